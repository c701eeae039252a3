"""What travels or is written follows the documents and vectors, not their pairs or n-grams."""

import math
import random

import pytest

from peerscope.operators.dense import _nearest
from peerscope.operators.sizing import Limits
from peerscope.operators.sparse_block import block_author_scores, document_vectors
from peerscope.operators.tfidf import fit_tfidf, sparse_cosine, term_counts, transform_tfidf


def _corpus(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, author string, processed_text string")


def test_the_index_is_written_as_one_row_per_document(spark):
    rng = random.Random(3)
    rows = [(i, f"a{i % 5}", " ".join(rng.choices(["red", "green", "blue", "black", "white"], k=12))) for i in range(60)]
    index = fit_tfidf(_corpus(spark, rows), min_df=2, max_df=1.0, limits=Limits(chunk_bytes=300))
    assert index.postings.count() > 300
    assert spark.read.parquet(*index.postings.inputFiles()).count() == 60
    # block scoring reads the same rows: nothing is grouped and written again
    assert sorted(document_vectors(index).inputFiles()) == sorted(index.postings.inputFiles())
    ids = [r.term_id for r in index.vocab.collect()]
    assert len(set(ids)) == len(ids) == index.vocab_size


def test_rows_that_share_an_id_share_a_norm_and_rows_without_one_only_count(spark):
    rows = [(1, "a", "red green"), (1, "b", "red blue"), (1, "a", "red"), (None, "c", "red blue"), (None, "c", None), (2, None, "blue")]
    index = fit_tfidf(_corpus(spark, rows), min_df=1, max_df=1.0, ngram_max=1)
    n, df = 6, {"red": 4, "green": 1, "blue": 3}
    idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in df.items()}
    assert {r.term: (r.df, pytest.approx(r.idf)) for r in index.vocab.collect()} == {t: (df[t], idf[t]) for t in df}
    norm = math.sqrt(3 * idf["red"] ** 2 + idf["green"] ** 2 + idf["blue"] ** 2)
    want = [(1, "a", "green", 1, idf["green"] / norm), (1, "a", "red", 1, idf["red"] / norm), (1, "a", "red", 1, idf["red"] / norm),
            (1, "b", "blue", 1, idf["blue"] / norm), (1, "b", "red", 1, idf["red"] / norm), (2, None, "blue", 1, 1.0)]
    got = sorted(((r.doc_id, r.author, r.term, r.tf, r.weight) for r in index.postings.collect()), key=repr)
    assert [g[:4] for g in got] == [w[:4] for w in sorted(want, key=repr)]
    assert [g[4] for g in got] == pytest.approx([w[4] for w in sorted(want, key=repr)])


def test_few_queries_do_not_move_the_postings(spark):
    index = fit_tfidf(_corpus(spark, [(i, "a", "red green blue") for i in range(9)]), min_df=1, max_df=1.0)
    asked = spark.createDataFrame([(1, "red blue")], "query_id long, processed_text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = sparse_cosine(transform_tfidf(asked, index), index)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_pruned_search_leaves_one_list_per_lane(spark):
    rng = random.Random(8)
    rows = [(i, f"a{i}", [rng.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    corpus = spark.createDataFrame(rows, "paper_id long, author string, embedding array<double>")
    queries = corpus.selectExpr("paper_id as query_id", "embedding")
    limits = Limits(block_rows=10, whole_blocks=1)
    found = _nearest(queries, corpus, 2, "query_id", "paper_id", "author", "embedding", limits, by_author=False)
    # the home block and one lane of all other blocks, not one list for each of some thirty blocks
    assert found.count() <= 2 * 2 * 300
    lanes = Limits(block_rows=10, whole_blocks=1, lane_values=600)
    again = _nearest(queries, corpus, 2, "query_id", "paper_id", "author", "embedding", lanes, by_author=False)
    assert again.count() <= 2 * 4 * 300 + 300


def test_counts_are_made_by_one_pass_over_each_text(spark):
    counts = term_counts(_corpus(spark, [(1, "a", "red red x blue"), (2, "b", ""), (3, None, None)]))
    got = sorted((r.doc_id, r.author, r.term, r.tf) for r in counts.collect())
    assert got == [(1, "a", "blue", 1), (1, "a", "red", 2), (1, "a", "red blue", 1), (1, "a", "red red", 1)]
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "lambdafunction" not in plan


def test_block_scoring_leaves_one_list_per_lane(spark):
    rng = random.Random(9)
    words = [f"w{chr(97 + i // 10)}{chr(97 + i % 10)}" for i in range(60)]
    rows = [(i, f"a{i % 9}", " ".join(rng.choices(words, k=15))) for i in range(160)]
    corpus = _corpus(spark, rows)
    index = fit_tfidf(corpus, min_df=2, max_df=1.0)
    queries = transform_tfidf(corpus.where("doc_id < 40").withColumnRenamed("doc_id", "query_id"), index)
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        # more blocks of documents than lanes
        blocks = 5 * spark.sparkContext.defaultParallelism
        got = block_author_scores(queries, index, 3, limits=Limits(block_rows=160 // blocks)).collect()
    finally:
        spark.conf.set(threshold, before)
    assert len(got) <= 40 * 3 * spark.sparkContext.defaultParallelism
    best = {}
    for r in got:
        best.setdefault(r.query_id, {}).setdefault(r.author, []).append(r.score)
    want = {}
    for r in sparse_cosine(queries, index).collect():
        want.setdefault(r.query_id, {}).setdefault(r.author, []).append(r.score)
    first = lambda lists: {q: [(a, round(max(s), 9)) for a, s in sorted(      # noqa: E731
        by.items(), key=lambda x: (-round(max(x[1]), 9), x[0]))][:3] for q, by in lists.items()}
    assert first(best) == first(want)
