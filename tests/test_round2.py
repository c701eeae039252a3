"""Cases that earlier cuts lost: gaps in ids, failed pages, raising stages, folder roots."""

import os
import re
import time

import pandas as pd
import pytest

import peerscope as ps
from peerscope.operators.evaluate import compare_methods, evaluate
from peerscope.operators.extract import concat_pages, extract_text
from peerscope.sources.corpus import build_corpus, scan_corpus
from peerscope.sources.index_io import load_index, save_index, term_postings
from peerscope.sources.sinks import export_csv, read_csv


def test_alignment_keeps_pairs_whatever_gaps_the_ids_have(spark):
    papers = spark.createDataFrame([(0, "a"), (2, "b"), (5, "c"), (6, "d")], "doc_id long, author string")
    vectors = spark.createDataFrame([(0,), (2,), (5,), (9,)], "vec_id long")
    assert sorted(r.doc_id for r in ps.align_vectors(papers, vectors).collect()) == [0, 2, 5]
    left = sorted((r.id, r.missing) for r in ps.unmatched_ids(papers, vectors).collect())
    assert left == [(6, "vector"), (9, "paper")]
    by_place = ps.align_by_position(papers, vectors, "doc_id", "vec_id").collect()
    assert sorted((r.doc_id, r.vec_id) for r in by_place) == [(0, 0), (2, 2), (5, 5), (6, 9)]


def test_document_whose_pages_all_fail_reaches_the_dead_letter(spark):
    pages = spark.createDataFrame([(3, 0, None, "bad"), (3, 1, None, "bad"), (4, 0, "x", None), (4, 1, None, "bad")],
                                  "doc_id long, page_no int, text string, error string")
    got = {r.doc_id: (r.n_pages, r.text) for r in concat_pages(pages, error_col="error").collect()}
    assert got == {3: (0, ""), 4: (1, "x")}


def test_csv_keeps_blanks_at_the_ends(spark, tmp_dir):
    rows = [(" A ", "p.pdf", " two  words "), ("B", " q.pdf", "")]
    df = spark.createDataFrame(rows, "author string, paper string, processed_text string")
    assert export_csv(df, f"{tmp_dir}/csv")
    back = read_csv(spark, f"{tmp_dir}/csv", "author string, paper string, processed_text string")
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_python_stages_see_blank_rows_only_and_errors_fall_through(spark):
    calls = [spark.sparkContext.accumulator(0) for _ in range(3)]

    def first(s: pd.Series) -> pd.Series:
        calls[0].add(len(s))
        return s.where(s.str.startswith("a"), "")

    def second(s: pd.Series) -> pd.Series:
        calls[1].add(len(s))
        raise ValueError("broken reader")

    def third(s: pd.Series) -> pd.Series:
        calls[2].add(len(s))
        return s.where(s.str.startswith("b"), " ")

    df = spark.createDataFrame([(i, "abc"[i % 3] + str(i)) for i in range(99)], "id long, raw string").coalesce(1)
    got = extract_text(df, [("one", first), ("two", second), ("three", third)], "raw").collect()
    assert {(r.extractor, r.status) for r in got} == {("one", "ok"), ("three", "ok"), (None, "no_text")}
    assert all(r.raw_text == (r.raw if r.raw[0] in "ab" else "") for r in got)
    assert (calls[0].value, calls[2].value) == (99, 66)


def test_slow_page_is_given_up(spark):
    def slow(s: pd.Series) -> pd.Series:
        if s.iloc[0] == "slow":
            time.sleep(20)
        return s

    df = spark.createDataFrame([(1, "slow"), (2, "quick")], "id long, raw string").coalesce(1)
    start = time.time()
    got = {r.id: r.status for r in extract_text(df, [("s", slow)], "raw", timeout_s=0.5).collect()}
    assert got == {1: "no_text", 2: "ok"} and time.time() - start < 15


def _tree(root):
    for author, name in (("ann", "a.pdf"), ("bob/deep", "b.pdf"), (".", "c.pdf")):
        os.makedirs(os.path.join(root, author), exist_ok=True)
        with open(os.path.join(root, author, name), "w") as f:
            f.write(f"text of {name}")


def test_author_is_the_first_folder_below_any_root(spark, tmp_dir):
    root = os.path.join(tmp_dir, "my papers")
    _tree(root)
    for spelled in (root, root + "/", "file://" + root, os.path.join(tmp_dir, "x", "..", "my papers"),
                    os.path.relpath(root)):
        os.makedirs(os.path.join(tmp_dir, "x"), exist_ok=True)
        got = sorted((r.author, r.paper) for r in scan_corpus(spark, spelled).collect())
        assert got == [(".", "c.pdf"), ("ann", "a.pdf"), ("bob", "b.pdf")], spelled


def test_ingest_extracts_every_file_once(spark, tmp_dir):
    _tree(os.path.join(tmp_dir, "papers"))
    calls = spark.sparkContext.accumulator(0)

    def stage(s: pd.Series) -> pd.Series:
        calls.add(len(s))
        return s.map(lambda b: b.decode() if b"a.pdf" not in b else "")

    corpus, failed = build_corpus(spark, os.path.join(tmp_dir, "papers"), [("py", stage)])
    assert sorted((r.paper_id, r.author) for r in corpus.collect()) == [(0, "bob"), (1, ".")]
    assert failed.count() == 1 and calls.value == 3


def test_statuses_name_their_reason(spark):
    subs = spark.createDataFrame(
        [(1, "graph", [1.0, 0.0]), (2, "", [1.0, 0.0]), (3, "graph", None), (4, "graph", [1.0])],
        "query_id long, processed_text string, embedding array<double>")
    status = ps.submission_status(subs, corpus_dim=2)
    assert {r.query_id: r.status for r in status.collect()} == {
        1: "ok", 2: "no_text", 3: "no_vector", 4: "wrong_dimension"}
    papers = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, author string")
    lists = spark.createDataFrame([(1, 1, "x", 0.5)], "query_id long, rank int, author string, score double")
    rows = evaluate(subs.select("query_id"), papers, compare_methods(lists, lists), status).collect()
    assert {(r.query_id, r.status, r.tfidf_author) for r in rows} == {
        (1, "ok", "x"), (2, "no_text", None), (3, "no_vector", None), (4, "wrong_dimension", None)}


def _small_corpus(spark):
    words = ["graph", "query", "index", "neural", "signal", "vision"]
    rows = [(i, f"au{i % 4}", f"p{i}.pdf", " ".join(words[(i + j) % 6] for j in range(3 + i % 3)))
            for i in range(24)]
    return spark.createDataFrame(rows, "doc_id long, author string, paper string, processed_text string")


def test_saved_index_finds_terms_and_keeps_paper(spark, tmp_dir):
    corpus = _small_corpus(spark)
    index = ps.fit_tfidf(corpus, min_df=1, max_df=1.0)
    vectors = ps.hashing_vectors(corpus).withColumnRenamed("doc_id", "paper_id")
    save_index(f"{tmp_dir}/index", corpus, vectors, index)
    stored = load_index(spark, f"{tmp_dir}/index")
    assert stored.corpus.where("paper = 'p3.pdf'").count() == 1
    got = term_postings(stored, ["graph"])
    want = index.postings.where("term = 'graph'")
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in want.collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^]]*term", plan)


def test_exact_overfetch_fills_the_lists(spark):
    corpus = _small_corpus(spark)
    index = ps.fit_tfidf(corpus, min_df=1, max_df=1.0)
    vectors = ps.hashing_vectors(corpus).join(corpus.select("doc_id", "author"), "doc_id") \
        .withColumnRenamed("doc_id", "paper_id")
    subs = spark.createDataFrame([(1, "au0 au1: a graph query index")], "query_id long, raw_text string")
    top = ps.recommend(subs, index, vectors, k=3, overfetch=None, threshold=2.0,
                       encode=lambda t: ps.hashing_vectors(t, id_col="query_id")).collect()
    # two of four authors are named: the other two are all that is left of either list
    assert sorted((r.method, r.author) for r in top) == [
        (m, a) for m in ("embedding", "tfidf") for a in ("au2", "au3")]


@pytest.mark.parametrize("both", [False, True])
def test_stream_over_epochs_with_a_replay(spark, tmp_dir, both):
    corpus = _small_corpus(spark)
    index = ps.fit_tfidf(corpus, min_df=1, max_df=1.0)
    vectors = ps.hashing_vectors(corpus).join(corpus.select("doc_id", "author"), "doc_id") \
        .withColumnRenamed("doc_id", "paper_id")
    source, sink, ckpt = (os.path.join(tmp_dir, n) for n in ("in", "out", "ckpt"))
    for i, text in enumerate(["graph query", "neural signal", "vision index"]):
        spark.createDataFrame([(i, text)], "item_id long, text string").coalesce(1) \
            .write.mode("append").parquet(source)
    extra = {"vector_corpus": vectors, "encode": lambda t: ps.hashing_vectors(t, id_col="query_id")} if both else {}

    def run():
        ps.stream_recommendations(spark, source, spark.read.parquet(source).schema, index, sink, ckpt, k=3,
                                  max_files_per_trigger=1, **extra).awaitTermination()
        return sorted(map(str, spark.read.parquet(sink).collect()))

    first = run()
    assert sorted(os.listdir(sink)) == ["epoch=0", "epoch=1", "epoch=2"]
    # the last commit is lost: its epoch runs again and rewrites the same folder
    last = os.path.join(ckpt, "commits", "2")
    for name in (last, os.path.join(ckpt, "commits", ".2.crc")):
        if os.path.exists(name):
            os.unlink(name)
    assert run() == first
    methods = {r.method for r in spark.read.parquet(sink).collect()} if both else {"tfidf"}
    assert methods == ({"tfidf", "embedding"} if both else {"tfidf"})


def test_exact_overfetch_goes_past_authors_at_the_threshold(spark):
    """More authors reach the threshold than any fixed over-fetch holds."""
    rows = [(i, f"near{i:02d}", "graph query", [1.0, 0.0]) for i in range(30)]
    rows += [(100 + i, f"far{i}", "graph index", [0.5, 1.0]) for i in range(3)]
    corpus = spark.createDataFrame(rows, "doc_id long, author string, processed_text string, embedding array<double>")
    index = ps.fit_tfidf(corpus, min_df=1, max_df=1.0)
    vectors = corpus.select(corpus.doc_id.alias("paper_id"), "author", "embedding")
    subs = spark.createDataFrame([(1, "graph by far1", "graph", [1.0, 0.0]), (2, "x", "index", [0.0, 1.0])],
                                 "query_id long, raw_text string, processed_text string, embedding array<double>")
    top = ps.recommend(subs, index, vectors, k=3, overfetch=None).collect()
    got = {(r.query_id, r.method): [x.author for x in sorted(top, key=lambda x: x["rank"])
                                    if (x.query_id, x.method) == (r.query_id, r.method)] for r in top}
    assert got[1, "embedding"] == got[1, "tfidf"] == ["far0", "far2"]
    assert got[2, "embedding"] == got[2, "tfidf"] == ["far0", "far1", "far2"]
