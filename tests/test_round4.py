"""Whole corpora submitted, saved and searched: what is written and moved stays small, the rows stay the same."""

import os
import random

import numpy as np
import pytest

import peerscope.operators.sparse_block as sparse_block
from peerscope.operators.recommend import recommend_tfidf
from peerscope.operators.sizing import Limits
from peerscope.operators.tfidf import fit_tfidf
from peerscope.session import checkpoint_dir


def _tables(spark):
    folder = os.path.join(checkpoint_dir(spark).removeprefix("file:"), "tables")
    return {os.path.join(folder, name) for name in os.listdir(folder)} if os.path.isdir(folder) else set()


def _texts(n, words, length, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choices(words, k=rng.randint(1, length))) for _ in range(n)]


def _words(n):
    return [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(n)]


def test_block_scoring_writes_blocks_and_no_row_for_every_term(spark):
    texts = _texts(90, _words(40), 60, 1)
    corpus = spark.createDataFrame([(i, f"a{i % 6}", t) for i, t in enumerate(texts)], "doc_id long, author string, processed_text string")
    index = fit_tfidf(corpus, min_df=2, max_df=1.0)
    before = _tables(spark)
    got = recommend_tfidf(corpus.withColumnRenamed("doc_id", "query_id"), index, k=3, scoring="block")
    assert got.count() == 90 * 3
    rows = sum(spark.read.parquet(t).count() for t in _tables(spark) - before)
    assert rows <= 90 + 2 * 4 * spark.sparkContext.defaultParallelism < index.postings.count()


@pytest.mark.parametrize("common", [0, 1, 200])
def test_block_scoring_gives_the_lists_of_the_join(spark, monkeypatch, common):
    """Repeated ids are one submission; ids that are missing, blank texts and unknown words have no term."""
    monkeypatch.setattr(sparse_block, "_COMMON", common)
    monkeypatch.setattr(sparse_block, "_COMMON_TERMS", 3)
    words = _words(30)
    corpus = spark.createDataFrame([(i, f"a{i % 7}" if i % 11 else None, t) for i, t in enumerate(_texts(70, words, 300, 2))],
                                   "doc_id long, author string, processed_text string")
    rows = [(str(i // 2), t) for i, t in enumerate(_texts(50, words + ["unknown"], 300, 3))]
    rows += [("x", "unknown"), ("y", ""), ("z", None), (None, words[0])]
    asked = spark.createDataFrame(rows, "query_id string, processed_text string")
    limits = Limits(block_rows=4, chunk_bytes=900, lane_bytes=2_000)
    index = fit_tfidf(corpus, min_df=2, max_df=1.0, limits=limits)
    want, got = ({(r.query_id, r.rank): (r.author, pytest.approx(r.score, abs=1e-9)) for r in recommend_tfidf(
        asked, index, k=4, scoring=scoring, limits=limits).collect()} for scoring in ("join", "block"))
    assert len(want) == 27 * 4 and got == want


def _shard(rows, bm25_search):
    """(shard, query terms, their starts, idf) of texts that are documents and queries."""
    words = bm25_search.WordHashes()
    found = [bm25_search.term_counts(t, words) for t in rows]
    terms = np.concatenate([t for t, _, _ in found])
    tfs = np.concatenate([c for _, c, _ in found])
    docs = np.repeat(np.arange(len(rows)), [len(t) for t, _, _ in found])
    by = np.argsort(terms, kind="stable")
    firsts = np.flatnonzero(np.r_[True, np.diff(terms[by]) != 0])
    arrays = {"doc_ids": np.arange(len(rows)), "lengths": np.array([n for _, _, n in found], np.int64), "terms": terms[by][firsts],
              "starts": np.append(firsts, len(by)), "docs": docs[by].astype(np.uint16), "tfs": tfs[by].astype(np.uint8)}
    shard = bm25_search.Shard({c: a.tobytes() for c, a in arrays.items()}, np.mean([n for _, _, n in found]))
    df = np.bincount(np.searchsorted(shard.terms, terms), minlength=len(shard.terms))[np.searchsorted(shard.terms, terms)]
    return shard, terms, np.cumsum([0] + [len(t) for t, _, _ in found]), np.log1p((len(rows) - df + 0.5) / (df + 0.5))


@pytest.mark.parametrize("added,cells", [(500_000, 2_000_000), (7, 1_000)])
def test_bm25_adds_the_lists_of_a_block_of_queries_together(monkeypatch, added, cells):
    """No query is searched alone while its lists are short; queries whose bounds stay below their threshold give nothing."""
    from peerscope.llm import bm25_search
    monkeypatch.setattr(bm25_search, "ADDED", added)
    monkeypatch.setattr(bm25_search, "COMMON_CELLS", cells)
    shard, terms, starts, idf = _shard(_texts(120, _words(200), 50, 4), bm25_search)
    want = np.zeros((120, 120))
    for q in range(120):
        for t, w in zip(terms[starts[q]:starts[q + 1]], idf[starts[q]:starts[q + 1]]):
            at = np.searchsorted(shard.terms, t)
            mine = slice(shard.starts[at], shard.starts[at + 1])
            want[q, shard.docs[mine]] += w * shard.weights[mine]
    monkeypatch.setattr(shard, "search", lambda *_: pytest.fail("a query was searched alone"))
    tenth = np.sort(want, axis=1)[:, -10]
    least = np.where(np.arange(120) % 3 == 1, tenth, np.where(np.arange(120) % 3 == 2, 1e9, 0.0))
    seen = []
    for q, places, scores in shard.search_block(starts, terms, idf, np.full(120, 10), least):
        seen.append(q)
        first = np.lexsort((places, -np.round(scores, 9)))[:10]
        order = np.lexsort((np.arange(120), -np.round(want[q], 9)))[:10]
        order = order[want[q][order] > 0]
        assert places[first].tolist() == order.tolist() and np.allclose(scores[first], want[q][order])
    assert seen == [q for q in range(120) if q % 3 != 2]


def test_a_saved_index_moves_packed_rows_and_stores_counts(spark, tmp_dir):
    from peerscope.operators.sparse_block import document_vectors
    from peerscope.sources import index_io
    texts = _texts(80, _words(60), 40, 6)
    corpus = spark.createDataFrame([(f"d{i}", f"a{i % 5}" if i % 9 else None, t) for i, t in enumerate(texts)],
                                   "doc_id string, author string, processed_text string")
    vectors = corpus.selectExpr("doc_id as paper_id", "array(1.0F) as embedding")
    index = fit_tfidf(corpus, min_df=2, max_df=1.0)
    rows = index.postings.count()
    starts = index_io._file_starts(index.postings, rows, "doc_id", 5)
    moved = index.postings.repartition(3).mapInArrow(index_io._packed_rows(starts, "doc_id"), "file int, rows binary")
    assert len(starts) == 4 and moved.count() <= 3 * 5 and {r.file for r in moved.collect()} == set(range(5))
    path = tmp_dir
    for again in range(2):      # fitted, then loaded and saved again
        version = index_io.save_index(path, corpus, vectors, index, postings_per_file=rows // 5 + 1)
        stored = index_io.load_index(spark, path).tfidf
        written = spark.read.parquet(os.path.join(path, "versions", version, "docvecs"))
        assert written.columns == ["doc_id", "author", "terms", "tfs", "dfs", "norm"] and written.count() == document_vectors(index).count()
        assert sorted(map(repr, document_vectors(stored).collect())) == sorted(map(repr, document_vectors(index).collect()))
        assert sorted(map(repr, stored.postings.collect())) == sorted(map(repr, index.postings.collect()))
        index, path = stored, f"{tmp_dir}/again"
    # an index without counts keeps its weights
    plain = type(stored)(vocab=stored.vocab, postings=stored.postings, docs=stored.docs, n_docs=stored.n_docs, vocab_size=stored.vocab_size)
    index_io.save_index(f"{tmp_dir}/plain", corpus, vectors, plain)
    loaded = index_io.load_index(spark, f"{tmp_dir}/plain").tfidf
    unordered = lambda rows: sorted((r.doc_id, r.author or "", sorted(zip(r.terms, r.weights))) for r in rows.collect())
    assert unordered(document_vectors(loaded)) == unordered(document_vectors(stored))


def test_lists_are_ranked_without_rounding_every_score(monkeypatch):
    """Only candidates near a list's end are rounded; ties, missing scores and bounds give the lists of a plain sort."""
    from peerscope.operators import blocks
    rng = np.random.default_rng(5)
    plain, rounded = np.round, []
    monkeypatch.setattr(blocks.np, "round", lambda x, *a: rounded.append(np.size(x)) or plain(x, *a))
    for ties in (False, True):
        scores = rng.normal(size=(40, 300))
        if ties:
            scores = plain(scores, 1) + rng.choice([0.0, 2e-10], scores.shape)
        scores[rng.random(scores.shape) < 0.02] = np.nan
        scores[3] = np.nan
        filled = np.where(np.isnan(scores), -np.inf, plain(scores, 9))
        for k in (1, 5, 299, 300, 400):
            order = np.argsort(-filled, axis=1, kind="stable")[:, :k]
            want = [(q, c) for q in range(40) for c in sorted(order[q].tolist())]
            rounded.clear()
            assert list(zip(*(x.tolist() for x in blocks.first_k(scores, np.arange(300), k)))) == want
            assert ties or k > 5 or sum(rounded) < scores.size / 2
            least = np.array([filled[q, order[q, -1]] - 4e-9 for q in range(40)])
            least[:2] = np.nan, -np.inf
            q, c = blocks.first_k(scores, np.arange(300), k, least)
            assert set(zip(q.tolist(), c.tolist())) >= {(a, b) for a, b in want if scores[a, b] >= least[a]}
            assert max(np.bincount(q)) <= k
