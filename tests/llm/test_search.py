import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from fixtures import awkward, awkward_rows, empty, words
from peerscope.llm import bm25_search
from peerscope.llm.ann_graph import build_graph, beam_search, nearest_neighbours, robust_prune, unit_rows, valid_vectors
from peerscope.llm.bm25_search import bm25_top_k


def brute_bm25(rows, queries, k):
    def terms(t):
        return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = [(i, Counter(terms(t))) for i, t in rows if i is not None and terms(t)]
    n, average = len(docs), sum(sum(c.values()) for _, c in docs) / len(docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for q, text in queries:
        scored = []
        for i, c in docs:
            if i == q:
                continue
            s = 0.0
            for t in set(terms(text)):
                if c[t]:
                    idf = math.log1p((n - df[t] + 0.5) / (df[t] + 0.5))
                    s += idf * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / average))
            if s > 0:
                scored.append((-round(s, 9), i))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def test_bm25_equals_brute_force(spark, monkeypatch):
    rows = [(i, words(i % 23, 30 + i % 50) + " " + words(i % 7, 15)) for i in range(300)]
    rows += [(r[0] + 1000 if r[0] is not None else None, r[1]) for r in awkward_rows()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    queries = docs.where(F.col("doc_id") % 9 == 0).dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "query_id")
    asked = [(r["query_id"], r["text"]) for r in queries.collect()]
    want = sorted(brute_bm25(rows, asked, 10))
    for chars in (24_000_000, 4_000):                 # one shard a task, and many
        monkeypatch.setattr(bm25_search, "SHARD_CHARS", chars)
        got = sorted(tuple(r) for r in bm25_top_k(docs, queries, query_block=16).collect())
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert np.allclose([g[3] for g in got], [w[3] for w in want])


def test_bm25_on_awkward_and_empty_tables(spark):
    docs = awkward(spark).select("doc_id", "text")
    queries = docs.where("doc_id in (0, 1, 8)").withColumnRenamed("doc_id", "query_id")
    assert {r["query_id"] for r in bm25_top_k(docs, queries).collect()} <= {8}
    none = empty(spark)
    assert bm25_top_k(none, none.withColumnRenamed("doc_id", "query_id").select("query_id", "text")).count() == 0


def test_pruned_graph_is_searched_with_high_recall():
    x = unit_rows(np.random.default_rng(5).normal(size=(1500, 24)))
    graph, entry = build_graph(x)
    assert graph.max() < len(x) and not (graph == np.arange(len(x))[:, None]).any()
    queries = unit_rows(np.random.default_rng(6).normal(size=(100, 24)))
    found, _ = beam_search(x, graph, entry, queries, 96)
    true = np.argsort(-(queries @ x.T), axis=1)[:, :5]
    assert np.mean([len(set(t) & set(f[:5])) / 5 for t, f in zip(true, found)]) > 0.95


def test_pruning_drops_what_a_kept_neighbour_covers():
    x = unit_rows(np.array([[1, 0], [1, 0.1], [1, 0.11], [1, -0.3]], float))
    kept = robust_prune(x, np.array([0]), np.array([[1, 2, 3, 0, -1, 1]]), 1.2, 3)
    assert kept.tolist() == [[1, 3, -1]]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_neighbours_with_copies_and_invalid_vectors(spark):
    rng = np.random.default_rng(7)
    points = rng.normal(size=(300, 8)).astype(np.float32)
    points[60:200] = points[60]                        # one vector many times
    rows = [(i, [float(v) for v in p], 0) for i, p in enumerate(points)]
    rows += [(1000, None, 0), (1050, [0.0] * 8, 0), (1100, [float("nan")] * 8, 0),
             (1150, [None] * 8, 0), (1200, [1.0, 2.0], 0), (1250, [], 0)]
    v = valid_vectors(vectors(spark, rows))
    got = nearest_neighbours(v, v.where("vec_id % 50 = 0"), shard_points=100, query_block=3).collect()
    x = points.astype(float)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hits = total = 0
    for q in range(0, 300, 50):
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        s = np.round(u @ u[q], 9)
        s[q] = -9
        want = np.lexsort((np.arange(300), -s))[:5]
        assert len(mine) == 5 and all(abs(m[2] - float(u[m[1]] @ u[q])) < 1e-9 for m in mine)
        hits += len(set(want) & {m[1] for m in mine})
        total += 5
        if 60 <= q < 200:
            assert [m[1] for m in mine] == want.tolist()
    assert hits / total >= 0.9
    assert not {r["query_id"] for r in got} & {1000, 1050, 1100, 1150, 1200, 1250}


def test_rows_that_repeat_a_vec_id(spark):
    rng = np.random.default_rng(17)
    points = rng.normal(size=(90, 6)).astype(np.float32)
    ids = [int(i) for i in rng.integers(0, 60, 90)]
    ids[:4], points[1], points[3] = [50, 50, 50, 7], points[0], points[0]
    rows = [(i, [float(v) for v in p], 0) for i, p in zip(ids, points)]
    rows.append((None, [1.0] * 6, 0))
    v = valid_vectors(vectors(spark, rows))
    for shard_points in (4096, 30):
        got = nearest_neighbours(v, v.where("vec_id % 50 = 0"), shard_points=shard_points).collect()
        x = points.astype(float)
        u = x / np.linalg.norm(x, axis=1)[:, None]
        want = []
        for q in [i for i, own in enumerate(ids) if own % 50 == 0]:
            near = np.round(u @ u[q], 9)
            others = sorted((-near[j], ids[j]) for j in range(90) if j != q)[:5]
            want += [(ids[q], rank, j, -s) for rank, (s, j) in enumerate(others, 1)]
        assert sorted((r[0], r[1], r[2], round(r[3], 9)) for r in got) == sorted(want)


def test_no_vectors(spark):
    v = valid_vectors(vectors(spark, [(50, None, 0)]))
    assert nearest_neighbours(v, v).count() == 0


def test_bm25_lanes_leave_one_list_a_query(spark, monkeypatch):
    """More shards on a lane give no more rows: what a lane leaves follows the queries only."""
    monkeypatch.setattr(bm25_search, "LANES", 2)
    rows = [(i, words(i % 23, 30 + i % 50) + " " + words(i % 7, 15)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = [r for r in rows if r[0] % 9 == 0]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    monkeypatch.setattr(bm25_search, "SHARD_CHARS", 1_000)
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", 1)
    plain = bm25_search._search
    counted = spark.sparkContext.accumulator(0)

    def counting(*args):
        run = plain(*args)

        def body(batches):
            for batch in run(batches):
                counted.add(batch.num_rows)
                yield batch
        return body

    monkeypatch.setattr(bm25_search, "_search", counting)
    got = sorted(tuple(r) for r in bm25_top_k(docs, queries, query_block=16).collect())
    assert [g[:3] for g in got] == [w[:3] for w in sorted(brute_bm25(rows, asked, 10))]
    assert 0 < counted.value <= 2 * 10 * len(asked)


def test_bm25_takes_one_shard_at_a_time(spark, monkeypatch):
    """Batches are bounded by bytes, whatever number of shards and query blocks meets on a lane; long counts stay whole."""
    monkeypatch.setattr(bm25_search, "LANES", 1)
    monkeypatch.setattr(bm25_search, "BATCH_BYTES", "1k")
    monkeypatch.setattr(bm25_search, "SHARD_CHARS", 2_000)
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", 1)
    rows = [(i, words(i % 13, 60) + " often" * (300 * (i == 7) + i % 3)) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    asked = [r for r in rows if r[0] % 4 == 3]
    plain, seen = bm25_search._search, [spark.sparkContext.accumulator(0) for _ in range(2)]

    def counting(*args):
        run = plain(*args)

        def taken(batches):
            for batch in batches:
                seen[0].add(1)
                seen[1].add(batch.num_rows)
                yield batch
        return lambda batches: run(taken(batches))

    monkeypatch.setattr(bm25_search, "_search", counting)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    got = sorted(tuple(r) for r in bm25_top_k(docs, spark.createDataFrame(asked, "query_id long, text string"),
                                              query_block=5).collect())
    want = sorted(brute_bm25(rows, asked, 10))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want])
    assert seen[0].value == seen[1].value > 20
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_bm25_adds_the_lists_of_a_query_at_once(spark, monkeypatch):
    """A query's lists are added in one go or not at all, by common and by rare words, with and without a threshold."""
    rows = [(i, words(i % 23, 40 + i % 50) + " " + words(100 + i % 60, 60) + f" rare{i % 40} rare{i % 11}") for i in range(400)]
    index = bm25_search.build_index(spark.createDataFrame(rows, "doc_id long, text string").repartition(1)).collect()
    hashes, counts = bm25_search.WordHashes(), Counter()
    found = {i: bm25_search.term_counts(t, hashes) for i, t in rows}
    for terms, _, _ in found.values():
        counts.update(terms.tolist())
    average = sum(n for _, _, n in found.values()) / len(rows)
    asked = list(range(0, 400, 9))
    terms = np.concatenate([found[q][0] for q in asked])
    starts = np.cumsum([0] + [len(found[q][0]) for q in asked])
    df = np.array([counts[t] for t in terms.tolist()], float)
    idf = np.log1p((len(rows) - df + 0.5) / (df + 0.5))
    want = {}
    for q, _, doc, score in brute_bm25(rows, [rows[q] for q in asked], 10):
        want.setdefault(q, []).append((doc, score))
    shard = bm25_search.Shard(index[0].asDict(), average)
    assert len(index) == 1 and 0 < len(shard.common) < len(shard.terms)
    plain, calls = shard._add, []
    monkeypatch.setattr(shard, "_add", lambda *args: calls.append(1) or plain(*args))
    for short, least in ((8, 0.0), (8, None), (0, None)):
        monkeypatch.setattr(bm25_search, "SHORT", short)
        calls.clear()
        bounds = np.array([want[q][-1][1] if least is None else least for q in asked])
        seen = 0
        for at, places, scores in shard.search_block(starts, terms, idf, np.full(len(asked), 11), bounds):
            mine = sorted((-round(s, 9), i) for s, i in zip(scores.tolist(), shard.ids[places].tolist()) if i != asked[at])[:10]
            assert [i for _, i in mine] == [i for i, _ in want[asked[at]]]
            assert np.allclose([-s for s, _ in mine], [s for _, s in want[asked[at]]])
            seen += 1
        assert seen == len(asked) and (short == 0 or len(calls) <= len(asked))
    assert not list(shard.search_block(starts, terms, idf, np.full(len(asked), 11), np.full(len(asked), 1e6)))
