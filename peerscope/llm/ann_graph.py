"""Approximate nearest neighbours on robust-pruned directed graphs, one per shard.

Equal vectors are one point (with its smallest ids, as many as a query may need),
and points are dealt to shards of about ``shard_points`` by a hash. In a
shard every point gets at most ``degree`` out-edges: greedy searches for the
point itself from the medoid propose neighbours, and the relaxed
distance rule keeps a neighbour only if no kept one is closer to it by the factor
``alpha``; edges are mirrored and pruned again where a point has too many.
Queries, in blocks, are searched in every shard by a beam over its graph;
the proposals are scored exactly in double precision on the original vectors and merged.

Work inside a shard is numpy on bounded arrays; Spark deals points, pairs
query blocks with shards by a join on the shard number, and merges.

Defined results: rows without a vec_id, null vectors, zero vectors and vectors with null or non-finite
components take no part; vectors are compared within one dimension; rows that repeat a
vector are neighbours with the score of equal vectors, smaller ids first; rows that
repeat a vec_id are rows of their own, as queries (a list each) and as neighbours, and a query leaves
out one row only, with its vec_id and vector; no valid vector gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peerscope.llm.common import written

DEGREE = 32
BUILD_BEAM = 48
SEARCH_BEAM = 128
ALPHA = 1.2
SHARD_POINTS = 4096
QUERY_BLOCK = 1024
_EXPAND = 4            # beam entries opened per step
_BATCH = 256


def unit_rows(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)).astype(np.float32)


def beam_search(x: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int,
                keep_visited: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(ids, similarities) of the best ``beam`` points met, best first, -1 where there are fewer.

    All queries step together; each opens its best unopened entries, scores
    their out-neighbours that it has not met, and keeps the best ``beam``.
    With ``keep_visited`` every point met is returned (for pruning).
    """
    rows = np.arange(len(queries))[:, None]
    met = np.zeros((len(queries), len(x) + 1), bool)
    met[:, -1] = True                                    # the place of missing neighbours (-1)
    ids = np.full((len(queries), 1), entry)
    near = (queries @ x[entry])[:, None]
    opened = np.zeros((len(queries), 1), bool)
    met[:, entry] = True
    seen_ids, seen_near = [ids], [near]
    while True:
        order = np.argsort(np.where(opened | (ids < 0), np.inf, -near), axis=1)[:, :_EXPAND]
        todo = ~np.take_along_axis(opened | (ids < 0), order, 1)
        if not todo.any():
            break
        np.put_along_axis(opened, order, True, 1)
        at = np.where(todo, np.take_along_axis(ids, order, 1), -1)
        new = np.where((at >= 0)[:, :, None], graph[at], -1).reshape(len(queries), -1)
        new = np.where(met[rows, new], -1, new)
        # a neighbour of two opened entries counts once
        new = np.sort(new, axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        met[rows, new] = True
        live = (new >= 0).any(axis=0)
        new = new[:, live]
        score = np.where(new >= 0, np.einsum("qd,qnd->qn", queries, x[new]), -np.inf)
        if keep_visited:
            seen_ids.append(new)
            seen_near.append(score)
        ids = np.concatenate([ids, new], axis=1)
        near = np.concatenate([near, score], axis=1)
        opened = np.concatenate([opened, new < 0], axis=1)
        if ids.shape[1] > beam:
            best = np.argpartition(-near, beam - 1, axis=1)[:, :beam]
            ids, near, opened = (np.take_along_axis(v, best, 1) for v in (ids, near, opened))
    if keep_visited:
        ids, near = np.concatenate(seen_ids, axis=1), np.concatenate(seen_near, axis=1)
    order = np.argsort(-near, axis=1, kind="stable")[:, :beam if not keep_visited else 4 * beam]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)


def robust_prune(x: np.ndarray, points: np.ndarray, ids: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """(points, degree) kept neighbours among the candidates ``ids`` (-1: none), nearest first.

    Distances are squared Euclidean between unit vectors, 2 - 2 * similarity;
    ``alpha`` is a factor of distances, so it enters squared.
    """
    ids = np.where(ids == points[:, None], -1, ids)
    ids = np.sort(ids, axis=1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
    far = np.where(ids >= 0, 2 - 2 * np.einsum("pd,pnd->pn", x[points], x[ids]), np.inf)
    order = np.argsort(far, axis=1, kind="stable")
    ids, far = np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)
    width = int((ids >= 0).sum(axis=1).max(initial=0))
    ids, far = ids[:, :width], far[:, :width]
    kept = np.full((len(points), degree), -1, np.int32)
    if not width:
        return kept
    vectors = x[ids]
    alive = ids >= 0
    each = np.arange(len(points))
    for slot in range(degree):
        at = alive.argmax(axis=1)
        some = alive[each, at]
        if not some.any():
            break
        kept[:, slot] = np.where(some, ids[each, at], -1)
        between = 2 - 2 * np.einsum("pd,pnd->pn", vectors[each, at], vectors)
        alive &= ~(some[:, None] & (alpha * alpha * between <= far))
        alive[each, at] = False
    return kept


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA,
                seed: int = 11) -> tuple[np.ndarray, int]:
    """(n, degree) out-neighbours (-1: none) and the medoid of unit vectors ``x``."""
    n, rng = len(x), np.random.default_rng(seed)
    medoid = int((x @ x.mean(axis=0)).argmax())
    start = min(degree, max(0, n - 1))
    graph = np.full((n, degree), -1, np.int32)
    if start:
        graph[:, :start] = (np.arange(n)[:, None] + rng.integers(1, n, (n, start))) % n
    for relaxed in (1.0, alpha):
        order = rng.permutation(n)
        for i in range(0, n, _BATCH):
            points = order[i:i + _BATCH]
            ids, _ = beam_search(x, graph, medoid, x[points], beam, keep_visited=True)
            graph[points] = robust_prune(x, points, np.concatenate([ids, graph[points]], axis=1), relaxed, degree)
            # mirrored edges
            to, back = graph[points].ravel(), np.repeat(points, degree)
            to, back = to[to >= 0], back[to >= 0]
            by = np.argsort(to, kind="stable")
            to, back = to[by], back[by]
            targets, first, count = np.unique(to, return_index=True, return_counts=True)
            more = np.full((len(targets), count.max(initial=0)), -1, np.int64)
            more[np.repeat(np.arange(len(targets)), count), np.arange(len(to)) - np.repeat(first, count)] = back
            for j in range(0, len(targets), _BATCH):
                t = targets[j:j + _BATCH]
                graph[t] = robust_prune(x, t, np.concatenate([graph[t], more[j:j + _BATCH]], axis=1),
                                        relaxed, degree)
    return graph, medoid


# -- the plan -------------------------------------------------------------------

def valid_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id long, vector) of the rows that take part."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    nonzero = F.exists(v, lambda c: c != 0)
    return rows.where(F.col(id_col).isNotNull() & v.isNotNull() & finite & nonzero).select(
        F.col(id_col).cast("long").alias("vec_id"), v.alias("vector"))


def distinct_points(vectors: DataFrame, copies: int) -> DataFrame:
    """(point, ids, vector): every distinct vector with its ``copies`` smallest ids."""
    turn = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    few = vectors.withColumn("turn", turn).where(F.col("turn") <= copies)
    return few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(
        F.get("ids", 0).alias("point"), "ids", "vector")


def _index(copies: int):
    """One shard: its points, their smallest ids and the graph, as arrays in one row."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("point", ignore_index=True)
        x = np.stack(rows["vector"].to_numpy()).astype(np.float64)
        ids = np.full((len(rows), copies), -1, np.int64)
        for i, own in enumerate(rows["ids"]):
            ids[i, :len(own)] = own
        graph, medoid = build_graph(unit_rows(x))
        return pd.DataFrame({
            "shard": rows["shard"].iloc[:1], "dim": np.int32(x.shape[1]), "medoid": np.int32(medoid),
            "vectors": [x.tobytes()], "ids": [ids.tobytes()], "graph": [graph.tobytes()]})
    return run


def build_index(vectors: DataFrame, copies: int, shard_points: int = SHARD_POINTS) -> DataFrame:
    """The written index: one row per shard (shard, dim, medoid, vectors, ids, graph)."""
    points = written(distinct_points(vectors, copies).withColumn("dim", F.size("vector")), "ann-points")
    sizes = points.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / shard_points).cast("int").alias("shards"))
    dealt = (points.join(sizes, "dim")
             .withColumn("shard", F.concat_ws(":", "dim", F.pmod(F.xxhash64("point"), F.col("shards")))))
    return written(dealt.select("shard", "point", "ids", "vector").groupBy("shard").applyInPandas(
        _index(copies), "shard string, dim int, medoid int, vectors binary, ids binary, graph binary"),
        "ann-index")


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    x = np.stack(rows["vector"].to_numpy()).astype(np.float64)
    return pd.DataFrame({"dim": [x.shape[1]], "block": rows["block"].iloc[:1].to_numpy(),
                         "rows": [rows["row"].to_numpy(np.int64).tobytes()],
                         "queries": [rows["vec_id"].to_numpy(np.int64).tobytes()], "wanted": [x.tobytes()]})


def _search(copies: int, k: int, beam: int):
    """Task function: a block of queries in one shard, scored exactly."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for r in batch.to_pylist()):
            dim = row["dim"]
            x = np.frombuffer(row["vectors"], np.float64).reshape(-1, dim)
            ids = np.frombuffer(row["ids"], np.int64).reshape(len(x), copies)
            graph = np.frombuffer(row["graph"], np.int32).reshape(len(x), -1)
            query_rows = np.frombuffer(row["rows"], np.int64)
            query_ids = np.frombuffer(row["queries"], np.int64)
            wanted = np.frombuffer(row["wanted"], np.float64).reshape(-1, dim)
            unit, units, norms = unit_rows(x), unit_rows(wanted), np.linalg.norm(x, axis=1)
            for i in range(0, len(wanted), _BATCH):
                found, _ = beam_search(unit, graph, row["medoid"], units[i:i + _BATCH], beam)
                found = found[:, :4 * (k + 1)]
                w = wanted[i:i + _BATCH]
                score = np.einsum("qd,qnd->qn", w, x[found]) / (
                    np.linalg.norm(w, axis=1)[:, None] * norms[found])
                score = np.where(found >= 0, score, -np.inf)
                best = np.argsort(-score, axis=1, kind="stable")[:, :k + 1]
                found, score = np.take_along_axis(found, best, 1), np.take_along_axis(score, best, 1)
                query, other = query_ids[i:i + _BATCH], ids[found]
                keep = (other >= 0) & np.isfinite(score)[:, :, None]
                # the query's own row: the first with its id at the point of its vector, and no other
                own = keep & (other == query[:, None, None]) & (x[found] == w[:, None]).all(axis=2)[:, :, None]
                flat = own.reshape(len(w), -1)
                each = np.flatnonzero(flat.any(axis=1))
                keep.reshape(len(w), -1)[each, flat[each].argmax(axis=1)] = False
                at = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query_rows[i + at[0]]), pa.array(query[at[0]]), pa.array(other[at]),
                     pa.array(score[at[0], at[1]])], names=["row", "query_id", "vec_id", "score"])
    return run


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 5, beam: int = SEARCH_BEAM,
                       shard_points: int = SHARD_POINTS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every query row, its own row left out.

    ``vectors`` and ``queries`` are (vec_id, vector) as ``valid_vectors`` returns them.
    """
    copies = k + 1
    index = build_index(vectors, copies, shard_points)
    # the written number of a query row is its key: a vec_id may stand for several rows
    asked = written(queries.withColumn("row", F.monotonically_increasing_id()), "ann-queries")
    blocks = max(1, math.ceil(asked.count() / query_block))
    packed = (asked.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
              .withColumn("dim", F.size("vector")).groupBy("dim", "block")
              .applyInPandas(_pack, "dim int, block long, rows binary, queries binary, wanted binary"))
    # every block meets every shard of its dimension; the shard number is the join key
    shards = index.select("dim", "shard")
    pairs = packed.join(shards, "dim").join(index.drop("dim"), "shard")
    found = pairs.select("dim", "medoid", "vectors", "ids", "graph", "rows", "queries", "wanted").mapInArrow(
        _search(copies, k, beam), "row long, query_id long, vec_id long, score double")
    nearest = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
