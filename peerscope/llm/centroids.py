"""Centroid clustering with heap-ordered bounds.

Lloyd rounds over integer vectors. A vector's gap is the lower bound of its
distance to the second-nearest centroid less the upper bound of that to its
own. When a centroid moves by d and the farthest-moving other one by e, the
gaps of its cluster shrink by d + e at most; the sum of these drifts is kept
per cluster, and a vector enters the heap of its cluster with its gap plus the
drift so far. While the top of a heap is above the cluster's drift, no vector
below it can change; vectors whose gap has expired are popped, compared with
all centroids exactly and pushed again.

Vectors lie in blocks; a row of the state table is a block with its vectors
and its heaps, and every round is one pass that reads the last table and
writes the next. The driver sees centroids and their sums only (clusters x
components numbers), never rows.

Awkward input: vectors that are null, have another number of components, or
hold null or non-finite ones take no part and have no row; repeated rows are
vectors of their own; a null ``vec_id`` is clustered but never starts a
centroid; with fewer vectors than clusters every vector starts one; an empty
table gives no rows; components whose integers pass 2**24 in size raise an
error, for distances would pass 64 bits; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerscope.llm.common import written
from peerscope.session import drop_path, scratch_path

BLOCK_ROWS = 8192
LARGEST = 1 << 24
SLACK = 1e-9  # share by which every bound is loosened against rounding

STATE = "block binary, ids binary, known binary, cluster binary, gap binary, heap binary, sizes binary"


def integer_vectors(embeddings: DataFrame, components: int = 64, factor: int = 256) -> DataFrame:
    """``vec_id, ints``: floor(factor * x) of the vectors with exactly ``components`` finite components."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = embeddings.where(x.isNotNull() & (F.size(x) == components)).where(finite)
    whole = F.transform(x, lambda v: F.floor(F.lit(factor) * v.cast("double")))
    too_large = F.exists(x, lambda v: F.abs(F.lit(factor) * v.cast("double")) >= float(LARGEST))
    return kept.select("vec_id", F.when(too_large, F.raise_error(F.lit("component too large for exact distances")))
                       .otherwise(F.transform(whole, lambda v: v.cast("int"))).alias("ints"))


def first_centroids(vectors: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors with the smallest sha256 of ``seed:vec_id``; equal hashes: smaller vector first."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.where(F.col("vec_id").isNotNull()).orderBy(digest, "ints").limit(clusters).collect()
    return np.array([r["ints"] for r in rows], dtype=np.int64)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to centroids; in doubles where these are exact."""
    far = int(max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)))
    if 4 * far * far * x.shape[1] < 2**53:
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        d = (a * a).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (a @ c.T)
        return d.astype(np.int64)
    d = np.empty((len(x), len(centroids)), dtype=np.int64)
    for j, c in enumerate(centroids):
        d[:, j] = ((x - c) ** 2).sum(1)
    return d


class Block:
    """Some vectors, the cluster of each, and one heap of (gap + drift, row) per cluster."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, x: np.ndarray, cluster: np.ndarray,
                 heaps: list[list[tuple[float, int]]]):
        self.ids, self.known, self.x, self.cluster, self.heaps = ids, known, x, cluster, heaps
        self.scanned = 0

    @classmethod
    def new(cls, ids, known, x, centroids: np.ndarray) -> Block:
        # every vector starts expired in the first heap, so the first round scans it
        heaps = [[] for _ in centroids]
        heaps[0] = [(-np.inf, i) for i in range(len(x))]
        return cls(ids, known, x, np.full(len(x), -1, dtype=np.int32), heaps)

    def assign(self, centroids: np.ndarray, drift: np.ndarray) -> np.ndarray:
        """Pop and rescan the expired vectors; the rows whose cluster may have changed."""
        expired = []
        for c, heap in enumerate(self.heaps):
            while heap and heap[0][0] <= drift[c]:
                expired.append(heapq.heappop(heap)[1])
        rows = np.array(expired, dtype=np.int64)
        self.scanned = len(rows)
        if not len(rows):
            return rows
        d = distances(self.x[rows], centroids)
        nearest = d.argmin(1).astype(np.int32)
        own = np.sqrt(d[np.arange(len(rows)), nearest].astype(np.float64))
        d[np.arange(len(rows)), nearest] = np.iinfo(np.int64).max
        other = np.sqrt(d.min(1).astype(np.float64)) if d.shape[1] > 1 else np.full(len(rows), np.inf)
        base = drift[nearest]
        keys = other - own + base - SLACK * (1 + own + base + np.where(np.isinf(other), 0, other))
        for row, c, key in zip(expired, nearest.tolist(), keys.tolist()):
            heapq.heappush(self.heaps[c], (key, row))
        self.cluster[rows] = nearest
        return rows

    def pack(self) -> tuple:
        keys = np.array([k for h in self.heaps for k, _ in h], dtype="<f8")
        rows = np.array([i for h in self.heaps for _, i in h], dtype="<i4")
        return (self.x.astype("<i4").tobytes(), self.ids.astype("<i8").tobytes(), self.known.astype("u1").tobytes(),
                self.cluster.astype("<i4").tobytes(), keys.tobytes(), rows.tobytes(),
                np.array([len(h) for h in self.heaps], "<i4").tobytes())

    @classmethod
    def unpack(cls, row: tuple, components: int) -> Block:
        x, ids, known, cluster, keys, rows, sizes = (
            np.frombuffer(b, t) for b, t in zip(row, ("<i4", "<i8", "u1", "<i4", "<f8", "<i4", "<i4")))
        pairs, heaps, at = list(zip(keys.tolist(), rows.tolist())), [], 0
        for n in sizes.tolist():
            heaps.append(pairs[at:at + n])
            at += n
        return cls(ids, known.astype(bool), x.reshape(-1, components).astype(np.int64), cluster.copy(), heaps)


def _blocks(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[Block]:
    """Blocks of new vectors (vec_id, ints)."""
    ids, known, parts, size = [], [], [], 0
    for batch in batches:
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, centroids.shape[1])
        ids.append(batch.column(0).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False))
        known.append(batch.column(0).is_valid().to_numpy(zero_copy_only=False))
        parts.append(x)
        size += len(x)
        if size >= BLOCK_ROWS:
            yield Block.new(np.concatenate(ids), np.concatenate(known), np.concatenate(parts), centroids)
            ids, known, parts, size = [], [], [], 0
    if size:
        yield Block.new(np.concatenate(ids), np.concatenate(known), np.concatenate(parts), centroids)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a batch one at a time: a row is a block of vectors."""
    return (tuple(c[i].as_py() for c in batch.columns) for i in range(batch.num_rows))


def _round(centroids: np.ndarray, drift: np.ndarray, fresh: bool):
    """One pass: every block after its expired vectors are rescanned."""
    def run(batches):
        if fresh:
            blocks = _blocks(batches, centroids)
        else:
            blocks = (Block.unpack(row, centroids.shape[1])
                      for batch in batches for row in _rows(batch))
        for block in blocks:
            block.assign(centroids, drift)
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], pa.binary()) for v in block.pack()],
                names=["block", "ids", "known", "cluster", "gap", "heap", "sizes"])
    return run


def _sums(components: int, clusters: int):
    """Exact sums of a task's blocks: one row per cluster with members (cluster, count, component sums)."""
    def run(batches):
        total, count = np.zeros((clusters, components), dtype=object), np.zeros(clusters, dtype=np.int64)
        for batch in batches:
            for x, cluster in _rows(batch):
                x = np.frombuffer(x, "<i4").reshape(-1, components).astype(np.int64)
                cluster = np.frombuffer(cluster, "<i4")
                order = np.argsort(cluster, kind="stable")
                names, starts, n = np.unique(cluster[order], return_index=True, return_counts=True)
                total[names] += np.add.reduceat(x[order], starts, axis=0).astype(object)
                count[names] += n
        used = np.flatnonzero(count)
        if len(used):
            yield pa.RecordBatch.from_arrays(
                [pa.array(used.astype(np.int32)), pa.array(count[used]),
                 pa.array([[int(v) for v in total[c]] for c in used], pa.list_(pa.int64()))],
                names=["cluster", "n", "sums"])
    return run


def centroid_sums(state: DataFrame, clusters: int, components: int) -> list[tuple[int, int, list[int]]]:
    """(cluster, members, component sums) of the clusters with members; added up on the executors."""
    parts = state.select("block", "cluster").mapInArrow(
        _sums(components, clusters), "cluster int, n long, sums array<bigint>")
    added = (parts.select("cluster", "n", F.posexplode("sums").alias("at", "v"))
             .groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v")))
    sums: dict[int, tuple[int, list[int]]] = {}
    for r in added.collect():  # clusters x components rows
        sums.setdefault(r["cluster"], (r["n"], [0] * components))[1][r["at"]] = int(r["v"])
    return [(c, n, v) for c, (n, v) in sorted(sums.items())]


def _members(centroids: np.ndarray):
    def run(batches):
        for batch in batches:
            for row in _rows(batch):
                block = Block.unpack(row, centroids.shape[1])
                for a in range(0, len(block.ids), BLOCK_ROWS):
                    s = slice(a, a + BLOCK_ROWS)
                    own = block.x[s] - centroids[block.cluster[s]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(block.ids[s], mask=~block.known[s]), pa.array(block.cluster[s]),
                         pa.array((own * own).sum(1))], names=["vec_id", "cluster", "distance"])
    return run


def cluster_vectors(vectors: DataFrame, clusters: int = 40, rounds: int = 5, seed: int = 2) -> tuple[DataFrame, np.ndarray]:
    """(``vec_id, cluster, distance`` of every row of ``vectors``, final centroids).

    ``rounds`` times all vectors go to their nearest centroid (ties: the
    smaller number) and centroids move to floor(sum / count); then vectors are
    assigned once more.
    """
    spark = vectors.sparkSession
    centroids = first_centroids(vectors, clusters, seed)
    if not len(centroids):
        if not vectors.isEmpty():
            raise ValueError("no vector has a vec_id to start a centroid")
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    components = centroids.shape[1]
    drift = np.zeros(len(centroids))
    state, old = vectors.select("vec_id", "ints"), None
    for turn in range(rounds + 1):
        path = scratch_path(spark, "centroid-state")
        state.mapInArrow(_round(centroids, drift, turn == 0), STATE).write.parquet(path)
        state = spark.read.schema(STATE).parquet(path)
        if old is not None:
            drop_path(spark, old)
        old = path
        if turn == rounds:
            break
        moved = centroids.copy()
        for c, n, sums in centroid_sums(state, len(centroids), components):
            moved[c] = [v // n for v in sums]
        step = np.sqrt(((moved - centroids).astype(np.float64) ** 2).sum(1))
        largest = int(step.argmax())
        others = np.full(len(step), step[largest])
        others[largest] = np.delete(step, largest).max(initial=0.0)
        drift = drift + (step + others) * (1 + SLACK)
        centroids = moved
    return state.mapInArrow(_members(centroids), "vec_id long, cluster int, distance long"), centroids


def centroid_clusters(vectors: DataFrame, clusters: int = 40, rounds: int = 5, seed: int = 2) -> DataFrame:
    """Members with ``cluster_inertia``, ``inertia`` (distance sums) and ``centroid_sha256``."""
    members, centroids = cluster_vectors(vectors, clusters, rounds, seed)
    spark = vectors.sparkSession
    members = written(members, "centroid-members")
    per = {r["cluster"]: int(r["s"]) for r in
           members.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    inertia = sum(per.values())
    table = spark.createDataFrame(
        [(c, per.get(c, 0), inertia, hashlib.sha256(",".join(map(str, v.tolist())).encode()).hexdigest())
         for c, v in enumerate(centroids)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return members.join(F.broadcast(table), "cluster")  # one row per cluster
