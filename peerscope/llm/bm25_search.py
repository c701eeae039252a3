"""Exact top-k BM25 search on sharded inverted indexes with block-max pruning.

Documents are indexed where they are read: every task turns blocks of its texts into
shards, each an inverted index with one row of arrays: sorted term hashes, posting
lists (document, term frequency), document lengths. A query's terms get their
idf from document counts over all shards, so scores are global. Shards lie on a number of
lanes that does not grow with the input. A block of queries goes once to each lane, meets its
shards one after the other, and leaves one list of k a query; the lists merge to the exact k best.

In a shard a query is evaluated as WAND does, a set of documents at a time. The k-th best
score of the shards that a query has met before on its lane is the threshold it starts
with; a query whose bounds (idf times the largest term weight) together stay below it
passes the shard by. The longest lists of a shard are kept as rows of a matrix, too: one product
adds them for a block of queries. The other lists, if they are short together, are added for
all those queries at once. Where they are long, the terms of a query
stand by falling bound. Lists are added from the top up to the pivot, where the bounds of
the rest together cannot lift an unseen document over the k-th best partial score; a rest that is
shorter than what it takes to bound it is added as well. A document met so far stays only
if its partial score plus the maxima that the remaining lists have in its block of
``BLOCK`` documents reaches the threshold. The best of those are scored in full,
which raises the threshold, before the others are looked at again. Only documents that
can no longer enter are left out, so the result is exact.

score = sum of ln(1 + (N - df + 0.5) / (df + 0.5)) * tf (k1 + 1) / (tf + k1 (1 - b + b len / avg))
over the distinct terms of the query. Terms are runs of characters other than ASCII white
space, A-Z lower-cased. Scores are rounded to nine places before they are ranked.

Defined results: a document or query without words has no score and no row; documents
without a common term are no result; ties go to the smaller doc_id; a query's own doc_id is left
out; repeated rows are documents of their own; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peerscope.llm.common import release_memory, written
from peerscope.llm.shingles import WordHashes

K1, B = 1.2, 0.75
BLOCK = 64                 # documents per block maximum
SHARD_CHARS = 10_000_000     # about as many bytes of index; tasks hold a few such rows at a time
SHARD_DOCS = 60_000        # a document's place in its shard has 16 bits
COMMON = 16                # lists that hold one in so many documents of a shard are multiplied as rows of a matrix
COMMON_CELLS = 2_000_000   # of that matrix, and of the scores it gives at once
SHORT = 64                 # a rest of up to so many postings a document is added rather than bounded
ADDED = 500_000            # postings added at once
QUERY_BLOCK = 512
LANES = 16                 # at least; twice the cores of a larger cluster
BATCH_BYTES = "8m"         # shards beside a query block that a task takes at once: one, as a rule
_BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
_ROWS_OUT = 100_000
_SCHEMA = ("shard string, doc_ids binary, lengths binary, terms binary, starts binary, "
           "docs binary, tfs binary")


def term_counts(text: str | None, words: WordHashes) -> tuple[np.ndarray, np.ndarray, int]:
    """(sorted term hashes, their counts, number of words) of a whole text."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    hashes = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens)).view(np.int64)
    terms, counts = np.unique(hashes, return_counts=True)
    return terms, counts, len(tokens)


def _index_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, part = WordHashes(), TaskContext.get().partitionId()
    ids: list[int] = []
    lengths: list[int] = []
    found: list[tuple[np.ndarray, np.ndarray]] = []
    chars = shards = 0

    def flush() -> pa.RecordBatch:
        terms = np.concatenate([t for t, _ in found])
        tfs = np.concatenate([c for _, c in found])
        docs = np.repeat(np.arange(len(found)), [len(t) for t, _ in found])
        by = np.argsort(terms, kind="stable")
        terms, tfs, docs = terms[by], tfs[by], docs[by]
        starts = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]])
        columns = [np.array(ids, np.int64), np.array(lengths, np.int64), terms[starts],
                   np.append(starts, len(terms)).astype(np.int64), docs.astype(np.uint16),
                   tfs.astype(np.uint8 if tfs.max() < 256 else np.uint32)]
        for kept in (ids, lengths, found):
            kept.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([f"{part}-{shards}"])] + [pa.array([c.tobytes()], pa.binary()) for c in columns],
            names=["shard", "doc_ids", "lengths", "terms", "starts", "docs", "tfs"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            terms, counts, n = term_counts(text, words)
            if not n or doc_id is None:
                continue
            ids.append(doc_id)
            lengths.append(n)
            found.append((terms, counts))
            chars += len(text)
            if chars >= SHARD_CHARS or len(ids) >= SHARD_DOCS:
                yield flush()
                chars, shards = 0, shards + 1
    if ids:
        yield flush()
    words.clear()
    release_memory()


def build_index(docs: DataFrame) -> DataFrame:
    """The written index of (doc_id, text) rows, one row per shard."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(rows.mapInArrow(_index_texts, _SCHEMA), "bm25-index")


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for terms, starts in zip(batch.column(0), batch.column(1)):
            t = np.frombuffer(terms.as_py(), np.int64)
            df = np.diff(np.frombuffer(starts.as_py(), np.int64))
            for i in range(0, len(t), 100_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t[i:i + 100_000]), pa.array(df[i:i + 100_000])], names=["term", "df"])


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [np.frombuffer(v.as_py(), np.int64) for v in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array([len(s) for s in sizes], pa.int64()),
                                          pa.array([int(s.sum()) for s in sizes], pa.int64())],
                                         names=["n", "words"])


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = WordHashes()
    for batch in batches:
        for query_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            terms, _, n = term_counts(text.as_py(), words)
            if n and query_id is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(terms), query_id, np.int64)), pa.array(terms)],
                    names=["query_id", "term"])


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["query_id", "term"], ignore_index=True)
    ids, starts = np.unique(rows["query_id"].to_numpy(), return_index=True)
    return pd.DataFrame({"block": rows["block"].iloc[:1].to_numpy(),
                         "q_ids": [ids.astype(np.int64).tobytes()],
                         "q_starts": [np.append(starts, len(rows)).astype(np.int64).tobytes()],
                         "q_terms": [rows["term"].to_numpy(np.int64).tobytes()],
                         "q_df": [rows["df"].to_numpy(np.int64).astype(np.uint32).tobytes()]})


class Shard:
    """One inverted index, ready to be searched."""

    def __init__(self, row: dict, average: float):
        # copies of what is kept, so that the batch can be let go
        self.ids = np.frombuffer(row["doc_ids"], np.int64).copy()
        lengths = np.frombuffer(row["lengths"], np.int64)
        self.terms = np.frombuffer(row["terms"], np.int64).copy()
        self.starts = np.frombuffer(row["starts"], np.int64).copy()
        self.docs = np.frombuffer(row["docs"], np.uint16).astype(np.int32)
        tf = np.frombuffer(row["tfs"], f"u{len(row['tfs']) // len(self.docs)}").astype(np.float64)
        self.weights = (K1 * (1 - B + B * lengths / average))[self.docs]
        self.weights += tf
        tf *= K1 + 1
        np.divide(tf, self.weights, out=self.weights)
        del tf
        self.largest = np.maximum.reduceat(self.weights, self.starts[:-1])
        term_of = np.repeat(np.arange(len(self.terms), dtype=np.int32), np.diff(self.starts))
        block = self.docs // BLOCK
        first = np.flatnonzero(np.r_[True, (term_of[1:] != term_of[:-1]) | (block[1:] != block[:-1])])
        self.block_max = np.maximum.reduceat(self.weights, first)
        self.block_of = block[first]
        self.block_starts = np.searchsorted(first, self.starts)
        self.n_blocks = len(self.ids) // BLOCK + 1
        sizes = np.diff(self.starts)
        common = np.flatnonzero(sizes * COMMON >= len(self.ids))
        common = common[np.argsort(-sizes[common], kind="stable")[:COMMON_CELLS // len(self.ids)]]
        self.row = np.full(len(self.terms), -1, np.int32)
        self.row[common] = np.arange(len(common))
        at, which = self._spans(self.starts[common], self.starts[common + 1])
        self.common = np.zeros((len(common), len(self.ids)))
        self.common[which, self.docs[at]] = self.weights[at]

    @staticmethod
    def _spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, which span) of several ranges, one after the other."""
        length = ends - starts
        which = np.repeat(np.arange(len(starts)), length)
        return np.arange(len(which)) + np.repeat(starts - np.cumsum(length) + length, length), which

    def _add(self, score: np.ndarray, terms: np.ndarray, idf: np.ndarray) -> np.ndarray:
        at, which = self._spans(self.starts[terms], self.starts[terms + 1])
        return score + np.bincount(self.docs[at], self.weights[at] * idf[which], len(self.ids))

    def _add_all(self, scores: np.ndarray, owner: np.ndarray, terms: np.ndarray, idf: np.ndarray) -> None:
        """The lists of all queries into their rows of ``scores``."""
        flat, first = scores.reshape(-1), owner * scores.shape[1]
        ends = np.cumsum(self.starts[terms + 1] - self.starts[terms])
        cuts = np.searchsorted(ends, np.arange(0, (ends[-1] if len(ends) else 0) + ADDED, ADDED))
        for lo, hi in zip(cuts[:-1], np.append(cuts[1:-1], len(terms))):
            at, which = self._spans(self.starts[terms[lo:hi]], self.starts[terms[lo:hi] + 1])
            np.add.at(flat, first[lo:hi][which] + self.docs[at], self.weights[at] * idf[lo:hi][which])

    def _complete(self, chosen: np.ndarray, terms: np.ndarray, idf: np.ndarray) -> np.ndarray:
        """What the lists of ``terms`` add to the chosen documents."""
        starts, ends = self.starts[terms], self.starts[terms + 1]
        if len(chosen) * len(terms) * 4 > int((ends - starts).sum()):
            return self._add(np.zeros(len(self.ids)), terms, idf)[chosen]
        out = np.zeros(len(chosen))
        for s, e, w in zip(starts.tolist(), ends.tolist(), idf.tolist()):
            at = np.searchsorted(self.docs[s:e], chosen)
            hit = at < e - s
            hit[hit] = self.docs[s + at[hit]] == chosen[hit]
            out[hit] += w * self.weights[s + at[hit]]
        return out

    def search_block(self, starts: np.ndarray, terms: np.ndarray, idf: np.ndarray, k: np.ndarray,
                     least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, places, scores) of a block of queries; the terms of query i lie from starts[i] to starts[i + 1]."""
        # found in their order, which is several times faster
        asked, which = np.unique(terms, return_inverse=True)
        at = np.minimum(np.searchsorted(self.terms, asked), len(self.terms) - 1)
        at[self.terms[at] != asked] = -1
        at = at[which]
        owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[at >= 0]
        at, idf = at[at >= 0], idf[at >= 0]
        bound = np.bincount(owner, idf * self.largest[at], len(starts) - 1)
        able = np.flatnonzero((bound > 0) & (bound * (1 + 1e-9) + 1e-9 >= least))
        ends = np.searchsorted(owner, able, side="right")
        begins = np.searchsorted(owner, able)
        row = self.row[at]
        step = max(1, COMMON_CELLS // len(self.ids))
        for lo in range(0, len(able), step):
            shares = np.zeros((len(able[lo:lo + step]), len(self.common)))
            for i, (s, e) in enumerate(zip(begins[lo:lo + step], ends[lo:lo + step])):
                known = row[s:e] >= 0
                shares[i, row[s:e][known]] = idf[s:e][known]
            scores = shares @ self.common
            s, e = begins[lo], ends[min(lo + step, len(able)) - 1]
            other = row[s:e] < 0
            place = np.searchsorted(able[lo:lo + step], owner[s:e][other])
            rest, rest_idf = at[s:e][other], idf[s:e][other]
            # queries that pass the shard by lie between
            mine = able[lo:lo + step][np.minimum(place, len(scores) - 1)] == owner[s:e][other]
            place, rest, rest_idf = place[mine], rest[mine], rest_idf[mine]
            length = np.bincount(place, self.starts[rest + 1] - self.starts[rest], len(scores))
            added = length <= SHORT * len(self.ids)
            short = added[place]
            self._add_all(scores, place[short], rest[short], rest_idf[short])
            cut = np.searchsorted(place, np.arange(len(scores) + 1))
            for i, q in enumerate(able[lo:lo + step].tolist()):
                if added[i]:
                    yield q, *self._best(scores[i], int(k[q]), float(least[q]))
                else:
                    yield q, *self.search(rest[cut[i]:cut[i + 1]], rest_idf[cut[i]:cut[i + 1]], scores[i], int(k[q]), float(least[q]))

    @staticmethod
    def _best(score: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the k best from ``least`` on, ties included."""
        slack = 1e-9 * (1.0 + float(score.max(initial=0.0)))
        met = np.flatnonzero(score > max(least - slack, 0.0))
        if len(met) > 2 * k:
            kth = np.partition(score[met], len(met) - k)[len(met) - k]
            met = met[score[met] >= kth - slack]
        return met, score[met]

    def search(self, at: np.ndarray, idf: np.ndarray, score: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) that hold the k best documents of this shard from ``least`` on, ties included.

        ``score``: what the common lists give every document; ``at``: the other lists.
        """
        def kth(values: np.ndarray) -> float:
            return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else 0.0

        bound = idf * self.largest[at]
        order = np.argsort(-bound, kind="stable")
        at, idf, bound = at[order], idf[order], bound[order]
        rest = np.append(np.cumsum(bound[::-1])[::-1], 0.0)
        slack = 1e-9 * (1.0 + float(rest[0]) + float(score.max(initial=0.0)))
        threshold = max(least, kth(score))
        pivot = int(np.count_nonzero(rest[:-1] >= threshold - slack))
        if int((self.starts[at[pivot:] + 1] - self.starts[at[pivot:]]).sum()) <= SHORT * len(self.ids):
            pivot = len(at)
        score = self._add(score, at[:pivot], idf[:pivot])
        threshold = max(threshold, kth(score))
        left, left_idf = at[pivot:], idf[pivot:]
        met = np.flatnonzero(score > 0)
        if not len(left):
            met = met[score[met] >= threshold - slack]
            return met, score[met]
        spans, which = self._spans(self.block_starts[left], self.block_starts[left + 1])
        lift = np.bincount(self.block_of[spans], self.block_max[spans] * left_idf[which], self.n_blocks)
        reach = score[met] + lift[met // BLOCK]
        met = met[reach >= threshold - slack]
        if not len(met):
            return met, score[met]
        # the most promising first: their full scores raise the threshold for the rest
        reach = score[met] + lift[met // BLOCK]
        by = np.argsort(-reach, kind="stable")
        head, tail = met[by[:4 * k]], met[by[4 * k:]]
        full = score[head] + self._complete(head, left, left_idf)
        threshold = max(threshold, kth(full))
        tail = tail[score[tail] + lift[tail // BLOCK] >= threshold - slack]
        if len(tail):
            head = np.concatenate([head, tail])
            full = np.concatenate([full, score[tail] + self._complete(tail, left, left_idf)])
        return head[full >= threshold - slack], full[full >= threshold - slack]


def _search(k: int, documents: int, average: float):
    """Task function: blocks of queries in the shards of a lane, the k best of each query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, shard = None, None
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}     # of each query: doc_ids and scores, best first
        for batch in batches:
            for i in range(batch.num_rows):
                # views of the batch: the arrays of a shard are read once for all its query blocks
                row = {c: batch.column(c)[i].as_buffer() for c in batch.schema.names if c != "shard"}
                if batch.column("shard")[i].as_py() != name:
                    shard = None      # let go before the next one is made
                    release_memory()
                    name, shard = batch.column("shard")[i].as_py(), Shard(row, average)
                ids = np.frombuffer(row["q_ids"], np.int64)
                starts = np.frombuffer(row["q_starts"], np.int64)
                terms = np.frombuffer(row["q_terms"], np.int64)
                df = np.frombuffer(row["q_df"], np.uint32).astype(np.float64)
                idf = np.log1p((documents - df + 0.5) / (df + 0.5))
                nothing = ids[:0], idf[:0]
                own = np.array([(shard.ids == q).sum() for q in ids.tolist()])      # places that a query itself may take
                least = np.array([found[q][1][-1] if len(found.get(q, nothing)[1]) == k else 0.0 for q in ids.tolist()])
                for at, place, new in shard.search_block(starts, terms, idf, k + own, least):
                    if not len(place):
                        continue
                    q = int(ids[at])
                    doc, score = found.get(q, nothing)
                    score, doc = np.append(score, np.round(new, 9)), np.append(doc, shard.ids[place])
                    best = np.lexsort((doc, -score))
                    best = best[(doc[best] != q) & (score[best] > 0)][:k]
                    found[q] = doc[best], score[best]
            # no view may hold the batch while the next one is read
            row = ids = starts = terms = df = nothing = None
            del batch
        shard = None
        release_memory()
        queries = list(found)
        for at in range(0, len(queries), max(1, _ROWS_OUT // k)):
            part = queries[at:at + max(1, _ROWS_OUT // k)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array(part, np.int64), [len(found[q][0]) for q in part]))]
                + [pa.array(np.concatenate([found[q][c] for q in part])) for c in (0, 1)],
                names=["query_id", "doc_id", "score"])
    return run


def bm25_top_k(docs: DataFrame, queries: DataFrame, k: int = 10, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, doc_id, score): the ``k`` best documents for every query text.

    ``docs`` is (doc_id, text), ``queries`` (query_id, text) with one row per query_id.
    """
    index = build_index(docs)
    size = index.select("lengths").mapInArrow(_lengths, "n long, words long").agg(
        F.sum("n").alias("n"), F.sum("words").alias("words")).first()
    n, average = size["n"] or 0, (size["words"] or 0) / max(1, size["n"] or 0) or 1.0
    df = (index.select("terms", "starts").mapInArrow(_document_counts, "term long, df long")
          .groupBy("term").agg(F.sum("df").alias("df")))
    asked = written(queries.select(F.col("query_id").cast("long").alias("query_id"), "text")
                    .mapInArrow(_query_terms, "query_id long, term long").distinct(), "bm25-queries")
    blocks = max(1, math.ceil(asked.select("query_id").distinct().count() / query_block))
    packed = (asked.join(df, "term")
              .withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
              .select("block", "query_id", "term", "df").groupBy("block")
              .applyInPandas(_pack, "block long, q_ids binary, q_starts binary, q_terms binary, q_df binary"))
    # every block of queries goes to every lane, and a shard lies on one lane: each pair meets once
    number = F.split("shard", "-")
    task, nth = number[0].cast("int"), number[1].cast("int")
    shards, tasks = index.agg(F.count(F.lit(1)), F.max(task) + 1).first()
    lanes = max(1, min(shards, max(LANES, 2 * docs.sparkSession.sparkContext.defaultParallelism)))
    # as a repartition of its own a lane is not split again, and is a task of its own
    routed = (packed.drop("block").withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
              .repartitionById(lanes, "lane"))
    lying = (index.withColumn("lane", F.pmod(task + nth * F.lit(tasks or 1), F.lit(lanes)))
             .repartitionById(lanes, "lane"))
    # shards are read in turn beside the queries of their lane
    found = lying.join(routed, "lane").drop("lane").mapInArrow(
        _search(k, n, average), "query_id long, doc_id long, score double")
    # every row holds a shard: batches of the usual size would be several of them, in Spark and in Python
    conf = docs.sparkSession.conf
    usual = conf.get(_BATCH_LIMIT)
    conf.set(_BATCH_LIMIT, BATCH_BYTES)
    try:
        found = written(found, "bm25-found")
    finally:
        conf.set(_BATCH_LIMIT, usual)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "doc_id", "score"))
