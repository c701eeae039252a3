"""N-gram Jaccard self-join: size-banded tiles, bitmap signatures, exact intersection.

A document is the set of its distinct five-word shingles (64-bit hashes); equal
sets form one class, and classes are joined, never their copies. Two classes
link when 100 * intersection >= ``percent`` * union.

1. profile: one pass over the texts gives set size, class and a parity bitmap
   whose width follows the size band (a factor 100/percent of sizes, at least 4/3), and counts
   shingles in a table of fixed size that covers all documents.
2. tiles: every class is entered under the n - ceil(0.75 n) + 1 shingles
   that come first in one global order, rare shingles first (by the count
   table, ties by hash). Two sets that link share such a shingle. Entries meet in
   tiles of (hash range of the shingle, size band); a class looks at its own and
   the next lower band only, as sizes of linked sets differ by that factor at most.
3. rounds: within a tile each shingle proposes its smallest class as partner
   of the others (a star, as many pairs as entries). The number of bits in which two
   bitmaps differ is at most the number of shingles in which the sets differ, so
   it bounds the overlap from above; pairs beyond the bound go. The rest is decided
   by intersecting the sorted arrays. Links join components; the next round
   proposes pairs between different components only, with another leader for each
   shingle. After ``star_rounds`` - 1 of them come ``nearest_rounds`` in which every class
   proposes in each group only its likeliest partner by the bitmaps, as many pairs at most as a group has
   classes. In the last round every remaining pair between different
   components that passes the size, position and bitmap bounds is decided (position:
   from the first shingle two sets share, both have enough shingles left to link). No link between different texts is
   lost, and a group of thousands of near copies costs about as many pairs as members.

Hot groups: copies are one class; a shingle that very many documents share
is late in the order; the sets of a star's members are dealt over salts. In the last round
the entries of a shingle are dealt over blocks of about ``_BLOCK``, and every two blocks meet in
a group of their own; of its pairs a task keeps only those that pass the bitmap bound.

Defined results: null, empty or blank text has an empty set, links with
nothing and is its own component; repeated rows are copies of each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerscope.llm.bpe import text_chunks
from peerscope.llm.common import free_name, release_memory, union_all, written
from peerscope.llm.components import connected_components
from peerscope.llm.shingles import WordHashes, shingle_set

COUNT_BITS = 22          # the count table: 2**22 counters of 4 bytes, at every input size
_COUNT_SLICES = 64
_FLUSH = 1 << 19
_CHUNK_BYTES = 4 << 20
_MEMBERS_PER_SALT = 64
_BLOCK = 2048            # entries of one shingle that meet in one group of the last round


# -- inside tasks ---------------------------------------------------------------

def size_band(n: np.ndarray, percent: int = 75) -> np.ndarray:
    """Sizes of sets that can link (a factor 100/percent, at least 4/3) are in the same or in neighbouring bands."""
    return np.floor(np.log(np.maximum(n, 1)) / math.log(max(4 / 3, 100 / percent)) + 1e-9).astype(np.int16)


def bitmap(shingles: np.ndarray) -> bytes:
    """Parity bitmap: two to four bits a shingle (a power of two, 256 to 131,072 bits).

    Fewer bits would let through pairs well below the threshold, for shingles that meet in one bit cancel out.
    """
    width = 1 << min(17, max(8, int(len(shingles) - 1).bit_length() + 1))
    ones = np.bincount((shingles >> np.uint64(8)).astype(np.int64) & (width - 1), minlength=width) & 1
    return np.packbits(ones.astype(np.uint8)).tobytes()


def differing_bits(a: bytes, b: bytes) -> int:
    """Bits in which two bitmaps differ, the wider one folded to the width of the other."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    if len(y) > len(x):
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def may_link(n_a: int, n_b: int, differ: int, percent: int) -> bool:
    """Whether sets of these sizes that differ in at least ``differ`` shingles can link."""
    overlap = (n_a + n_b - differ) // 2
    overlap = min(overlap, n_a, n_b)
    return 100 * overlap >= percent * (n_a + n_b - overlap)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, counts = WordHashes(), np.zeros(1 << COUNT_BITS, np.int32)
    mask = np.uint64((1 << COUNT_BITS) - 1)
    for ids, texts in ((batch.column(0).slice(i, j - i), texts)
                       for batch in batches for i, j, texts in text_chunks(batch.column(1), _CHUNK_BYTES)):
        sizes, classes, bits = [], [], []
        for text in texts:
            s = shingle_set(text, words)
            sizes.append(len(s))
            classes.append(xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None)
            bits.append(bitmap(s) if len(s) else None)
            np.add.at(counts, (s & mask).astype(np.int64), 1)
        n = len(sizes)
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(bits, pa.binary()),
             pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
            names=["doc_id", "n", "cls", "bits", "slice", "counts"])
    if counts.any():
        parts = np.minimum(counts, 2**16 - 1).astype(np.uint16).reshape(_COUNT_SLICES, -1)
        k = _COUNT_SLICES
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()),
             pa.nulls(k, pa.binary()), pa.array(range(k), pa.int32()),
             pa.array([p.tobytes() for p in parts], pa.binary())],
            names=["doc_id", "n", "cls", "bits", "slice", "counts"])
    del words, counts
    release_memory()


def _sum_slices(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(c, np.uint16).astype(np.int64) for c in rows["counts"])
    return pd.DataFrame({"slice": rows["slice"].iloc[:1],
                         "counts": [np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()]})


def _entries(order, tiles: int, percent: int):
    """Task function: the first shingles of every class, as blocks by tile."""
    mask = np.uint64((1 << COUNT_BITS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = WordHashes(), order.value
        seen: set[int] = set()
        held: list[tuple[np.ndarray, int, int]] = []
        waiting = 0

        def flush() -> pa.RecordBatch:
            keys = np.concatenate([k for k, _, _ in held])
            places = np.concatenate([np.arange(len(k), dtype=np.int32) for k, _, _ in held])
            lengths = [len(k) for k, _, _ in held]
            classes = np.repeat(np.array([c for _, c, _ in held], np.int64), lengths)
            bands = np.repeat(size_band(np.array([n for _, _, n in held]), percent), lengths)
            tile = (keys >> np.uint64(40)).astype(np.int64) % tiles
            at = np.argsort(tile, kind="stable")
            keys, classes, bands, places, tile = keys[at], classes[at], bands[at], places[at], tile[at]
            cuts = np.flatnonzero(np.diff(tile, prepend=-1))
            ends = np.append(cuts[1:], len(tile))
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(tile[cuts], pa.int64())]
                + [pa.array([x[i:j].tobytes() for i, j in zip(cuts, ends)], pa.binary())
                   for x in (keys, classes, bands, places)], names=["tile", "keys", "classes", "bands", "places"])

        for batch in batches:
            for text in batch.column(0):
                s = shingle_set(text.as_py(), words)
                n = len(s)
                if not n:
                    continue
                cls = xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63)
                if cls in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(cls)
                first = n - -(-n * percent // 100) + 1
                by = np.argsort(counts[(s & mask).astype(np.int64)], kind="stable")
                held.append((s[by[:first]], cls, n))
                waiting += first
                if waiting >= _FLUSH:
                    waiting = 0
                    yield flush()
        if held:
            yield flush()
        words.clear()
        seen.clear()
        release_memory()

    return run


def _star_pairs(keys: np.ndarray, classes: np.ndarray, bands: np.ndarray) -> np.ndarray:
    """(smallest class, other) of every shingle, within a band and to the next band."""
    start = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (bands[1:] != bands[:-1])])
    length = np.diff(np.append(start, len(keys)))
    lead = np.repeat(classes[start], length)
    pairs = [np.column_stack([lead, classes])]
    nxt = np.flatnonzero((keys[start[1:]] == keys[start[:-1]])
                         & (bands[start[1:]] == bands[start[:-1]] + 1))
    if len(nxt):
        rows = np.concatenate([np.arange(start[i + 1], start[i + 1] + length[i + 1]) for i in nxt])
        pairs.append(np.column_stack([np.repeat(classes[start[nxt]], length[nxt + 1]), classes[rows]]))
    out = np.concatenate(pairs)
    out = out[out[:, 0] != out[:, 1]]
    return np.unique(np.sort(out, axis=1), axis=0)


def _meet(rows: pd.DataFrame) -> pd.DataFrame:
    """One tile: entries whose shingle has a partner, and the star pairs."""
    keys = np.frombuffer(b"".join(rows["keys"]), np.uint64)
    classes = np.frombuffer(b"".join(rows["classes"]), np.int64)
    bands = np.frombuffer(b"".join(rows["bands"]), np.int16)
    places = np.frombuffer(b"".join(rows["places"]), np.int32)
    by = np.lexsort((classes, bands, keys))
    keys, classes, bands, places = keys[by], classes[by], bands[by], places[by]
    new = np.r_[True, (keys[1:] != keys[:-1]) | (classes[1:] != classes[:-1])]
    keys, classes, bands, places = keys[new], classes[new], bands[new], places[new]
    near = np.zeros(len(keys), bool)
    pair = (keys[1:] == keys[:-1]) & (bands[1:] - bands[:-1] <= 1)
    near[1:] |= pair
    near[:-1] |= pair
    keys, classes, bands, places = keys[near], classes[near], bands[near], places[near]
    if not len(keys):
        return pd.DataFrame({"key": [], "band": [], "place": [], "a": [], "b": []}).astype(
            {"key": "int64", "band": "int16", "place": "int32", "a": "int64", "b": "Int64"})
    pairs = _star_pairs(keys, classes, bands)
    entries = pd.DataFrame({"key": keys.view(np.int64), "band": bands, "place": places, "a": classes, "b": pd.NA})
    stars = pd.DataFrame({"key": np.int64(0), "band": np.int16(0), "place": np.int32(0), "a": pairs[:, 0], "b": pairs[:, 1]})
    return pd.concat([entries, stars]).astype({"b": "Int64"})


def _bound(percent: int):
    """Task function: pairs whose sizes and bitmaps allow a link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = batch.column("n_a").to_pylist(), batch.column("n_b").to_pylist()
            bits = zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist())
            keep = [may_link(x, y, differing_bits(p, q), percent)
                    for x, y, (p, q) in zip(n_a, n_b, bits)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _shingle_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = WordHashes()
    for batch in batches:
        sets = [shingle_set(t.as_py(), words).tobytes() for t in batch.column(1)]
        # a row that repeats a doc_id with another text is not of this class
        own = [xxhash.xxh64_intdigest(s) - (1 << 63) == c
               for s, c in zip(sets, batch.column(0).to_pylist())]
        out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())],
                                         names=["cls", "shingles"])
        yield out.filter(pa.array(own, pa.bool_()))


def _decide(percent: int):
    """Task function: exact intersection of two sorted arrays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                a, b = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if len(a) > len(b):
                    a, b = b, a
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                both = int((b[at] == a).sum())
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _group_pairs(keys: np.ndarray, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of index pairs of equal keys and different roots, from about ``_FLUSH`` pairs each.

    ``keys`` are sorted. Groups of one size are worked on together; of a large
    group some rows at a time meet all later ones.
    """
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    length = np.diff(np.append(start, len(keys)))
    for m in np.unique(length[length > 1]).tolist():
        groups = start[length == m]
        if m * m <= _FLUSH:
            i, j = np.triu_indices(m, 1)
            step = max(1, _FLUSH // len(i))
            for at in range(0, len(groups), step):
                base = groups[at:at + step, None]
                a, b = (base + i).ravel(), (base + j).ravel()
                other = root[a] != root[b]
                yield a[other], b[other]
        else:
            step = max(1, _FLUSH // m)
            for base in groups.tolist():
                for at in range(base, base + m, step):
                    a, b = np.nonzero(root[at:at + step, None] != root[None, at + 1:base + m])
                    later = b >= a
                    yield a[later] + at, b[later] + at + 1


def _side_pairs(side: np.ndarray, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of index pairs of different roots, one of either side of a block pair."""
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    step = max(1, _FLUSH // max(1, len(right)))
    for at in range(0, len(left), step):
        part = left[at:at + step]
        i, j = np.nonzero(root[part, None] != root[None, right])
        yield part[i], right[j]


def _likely(a: np.ndarray, b: np.ndarray, n: np.ndarray, bits: list[bytes], percent: int) -> np.ndarray:
    """The largest similarity that the bitmaps allow pairs of class positions, 0 for pairs that cannot link."""
    width = np.array([len(x) for x in bits])
    most = np.zeros(len(a))
    tables, place = {}, np.zeros(len(bits), np.int64)
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        place[own] = np.arange(len(own))
        tables[w] = np.frombuffer(b"".join(bits[i] for i in own), np.uint64).reshape(len(own), -1)
    low, high = np.minimum(width[a], width[b]), np.maximum(width[a], width[b])
    for w, v in {*zip(low.tolist(), high.tolist())}:
        own = np.flatnonzero((low == w) & (high == v))
        for at in (own[i:i + 25_000] for i in range(0, len(own), 25_000)):
            small = np.where(width[a[at]] == w, a[at], b[at])
            large = a[at] + b[at] - small
            x, y = tables[w][place[small]], tables[v][place[large]]
            if v > w:
                y = np.bitwise_xor.reduce(y.reshape(len(y), v // w, -1), axis=1)
            differ = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            n_a, n_b = n[a[at]], n[b[at]]
            overlap = np.minimum((n_a + n_b - differ) // 2, np.minimum(n_a, n_b))
            union = n_a + n_b - overlap
            most[at] = np.where(100 * overlap >= percent * union, overlap / union, 0.0)
    return most


def _likeliest(pairs: np.ndarray, most: np.ndarray, m: int) -> np.ndarray:
    """Places of the pairs that are the likeliest one of a class; ``pairs`` are a * m + b."""
    ends = np.concatenate([pairs // m, pairs % m])
    place = np.tile(np.arange(len(pairs)), 2)
    by = np.lexsort((pairs[place], -most[place], ends))
    first = np.ones(len(by), bool)
    first[1:] = ends[by[1:]] != ends[by[:-1]]
    return np.unique(place[by[first]])


def _cross_pairs(percent: int, nearest: bool = False):
    """Task function: all pairs of one group between different components within the bounds.

    ``nearest``: of each class only the likeliest one.
    """
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key", ignore_index=True)
        classes, first, of = np.unique(rows["a"].to_numpy(), return_index=True, return_inverse=True)
        n = rows["n"].to_numpy()[first]
        bits = rows["bits"].iloc[first].tolist()
        root, side = rows["root"].to_numpy(), rows["side"].to_numpy()
        size, place = rows["n"].to_numpy().astype(np.int64), rows["place"].to_numpy().astype(np.int64)
        found, likely, new = np.empty(0, np.int64), np.empty(0), []

        def bounded() -> tuple[np.ndarray, np.ndarray]:
            """The pairs found so far and those of the new ones that the bitmaps let through."""
            pairs = np.setdiff1d(np.concatenate([found[:0], *new]), found)
            new.clear()
            most = _likely(pairs // len(classes), pairs % len(classes), n, bits, percent)
            pairs, most = np.append(found, pairs[most > 0]), np.append(likely, most[most > 0])
            if nearest:
                keep = _likeliest(pairs, most, len(classes))
                pairs, most = pairs[keep], most[keep]
            return pairs, most

        blocks = _group_pairs(rows["key"].to_numpy(), root) if side[0] < 0 else _side_pairs(side, root)
        for i, j in blocks:
            a, b = np.minimum(of[i], of[j]), np.maximum(of[i], of[j])
            # at the first shingle two sets share in the global order, each has only what follows to share:
            # a pair that links passes there, and a pair that passes nowhere goes
            need = -(-percent * (size[i] + size[j]) // (100 + percent))
            fit = (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])) & (
                np.minimum(size[i] - place[i], size[j] - place[j]) >= need)
            new.append(a[fit] * len(classes) + b[fit])
            if sum(map(len, new)) >= 4 * _FLUSH:
                found, likely = bounded()
        found, likely = bounded()
        return pd.DataFrame({"a": classes[found // len(classes)],
                             "b": classes[found % len(classes)]}).astype("int64")
    return run


# -- the plan -------------------------------------------------------------------

def _verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by bitmap bound and then exact intersection."""
    meta = classes.select("cls", "n", "bits")
    sides = [meta.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"),
                         F.col("bits").alias(f"bits_{c}")) for c in "ab"]
    sized = (pairs.join(sides[0], "a").join(sides[1], "b")
             .where((F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)))
    likely = written(sized.mapInArrow(_bound(percent), "a long, b long"), "ngram-likely")
    needed = likely.select(F.col("a").alias("cls")).union(likely.select("b")).distinct()
    holders = needed.join(classes.select("cls", "doc_id"), "cls")
    sets = written(docs.join(holders, "doc_id").select("cls", "text")
                   .mapInArrow(_shingle_arrays, "cls long, shingles binary")
                   .dropDuplicates(["cls"]), "ngram-sets")
    # members of a star bring their sets to as many copies of the leader as there are salts
    stars = (likely.groupBy("a").agg(F.count(F.lit(1)).alias("members"))
             .withColumn("salts", F.ceil(F.col("members") / _MEMBERS_PER_SALT).cast("int")))
    leaders = (stars.join(sets, stars["a"] == sets["cls"])
               .select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
                       F.col("shingles").alias("set_a")))
    members = (likely.join(stars.select("a", "salts"), "a")
               .withColumn("salt", F.pmod(F.col("b"), F.col("salts")).cast("int"))
               .join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("set_b")), "b")
               .select("a", "b", "salt", "set_b"))
    decided = (members.join(leaders, ["a", "salt"]).select("a", "b", "set_a", "set_b")
               .mapInArrow(_decide(percent), "a long, b long"))
    return written(decided, "ngram-links")


def _open_entries(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """Entries (key, band, place, a, root, blocks) of shingles that stand in two components or more."""
    labelled = entries.join(roots, F.col("a") == F.col("node"), "left").select(
        "key", "band", "place", "a", F.coalesce("root", "a").alias("root"))
    split = labelled.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"),
                                        F.ceil(F.count(F.lit(1)) / _BLOCK).cast("int").alias("blocks")) \
                    .where("lo != hi").select("key", "blocks")
    return labelled.join(split, "key")


def _pair_groups(open_entries: DataFrame, tiles: int) -> DataFrame:
    """Entries with the group (tile, hot, lo, hi) in which they meet, and their side of it.

    Shingles of one block share the groups of their tile; the entries of another meet in a group of
    its own for every two blocks, as sides 0 and 1, and within each block (side -1).
    """
    own = F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int")
    return (open_entries.withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
            .withColumn("side", F.when(F.col("lo") == F.col("hi"), -1)
                        .otherwise((F.col("own") == F.col("hi")).cast("int")))
            .withColumn("tile", F.pmod("key", F.lit(tiles)))
            .withColumn("hot", F.when(F.col("blocks") > 1, F.col("key")))
            .drop("own", "other", "blocks"))


def _next_star(open_entries: DataFrame, turn: int) -> DataFrame:
    """Star pairs with another leader per shingle, between different components."""
    lead = open_entries.groupBy("key").agg(
        F.min_by(F.struct("a", "root", "band"), F.xxhash64("a", F.lit(turn))).alias("lead"))
    return (open_entries.join(lead, "key")
            .where((F.col("root") != F.col("lead.root"))
                   & (F.abs(F.col("band") - F.col("lead.band")) <= 1))
            .select(F.least("a", "lead.a").alias("a"), F.greatest("a", "lead.a").alias("b"))
            .distinct())


def ngram_components(docs: DataFrame, percent: int = 75, star_rounds: int = 2,
                     entries_per_tile: int = 1_000_000, nearest_rounds: int = 1) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    ``component_id`` is the smallest doc_id reachable over links.
    """
    if not 1 <= percent <= 100:
        raise ValueError(f"percent must be between 1 and 100, not {percent}")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profile = written(texts.mapInArrow(
        _profile, "doc_id long, n long, cls long, bits binary, slice int, counts binary"),
        "ngram-profile")
    one_per_doc = profile.where("slice is null")
    slices = (profile.where("slice is not null").select("slice", "counts").groupBy("slice")
              .applyInPandas(_sum_slices, "slice int, counts binary"))
    counts = np.zeros((_COUNT_SLICES, (1 << COUNT_BITS) // _COUNT_SLICES), np.int32)
    for row in slices.collect():       # a table of fixed size: 16 MB in all
        counts[row["slice"]] = np.frombuffer(row["counts"], np.int32)
    order = docs.sparkSession.sparkContext.broadcast(counts.ravel())

    classes = written(one_per_doc.where("n > 0").groupBy("cls")
                      .agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"),
                           F.first("bits").alias("bits")), "ngram-classes")
    total = classes.agg(F.sum(F.col("n") * (100 - percent) / 100 + 1)).first()[0] or 0
    tiles = max(64, math.ceil(total / entries_per_tile))
    met = written(texts.select("text").mapInArrow(
        _entries(order, tiles, percent), "tile long, keys binary, classes binary, bands binary, places binary")
        .groupBy("tile").applyInPandas(_meet, "key long, band short, place int, a long, b long"), "ngram-met")
    entries = met.where("b is null").select("key", "band", "place", "a")

    links = _verify(met.where("b is not null").select("a", "b").distinct(), classes, texts, percent)
    roots = connected_components(links)
    last = star_rounds + nearest_rounds
    for turn in range(1, last + 1):
        left = written(_open_entries(entries, roots), "ngram-open")
        if left.isEmpty():
            break
        entries = left.select("key", "band", "place", "a")
        if turn < star_rounds:
            pairs = _next_star(left, turn)
        else:
            meta = classes.select(F.col("cls").alias("a"), "n", "bits")
            pairs = (_pair_groups(left.join(meta, "a"), tiles).groupBy("tile", "hot", "lo", "hi")
                     .applyInPandas(_cross_pairs(percent, turn < last), "a long, b long").distinct())
        more = _verify(pairs, classes, texts, percent)
        links = union_all([links, more])
        roots = connected_components(links)

    rooted = classes.join(roots, F.col("cls") == F.col("node"), "left").select(
        "cls", "doc_id", F.coalesce("root", "cls").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = rooted.join(smallest, "root").select(F.col("cls").alias("_cls"), "component_id")
    return (one_per_doc.join(named, F.col("cls") == F.col("_cls"), "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.coalesce("component_id", "doc_id").alias("component_id")))


def keep_one_per_component(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Of every component the document with the smallest doc_id, once.

    Rows without a doc_id stay as they are.
    """
    own, version = free_name(docs, "_kept_id"), free_name(docs, "_version")
    first = (ngram_components(docs, percent).where("doc_id = component_id")
             .select(F.col("doc_id").alias(own)).distinct())
    kept = (docs.join(first, F.col("doc_id") == F.col(own), "left_semi")
            .withColumn(version, F.xxhash64("text")).dropDuplicates(["doc_id", version])
            .drop(version))
    return kept.unionByName(docs.where("doc_id is null"))
