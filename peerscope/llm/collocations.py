"""Phrase collocations from a weighted de Bruijn graph of word grams.

Texts fall into pieces and words; every word position adds one gram, the words
from there up to ``order`` or the end of its piece. A gram of ``order`` words
is an edge between its first and its last ``order - 1`` words; a shorter one is
what a piece's end takes from its nodes. Edges of weight ``min_count`` or more
form the graph. Its unary paths (nodes with one edge in and one out, of equal
weight) are compacted by pointer doubling, and the count of every shorter
phrase follows from the flow along the paths plus the remaining grams.

Before grams are counted, a first pass counts the two- and three-word grams in
2**32 hashed slots; a gram whose slot stays below ``min_count`` cannot be in a
frequent phrase, and the gram of a position is cut there. Slots shared by
chance only keep more grams, so all counts of frequent phrases stay exact. The
slots travel as bits, 32 MB at most; a corpus that fills them loses the saving,
not the result.

Awkward input: null texts are empty and add nothing, a null ``lang`` is
``und``; repeated rows count as often as they stand; texts of any length are
cut at piece ends only; other columns and their names do not matter; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peerscope.llm.bpe import text_chunks
from peerscope.llm.common import union_all, written

# fixed values: bytes that end a piece and bytes that part words
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
WORD_GAPS = b" \t"

BATCH_BYTES = 2 << 20   # text that is split at once
FLUSH_SLOTS = 2 << 20   # slots that are counted before they are sent
SLOT_RANGES = 1024      # groups of slots that are summed together
RANGE_BITS = 22         # slots of a range: 2**32 / SLOT_RANGES
TOP_BUCKETS = 32        # parts of a language whose first phrases are found apart
MAX_FILTER_BITS = 28    # the bits sent to the tasks: at most 2**28, 32 MB


def _byte_classes() -> tuple[np.ndarray, np.ndarray]:
    lower, kind = np.arange(256, dtype=np.uint8), np.zeros(256, dtype=np.uint8)
    lower[65:91] += 32
    kind[list(WORD_GAPS)] = 1
    kind[list(PIECE_ENDS)] = 2
    return lower, kind


LOWER, KIND = _byte_classes()


def _part(text: bytes) -> Iterator[bytes]:
    """A text in parts of about BATCH_BYTES, cut behind the ends of pieces only."""
    while len(text) > BATCH_BYTES:
        ends = np.flatnonzero(KIND[np.frombuffer(text, np.uint8)] == 2)
        if not len(ends):
            break
        i = int(np.searchsorted(ends, BATCH_BYTES))
        cut = int(ends[max(i - 1, 0)]) + 1
        yield text[:cut]
        text = text[cut:]
    yield text


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[str]]]:
    texts, langs, size = [], [], 0
    for batch in batches:
        for i, j, some in text_chunks(batch.column(0), BATCH_BYTES):
            for text, lang in zip(some, batch.column(1).slice(i, j - i).to_pylist()):
                for part in _part(text.encode()) if text else ():
                    if size and size + len(part) > BATCH_BYTES:
                        yield texts, langs
                        texts, langs, size = [], [], 0
                    texts.append(part)
                    langs.append(lang)
                    size += len(part) + 1
    if texts:
        yield texts, langs


class Words:
    """The words of some texts in order: number of the word, of its language, room up to its piece's end."""

    def __init__(self, texts: list[bytes], langs: list[str], order: int):
        raw = np.frombuffer(b"\n".join(texts), np.uint8)
        kind = KIND[raw]
        inside = np.zeros(len(raw) + 2, dtype=np.int8)
        inside[1:-1] = kind == 0
        edge = np.diff(inside)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        offsets = np.zeros(len(starts) + 1, dtype=np.int32)
        np.cumsum(ends - starts, out=offsets[1:])
        packed = LOWER[raw[kind == 0]]
        coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(packed)).dictionary_encode()
        self.code = coded.indices.to_numpy(zero_copy_only=False)
        self.words = coded.dictionary
        names = sorted(set(langs))
        place = {name: i for i, name in enumerate(names)}
        self.langs = names
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
        doc = np.searchsorted(begins, starts, side="right") - 1
        self.lang = np.array([place[x] for x in langs], dtype=np.int32)[doc]
        ends_of_pieces = np.flatnonzero(kind == 2)
        first_after = np.append(np.searchsorted(starts, ends_of_pieces), len(starts))
        after = first_after[np.searchsorted(ends_of_pieces, starts)]
        self.room = np.minimum(after - np.arange(len(starts)), order).astype(np.int8)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _slots(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the two- and three-word grams that start at each word (past a piece's end: of no meaning)."""
    import xxhash

    by_word = np.array([xxhash.xxh64_intdigest(x) for x in w.words.to_pylist()], dtype=np.uint64)
    by_lang = np.array([xxhash.xxh64_intdigest(x, seed=1) for x in w.langs], dtype=np.uint64)
    h = by_word[w.code] if len(w.code) else np.zeros(0, np.uint64)
    one = _mix(h + (by_lang[w.lang] if len(w.code) else h))
    nothing = np.zeros(2, np.uint64)
    two = _mix(one + np.concatenate([h[1:], nothing[:1]])[:len(h)])
    three = _mix(two + np.concatenate([h[2:], nothing])[:len(h)])
    return (two >> np.uint64(32)).astype(np.uint32), (three >> np.uint64(32)).astype(np.uint32)


def _count_slots(order: int, min_count: int):
    def run(batches):
        kept, size = [], 0
        for texts, langs in _groups(batches):
            w = Words(texts, langs, order)
            two, three = _slots(w)
            kept += [two[w.room >= 2], three[w.room >= 3]]
            size += len(kept[-1]) + len(kept[-2])
            if size >= FLUSH_SLOTS:
                yield _slot_rows(kept, min_count)
                kept, size = [], 0
        if size:
            yield _slot_rows(kept, min_count)
    return run


def _slot_rows(kept: list[np.ndarray], min_count: int) -> pa.RecordBatch:
    slots, counts = np.unique(np.concatenate(kept), return_counts=True)
    counts = np.minimum(counts, min_count).astype("<u4" if min_count > 255 else "u1")
    bounds = np.searchsorted(slots, np.arange(SLOT_RANGES + 1, dtype=np.uint64) << np.uint64(RANGE_BITS))
    rows = [(i, slots[a:b].astype("<u4").tobytes(), counts[a:b].tobytes())
            for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])) if a < b]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2))],
        names=["part", "slots", "counts"])


def _heavy_slots(min_count: int):
    """Rows in the order of their range: one range's counters at a time, whatever the number of rows."""
    mask = (1 << RANGE_BITS) - 1

    def row(part, total):
        heavy = np.flatnonzero(total >= min_count).astype("<u4") + np.uint32(part << RANGE_BITS)
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([len(heavy)], pa.int64()), pa.array([heavy.tobytes()], pa.binary())],
            names=["part", "n", "heavy"])

    def run(batches):
        part, total = None, None
        for batch in batches:
            for p, slots, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part:
                    if total is not None:
                        yield row(part, total)
                    part, total = p, np.zeros(1 << RANGE_BITS, dtype=np.uint32)
                at = np.frombuffer(slots, "<u4") & np.uint32(mask)
                add = np.frombuffer(counts, "<u4" if min_count > 255 else "u1")
                total[at] = np.minimum(total[at] + add, min_count)
        if total is not None:
            yield row(part, total)
    return run


def _fold(bits: int):
    """The heavy slots of a range as bits; a slot's bit is named by its upper ``bits`` bits."""
    def run(batches):
        for batch in batches:
            parts, packed = batch.column(0).to_pylist(), []
            for part, heavy in zip(parts, batch.column(1).to_pylist()):
                at = np.frombuffer(heavy, "<u4") >> np.uint32(32 - bits)
                own = np.zeros((1 << bits) // SLOT_RANGES, dtype=np.uint8)
                own[at - np.uint32(part * len(own))] = 1
                packed.append(np.packbits(own, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(packed, pa.binary())],
                                             names=["part", "bits"])
    return run


def heavy_filter(texts: DataFrame, order: int, min_count: int) -> tuple[int, np.ndarray]:
    """Bits of the slots that hold ``min_count`` or more grams; at most 32 MB whatever the input."""
    counted = texts.mapInArrow(_count_slots(order, min_count), "part int, slots binary, counts binary")
    heavy = written(counted.repartition("part").sortWithinPartitions("part")
                    .mapInArrow(_heavy_slots(min_count), "part int, n long, heavy binary"), "heavy-slots")
    n = heavy.agg(F.sum("n")).first()[0] or 0
    bits = min(max(16, int(32 * n).bit_length()), MAX_FILTER_BITS)
    table = np.zeros((SLOT_RANGES, (1 << bits) // SLOT_RANGES // 8), dtype=np.uint8)
    for row in heavy.select("part", "heavy").mapInArrow(_fold(bits), "part int, bits binary").toLocalIterator():
        table[row["part"]] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return bits, table.reshape(-1)


def _lengths(w: Words, bits: int, table: np.ndarray, order: int) -> np.ndarray:
    """Words of each position's gram: up to its piece's end, cut where a phrase cannot be frequent."""
    def heavy(slots):
        at = slots >> np.uint32(32 - bits)
        return (table[at >> np.uint32(3)] >> (at & np.uint32(7)).astype(np.uint8)) & 1 > 0

    two, three = (heavy(s) for s in _slots(w))
    two &= w.room >= 2
    three &= two & (w.room >= 3)
    three[:-1] &= two[1:]
    length = np.ones(len(w.code), dtype=np.int8)
    length[two] = 2
    alive = three
    for k in range(3, order + 1):
        length[alive] = k
        if k < order:
            after = np.zeros_like(alive)
            after[:len(alive) - (k - 2)] = three[k - 2:]
            alive = alive & after
    return length


def _count_grams(order: int, shipped, bits: int):
    def run(batches):
        for texts, langs in _groups(batches):
            w = Words(texts, langs, order)
            if not len(w.code):
                continue
            length = np.minimum(_lengths(w, bits, shipped.value, order), w.room)
            n_words, at = len(w.words), np.arange(len(w.code))
            name = w.lang.astype(np.int64) * n_words + w.code
            names, grams, counts = [], [], []
            for k in range(1, order + 1):
                own = length[at] == k
                _, first, n = np.unique(name[own], return_index=True, return_counts=True)
                where = at[own][first]
                if len(where):
                    columns = [w.words.take(pa.array(w.code[where + j])) for j in range(k)]
                    grams.append(pc.binary_join_element_wise(*columns, " ") if k > 1 else columns[0])
                    names.append(pa.array(w.langs).take(pa.array(w.lang[where])))
                    counts.append(pa.array(n, pa.int64()))
                at, name = at[~own], name[~own]
                if not len(at) or k == order:
                    break
                _, name = np.unique(name, return_inverse=True)
                name = name * n_words + w.code[at + k]
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays(names), pa.concat_arrays(grams), pa.concat_arrays(counts)],
                names=["lang", "gram", "n"])
    return run


def _words(gram: Column) -> Column:
    return F.size(F.split(gram, " "))


def position_grams(docs: DataFrame, order: int = 5, min_count: int = 100) -> DataFrame:
    """``lang, gram, k, n``: the grams of all word positions, added up.

    ``k == order``: edges of the graph. Shorter: piece ends, and positions
    whose longer gram cannot be frequent.
    """
    spark = docs.sparkSession
    texts = docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    bits, table = heavy_filter(texts, order, min_count)
    shipped = spark.sparkContext.broadcast(table)
    counted = texts.mapInArrow(_count_grams(order, shipped, bits), "lang string, gram string, n long")
    grams = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return grams.select("lang", "gram", _words("gram").alias("k"), "n")


def compact_paths(edges: DataFrame, order: int = 5) -> DataFrame:
    """``lang, words, n_edges, n``: the unary paths of the graph of ``edges`` (lang, gram, n).

    Two edges belong to one path when the node between them has no other edge
    and both have the same weight. Pointers to an edge's predecessor are
    doubled until they reach the path's first edge, so paths of L edges take
    log2(L) joins on the edges; edges of a ring have no first edge and are
    paths of their own.
    """
    first = F.substring_index("gram", " ", order - 1)
    last = F.substring_index("gram", " ", 1 - order)
    edges = written(edges.select("lang", "gram", "n", first.alias("u"), last.alias("v")), "graph-edges")
    into = edges.groupBy("lang", F.col("v").alias("node")).agg(
        F.count("*").alias("n_in"), F.min("gram").alias("before"), F.min("n").alias("w_in"))
    out_of = edges.groupBy("lang", F.col("u").alias("node")).agg(
        F.count("*").alias("n_out"), F.min("gram").alias("after"), F.min("n").alias("w_out"))
    links = (into.join(out_of, ["lang", "node"])
             .where("n_in = 1 and n_out = 1 and w_in = w_out and before <> after")
             .select("lang", F.col("after").alias("gram"), "before"))
    at = written(edges.join(links, ["lang", "gram"], "left")
                 .select("lang", "gram", "n", F.col("before").alias("ptr"),
                         F.when(F.col("before").isNull(), 0).otherwise(1).cast("long").alias("steps"),
                         F.coalesce("before", "gram").alias("head"),
                         F.col("before").isNull().alias("done")), "graph-paths")
    open_edges = at.where("not done").count()
    while open_edges:
        target = at.select("lang", F.col("gram").alias("ptr"), F.col("ptr").alias("t_ptr"),
                           F.col("steps").alias("t_steps"), F.col("head").alias("t_head"),
                           F.col("done").alias("t_done"))
        moved = at.where("not done").join(target, ["lang", "ptr"])
        at = written(at.where("done").unionByName(moved.select(
            "lang", "gram", "n", F.col("t_ptr").alias("ptr"), (F.col("steps") + F.col("t_steps")).alias("steps"),
            F.col("t_head").alias("head"), F.col("t_done").alias("done"))), "graph-paths")
        still = at.where("not done").count()
        if still == open_edges:
            break
        open_edges = still
    at = at.select("lang", "gram", "n", F.when(F.col("done"), F.col("head")).otherwise(F.col("gram")).alias("head"),
                   F.when(F.col("done"), F.col("steps")).otherwise(0).alias("steps"))
    tails = F.transform(F.array_sort(F.collect_list(F.struct("steps", F.substring_index("gram", " ", -1).alias("word")))),
                        lambda s: s["word"])
    return (at.groupBy("lang", "head").agg(tails.alias("tails"), F.min("n").alias("n"))
            .select("lang", F.concat(F.slice(F.split("head", " "), 1, order - 1), "tails").alias("words"),
                    F.size("tails").alias("n_edges"), "n"))


def phrase_counts(docs: DataFrame, order: int = 5, min_count: int = 100) -> tuple[DataFrame, DataFrame]:
    """Counts of the phrases of 1 to ``order`` words: (``lang, phrase, k, f``, ``lang, n`` words in all).

    Exact for every phrase with ``min_count`` occurrences or more, and only
    these are returned.
    """
    grams = written(position_grams(docs, order, min_count), "position-grams")
    totals = grams.groupBy("lang").agg(F.sum("n").alias("n_words"))
    edge = (F.col("k") == order) & (F.col("n") >= min_count)
    paths = written(compact_paths(grams.where(edge), order), "compact-paths")
    # flow along the paths: every edge starts one phrase of each length
    starts = paths.select("lang", "words", "n", F.explode(F.sequence(F.lit(1), F.col("n_edges"))).alias("at"))
    from_paths = starts.select("lang", "n", F.slice("words", F.col("at"), order).alias("words"))
    rest = grams.where(~edge).select("lang", "n", F.split("gram", " ").alias("words"))
    flow = from_paths.unionByName(rest).select("lang", "n", "words", F.explode(
        F.sequence(F.lit(1), F.size("words"))).alias("k"))
    counts = (flow.groupBy("lang", F.array_join(F.slice("words", 1, F.col("k")), " ").alias("phrase"), "k")
              .agg(F.sum("n").alias("f")).where(F.col("f") >= min_count))
    return written(counts, "phrase-counts"), totals


def collocations(docs: DataFrame, order: int = 5, min_count: int = 100, top: int = 2000,
                 cover_percent: int = 100) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases of 2 to ``order`` words.

    The score of a phrase is floor(1000 * a * n / (l * r)) at its weakest cut
    (ties: the earliest). Phrases inside a longer candidate with at least
    ``cover_percent`` of their count are left out.
    """
    counts, totals = phrase_counts(docs, order, min_count)
    candidates = counts.where("k >= 2")
    if order > 2:
        covers = union_all([_inner_phrases(candidates, size) for size in range(2, order)])
        best = covers.groupBy("lang", "phrase").agg(F.max("cover").alias("cover"))
        candidates = (candidates.join(best, ["lang", "phrase"], "left")
                      .where(F.col("cover").isNull()
                             | (100 * F.col("cover").cast("decimal(22,0)") < cover_percent * F.col("f").cast("decimal(22,0)"))))
    words = F.split("phrase", " ")
    cuts = (candidates.select("lang", "phrase", "k", F.col("f").alias("a"), words.alias("words"),
                              F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
            .select("lang", "phrase", "a", "cut", F.array_join(F.slice("words", 1, F.col("cut")), " ").alias("head"),
                    F.array_join(F.slice("words", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("rest")))
    f = counts.select("lang", "phrase", "f")
    big = "decimal(19,0)"
    scored = (cuts.join(f.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
              .join(f.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
              .join(F.broadcast(totals) if _few(totals) else totals, "lang")
              .selectExpr("lang", "phrase", "a", "cut", "l", "r", "n_words AS n",
                          f"(CAST(a AS {big}) * CAST(n_words AS {big}) * CAST(1000 AS decimal(4,0)))"
                          f" DIV (CAST(l AS {big}) * CAST(r AS {big})) AS score"))
    weakest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("s"))
    best_first = [F.desc("score"), F.desc("a"), "phrase"]
    # each bucket's first rows before the language's: one task never gets more than TOP_BUCKETS * top rows
    in_bucket = Window.partitionBy("lang", "bucket").orderBy(*best_first)
    first = (weakest.select("lang", "phrase", "s.a", "s.l", "s.r", "s.n", "s.score")
             .withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(TOP_BUCKETS)))
             .withColumn("rank", F.row_number().over(in_bucket)).where(F.col("rank") <= top))
    return (first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best_first)).cast("long"))
            .where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def _inner_phrases(candidates: DataFrame, size: int) -> DataFrame:
    """``lang, cover, phrase``: the phrases of ``size`` words inside longer candidates, with the count of these."""
    place = F.sequence(F.lit(1), F.col("k") - size + 1)
    inner = F.transform(place, lambda i: F.array_join(F.slice(F.split("phrase", " "), i, size), " "))
    return (candidates.where(F.col("k") > size)
            .select("lang", F.col("f").alias("cover"), F.explode(inner).alias("phrase")))


def _few(totals: DataFrame, bound: int = 10_000) -> bool:
    """Whether the table of languages is small enough to be sent to every task."""
    return totals.limit(bound + 1).count() <= bound
