"""Token ids as ORC files: run-length coded integers, row indexes, Bloom filters.

Documents are range-partitioned and sorted by doc_id, encoded with the tokenizers
library, ended with ``end_id`` and written as ORC: ids are an integer
column in ORC's run-length encoding, every stripe has row indexes (smallest and
largest doc_id of each ``row_index_stride`` rows) and a Bloom filter on doc_id.
Files, and stripes within a file, can be read by separate tasks; a search for
one document skips files, stripes and row groups by these metadata.

A byte-level tokenizer of this kind begins a token at every space that follows
another character and at a line end between visible ones, so a few megabytes of text are cut there in arrays, their
distinct pieces are looked up among those met lately or else encoded, and the ids gathered. Where a space stands inside a run of white
space, or a special token's string occurs, the text is encoded as a whole.

Defined results: null and empty text is the end id alone; rows with null doc_id
come first; repeated rows are stored as often as they occur; an empty table
gives a store without rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peerscope.llm.bpe import text_chunks
from peerscope.llm.common import worker_memory

_CHUNK_BYTES = 6_000_000
_LINES = 500
_KNOWN_PIECES = 1_000_000    # pieces and bytes of pieces that a worker remembers
_KNOWN_BYTES = 32_000_000
_INNER_SPACE = re.compile(r" \s(?<=\s \s)")   # from the literal, which is found fast
SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"


class PieceEncoder:
    """Token ids of texts with the tokenizers library, by their distinct pieces.

    Pieces met lately are remembered in arrays: their strings, their ids one after the other, and
    the number of ids of each. Beyond the bounds only those of the latest texts stay.
    """

    def __init__(self, path: str, most: int = _KNOWN_PIECES, most_bytes: int = _KNOWN_BYTES):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.most, self.most_bytes = most, most_bytes
        self.forget()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line_end = line_end[0] if len(line_end) == 1 else None

    def forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.known_ids, self.known_n = np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def look_up(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """What ``of_pieces`` returns; only pieces that are not remembered are encoded."""
        at = pc.fill_null(pc.index_in(pieces, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(at < 0)
        fresh = pieces.take(pa.array(new))
        ids, n = self.of_pieces(fresh)
        at[new] = len(self.known) + np.arange(len(new))
        self.known = pa.concat_arrays([self.known, fresh])
        self.known_ids, self.known_n = np.concatenate([self.known_ids, ids]), np.concatenate([self.known_n, n])
        n = self.known_n[at]
        ids = _gather(self.known_ids, (np.cumsum(self.known_n) - self.known_n)[at], n)
        if len(self.known) > self.most or self.known.nbytes > self.most_bytes:
            self.known, self.known_ids, self.known_n = pieces, ids, n
            if len(pieces) > self.most or pieces.nbytes > self.most_bytes:
                self.forget()
        return ids, n

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in found]

    def of_pieces(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of distinct pieces, each with the space or line end before it, one after the other; number of each).

        Pieces with printable characters behind the first go to the library as lines of a
        few texts; the line ends are tokens of their own and part the ids again. So do
        pieces with single line ends between printable parts, as several lines.
        """
        line, n_lines = np.zeros(len(pieces), dtype=bool), np.ones(len(pieces), dtype=np.int64)
        if self.line_end is not None:
            data, at = np.frombuffer(pieces.buffers()[2] or b"", np.uint8), np.frombuffer(pieces.buffers()[1], "<i4")
            at = at[pieces.offset:pieces.offset + len(pieces) + 1]
            # pieces with bytes that are not plain ASCII letters, digits, marks or the space are looked at one by one
            odd = np.flatnonzero((data < 32) | (data > 126))
            some = np.searchsorted(odd, at[1:]) > np.searchsorted(odd, at[:-1])
            line = (at[1:] > at[:-1] + 1) & ~some
            line[some] = [_as_lines(p) for p in pieces.filter(pa.array(some)).to_pylist()]
            breaks = odd[data[odd] == 10]
            n_lines += np.searchsorted(breaks, at[1:]) - np.searchsorted(breaks, at[:-1])
        lines = np.flatnonzero(line)
        cuts = np.append(np.arange(0, len(lines), _LINES), len(lines)).astype(np.int32)
        blocks = [lines[i:j] for i, j in zip(cuts[:-1], cuts[1:])]
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), pieces.filter(pa.array(line))), "\n").to_pylist()
        coded = self.tokenizer.encode_batch_fast([f"{text}\n" for text in joined], add_special_tokens=False)
        n, parts, order = np.zeros(len(pieces), dtype=np.int64), [], []
        for block, found in zip(blocks, coded if len(lines) else []):
            ids = np.array(found.ids, "<u4")
            ends, last = np.flatnonzero(ids == self.line_end), np.cumsum(n_lines[block])
            if len(ends) == last[-1]:
                ends = ends[last - 1]
                n[block] = np.diff(ends, prepend=-1) - 1
                parts.append(np.delete(ids, ends))
                order.append(block)
            else:
                line[block] = False
        rest = np.flatnonzero(~line)
        alone = self.whole(pieces.take(pa.array(rest)).to_pylist())
        n[rest] = [len(x) for x in alone]
        order = np.concatenate([*order, rest]).astype(np.int64)
        flat = np.concatenate([*parts, *alone, np.zeros(0, "<u4")])
        # from the order of encoding to the order of the pieces
        first = np.empty(len(pieces), dtype=np.int64)
        first[order] = np.cumsum(n[order]) - n[order]
        return _gather(flat, first, n), n

    def encode_batch(self, texts: list[str], end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, ``end`` behind each; number of ids of each text).

        The pieces of all texts are cut and numbered in arrays; only distinct ones are looked up.
        """
        apart = [bool(_INNER_SPACE.search(t)) or any(s in t for s in self.special) for t in texts]
        # a space before each text makes its first piece like the others for now
        raw_texts = [b"" if x or not t else b" " + t.encode("utf-8", "surrogatepass") for x, t in zip(apart, texts)]
        sizes = np.array([len(r) for r in raw_texts], dtype=np.int64)
        raw = np.frombuffer(b"".join(raw_texts), np.uint8)
        begins = np.cumsum(sizes) - sizes
        cut = raw == 32
        cut[_lone_line_ends(raw)] = True
        starts = np.flatnonzero(cut)
        offsets = np.append(starts, len(raw)).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw)).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        flat, n_ids = self.look_up(coded.dictionary)
        # the first piece of a text has no space before it
        first_pieces = np.searchsorted(starts, begins[sizes > 0])
        heads = self.whole([p[1:] for p in coded.dictionary.take(pa.array(codes[first_pieces])).to_pylist()])
        codes[first_pieces] = len(n_ids) + np.arange(len(heads))
        # behind the pieces of a text: the text as a whole, if it was kept apart, and the end
        whole = self.whole([t for t, x in zip(texts, apart) if x])
        next_whole = len(n_ids) + len(heads)
        end_code = next_whole + len(whole)
        at, more = [], []
        for stop, x in zip(np.searchsorted(starts, begins + sizes).tolist(), apart):
            if x:
                at.append(stop)
                more.append(next_whole)
                next_whole += 1
            at.append(stop)
            more.append(end_code)
        codes = np.insert(codes, np.array(at, dtype=np.int64), np.array(more, dtype=np.int64))
        own = [*heads, *whole, np.frombuffer(end, "<u4")]
        n_ids = np.concatenate([n_ids, [len(x) for x in own]]).astype(np.int64)
        flat = np.concatenate([flat, *own])
        n = n_ids[codes]
        ids = _gather(flat, (np.cumsum(n_ids) - n_ids)[codes], n)
        # every text ends with the code of the end
        ends = np.cumsum(n)[np.flatnonzero(codes == end_code)]
        return ids, np.diff(ends, prepend=0)


def _as_lines(piece: str) -> bool:
    """Whether every line end of a piece stands by itself, and all behind its first character is printable."""
    head, *rest = piece.split("\n")
    return (not head or (len(head) > 1 and head.isprintable())) and all(x and x.isprintable() for x in rest)


def _lone_line_ends(raw: np.ndarray) -> np.ndarray:
    """Places of line ends between two visible characters, each ASCII or one of U+00C0 to U+00FF."""
    visible, latin = (raw > 32) & (raw < 127), raw == 0xC3
    at = np.flatnonzero(raw == 10)
    at = at[(at > 1) & (at < len(raw) - 1)]
    return at[(visible[at - 1] | latin[at - 2]) & (visible[at + 1] | latin[at + 1])]


def _gather(flat: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The runs of ``n`` values that begin at ``first``, one after the other."""
    ends = np.cumsum(n)
    return flat[np.repeat(first - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


def _encode(path: str, end_id: int):
    """Task function: one row per document of a sorted partition, with its place in the partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, start = worker_memory(("byte-pieces", path), lambda: PieceEncoder(path)), 0
        end, part = np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        for batch in batches:
            for i, j, texts in text_chunks(batch.column(1), _CHUNK_BYTES):
                flat, n = encoder.encode_batch([t or "" for t in texts], end)
                ends = np.cumsum(n)
                values = pa.array(flat.view("<i4"))
                ids = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array([part] * (j - i), pa.int32()),
                     pa.array(start + ends - n), pa.array(n), ids],
                    names=["doc_id", "part", "local_start", "n_tokens", "ids"])
                start += int(ends[-1]) if len(ends) else 0
    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2,
                 stripe_mb: int = 64, row_index_stride: int = 2_000) -> None:
    """Write the store at ``path``, in ascending doc_id order over its files."""
    # sorting one long text at a time is what a sort of (id, text) does; ties by a hash of the text
    tie = F.xxhash64("text")
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .repartitionByRange("doc_id").sortWithinPartitions("doc_id", tie))
    (rows.mapInArrow(_encode(tokenizer, end_id), SCHEMA).write
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
     .option("orc.create.index", "true").option("orc.row.index.stride", str(row_index_stride))
     .option("orc.stripe.size", str(stripe_mb << 20)).option("orc.compress", "ZSTD")
     .orc(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): the store, with each document's place in the whole sequence.

    Places need one number per file part, which is all that is summed in one task
    and broadcast (16 bytes a part; parts hold 100 MB and more of a large table).
    """
    stored = spark.read.schema(SCHEMA).orc(path)
    sizes = stored.groupBy("part").agg(F.max(F.col("local_start") + F.col("n_tokens")).alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    return stored.join(F.broadcast(offsets), "part").select(
        "doc_id", (F.col("offset") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def find_tokens(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of some documents; files and stripes without them are skipped by their metadata."""
    return spark.read.schema(SCHEMA).orc(path).where(F.col("doc_id").isin(doc_ids)) \
                .select("doc_id", "n_tokens", "ids")


def token_checksums(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of stored documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            at = ids.offsets.to_numpy()
            raw = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes())
            sums = [zlib.crc32(raw[4 * i:4 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())],
                                             names=["doc_id", "start", "n_tokens", "ids_crc32"])
    return tokens.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
