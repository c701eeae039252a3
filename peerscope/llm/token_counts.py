"""Token counts of texts with a shortcut for words that are one token.

For tokenizer models of the piece kind (BPE over characters, a space written
as U+2581 and put before the text, byte fallback). Before any text is read,
two facts about the vocabulary are proved from the model file:

* no piece holds the space mark behind another character, so no merge crosses
  from a word into the space after it, and a text's tokens are those of its
  pre-tokens, each a run of spaces and the characters up to the next space;
* which pieces that begin with the space mark are one token when they are
  encoded alone: every one of them is merged from its characters here, and
  kept if the merges end at the piece itself.

Pre-tokens found among the proved pieces count as one. Only the rest is
merged: the neighbours with the best score (the leftmost of equals) become one
part until no two neighbours form a piece; characters that are no piece count
their bytes. Counts of merged pre-tokens are remembered, bounded, per worker.

Awkward input: null and empty texts have no bytes and no tokens; strings of
control pieces inside texts are ordinary text; texts of any length are counted
whole; repeated rows are counted each; other columns are kept unless they
carry the name of a new one; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from peerscope.llm.common import drop_oldest_half, free_name, worker_memory

# fixed values: the mark for a space, and the numbers of the model file's fields
MARK = "▁"
PIECES, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MODEL_TYPE, BPE, BYTE_FALLBACK = 3, 2, 35
DUMMY_PREFIX, REMOVE_EXTRA, ESCAPE = 3, 4, 5

_CHUNK_BYTES = 4 << 20
_CACHE_ENTRIES = 200_000
_LONG = 48


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""
    def varint(i):
        value = shift = 0
        while True:
            byte = data[i]
            i, value, shift = i + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value, i

    i = 0
    while i < len(data):
        tag, i = varint(i)
        if tag & 7 == 0:
            value, i = varint(i)
        else:
            size, i = varint(i) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], i)
            value, i = data[i:i + size], i + size
        yield tag >> 3, value


class PieceModel:
    """Scores of the pieces that merges can form, and the proved whole tokens."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            parts = list(_fields(f.read()))
        self.scores: dict[str, float] = {}
        for number, value in parts:
            if number == PIECES:
                piece = dict(_fields(value))
                if piece.get(3, NORMAL) == NORMAL:
                    self.scores[piece[1].decode()] = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                elif piece[3] in (USER_DEFINED, UNUSED):
                    raise ValueError(f"{path}: user-defined or unused pieces are not supported")
        trainer = dict(_fields(next(v for n, v in parts if n == TRAINER)))
        normalizer = dict(_fields(next(v for n, v in parts if n == NORMALIZER)))
        if trainer.get(MODEL_TYPE) != BPE or not trainer.get(BYTE_FALLBACK):
            raise ValueError(f"{path}: not a BPE model with byte fallback")
        if (normalizer.get(2) or not normalizer.get(DUMMY_PREFIX, 1) or normalizer.get(REMOVE_EXTRA, 1)
                or not normalizer.get(ESCAPE, 1)):
            raise ValueError(f"{path}: texts are changed before they are merged")
        crossing = [p for p in self.scores if MARK in p.lstrip(MARK)]
        if crossing:
            raise ValueError(f"{path}: {crossing[0]!r} reaches from a word over a space")

    def merge(self, word: str) -> list[str]:
        """The parts of a pre-token when no two neighbours form a piece any more."""
        return self._merge_long(word) if len(word) > _LONG else self._merge_short(word)

    def _merge_short(self, word: str) -> list[str]:
        get, parts = self.scores.get, list(word)
        pairs = [get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for i, score in enumerate(pairs):
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = get(parts[at - 1] + parts[at])
            if at < len(pairs):
                pairs[at] = get(parts[at] + parts[at + 1])

    def _merge_long(self, word: str) -> list[str]:
        """The same merges with a heap of (score, place)."""
        parts: list[str] = list(word)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(parts) and (score := self.scores.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-score, i, parts[i] + parts[j]))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, merged = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j >= len(parts) or parts[i] + parts[j] != merged:
                continue
            parts[i], parts[j], after[i] = merged, "", after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p]

    def count(self, word: str) -> int:
        scores = self.scores
        return sum(1 if p in scores else len(p.encode("utf-8", "surrogatepass")) for p in self.merge(word))

    def whole_tokens(self) -> frozenset[str]:
        """The pre-tokens (space mark first) that are proved to be one token when encoded alone."""
        return frozenset(p for p in self.scores if p.startswith(MARK) and self.merge(p) == [p])


class TokenCounter:
    """Counts of pre-tokens; the proved ones without a merge."""

    def __init__(self, path: str, whole: frozenset[str]):
        self.model = PieceModel(path)
        self.whole = {w.replace(MARK, " "): 1 for w in whole}
        self.merged: dict[str, int] = {}

    def of_words(self, words: list[str]) -> np.ndarray:
        """``words`` are distinct pre-tokens with spaces for marks."""
        if len(self.merged) + len(words) > _CACHE_ENTRIES:
            drop_oldest_half(self.merged)
        counts = []
        for word in words:
            n = self.whole.get(word) or self.merged.get(word)
            if n is None:
                n = self.merged[word] = self.model.count(word.replace(" ", MARK))
            counts.append(n)
        return np.array(counts, dtype=np.int64)

    def of_texts(self, texts: list[str]) -> np.ndarray:
        marked = [(" " + t.replace(MARK, " ")).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        sizes = np.array([len(m) for m in marked], dtype=np.int64)
        raw = np.frombuffer(b"".join(marked), np.uint8)
        if not len(raw):
            return np.zeros(len(texts), dtype=np.int64)
        begins = (np.cumsum(sizes) - sizes)[sizes > 0]
        space = raw == 32
        start = space.copy()
        start[1:] &= ~space[:-1]
        start[begins] = True
        starts = np.flatnonzero(start)
        offsets = np.append(starts, len(raw)).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw)).dictionary_encode()
        counts = self.of_words(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        out = np.zeros(len(texts), dtype=np.int64)
        out[sizes > 0] = np.add.reduceat(counts, np.searchsorted(starts, begins))
        return out


def token_counts(docs: DataFrame, path: str, limit: int = 4096, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``n_bytes``, ``n_tokens`` and ``over_limit`` (n_tokens > limit).

    ``path`` is the model file, at the same place on every executor.
    """
    from peerscope.llm.bpe import text_chunks

    whole = PieceModel(path).whole_tokens()  # at most the vocabulary
    kept = [c for c in docs.columns if c not in (text_col, "n_bytes", "n_tokens", "over_limit")]
    text = free_name(docs, "text_to_count")
    fields = [docs.schema[c] for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_memory(("piece-model", path), lambda: TokenCounter(path, whole))
        for batch in batches:
            for i, j, texts in text_chunks(batch.column(0), _CHUNK_BYTES):
                n = counter.of_texts([t or "" for t in texts])
                yield pa.RecordBatch.from_arrays([c.slice(i, j - i) for c in batch.columns[1:]] + [pa.array(n)],
                                                 names=[*kept, "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    schema = StructType([*fields, StructField("n_bytes", LongType()), StructField("n_tokens", LongType())])
    counted = docs.select(F.col(text_col).alias(text), *kept, size.alias("n_bytes")).mapInArrow(run, schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
