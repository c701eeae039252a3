"""BPE encoding and decoding with a contiguous rank array.

The merges of a word are found as follows: the parts of the word (at
first its bytes) stand in an array, with the merge rank of every two
neighbours in a second one. Again and again the array is scanned for the
smallest rank (the leftmost of equals), the boundary there is deleted, and the
ranks on both sides of the new part are looked up anew, until no neighbours
merge. Words of one length class are worked on together, one numpy row per
word; words of more than ``LONG_WORD`` bytes, for which a scan per merge would be
quadratic, use a heap of neighbour ranks with the same result.

Encoding follows a tokenizer file of the word-level byte BPE kind: NFC,
white space runs to one space, lower case, split into letter runs, single digits and
runs of other characters, bytes as printable characters, word end mark. Words
do not cross white space, so pieces between white space are encoded once and
remembered (bounded, per Python worker).

Defined results: null and empty text have no tokens and decode to the empty
string; the strings of special tokens are those tokens; texts of any length
are encoded whole, ``_CHUNK_BYTES`` of text at a time.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from peerscope.llm.common import drop_oldest_half, worker_memory

LONG_WORD = 256
_CHUNK_BYTES = 4_000_000
_CACHE_ENTRIES = 300_000
_NO_RANK = np.int32(2**31 - 1)

# fixed values: the split pattern of the tokenizer file
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# characters with the Unicode property White_Space; str.split() adds \x1c-\x1f
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves, the others in turn for the
    characters from 256 on.
    """
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


def pieces_of(text: str) -> list[str]:
    """The runs between Unicode white space."""
    if _SEPARATORS.search(text):
        return [p for p in _SPACE.split(text) if p]
    return text.split()


class WordBpe:
    """A tokenizer file with ranked merges and a word end mark."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model.get("end_of_word_suffix") or ""
        characters = byte_characters()
        self.first = np.array([vocab[c] for c in characters], np.int64)
        self.last = np.array([vocab[c + end] for c in characters], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.base = max(vocab.values()) + 1
        keys = left * self.base + right
        by = np.argsort(keys, kind="stable")
        self.keys = keys[by]
        self.ranks = by.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([self.base - 1, *self.special.values()]) + 1)
        for token, i in {**vocab, **self.special}.items():
            self.tokens[i] = token
        alternatives = "|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))
        self.special_pattern = re.compile(f"({alternatives})") if alternatives else None
        self.piece_ids: dict[str, bytes] = {}
        self.piece_text: dict[str, str] = {}
        self.word_ids: dict[str, bytes] = {}

    # -- merging ------------------------------------------------------------

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of neighbours; ``_NO_RANK`` where they do not merge (or one is -1, padding)."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (right >= 0), self.ranks[at], _NO_RANK)

    def _merge_rows(self, parts: np.ndarray) -> list[np.ndarray]:
        """Merge every row of a (words, bytes) array of part ids, padded with -1."""
        done: list[np.ndarray | None] = [None] * len(parts)
        rows = np.arange(len(parts))
        if parts.shape[1] > 1:
            ranks = self._rank(parts[:, :-1], parts[:, 1:])
        while parts.shape[1] > 1:
            at = ranks.argmin(axis=1)
            lowest = ranks[np.arange(len(parts)), at]
            live = lowest != _NO_RANK
            if not live.all():
                for i in np.flatnonzero(~live):
                    done[rows[i]] = parts[i][parts[i] >= 0]
                rows, parts, ranks, at, lowest = (x[live] for x in (rows, parts, ranks, at, lowest))
            if not len(rows):
                return done
            each = np.arange(len(rows))
            parts[each, at] = self.merged[lowest]
            width = parts.shape[1] - 1
            columns = np.arange(width)
            # the boundary right of ``at`` goes: later parts and ranks move up by one
            parts = np.take_along_axis(parts, columns + (columns > at[:, None]), axis=1)
            if width == 1:
                break
            columns = columns[:-1]
            ranks = np.take_along_axis(ranks, columns + (columns >= at[:, None]), axis=1)
            before, after = at > 0, at < width - 1
            i, j = each[before], at[before]
            ranks[i, j - 1] = self._rank(parts[i, j - 1], parts[i, j])
            i, j = each[after], at[after]
            ranks[i, j] = self._rank(parts[i, j], parts[i, j + 1])
        for i, row in zip(rows, parts):
            done[i] = row[row >= 0]
        return done

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same merges for one long word, by a heap of (rank, position)."""
        lookup = {int(k): int(r) for k, r in zip(self.keys, self.ranks)}
        after = list(range(1, len(parts))) + [-1]
        before = list(range(-1, len(parts) - 1))
        gone = [False] * len(parts)

        def rank(i: int, j: int) -> int | None:
            return lookup.get(parts[i] * self.base + parts[j])

        heap = [(r, i, i + 1) for i in range(len(parts) - 1) if (r := rank(i, i + 1)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, j = heapq.heappop(heap)
            if gone[i] or after[i] != j or rank(i, j) != r:
                continue
            parts[i], gone[j], after[i] = int(self.merged[r]), True, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (new := rank(a, b)) is not None:
                    heapq.heappush(heap, (new, a, b))
        return [p for p, g in zip(parts, gone) if not g]

    def encode_words(self, words: list[str]) -> None:
        """Encode the words that are not remembered yet."""
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            raw = word.encode("utf-8", "surrogatepass")
            if len(raw) > LONG_WORD:
                parts = self.first[np.frombuffer(raw, np.uint8)]
                parts[-1] = self.last[raw[-1]]
                self.word_ids[word] = np.array(self._merge_long(parts.tolist()), "<u4").tobytes()
            else:
                by_length.setdefault(len(raw), []).append((word, raw))
        for length, group in by_length.items():
            raw = np.frombuffer(b"".join(r for _, r in group), np.uint8).reshape(len(group), length)
            parts = self.first[raw]
            parts[:, -1] = self.last[raw[:, -1]]
            for (word, _), ids in zip(group, self._merge_rows(parts)):
                self.word_ids[word] = ids.astype("<u4").tobytes()

    # -- texts --------------------------------------------------------------

    def words_of(self, piece: str) -> list[str]:
        if piece.isascii():
            return _WORDS.findall(piece.lower())
        # letter by letter a capital sigma becomes the same small one everywhere
        return _WORDS.findall(unicodedata.normalize("NFC", piece).replace("\u03a3", "\u03c3").lower())

    def remember(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.piece_ids]
        if len(self.piece_ids) + len(new) > _CACHE_ENTRIES:
            drop_oldest_half(self.piece_ids)
            drop_oldest_half(self.piece_text)
            new = [p for p in pieces if p not in self.piece_ids]
        split = [self.words_of(p) for p in new]
        unknown = {w for words in split for w in words if w not in self.word_ids}
        if len(self.word_ids) + len(unknown) > _CACHE_ENTRIES:
            drop_oldest_half(self.word_ids)
            unknown = {w for words in split for w in words if w not in self.word_ids}
        self.encode_words(list(unknown))
        for piece, words in zip(new, split):
            ids = b"".join([self.word_ids[w] for w in words])
            self.piece_ids[piece] = ids
            self.piece_text[piece] = self.decode(np.frombuffer(ids, "<u4"))

    def decode(self, ids: np.ndarray) -> str:
        """Token strings joined by spaces: such files name no decoder."""
        return " ".join([self.tokens[i] for i in ids.tolist()])

    def encode_batch(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """(ids as little-endian 32-bit integers, decoded text) of each text."""
        out, plain = [], []
        for text in texts:
            parts = [text or ""]
            if self.special_pattern is not None and "<|" in parts[0]:
                parts = self.special_pattern.split(parts[0])
            plain.append([p if p in self.special else pieces_of(p) for p in parts])
        self.remember({p for parts in plain for ps in parts if isinstance(ps, list) for p in ps})
        for parts in plain:
            ids, decoded = [], []
            for part in parts:
                if isinstance(part, list):
                    ids += map(self.piece_ids.__getitem__, part)
                    decoded += map(self.piece_text.__getitem__, part)
                else:
                    ids.append(np.array([self.special[part]], "<u4").tobytes())
                    decoded.append(part)
            out.append((b"".join(ids), " ".join(decoded)))
        return out


def text_chunks(column: pa.Array, most: int) -> Iterator[tuple[int, int, list]]:
    """(start, end, values) of slices of a text column of about ``most`` bytes each."""
    total = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(column):
        before = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, before + most, "right")))
        yield start, end, column.slice(start, end - start).to_pylist()
        start = end


def bpe_encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids",
               decoded_col: str = "decoded") -> DataFrame:
    """``docs`` with the token ids (binary, little-endian 32-bit) and the decoded text added.

    ``path`` is the tokenizer file, at the same place on every executor.
    """
    kept = [c for c in docs.columns if c not in (ids_col, decoded_col)]
    fields = [docs.schema[c] for c in kept]
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_memory(("words", path), lambda: WordBpe(path))
        for batch in batches:
            for i, j, texts in text_chunks(batch.column(at), _CHUNK_BYTES):
                ids, decoded = zip(*bpe.encode_batch(texts))
                yield pa.RecordBatch.from_arrays(
                    [c.slice(i, j - i) for c in batch.columns]
                    + [pa.array(ids, pa.binary()), pa.array(decoded, pa.string())],
                    names=[*kept, ids_col, decoded_col])

    schema = StructType([*fields, StructField(ids_col, BinaryType()), StructField(decoded_col, StringType())])
    return docs.select(*kept).mapInArrow(run, schema)
