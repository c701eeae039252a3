"""Word shingles of texts as sorted 64-bit hash sets (numpy, inside tasks)."""

from __future__ import annotations

import numpy as np
import xxhash

# fixed values: odd multipliers of the shingle hash
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)
_CACHE_WORDS = 150_000


class WordHashes(dict):
    """word (bytes) -> 64-bit hash; forgets everything when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(_MULTIPLIERS[0])
    h ^= h >> np.uint64(29)
    return h


def shingle_set(text: str | None, words: WordHashes, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles of a whole text.

    Words are runs of characters other than ASCII white space, A-Z lower-cased
    (bytes.lower and bytes.split do exactly that). A text of fewer words is one
    shingle; without words the set is empty.
    """
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not tokens:
        return np.empty(0, np.uint64)
    if len(tokens) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(tokens), 1)], np.uint64)
    w = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    n = len(w) - width + 1
    h = w[:n] * np.uint64(_MULTIPLIERS[0])
    for i in range(1, width):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(_MULTIPLIERS[i % len(_MULTIPLIERS)]) + w[i:n + i]
    return np.unique(_mix(h))
