"""Words of UTF-8 texts as 64-bit hashes, for Arrow functions.

Words are maximal runs of bytes other than space and \\x09-\\x0D, which is what ``bytes.split()`` cuts at.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers of the shingle mix.
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


#: Bytes of words (and of what Python needs for each) that a process remembers; longer words are hashed anew each time.
KNOWN_BYTES, LONGEST = 24 << 20, 256


class _Hashes(dict):
    """Word to hash; forgets everything when full, which costs time but never changes a value."""

    held = 0

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONGEST:
            self.held += len(word) + 200
            if self.held > KNOWN_BYTES:
                self.clear()
                self.held = 0
            self[word] = value
        return value


_CACHE = _Hashes()


def word_hashes(data: bytes | None, lower: bool = True) -> np.ndarray:
    """Hash of every word, in order; ASCII letters in lower case if *lower* (``bytes.lower`` leaves others alone)."""
    words = (data.lower() if lower else data).split() if data else []
    return np.fromiter(map(_CACHE.__getitem__, words), dtype=np.uint64, count=len(words))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of *width* words, in order; of the whole sequence where it is shorter (none if empty)."""
    n = len(hashes)
    if n == 0:
        return hashes
    span = min(width, n)
    out = np.full(n - span + 1, np.uint64(span), dtype=np.uint64)
    for k in range(span):
        out = (out ^ hashes[k:n - span + 1 + k]) * MIX[k % 3]
        out ^= out >> np.uint64(29)
    return out


def signed(values: np.ndarray) -> np.ndarray:
    """Unsigned hashes as the longs that Spark has."""
    return values.view(np.int64)
