"""Hashed word shingles of whole texts."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

from strandweave.llm.common import mix64

_P = 0x9E3779B97F4A7C15 | 1
_Q = pow(_P, -1, 1 << 64)
_powers = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, grown as texts need."""
    global _powers
    if len(_powers[0]) < n:
        n = max(n, 2 * len(_powers[0]), 1 << 16)
        up = np.full(n, _P, dtype=np.uint64)
        down = np.full(n, _Q, dtype=np.uint64)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash (xxh3) of each word's bytes, A-Z lower-cased, in order; words are runs of bytes other than space and 0x09-0x0D."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII letters and blanks only
    return np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; with fewer words, of the whole sequence; none without words."""
    words = word_hashes(text) if text else np.zeros(0, dtype=np.uint64)
    if not len(words):
        return words
    size = min(k, len(words))
    out = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        out = mix64(out + words[i : len(words) - size + 1 + i])
    return np.unique(out)

