"""Burrows-Wheeler transform and common prefixes of a collection, built column by column.

Round by round every document gives one more symbol, from its last to its first. The collection's suffixes so far are in
order; putting a document's next symbol before its longest suffix makes a new one, and all suffixes that start with the same
symbol keep the order of what follows it. So a round is one sequential pass over the transform that deals its entries into
one segment for each symbol (a stable distribution), and the longest common prefix of neighbours in a segment is one more
than the least common prefix between the places they came from. Every round reads and writes each array front to back.
"""

from __future__ import annotations

import numpy as np


def suffixes(documents: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, offset, common prefix with the suffix before) of all non-empty suffixes, in order.

    Equal suffixes are ordered by document. Common prefixes count up to 255. The memory taken is about 40 bytes for each byte
    of the documents.
    """
    m = len(documents)
    if not m:
        return (np.zeros(0, dtype=np.int64),) * 3
    sizes = np.array([len(d) for d in documents], dtype=np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1  # a place for each suffix, the empty one included
    symbols = np.empty(int(sizes.sum()) + m + 1, dtype=np.uint16)  # the symbol before each place, 0 where a document starts
    symbols[1:] = np.frombuffer(b"\0".join(documents) + b"\0\0", dtype=np.uint8)[: len(symbols) - 1]
    symbols += 1
    symbols[starts] = 0
    order = empties = (starts + sizes).astype(np.int32)
    lcp = none = np.zeros(m, dtype=np.uint8)
    for _ in range(int(sizes.max())):
        before = symbols[order]
        dealt = np.argsort(before, kind="stable")
        ordered = before[dealt]
        dealt = dealt[(skip := int(np.searchsorted(ordered, 1))) :]
        low = np.zeros(len(dealt), dtype=np.uint8)
        same = np.flatnonzero(ordered[skip + 1 :] == ordered[skip:-1])
        if len(same):
            low[same + 1] = np.minimum(_least(lcp, dealt[same] + 1, dealt[same + 1]), 254) + 1
        order = np.concatenate([empties, order[dealt] - 1])
        lcp = np.concatenate([none, low])
    order = order[m:].astype(np.int64)
    doc = np.searchsorted(starts, order, side="right") - 1
    return doc, order - starts[doc], lcp[m:].astype(np.int64)


def _least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of values[lo..hi], both ends included, for many ranges: from minima over spans of powers of two."""
    level = np.frexp((hi - lo + 1).astype(np.float64))[1].astype(np.int64) - 1
    n, top = len(values), int(level.max())
    spans = np.empty((top + 1, n), dtype=values.dtype)
    spans[0] = values
    for k in range(top):
        half, whole = 1 << k, n - (2 << k) + 1
        np.minimum(spans[k, :whole], spans[k, half : half + whole], out=spans[k + 1, :whole])
    flat, row = spans.reshape(-1), level * n
    return np.minimum(flat[row + lo], flat[row + hi + 1 - (1 << level)])


def repeated(documents: list[bytes], owners: np.ndarray, length: int) -> list[tuple[int, int]]:
    """(document, offset) of every string of `length` bytes that also starts in a document of a smaller owner."""
    doc, offset, lcp = suffixes(documents)
    sizes = np.array([len(d) for d in documents], dtype=np.int64)
    if not len(doc):
        return []
    first = np.flatnonzero(lcp < length)  # a run of suffixes that share their first `length` bytes starts here
    run = np.cumsum(lcp < length) - 1
    own = owners[doc]
    least = np.minimum.reduceat(own, first)[run]
    hit = (own > least) & (sizes[doc] - offset >= length)
    return list(zip(doc[hit].tolist(), offset[hit].tolist(), strict=True))
