"""Overlaps found within the rows of one anchor: rows of both strands (`StrandAnchors`) are shuffled once, and nothing is joined.

All sources of a sink have a row for the anchor of its first window, so whatever has to be known of the sink, such as its longest overlap,
its runs or its degree, is known where that anchor's rows are put together. Each row is a sink on its own strand, on the other one, or on
neither. Anchors of few rows are compared row by row, larger ones by sorting what sources and sinks have besides the anchor, length by
length; only an anchor of more than `most` rows is handed back as it is, for joins over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandweave.functions.fingerprint import PRIME_1, PRIME_2
from strandweave.operators.anchors import StrandAnchors

TASK_ROWS = 1 << 20  # of a task, about
MOST = 1 << 20  # rows of an anchor that a task takes at once
SMALL = 512  # rows of an anchor that are compared row by row
CHUNK = 1 << 20  # pairs of a block


def _groups(blocks: Iterator[pa.RecordBatch], most: int, small: int) -> Iterator[tuple[bool, list[np.ndarray]]]:
    """Rows (key, rest, info), which come in order of keys, in blocks of whole keys; and, marked, those of keys of more than `most` rows."""
    held, large = None, None
    for b in blocks:
        rows = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if large is not None:
            n = np.searchsorted(rows[0], large, side="right")
            if n:
                yield True, [c[:n] for c in rows]
            rows = [c[n:] for c in rows]
        if held is not None:
            rows = [np.concatenate(c) for c in zip(held, rows, strict=True)]
        if not len(rows[0]):
            continue
        cut = np.searchsorted(rows[0], rows[0][-1])
        yield from _parted([c[:cut] for c in rows], most, small)
        held = [c[cut:] for c in rows]
        if len(held[0]) > most:
            large = held[0][0]
            yield True, held
            held = None
    if held is not None:
        yield from _parted(held, most, small)


def _parted(rows: list[np.ndarray], most: int, small: int) -> Iterator[tuple[bool, list[np.ndarray]]]:
    """Whole keys: the small ones together, each other one by itself."""
    starts = np.flatnonzero(np.append(True, rows[0][1:] != rows[0][:-1])) if len(rows[0]) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.append(starts, len(rows[0])))
    bound = min(small, most)
    kept = np.repeat(sizes <= bound, sizes)
    if kept.any():
        yield False, [c[kept] for c in rows]
    for s, n in zip(starts[sizes > bound], sizes[sizes > bound], strict=True):
        yield bool(n > most), [c[s : s + n] for c in rows]


@dataclass
class Block:
    """Rows of whole keys, by key and place, and their sinks: `at` is a sink's row, `back` whether it is one on the other strand."""

    anchors: StrandAnchors
    rest: np.ndarray
    place: np.ndarray
    name: np.ndarray
    single: bool
    group: np.ndarray
    at: np.ndarray
    back: np.ndarray
    by_fingerprint: bool
    chunk: int

    @classmethod
    def of(cls, anchors: StrandAnchors, key: np.ndarray, rest: np.ndarray, info: np.ndarray, by_fingerprint: bool, small: int, chunk: int) -> Block:
        place = info >> 3 & 31
        order = np.lexsort((place, key))
        key, rest, info, place = key[order], rest[order].view(np.uint64), info[order], place[order]
        group = np.cumsum(np.append(0, key[1:] != key[:-1]))
        own, other = np.flatnonzero(info & 4), np.flatnonzero(info & 2)
        at, back = np.append(own, other), np.append(np.zeros(len(own), dtype=bool), np.ones(len(other), dtype=bool))
        return cls(anchors, rest, place, info >> 8 << 1 | info & 1, len(key) > small and not group[-1], group, at, back, by_fingerprint, chunk)

    @property
    def width(self) -> int:
        return self.anchors.length - self.anchors.size

    def _like(self, part: np.ndarray) -> np.ndarray:
        """What has to agree of what an overlap has besides its anchor."""
        return (part % np.uint64(PRIME_1)) << np.uint64(29) | part % np.uint64(PRIME_2) if self.by_fingerprint else part

    def tail(self, rest: np.ndarray, shift: np.ndarray | int) -> np.ndarray:
        return self._like(rest & ((np.uint64(1) << (2 * (self.width - np.asarray(shift))).astype(np.uint64)) - np.uint64(1)))

    def head(self, rest: np.ndarray, shift: np.ndarray | int) -> np.ndarray:
        return self._like(rest >> (2 * np.asarray(shift)).astype(np.uint64))

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(sink, row, shift): the sinks' numbers, the rows of their sources, and by how many bases they are apart; where rows are
        compared one by one, all pairs of a sink in one part, in order of sinks."""
        return self._sorted_pairs() if self.single else self._compared_pairs()

    def _compared_pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        span = self.anchors.length - self.anchors.min_overlap
        spot = self.group * 128 + self.place + 32
        mine = spot[self.at]
        low = np.searchsorted(spot, np.where(self.back, mine - span, mine + 1))
        high = np.searchsorted(spot, np.where(self.back, mine - 1, mine + span), side="right")
        n = high - low
        part = np.cumsum(n) // self.chunk
        cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(n)) if len(n) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            sink = np.repeat(np.arange(a, b), n[a:b])
            row = np.arange(len(sink)) - np.repeat(np.cumsum(n[a:b]) - n[a:b], n[a:b]) + low[sink]
            at, back = self.at[sink], self.back[sink]
            shift = np.abs(self.place[row] - self.place[at])
            one, other = self.rest[np.where(back, at, row)], self.rest[np.where(back, row, at)]
            found = self.tail(one, shift) == self.head(other, shift)
            yield sink[found], row[found], shift[found]

    def keys(self, shift: int, back: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """One anchor's sinks of one strand, and the sources of its overlaps that are `shift` bases apart: numbers, and keys that agree."""
        sinks = np.flatnonzero(self.back == back)
        place = self.width - self.place if back else self.place
        own, other = (self.tail, self.head) if back else (self.head, self.tail)
        at = self.at[sinks]
        rows = np.flatnonzero((place >= shift) & (place - shift < self.anchors.places))
        code = lambda place, part: place.astype(np.uint64) << np.uint64(60) | part
        return sinks, code(place[at], own(self.rest[at], shift)), rows, code(place[rows] - shift, other(self.rest[rows], shift))

    def _sorted_pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for shift in range(1, self.anchors.length - self.anchors.min_overlap + 1):
            for back in (False, True):
                sinks, sink_keys, rows, row_keys = self.keys(shift, back)
                order = np.argsort(sink_keys, kind="stable")
                sinks, sink_keys = sinks[order], sink_keys[order]
                low, high = np.searchsorted(sink_keys, row_keys), np.searchsorted(sink_keys, row_keys, side="right")
                met = high > low
                rows, low, n = rows[met], low[met], (high - low)[met]
                part = np.cumsum(n) // self.chunk
                cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(n)) if len(n) else [0]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    row = np.repeat(np.arange(a, b), n[a:b])
                    sink = sinks[np.arange(len(row)) - np.repeat(np.cumsum(n[a:b]) - n[a:b], n[a:b]) + low[row]]
                    yield sink, rows[row], np.full(len(row), shift)

    def ids(self, rows: np.ndarray, back: np.ndarray) -> np.ndarray:
        """The ids of rows' strings, or of those of the other strand."""
        name = self.name[rows]
        return name >> 1 ^ (back & ~name & 1)

    def ends(self, sink: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two ends of the links that pairs stand for (see `overlap.directed`): the sink's, all of whose links are here, and the other."""
        back = self.back[sink]
        own, other = self.name[self.at[sink]], self.name[row]
        twin = lambda end: end ^ np.where(end & 1, 0, 2)
        return np.where(back, own, twin(own)), np.where(back, twin(other), other)


Found = Callable[[Block], Iterator[list[np.ndarray | pa.Array]]]


def together(anchors: StrandAnchors, strands: DataFrame, find: Found, schema: str, most: int | None = None, by_fingerprint: bool = False) -> DataFrame:
    """What `find` makes of the rows of all anchors, in columns of `schema`, and beside it (key, rest, info) of the rows, else null, of
    anchors of more than `most` rows. One shuffle, to so many tasks that each has about TASK_ROWS rows."""
    most = min(most or MOST, MOST if anchors.places <= 16 else SMALL)  # places and bases fill a number
    small, chunk = SMALL, CHUNK
    names = [c.split()[0] for c in schema.split(", ")]
    tasks = max(16, 3 * strands.count() // TASK_ROWS)

    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        for large, rows in _groups(blocks, most, small):
            if large:
                columns = [pa.array(c) for c in rows]
                kinds = kinds or [_EMPTY[c.split(" ", 1)[1]] for c in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(rows[0]), k) for k in kinds), *columns], names=[*names, "key", "rest", "info"])
                continue
            for out in find(Block.of(anchors, *rows, by_fingerprint, small, chunk)):
                if len(out[0]):
                    columns = [c if isinstance(c, pa.Array) else pa.array(c) for c in out]
                    yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(len(columns[0]), pa.int64()) for _ in range(3))], names=[*names, "key", "rest", "info"])

    rows = anchors.strand_rows(strands).repartition(tasks, "key").sortWithinPartitions("key")
    return rows.mapInArrow(run, f"{schema}, key long, rest long, info long")


_EMPTY = {"int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64())}


def _foreign(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    return own >> 2 != other >> 2


def links(drop_self: bool = True) -> Found:
    """(a, b, ovlp): each link once, where the end with the larger number is a sink."""

    def find(block: Block) -> Iterator[list[np.ndarray]]:
        for sink, row, shift in block.pairs():
            own, other = block.ends(sink, row)
            kept = other <= own
            if drop_self:
                kept &= _foreign(own, other)
            yield [other[kept], own[kept], (block.anchors.length - shift[kept]).astype(np.int32)]

    return find


KNOWN, TOP, MIXED = 1, 2, 4  # of a link's end: all its links were seen, this is a longest one, and there are shorter ones


def halves(block: Block) -> Iterator[list[np.ndarray]]:
    """(a, b, mark): links, a below b, with what is known of either end here: `mark` is the overlap's length above three bits for b and
    three for a. A link of which both ends are known here is in one row, else in two."""
    length = block.anchors.length

    def seen(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for sink, row, shift in parts:
            own, other = block.ends(sink, row)
            kept = _foreign(own, other)
            yield sink[kept], own[kept], other[kept], length - shift[kept]

    most, least = np.zeros(len(block.at), dtype=np.int64), np.full(len(block.at), length)
    if block.single:  # pairs of a sink come in several parts
        for sink, _, _, ovlp in seen(block.pairs()):
            np.maximum.at(most, sink, ovlp)
            np.minimum.at(least, sink, ovlp)
    for sink, own, other, ovlp in seen(block.pairs()):
        if not len(sink):
            continue
        if not block.single:
            first = np.flatnonzero(np.append(True, sink[1:] != sink[:-1]))
            most[sink[first]], least[sink[first]] = np.maximum.reduceat(ovlp, first), np.minimum.reduceat(ovlp, first)
        mark = KNOWN + TOP * (ovlp == most[sink]) + MIXED * (least[sink] < most[sink])
        below = own < other
        a, b, mark = np.where(below, own, other), np.where(below, other, own), ovlp << 6 | np.where(below, mark, mark << 3)
        order = np.lexsort((mark >> 6, b, a))
        a, b, mark = a[order], b[order], mark[order]
        twice = np.append((a[1:] == a[:-1]) & (b[1:] == b[:-1]) & (mark[1:] >> 6 == mark[:-1] >> 6), False)
        mark[:-1] |= np.where(twice[:-1], mark[1:], 0)
        kept = np.append(True, ~twice[:-1])
        yield [a[kept], b[kept], mark[kept]]


RUNS = "ovlp int, n_src long, n_dst long, sources array<long>, sinks array<long>, own_src array<long>, own_dst array<long>"


def runs(block: Block) -> Iterator[list[np.ndarray | pa.Array]]:
    """Columns of RUNS: each overlap string's sources and sinks, which all stand here, and the pairs of them that are of one read."""
    return _sorted_runs(block) if block.single else _compared_runs(block)


def _compared_runs(block: Block) -> Iterator[list[np.ndarray | pa.Array]]:
    for sink, row, shift in block.pairs():
        if not len(sink):
            continue
        order = np.lexsort((row, shift, sink))
        sink, row, shift = sink[order], row[order], shift[order]
        first = np.flatnonzero(np.append(True, (sink[1:] != sink[:-1]) | (shift[1:] != shift[:-1])))  # pairs of a sink and a length
        n, sinks, shifts = np.diff(np.append(first, len(sink))), sink[first], shift[first]
        at, back = block.at[sinks], block.back[sinks]
        part = np.where(back, block.tail(block.rest[at], shifts), block.head(block.rest[at], shifts))
        kind = ((block.group[at] * 2 + back) * 32 + block.place[at]) * 64 + shifts
        order = np.lexsort((sinks, part, kind))
        begins = np.flatnonzero(np.append(True, (kind[order][1:] != kind[order][:-1]) | (part[order][1:] != part[order][:-1])))
        one = order[begins]  # a sink of each run, whose sources are all that the run has
        n_dst, n_src = np.diff(np.append(begins, len(order))), n[one]
        pair = np.repeat(first[one] - (np.cumsum(n_src) - n_src), n_src) + np.arange(n_src.sum())
        src = block.ids(row[pair], block.back[sink[pair]])
        yield _run_rows(block.anchors.length - shifts[one], src, n_src, block.ids(at[order], back[order]), n_dst)


def _sorted_runs(block: Block) -> Iterator[list[np.ndarray | pa.Array]]:
    for shift in range(1, block.anchors.length - block.anchors.min_overlap + 1):
        for back in (False, True):
            sinks, sink_keys, rows, row_keys = block.keys(shift, back)
            one, other = np.argsort(sink_keys, kind="stable"), np.argsort(row_keys, kind="stable")
            sink_keys, row_keys = sink_keys[one], row_keys[other]
            both = np.intersect1d(sink_keys, row_keys)
            (dst, n_dst), (src, n_src) = (_taken(block.ids(x, np.full(len(x), back)), k, both) for x, k in ((block.at[sinks[one]], sink_keys), (rows[other], row_keys)))
            if len(both):
                yield _run_rows(np.full(len(both), block.anchors.length - shift), src, n_src, dst, n_dst)


def _taken(ids: np.ndarray, keys: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of some keys, which are in order, and how many each has."""
    first, last = np.searchsorted(keys, kept), np.searchsorted(keys, kept, side="right")
    n = last - first
    return ids[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


def _run_rows(ovlp: np.ndarray, src: np.ndarray, n_src: np.ndarray, dst: np.ndarray, n_dst: np.ndarray) -> list[np.ndarray | pa.Array]:
    one, other = np.repeat(np.arange(len(n_src)), n_src), np.repeat(np.arange(len(n_dst)), n_dst)
    src, dst = src[np.lexsort((src, one))], dst[np.lexsort((dst, other))]
    read = np.unique(np.append(src, dst) >> 1, return_inverse=True)[1]
    mine, theirs = one << 32 | read[: len(src)], other << 32 | read[len(src) :]
    order = np.argsort(theirs, kind="stable")
    at, n = _taken(order, theirs[order], mine)
    own = np.repeat(np.arange(len(src)), n)
    n_own = np.bincount(one[own], minlength=len(n_src))
    lists = lambda values, sizes: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values))
    return [ovlp.astype(np.int32), n_src, n_dst, lists(src, n_src), lists(dst, n_dst), lists(src[own], n_own), lists(dst[at], n_own)]
