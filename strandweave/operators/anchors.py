"""Places where overlapping reads can meet: rows for few substrings of a read instead of one for each overlap length.

An overlap holds its sink's first min_overlap bases, a window of the source. Of a window's substrings of `size` bases the one
whose mixed code is least, the leftmost of equals, is its anchor: windows that are equal have equal anchors at equal places. A
source has a row for each anchor of its windows (neighbouring windows mostly share theirs), a sink for that of its first one. Source
and sink that overlap by all but `shift` bases meet in the key of one anchor, at places that differ by `shift`, and in no other row.

Besides the key, which stands for the anchor's bases, a row carries the read's other bases: two bits each in one number where all
reads have capital A, C, G, T only and few enough of them, as text otherwise. Keys of A, C, G, T are exact; with other letters they
are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.functions.blocks import CODE, RAW, by_length, restored

MIX_1, MIX_2, ROLL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0x100000001B3)


def _keys(letters: np.ndarray, size: int) -> np.ndarray:
    """Mixed codes of all substrings of `size` letters of the rows; one to one for A, C, G, T."""
    mixed = []
    known = (letters == 65) | (letters == 67) | (letters == 71) | (letters == 84)
    kinds = [((letters >> 1 & 3).astype(np.uint64), np.uint64(4))] + ([] if known.all() else [(letters.astype(np.uint64), ROLL)])
    for codes, radix in kinds:
        out = np.zeros((len(codes), codes.shape[1] - size + 1), dtype=np.uint64)
        for i in range(size):
            out = out * radix + codes[:, i : i + out.shape[1]]
        out *= MIX_1
        out ^= out >> np.uint64(32)
        mixed.append(out * MIX_2)
    if len(mixed) == 1:
        return mixed[0]
    strange = np.lib.stride_tricks.sliding_window_view(~known, size, axis=1).any(axis=2)
    return np.where(strange, mixed[1], mixed[0])


@dataclass(frozen=True)
class Anchors:
    """Anchors of reads (id, seq) of `length` bases; `packed` if their other bases are kept as numbers."""

    min_overlap: int
    length: int
    packed: bool

    @classmethod
    def of(cls, reads: DataFrame, min_overlap: int) -> Anchors:
        """For the reads of more than min_overlap bases, which have one length; one pass over them."""
        long = reads.where(F.length("seq") > min_overlap)
        shortest, longest, plain = long.agg(F.min(F.length("seq")), F.max(F.length("seq")), F.every(~F.col("seq").rlike("[^ACGT]"))).first()
        if shortest != longest:
            raise ValueError(f"reads of {shortest} to {longest} bases: all must have one length")
        own = cls(min_overlap, longest or min_overlap + 1, False)
        return cls(min_overlap, own.length, bool(plain) and own.length - own.size <= 31)

    @property
    def size(self) -> int:
        return min(31, self.min_overlap - min(12, self.min_overlap * 3 // 8))

    @property
    def places(self) -> int:
        """Of substrings within a window."""
        return self.min_overlap - self.size + 1

    def rows(self, reads: DataFrame, source: bool) -> DataFrame:
        """(key, id, at, rest): the anchors of all windows but the first, or of the first."""
        size, places, least, length, packed = self.size, self.places, self.min_overlap, self.length, self.packed

        def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in blocks:
                if not b.num_rows:
                    continue
                letters = np.array(b.column(1).to_pylist(), dtype=f"S{length}").view(np.uint8).reshape(-1, length)
                keys = _keys(letters, size)
                windows = range(1, length - least + 1) if source else range(1)
                at = np.stack([o + keys[:, o : o + places].argmin(axis=1) for o in windows], axis=1)
                new = np.ones(at.shape, dtype=bool)
                new[:, 1:] = at[:, 1:] != at[:, :-1]  # places of anchors don't go back from window to window
                row, at = np.nonzero(new)[0], at[new]
                left = np.arange(length - size)
                rest = np.take_along_axis(letters[row], np.where(left < at[:, None], left, left + size), axis=1)
                if packed:
                    bits = np.zeros(len(rest), dtype=np.int64)
                    for i in range(rest.shape[1]):
                        bits = bits << 2 | (rest[:, i] >> 1 & 3)
                    other = pa.array(bits)
                else:
                    other = pa.array([r.tobytes().decode() for r in rest], type=pa.string())
                ids = b.column(0).to_numpy(zero_copy_only=False)[row]
                yield pa.RecordBatch.from_arrays([pa.array(keys[row, at].view(np.int64)), pa.array(ids), pa.array(at.astype(np.int32)), other], names=["key", "id", "at", "rest"])

        long = reads.where(F.length("seq") > least).select(F.col("id").cast("long"), "seq")
        return long.mapInArrow(run, f"key long, id long, at int, rest {'long' if packed else 'string'}")

    def tail(self, rest: Column, shift: Column) -> Column:
        """What a source's overlap has besides the anchor's bases."""
        if self.packed:
            return rest.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(self.length - self.size) - shift) * 2) - 1)
        return F.substring(rest, shift + 1, F.lit(self.length))

    def head(self, rest: Column, shift: Column) -> Column:
        """What a sink's overlap has besides the anchor's bases."""
        if self.packed:
            return F.call_function("shiftright", rest, shift * 2)
        return F.substring(rest, F.lit(1), F.lit(self.length - self.size) - shift)

    def start(self, rest: Column, shift: Column) -> Column:
        """What the first min_overlap bases of a source's overlap have besides the anchor's."""
        n = F.lit(self.min_overlap - self.size)
        if self.packed:
            last = F.lit(self.length - self.min_overlap) - shift
            return F.call_function("shiftright", self.tail(rest, shift), last * 2)
        return F.substring(rest, shift + 1, n)

    def shifts(self, at: Column) -> Column:
        """All shifts at which a source's anchor can be that of a window."""
        return F.sequence(F.greatest(at - (self.places - 1), F.lit(1)), F.least(at, F.lit(self.length - self.min_overlap)))


def _window_ends(letters_before: np.ndarray, first: np.ndarray, last: np.ndarray | int, row: np.ndarray) -> np.ndarray:
    """Numbers of the bases [first, last) of rows, from the numbers of all their beginnings; right for up to 31 bases."""
    return letters_before[row, last] - letters_before[row, first] * (np.uint64(1) << (2 * (last - first)).astype(np.uint64))


@dataclass(frozen=True)
class StrandAnchors(Anchors):
    """Anchors of both strands at once, of reads of A, C, G, T that come in one row with their reverse complement.

    The code of a substring is the smaller of its own and its reverse complement's (which differ, as sizes are odd), and a row shows
    the read from the strand where that is the smaller one. So a read has a row for each anchor, not for each of either strand, and
    rows of one key are on one strand. They are sources, and sinks where their anchor is that of the strand's first window
    (`first`), or that of the other strand's (`last`), which is the mirror of the overlap. Where the least code stands twice in a window the
    left one is a sink's anchor; sources have rows for the outermost ones, as the sink may lie on either strand.
    """

    @classmethod
    def of_strands(cls, strands: DataFrame, min_overlap: int) -> StrandAnchors | None:
        """For rows (code, x, y) of `distinct_strands`; none if they have other letters, several lengths, or too many bases for a number."""
        size, kind = F.octet_length("code"), F.substring("code", -1, 1)
        shortest, longest, least, most = strands.agg(F.min(size), F.max(size), F.min(kind), F.max(kind)).first()
        if shortest is None or shortest != longest or least != most or bytes(most) == RAW:
            return None
        own = cls(min_overlap, 4 * (longest - 1) - (-most[0] % 4), True)
        return own if own.min_overlap < own.length and own.length - own.size <= 31 else None

    @property
    def size(self) -> int:
        return super().size - (super().size % 2 == 0)

    def strand_rows(self, strands: DataFrame) -> DataFrame:
        """(key, rest, info): `info` is the id of the read on the row's strand, the anchor's place, and three marks."""
        size, places, least, length = self.size, self.places, self.min_overlap, self.length

        def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in blocks:
                if not b.num_rows:
                    continue
                ((_, letters),) = by_length(restored(b.column(0)))
                x, twin = b.column(1).to_numpy(zero_copy_only=False), b.column(2).is_valid().to_numpy(zero_copy_only=False)
                if (b.column(2).to_numpy(zero_copy_only=False)[twin] != x[twin] ^ 1).any():
                    raise ValueError("ids of both strands must be 2 n and 2 n + 1")
                n, codes, before = len(x), CODE[letters], []
                for own in (codes, 3 - codes[:, ::-1]):
                    sums = np.zeros((length + 1, n), dtype=np.uint64)
                    for i, c in enumerate(np.ascontiguousarray(own.T)):
                        sums[i + 1] = sums[i] * np.uint64(4) + c
                    before.append(np.ascontiguousarray(sums.T))
                one, other = (m[:, size:] - m[:, : length - size + 1] * np.uint64(4**size) & np.uint64(4**size - 1) for m in before)
                other = other[:, ::-1]
                turned, key = other < one, np.minimum(one, other)
                mixed = key * MIX_1
                mixed ^= mixed >> np.uint64(32)
                mixed *= MIX_2
                backwards, used = mixed[:, ::-1], np.zeros(key.shape, dtype=bool)
                every = np.arange(n)
                for o in range(length - least + 1):
                    left = o + mixed[:, o : o + places].argmin(axis=1)
                    end = length - size + 1 - o - places
                    right = o + places - 1 - backwards[:, end : end + places].argmin(axis=1)
                    used[every, left] = used[every, right] = True
                    first = left if o == 0 else first
                used &= twin[:, None] | ~turned  # a string that is its own complement has each anchor twice
                row, at = np.nonzero(used)
                turn = turned[row, at]
                begins, ends = at == first[row], at == right[row]
                first_window, last_window = np.where(turn, ends, begins), np.where(turn, begins, ends)
                place = np.where(turn, length - size - at, at)
                seen = np.concatenate(before)
                line = row + n * turn
                rest = _window_ends(seen, np.zeros_like(place), place, line) << (2 * (length - size - place)).astype(np.uint64) | _window_ends(seen, place + size, np.full_like(place, length), line)
                info = (x[row] ^ turn) << 8 | place << 3 | first_window << 2 | last_window << 1 | ~twin[row]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (key[row, at], rest, info)], names=["key", "rest", "info"])

        return strands.select("code", "x", "y").mapInArrow(run, "key long, rest long, info long")
