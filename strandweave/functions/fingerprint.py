"""Dual polynomial fingerprints of base strings, exact in 64-bit arithmetic.

h(s c) = (h(s) * radix + code(c)) mod prime for two (radix, prime) pairs; fp = h1 << 32 | h2, always a non-negative long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandweave.functions.bases import digits, encode
from strandweave.functions.blocks import by_length

# The two prime moduli and their radices.
PRIME_1, RADIX_1 = 536870909, 5
PRIME_2, RADIX_2 = 536870879, 7


@dataclass(frozen=True)
class Hash:
    """One polynomial hash. Smaller primes make collisions likely, for diagnostics."""

    prime: int
    radix: int

    @property
    def inverse(self) -> int:
        return pow(self.radix, self.prime - 2, self.prime)

    def power(self, n: int) -> int:
        return pow(self.radix, n, self.prime)

    @property
    def chunk(self) -> int:
        """How many codes, as digits to the base of the radix, a 64-bit number holds; 0 where codes are no such digits."""
        return int(62 / log2(self.radix)) if 5 <= self.radix <= 36 else 0

    def read_on(self, h: Column, digits_: Column, size: int) -> Column:
        """From the hash of what is before a chunk of `size` codes to that with the chunk, read as one number."""
        return (h * self.power(size) + F.conv(digits_, self.radix, 10).cast("long") % self.prime) % self.prime

    def of(self, seq: Column) -> Column:
        """Hash of a string; 0 for an empty one."""
        if self.chunk:
            return F.aggregate(chunks(seq, self.chunk), F.lit(0).cast("long"), lambda h, c: self.read_on(h, c, self.chunk))
        codes = F.transform(F.sequence(F.lit(1), F.length(seq)), lambda i: encode(F.substring(seq, i, F.lit(1))))
        fold = F.aggregate(codes, F.lit(0).cast("long"), lambda a, e: (a * self.radix + e) % self.prime)
        return F.when(F.length(seq) == 0, F.lit(0).cast("long")).otherwise(fold)

    def prefixes(self, seq: Column) -> Column:
        """Array of the hashes of all non-empty prefixes (an inclusive scan)."""
        start = F.array().cast("array<bigint>")
        step = lambda a, i: F.array_append(a, (F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("long")) * self.radix + encode(F.substring(seq, i, F.lit(1)))) % self.prime)
        return F.when(F.length(seq) == 0, start).otherwise(F.aggregate(F.sequence(F.lit(1), F.length(seq)), start, step))

    def concat(self, left: Column, right: Column, right_length: Column) -> Column:
        """Hash of a concatenation from the parts' hashes (the monoid that segmented scans rest on)."""
        shift = F.aggregate(F.sequence(F.lit(1), F.greatest(right_length, F.lit(1))), F.lit(1).cast("long"), lambda a, _: a * self.radix % self.prime)
        return (left * F.when(right_length == 0, F.lit(1).cast("long")).otherwise(shift) + right) % self.prime

    def next_suffix(self, h: Column, code: Column, length: int) -> Column:
        """From the hash of the suffix of `length`, whose first base has this code, to that of length - 1."""
        return (h + (self.prime - code * self.power(length - 1) % self.prime)) % self.prime

    def previous_prefix(self, h: Column, code: Column) -> Column:
        """From the hash of a prefix, whose last base has this code, to that of the prefix without it."""
        return (h + self.prime - code) % self.prime * self.inverse % self.prime


DUAL = (Hash(PRIME_1, RADIX_1), Hash(PRIME_2, RADIX_2))


def combine(h1: Column, h2: Column) -> Column:
    return F.shiftleft(h1.cast("long"), 32).bitwiseOR(h2.cast("long"))


def split(fp: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def chunks(seq: Column, size: int) -> Column:
    """A string's codes as digits in chunks of one size, the first filled up with zeros, which count for nothing."""
    return F.regexp_extract_all(F.lpad(digits(seq), (F.ceil(F.length(seq) / F.lit(size)) * size).cast("int"), F.lit("0")), F.lit(f"[0-9]{{{size}}}"), F.lit(0))


def fingerprint(seq: Column, pair: tuple[Hash, Hash] = DUAL) -> Column:
    """Both hashes, folded over the same chunks in one go."""
    size = min(h.chunk for h in pair)
    if not size:
        return combine(pair[0].of(seq), pair[1].of(seq))
    zero = F.struct(*(F.lit(0).cast("long").alias(n) for n in ("a", "b")))
    step = lambda h, c: F.struct(pair[0].read_on(h["a"], c, size).alias("a"), pair[1].read_on(h["b"], c, size).alias("b"))
    return F.aggregate(chunks(seq, size), zero, step, lambda h: combine(h["a"], h["b"]))


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of strings of ASCII letters, by position and string, 0 beyond a string's end; and whether a string is that long."""
    letters = np.array([t.encode() for t in texts])
    letters = np.ascontiguousarray(letters.view(np.uint8).reshape(len(texts), letters.itemsize).T)
    inside = letters != 0
    return np.where(inside, (letters >> 1 & 3) + 1, 0).astype(np.int64), inside


def _hashes(letters: np.ndarray, k: Hash) -> np.ndarray:
    """One hash of rows of one length: several codes at a time are read as one number, which the hash so far is shifted by."""
    rows, n = letters.shape
    size = 8 if k.prime * k.radix**8 < 1 << 52 else 1
    h, codes = np.zeros(rows, dtype=np.int64), (letters >> 1 & 3) + 1
    for i in range(0, n, size):
        part = codes[:, i : i + size]
        powers = np.array([k.radix**j for j in range(part.shape[1])][::-1], dtype=np.float64)
        h = (h * k.radix ** part.shape[1] + (part.astype(np.float64) @ powers).astype(np.int64)) % k.prime  # all below 2**53
    return h


def _scanned(df: DataFrame, column: str, pair: tuple[Hash, Hash], sums: bool) -> DataFrame:
    at = df.columns.index(column)
    names = [*df.columns, *(("sum_h1", "sum_h2") if sums else ("fp",))]

    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks:
            if not b.num_rows:
                continue
            if not sums:
                fp = np.zeros(b.num_rows, dtype=np.int64)
                for rows, letters in by_length(b.column(at)):
                    first, second = (_hashes(letters, k) for k in pair)
                    fp[rows] = first << 32 | second
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp)], names=names)
                continue
            codes, inside = _codes(b.column(at).to_pylist())
            found = []
            for k in pair:
                h, total = np.zeros(b.num_rows, dtype=np.int64), np.zeros(b.num_rows, dtype=np.int64)
                for code, there in zip(codes, inside, strict=True):
                    h = np.where(there, (h * k.radix + code) % k.prime, h)
                    total += np.where(there, h, 0)
                found.append(total)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x) for x in found)], names=names)

    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.LongType()) for n in names[len(df.columns) :])])
    return df.mapInArrow(run, schema)


def fingerprinted(df: DataFrame, column: str = "seq", pair: tuple[Hash, Hash] = DUAL) -> DataFrame:
    """The rows with the fingerprint of a column of ASCII strings, as `fp`: that of `fingerprint`, scanned a block of rows at a time."""
    return _scanned(df, column, pair, sums=False)


def prefix_sums(df: DataFrame, column: str = "seq", pair: tuple[Hash, Hash] = DUAL) -> DataFrame:
    """The rows with the sums of both hashes of all non-empty prefixes, `sum_h1` and `sum_h2`, by an inclusive scan."""
    return _scanned(df, column, pair, sums=True)


def _rolled(first: Column, least: int, longest: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Fingerprints of lengths `least` to `longest`: each from the one before by `step` (struct of both hashes, length)."""
    a, b = split(first)
    start = F.array(F.struct(a.alias("a"), b.alias("b")))
    lengths = F.when(longest > least, F.sequence(F.lit(least + 1), longest)).otherwise(F.array().cast("array<int>"))
    grown = F.aggregate(lengths, start, lambda done, n: F.array_append(done, step(F.element_at(done, -1), n)))
    return F.transform(grown, lambda h: combine(h["a"], h["b"]))


def prefix_fingerprints(seq: Column, least: int, pair: tuple[Hash, Hash] = DUAL) -> Column:
    """Those of the prefixes of `least` bases up to all but one, one base more each time."""

    def step(h: Column, n: Column) -> Column:
        code = encode(F.substring(seq, n, F.lit(1)))
        return F.struct(*(((h[i] * k.radix + code) % k.prime).alias(i) for i, k in zip("ab", pair, strict=True)))

    return _rolled(fingerprint(F.substring(seq, F.lit(1), F.lit(least)), pair), least, F.length(seq) - 1, step)


def suffix_fingerprints(seq: Column, least: int, longest_read: int, pair: tuple[Hash, Hash] = DUAL) -> Column:
    """Those of the suffixes; a base more at the front counts its code times a power of the radix, from a small table."""
    powers = [F.array(*(F.lit(k.power(n)).cast("long") for n in range(least, max(longest_read, least + 1)))) for k in pair]

    def step(h: Column, n: Column) -> Column:
        code = encode(F.substring(seq, F.length(seq) - n + 1, F.lit(1)))
        return F.struct(*(((h[i] + code * F.element_at(p, n - least)) % k.prime).alias(i) for i, k, p in zip("ab", pair, powers, strict=True)))

    return _rolled(fingerprint(F.substring(seq, F.length(seq) - least + 1, F.lit(least)), pair), least, F.length(seq) - 1, step)
