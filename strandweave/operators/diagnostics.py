"""How often different strings share a fingerprint."""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions.blocks import CODE, RAW, by_length, even_column, packed, restored
from strandweave.functions.fingerprint import DUAL, Hash, fingerprinted
from strandweave.operators.overlap import suffix
from strandweave.operators.reads import both_strands

BASE_BYTES = np.frombuffer(b"ACGT", dtype=np.uint8)  # in order of their packed codes
SMALL_PRIMES = 1 << 16  # product of primes up to which all fingerprints are counted in a table
TASK_STRINGS = 1 << 21  # of a task, about


def side(reads: DataFrame, which: str, length: int | None = None) -> DataFrame:
    """(fp-less) strings to test: whole reads, or suffixes or prefixes of a length."""
    if which == "read" or length is None:
        return reads.select(F.col("seq").alias("sub"))
    return reads.select((suffix("seq", length) if which == "suffix" else F.substring("seq", 1, length)).alias("sub"))


def strings_per_fp(reads: DataFrame, pair: tuple[Hash, Hash] = DUAL, which: str = "read", length: int | None = None) -> DataFrame:
    """(fp, n_strings): how many different strings each fingerprint stands for."""
    strings = side(reads, which, length).groupBy("sub").agg(F.count("*").alias("n"))
    return fingerprinted(strings.select("sub"), "sub", pair).groupBy("fp").agg(F.count("*").alias("n_strings"))


def collisions_by_round(reads: DataFrame, min_overlap: int, pair: tuple[Hash, Hash] = DUAL) -> DataFrame:
    """(ovlp, side, n_strings, n_fps, n_shared_fps) of the suffixes and prefixes that each round compares, by one aggregation.

    Suffixes are prefixes read backwards. Reads are shuffled whole, once for each side, by the min_overlap bases that all strings of a
    read on that side share, and put in order; a read's prefixes longer than what it has in common with the read before are new.
    """
    wanted = reads.where(F.length("seq") > min_overlap)
    ends = F.array(F.struct(F.lit("suffix").alias("side"), F.reverse("seq").alias("text")), F.struct(F.lit("prefix").alias("side"), F.col("seq").alias("text")))
    own = wanted.select(F.explode(ends).alias("e")).select("e.side", "e.text").withColumn("seed", F.xxhash64(F.substring("text", 1, min_overlap)))
    dealt = own.repartition("side", "seed").sortWithinPartitions("side", "text").select("side", "text")

    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = ("", "")
        for b in blocks:
            sides, texts, ovlps, subs = [], [], [], []
            for side, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shared = len(commonprefix([last[1], text])) if side == last[0] else 0
                if side == last[0] and len(last[1]) - 1 < shared:
                    shared = len(last[1]) - 1  # the whole of the read before is no string of its own
                for n in range(max(min_overlap, shared + 1), len(text)):
                    sides.append(side)
                    ovlps.append(n)
                    subs.append(text[:n] if side == "prefix" else text[:n][::-1])
                last = (side, text)
            yield pa.RecordBatch.from_arrays([pa.array(ovlps, type=pa.int32()), pa.array(sides, type=pa.string()), pa.array(subs, type=pa.string())], names=["ovlp", "side", "sub"])

    strings = dealt.mapInArrow(run, "ovlp int, side string, sub string")
    return _per_round(fingerprinted(strings, "sub", pair).groupBy("ovlp", "side", "fp").agg(F.count("*").alias("n")))


def strand_collisions(strands: DataFrame, min_overlap: int, pair: tuple[Hash, Hash] = DUAL) -> DataFrame:
    """The rows of `collisions_by_round` for the strings of both strands, from rows (code, x, y) of `distinct_strands`.

    The suffixes are the reverse complements of the prefixes, so one order of packed strings tells both apart, and both fingerprints are
    rolled over blocks of them. With small primes a task adds up its counts of all fingerprints. Strings of other letters or several
    lengths, and rounds of fewer than 4 bases, which no byte of a packed string tells apart, go through `collisions_by_round`.
    """
    n, shortest, longest, least, most = strands.agg(F.count("*"), F.min(F.octet_length("code")), F.max(F.octet_length("code")), *(f(F.substring("code", -1, 1)) for f in (F.min, F.max))).first()
    if not n or shortest != longest or least != most or bytes(most) == RAW or min_overlap < 4:
        return collisions_by_round(both_strands(strands), min_overlap, pair)
    length = 4 * (longest - 1) - (-most[0] % 4)
    small = pair[0].prime * pair[1].prime
    small = small if small <= SMALL_PRIMES else 0
    lengths, sides = range(min_overlap, length), ("prefix", "suffix")

    def pack(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks:
            if b.num_rows:
                ((_, letters),) = by_length(restored(b.column(0)))
                codes = CODE[letters]
                for own in (codes, 3 - codes[b.column(1).is_valid().to_numpy(zero_copy_only=False)][:, ::-1]):
                    yield pa.RecordBatch.from_arrays([even_column(packed(own), pa.binary())], names=["code"])

    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, counts = np.full((1, length), 255, dtype=np.uint8), np.zeros((len(lengths), 2, small), dtype=np.int64)
        code = (BASE_BYTES >> 1 & 3).astype(np.int64) + 1

        def batch(ovlp: int, side: int, h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            size = len(h)
            return pa.RecordBatch.from_arrays([pa.array(np.full(size, ovlp, dtype=np.int32)), pa.array([sides[side]] * size, type=pa.string()), pa.array(h), pa.array(n)], names=["ovlp", "side", "fp", "n"])

        for b in blocks:
            if not b.num_rows:
                continue
            ((_, body),) = by_length(b.column(0))
            codes = np.stack([body >> s & 3 for s in (6, 4, 2, 0)], axis=2).reshape(len(body), -1)[:, :length]
            shared = (codes != np.concatenate([last, codes[:-1]])).argmax(axis=1)  # all strings differ
            last = codes[-1:]
            heads, tails = [np.zeros(len(codes), dtype=np.int64) for _ in pair], [np.zeros(len(codes), dtype=np.int64) for _ in pair]
            for k in range(1, length):
                own, other = code[codes[:, k - 1]], code[3 - codes[:, k - 1]]
                heads = [(h * p.radix + own) % p.prime for h, p in zip(heads, pair, strict=True)]
                tails = [(h + other * p.power(k - 1)) % p.prime for h, p in zip(tails, pair, strict=True)]
                if k < min_overlap:
                    continue
                new = shared < k
                for side, (one, two) in enumerate((heads, tails)):
                    if small:
                        counts[k - min_overlap, side] += np.bincount(one[new] * pair[1].prime + two[new], minlength=small)
                    elif new.any():
                        yield batch(k, side, one[new] << 32 | two[new], np.ones(new.sum(), dtype=np.int64))
        for k, side in ((k, s) for k in lengths for s in (0, 1)):
            found = np.flatnonzero(counts[k - min_overlap, side])
            yield batch(k, side, found // pair[1].prime << 32 | found % pair[1].prime if small else found, counts[k - min_overlap, side][found])

    texts = strands.select("code", "y").mapInArrow(pack, "code binary")
    dealt = texts.repartition(max(8, 2 * n // TASK_STRINGS), F.substring("code", 1, min_overlap // 4)).sortWithinPartitions("code")
    return _per_round(dealt.mapInArrow(run, "ovlp int, side string, fp long, n long").groupBy("ovlp", "side", "fp").agg(F.sum("n").alias("n")))


def _per_round(per_fp: DataFrame) -> DataFrame:
    return per_fp.groupBy("ovlp", "side").agg(F.sum("n").alias("n_strings"), F.count("*").alias("n_fps"), F.count(F.when(F.col("n") > 1, 1)).alias("n_shared_fps"))


def collision_rate(reads: DataFrame, pair: tuple[Hash, Hash] = DUAL, which: str = "read", length: int | None = None) -> DataFrame:
    """One row: distinct strings, distinct fingerprints, and the share of strings lost to collisions in per cent."""
    strings = side(reads, which, length).groupBy("sub").agg(F.count("*").alias("n"))
    per_fp = fingerprinted(strings.select("sub"), "sub", pair).groupBy("fp").agg(F.count("*").alias("n"))
    totals = per_fp.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_strings"), F.count("*").alias("n_fps"), F.count(F.when(F.col("n") > 1, 1)).alias("n_shared_fps"))
    return totals.withColumn("rate_percent", F.when(F.col("n_strings") == 0, F.lit(0.0)).otherwise((1 - F.col("n_fps") / F.col("n_strings")) * 100))
