"""Per-read operators: strands and ids, distinct reads, lengths and offsets, columns of bases."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.functions.bases import base_at
from strandweave.functions.blocks import CODE, COMPLEMENT, by_length, complement, even_column, restored, squeeze, squeezed
from strandweave.functions.fingerprint import DUAL, Hash, fingerprinted
from strandweave.plans.storage import running_total

TASK_READS = 1 << 18


def orient(reads: DataFrame) -> DataFrame:
    """(id, seq) of both strands: id = 2 * ordinal + strand, strand 1 being the reverse complement. No shuffle."""

    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks:
            ordinal = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for rows, letters in by_length(b.column(1)):
                ids, n = np.repeat(ordinal[rows] * 2, 2), letters.shape[1]
                ids[1::2] += 1
                if (letters > 127).any():
                    seqs = pa.array([s for x in letters for own in [x.tobytes().decode()] for s in (own, complement(own))], type=pa.string())
                else:
                    both = np.empty((len(rows), 2, n), dtype=np.uint8)
                    both[:, 0], both[:, 1] = letters, COMPLEMENT[letters[:, ::-1]]
                    seqs = even_column(both.reshape(2 * len(rows), n), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(ids), seqs], names=["id", "seq"])

    return reads.select(F.col("ordinal").cast("long"), "seq").mapInArrow(run, "id long, seq string")


def strand(oriented_id: Column) -> Column:
    return oriented_id.bitwiseAND(1)


def read_number(oriented_id: Column) -> Column:
    return F.shiftright(oriented_id, 1)


def with_fingerprint(oriented: DataFrame, pair: tuple[Hash, Hash] = DUAL) -> DataFrame:
    return fingerprinted(oriented, "seq", pair)


def distinct_reads(oriented: DataFrame, by: str = "seq") -> DataFrame:
    """The smallest id of each string (or of each fingerprint): one shuffle, with partial aggregation before it."""
    if by == "seq":
        return oriented.groupBy("seq").agg(F.min("id").alias("id")).select("id", "seq")
    return oriented.groupBy(by).agg(F.min("id").alias("id"), F.min_by("seq", "id").alias("seq")).select("id", "seq", by)


def _entries(text: str, ordinal: int) -> list[tuple[bytes, int, int, int]]:
    """One read's rows of `distinct_strands` (-1 for no id): one, unless complementing the complement gives another string."""
    other = complement(text)
    if complement(other) == text:
        a, b = squeeze(text), squeeze(other)
        return [(a, 2 * ordinal, -1, 2) if a == b else (a, 2 * ordinal, 2 * ordinal + 1, 2) if a < b else (b, 2 * ordinal + 1, 2 * ordinal, 2)]
    a, b = squeeze(other), squeeze(complement(other))
    return [(squeeze(text), 2 * ordinal, -1, 1), (a, 2 * ordinal + 1, -1, 1) if a <= b else (b, -1, 2 * ordinal + 1, 1)]


def distinct_strands(reads: DataFrame) -> DataFrame:
    """(code, x, y, n, size): each string of either strand with its smallest id, a string and its reverse complement in one row.

    n is how many oriented reads have either, `size` their length. One shuffle, of a row for each read (see `read_strands`); where their
    number is known, to so many tasks that each has about TASK_READS of them, else with partial aggregation before it.
    """
    rows = read_strands(reads)
    if known := getattr(reads, "_strandweave_rows", 0):
        rows = rows.repartition(max(16, known // TASK_READS), "code")
    return rows.groupBy("code").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.sum("n").alias("n"), F.max("size").alias("size"))


def read_strands(reads: DataFrame) -> DataFrame:
    """(code, x, y, n, size): reads and their reverse complements, both in one row. `code` stands for the smaller of both strings, packed to
    two bits a base; x is its id and y that of the other (null if there is none)."""

    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks:
            ordinal = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for rows, letters in by_length(b.column(1)):
                codes = CODE[letters]
                plain = (codes < 4).all(axis=1)
                codes, o, odd = codes[plain], ordinal[rows[plain]], []
                own, other = squeezed(codes), squeezed(3 - codes[:, ::-1])
                a, b_ = (m.view(f"S{m.shape[1]}").reshape(-1) for m in (own, other))
                swap, same = b_ < a, b_ == a
                x, y = 2 * o + swap, np.where(same, -1, 2 * o + ~swap)
                code = even_column(np.where(swap[:, None], other, own), pa.binary())
                parts = [(code, x, y, np.full(len(o), 2, dtype=np.int64))]
                odd = [e for i, p in zip(rows[~plain], letters[~plain], strict=True) for e in _entries(p.tobytes().decode(), int(ordinal[i]))]
                if odd:
                    key, *numbers = zip(*odd, strict=True)
                    parts.append((pa.array(key, type=pa.binary()), *(np.array(v, dtype=np.int64) for v in numbers)))
                for code, x, y, n in parts:
                    size = np.full(len(code), letters.shape[1], dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([code, pa.array(x, mask=x < 0), pa.array(y, mask=y < 0), pa.array(n), pa.array(size)], names=["code", "x", "y", "n", "size"])

    return reads.select(F.col("ordinal").cast("long"), "seq").mapInArrow(run, "code binary, x long, y long, n long, size int")


def both_strands(distinct: DataFrame) -> DataFrame:
    """(id, seq) of all strings that `distinct_strands` has put into rows (code, x, y)."""

    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks:
            texts = restored(b.column(0))
            x, y = (b.column(i).fill_null(-1).to_numpy() for i in (1, 2))
            if (x >= 0).any():
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(x >= 0)) for c in (b.column(1), texts)], names=["id", "seq"])
            for rows, letters in by_length(texts.filter(pa.array(y >= 0))):
                if (letters > 127).any():
                    seqs = pa.array([complement(t.tobytes().decode()) for t in letters], type=pa.string())
                else:
                    seqs = even_column(COMPLEMENT[letters[:, ::-1]], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(y[y >= 0][rows]), seqs], names=["id", "seq"])

    return distinct.select("code", "x", "y").mapInArrow(run, "id long, seq string")


def lengths_and_offsets(reads: DataFrame) -> DataFrame:
    """(ordinal, len, offset): where each read starts in the concatenation of all."""
    return running_total(reads.select("ordinal", F.length("seq").alias("len")), "ordinal", "len", "offset").select("ordinal", "len", "offset")


def length_summary(reads: DataFrame) -> DataFrame:
    size = F.length("seq")
    return reads.agg(F.count("*").alias("n_reads"), F.min(size).alias("min_len"), F.max(size).alias("max_len"), F.coalesce(F.min(size) == F.max(size), F.lit(True)).alias("equal"))


def base_column(reads: DataFrame, position: int) -> DataFrame:
    return reads.select("ordinal", base_at(F.col("seq"), position).alias("base"))


def transpose(reads: DataFrame, block: int = 4096) -> DataFrame:
    """(pos, block, bases): position-major columns, in blocks of `block` consecutive reads, so no row grows with the input.

    Reads are shuffled whole, by block, and a task turns one block over at a time.
    """

    def turn(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def flush() -> Iterator[pa.RecordBatch]:
            columns = ["".join(c) for c in zip_longest(*held, fillvalue="")]
            if columns:
                yield pa.RecordBatch.from_arrays([pa.array(range(len(columns)), type=pa.int32()), pa.array([at] * len(columns), type=pa.int64()), pa.array(columns)], names=["pos", "block", "bases"])

        for b in blocks:
            for own, seq in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if own != at:
                    yield from flush()
                    held, at = [], own
                held.append(seq)
        yield from flush()

    own = reads.select(F.floor(F.col("ordinal") / block).alias("block"), "ordinal", "seq")
    return own.repartition("block").sortWithinPartitions("block", "ordinal").mapInArrow(turn, "pos int, block long, bases string")


def append_columns(columns: DataFrame, reads: DataFrame, block: int = 4096) -> DataFrame:
    """Columns of bases with those of later reads appended; a block that wasn't full is filled up first."""
    both = columns.withColumn("batch", F.lit(0)).unionByName(transpose(reads, block).withColumn("batch", F.lit(1)))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("batch", "bases"))), lambda s: s["bases"]), "")
    return both.groupBy("pos", "block").agg(joined.alias("bases"))  # two parts at most, of `block` bases in all


def group_counts(keyed: DataFrame, key: str = "fp") -> DataFrame:
    return keyed.groupBy(key).agg(F.count("*").alias("n"))


def duplicate_groups(keyed: DataFrame, key: str = "fp") -> DataFrame:
    """Keys of two rows or more, with the id that survives."""
    return keyed.groupBy(key).agg(F.count("*").alias("n"), F.min("id").alias("min_id")).where("n >= 2")


def duplicate_members(keyed: DataFrame, key: str = "fp") -> DataFrame:
    """(key, id, min_id, removed): all rows of keys of two rows or more; a hot key's rows are split by adaptive skew joins."""
    return keyed.select(key, "id").join(duplicate_groups(keyed, key).select(key, "min_id"), key).withColumn("removed", F.col("id") != F.col("min_id"))


def duplicates_removed(keyed: DataFrame, key: str = "fp") -> DataFrame:
    per_key = keyed.groupBy(key).agg(F.count("*").alias("n"))
    return per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_distinct")).withColumn("n_removed", F.col("n_rows") - F.col("n_distinct"))
