"""Reads derived from the text of `documents`, for tables without sequencing data.

Letters become bases by their place in the alphabet (z becomes N, which exercises the quality filter). The reads of a text are
its windows of `length` bases at multiples of `stride`, and a last one that ends where the text ends, so every letter of a text
is in a read; a text of fewer than `length` letters has none. Reads are in order of document and offset, documents in order of id
(null first) and text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from strandweave.functions.blocks import LOW, column_of, even_column, raw_bytes
from strandweave.plans.storage import materialize

LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAN"
LENGTH, STRIDE, MIN_OVERLAP = 48, 16, 32
TIE = 64
ROWS = 1 << 15  # of a block that is handed on
BASE_OF = np.zeros(256, dtype=np.uint8)
for _letter, _base in zip(LETTERS, BASES, strict=True):
    BASE_OF[[ord(_letter), ord(_letter.upper())]] = ord(_base)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in order of their ids, spread over tasks by them, however few splits their file has; those that share one by text.

    Ranges look at the start of a text only, as the driver sees a sample of what they are cut by.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.repartitionByRange("doc_id", F.substring("text", 1, TIE)).sortWithinPartitions("doc_id", "text")


def _window_places(starts: np.ndarray, length: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """For texts whose bases begin at `starts` (one place more than texts): each window's text and its offset there, in order."""
    last = np.diff(starts) - length  # where the window that ends with the text starts
    n = np.where(last < 0, 0, last // stride + 1 + (last % stride != 0))
    text = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return text, np.minimum(nth * stride, last[text])


def _bases(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bases of a column of texts, one after another, and where each text's start."""
    data, at = raw_bytes(column)
    found = BASE_OF[data[at[0] : at[-1]]]
    there = found != 0
    return found[there], np.concatenate([[0], np.cumsum(there)])[at - at[0]]


def raw_reads(spark: SparkSession, sf_dir: str, length: int = LENGTH, stride: int = STRIDE) -> DataFrame:
    """(doc_id, off, seq) before the quality filter, in order within and over partitions."""

    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks:
            bases, starts = _bases(b.column(1))
            text, off = _window_places(starts, length, stride)
            for i in range(0, len(text), ROWS):
                t, o = text[i : i + ROWS], off[i : i + ROWS]
                seq = sliding_window_view(bases, length)[starts[t] + o]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(t)), pa.array(o.astype(np.int32)), even_column(seq, pa.string())], names=["doc_id", "off", "seq"])

    docs = _documents(spark, sf_dir)
    return docs.mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("off", T.IntegerType()), T.StructField("seq", T.StringType())]))


def reads(spark: SparkSession, sf_dir: str, keep_low_quality: bool = False, in_order: bool = False) -> DataFrame:
    """(ordinal, seq) of the windows that pass the filter; `in_order` also within and over partitions.

    Only documents are put in order and stored, as their bases, each with the number of its first read in its task; their windows are
    made from those when they are read.
    """
    length, stride = LENGTH, STRIDE

    def good(bases: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each window's text and its start among all bases."""
        text, off = _window_places(starts, length, stride)
        at = starts[text] + off
        if keep_low_quality or not len(at):
            return text, at
        low = np.concatenate([[0], np.cumsum(LOW[bases])])
        kept = low[at + length] == low[at]
        return text[kept], at[kept]

    def count(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for b in blocks:
            bases, starts = _bases(b.column(1))
            n = np.bincount(good(bases, starts)[0], minlength=b.num_rows)
            before = done + np.cumsum(n) - n
            done += int(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(before), pa.array(n), column_of(bases, starts, pa.string())], names=["before", "n", "bases"])

    def cut(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks:
            bases, starts = raw_bytes(b.column(1))
            bases, starts = bases[starts[0] : starts[-1]], (starts - starts[0]).astype(np.int64)
            text, at = good(bases, starts)
            n = np.bincount(text, minlength=b.num_rows)
            number = b.column(0).to_numpy()[text] + np.arange(len(text)) - (np.cumsum(n) - n)[text]
            for i in range(0, len(text), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(number[i : i + ROWS]), even_column(sliding_window_view(bases, length)[at[i : i + ROWS]], pa.string())], names=["ordinal", "seq"])

    docs = _documents(spark, sf_dir).mapInArrow(count, "before long, n long, bases string").where("n > 0")
    docs = materialize(docs.withColumn("part", F.spark_partition_id()))
    sums = docs.groupBy("part").agg(F.sum("n").alias("n"))
    sums = sums.select("part", "n", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    docs = docs.join(F.broadcast(sums.drop("n")), "part").select((F.col("base") + F.col("before")).alias("first"), "bases")  # a row for each partition
    if in_order:
        docs = docs.repartitionByRange("first").sortWithinPartitions("first")
    out = docs.mapInArrow(cut, "ordinal long, seq string")
    out._strandweave_rows = sums.agg(F.sum("n")).first()[0] or 0  # known without making them
    return out
