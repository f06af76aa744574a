"""The bases of all reads by position: a stored table with a folder for each position, read a column at a time and appended to.

A row holds one position of `block` consecutive reads, two bits a base, four bases a byte, the first in the high bits. Reads are
shuffled whole, by block; a task turns one block over at a time. An append writes the blocks from the last one on that wasn't full;
blocks that are full are never written again. It goes into a folder of its own, by the number of the append, with the reads that
the table holds after it beside it; what isn't there yet isn't seen, so an append that was cut off can be repeated. The last block
of an earlier append counts only if no later one starts with it.

Bases are A, C, T, G in any case and come back in capitals; reads have one length and dense ordinals.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions.bases import unpack
from strandweave.plans.storage import materialize

BLOCK, BLOCKS_PER_FILE = 4096, 4096


def turned(reads: DataFrame, block: int = BLOCK) -> DataFrame:
    """(pos, block, first, n, packed): a row for each position and block of reads (ordinal, seq); `first` is the first read's place
    within its block. Only ordinals and bases are shuffled, once."""

    def turn(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                bases = np.array([s for _, s in held], dtype=bytes).view(np.uint8).reshape(len(held), -1).T
                codes = np.zeros((len(bases), -(-len(held) // 4) * 4), dtype=np.uint8)
                codes[:, : len(held)] = bases >> 1 & 3
                packed = codes[:, ::4] << 6 | codes[:, 1::4] << 4 | codes[:, 2::4] << 2 | codes[:, 3::4]
                n = len(packed)
                columns = [pa.array(np.arange(n, dtype=np.int32)), pa.array([at] * n, type=pa.int64()), pa.array([held[0][0] % block] * n, type=pa.int32()), pa.array([len(held)] * n, type=pa.int32()), pa.array([row.tobytes() for row in packed], type=pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["pos", "block", "first", "n", "packed"])

        for b in blocks:
            for ordinal, seq in zip(b.column(b.schema.get_field_index("ordinal")).to_pylist(), b.column(b.schema.get_field_index("seq")).to_pylist(), strict=True):
                if ordinal // block != at:
                    yield from flush()
                    held, at = [], ordinal // block
                held.append((ordinal, seq.encode()))
        yield from flush()

    own = reads.select(F.floor(F.col("ordinal") / block).alias("block"), F.col("ordinal").cast("long"), "seq")
    dealt = own.repartition("block").sortWithinPartitions("block", "ordinal")
    return dealt.mapInArrow(turn, "pos int, block long, first int, n int, packed binary")


class BaseMatrix:
    """The table in a folder, with `block` reads a row."""

    def __init__(self, spark: SparkSession, folder: str, block: int = BLOCK):
        self.spark, self.folder, self.block = spark, folder.rstrip("/"), block

    def appends(self) -> list[tuple[int, int, int]]:
        """(number, reads before, reads after) of the appends so far, a row each."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/appends/*/_SUCCESS")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path):
            return []
        rows = self.spark.read.schema("before long, after long, append int").parquet(f"{self.folder}/appends")
        return sorted((r["append"], r["before"], r["after"]) for r in rows.collect())

    def append(self, reads: DataFrame) -> int:
        """Add reads whose ordinals go on from those of the table; the number of reads after it."""
        done = self.appends()
        nth, before = len(done), done[-1][2] if done else 0
        low, high, n = reads.agg(F.min("ordinal"), F.max("ordinal"), F.count("*")).first()
        if n == 0:
            return before
        if (low, high) != (before, before + n - 1):
            raise ValueError(f"the table holds {before} reads: {n} reads with ordinals {low} to {high} don't go on from it")
        if before % self.block:  # the last block is written anew, with what it had
            last = self.rows().where(F.col("block") == before // self.block)
            reads = reads.select("ordinal", "seq").union(self._reads_of(last))
        rows = turned(reads, self.block).withColumn("file", F.floor(F.col("block") / BLOCKS_PER_FILE))
        rows = rows.repartition("pos", "file").sortWithinPartitions("pos", "block").drop("file")
        rows.write.partitionBy("pos").mode("overwrite").parquet(f"{self.folder}/columns/append={nth}")
        mark = self.spark.range(1).select(F.lit(before).cast("long").alias("before"), F.lit(before + n).cast("long").alias("after"))
        mark.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/appends/append={nth}")
        return before + n

    def rows(self) -> DataFrame:
        """(pos, block, n, packed) of all positions; a filter on `pos` reads that position's files only."""
        done = self.appends()
        schema = "block long, first int, n int, packed binary, append int, pos int"
        if not done:
            return self.spark.createDataFrame([], schema).select("pos", "block", "n", "packed")
        every = self.spark.read.schema(schema).option("basePath", f"{self.folder}/columns").parquet(*(f"{self.folder}/columns/append={nth}" for nth, *_ in done))
        renewed = [(nth, later[1] // self.block) for (nth, *_), later in zip(done, done[1:], strict=False) if later[1] % self.block]
        if renewed:  # a row for each append: what the next one wrote anew
            over = reduce(lambda a, b: a | b, ((F.col("append") == nth) & (F.col("block") == at) for nth, at in renewed))
            every = every.where(~over)
        return every.select("pos", "block", "n", "packed")

    def _bases(self, rows: DataFrame) -> DataFrame:
        """(pos, block, bases) as text."""
        return rows.select("pos", "block", unpack(F.hex("packed"), F.col("n")).alias("bases"))

    def columns(self) -> DataFrame:
        """(pos, block, bases) of all positions."""
        return self._bases(self.rows())

    def column(self, position: int) -> DataFrame:
        """(ordinal, base): one base of every read, from that position's files alone."""
        rows = self._bases(self.rows().where(F.col("pos") == position))
        cells = rows.select("block", F.posexplode(F.split("bases", "")).alias("nth", "base")).where("base <> ''")
        return cells.select((F.col("block") * self.block + F.col("nth")).alias("ordinal"), "base")

    def _reads_of(self, rows: DataFrame) -> DataFrame:
        """(ordinal, seq) of some blocks' reads."""
        cells = self._bases(rows).select("pos", "block", F.posexplode(F.split("bases", "")).alias("nth", "base")).where("base <> ''")
        whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "base"))), lambda c: c["base"]), "")  # a read's bases
        return materialize(cells.groupBy("block", "nth").agg(whole.alias("seq"))).select((F.col("block") * self.block + F.col("nth")).alias("ordinal"), "seq")


