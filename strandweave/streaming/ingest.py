"""Incremental ingestion: files that arrive in a folder become filtered reads, each file once.

A read's ordinal needs a total order over all files, so the stream keeps (file, line) keys; numbering is a batch step over
what has been ingested.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandweave.functions.bases import is_low_quality

#: Bytes of the largest file that the stream takes as one row.
LARGEST_FILE = 256 << 20


def read_stream(spark: SparkSession, folder: str, files_per_batch: int = 16, largest: int = LARGEST_FILE) -> DataFrame:
    """(file, record, seq): whole files as rows, so that records keep their lines together.

    For many files of moderate size: one beyond `largest` bytes, one that doesn't start with @ and one that ends within a
    record fail the batch. Large files belong into the batch reader, which splits them.
    """
    raw = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).load(folder)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"), "value").where("value <> ''")
    fault = F.when(F.col("bytes") > largest, F.lit(": too large for the stream"))
    lines = F.split(F.regexp_replace("value", "\r?\n$", ""), "\r?\n")
    fault = fault.when(~F.col("value").startswith("@"), F.lit(": the first line does not start with @")).when(F.size(lines) % 4 != 0, F.lit(": the last record is incomplete"))
    lines = raw.select("file", F.when(fault.isNotNull(), F.raise_error(F.concat("file", fault)).cast("array<string>")).otherwise(lines).alias("lines"))
    records = lines.select("file", F.posexplode("lines").alias("line_no", "seq")).where("line_no % 4 = 1")
    return records.where(~is_low_quality(F.col("seq"))).select("file", ((F.col("line_no") - 1) / 4).cast("long").alias("record"), "seq")


def ingest_available(spark: SparkSession, folder: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append the reads of all files not yet seen to a Parquet folder, then stop."""
    return read_stream(spark, folder).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
