"""Distinct reads of a stream: the smallest id of each fingerprint, whatever order and batches the reads arrive in; or the smallest ids of each
string and its reverse complement, which are one packed key (`smallest_strands`).

The state is one row for each key; a smaller id that comes late replaces it, and each batch writes the rows it changed to
a folder of its own, so a batch that is run again after a failure leaves the same rows. A reader takes the smallest id over all
batches. The state store keeps its rows on disk (RocksDB), so memory doesn't grow with the keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = {PROVIDER: ROCKSDB, "spark.sql.streaming.minBatchesToRetain": "2"}  # earlier states of the last batches only


def smallest_ids(keyed: DataFrame) -> DataFrame:
    """(fp, id, seq): of a frame or stream (id, seq, fp), the smallest id of each fingerprint and its string."""
    return keyed.groupBy("fp").agg(F.min("id").alias("id"), F.min_by("seq", "id").alias("seq"))


def smallest_strands(rows: DataFrame) -> DataFrame:
    """(code, x, y): of a frame or stream of these columns of `read_strands`, the smallest ids of each string and its reverse complement."""
    return rows.groupBy("code").agg(F.min("x").alias("x"), F.min("y").alias("y"))


def write_distinct(keyed: DataFrame, target: str, checkpoint: str, smallest: Callable[[DataFrame], DataFrame] = smallest_ids) -> StreamingQuery:
    """Take in what a stream (id, seq, fp), or one that `smallest` takes, has to offer, then stop; started again with the same checkpoint,
    it goes on."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{target}/batch={number}")

    spark = keyed.sparkSession
    before = {k: spark.conf.get(k) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        stream = smallest(keyed).writeStream.outputMode("update").foreachBatch(save)
        return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def read_distinct(spark: SparkSession, target: str) -> DataFrame:
    """(id, seq, fp) of all batches so far."""
    rows = spark.read.schema("fp long, id long, seq string, batch long").parquet(target)
    return smallest_ids(rows).select("id", "seq", "fp")


def read_distinct_strands(spark: SparkSession, target: str) -> DataFrame:
    """(code, x, y) of all batches of `smallest_strands` so far."""
    return smallest_strands(spark.read.schema("code binary, x long, y long, batch long").parquet(target))
