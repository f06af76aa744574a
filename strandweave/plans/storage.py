"""Materialised intermediate results, and dense numbering, on any number of executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_folders: dict[str, str] = {}
_made: list[list[str]] = []  # what `settled` calls under way have seen written


def use_folder(spark: SparkSession, folder: str) -> None:
    """Where this application keeps intermediate results if spark.checkpoint.dir is unset: a folder that all executors see."""
    _folders[spark.sparkContext.applicationId] = folder.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """The folder for this application's intermediate results, below spark.checkpoint.dir.

    Where that is unset it is what `use_folder` was told, or, with a local master only, a temporary folder that goes when
    the driver ends. On a cluster a machine's own folder would hold but a part of the rows, so there it is an error.
    """
    context = spark.sparkContext
    own = f"strandweave-{context.applicationId}"
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return f"{base.rstrip('/')}/{own}"
    if context.applicationId not in _folders:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="strandweave-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        use_folder(spark, f"file://{folder}")
    return f"{_folders[context.applicationId]}/{own}"


@contextmanager
def shuffles_end_with_their_query(spark: SparkSession) -> Iterator[None]:
    """Within this, Spark deletes a query's shuffle files as soon as it has ended, not when the driver collects garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame) -> DataFrame:
    """Write to the scratch folder and read back.

    Cuts the lineage; unlike a cached or locally checkpointed frame the result outlives executors.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    for made in _made:
        made.append(path)
    with shuffles_end_with_their_query(spark):
        df.write.option("compression", "zstd").parquet(path)  # reads in order share most of their letters with the one before
    out = spark.read.schema(df.schema).parquet(path)
    out._strandweave_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def delete_files(spark: SparkSession, pattern: str) -> None:
    """Delete the files that a pattern with wildcards names, in any store that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in store.globStatus(at) or []:
        store.delete(found.getPath(), False)


def discard(df: DataFrame) -> None:
    """Delete what `materialize` wrote for this frame, when nothing reads it any more."""
    _delete(df.sparkSession, df._strandweave_path)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What `make` returns, materialised; whatever was materialised on the way to it is deleted."""
    _made.append([])
    try:
        out = materialize(make())
    finally:
        made = _made.pop()
    for path in made:
        if path != out._strandweave_path:
            _delete(spark, path)
    return out


def cleanup(spark: SparkSession) -> None:
    """Delete all intermediate results of this application; frames that read them end with it."""
    _delete(spark, scratch(spark))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Number rows 0, 1, 2, ... in the order of partitions, and of rows within them; for frames with a stable order.

    Each partition's base is the running sum over the counts of the earlier ones, a frame with a row for each partition.
    """
    local = materialize(df.withColumn("_at", F.monotonically_increasing_id()))
    local = local.withColumn("_part", F.shiftrightunsigned("_at", 33)).withColumn("_nth", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = local.groupBy("_part").agg(F.count("*").alias("_n"))
    bases = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return local.join(F.broadcast(bases), "_part").withColumn(name, F.col("_base") + F.col("_nth")).drop("_at", "_part", "_nth", "_base")  # a row for each partition


def dense_index(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """Number rows 0, 1, 2, ... in the given order without putting them all into one task.

    Range partitioning samples the frame first, which runs its plan once more; so hand over one that is cheap or materialised.
    """
    return numbered(df.repartitionByRange(*order).sortWithinPartitions(*order), name)


def running_total(df: DataFrame, order: str, value: str, name: str, block: int = 1 << 16) -> DataFrame:
    """Exclusive running sum by a dense integer order: within blocks of rows, and over the blocks' sums."""
    own = df.withColumn("_block", (F.col(order) / block).cast("long"))
    sums = own.groupBy("_block").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return own.join(sums, "_block").withColumn(name, F.col("_base") + F.coalesce(F.sum(value).over(inner), F.lit(0))).drop("_block", "_base")


def running_max(df: DataFrame, order: str, value: str, name: str, block: int = 1 << 16) -> DataFrame:
    """Inclusive running maximum by a dense integer order, in the same two steps; it fills a range from a mark at its start."""
    own = df.withColumn("_block", (F.col(order) / block).cast("long"))
    tops = own.groupBy("_block").agg(F.max(value).alias("_top"))
    tops = tops.select("_block", F.max("_top").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    inner = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return own.join(tops, "_block").withColumn(name, F.greatest(F.col("_before"), F.max(value).over(inner))).drop("_block", "_before")
