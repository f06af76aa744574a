"""Running values within segments, of which one may span any number of tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandweave.plans.storage import dense_index, materialize

BLOCK = 1 << 16

#: Folds of a scan: the aggregate of many values, and that of two, either of which may be null.
FOLDS = {
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
}


def placed(df: DataFrame, segment: list[str], order: list[str], name: str = "place") -> DataFrame:
    """The rows with their dense place in the order of segment and order, over all segments; materialised."""
    return materialize(dense_index(df, [*segment, *order], name))


def segmented_scan(rows: DataFrame, segment: list[str], scans: dict[str, tuple[str, str]], place: str = "place", block: int = BLOCK) -> DataFrame:
    """Inclusive scans within segments: `scans` names new columns and gives each a fold (of FOLDS) and the column it folds.

    The rows have a dense integer place. Two steps: within blocks of `block` consecutive rows, and over the folds of each
    segment's blocks, whose scan up to the block before is carried in. So a task holds a block, or a row for each block of one
    segment, however large the segment. Null values count for nothing, null segments are segments.
    """
    own = rows.withColumn("_block", F.floor(F.col(place) / block))
    fold = {name: FOLDS[kind] for name, (kind, _) in scans.items()}
    parts = own.groupBy(*segment, "_block").agg(*(fold[n][0](c).alias(f"_of_{n}") for n, (_, c) in scans.items()))
    before = Window.partitionBy(*segment).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(*(F.col(c).alias(f"_{c}") for c in segment), F.col("_block").alias("_at"), *(fold[n][0](f"_of_{n}").over(before).alias(f"_carried_{n}") for n in scans))
    same = F.col("_block") == F.col("_at")
    for c in segment:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    inner = Window.partitionBy("_block", *segment).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    joined = own.join(carried, same)
    found = {n: fold[n][1](F.col(f"_carried_{n}"), fold[n][0](c).over(inner)) for n, (_, c) in scans.items()}
    return joined.select(*rows.columns, *(c.alias(n) for n, c in found.items()))
