"""Vector rows for the vector operators: validation, one row for each id, packing to bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: str) -> Column:
    """Whether a vector is there and all its components are numbers."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def one_per_id(rows: DataFrame, key: str, vector: str, label: str | None = None) -> DataFrame:
    """(id, vec), with a label (id, label, vec), of the rows with an id, a label and a valid, non-empty vector: of rows that share
    an id, the first by label, then by vector."""
    own = rows.select(F.col(key).cast("long").alias("id"), *([F.col(label).alias("label")] if label else []), F.col(vector).cast("array<double>").alias("vec"))
    own = own.where(F.col("id").isNotNull() & finite("vec") & (F.size("vec") > 0))
    own = own.where("label IS NOT NULL") if label else own
    return own.groupBy("id").agg(F.min(F.struct(*own.columns[1:])).alias("r")).select("id", *(f"r.{c}" for c in own.columns[1:]))


def packed_vectors(rows: DataFrame, key: str, vector: str, extra: list[str] = ()) -> DataFrame:
    """(id, vec, dim, *extra): vec holds the components as little-endian doubles; null for vectors that are null, empty or
    hold null or non-finite components."""

    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks:
            for at in range(0, block.num_rows, 4096):
                part = block.slice(at, 4096)
                out, dims = [], []
                for v in part.column(part.schema.get_field_index("vec")):
                    x = None if not v.is_valid else v.values.to_numpy(zero_copy_only=False).astype(np.float64) if v.values.null_count == 0 else None
                    good = x is not None and len(x) > 0 and np.isfinite(x).all()
                    out.append(x.tobytes() if good else None)
                    dims.append(len(x) if good else None)
                keep = [part.column(part.schema.get_field_index(c)) for c in ["id", *extra]]
                yield pa.RecordBatch.from_arrays([keep[0], pa.array(out, type=pa.binary()), pa.array(dims, type=pa.int32()), *keep[1:]], names=["id", "vec", "dim", *extra])

    own = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"), *extra)
    kinds = "".join(f", `{c}` {own.schema[c].dataType.simpleString()}" for c in extra)
    return own.mapInArrow(run, f"id long, vec binary, dim int{kinds}")
