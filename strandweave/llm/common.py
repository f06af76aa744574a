"""Helpers that several operators share: tables, the shared folder, hashing, components."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.plans.storage import discard, materialize, scratch

#: Words are maximal runs of bytes other than space and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark (so any store that Spark reaches will do)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder for intermediate results that all executors see."""
    return f"{scratch(spark)}/{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts the lineage, lets its shuffle files go and survives lost executors."""
    return materialize(df)


def batches(blocks, columns: list[str], rows: int = 512):
    """Lists of column values from Arrow batches, at most `rows` at a time."""
    for block in blocks:
        for at in range(0, block.num_rows, rows):
            part = block.slice(at, rows)
            yield [part.column(block.schema.get_field_index(c)).to_pylist() for c in columns]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (xor-shift and multiply, wraps)."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def components(links: DataFrame, left: str = "a", right: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): the smallest id reachable, for every node that has a link.

    Alternates large-star and small-star steps until the edge set is a set of stars. Each step is a grouped minimum
    (partial aggregation first) and a join of single-row groups to their members, which adaptive execution can split
    when one centre is hot. No neighbour list is ever gathered. Raises if `rounds` steps don't get there.
    """
    ids = lambda u, v: links.select(F.col(u).alias("u"), F.col(v).alias("v"))
    edges = keep(ids(left, right).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(rounds):
        before = _mark(edges)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(low, both.u == low.k).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(low, large.u == low.k).select(F.explode(F.array(F.struct(F.col("v").alias("x"), "m"), F.struct(F.col("u").alias("x"), "m"))).alias("e"))
        last, edges = edges, keep(small.select(F.col("e.x").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct())
        discard(last)
        if _mark(edges) == before:
            break
    else:
        raise RuntimeError(f"components are not final after {rounds} rounds")
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.union(edges.select(F.col("v"), F.col("v"))).groupBy("node").agg(F.min("component").alias("component"))


def _mark(edges: DataFrame) -> tuple:
    """Count and checksum of distinct edges; exclusive or can't overflow, however many there are."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
