"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `vnodes` points of the ring; a key belongs to the first point clockwise from its hash. Shard
capacities add up to exactly the number of rows (the first rows % shards shards by ring hash take one more), and the
keys of an arc that find their shard full continue clockwise to the next point whose shard has room. So counts differ
by one at most, and only overflowing keys leave their home.

Keys of an arc are ordered by (ring position, key, size, checksum). Only the number of keys per (arc, lane) goes to the
driver: vnodes * shards * lanes counts, whatever the number of rows. Rows with a null key stand where their text's checksum
puts them, null texts count as empty; repeated rows are placed one by one; an empty table gives an empty result. The input's other columns are not
carried, so clashing names can't arise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandweave.llm.common import keep, table

SHARDS, VNODES, LANES = 16, 128, 8


def points(shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Ring positions in ascending order and the shard that owns each."""
    at = [(int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big") >> 1, s) for s in range(shards) for v in range(vnodes)]
    at.sort()
    return np.array([p for p, _ in at], dtype=np.int64), np.array([s for _, s in at], dtype=np.int64)


def plan(counts: np.ndarray, owner: np.ndarray, shards: int) -> list[tuple[int, int, int, int, int]]:
    """Intervals (arc, lo, hi, shard, slot): ranks lo <= r < hi of the arc go to the shard, from that slot on.

    Home arcs fill first, clockwise; then each arc's overflow walks on clockwise to shards with room.
    """
    total, arcs = int(counts.sum()), len(owner)
    extra = sorted(range(shards), key=lambda s: hashlib.sha256(f"extra/{s}".encode()).digest())[: total % shards]
    room = [total // shards + (s in extra) for s in range(shards)]
    used, out, over = [0] * shards, [], []
    for a in range(arcs):
        s, n = int(owner[a]), int(counts[a])
        n_home = min(n, room[s] - used[s])
        if n_home:
            out.append((a, 0, n_home, s, used[s]))
            used[s] += n_home
        if n > n_home:
            over.append((a, n_home, n))
    for a, lo, hi in over:
        at = a
        while lo < hi:
            at = (at + 1) % arcs
            s = int(owner[at])
            if n := min(hi - lo, room[s] - used[s]):
                out.append((a, lo, lo + n, s, used[s]))
                used[s] += n
                lo += n
    return out


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, vnodes: int = VNODES, lanes: int = LANES) -> DataFrame:
    """(key, size, text_crc32, shard, slot): the bounded-load ring placement of every row."""
    spark = docs.sparkSession
    where, owner = points(shards, vnodes)
    arcs = len(owner)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), (F.octet_length(body) + F.lit(1)).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    of_text = F.xxhash64("text_crc32", "size", F.lit("no id"))  # so that rows without an id spread over the ring
    rows = rows.withColumn("pos", F.shiftrightunsigned(F.when(F.col("doc_id").isNull(), of_text).otherwise(F.xxhash64(F.col("doc_id").cast("string"))), 1))
    rows = rows.withColumn("lane", F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit("lane")), F.lit(lanes)).cast("int"))

    def add_arc(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks:
            pos = b.column(b.schema.get_field_index("pos")).to_numpy(zero_copy_only=False)
            arc = np.searchsorted(where, pos, side="left") % arcs
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(arc.astype(np.int32))], names=[*b.schema.names, "arc"])

    rows = keep(rows.mapInArrow(add_arc, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, size long, text_crc32 long, pos long, lane int, arc int"))
    counted = np.zeros((arcs, lanes), dtype=np.int64)
    for r in rows.groupBy("arc", "lane").count().collect():  # arcs * lanes rows at most
        counted[r["arc"], r["lane"]] = r["count"]
    before = np.cumsum(counted, axis=1) - counted
    steps = pd.DataFrame(plan(counted.sum(axis=1), owner, shards), columns=["arc", "lo", "hi", "shard", "slot0"])
    cells = []
    for s in steps.itertuples(index=False):
        for lane in range(lanes):
            lo, hi = max(s.lo, before[s.arc, lane]), min(s.hi, before[s.arc, lane] + counted[s.arc, lane])
            if lo < hi:
                cells.append((s.arc, lane, int(lo - before[s.arc, lane]), int(hi - before[s.arc, lane]), s.shard, int(s.slot0 + lo - s.lo)))
    cells = spark.createDataFrame(cells, "c_arc int, c_lane int, lo long, hi long, shard int, slot0 long")
    order = Window.partitionBy("arc", "lane").orderBy("pos", "doc_id", "size", "text_crc32")
    ranked = rows.withColumn("rank", F.row_number().over(order).cast("long") - 1)
    on = (F.col("arc") == F.col("c_arc")) & (F.col("lane") == F.col("c_lane")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    placed = ranked.join(F.broadcast(cells), on)  # bounded by arcs * lanes + overflow steps, not by the rows
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("slot0") + F.col("rank") - F.col("lo")).alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
