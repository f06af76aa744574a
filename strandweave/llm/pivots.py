"""Hard negatives: rows of another label whose score lies in a window below that of a positive, found through a pivot table.

Vectors become integers, floor(scale * x); a score is an inner product. With one more component, sqrt(M^2 - |y|^2) for rows and 0
for anchors, M being the largest length of all, |q - y|^2 = |q|^2 + M^2 - 2 q.y is the square of a distance. The distances of
every row to some pivots (a bounded sample of `PIVOTS` rows of each vector length) are stored with it, so the triangle inequality
brackets any anchor's distance to the row, and with it the score: it is at least |d(q, p) - d(y, p)| and at most d(q, p) + d(y, p)
for every pivot p. Only rows whose bracket meets a window that the anchor still looks in have their score worked out.

Rows are stored in blocks of about `block_rows` by nearest pivot, each with ids, labels, vectors and the table of distances. An
anchor looks first in the block that it stands in itself. The k-th best score found there narrows its windows, and it goes on
to the blocks of those pivots only whose ranges of distances, over all their rows, let the bracket meet a window. This is done
twice: for the best rows of the anchor's own label, its positives, and for rows of other labels in the windows that these open.
A task holds one block and a bounded number of anchors. Where pivots rule nothing out, as for random vectors of many
components, all rows are checked against all anchors, block by block.

Rows take no part if label, id or vector is null, or the vector is empty or holds null or non-finite components. An id stands
for one row: of rows that share it, the first by label, then by vector, takes part. Vectors of other length than the anchor's
are no candidates. Ties go to the smaller id. A positive of a negative score has no window. Integers are exact; components
beyond 2**31 raise. An empty table gives an empty result. Only id, vector and label are read, so clashing names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandweave.llm.common import keep, table
from strandweave.llm.mtree import apart, lifted
from strandweave.llm.vectors import one_per_id

POSITIVES, NEGATIVES, LOW, HIGH, SCALE, EVERY = 5, 3, 50, 95, 256, 50
PIVOTS, BLOCK_ROWS, QUERY_ROWS, CHUNK = 16, 8192, 2048, 64
LOWEST, HIGHEST = -(1 << 62), 1 << 62

Sphere = tuple[float, np.ndarray]  # the square of the largest length, and the lifted pivots


def reach(base: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances at which scores from low to high lie, nearest and farthest, with room for rounding."""
    room = 1e-7 * (1 + np.sqrt(base))
    span = lambda score: np.sqrt(np.maximum(base - 2.0 * score, 0))
    return np.where(high >= HIGHEST, 0.0, span(high) - room), np.where(low <= LOWEST, np.inf, span(low) + room)


def bracketed(to_pivots: np.ndarray, near: np.ndarray, far: np.ndarray, table_: np.ndarray) -> np.ndarray:
    """For anchors with distances to pivots, and each row of a table of such: whether its bracket meets [near, far]."""
    ok = np.ones((len(to_pivots), len(table_)), dtype=bool)
    for p in range(table_.shape[1]):
        d, own = table_[:, p][None], to_pivots[:, p]
        ok &= (d <= (own + far)[:, None]) & (d >= np.maximum(own - far, near - own)[:, None])
    return ok


def scores_of(queries: np.ndarray, rows: np.ndarray, top: float) -> np.ndarray:
    """Inner products, exact: by doubles as long as all sums are below 2**53."""
    if max(top, float((queries.astype(np.float64) ** 2).sum(axis=1).max(initial=0))) < 1 << 52:
        return np.rint(queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return queries @ rows.T


def packed(rows: DataFrame, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """(id, label, dim, vec, length): integers of the rows that take part, one for each id, as binary int64."""

    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks:
            ids, labels, vectors = (b.column(b.schema.get_field_index(c)) for c in ("id", "label", "vec"))
            out = [np.floor(np.asarray(v.values, dtype=np.float64) * scale) for v in vectors]
            if any(np.abs(x).max() >= 1 << 31 for x in out):
                raise OverflowError("components beyond 2**31: vectors are too long for exact scores")
            columns = [ids, labels, pa.array([len(x) for x in out], type=pa.int32()), pa.array([x.astype(np.int64).tobytes() for x in out], type=pa.binary()), pa.array([float(x @ x) for x in out], type=pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "dim", "vec", "length"])

    first = one_per_id(rows, key, vector, label).select("id", F.col("label").cast("string").alias("label"), "vec")
    return first.mapInArrow(run, "id long, label string, dim int, vec binary, length double")


class PivotTable:
    """All rows in blocks with their pivot distances, and the ranges of these for each pivot's rows."""

    def __init__(self, rows: DataFrame, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS):
        """rows: as `packed` gives them, materialised."""
        self.context, self.query_rows = rows.sparkSession.sparkContext, query_rows
        spheres: dict[int, Sphere] = {}
        for r in rows.groupBy("dim").agg(F.max("length").alias("top")).collect():  # a row for each vector length
            some = rows.where(F.col("dim") == r["dim"]).orderBy(F.xxhash64("id", F.lit("pivot")), "id").limit(pivots).select("vec").collect()
            spheres[r["dim"]] = r["top"], lifted(np.array([np.frombuffer(v["vec"], dtype=np.int64) for v in some]), r["top"])
        self.spheres = sent = self.context.broadcast(spheres)  # PIVOTS vectors of each length at most

        def measure(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in blocks:
                dims, vecs = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("dim", "vec"))
                to, home = [None] * b.num_rows, np.zeros(b.num_rows, dtype=np.int32)
                for d in set(dims):
                    top, points = sent.value[d]
                    at = np.flatnonzero(np.array(dims) == d)
                    found = apart(lifted(np.array([np.frombuffer(vecs[i], dtype=np.int64) for i in at]), top), points)
                    home[at] = found.argmin(axis=1)
                    for i, f in zip(at.tolist(), found, strict=True):
                        to[i] = f.tobytes()
                columns = [*(b.column(b.schema.get_field_index(c)) for c in ("id", "label", "dim", "vec")), pa.array(to, type=pa.binary()), pa.array(home)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "dim", "vec", "to", "home"])

        placed = keep(rows.mapInArrow(measure, "id long, label string, dim int, vec binary, to binary, home int"))
        self.parts = keep(placed.groupBy("dim", "home").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts")))
        self.rows = placed.join(self.parts, ["dim", "home"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("id")
            to = np.array([np.frombuffer(t) for t in pdf["to"]])
            one = {"dim": pdf["dim"].iloc[0], "home": pdf["home"].iloc[0], "part": pdf["part"].iloc[0], "ids": pdf["id"].to_numpy().tobytes(), "labels": pdf["label"].tolist(), "vecs": b"".join(pdf["vec"]), "table": to.tobytes(), "least": to.min(axis=0).tolist(), "most": to.max(axis=0).tolist()}
            return pd.DataFrame({k: [v] for k, v in one.items()})

        kinds = "dim int, home int, part int, ids binary, labels array<string>, vecs binary, table binary, least array<double>, most array<double>"
        self.blocks = keep(self.rows.groupBy("dim", "home", "part").applyInPandas(build, kinds))
        sides = self.blocks.select("dim", "home", F.posexplode(F.arrays_zip("least", "most")).alias("p", "r")).groupBy("dim", "home", "p")
        ranges: dict[tuple[int, int], dict[int, tuple[float, float]]] = {}
        for r in sides.agg(F.min("r.least").alias("least"), F.max("r.most").alias("most")).collect():  # PIVOTS^2 rows of each length at most
            ranges.setdefault((r["dim"], r["home"]), {})[r["p"]] = r["least"], r["most"]
        self.ranges = self.context.broadcast({k: np.array([v[p] for p in sorted(v)]) for k, v in ranges.items()})

    def _in_blocks(self, asked: DataFrame, k: int, same: bool) -> DataFrame:
        """(anchor, w, id, score): the k best rows of one block in each window; asked has the block and `windows` (w, low, high)."""
        sent, on = self.spheres, ["dim", "home", "part"]

        def look(block: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
            found: list[tuple[int, int, int, int]] = []
            if len(block) and len(anchors):
                b, dim = block.iloc[0], int(block["dim"].iloc[0])
                top, points = sent.value[dim]
                ids, labels = np.frombuffer(b["ids"], dtype=np.int64), np.array(b["labels"], dtype=object)
                rows, to = np.frombuffer(b["vecs"], dtype=np.int64).reshape(len(ids), dim), np.frombuffer(b["table"]).reshape(len(ids), -1)
                for lo in range(0, len(anchors), CHUNK):
                    some = anchors.iloc[lo : lo + CHUNK]
                    q = np.array([np.frombuffer(v, dtype=np.int64) for v in some["vec"]])
                    windows = [[(w["w"], w["low"], w["high"]) for w in ws] for ws in some["windows"]]
                    base = (q.astype(np.float64) ** 2).sum(axis=1) + top
                    low, high = np.array([min(w[1] for w in ws) for ws in windows]), np.array([max(w[2] for w in ws) for ws in windows])
                    near, far = reach(base, low, high)
                    ok = bracketed(apart(np.hstack([q.astype(np.float64), np.zeros((len(q), 1))]), points), near, far, to)
                    ok &= (labels[None] == some["label"].to_numpy()[:, None]) == same
                    ok &= ids[None] != some["id"].to_numpy()[:, None]
                    live = np.flatnonzero(ok.any(axis=0))
                    score = scores_of(q, rows[live], top)
                    ok = ok[:, live] & (score >= low[:, None]) & (score <= high[:, None])
                    for i, anchor in enumerate(some["id"].tolist()):
                        at = np.flatnonzero(ok[i])
                        at = at[np.argsort(-score[i, at], kind="stable")]  # a block's rows are in order of their ids
                        falling = -score[i, at]
                        for w, least, most in windows[i]:
                            first, end = np.searchsorted(falling, -most), np.searchsorted(falling, -least, side="right")
                            found += [(anchor, w, int(ids[live[j]]), int(score[i, j])) for j in at[first : min(end, first + k)]]
            return pd.DataFrame(found, columns=["anchor", "w", "id", "score"]).astype({"anchor": "int64", "w": "int32", "id": "int64", "score": "int64"})

        chunks = asked.groupBy(*on).agg(F.ceil(F.count("*") / self.query_rows).cast("int").alias("chunks"))
        dealt = asked.join(chunks, on).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).select(*on, "chunk", "id", "label", "vec", "windows")
        needed = self.blocks.drop("least", "most").join(chunks, on).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
        return keep(needed.groupBy(*on, "chunk").cogroup(dealt.groupBy(*on, "chunk")).applyInPandas(look, "anchor long, w int, id long, score long"))

    def best(self, anchors: DataFrame, windows: DataFrame, k: int, same: bool) -> DataFrame:
        """(anchor, w, id, score, rank): for each anchor's window (anchor, w, low, high), the k best rows of its own label (`same`)
        or of others, its own left out. anchors: rows of this table."""
        spheres, ranges = self.spheres, self.ranges

        def needs(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Pivots whose rows' ranges of distances let a bracket meet an anchor's windows."""
            for b in blocks:
                get = lambda c: b.column(b.schema.get_field_index(c)).to_pylist()  # noqa: B023, E731
                out = []
                for d, v, ws in zip(get("dim"), get("vec"), get("windows"), strict=True):
                    top, points = spheres.value[d]
                    q = np.append(np.frombuffer(v, dtype=np.int64).astype(np.float64), 0.0)
                    near, far = reach(np.array([float(q @ q) + top]), np.array([min(w["low"] for w in ws)]), np.array([max(w["high"] for w in ws)]))
                    own = apart(q[None], points)[0]
                    meets = lambda r: (r[:, 0] <= own + far).all() and (r[:, 1] >= np.maximum(own - far, near - own)).all()  # noqa: B023, E731
                    out.append([h for (dim, h), r in ranges.value.items() if dim == d and meets(r)])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, type=pa.list_(pa.int32()))], names=[*b.schema.names, "homes"])

        def with_windows(ws: DataFrame) -> DataFrame:
            lists = ws.groupBy(F.col("anchor").alias("id")).agg(F.sort_array(F.collect_list(F.struct("w", "low", "high"))).alias("windows"))  # a few of each anchor
            return anchors.select("id", "label", "dim", "vec", "home", "part").join(lists, "id")

        own = self._in_blocks(with_windows(windows), k, same)
        floors = own.groupBy("anchor", "w").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k).select("anchor", "w", "floor")
        narrowed = windows.join(floors, ["anchor", "w"], "left").select("anchor", "w", F.greatest("low", "floor").alias("low"), "high")
        rest = with_windows(narrowed).withColumnsRenamed({"home": "own_home", "part": "own_part"})
        kind = "array<struct<w:int,low:bigint,high:bigint>>"
        rest = rest.mapInArrow(needs, f"id long, label string, dim int, vec binary, own_home int, own_part int, windows {kind}, homes array<int>")
        rest = rest.withColumn("home", F.explode("homes")).join(self.parts, ["dim", "home"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        rest = rest.where((F.col("home") != F.col("own_home")) | (F.col("part") != F.col("own_part"))).select("id", "label", "dim", "vec", "home", "part", "windows")
        order = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "id")
        return own.union(self._in_blocks(rest, k, same)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", is_anchor: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its `positives` best
    rows of its label, the `negatives` best rows of other labels that score `low` to `high` per cent of the positive.

    `is_anchor`, over a column `id`, picks the anchors; every fiftieth id by default.
    """
    table_ = PivotTable(keep(packed(rows, key, vector, label, scale)), pivots, block_rows, query_rows)
    anchors = keep(table_.rows.where(F.col("id") % EVERY == 0 if is_anchor is None else is_anchor))
    whole = anchors.select(F.col("id").alias("anchor"), F.lit(0).alias("w"), F.lit(LOWEST).cast("long").alias("low"), F.lit(HIGHEST).cast("long").alias("high"))
    near = keep(table_.best(anchors, whole, positives, True).select("anchor", F.col("rank").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    bounds = near.where("positive_score >= 0").select("anchor", "w", F.expr(f"(positive_score * {low} + 99) DIV 100").alias("low"), F.expr(f"(positive_score * {high}) DIV 100").alias("high"))
    found = table_.best(anchors, keep(bounds.where("low <= high")), negatives, False)
    out = found.join(near, ["anchor", "w"])
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return mine(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


SQL = """
WITH v AS (
  SELECT vec_id, l, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS y FROM (
    SELECT *, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l,
      row_number() OVER (PARTITION BY vec_id ORDER BY CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END, embedding) AS nth
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  ) WHERE nth = 1
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.l = b.l AS same, CAST(list_inner_product(a.y, b.y) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.y) = len(b.y)
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
  s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""
