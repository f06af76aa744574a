"""Exact top-k by inner product: best-first search in M-trees.

Vectors become integers, floor(scale * x). Largest inner product is nearest neighbour once every vector y gets one more
component sqrt(M^2 - |y|^2), M the largest length of all: then |q - y|^2 = |q|^2 + M^2 - 2 q.y, a metric. An M-tree's inner
page holds routing vectors with covering radii and distances to the page's own router, a leaf page vectors with theirs.

The top of the tree is a table of at most `ROUTERS` routers, vectors of a sample. Every vector goes to its nearest one; what a
router holds is dealt to trees of about `tree_rows`, each built once and stored. A query first searches one tree of its
nearest router. The k-th best score found there bounds the rest: the query goes on to those routers only whose ball it can't
rule out, and starts there with that bound. A task searches one tree for a block of queries: pages are taken in order of the
least distance that their ball allows, each for the queries that still need it; routers and vectors are left out whose stored
parent distance proves, by the triangle inequality, that they can't matter. Scores are exact integers.

Vectors of other dimension than the query's are no candidates. Vectors that are null, empty or hold null or non-finite
components, and rows with a null id, take no part. An id stands for one vector, as query and as candidate: of rows that share it,
the one whose vector comes first takes part. Ties go to the smaller id. An empty table gives an empty result. Only id and vector
are read, so clashing names don't matter.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandweave.llm.common import keep, table
from strandweave.llm.vectors import one_per_id, packed_vectors

K, SCALE, EVERY, TREE_ROWS, QUERY_ROWS, LEAF, FANOUT, ROUTERS = 5, 256, 50, 8192, 2048, 128, 16, 1024
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


@dataclass
class Page:
    """Entries of one page: rows of the tree (a leaf) or child pages; `to_router` are the stored parent distances."""

    rows: np.ndarray | None
    children: list[Page] = field(default_factory=list)
    routers: np.ndarray | None = None
    radii: np.ndarray | None = None
    to_router: np.ndarray | None = None


def lifted(vectors: np.ndarray, top: float) -> np.ndarray:
    """Vectors with the component that brings them all to the length sqrt(top)."""
    x = vectors.astype(np.float64)
    return np.hstack([x, np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0))[:, None]])


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between the rows of two matrices."""
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T, 0))


class MTree:
    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT, seed: int = 5, top: float | None = None, router: np.ndarray | None = None):
        """vectors: integers as int64 rows; `top` is the largest squared length, of more vectors than these where trees share it."""
        self.ids, self.exact, self.leaf, self.fanout, self.seen = ids, vectors, leaf, fanout, 0
        x = vectors.astype(np.float64)
        self.top = top if top is not None else float((x * x).sum(axis=1).max()) if len(x) else 0.0
        self.points = lifted(vectors, self.top)
        self.float_exact = self.top < 2**50
        self.router = router if router is not None else self.points.mean(axis=0) if len(x) else None
        self.radius = float(apart(self.points, self.router[None]).max()) if len(x) else 0.0
        self.root = self._build(np.arange(len(x)), self.router, np.random.default_rng(seed)) if len(x) else None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "points"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state | {"points": lifted(state["exact"], state["top"])}

    def _build(self, rows: np.ndarray, router: np.ndarray, rng: np.random.Generator) -> Page:
        near = lambda r, p: np.sqrt(((self.points[r] - p) ** 2).sum(axis=1))
        if len(rows) <= self.leaf:
            return Page(rows, to_router=near(rows, router))
        p = self.points[rng.choice(rows, size=self.fanout, replace=False)]
        side = apart(self.points[rows], p).argmin(axis=1)
        groups = [(p[j], rows[side == j]) for j in range(self.fanout) if (side == j).any()]
        if len(groups) == 1:  # copies of one vector
            groups = [(p[0], part) for part in np.array_split(rows, self.fanout)]
        page = Page(None, [self._build(g, r, rng) for r, g in groups], np.array([r for r, _ in groups]))
        page.radii = np.array([near(g, r).max() for r, g in groups])
        page.to_router = np.sqrt(((page.routers - router) ** 2).sum(axis=1))
        return page

    def search(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """The k best (score, id), ties to smaller ids, without rows of the id `own`."""
        scores, ids = self.search_many(query[None], np.array([own]), k)
        return [(s, i) for s, i in zip(scores[0].tolist(), ids[0].tolist(), strict=True) if s > LOWEST]

    def search_many(self, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids (LOWEST where there are fewer than k) of a block of queries; below `floor` none is looked for."""
        m = len(queries)
        scores, ids = np.full((m, k), LOWEST), np.full((m, k), HIGHEST)
        if self.root is None:
            return scores, ids
        floor = np.full(m, LOWEST) if floor is None else floor
        q = np.hstack([queries.astype(np.float64), np.zeros((m, 1))])
        base = (q * q).sum(axis=1) + self.top
        slack = 1e-7 * (1 + np.sqrt(base))
        distance = lambda who, s: np.where(s > LOWEST, np.sqrt(np.maximum(base[who] - 2.0 * s, 0)), np.inf) + slack[who]
        far, in_floats = distance(np.arange(m), floor), self.float_exact and float(base.max()) < 2**51
        queue, n = [(0.0, 0, self.root, np.arange(m), apart(q, self.router[None])[:, 0], np.zeros(m))], 1
        while queue:
            _, _, page, who, d, low = heapq.heappop(queue)
            live = low <= far[who]
            if not live.any():
                continue
            who, d = who[live], d[live]
            bound, reach = np.abs(d[:, None] - page.to_router[None]), far[who][:, None]
            if page.rows is None:
                some = np.flatnonzero((bound - page.radii[None] <= reach).any(axis=0))
                ds = apart(q[who], page.routers[some])
                self.seen += ds.size
                lows = np.maximum(np.maximum(ds, bound[:, some]) - page.radii[None, some], 0)
                for c, at in enumerate(some.tolist()):
                    if (sel := lows[:, c] <= far[who]).any():
                        heapq.heappush(queue, (float(lows[sel, c].min()), n, page.children[at], who[sel], ds[sel, c], lows[sel, c]))
                        n += 1
                continue
            some = (bound <= reach).any(axis=0)
            rows = page.rows[some]
            self.seen += len(who) * len(rows)
            if in_floats:
                found = np.rint(q[who, :-1] @ self.points[rows, :-1].T).astype(np.int64)
            else:
                found = queries[who] @ self.exact[rows].T
            found[self.ids[rows][None] == own[who][:, None]] = LOWEST
            least = np.maximum(scores[who, -1], floor[who])
            found[found < least[:, None]] = LOWEST
            better = (found > LOWEST).any(axis=1)
            if better.any():
                who, found = who[better], found[better]
                s = np.hstack([scores[who], found])
                i = np.hstack([ids[who], np.broadcast_to(self.ids[rows], found.shape)])
                order = np.lexsort((i, -np.maximum(s, LOWEST + 1)), axis=-1)[:, :k]
                scores[who], ids[who] = np.take_along_axis(s, order, axis=1), np.take_along_axis(i, order, axis=1)
                far[who] = distance(who, np.maximum(scores[who, -1], floor[who]))
        return scores, ids


def integers(raw: bytes, scale: int) -> np.ndarray:
    return np.floor(scale * np.frombuffer(raw)).astype(np.int64)


def top_k(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = SCALE, every: int = EVERY, tree_rows: int = TREE_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by `every`, against all rows."""
    spark = rows.sparkSession

    def measure(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks:
            vecs = [integers(v, scale) for v in b.column(b.schema.get_field_index("vec")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in ("id", "dim")), pa.array([v.tobytes() for v in vecs], type=pa.binary()), pa.array([float((v.astype(np.float64) ** 2).sum()) for v in vecs], type=pa.float64())], names=["id", "dim", "vec", "length"])

    valid = keep(packed_vectors(one_per_id(rows, key, vector), "id", "vec").mapInArrow(measure, "id long, dim int, vec binary, length double"))
    tops, routers = {}, {}
    for r in valid.groupBy("dim").agg(F.count("*").alias("n"), F.max("length").alias("top")).collect():  # a row for each dimension
        some = valid.where(F.col("dim") == r["dim"]).orderBy(F.xxhash64("id", F.lit("router")), "id").limit(min(ROUTERS, -(-r["n"] // tree_rows))).select("vec").collect()
        tops[r["dim"]] = r["top"]
        routers[r["dim"]] = lifted(np.array([np.frombuffer(v["vec"], dtype=np.int64) for v in some]), r["top"])
    shared = spark.sparkContext.broadcast((tops, routers))  # ROUTERS vectors of each dimension at most

    def nearest(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops, routers = shared.value
        for b in blocks:
            dims, vecs = b.column(b.schema.get_field_index("dim")).to_pylist(), b.column(b.schema.get_field_index("vec")).to_pylist()
            out = np.zeros(b.num_rows, dtype=np.int32)
            for d in set(dims):
                at = np.flatnonzero(np.array(dims) == d)
                for lo in range(0, len(at), 1024):
                    x = np.array([np.frombuffer(vecs[i], dtype=np.int64) for i in at[lo : lo + 1024]])
                    out[at[lo : lo + 1024]] = apart(lifted(x, tops[d]), routers[d]).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*b.schema.names, "router"])

    placed = keep(valid.mapInArrow(nearest, "id long, dim int, vec binary, length double, router int"))
    parts = placed.groupBy("dim", "router").agg(F.ceil(F.count("*") / tree_rows).cast("int").alias("parts"))
    placed = placed.join(parts, ["dim", "router"]).withColumn("part", F.pmod(F.xxhash64("id", "vec"), F.col("parts")).cast("int"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tops, routers = shared.value
        d, r, p = (int(pdf[c].iloc[0]) for c in ("dim", "router", "part"))
        tree = MTree(np.array([np.frombuffer(v, dtype=np.int64) for v in pdf["vec"]]), pdf["id"].to_numpy(), top=tops[d], router=routers[d][r])
        return pd.DataFrame({"dim": [d], "router": [r], "part": [p], "radius": [tree.radius], "tree": [pickle.dumps(tree)]})

    trees = keep(placed.groupBy("dim", "router", "part").applyInPandas(build, "dim int, router int, part int, radius double, tree binary"))
    balls = {(r["dim"], r["router"]): r["radius"] for r in trees.groupBy("dim", "router").agg(F.max("radius").alias("radius")).collect()}  # a row for each router

    def search(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(asked):
            tree = pickle.loads(own["tree"].iloc[0])
            queries = np.array([np.frombuffer(v, dtype=np.int64) for v in asked["vec"]])
            scores, ids = tree.search_many(queries, asked["id"].to_numpy(), k, asked["floor"].to_numpy())
            at, nth = np.nonzero(scores > LOWEST)
            out = {"query_id": asked["id"].to_numpy()[at], "vec_id": ids[at, nth], "score": scores[at, nth]}
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    def searched(queries: DataFrame) -> DataFrame:
        """(query_id, vec_id, score): queries (id, vec, floor) in the trees (dim, router, part), in blocks of about query_rows."""
        on = ["dim", "router", "part"]
        queries = queries.select(*on, "id", "vec", F.coalesce("floor", F.lit(int(LOWEST))).alias("floor"))
        blocks = queries.groupBy(*on).agg(F.ceil(F.count("*") / query_rows).cast("int").alias("blocks"))
        asked = queries.join(blocks, on).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
        needed = trees.join(blocks, on).select(*on, "tree", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        return keep(needed.groupBy(*on, "block").cogroup(asked.groupBy(*on, "block")).applyInPandas(search, "query_id long, vec_id long, score long"))

    def reach(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Routers whose ball may hold something as good as the query's k-th best so far."""
        tops, routers = shared.value
        for b in blocks:
            get = lambda c: b.column(b.schema.get_field_index(c)).to_pylist()  # noqa: B023, E731
            out = []
            for d, v, f in zip(get("dim"), get("vec"), get("floor"), strict=True):
                q = np.append(np.frombuffer(v, dtype=np.int64).astype(np.float64), 0.0)
                base = float(q @ q) + tops[d]
                far = np.inf if f is None else np.sqrt(max(base - 2.0 * f, 0.0)) + 1e-7 * (1 + np.sqrt(base))
                radii = np.array([balls.get((d, r), -np.inf) for r in range(len(routers[d]))])
                out.append(np.flatnonzero(apart(q[None], routers[d])[0] - radii <= far).tolist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, type=pa.list_(pa.int32()))], names=[*b.schema.names, "routers"])

    asked = placed.where(F.col("id") % every == 0)
    first = searched(asked.withColumn("floor", F.lit(None).cast("long")))
    floors = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k).select(F.col("query_id").alias("id"), "floor")
    rest = asked.select("id", "dim", "vec", F.col("router").alias("home"), F.col("part").alias("home_part")).join(floors, "id", "left")
    rest = rest.mapInArrow(reach, "id long, dim int, vec binary, home int, home_part int, floor long, routers array<int>")
    rest = rest.select("id", "dim", "vec", "home", "home_part", "floor", F.explode("routers").alias("router")).join(parts, ["dim", "router"])
    rest = rest.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where((F.col("router") != F.col("home")) | (F.col("part") != F.col("home_part")))
    found = first.union(searched(rest))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS y FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY embedding) = 1
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.y AS DOUBLE[]), CAST(c.y AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.y) = len(c.y)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
