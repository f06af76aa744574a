"""MinHash near-duplicate components: one-permutation hashing, optimal densification, banded buckets, star edges.

One hash per shingle serves all `bands * rows` bins; the bin is the hash's leading part and keeps its smallest hash. An
empty bin borrows from a filled one that a fixed random order of bins, drawn for that bin alone, names first; so borrowed
values are as good as independent ones, also for very short texts. Signatures are cut into bands, hashed to buckets.

Documents with equal sets form one class, of which one representative goes on. A bucket of m representatives yields a star
of m - 1 candidate edges around its centre, the member that shares most buckets with most others, which tends to be the
least edited copy. Edges are confirmed on the whole sets, by 64-bit hashes of their shingles.

What stars miss is a link between two members that are in no component together. Members x and y of a bucket with centre c
have |x & y| = |c| - |M(x) | M(y)| + |D(x) & D(y)|, where M are the shingles of c that a member lacks and D those that it has
and c lacks. Both terms are bounded without comparing the texts: the union by its larger part and by the bits set in the union
of two small bitmaps, the intersection by the number of shingles in D that any other member has as well, and by bitmaps. So
edited copies just below the threshold drop out by their own numbers: a member goes on only into classes of partners' sizes
where it could reach the threshold, and pairs are made only of those whose bound does, and then confirmed. Nothing is capped
or sampled, and no pair is left out that could be linked.

With 40 bands of 6 rows a pair at the threshold shares no bucket with probability (1 - 0.8**6)**40 = 6e-6.

A null, empty or blank text has an empty set and links with nothing. Rows that share an id count as one document. Rows
without an id get n_shingles, no component, and are kept. Ties go to the smallest id. An empty table gives an empty
result. Only id and text are read, so extra columns with clashing names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm.common import batches, components, keep, mix64, table
from strandweave.llm.shingles import shingle_set

BANDS, ROWS, PERCENT, WORDS, STEP = 40, 6, 80, 4, 1.05


@lru_cache(maxsize=64)
def _recent(text: str, k: int) -> np.ndarray:
    """Sets of the texts compared last: rows come in the order of one side."""
    return shingle_set(text, k)


def _orders(bins: int) -> np.ndarray:
    """For each bin, the rank of every other bin in the order in which it borrows."""
    grid = np.arange(bins * bins, dtype=np.uint64).reshape(bins, bins)
    return mix64(grid + np.uint64(0xC2B2AE3D27D4EB4F))


_ORDERS: dict[int, np.ndarray] = {}


def signature(values: np.ndarray, bins: int) -> np.ndarray:
    """Densified one-permutation signature of a non-empty sorted set of 64-bit hashes."""
    if bins not in _ORDERS:
        _ORDERS[bins] = _orders(bins)
    at = ((values >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    filled = at[first].astype(np.int64)
    out = np.zeros(bins, dtype=np.uint64)
    out[filled] = values[first]
    empty = np.ones(bins, dtype=bool)
    empty[filled] = False
    if empty.any():
        out[empty] = values[first[np.argmin(_ORDERS[bins][empty][:, filled], axis=1)]]
    return out


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    sig = signature(values, bands * rows).reshape(bands, rows)
    key = np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        key = mix64(key + sig[:, r])
    return key.view(np.int64)


def needed(p: int, a: Column, b: Column) -> Column:
    """How many shingles sets of two sizes must share to reach `p` per cent: p * (a + b) / (100 + p), rounded up."""
    return F.ceil((a + b) * p / F.lit(100 + p) - F.lit(1e-9))


def fingerprints(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell a non-empty set from others."""
    return int(s.sum().view(np.int64)), int(mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum().view(np.int64))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 2, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each input row."""
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def sign(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in batches(blocks, ["doc_id", "text"]):
            out = []
            for d, t in zip(ids, texts, strict=True):
                s = shingle_set(t, k)
                if len(s) and d is not None:
                    out.append((d, len(s), *fingerprints(s), band_keys(s, bands, rows)))
                else:
                    out.append((d, len(s), None, None, None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n_shingles", "fp1", "fp2", "bands"])

    signed = keep(own.mapInArrow(sign, "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>"))
    classes = keep(signed.where("fp1 IS NOT NULL").groupBy("fp1", "fp2", "n_shingles").agg(F.min("doc_id").alias("rep")))
    one = classes.select(F.col("rep").alias("doc_id"), "fp1").distinct()
    entries = signed.join(one, ["doc_id", "fp1"], "left_semi").select(F.col("doc_id").alias("rep"), F.col("fp1").alias("fp"), F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1")
    members = keep(entries.join(shared, "bucket"))
    weights = members.groupBy("rep", "fp").agg(F.sum("c").alias("weight"))
    rank = F.shiftleft(F.least("weight", F.lit((1 << 31) - 1)), 31).bitwiseOR(F.xxhash64("rep", "fp").bitwiseAND(0x7FFFFFFF))
    members = keep(members.join(weights, ["rep", "fp"]).select("bucket", "rep", "fp", "n", rank.alias("rank")).distinct())  # repeated rows once
    nodes = members.select(F.col("rep").alias("doc_id"), "fp").distinct()

    def gather(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in batches(blocks, ["doc_id", "text"]):
            fps = [int(shingle_set(t, k).sum().view(np.int64)) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), pa.array(fps, type=pa.int64()), pa.array(texts, type=pa.string())], names=["doc_id", "fp", "text"])

    texts = own.join(nodes.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(gather, "doc_id long, fp long, text string")
    texts = keep(texts.dropDuplicates(["doc_id", "fp"]))

    def compared(pairs: DataFrame, deal: bool) -> DataFrame:
        """For pairs (a, fa, b, fb): sizes and whether they are linked; with `deal`, also how many of b's shingles a lacks, a
        bitmap of these, and a's shingles that b lacks."""

        def check(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for a, fa, b, fb, x, y in batches(blocks, ["a", "fa", "b", "fb", "x", "y"]):
                out = []
                for i in range(len(a)):
                    u, v = _recent(x[i], k), _recent(y[i], k)
                    at = np.minimum(np.searchsorted(v, u), len(v) - 1)
                    common = v[at] == u
                    both = int(common.sum())
                    row = (a[i], fa[i], len(u), b[i], fb[i], len(v), 100 * both >= percent * (len(u) + len(v) - both), len(v) - both)
                    if deal:
                        lacks = np.ones(len(v), dtype=bool)
                        lacks[at[common]] = False
                        out.append((*row, *_bitmap(v[lacks]), u[~common].view(np.int64)))
                    else:
                        out.append((*row, *[None] * WORDS, None))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), kinds.values(), strict=True)], names=list(kinds))

        long = pa.int64()
        kinds = {"a": long, "fa": long, "na": long, "b": long, "fb": long, "nb": long, "linked": pa.bool_(), "missing": long} | {f"m{w}": long for w in range(WORDS)} | {"added": pa.list_(long)}
        left = texts.select(F.col("doc_id").alias("a"), F.col("fp").alias("fa"), F.col("text").alias("x"))
        right = texts.select(F.col("doc_id").alias("b"), F.col("fp").alias("fb"), F.col("text").alias("y"))
        both = pairs.join(left, ["a", "fa"]).join(right, ["b", "fb"]).select("a", "fa", "b", "fb", "x", "y")
        return both.mapInArrow(check, "a long, fa long, na long, b long, fb long, nb long, linked boolean, missing long, " + ", ".join(f"m{w} long" for w in range(WORDS)) + ", added array<long>")

    def linked(pairs: DataFrame) -> DataFrame:
        return keep(compared(pairs, False).where("linked").select("a", "b"))

    def placed(rows: DataFrame) -> DataFrame:
        """The rows with the component so far of each member."""
        rows = rows.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
        return rows.withColumn("component", F.coalesce("component", "rep"))

    def merge(links: DataFrame) -> DataFrame:
        """The components, joined by further links: what is solved anew is the graph of components only."""
        ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(found, "node", "left_anti")
        side = lambda i: found.select(F.col("node").alias(i), F.col("component").alias(f"c{i}"))
        joined = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).where("ca <> cb")
        up = components(joined, "ca", "cb").select(F.col("node").alias("component"), F.col("component").alias("top"))
        every = found.select("node", "component").union(ends.select("node", F.col("node").alias("component")))
        return keep(every.join(up, "component", "left").select("node", F.coalesce("top", "component").alias("component")))

    close = needed(percent, F.col("na"), F.col("nb")) <= F.least("na", "nb")
    centres = members.groupBy("bucket").agg(F.max("rank").alias("rank"))
    centres = members.join(centres, ["bucket", "rank"]).select("bucket", F.col("rep").alias("b"), F.col("fp").alias("fb"), F.col("n").alias("nb"))
    stars = members.select("bucket", F.col("rep").alias("a"), F.col("fp").alias("fa"), F.col("n").alias("na")).join(centres, "bucket")
    found = keep(components(linked(stars.where(close & ((F.col("a") != F.col("b")) | (F.col("fa") != F.col("fb")))).select("a", "fa", "b", "fb").distinct())))

    # what stars miss: members of buckets that hold several components, by what tells them from their bucket's centre
    rest = placed(members.select("bucket", "rep", "fp", "n"))
    mixed = rest.groupBy("bucket").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 < c2").select("bucket")
    rest = keep(rest.join(mixed, "bucket").join(centres.select("bucket", "b", "fb"), "bucket"))
    if not rest.isEmpty():
        apart = keep(compared(rest.select(F.col("rep").alias("a"), F.col("fp").alias("fa"), "b", "fb").distinct(), True))
        late = linked(_bounded(rest, apart, percent))
        if not late.isEmpty():
            found = merge(late)

    groups = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("fp1", "fp2", F.col("n_shingles").alias("n"), F.coalesce("component", "rep").alias("c"))
    out = signed.select("doc_id", "n_shingles", "fp1", "fp2").join(groups.withColumnsRenamed({"fp1": "g1", "fp2": "g2"}), (F.col("fp1") == F.col("g1")) & (F.col("fp2") == F.col("g2")) & (F.col("n_shingles") == F.col("n")), "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _bitmap(items: np.ndarray) -> list[int]:
    """64 * WORDS bits, one of which each 64-bit hash sets."""
    bits, word = np.uint64(1) << (items & np.uint64(63)), (items >> np.uint64(6)) % np.uint64(WORDS)
    return [int(np.bitwise_or.reduce(bits[word == w], initial=np.uint64(0)).view(np.int64)) for w in range(WORDS)]


def _bounded(rest: DataFrame, apart: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, fa, b, fb) of a bucket's members in different components whose intersection may be large enough."""
    words = range(WORDS)
    every = apart.select("a", "fa", "b", "fb", F.explode("added").alias("g"))
    counts = every.groupBy("b", "fb", "g").agg(F.count("*").alias("c")).where("c > 1")
    bits = lambda w: F.bit_or(F.when(F.pmod(F.shiftright("g", 6), F.lit(WORDS)) == w, F.expr("shiftleft(1L, CAST(g & 63 AS INT))")))
    shared = every.join(counts, ["b", "fb", "g"]).groupBy("a", "fa", "b", "fb").agg(F.count("*").alias("s"), *(bits(w).alias(f"d{w}") for w in words))
    facts = apart.drop("linked", "added").join(shared, ["a", "fa", "b", "fb"], "left").fillna(0, ["s", *(f"d{w}" for w in words)])
    facts = keep(facts.withColumnsRenamed({"a": "rep", "fa": "fp", "na": "n", "nb": "base", "missing": "m"}))
    rows = rest.select("bucket", "rep", "fp", "b", "fb", "component").join(facts, ["rep", "fp", "b", "fb"])

    # the smaller of a pair stands in the class of its size, the larger in all classes of sizes that it can be linked with
    size_class = lambda n: F.floor(F.log(n.cast("double")) / log(STEP)).cast("int")
    n, m, base = F.col("n"), F.col("m"), F.col("base")
    smaller = rows.where(needed(percent, n, n) - base + m <= F.col("s")).withColumn("class", size_class(n))
    larger = rows.withColumn("class", F.explode(F.sequence(size_class(F.greatest(F.ceil(n * percent / 100), F.lit(1))) - 1, size_class(n))))
    least, most = F.floor(F.pow(F.lit(STEP), F.col("class"))) - 1, F.ceil(F.pow(F.lit(STEP), F.col("class") + 1)) + 1
    larger = larger.where(needed(percent, n, F.greatest(least, F.lit(1))) - base + F.greatest(m, base - most) <= F.col("s"))
    x, y = (t.select("bucket", "class", *(F.col(c).alias(f"{c}_{i}") for c in ["rep", "fp", "b", "fb", "n", "base", "m", "s", "component", *(f"m{w}" for w in words), *(f"d{w}" for w in words)])) for t, i in ((smaller, "a"), (larger, "b")))
    joint = lambda kind: sum((F.bit_count(F.col(f"{kind}{w}_a").bitwiseOR(F.col(f"{kind}{w}_b"))) for w in words), F.lit(0))
    union = F.greatest("m_a", "m_b", joint("m").cast("long"))
    common = F.least(F.col("s_a"), F.col("s_b"), F.col("s_a") + F.col("s_b") - joint("d"))
    enough = needed(percent, F.col("n_a"), F.col("n_b")) <= F.least(F.col("n_a"), F.col("base_a") - union + common)
    once = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("rep_a") < F.col("rep_b")))
    pairs = x.join(y, (x.bucket == y.bucket) & (x["class"] == y["class"]) & (F.col("b_a") == F.col("b_b")) & (F.col("fb_a") == F.col("fb_b")) & once & (F.col("component_a") != F.col("component_b")) & enough)
    return pairs.select(F.col("rep_a").alias("a"), F.col("fp_a").alias("fa"), F.col("rep_b").alias("b"), F.col("fp_b").alias("fb")).distinct()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
                      ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
  FROM w
), e AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), f AS (
  SELECT g, count(*) AS f FROM e GROUP BY g
), ranked AS (
  SELECT e.doc_id, e.n, e.g, row_number() OVER (PARTITION BY e.doc_id ORDER BY f.f, e.g) AS r FROM e JOIN f USING (g)
), p AS (
  SELECT doc_id, n, g FROM ranked WHERE r <= n - CAST(ceil(0.8 * n) AS BIGINT) + 1
), c AS (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
), j AS (
  SELECT c.a, c.b FROM c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b
  WHERE 100 * len(list_intersect(x.s, y.s)) >= 80 * (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)))
), d AS (
  SELECT a AS u, b AS v FROM j UNION ALL SELECT b, a FROM j
), reach AS (
  WITH RECURSIVE r(u, v) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.u, d.v FROM r JOIN d ON r.v = d.u)
  SELECT u, min(v) AS component_id FROM r GROUP BY u
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id, s.doc_id = r.component_id AS kept
FROM s JOIN reach r ON r.u = s.doc_id
"""
