"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

Targets: weight shares of the total size, clamped at `epochs` times the source's size; what a clamp frees goes to the
others in proportion to their weights, until no source is above its clamp. The fixed point is found in closed form: with
sources in ascending order of clamp / weight, a source is clamped if its clamp / weight is at most the water level that
remains for it and all later ones.

Sampling: each document is taken floor(target / source size) times. The rest of the target is shared by the source's size
classes (documents of as many binary digits) in proportion to their sizes, and filled in each class by its documents in a
seeded order (MD5 of seed and id, of rows without an id their text's MD5), up to the document at which the sum comes nearest. The smallest class that has room for
what all others leave then takes that, so that a source ends within half a document of that class of its target; where no
class has room, the classes' own roundings, half a document each at most, add up. The running sums go over
hash buckets of each class, so that a source with a third of all rows is spread over many tasks. Reruns agree, as the
order depends on nothing but the row.

A null source is a source of its own, ordered last; a null or blank text has size 0 and is never sampled beyond its
whole repetitions, which count nothing; rows with a null id are spread by their texts; repeated rows are taken one by one; an
empty table gives an empty result. The input's other columns are not carried, so clashing names can't arise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandweave.llm.common import WORD, keep, table

WEIGHTS, EPOCHS, SEED = (5, 2, 1), 3, "mix-1"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size) -> (source, source_size, target). One row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("clamp", F.col("source_size") * epochs)
    fill = Window.orderBy(F.col("clamp") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(every)).withColumn("weights", F.sum("weight").over(every))
    clamp_before = F.sum("clamp").over(fill) - F.col("clamp")
    weight_from = F.col("weights") - F.sum("weight").over(fill) + F.col("weight")
    s = s.withColumn("level", (F.col("total") - clamp_before) / weight_from)
    s = s.withColumn("open_level", F.when(F.col("clamp") > F.col("level") * F.col("weight"), F.col("level")))
    level = F.min(F.struct(F.col("open_level").isNull(), F.col("clamp") / F.col("weight"), F.col("open_level").alias("x"))).over(every)["x"]
    s = s.withColumn("final_level", level)
    raw = F.when(F.col("open_level").isNull() | F.col("final_level").isNull(), F.col("clamp").cast("double")).otherwise(F.col("final_level") * F.col("weight"))
    return s.select("source", "source_size", F.least(F.col("clamp").cast("double"), raw).alias("target"))


def dice(key: str, text: str, seed: str) -> Column:
    """What orders rows at random: a digest of the id, of rows without one of the text."""
    name = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))))
    return F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary"))


def sample(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies): how often the mix takes each row."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), dice(key, text, seed).alias("dice"))
    rows = keep(rows.withColumn("class", F.length(F.bin("size")))).withColumn("bucket", F.substring("dice", 1, 2))

    part = rows.groupBy("source", "class", "bucket").agg(F.sum("size").alias("part_size"))
    before = Window.partitionBy("source", "class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select(F.col("source").alias("s_"), F.col("class").alias("c_"), F.col("bucket").alias("b_"), F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("before"))
    inner = Window.partitionBy("source", "class", "bucket").orderBy("dice", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.withColumn("run", F.sum("size").over(inner))
    ranked = ranked.join(part, ranked.source.eqNullSafe(part.s_) & (ranked["class"] == part.c_) & (ranked.bucket == part.b_))
    ranked = keep(ranked.select("doc_id", "source", "class", "size", (F.col("before") + F.col("run") - F.col("size") / F.lit(2.0)).alias("middle")))

    sizes = ranked.groupBy("source", "class").agg(F.sum("size").alias("class_size"))
    goal = targets(sizes.groupBy("source").agg(F.sum("class_size").alias("source_size")), weights, epochs)
    goal = goal.withColumn("whole", F.floor(F.col("target") / F.greatest("source_size", F.lit(1))))
    goal = goal.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    goal = goal.withColumnRenamed("source", "g_")
    share = sizes.join(goal, sizes.source.eqNullSafe(goal.g_)).drop("g_")
    share = share.withColumn("class_rest", F.col("rest") * F.col("class_size") / F.greatest("source_size", F.lit(1)))
    share = keep(share.withColumnRenamed("source", "s_").withColumnRenamed("class", "c_"))  # a row for each source and class

    same = ranked.source.eqNullSafe(F.col("s_")) & (ranked["class"] == F.col("c_"))
    first = ranked.join(share, same).where("middle <= class_rest").groupBy("s_", "c_").agg(F.sum("size").alias("taken"))
    first = first.withColumnRenamed("s_", "t_").withColumnRenamed("c_", "u_")
    share = share.join(first, share.s_.eqNullSafe(first.t_) & (share.c_ == first.u_), "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    source_rows = Window.partitionBy("s_")
    share = share.withColumn("left_over", F.col("rest") - (F.sum("taken").over(source_rows) - F.col("taken")))
    fits = F.when((F.col("left_over") >= 0) & (F.col("left_over") <= F.col("class_size")) & (F.col("class_size") > 0), F.col("c_"))
    share = share.withColumn("class_rest", F.when(F.col("c_") == F.min(fits).over(source_rows), F.col("left_over")).otherwise(F.col("class_rest")))
    share = share.select("s_", "c_", "source_size", "target", "whole", "class_rest")
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("whole") + F.when(F.col("middle") <= F.col("class_rest"), 1).otherwise(0))
    return ranked.join(share, same).select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = sample(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
WITH docs AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(coalesce(text, '')))) AS dice
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
         3 * source_size AS clamp, CAST(sum(source_size) OVER () AS BIGINT) AS total
  FROM s
), l AS (
  SELECT *, (total - (sum(clamp) OVER f - clamp)) / (sum(weight) OVER () - sum(weight) OVER f + weight) AS level
  FROM w WINDOW f AS (ORDER BY clamp / weight, source ASC NULLS LAST)
), o AS (
  SELECT *, CASE WHEN clamp > level * weight THEN level END AS open_level FROM l
), g AS (
  SELECT source, source_size,
         least(CAST(clamp AS DOUBLE), CASE WHEN open_level IS NULL OR x IS NULL THEN CAST(clamp AS DOUBLE) ELSE x * weight END) AS target
  FROM (SELECT *, first_value(open_level) OVER (ORDER BY open_level IS NULL, clamp / weight ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS x FROM o)
), k AS (
  SELECT *, length(bin(size)) AS class,
         sum(size) OVER (PARTITION BY source, length(bin(size)) ORDER BY dice, doc_id, size ROWS UNBOUNDED PRECEDING) - size / 2.0 AS middle
  FROM docs
), c AS (
  SELECT k.source, k.class, CAST(sum(size) AS BIGINT) AS class_size, any_value(source_size) AS source_size, any_value(target) AS target,
         any_value(floor(target / greatest(source_size, 1))) AS whole,
         any_value(target - floor(target / greatest(source_size, 1)) * source_size) AS rest
  FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source GROUP BY k.source, k.class
), q AS (
  SELECT c.*, c.rest * c.class_size / greatest(c.source_size, 1) AS class_rest FROM c
), t AS (
  SELECT q.source, q.class, any_value(q.class_size) AS class_size, any_value(q.source_size) AS source_size, any_value(q.target) AS target,
         any_value(q.whole) AS whole, any_value(q.rest) AS rest, any_value(q.class_rest) AS class_rest,
         CAST(sum(CASE WHEN k.middle <= q.class_rest THEN k.size ELSE 0 END) AS BIGINT) AS taken
  FROM k JOIN q ON k.source IS NOT DISTINCT FROM q.source AND k.class = q.class GROUP BY q.source, q.class
), u AS (
  SELECT *, rest - (sum(taken) OVER (PARTITION BY source) - taken) AS left_over FROM t
), v AS (
  SELECT *, min(CASE WHEN left_over >= 0 AND left_over <= class_size AND class_size > 0 THEN class END) OVER (PARTITION BY source) AS pick FROM u
)
SELECT k.doc_id, k.size, v.source_size, v.target,
       CAST(CASE WHEN k.size = 0 THEN 0 ELSE k.size * (v.whole + CASE WHEN k.middle <= CASE WHEN v.class = v.pick THEN v.left_over ELSE v.class_rest END THEN 1 ELSE 0 END) END AS BIGINT) AS taken
FROM k JOIN v ON k.source IS NOT DISTINCT FROM v.source AND k.class = v.class
"""
