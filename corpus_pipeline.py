"""A corpus pipeline of five stages over `documents`; each stage's rows are written as Parquet and read again by the next.

language_id     documents without a language, or between two, go; a missing lang is filled in. Without any labelled row to
                learn from, only texts without letters go, and a missing lang stays so
near_dedup      of documents with similar sets of five-word shingles, the smallest id stays, also among rows of one id
suffix_dedup    passages of 50 bytes and more that an earlier document has are cut out; what is left empty goes
mixing          documents are repeated or left out so that the sources meet their target weights
packing         tokens are cut and packed into sequences

Rows of `near_dedup` are told apart by a 64-bit hash of id and text; two that collide, of 10^10 rows perhaps three, count as one
document. Rows without an id are kept by the filters like others, but share no links, and those alike in all columns are mixed alike.
An empty table gives an empty result. Columns besides those of `documents` are not carried.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandweave.llm import langid, minhash, mixing, packing, suffix
from strandweave.llm.common import table
from strandweave.plans.shipping import ship
from strandweave.plans.storage import discard, settled

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _shipped(stage: Stage) -> Stage:
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


@_shipped
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(COLUMNS)
    model = langid.fit(docs)
    if not model.langs:  # every text would be without a language
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = langid.predict(docs, model)
    good = found.where((F.col("lang_pred") != "und") & ~F.col("ambiguous"))
    return good.withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


@_shipped
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = docs.where("doc_id IS NOT NULL").select(*COLUMNS, F.xxhash64("doc_id", "text").alias("row"))
    found = minhash.near_duplicates(own.select("row", "text"), key="row", k=5).select(F.col("doc_id").alias("row"), "component_id").distinct()
    least = F.min(F.struct("doc_id", "row"))["row"].alias("row")
    stay = found.join(own.select("row", "doc_id").distinct(), "row").groupBy("component_id").agg(least).select("row")
    first = Window.partitionBy("row", "doc_id").orderBy(F.xxhash64("lang", "source"))  # of rows alike in id and text, one
    kept = own.join(stay, "row", "left_semi").withColumn("nth", F.row_number().over(first)).where("nth = 1")
    return kept.select(COLUMNS).union(docs.where("doc_id IS NULL").select(COLUMNS))


@_shipped
def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffix.dedup(docs.select(COLUMNS), as_text=True).where("kept <> ''")
    return cut.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("kept").cast("long")).select(COLUMNS)


@_shipped
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row = F.concat_ws(" ", F.xxhash64(*COLUMNS).cast("string"), F.xxhash64(F.lit("second"), *COLUMNS).cast("string"))  # 128 bits
    docs = docs.select(COLUMNS).withColumn("row", row)
    copies = mixing.sample(docs, key="row").groupBy(F.col("doc_id").alias("row")).agg(F.max("copies").alias("copies"))
    taken = docs.join(copies.where("copies > 0"), "row")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(COLUMNS)


@_shipped
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("mixing", mix), ("packing", pack)]

#: Models, hashing and tokenizers are beyond SQL; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = settled(spark, partial(stage, spark, docs, sf_dir))  # what the stage wrote on its way goes
        if before is not None:
            discard(before)
        before = docs
    return docs
