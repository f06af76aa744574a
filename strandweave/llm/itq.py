"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, reranking by the vectors themselves.

A bounded sample of unit vectors (`sample_rows`, picked by a hash of the id) gives a mean, principal directions and a
rotation that brings the projections close to the corners of a cube (alternating signs and an orthogonal Procrustes step);
signs of the rotated projections are the code, all bits being about balanced. The mean is left out where it is long: it then
points into a crowd, whose codes would be noise without it.

Tables hold the codes by some of their bits; two vectors meet if they agree in all bits of any table. A table takes as many
bits as leave about `cell` vectors of a label in a cell (log2 of their number less log2 of `cell`), so the work per vector
grows far less than the input. Vectors at the threshold differ in each bit with probability arccos(threshold) / pi, so as
many tables are used as miss a pair with probability `miss` at most; they are cut from the code in one order of its bits
after another. Only ids and codes are dealt to cells. Pairs that meet there are filtered by the Hamming distance of the whole
codes, then reranked by the cosine of the original vectors, in double precision, and count in the first table in which they
meet.

Equal vectors of one label form a class with one representative. The members of a table cell are compared by blocks of at
most `block` rows, every pair of blocks being a task's unit of its own, so that no cell is too large for a task. Where more
than `DENSE` pairs a row pass the filter, as in a crowd of close vectors, the unit's vectors are sent to it, and what leaves
it are sums of link counts and edges that connect what is linked in it, not pairs.

Rows with a null label, and vectors that are null, empty, zero or hold null or non-finite components, link with nothing, as
do vectors of different length. Rows that share an id count as one vector for components, each row as one for counts. An
empty table gives an empty result. Only id, vector and label are read, so clashing names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import acos, comb, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm.common import batches, components, keep, table
from strandweave.llm.vectors import packed_vectors

THRESHOLD, BITS, SAMPLE_ROWS, BLOCK, ROUNDS, CELL, MISS, LONG_MEAN = 0.93, 64, 10_000, 2048, 30, 64, 0.003, 0.2
#: Table bits at least and at most.
LEAST_BITS, MOST_BITS = 4, 16
#: Rows compared at once, pairs reranked at once, and pairs per row from which a unit's vectors are compared where they meet.
CHUNK, PAIRS, DENSE = 256, 1 << 16, 8


def learn(x: np.ndarray, bits: int = BITS, rounds: int = ROUNDS, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dim x bits) of unit vectors, by principal directions and iterative quantisation."""
    dim, rng = x.shape[1], np.random.default_rng(seed)
    bits = min(bits, dim)
    mean = x.mean(axis=0)
    if np.linalg.norm(mean) > LONG_MEAN:
        mean = np.zeros(dim)
    y = x - mean
    _, vectors = np.linalg.eigh(y.T @ y + 1e-9 * np.eye(dim))
    main = vectors[:, ::-1][:, :bits]
    y = y @ main
    turn = np.linalg.qr(rng.standard_normal((bits, bits)))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(y @ turn >= 0, 1.0, -1.0).T @ y)
        turn = (u @ v).T
    return mean, main @ turn


def codes(unit: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> np.ndarray:
    signs = (unit - mean) @ turn >= 0
    return signs.astype(np.uint64) @ (np.uint64(1) << np.arange(signs.shape[1], dtype=np.uint64))


def distances(bits: int, threshold: float) -> np.ndarray:
    """Probability of each Hamming distance of two codes right at the threshold."""
    apart = acos(threshold) / pi
    return np.array([comb(bits, d) * apart**d * (1 - apart) ** (bits - d) for d in range(bits + 1)])


@lru_cache(maxsize=64)
def radius(bits: int, threshold: float = THRESHOLD, miss: float = MISS) -> int:
    """Hamming distance up to which codes are compared: a tenth of `miss` lies beyond it."""
    beyond = 1 - np.cumsum(distances(bits, threshold))
    return int(np.flatnonzero(beyond <= miss / 10)[0])


@lru_cache(maxsize=64)
def masks(bits: int, per_table: int, threshold: float = THRESHOLD, miss: float = MISS, seed: int = 4) -> np.ndarray:
    """The bits of each table, as masks of a code of `bits` bits.

    Codes of a pair at the threshold differ in d bits with binomial probability; as many tables as leave a pair in none of
    them with probability `miss`, over all d.
    """
    chance, per_table = distances(bits, threshold), min(per_table, bits)
    missed = np.array([1 - comb(bits - d, per_table) / comb(bits, per_table) for d in range(bits + 1)])
    n = next(n for n in range(1, 1 << 20) if chance @ missed**n <= miss + chance[missed == 1].sum())
    rng, out = np.random.default_rng(seed), []
    while len(out) < n:
        order = rng.permutation(bits)
        out += [sum(1 << int(i) for i in order[at : at + per_table]) for at in range(0, bits - per_table + 1, per_table)]
    return np.array(out[:n], dtype=np.uint64).view(np.int64)


def joined(lab: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (places of equals, the smallest of a group) after joining the groups of a[i] and b[i]."""
    while True:
        low, new = np.minimum(lab[a], lab[b]), lab.copy()
        np.minimum.at(new, lab[a], low)
        np.minimum.at(new, lab[b], low)
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def near_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, bits: int = BITS, sample_rows: int = SAMPLE_ROWS, block: int = BLOCK, cell: int = CELL, miss: float = MISS) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each input row."""
    spark = rows.sparkSession
    own = rows.select(F.col(key).alias("key"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    every = keep(packed_vectors(own, "key", "vector", ["label"]))
    valid = every.where("vec IS NOT NULL AND label IS NOT NULL AND id IS NOT NULL")
    classes = keep(valid.groupBy("label", "dim", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).withColumn("vh", F.xxhash64("label", "vec")))  # an id may have several vectors
    n = classes.count()
    dice = F.pmod(F.xxhash64("rep", F.lit("itq")), F.lit(1 << 30))
    sample = classes.where(dice < int(min(1.0, sample_rows / max(n, 1)) * (1 << 30))).select("dim", "vec").collect()  # about sample_rows vectors
    by_dim: dict[int, list[np.ndarray]] = {}
    for r in sample:
        x = np.frombuffer(r["vec"])
        if (size := np.linalg.norm(x)) > 0:
            by_dim.setdefault(r["dim"], []).append(x / size)
    models = spark.sparkContext.broadcast({d: learn(np.array(v), bits) for d, v in by_dim.items()})

    wide = F.greatest(F.lit(LEAST_BITS), F.least(F.lit(MOST_BITS), F.ceil(F.log2(F.count("*") / F.lit(cell))).cast("int")))
    groups = classes.groupBy("label", "dim").agg(wide.alias("per_table"))

    def encode(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks:
            get = lambda c: b.column(b.schema.get_field_index(c))  # noqa: B023, E731
            dims, wides = get("dim").to_numpy(), get("per_table").to_numpy()
            out, keys = [None] * b.num_rows, [None] * b.num_rows
            for d, w in sorted(set(zip(dims.tolist(), wides.tolist(), strict=True))):
                at = np.flatnonzero((dims == d) & (wides == w))
                x = np.frombuffer(b"".join(get("vec").take(pa.array(at)).to_pylist())).reshape(len(at), d)
                size = np.linalg.norm(x, axis=1)
                mean, turn = models.value.get(d) or (np.zeros(d), np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))[0][:, :bits])
                code = codes(x / np.where(size > 0, size, 1)[:, None], mean, turn).view(np.int64)
                cut = code[:, None] & masks(min(bits, d), w, threshold, miss)[None]
                for i, c, k, s in zip(at.tolist(), code.tolist(), cut, size, strict=True):
                    if s > 0:
                        out[i], keys[i] = c, k
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, type=pa.int64()), pa.array(keys, type=pa.list_(pa.int64()))], names=[*b.schema.names, "code", "keys"])

    kind = every.schema["label"].dataType.simpleString()
    coded = classes.join(groups, ["label", "dim"]).select("label", "dim", "vec", "rep", "copies", "vh", "per_table")
    coded = keep(coded.mapInArrow(encode, f"label {kind}, dim int, vec binary, rep long, copies long, vh long, per_table int, code long, keys array<long>").where("code IS NOT NULL"))
    cells = coded.select("label", "dim", "rep", "vh", F.posexplode("keys").alias("table", "key"))
    cells = cells.select("rep", "vh", "table", F.xxhash64("label", "dim", "table", "key").alias("cell"))
    sizes = cells.groupBy("cell").count().where("count > 1").select("cell", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    cells = cells.join(sizes, "cell").withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("cell", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "table", "rep", "vh")
    cells = cells.join(coded.select("rep", "vh", "dim", "code", "per_table"), ["rep", "vh"])
    cells = keep(cells.select("cell", "i", "j", "mine", "table", "rep", "vh", "code", "dim", "per_table"))

    def pairs_of(code: np.ndarray, mine: np.ndarray, first: tuple) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of pairs within the radius that meet here first, some rows at a time."""
        i, j, nth, dim, wide = first[1], first[2], first[4], first[8], first[9]
        for lo in range(0, len(code), CHUNK):
            apart = code[lo : lo + CHUNK, None] ^ code[None]
            a, b = np.nonzero(np.bitwise_count(apart.view(np.uint64)) <= radius(min(bits, dim), threshold, miss))
            some = (a + lo < b) & ((mine[a + lo] != mine[b]) if i != j else True)
            a, b = a[some], b[some]
            for mask in masks(min(bits, dim), wide, threshold, miss)[:nth]:
                some = apart[a, b] & mask != 0
                a, b = a[some], b[some]
            yield a + lo, b

    def meet(unit: list[tuple]) -> list[tuple]:
        """A unit's pairs, or that there are too many of them."""
        code, mine, out = np.array([r[7] for r in unit]), np.array([r[3] for r in unit]), []
        for a, b in pairs_of(code, mine, unit[0]):
            if len(out) + len(a) > DENSE * len(unit) + 64:
                return [(*unit[0][:3], None, None, None, None)]
            out += [(None, None, None, unit[x][5], unit[x][6], unit[y][5], unit[y][6]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        return out

    def compare(unit: list[tuple]) -> list[tuple]:
        x = np.frombuffer(b"".join(r[11] for r in unit)).reshape(len(unit), unit[0][8])
        x = x / np.linalg.norm(x, axis=1)[:, None]
        mine, rep, vh, code, copies = (np.array([r[c] for r in unit]) for c in (3, 5, 6, 7, 10))
        lab, counts = np.arange(len(unit)), np.zeros(len(unit), dtype=np.int64)
        for a, b in pairs_of(code, mine, unit[0]):
            hit = np.concatenate([np.einsum("ij,ij->i", x[a[k : k + PAIRS]], x[b[k : k + PAIRS]]) >= threshold for k in range(0, len(a), PAIRS)] or [np.zeros(0, dtype=bool)])
            a, b = a[hit], b[hit]
            counts += np.bincount(a, weights=copies[b], minlength=len(unit)).astype(np.int64) + np.bincount(b, weights=copies[a], minlength=len(unit)).astype(np.int64)
            lab = joined(lab, a, b)
        at, other = np.flatnonzero(counts).tolist(), np.flatnonzero(lab != np.arange(len(unit))).tolist()
        return [(int(rep[k]), int(vh[k]), int(counts[k]), None) for k in at] + [(int(rep[k]), int(vh[k]), 0, int(rep[lab[k]])) for k in other]

    def rerank(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Link counts and edges of pairs by their vectors."""
        for a, va, b, vb, x, y, m, n in batches(blocks, ["a", "va", "b", "vb", "x", "y", "m", "n"]):
            out = []
            for k in range(len(a)):
                u, v = np.frombuffer(x[k]), np.frombuffer(y[k])
                if (u / np.linalg.norm(u)) @ (v / np.linalg.norm(v)) >= threshold:
                    out += [(a[k], va[k], n[k], b[k]), (b[k], vb[k], m[k], a[k])]
            if out:
                yield batch(out, links)

    def over_units(solve, kinds: dict[str, pa.DataType]):
        def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unit, at = [], None
            for b in blocks:
                out = []
                for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if r[:3] != at:
                        out += solve(unit) if len(unit) > 1 else []
                        unit, at = [], r[:3]
                    unit.append(r)
                if out:
                    yield batch(out, kinds)
            if len(unit) > 1 and (out := solve(unit)):
                yield batch(out, kinds)

        return run

    def batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

    long, int_ = pa.int64(), pa.int32()
    met_kinds = {"cell": long, "i": int_, "j": int_, "a": long, "va": long, "b": long, "vb": long}
    links = {"rep": long, "vh": long, "links": long, "peer": long}
    dealt = lambda df: df.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "rep", "vh")
    met = keep(dealt(cells).mapInArrow(over_units(meet, met_kinds), "cell long, i int, j int, a long, va long, b long, vb long"))
    vectors = coded.select("rep", "vh", "copies", "vec")
    left, right = (vectors.select(F.col("rep").alias(x), F.col("vh").alias(f"v{x}"), F.col("copies").alias(c), F.col("vec").alias(v)) for x, c, v in (("a", "m", "x"), ("b", "n", "y")))
    pairs = met.where("cell IS NULL").select("a", "va", "b", "vb").join(left, ["a", "va"]).join(right, ["b", "vb"])
    single = pairs.mapInArrow(rerank, "rep long, vh long, links long, peer long")
    crowded = cells.join(met.where("cell IS NOT NULL").select("cell", "i", "j"), ["cell", "i", "j"]).join(vectors, ["rep", "vh"])
    crowded = crowded.select("cell", "i", "j", "mine", "table", "rep", "vh", "code", "dim", "per_table", "copies", "vec")
    found = keep(single.union(dealt(crowded).mapInArrow(over_units(compare, links), "rep long, vh long, links long, peer long")))
    counts = found.groupBy("rep", "vh").agg(F.sum("links").alias("links"))
    joint = components(found.where("peer IS NOT NULL").select(F.col("rep").alias("a"), F.col("peer").alias("b")))
    groups = coded.select("label", "vec", "rep", "vh", "copies").join(counts, ["rep", "vh"], "left").join(joint.withColumnRenamed("node", "rep"), "rep", "left")
    groups = groups.select(F.col("label").alias("g_label"), F.col("vec").alias("g_vec"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c"))
    out = every.join(groups, every.label.eqNullSafe(groups.g_label) & (every.vec == groups.g_vec) & every.id.isNotNull(), "left")
    out = out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS y, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n
  FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL
), p AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.y, b.y) / (a.n * b.n) >= 0.93
), reach AS (
  WITH RECURSIVE r(u, v) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.u, p.v FROM r JOIN p ON r.v = p.u)
  SELECT u, min(v) AS component_id FROM r GROUP BY u
), k AS (SELECT u, count(*) AS n_links FROM p GROUP BY u)
SELECT e.vec_id, coalesce(k.n_links, 0) AS n_links, r.component_id, e.vec_id = r.component_id AS kept
FROM embeddings e JOIN reach r ON r.u = e.vec_id LEFT JOIN k ON k.u = e.vec_id
"""
