"""Compression of vectors to short codes: product quantisation with integer codebooks that are learnt by an RDD tree aggregation.

Components become integers, floor(scale * x). Vectors lie in blocks of `block_rows`, stored column by column: a block is a NumPy
matrix with a row for each component, so a part of all its vectors is a slice of rows. A round sends the codebooks out, adds up
each block's squared distances to all entries component by component, assigns every part to its nearest entry (the lowest index
on ties) and adds the parts up, with their numbers, into int64 tensors (part, entry, component) by np.add.at. Those tensors, of a
size that depends on the codebooks alone, are merged by treeAggregate; the driver receives a few of them and replaces each entry
by the floor of its mean, leaving unused ones. The blocks are read again from the shared folder in each round.

A codebook starts as the parts of the `entries` first vectors in the order of id, null ids last, then of the vector; with fewer
vectors it has fewer entries. Vectors of each length have codebooks of their own, so lengths have to be few; a length that the
parts don't divide is filled up with zeros for the cut. Vectors that are null or hold null or non-finite components are left out;
an empty vector has empty parts, at distance 0 of entry 0. Repeated rows are coded each, and count each. Null labels form one
group. Integers are exact up to a bound on the sum of squares, 2**62; beyond it the operator raises. An empty table gives an
empty result. Only id, vector and label are read, so clashing names don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm.common import keep, table
from strandweave.llm.vectors import finite

PARTS, ENTRIES, ROUNDS, SCALE, BLOCK_ROWS = 4, 256, 4, 1024, 2048
#: Rows whose distances to all entries are in memory at once, and the depth of the reduction tree.
CHUNK, DEPTH = 512, 3
LARGEST = 1 << 62


def pieces(block: np.ndarray, parts: int) -> np.ndarray:
    """A block (component, row) as (part, component within it, row), filled up with zeros."""
    size = -(-len(block) // parts)
    full = np.zeros((parts * size, block.shape[1]), dtype=np.int64)
    full[: len(block)] = block
    return full.reshape(parts, size, block.shape[1])


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each column of a part (component, row), its nearest entry of a codebook (entry, component) and the squared distance."""
    at, least = np.zeros(part.shape[1], dtype=np.int64), np.zeros(part.shape[1], dtype=np.int64)
    top = sum(max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) ** 2 for x in part) + sum(int(abs(x).max(initial=0)) ** 2 for x in book.T)
    if 4 * top >= LARGEST:
        raise OverflowError("squared distances beyond 2**62: vectors are too long for exact sums")
    kind = np.float64 if 4 * top < 1 << 53 else np.int64  # both exact
    columns = book.T.astype(kind)
    for lo in range(0, part.shape[1], CHUNK):
        own = part[:, lo : lo + CHUNK].astype(kind)
        apart, gap = np.zeros((own.shape[1], len(book)), dtype=kind), np.empty((own.shape[1], len(book)), dtype=kind)
        for x, entry in zip(own, columns, strict=True):
            np.subtract(x[:, None], entry[None], out=gap)
            np.multiply(gap, gap, out=gap)
            apart += gap
        best = apart.argmin(axis=1)
        at[lo : lo + CHUNK], least[lo : lo + CHUNK] = best, apart[np.arange(len(best)), best]
    return at, least


Books = dict[int, np.ndarray]
Sums = dict[int, tuple[np.ndarray, np.ndarray]]


def add_block(sums: Sums | None, row: tuple[int, int, bytes], books: Books) -> Sums:
    """Sums and numbers (part, entry, component) with those of one block (length, rows, components)."""
    dim, n, body = row
    book, sums = books[dim], sums if sums is not None else {}
    parts = pieces(np.frombuffer(body, dtype=np.int64).reshape(dim, n), len(book))
    total, count = sums.setdefault(dim, (np.zeros(book.shape, dtype=np.int64), np.zeros(book.shape[:2], dtype=np.int64)))
    for p, part in enumerate(parts):
        at, _ = nearest(part, book[p])
        np.add.at(total[p], at, part.T)
        np.add.at(count[p], at, 1)
    return sums


def merge(a: Sums | None, b: Sums | None) -> Sums | None:
    if a is None or b is None:
        return b if a is None else a
    for dim, (total, count) in b.items():
        if dim in a:
            a[dim][0][...] += total
            a[dim][1][...] += count
        else:
            a[dim] = total, count
    return a


def blocks_of(rows: DataFrame, key: str, vector: str, label: str, scale: int, block_rows: int) -> DataFrame:
    """(dim, n, body, ids, labels): vectors of one length in blocks, components as int64 in columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column(b.schema.get_field_index("vec"))
            sizes = np.asarray(b.column(b.schema.get_field_index("dim")))
            for dim in np.unique(sizes):
                every = np.flatnonzero(sizes == dim)
                for lo in range(0, len(every), block_rows):
                    some = pa.array(every[lo : lo + block_rows])
                    x = np.asarray(vectors.take(some).flatten(), dtype=np.float64).reshape(len(some), dim) * scale
                    if x.size and np.abs(x).max() >= 1 << 31:
                        raise OverflowError("components beyond 2**31: vectors are too long for exact sums")
                    body = np.ascontiguousarray(np.floor(x).astype(np.int64).T).tobytes()
                    ids, labels = (b.column(b.schema.get_field_index(c)).take(some) for c in ("id", "label"))
                    columns = [pa.array([int(dim)], type=pa.int32()), pa.array([len(some)], type=pa.int32()), pa.array([body], type=pa.binary()), *(pa.ListArray.from_arrays(pa.array([0, len(c)], type=pa.int32()), c) for c in (ids, labels))]
                    yield pa.RecordBatch.from_arrays(columns, names=["dim", "n", "body", "ids", "labels"])

    own = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"), F.col(label).alias("label"))
    own = own.where(finite("vec")).withColumn("dim", F.size("vec"))
    return own.mapInArrow(run, f"dim int, n int, body binary, ids array<long>, labels array<{own.schema['label'].dataType.simpleString()}>")


def first_books(rows: DataFrame, key: str, vector: str, scale: int, parts: int, entries: int) -> Books:
    """Codebooks (part, entry, component) of the first vectors of each length, `entries` vectors of a length at most."""
    own = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec")).where(finite("vec"))
    own = own.select("id", F.transform("vec", lambda x: F.floor(x * scale)).alias("vec"), F.size("vec").alias("dim"))
    books = {}
    for (dim,) in own.select("dim").distinct().collect():  # a row for each length
        first = own.where(F.col("dim") == dim).orderBy(F.asc_nulls_last("id"), "vec").limit(entries).select("vec").collect()
        books[dim] = np.ascontiguousarray(pieces(np.array([r["vec"] for r in first], dtype=np.int64).reshape(len(first), dim).T, parts).transpose(0, 2, 1))
    return books


def learn(blocks: DataFrame, books: Books, rounds: int = ROUNDS, depth: int = DEPTH) -> Books:
    """Codebooks after some rounds over all blocks."""
    context = blocks.sparkSession.sparkContext
    rows = blocks.select("dim", "n", "body").rdd.map(tuple)
    for _ in range(rounds):
        sent = context.broadcast(books)  # parts x entries x components for each length
        sums = rows.treeAggregate(None, lambda acc, row, sent=sent: add_block(acc, row, sent.value), merge, depth) or {}
        sent.unpersist()
        books = {d: np.where(count[..., None] > 0, total // np.maximum(count, 1)[..., None], books[d]) for d, (total, count) in sums.items()}
    return books


def assign(blocks: DataFrame, books: Books) -> DataFrame:
    """(vec_id, label, code, error): the index of each part's nearest entry, and the squared distances' sum over the parts."""
    sent = blocks.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                dim, n, body, ids, labels = (b.column(b.schema.get_field_index(c))[i] for c in ("dim", "n", "body", "ids", "labels"))
                book = sent.value[dim.as_py()]
                parts = pieces(np.frombuffer(body.as_py(), dtype=np.int64).reshape(dim.as_py(), n.as_py()), len(book))
                found = [nearest(part, entries) for part, entries in zip(parts, book, strict=True)]
                code = np.stack([at for at, _ in found], axis=1).astype("<u2")
                error = sum(least for _, least in found)
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.ListArray.from_arrays(pa.array(np.arange(n.as_py() + 1, dtype=np.int32) * len(book)), pa.array(code.reshape(-1).astype(np.int32))), pa.array(error, type=pa.int64())], names=["vec_id", "label", "code", "error"])

    kind = blocks.schema["labels"].dataType.elementType.simpleString()
    return blocks.mapInArrow(run, f"vec_id long, label {kind}, code array<int>, error long")


def compress(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, Books]:
    """Coded vectors (vec_id, label, code, error), a row for each that takes part, and the codebooks (part, entry, component)."""
    blocks = keep(blocks_of(rows, key, vector, label, scale, block_rows))
    books = learn(blocks, first_books(rows, key, vector, scale, parts, entries), rounds)
    return assign(blocks, books), books


def digest(book: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, book.reshape(-1).tolist())).encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    coded = keep(coded)
    per_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    width = 2 if max((b.shape[1] for b in books.values()), default=1) <= 256 else 4
    code = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), width, "0"))), "")
    both = ",".join(digest(books[d]) for d in sorted(books)) if len(books) != 1 else digest(next(iter(books.values())))
    joined = coded.join(per_label, coded.label.eqNullSafe(per_label.of))
    return joined.select("vec_id", code.alias("code"), "error", "label_error", F.lit(both).alias("codebooks_sha256"))


def _round_sql(n: int) -> str:
    """One round of the codebooks `b{n}` (p, e, c list): assignments `a{n}` and the codebooks after it."""
    return f"""a{n} AS MATERIALIZED (
  SELECT p.vec_id, p.p, min({{'d': list_inner_product(p.c, p.c) - 2 * list_inner_product(p.c, b.c) + list_inner_product(b.c, b.c), 'e': b.e}}) AS best
  FROM parts p JOIN b{n} b USING (p) GROUP BY p.vec_id, p.p
)"""


def _sql() -> str:
    ctes = [
        """v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS y FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        "parts AS MATERIALIZED (SELECT vec_id, p, list_slice(y, p * len(y) // 4 + 1, (p + 1) * len(y) // 4) AS c FROM v, range(0, 4) t(p))",
        "b0 AS MATERIALIZED (SELECT p, e, c FROM (SELECT p, c, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) WHERE e < 256)",
    ]
    for n in range(ROUNDS):
        ctes.append(_round_sql(n))
        ctes.append(
            f"""m{n} AS (
  SELECT p, e, list(floor(s / k) ORDER BY i) AS c FROM (
    SELECT p, e, i, sum(c[i]) AS s, count(*) AS k FROM (SELECT p, a.best.e AS e, x.c, unnest(range(1, len(x.c) + 1)) AS i FROM a{n} a JOIN parts x USING (vec_id, p)) GROUP BY p, e, i) GROUP BY p, e
), b{n + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{n} b LEFT JOIN m{n} m USING (p, e))"""
        )
    ctes.append(_round_sql(ROUNDS))
    ctes.append(f"s AS (SELECT sha256(string_agg(CAST(CAST(c[i] AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, c, unnest(range(1, len(c) + 1)) AS i FROM b{ROUNDS}))")
    ctes.append(f"k AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id)")
    return "WITH " + ", ".join(ctes) + " SELECT v.vec_id, k.code, k.error, CAST(sum(k.error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error, s.codebooks_sha256 FROM v JOIN k USING (vec_id), s"


#: For vectors of one length, which 4 divides, and each id once.
SQL = _sql()
