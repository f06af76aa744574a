"""Token-id shards with a minimal perfect hash index.

`write` encodes whole texts and lays them out in ascending id order: rows are range-partitioned by id, and each task
writes its rows as shard files of a bounded number of tokens, under a name that depends on the task alone and by an atomic
rename, so a task that runs again replaces its own files. A shard holds, in this order and little-endian,

    magic, id width (2 or 4), documents n, tokens, keys in the index, levels of the index         (header, 64 bytes)
    index levels                   uint64 bits, uint64 set bits of each
    token ids                      raw payload, `width` bytes each
    document ids                   int64[n], ascending; a bitmap marks null ids
    offsets                        uint64[n + 1] into the payload, in tokens
    index                          bits of all levels; for every `RANK` bits of a level uint32 set bits before them;
                                   fingerprints uint32[keys]; ordinals uint32[keys]

The index maps a document id to the place of its entry in constant time: level by level, a hash of the id picks a bit;
the first set one, by its rank among all set bits, is the id's own slot (no two ids share one, and none is empty). The
slot holds a fingerprint, by which ids that aren't there are told, and the entry's ordinal. Every section's place follows
from the header, so `TokenStore.get` reads a few ranges of bytes besides the document's own ids, however large the shard.
Each task also writes a directory of its shards' first ids.

A null text is an empty one. Null ids come first and are read by position, as they have no index entry. Of a repeated id,
every row is kept and the index leads to the first. An empty table gives no shard and an empty result. The input's other
columns are not carried, so clashing names can't arise.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandweave.llm.common import batches, keep, mix64, shared_dir, table
from strandweave.llm.encode import END_ID, WORD_BPE, encoder, tokenizer_path

MAGIC, HEADER = b"SLTOKENS", struct.Struct("<8sIQQQI24x")
SHARD_TOKENS, GAMMA, RANK = 2_000_000, 2.0, 512
NO_ID = np.iinfo(np.int64).min


class PerfectHash:
    """A minimal perfect hash of distinct int64 keys by cascading collision-free bit arrays."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        counts = [int(b.sum()) for b in levels]
        self.base = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.ranks = [np.cumsum(b, dtype=np.int64) for b in levels]

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix64(keys ^ mix64(np.array([level + 1]))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, levels = keys.astype(np.int64).view(np.uint64), []
        while len(left):
            size = max(64, int(GAMMA * len(left) + 63) // 64 * 64)
            at = cls._at(left, len(levels), size)
            single = np.bincount(at, minlength=size) == 1
            levels.append(single)
            left = left[~single[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for some keys that were not built in (others get a foreign slot)."""
        keys = keys.astype(np.int64).view(np.uint64)
        out, left = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = self._at(keys[left], level, len(bits))
            hit = bits[at]
            out[left[hit]] = self.base[level] + ranks[at[hit]] - 1
            left = left[~hit]
        return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype("<u4")


def shard_bytes(ids: list[int | None], bodies: list[bytes], width: int) -> bytes:
    """One shard file of documents in ascending id order; bodies hold 32-bit ids."""
    n = len(ids)
    null = np.array([d is None for d in ids], dtype=bool)
    keys = np.array([0 if d is None else d for d in ids], dtype="<i8")
    offsets = np.zeros(n + 1, dtype="<u8")
    np.cumsum([len(b) // 4 for b in bodies], out=offsets[1:])
    payload = np.frombuffer(b"".join(bodies), dtype="<u4").astype(f"<u{width}")
    unique, first = np.unique(keys[~null], return_index=True)
    index = PerfectHash.build(unique)
    slots = index.slots(unique)
    marks, ordinals = np.zeros(len(unique), dtype="<u4"), np.zeros(len(unique), dtype="<u4")
    marks[slots], ordinals[slots] = fingerprint(unique), np.flatnonzero(~null)[first]
    sizes, counts = [len(bits) for bits in index.levels], [int(bits.sum()) for bits in index.levels]
    parts = [HEADER.pack(MAGIC, width, n, len(payload), len(unique), len(sizes)), np.array([sizes, counts], dtype="<u8").T.tobytes()]
    parts += [payload.tobytes(), keys.tobytes(), np.packbits(null).tobytes(), offsets.tobytes(), *(np.packbits(bits).tobytes() for bits in index.levels)]
    for bits in index.levels:
        per = np.add.reduceat(bits, np.arange(0, len(bits), RANK), dtype=np.int64)
        parts.append((np.cumsum(per) - per).astype("<u4").tobytes())
    return b"".join([*parts, marks.tobytes(), ordinals.tobytes()])


class Layout:
    """Where a shard's sections start, from its header and the table of its levels."""

    def __init__(self, header: bytes, levels: bytes | None = None):
        magic, self.width, self.n, self.tokens, self.n_keys, self.n_levels = HEADER.unpack_from(header)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        if levels is None:
            return
        self.sizes, self.counts = np.frombuffer(levels, dtype="<u8").astype(np.int64).reshape(-1, 2).T.tolist()
        at = HEADER.size + len(levels)
        self.bits, self.ranks = [], []
        self.payload, at = at, at + self.width * self.tokens
        self.keys, at = at, at + 8 * self.n
        self.null, at = at, at + -(-self.n // 8)
        self.offsets, at = at, at + 8 * (self.n + 1)
        for size in self.sizes:
            self.bits.append(at)
            at += size // 8
        for size in self.sizes:
            self.ranks.append(at)
            at += 4 * -(-size // RANK)
        self.marks, self.ordinals = at, at + 4 * self.n_keys


class Shard:
    """A shard file read back."""

    def __init__(self, raw: bytes):
        at = Layout(raw, raw[HEADER.size : HEADER.size + 16 * Layout(raw).n_levels])
        take = lambda kind, n, place: np.frombuffer(raw, dtype=kind, count=n, offset=place)
        self.width, self.n, self.tokens = at.width, at.n, at.tokens
        self.payload, self.keys = take(f"<u{self.width}", self.tokens, at.payload), take("<i8", self.n, at.keys)
        self.null = np.unpackbits(take("u1", -(-self.n // 8), at.null), count=self.n).astype(bool)
        self.offsets = take("<u8", self.n + 1, at.offsets)
        self.index = PerfectHash([np.unpackbits(take("u1", size // 8, at.bits[i]), count=size).astype(bool) for i, size in enumerate(at.sizes)])
        self.marks, self.ordinals = take("<u4", at.n_keys, at.marks), take("<u4", at.n_keys, at.ordinals)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Ordinal of each key's first entry, -1 where it has none."""
        slots = self.index.slots(keys)
        out = np.full(len(keys), -1, dtype=np.int64)
        ok = slots >= 0
        ok[ok] = self.marks[slots[ok]] == fingerprint(keys[ok])
        out[ok] = self.ordinals[slots[ok]]
        ok[ok] = self.keys[out[ok]] == keys[ok]  # the directory is here as well, so a chance fingerprint can't mislead
        out[~ok] = -1
        return out

    def ids(self, ordinal: int) -> np.ndarray:
        return self.payload[int(self.offsets[ordinal]) : int(self.offsets[ordinal + 1])]


def _shard_name(part: int, seq: int) -> str:
    return f"{part:06d}-{seq:06d}.tok"


def write(docs: DataFrame, folder: str, path: str | None = None, blanks: str = "drop", key: str = "doc_id", text: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the shards below `folder` and return their manifest: file, first_id, part, seq, n_docs, n_tokens."""

    def write_part(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        enc, part, seq = encoder(path or tokenizer_path(WORD_BPE), blanks), TaskContext.get().partitionId(), 0
        store, base = fs.FileSystem.from_uri(folder)
        width, end = 2 if enc.vocab_size <= 1 << 16 else 4, END_ID.to_bytes(4, "little")
        store.create_dir(base, recursive=True)
        ids: list[int | None] = []
        bodies: list[bytes] = []
        tokens, firsts = 0, []

        def put(name: str, body: bytes) -> None:
            draft = f"{base}/.{name}-{uuid.uuid4().hex}"
            with store.open_output_stream(draft) as out:
                out.write(body)
            store.move(draft, f"{base}/{name}")

        def flush() -> pa.RecordBatch:
            nonlocal ids, bodies, tokens, seq
            name = _shard_name(part, seq)
            put(name, shard_bytes(ids, bodies, width))
            firsts.append(NO_ID if ids[0] is None else ids[0])
            row = [[name], [ids[0]], [part], [seq], [len(ids)], [tokens]]
            ids, bodies, tokens, seq = [], [], 0, seq + 1
            return pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(row, kinds, strict=True)], names=names)

        for some, texts in batches(blocks, ["doc_id", "text"]):
            for d, body in zip(some, enc.encode_many(texts), strict=True):
                ids.append(d)
                bodies.append(body + end)
                tokens += len(body) // 4 + 1
                if tokens >= shard_tokens:
                    yield flush()
        if ids:
            yield flush()
        if firsts:
            put(f"{part:06d}.dir", np.array(firsts, dtype="<i8").tobytes())

    names, kinds = ["file", "first_id", "part", "seq", "n_docs", "n_tokens"], [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    tie = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    return keep(rows.mapInArrow(write_part, "file string, first_id long, part int, seq int, n_docs long, n_tokens long"))


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the shard files, each document found by its key in the index."""

    def digest(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files, raws in batches(blocks, ["path", "content"], rows=1):
            shard, name = Shard(raws[0]), files[0].rsplit("/", 1)[-1]
            found = shard.find(shard.keys)
            found[shard.null] = np.flatnonzero(shard.null)
            again = np.append(False, (shard.keys[1:] == shard.keys[:-1]) & ~shard.null[:-1])  # later rows of an id follow its first
            found[again] = np.flatnonzero(again)
            if not (found == np.arange(shard.n)).all():
                raise ValueError(f"{name}: the index does not lead to every document")
            crc = [zlib.crc32(shard.ids(i).astype("<u4").tobytes()) for i in found.tolist()]
            sizes = (shard.offsets[found + 1] - shard.offsets[found]).astype(np.int64)
            keys = pa.array(shard.keys, mask=shard.null)
            yield pa.RecordBatch.from_arrays([pa.array([name] * shard.n), keys, pa.array(shard.offsets[found].astype(np.int64)), pa.array(sizes), pa.array(crc, type=pa.int64())], names=["file", "doc_id", "local", "n_tokens", "ids_crc32"])

    spark = manifest.sparkSession
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))  # ranges of ids ascend with their tasks; a row for each task
    parts = parts.select("part", before(Window.orderBy("part")).alias("part_base"))
    bases = manifest.withColumn("own", before(Window.partitionBy("part").orderBy("seq"))).join(parts, "part")
    bases = bases.select(F.col("file").alias("m_file"), (F.col("part_base") + F.col("own")).alias("base"))
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder).select("path", "content")
    rows = raw.mapInArrow(digest, "file string, doc_id long, local long, n_tokens long, ids_crc32 long")
    rows = rows.join(bases, F.col("file") == F.col("m_file"))
    return rows.select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


class TokenStore:
    """Keyed access from one process: the task's range by the first ids of all (a row for each task that wrote), the shard by
    that task's directory, the entry by the shard's index. `bytes_read` counts what the last call read."""

    def __init__(self, manifest: DataFrame, folder: str):
        from pyarrow import fs

        rows = manifest.where("seq = 0").select("part", "first_id").orderBy("part").collect()
        self.parts, self.firsts = [r["part"] for r in rows], np.array([NO_ID if r["first_id"] is None else r["first_id"] for r in rows], dtype=np.int64)
        self.store, self.base = fs.FileSystem.from_uri(folder)
        self.bytes_read = 0

    @staticmethod
    def _places(firsts: np.ndarray, doc_id: int) -> range:
        """Where an id can be: from the last place that starts before it to the last that starts with it."""
        first, last = (int(np.searchsorted(firsts, doc_id, side=side)) - 1 for side in ("left", "right"))
        return range(max(first, 0), last + 1)

    def _range(self, file, place: int, n: int) -> bytes:
        self.bytes_read += n
        return file.read_at(n, place)

    def get(self, doc_id: int) -> list[int] | None:
        self.bytes_read = 0
        for p in self._places(self.firsts, doc_id):
            with self.store.open_input_file(f"{self.base}/{self.parts[p]:06d}.dir") as f:
                shards = np.frombuffer(self._range(f, 0, f.size()), dtype="<i8")
            for seq in self._places(shards, doc_id):
                with self.store.open_input_file(f"{self.base}/{_shard_name(self.parts[p], seq)}") as f:
                    if (found := self._find(f, doc_id)) is not None:
                        return found
        return None

    def _find(self, file, doc_id: int) -> list[int] | None:
        header = self._range(file, 0, HEADER.size)
        at = Layout(header, self._range(file, HEADER.size, 16 * Layout(header).n_levels))
        number = lambda place, kind: int(np.frombuffer(self._range(file, place, np.dtype(kind).itemsize), dtype=kind)[0])
        key, base = np.array([doc_id], dtype=np.int64), 0
        for level, (size, count) in enumerate(zip(at.sizes, at.counts, strict=True)):
            bit = int(PerfectHash._at(key.view(np.uint64), level, size)[0])
            block = bit // RANK
            bits = np.unpackbits(np.frombuffer(self._range(file, at.bits[level] + block * RANK // 8, min(RANK, size - block * RANK) // 8), dtype=np.uint8))
            if bits[bit - block * RANK]:
                slot = base + number(at.ranks[level] + 4 * block, "<u4") + int(bits[: bit - block * RANK].sum())
                if number(at.marks + 4 * slot, "<u4") != int(fingerprint(key)[0]):
                    return None
                entry = number(at.ordinals + 4 * slot, "<u4")
                if number(at.keys + 8 * entry, "<i8") != doc_id:  # a chance fingerprint
                    return None
                lo, hi = np.frombuffer(self._range(file, at.offsets + 8 * entry, 16), dtype="<u8").tolist()
                return np.frombuffer(self._range(file, at.payload + at.width * lo, at.width * (hi - lo)), dtype=f"<u{at.width}").tolist()
            base += count
        return None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    return read(write(table(spark, sf_dir, "documents"), folder), folder)
