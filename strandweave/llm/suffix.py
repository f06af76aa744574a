"""Suffix-array dedup: remove every byte that a string of `length` bytes covers which also starts in an earlier document.

A collection transform built column by column takes one pass over all text for each byte of the longest document, so texts
are first cut, without loss, to the places where documents can share anything (see README for figures):

1. Every window of `length` bytes is represented by its smallest k-gram hash (leftmost on ties), so equal windows have equal
   representatives. Consecutive windows with the same representative form a run of at most length - k + 1 windows.
2. Runs meet by representative. Runs of equal bytes are settled at once: all but those of the smallest id are covered. What
   is left are runs that share a representative and differ in their bytes: ends of shared passages, places of edits.
3. A run's windows are parted by how far left of the representative they start (`PARTS` ranges of distances). All windows
   of a part have the same bytes around the representative in common, nearly `length` of them, by which parts meet. Equal
   parts are settled like equal runs. Of the others, short strings that agree in part, the collection's transform and common
   prefixes are built column by column. Runs of suffixes with common prefixes of `length` or more are the shared strings.

Of a batch of documents, only the first owner of a run is sent on; so a passage that a third of all documents share is sent
once for each batch, and one that all share with different surroundings is spread by these.

A null or empty text has no bytes. Rows with a null id keep all bytes and take none from others. Rows of one id don't take
from each other. An empty table gives an empty result. Only id and text are read; `dedup` carries other columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_intdigest, xxh64_intdigest

from strandweave.llm.colbwt import repeated
from strandweave.llm.common import batches, keep, mix64, table
from strandweave.llm.shingles import _tables as powers

LENGTH, GRAM, PARTS, DOCS_PER_BUCKET, BATCH, TRANSFORM_BYTES = 50, 20, 4, 1000, 1024, 1 << 18


def runs(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text's runs: hash of the representative, hash of the run's bytes, first and last window, representative's place."""
    n, w = len(raw), length - gram + 1
    if n < length:
        none = np.zeros(0, dtype=np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((np.frombuffer(raw, dtype=np.uint8).astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    value = mix64((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    least, at, span = value, np.arange(len(value), dtype=np.int32), 1
    while span < w:  # sliding minimum over w grams, by doubling
        step = min(span, w - span)
        right = least[step:] < least[:-step]
        least, at = np.where(right, least[step:], least[:-step]), np.where(right, at[step:], at[:-step])
        span += step
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    last = np.append(first[1:], len(at)) - 1
    size = (last - first).astype(np.uint64)
    whole = mix64((sums[last + length] - sums[first]) * down[first] + mix64(size))
    return least[first], whole, first, last, at[first].astype(np.int64)


def merged(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Disjoint, ascending half-open ranges (rows of start, end) that cover the same places."""
    if not len(starts):
        return np.zeros((0, 2), dtype=np.int64)
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > ends[:-1])
    return np.stack([starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)]], axis=1)


def covered(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, key: str = "doc_id", text: str = "text", transform_bytes: int = TRANSFORM_BYTES) -> DataFrame:
    """(doc_id, row, ranges): the covered byte ranges of rows that have any, as pairs of int64; `row` is row_key's value."""
    own = docs.where(F.col(key).isNotNull() & (F.octet_length(text) >= length)).select(F.col(key).cast("long").alias("doc_id"), row_key(text).alias("row"), F.col(text).alias("text"))
    buckets = max(64, docs.count() // DOCS_PER_BUCKET)

    def scan(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows for buckets of representatives, and ranges settled within a batch (passed on with a bucket of the row)."""
        for ids, rows, texts in batches(blocks, ["doc_id", "row", "text"], rows=BATCH):
            order = np.argsort(np.array(ids), kind="stable").tolist()
            found = [runs(texts[i].encode("utf-8", "surrogatepass"), length, gram) for i in order]
            counts = [len(f[0]) for f in found]
            h1, h2, first, last = (np.concatenate([f[j] for f in found]) for j in range(4))
            nth = np.repeat(np.arange(len(order)), counts)
            id_of, row_of = np.array(ids)[order], np.array(rows)[order]
            both = mix64(h1 + mix64(h2))
            by = np.argsort(both, kind="stable")  # owners ascend within equal runs, which agree in both hashes
            new = np.append(True, (h1[by][1:] != h1[by][:-1]) | (h2[by][1:] != h2[by][:-1]))
            owner = id_of[nth[by][new]][np.cumsum(new) - 1]
            settled = np.zeros(len(by), dtype=bool)
            settled[by] = id_of[nth[by]] > owner
            once = np.zeros(len(by), dtype=bool)  # one entry for each row and run
            once[by] = new | np.append(True, nth[by][1:] != nth[by][:-1])
            out: list[tuple] = []
            edges = np.concatenate([[0], np.cumsum(counts)])
            for d in np.unique(nth[settled]).tolist():
                at = np.arange(edges[d], edges[d + 1])[settled[edges[d] : edges[d + 1]]]
                r = merged(first[at], last[at] + length)
                out.append((int(row_of[d]) % buckets, id_of[d : d + 1].tobytes() + row_of[d : d + 1].tobytes(), None, None, None, r.tobytes()))
            send = np.flatnonzero(once & ~settled)
            bucket = (h1[send] >> np.uint64(20)) % np.uint64(buckets)
            send = send[np.argsort(bucket, kind="stable")]
            bucket = np.sort(bucket)
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(send) else np.zeros(0, dtype=np.int64)
            a, b = h1[send] >> np.uint64(16), h2[send]
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(send)], strict=True):
                docs_in, nth_in = np.unique(nth[send[lo:hi]], return_inverse=True)
                out.append((int(bucket[lo]), id_of[docs_in].tobytes() + row_of[docs_in].tobytes(), _cut(a[lo:hi], 6), b[lo:hi].tobytes(), nth_in.astype("<u2").tobytes(), None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), [pa.int32(), *[pa.binary()] * 5], strict=True)], names=["bucket", "docs", "h1", "h2", "nth", "ranges"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        """Settle equal runs of a bucket; ask for the bytes of runs that share a representative only."""
        passed = pdf[pdf["ranges"].notna()]
        who = np.frombuffer(b"".join(passed["docs"]), dtype=np.int64).reshape(-1, 2)
        out = [pd.DataFrame({"doc_id": who[:, 0], "row": who[:, 1], "tag": 0, "ranges": passed["ranges"]})]
        sent = pdf[pdf["ranges"].isna()]
        if len(sent):
            ids, rows, h1, h2 = [], [], [], []
            for docs_in, a, b, nth in zip(sent["docs"], sent["h1"], sent["h2"], sent["nth"], strict=True):
                who, at = np.frombuffer(docs_in, dtype=np.int64).reshape(2, -1), np.frombuffer(nth, dtype="<u2")
                ids.append(who[0][at])
                rows.append(who[1][at])
                h1.append(_uncut(a, 6))
                h2.append(np.frombuffer(b, dtype="<u8"))
            ids, rows, h1, h2 = map(np.concatenate, (ids, rows, h1, h2))
            by = np.lexsort((ids, h2, h1))
            ids, rows, h1, h2 = ids[by], rows[by], h1[by], h2[by]
            group = np.append(True, h1[1:] != h1[:-1])
            klass = group | np.append(True, h2[1:] != h2[:-1])
            owner = ids[klass][np.cumsum(klass) - 1]
            later = ids > owner
            starts = np.flatnonzero(group)
            nth_group = np.cumsum(group) - 1
            mixed = (np.minimum.reduceat(owner, starts) < np.maximum.reduceat(owner, starts))[nth_group] & ~later
            tags = _tags(h1, h2)
            for kind, some in ((0, later), (1, mixed)):
                out.append(pd.DataFrame({"doc_id": ids[some], "row": rows[some], "tag": (tags[some] | np.uint64(kind)).view(np.int64), "ranges": None}))
        return pd.concat(out, ignore_index=True)[["doc_id", "row", "tag", "ranges"]]

    sent = own.mapInArrow(scan, "bucket int, docs binary, h1 binary, h2 binary, nth binary, ranges binary")
    met = keep(sent.groupBy("bucket").applyInPandas(meet, "doc_id long, row long, tag long, ranges binary"))
    asked = met.where("ranges IS NULL").groupBy("doc_id", "row").agg(F.collect_list("tag").alias("asked"))
    def windows(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The ranges that windows at these places cover."""
        for ids, rows, firsts in batches(blocks, ["doc_id", "row", "firsts"]):
            found = [merged(np.array(f), np.array(f) + length).tobytes() for f in firsts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), pa.array(rows, type=pa.int64()), pa.array(found, type=pa.binary())], names=["doc_id", "row", "ranges"])

    spare = length - gram
    cuts = [(int(c[0]), int(c[-1])) for c in np.array_split(np.arange(spare + 1), PARTS)]

    def fetch(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ranges of settled runs (first = -1), and the bytes of the others' parts."""
        for block in blocks:
            for lo in range(0, block.num_rows, 256):
                part = block.slice(lo, 256)
                ids, rows, texts, asked = (part.column(part.schema.get_field_index(c)) for c in ("doc_id", "row", "text", "asked"))
                ends = np.cumsum(asked.value_lengths().to_numpy(zero_copy_only=False))
                tags = asked.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                out: list[tuple] = []
                for d, row, t, start, end in zip(ids.to_pylist(), rows.to_pylist(), texts.to_pylist(), [0, *ends.tolist()], ends.tolist(), strict=False):
                    raw, mine = t.encode("utf-8", "surrogatepass"), tags[start:end]
                    h1, h2, first, last, place = runs(raw, length, gram)
                    own_tags = _tags(h1 >> np.uint64(16), h2)
                    at = np.flatnonzero(np.isin(own_tags, mine[mine & np.uint64(1) == 0]))
                    if len(at):
                        out.append((row, d, row, -1, merged(first[at], last[at] + length).tobytes()))
                    at = np.flatnonzero(np.isin(own_tags | np.uint64(1), mine[mine & np.uint64(1) == 1]))
                    for p, f, n in zip(place[at].tolist(), first[at].tolist(), last[at].tolist(), strict=True):
                        for k, (near, far) in enumerate(cuts):  # how far left of the representative a window starts
                            a, b = max(near, p - n), min(far, p - f)
                            if a <= b:
                                out.append((xxh64_intdigest(raw[p - near : p + length - far], k) - (1 << 63), d, row, p - b, raw[p - b : p - a + length]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()], strict=True)], names=["meeting", "doc_id", "row", "first", "body"])

    def transform(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts in the order of their meeting: equal ones are settled, the others of some meetings go into one collection.

        A meeting of more than `transform_bytes` is given up window by window instead, as it comes; so no collection is larger.
        """
        pool: list[tuple[int, bytes, list[tuple[int, int]]]] = []  # smallest id, bytes, its places (row, first)
        meeting: dict[bytes, tuple[int, list[tuple[int, int]]]] = {}
        out: list[tuple] = []
        at, taken, held, wide = None, 0, 0, False

        def solve() -> None:
            nonlocal pool, taken
            found: dict[tuple[int, int], list[int]] = {}
            for i, o in repeated([p[1] for p in pool], np.array([p[0] for p in pool]), length) if pool else []:
                for d, row, first in pool[i][2]:
                    found.setdefault((d, row), []).append(first + o)
            for (d, row), starts in found.items():
                starts = np.array(starts)
                out.append((d, row, merged(starts, starts + length).tobytes(), None, None, None))
            pool, taken = [], 0

        def close() -> None:
            nonlocal meeting, taken
            if len(meeting) > 1 and len({x[0] for x in meeting.values()}) > 1:
                pool.extend((d, body, places) for body, (d, places) in meeting.items())
                taken += held
                if taken > transform_bytes:
                    solve()
            meeting = {}

        def give(body: bytes, d: int, row: int, first: int) -> None:
            for o in range(len(body) - length + 1):
                digest = xxh3_128_intdigest(body[o : o + length])
                out.append((d, row, None, first + o, (digest >> 64) - (1 << 63), (digest & (1 << 64) - 1) - (1 << 63)))

        for meetings, ids, rows, firsts, bodies in batches(blocks, ["meeting", "doc_id", "row", "first", "body"], rows=8192):
            for m, d, row, f, body in zip(meetings, ids, rows, firsts, bodies, strict=True):
                if f < 0:
                    out.append((d, row, body, None, None, None))
                    continue
                if m != at:
                    close()
                    at, held, wide = m, 0, False
                if wide:
                    give(body, d, row, f)
                    continue
                if body not in meeting:
                    held += len(body)
                owner, places = meeting.setdefault(body, (d, []))
                if owner < d:  # ids ascend within a meeting
                    out.append((d, row, np.array([f, f + len(body)], dtype=np.int64).tobytes(), None, None, None))
                else:
                    places.append((d, row, f))
                if held > transform_bytes:
                    for body, (_, places) in meeting.items():
                        for place in places:
                            give(body, *place)
                    meeting, wide = {}, True
            if out:
                yield batch(out)
                out = []
        close()
        solve()
        if out:
            yield batch(out)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "row", "ranges", "first", "w1", "w2"])

    fetched = own.join(asked, ["doc_id", "row"]).mapInArrow(fetch, "meeting long, doc_id long, row long, first int, body binary")
    late = keep(fetched.repartition("meeting").sortWithinPartitions("meeting", "doc_id").mapInArrow(transform, "doc_id long, row long, ranges binary, first long, w1 long, w2 long"))
    ranges = met.where("ranges IS NOT NULL").select("doc_id", "row", "ranges").union(late.where("ranges IS NOT NULL").select("doc_id", "row", "ranges"))
    single = late.where("w1 IS NOT NULL").select("doc_id", "row", "first", "w1", "w2")
    if not single.isEmpty():  # windows of large meetings, each by itself
        owners = single.groupBy("w1", "w2").agg(F.min("doc_id").alias("owner"))
        hit = single.join(owners, ["w1", "w2"]).where("doc_id > owner").groupBy("doc_id", "row").agg(F.sort_array(F.collect_list("first")).alias("firsts"))
        ranges = ranges.union(hit.mapInArrow(windows, "doc_id long, row long, ranges binary"))
    return ranges.groupBy("doc_id", "row").agg(F.collect_list("ranges").alias("ranges"))


def _tags(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """A number for each run from its two (cut) hashes; the lowest bit is free."""
    return mix64(h1 + mix64(h2)) & ~np.uint64(1)


def _cut(values: np.ndarray, size: int) -> bytes:
    """The low `size` bytes of each number."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def _uncut(raw: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(raw) // size, 8), dtype=np.uint8)
    out[:, :size] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, size)
    return out.view("<u8").reshape(-1)


def row_key(text: str = "text"):
    """Tells rows of one id apart by their texts; rows alike in both are treated alike."""
    return F.xxhash64(F.col(text))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, as_text: bool = False, **kw) -> DataFrame:
    """The input's columns, and removed (disjoint byte ranges) and kept (the other bytes, joined); input columns of these two
    names are replaced, any others are carried.

    `as_text` makes kept a string, without the parts of letters that a range's ends cut.
    """
    found = covered(docs, length, key=key, text=text, **kw).select(*(F.col(c).alias(f"_suffix_{c}") for c in ("doc_id", "row", "ranges")))
    rest = [c for c in docs.columns if c not in ("removed", "kept")]
    used = docs.select(*(F.col(f"`{c}`") for c in rest), F.col(text).alias("_suffix_text"), F.col(key).cast("long").alias("_suffix_key"))
    joined = used.join(found, (F.col("_suffix_key") == F.col("_suffix_doc_id")) & (row_key("_suffix_text") == F.col("_suffix_row")), "left")
    joined = joined.select(*(F.col(f"`{c}`") for c in rest), "_suffix_text", "_suffix_ranges")

    def remove(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks:
            for at in range(0, block.num_rows, 512):
                part = block.slice(at, 512)
                spans, kept = [], []
                for t, ranges in zip(part.column(len(rest)).to_pylist(), part.column(len(rest) + 1).to_pylist(), strict=True):
                    raw = (t or "").encode("utf-8", "surrogatepass")
                    pairs = np.frombuffer(b"".join(ranges or []), dtype=np.int64).reshape(-1, 2)
                    pairs = merged(pairs[:, 0], pairs[:, 1]).tolist()
                    edges = [0, *(x for p in pairs for x in p), len(raw)]
                    spans.append([{"first": a, "past": b} for a, b in pairs])
                    kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                if as_text:
                    kept = [b.decode("utf-8", "ignore") for b in kept]
                kind = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], pa.array(spans, type=kind), pa.array(kept, type=pa.string() if as_text else pa.binary())], names=[*rest, "removed", "kept"])

    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in rest)
    return joined.mapInArrow(remove, f"{schema}removed array<struct<first: bigint, past: bigint>>, kept {'string' if as_text else 'binary'}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["past"] - r["first"])
    return rows.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
