"""Byte-level BPE by a sentencepiece model that is serialised directly from a file of ranks; decoding by the inverse mapping.

The file lists byte strings and their ranks; a lower rank merges first. Each byte becomes one character, chr(0x100 + byte), so a
token's bytes become a piece of as many characters. The pieces, with the negative rank as score, and their place as id, are
written as a BPE model in the library's file format, with the identity as normalisation and no blank added: the library then
merges the pair of the highest score, the leftmost of equals, as merging by ranks does. A text is first split by a pattern
(pre-tokens), each pre-token is mapped and encoded by itself; one that is a token as a whole is that token. Decoding looks an
id's piece up and maps its characters back to bytes.

Which characters are letters or digits for the pattern differs between libraries' Unicode versions, only for code points that
this Python doesn't know as assigned. What tiktoken takes these for is found by a small vocabulary whose tokens tell how it split.

A null text has no ids, as an empty one; a null id stays null; each row is encoded by itself, so repeated rows give equal rows;
texts may be of any length, and an empty table gives an empty result. Only id and text are read, so clashing names don't matter.
"""

from __future__ import annotations

import base64
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm.common import batches, table
from strandweave.llm.encode import tokenizer_path

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokens cached per worker, of two generations, and the characters that a cached one has at most.
CACHE, CACHED_SIZE = 200_000, 64
#: Rows and characters of a batch of results, whichever comes first.
BATCH_ROWS, BATCH_SIZE = 256, 1 << 22
# Fixed values of the library's model format: kinds of pieces and of models.
NORMAL, UNKNOWN, BPE = 1, 2, 2

_TO_TEXT = {b: chr(0x100 + b) for b in range(256)}
_TO_BYTE = {0x100 + b: b for b in range(256)}


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file in order of their ranks, which have to be 0, 1, 2, ..."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(ranks) != list(range(len(pairs))):
        raise ValueError(f"{path}: ranks are not 0 to {len(pairs) - 1}")
    if len(single := {t for t in ranks.values() if len(t) == 1}) != 256:
        raise ValueError(f"{path}: only {len(single)} of 256 single bytes are tokens")
    return [ranks[i] for i in range(len(pairs))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the ranks; the unknown piece, which no byte string needs, comes last."""
    piece = lambda text, score, kind: _bytes(1, _bytes(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))
    pieces = [piece("".join(_TO_TEXT[b] for b in token), -float(rank), NORMAL) for rank, token in enumerate(tokens)]
    pieces.append(piece("<unk>", 0.0, UNKNOWN))
    none = (1 << 64) - 1  # -1: there is no such piece
    trainer = _number(3, BPE) + _number(4, len(pieces)) + _number(40, len(tokens)) + _number(41, none) + _number(42, none) + _number(43, none)
    normaliser = _bytes(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _bytes(2, trainer) + _bytes(3, normaliser)


def unsettled() -> list[str]:
    """Characters whose class depends on the Unicode version: unassigned for this Python, a letter or digit for `regex`."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    return [c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]


def _class(characters: list[str]) -> str:
    """Sorted characters as the ranges of a character class."""
    out, first = [], None
    for c, after in zip(characters, [*characters[1:], None], strict=True):
        first = first or c
        if after is None or ord(after) != ord(c) + 1:
            out.append(f"\\U{ord(first):08X}-\\U{ord(c):08X}")
            first = None
    return "".join(out)


@lru_cache(maxsize=1)
def patterns() -> tuple[re.Pattern, re.Pattern, regex.Pattern, regex.Pattern]:
    """What finds a character from the first unsettled one on, what an unsettled one, the public pattern, and that with the letters and digits that tiktoken takes for such."""
    import tiktoken
    from public_tokenizers import PATTERN

    pairs = [bytes([a, b]) for a in b"a1" for b in range(256)]  # a token of two bytes shows that no split came between them
    probe = tiktoken.Encoding("probe", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate([*(bytes([b]) for b in range(256)), *pairs])}, special_tokens={})
    unsure, text = unsettled(), PATTERN
    for kind, before in (("L", "a"), ("N", "1")):
        if wrong := [c for c in unsure if regex.match(rf"\p{{{kind}}}", c) and len(probe.encode_ordinary(before + c)) > len(c.encode())]:
            text = text.replace(rf"\p{{{kind}}}", rf"[\p{{{kind}}}--[{_class(wrong)}]]")
    return re.compile(f"[{unsure[0]}-\U0010FFFF]"), re.compile(f"[{_class(unsure)}]"), regex.compile(PATTERN), regex.compile(text, regex.V1)


class ByteBPE:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.tokens = read_ranks(path)
        self.model = SentencePieceProcessor(model_proto=serialise(self.tokens))
        self.pieces = [self.model.id_to_piece(i) for i in range(len(self.tokens))]
        self.data = [bytes(map(_TO_BYTE.__getitem__, map(ord, p))) for p in self.pieces]
        self.rank = {token: i for i, token in enumerate(self.tokens)}
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _merged(self, words: list[str]) -> list[bytes]:
        """Ids of pre-tokens, as little-endian 32-bit integers."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        whole = [self.rank.get(r) for r in raw]
        rest = [r.decode("latin-1").translate(_SHIFT) for r, w in zip(raw, whole, strict=True) if w is None]
        merged = iter(self.model.encode(rest, num_threads=1))
        return [struct.pack(f"<{len(ids)}i", *ids) for ids in ((w,) if w is not None else next(merged) for w in whole)]

    def split(self, text: str | None) -> list[str]:
        """The text's pre-tokens."""
        high, unsure, plain, careful = patterns()
        if not text:
            return []
        return (careful if not text.isascii() and high.search(text) and unsure.search(text) else plain).findall(text)

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, each match of the pattern by itself."""
        split = [self.split(t) for t in texts]
        if len(self.cache) > CACHE:
            self.older, self.cache = self.cache, {}
        cache, older, new, long = self.cache, self.older, [], {}
        for w in set().union(*split).difference(cache):
            if (known := older.get(w)) is not None:
                cache[w] = known
            else:
                new.append(w)
        for w, ids in zip(new, self._merged(new), strict=True):
            (cache if len(w) <= CACHED_SIZE else long)[w] = ids
        get = cache.__getitem__ if not long else lambda w: cache[w] if w in cache else long[w]
        return [np.frombuffer(b"".join(map(get, words)), dtype="<i4") for words in split]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.data.__getitem__, ids))


_SHIFT = {b: 0x100 + b for b in range(256)}


@lru_cache(maxsize=2)
def coder(path: str) -> ByteBPE:
    """One coder per worker and file, kept from task to task."""
    return ByteBPE(path)


def _grouped(blocks: Iterator[pa.RecordBatch], columns: list[str], size: int) -> Iterator[tuple[list, ...]]:
    """Rows of some columns, as many at once as the sizes of the column number `size` allow."""
    held, weight = [], 0
    for lists in batches(blocks, columns, BATCH_ROWS):
        for row in zip(*lists, strict=True):
            held.append(row)
            weight += len(row[size] or "")
            if len(held) == BATCH_ROWS or weight >= BATCH_SIZE:
                yield tuple(zip(*held, strict=True))
                held, weight = [], 0
    if held:
        yield tuple(zip(*held, strict=True))


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = RANKS) -> DataFrame:
    """(doc_id, ids), a row for each input row; `ranks` names a public rank file that every machine has."""

    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(tokenizer_path(ranks))
        for keys, texts in _grouped(blocks, ["doc_id", "text"], 1):
            ids = own.encode_many(texts)
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(keys, type=pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))], names=["doc_id", "ids"])

    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(doc_id, ids, data): the bytes that the ids stand for."""

    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(tokenizer_path(ranks))
        for b in blocks:
            for at in range(0, b.num_rows, BATCH_ROWS):
                part = b.slice(at, BATCH_ROWS)
                keys, ids = part.column(part.schema.get_field_index("doc_id")), part.column(part.schema.get_field_index("ids"))
                flat, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_pylist()
                data = [own.decode(flat[a:z].tolist()) if there else None for a, z, there in zip(ends, ends[1:], ids.is_valid().to_pylist(), strict=False)]
                yield pa.RecordBatch.from_arrays([keys, ids, pa.array(data, type=pa.binary())], names=["doc_id", "ids", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, data binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = decode(encode(table(spark, sf_dir, "documents")))
    listed = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))
