"""Language identification by error-correcting output codes over byte n-grams.

Every language has a codeword; a binary classifier for each bit says on which side of that bit a text's language is.
Each classifier is linear in the counts of byte n-grams (1 to `n` of them, lower-cased, hashed to `dim` features): the
log-odds of the two sides' n-gram distributions, all languages of a side weighing the same. Decoding is loss-weighted: the
language whose codeword has the smallest logistic loss over all margins wins, ties going to the first in code-point order;
`score` is the softmax of the negative losses, and `ambiguous` flags texts whose two best languages are closer than
`margin`.

Fitting uses a bounded sample: `per_lang` labelled rows of each language in expectation, picked by a hash of the id, whole
texts each. Prediction reads every whole text, and nothing but the text. A text that is null, empty or without any letter is
`und` with score 0. Rows without lang are predicted like all others. With no labelled row at all, everything is `und`; with
one language, every text with letters has it, with score 1. Repeated rows are predicted one by one. The input's other
columns are kept by `predict`, which raises where one is called held_out, lang_pred, score or ambiguous.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandweave.llm.common import batches, table

PER_LANG, NGRAM, BITS, MARGIN, SAMPLE_TASKS = 3000, 3, 15, 0.1, 12
LETTER = re.compile(r"[^\W\d_]")


def features(text: str, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of a text's byte n-grams, and how often each occurs."""
    b = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
    counts, code = np.zeros(1 << bits, dtype=np.int32), np.zeros(len(b), dtype=np.uint32)
    for k in range(n):
        m = len(b) - k
        code = code[:m] * np.uint32(257) + b[k:] + np.uint32(1)
        at = (code * np.uint32(0x9E3779B1) + np.uint32(k * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(32 - bits)
        counts += np.bincount(at, minlength=1 << bits).astype(np.int32)
    used = np.flatnonzero(counts)
    return used, counts[used]


def codebook(k: int, seed: int = 7) -> np.ndarray:
    """k codewords of -1 and 1, as a k x length array with distinct, non-complementary columns.

    All such columns for up to 6 languages, else 12 * log2(k) random balanced ones, the best of 200 draws by distance.
    """
    if k == 1:
        return np.ones((1, 0))
    if k <= 6:
        return np.array([[1, *c] for c in itertools.product((-1, 1), repeat=k - 1) if -1 in c], dtype=float).T
    rng, best, apart = np.random.default_rng(seed), None, -1
    for _ in range(200):
        book = np.array([rng.permutation(np.arange(k) % 2 * 2 - 1) for _ in range(int(12 * np.log2(k)))], dtype=float).T
        gap = min((book[i] != book[j]).sum() for i in range(k) for j in range(i))
        if gap > apart:
            best, apart = book, gap
    return best


@dataclass
class Model:
    langs: list[str]
    book: np.ndarray
    weights: np.ndarray  # features x bits
    n: int
    bits: int
    margin: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.langs or not LETTER.search(text):
            return "und", 0.0, True
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        used, counts = features(text, self.n, self.bits)
        total = counts.sum()
        margins = counts @ self.weights[used] / total * min(float(total), 60.0)  # evidence of at most some ten letters a bit
        loss = np.logaddexp(0, -self.book * margins).sum(axis=1)
        odds = np.exp(loss.min() - loss)
        best = int(np.argmin(loss))
        score = float(odds[best] / odds.sum())
        return self.langs[best], score, bool(score < (1 + self.margin) / 2)


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = PER_LANG, n: int = NGRAM, bits: int = BITS, margin: float = MARGIN) -> Model:
    spark = docs.sparkSession
    train = docs.where(F.col(lang).isNotNull() & ~held_out(key))
    sizes = {r[0]: r[1] for r in train.groupBy(lang).count().collect()}  # a row for each language
    if not sizes:
        return Model([], np.ones((0, 0)), np.zeros((1 << bits, 0)), n, bits, margin)
    share = F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(int(min(1.0, per_lang / v) * (1 << 30)))) for k, v in sizes.items()))
    dice = F.pmod(F.xxhash64(F.col(key), F.lit("langid")), F.lit(1 << 30))
    sample = train.where(dice < F.element_at(share, F.col(lang))).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for langs, texts in batches(blocks, ["lang", "text"]):
            for name, t in zip(langs, texts, strict=True):
                if t:
                    used, counts = features(t, n, bits)
                    seen.setdefault(name, np.zeros(1 << bits))[used] += counts
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), type=pa.string()), pa.array([c.tobytes() for c in seen.values()], type=pa.binary())], names=["lang", "counts"])

    # bounded by languages * SAMPLE_TASKS rows of 2**bits numbers, whatever the input
    total: dict[str, np.ndarray] = {k: np.zeros(1 << bits) for k in sorted(sizes)}
    for r in sample.repartition(SAMPLE_TASKS).mapInArrow(count, "lang string, counts binary").toLocalIterator():
        total[r["lang"]] += np.frombuffer(r["counts"])
    langs = sorted(total)
    book = codebook(len(langs))
    p = np.array([(total[k] + 0.02) / (total[k].sum() + 0.02 * (1 << bits)) for k in langs])
    weights = np.zeros((1 << bits, book.shape[1]), dtype=np.float32)
    for j in range(book.shape[1]):
        weights[:, j] = np.log(p[book[:, j] > 0].mean(axis=0)) - np.log(p[book[:, j] < 0].mean(axis=0))
    return Model(langs, book, weights, n, bits, margin)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The input's columns and held_out, lang_pred, score, ambiguous; raises where the input has one of these."""
    if clash := {"held_out", "lang_pred", "score", "ambiguous"} & set(docs.columns):
        raise ValueError(f"the input must not have columns called {', '.join(sorted(clash))}")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits * bits-of-the-code numbers

    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for block in blocks:
            for at in range(0, block.num_rows, 512):
                part = block.slice(at, 512)
                found = [m.predict(t) for t in part.column(part.schema.get_field_index(text)).to_pylist()]
                new = [pa.array(c, type=k) for c, k in zip(zip(*found, strict=True), (pa.string(), pa.float64(), pa.bool_()), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, "lang_pred", "score", "ambiguous"])

    own = docs.withColumn("held_out", held_out(key))
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    return own.mapInArrow(run, T.StructType([*own.schema.fields, *new]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = predict(docs.select("doc_id", "text"), fit(docs))
    return rows.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
