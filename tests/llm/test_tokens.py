import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandweave.llm import packing, tokenstore
from strandweave.llm.common import shared_dir
from strandweave.llm.encode import BYTE_BPE, END_ID, WORD_BPE, Encoder, tokenizer_path

KINDS = [(WORD_BPE, "drop"), (BYTE_BPE, "lead")]
TEXTS = ["", " ", "\n", "a", " a", "a ", "a\n", "\na", "a  b", "it's Σας ΑΣ", "x\ty", "é é", "<|endoftext|> a", "日本語 テスト 🙂 ok", "A B", "\x1c a", "İstanbul İ", "1 2 34 don't we'll", "a\n\nb", "a \nb", "ﬁ Å", "a ́b", " x", "x" * 3000]


@pytest.fixture(scope="module", params=KINDS, ids=["word", "byte"])
def encoders(request):
    from tokenizers import Tokenizer

    return Encoder(tokenizer_path(request.param[0]), request.param[1]), Tokenizer.from_file(tokenizer_path(request.param[0]))


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_encoder_equals_library(encoders):
    own, inner = encoders
    assert [ids(x) for x in own.encode_many([None, *TEXTS])] == [[], *(inner.encode(t, add_special_tokens=False).ids for t in TEXTS)]
    assert [ids(x) for x in own.encode_many(TEXTS)] == [inner.encode(t, add_special_tokens=False).ids for t in TEXTS]  # from the cache


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abAB é\n\t.,'1<|>́ßİ ")), max_size=40))
def test_encoder_equals_library_on_anything(encoders, text):
    own, inner = encoders
    assert ids(own.encode_many([text])[0]) == inner.encode(text, add_special_tokens=False).ids


def test_capitals_before_combining_marks(encoders):
    """Some letters are composed with a mark only in lower case, which the library makes after composing."""
    own, inner = encoders
    texts = ["H\u0331a J\u030c. T\u0308, W\u030a Y\u030aa", "a\u00a0b.\u2028C\u3000d, \u2003e\u0301.", "É. é, Ö... ×. ÷, 1. x2'' É's. \"", "a" * 50 + " . .. a", "\n", "  "]
    for text in texts:
        assert ids(own.encode_many([text])[0]) == inner.encode(text, add_special_tokens=False).ids
    assert [ids(x) for x in own.encode_many(texts)] == [inner.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize(("name", "blanks"), KINDS)
def test_words_are_kept_without_their_marks(name, blanks):
    """A word with marks is two pieces, so 400 different ones fill the cache with no more than their words and marks."""
    own = Encoder(tokenizer_path(name), blanks)
    marks = [".", ",", "!?", "***"]
    own.encode_many([" ".join(f"{a}{b}é{m}" for a in "abcdefghij" for b in "klmnopqrst" for m in marks)])
    assert len(own.cache) <= 100 + len(marks) + 1


def test_perfect_hash():
    for n in (0, 1, 2, 63, 5000):
        keys = np.unique(np.random.default_rng(n).integers(-(1 << 62), 1 << 62, n))
        index = tokenstore.PerfectHash.build(keys)
        assert sorted(index.slots(keys).tolist()) == list(range(len(keys)))


def test_token_store(spark, docs_of, odd):
    rng = random.Random(4)
    rows = odd + [(rng.randrange(100, 10_000), " ".join(rng.choice(["alpha", "beta", "gamma."]) for _ in range(rng.randint(1, 60)))) for _ in range(80)]
    folder = shared_dir(spark)
    manifest = tokenstore.write(docs_of(rows), folder, shard_tokens=500)
    found = tokenstore.read(manifest, folder).collect()
    assert manifest.count() > 3
    own = Encoder(tokenizer_path(WORD_BPE), "drop")
    bodies = [b + END_ID.to_bytes(4, "little") for b in own.encode_many([t for _, t in rows])]
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in found) == sorted((d or -1, len(b) // 4, zlib.crc32(b)) for (d, _), b in zip(rows, bodies, strict=True))
    ordered = sorted(found, key=lambda r: r.start)
    assert [r.start for r in ordered] == [0, *np.cumsum([r.n_tokens for r in ordered])[:-1].tolist()]
    assert [r.doc_id or -1 for r in ordered] == sorted(r.doc_id or -1 for r in found)
    store = tokenstore.TokenStore(manifest, folder)
    by_id = {d: ids(b) for (d, _), b in zip(rows, bodies, strict=True) if d is not None}
    for d in list(by_id)[:12]:
        assert store.get(d) in [ids(b) for (e, _), b in zip(rows, bodies, strict=True) if e == d]
    assert store.get(-5) is None and store.get(99_999) is None


def test_keyed_access_reads_a_bounded_number_of_bytes(spark, docs_of):
    reads = []
    for n in (50, 5000):
        rows = [(7 * i, f"alpha beta {i % 10}") for i in range(n)] + [(None, "no id")] * 3 + [(7 * (n // 2), "again")]
        folder = shared_dir(spark)
        store = tokenstore.TokenStore(tokenstore.write(docs_of(rows).coalesce(1), folder, shard_tokens=10**9), folder)
        own = Encoder(tokenizer_path(WORD_BPE), "drop")
        most = 0
        for i in range(0, n, max(1, n // 40)):
            want = [ids(b) + [END_ID] for b in own.encode_many([x for d, x in rows if d == 7 * i])]
            assert store.get(7 * i) in want
            most = max(most, store.bytes_read)
            assert store.get(7 * i + 1) is None and store.get(-i - 1) is None
        reads.append(most)
    assert reads[1] < reads[0] + 500 and reads[1] < 2500


def test_token_store_of_very_long_texts(spark, docs_of):
    rows = [(1, "alpha beta " * 40_000), (2, "x" * 300_000), (3, None), (4, "beta"), (5, "alpha beta " * 40_000)]
    folder = shared_dir(spark)
    manifest = tokenstore.write(docs_of(rows), folder, shard_tokens=1000)
    own = Encoder(tokenizer_path(WORD_BPE), "drop")
    want = {d: ids(b) + [END_ID] for (d, _), b in zip(rows, own.encode_many([t for _, t in rows]), strict=True)}
    assert {r.doc_id: r.n_tokens for r in tokenstore.read(manifest, folder).collect()} == {d: len(x) for d, x in want.items()}
    store = tokenstore.TokenStore(manifest, folder)
    assert all(store.get(d) == x for d, x in want.items())


def test_token_store_of_nothing(spark, docs_of):
    folder = shared_dir(spark)
    assert tokenstore.read(tokenstore.write(docs_of([]), folder), folder).collect() == []


def test_sum_of_squares_rule():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 33, 300)
    bins, offsets = packing.place(sizes, 32)
    gaps, count = {}, [0] * 33
    for s, b, o in zip(sizes.tolist(), bins.tolist(), offsets.tolist(), strict=True):
        square = lambda g: sum(c * c for c in [*[count[h] - (h == g) + (h == g - s) for h in range(1, 32)]])  # noqa: B023, E731
        fits = [g for g in range(s, 32) if count[g]]
        g = gaps.get(b, 32)
        assert o == 32 - g
        if fits:
            assert square(g) == min(map(square, fits))
        else:
            assert g == 32
        if g < 32:
            count[g] -= 1
        gaps[b] = g - s
        if 0 < g - s < 32:
            count[g - s] += 1


def test_packing(docs_of, odd):
    rows = odd + [(100 + i, "lorem ipsum dolor " * (i * 13 % 700)) for i in range(60)]
    found = packing.pack(docs_of(rows), group_rows=40).collect()
    own = Encoder(tokenizer_path(BYTE_BPE), "lead")
    want = []
    for (d, _), b in zip(rows, own.encode_many([t for _, t in rows]), strict=True):
        b += END_ID.to_bytes(4, "little")
        n, at, k = len(b) // 4, 0, 0
        while at < n:
            size = min(1024, n - at) if at or n <= 1024 else n % 1024 or 1024
            want.append((d or -1, k, at, size, zlib.crc32(b[4 * at : 4 * (at + size)])))
            at, k = at + size, k + 1
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in found) == sorted(want)
    by = {}
    for r in found:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:], strict=False)) and sum(pieces[-1]) <= 1024
    assert len(by) <= -(-sum(r.length for r in found) // 1024) * 1.05 + 3
    assert packing.pack(docs_of([])).count() == 0
