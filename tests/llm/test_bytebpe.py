import base64
import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandweave.llm import bytebpe
from strandweave.llm.encode import tokenizer_path


@pytest.fixture(scope="module")
def library():
    """The same vocabulary in the library whose results count."""
    import tiktoken
    from public_tokenizers import PATTERN

    with open(tokenizer_path(bytebpe.RANKS), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bytebpe.coder(tokenizer_path(bytebpe.RANKS))


TEXTS = ["", " ", "\n", "a", "  a", "a  ", "it's  Σας\r\n", "x\ty", "é é", "<|endoftext|> a", "日本語 テスト 🙂 ok", "\x00\x1c\x85\xa0a", "▁ ▁▁ <unk> <s>", "1 2 34 don't we'll DON'T", "a\n\nb \n c", "x" * 20_000, "ab" * 5_000, " " * 3_000, "٣४ ⅷ²", "՘ ࢏౜1\U000323b0", "a" * 64 + " " + "b" * 65]


def test_ids_equal_the_library(own, library):
    assert [i.tolist() for i in own.encode_many([None, *TEXTS])] == [[], *map(library.encode_ordinary, TEXTS)]
    assert [i.tolist() for i in own.encode_many(TEXTS)] == list(map(library.encode_ordinary, TEXTS))  # from the cache
    assert all(own.decode(library.encode_ordinary(t)) == t.encode() for t in TEXTS)


def test_letters_of_newer_unicode_versions(own, library):
    for c in bytebpe.unsettled()[::97]:
        for t in (f"a{c}", f"1{c}", f"!{c} {c}{c}a1"):
            assert own.encode_many([t])[0].tolist() == library.encode_ordinary(t)


def test_every_token_is_a_piece(own):
    assert own.data == own.tokens and len(own.tokens) == 50_256
    text = [t.decode("latin-1").translate(bytebpe._SHIFT) for t in own.tokens]
    assert own.pieces == text
    merged = own.model.encode(text, num_threads=1)
    assert sum(ids == [rank] for rank, ids in enumerate(merged)) > 50_000  # the model itself, without the look-up of whole tokens


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40) | st.text(alphabet=st.sampled_from(list("abAB é\n\t.,'1<|>ß 日̈🙂")), max_size=60))
def test_ids_equal_the_library_on_anything(own, library, text):
    ids = own.encode_many([text])[0].tolist()
    assert ids == library.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


def test_a_small_cache_gives_the_same(own, library, monkeypatch):
    monkeypatch.setattr(bytebpe, "CACHE", 5)
    rng = random.Random(1)
    for _ in range(60):
        text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]) for _ in range(4))
        assert own.encode_many([text])[0].tolist() == library.encode_ordinary(text)


def test_bad_rank_files(tmp_path):
    lines = [base64.b64encode(bytes([i])) + b" %d" % i for i in range(256)]
    for body in (lines[:-1], [*lines, base64.b64encode(b"ab") + b" 300"]):
        (tmp_path / "ranks").write_bytes(b"\n".join(body))
        with pytest.raises(ValueError):
            bytebpe.read_ranks(str(tmp_path / "ranks"))
    (tmp_path / "ranks").write_bytes(b"\n".join([*lines, base64.b64encode(b"ab") + b" 256", b""]))
    small = bytebpe.ByteBPE(str(tmp_path / "ranks"))
    assert small.encode_many(["abab b"])[0].tolist() == [256, 256, 32, 98]


def test_rows(spark, docs_of, odd, library):
    rows = odd + [(20 + i, t) for i, t in enumerate(TEXTS)] + [(99, "word " * 60_000)]
    found = bytebpe.decode(bytebpe.encode(docs_of(rows))).collect()
    want = [(d, library.encode_ordinary(t or ""), (t or "").encode()) for d, t in rows]
    order = lambda r: (r[0] is None, r[0] or 0, bytes(r[2]))
    assert sorted(((r.doc_id, r.ids, bytes(r.data)) for r in found), key=order) == sorted(want, key=order)
    assert bytebpe.decode(bytebpe.encode(docs_of([]))).collect() == []


def test_query(spark, docs_of, odd, library, tmp_path):
    docs_of(odd, extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    found = bytebpe.query(spark, str(tmp_path)).collect()
    want = []
    for d, t in odd:
        ids = library.encode_ordinary(t or "")
        want.append((d or -1, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == sorted(want)
