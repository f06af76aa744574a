import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import pytest
from test_dedup import near_brute, suffix_brute

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as pipeline


@pytest.fixture(scope="module")
def corpus(docs_of):
    rng = random.Random(12)
    words = {k: ["".join(rng.choice(a) for _ in range(rng.randint(2, 8))) for _ in range(400)] for k, a in (("en", "aeiostnr"), ("de", "äuüwkzfh"))}
    passage = " ".join(rng.choice(words["en"]) for _ in range(60))
    rows = []
    for i in range(120):
        lang = "de" if i % 3 == 0 else "en"
        text = " ".join(rng.choice(words[lang]) for _ in range(rng.randint(20, 120)))
        if i % 10 == 1:
            text += " " + passage
        if i % 17 == 0:
            text = rows[-1][1] if rows else text
        rows.append((i, text, lang if i % 7 else None, "abc"[i % 3]))
    rows += [(200, None, "en", "a"), (201, "", "en", "a"), (202, "12 34", "en", "b"), (203, rows[5][1], "en", None), (203, rows[5][1], "en", None)]
    return rows, docs_of(rows, extra=False)


def test_stages(spark, corpus):
    rows, docs = corpus
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "suffix_dedup", "mixing", "packing"]
    step = dict(pipeline.STAGES)
    from strandweave.llm.common import keep

    one = keep(step["language_id"](spark, docs, ""))
    assert one.columns == pipeline.COLUMNS
    assert sorted(r.doc_id for r in one.collect()) == sorted(r[0] for r in rows if r[1] and r[1] != "12 34")
    assert all(r.lang for r in one.collect())

    two = keep(step["near_dedup"](spark, one, ""))
    kept = {d for d, _, _, k in near_brute([(r.doc_id, r.text) for r in one.collect()], 5) if k}
    assert sorted(r.doc_id for r in two.collect()) == sorted(kept)

    three = keep(step["suffix_dedup"](spark, two, ""))
    want = [x for x in suffix_brute([(r.doc_id, r.text) for r in two.collect()]) if x[1] > x[2]]
    texts = {r.doc_id: r for r in three.collect()}
    assert {d: n - gone for d, n, gone, *_ in want} == {d: len(r.text.encode()) for d, r in texts.items()}  # no letter is cut here
    assert all(r.n_chars == len(r.text) for r in texts.values())

    four = keep(step["mixing"](spark, three, ""))
    assert four.columns == pipeline.COLUMNS
    size, taken = Counter(), Counter()
    for r in three.collect():
        size[r.source] += len(r.text.split())
    for r in four.collect():
        taken[r.source] += len(r.text.split())
        assert r.text == texts[r.doc_id].text
    assert max(Counter(r.doc_id for r in four.collect()).values()) <= 3
    assert abs(sum(taken.values()) - sum(size.values())) < 0.05 * sum(size.values())

    five = step["packing"](spark, four, "").collect()
    assert Counter(r.doc_id for r in five if r.piece == 0) == Counter(r.doc_id for r in four.collect())


def test_no_language_to_learn_keeps_texts_with_letters(spark, docs_of):
    held_out = next(i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 5 == 0)
    for rows in ([(1, "clean text", None), (2, "日本語", None), (3, "12 34", None), (4, None, None), (5, "", None)], [(1, "clean text", None), (2, "åé", None), (held_out, "abc", "en")]):
        found = {r.doc_id: r.lang for r in dict(pipeline.STAGES)["language_id"](spark, docs_of(rows), "").collect()}
        assert found == {d: lang for d, t, lang in rows if t and t != "12 34"}


def test_different_texts_of_one_id_stay(spark, docs_of):
    text = lambda w: " ".join(f"{w}{i}" for i in range(30))
    rows = [(7, text("a")), (7, text("b")), (7, text("b")), (7, text("B")), (3, text("a")), (9, text("c")), (9, text("d") + " end"), (5, text("d")), (4, None), (4, ""), (None, text("a"))]
    found = [(r.doc_id, (r.text or "").lower()) for r in dict(pipeline.STAGES)["near_dedup"](spark, docs_of(rows), "").collect()]
    want = [(7, text("b")), (3, text("a")), (9, text("c")), (5, text("d")), (4, ""), (4, ""), (None, text("a"))]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_empty_table(spark, docs_of, tmp_path):
    docs_of([], extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_on_odd_rows(spark, docs_of):
    """Rows without an id, very long texts, ties, and columns whose names the stages use inside."""
    from pyspark.sql import functions as F

    from strandweave.llm.common import keep

    rng = random.Random(21)
    words = [f"word{i}" for i in range(5000)]
    long = " ".join(rng.choice(words) for _ in range(40_000))
    rows = [(None, "a text without an id, twice"), (None, "a text without an id, twice"), (None, None), (1, long), (2, long + " and an end"), (3, "x" * 200_000), (4, None), (5, ""), (6, "short text"), (6, "short text"), (7, "short text"), (None, long[:5000])]
    rows = [(d, t, "en", "ab"[i % 2]) for i, (d, t) in enumerate(rows)]
    names = ["copies", "copy", "removed", "kept", "component_id", "nth", "lang_pred", "score", "ambiguous", "held_out", "first", "length"]
    docs = docs_of(rows).select("*", *(F.lit(i).alias(c) for i, c in enumerate(names)))
    step = dict(pipeline.STAGES)
    texts = lambda df: sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in df.collect())
    every = sorted((d is None, d or 0, t or "") for d, t, *_ in rows)

    one = keep(step["language_id"](spark, docs, ""))
    assert one.columns == pipeline.COLUMNS and texts(one) == [x for x in every if x[2]]
    two = keep(step["near_dedup"](spark, docs, ""))
    gone = [(False, 2, long + " and an end"), (False, 6, "short text"), (False, 7, "short text")]
    assert texts(two) == sorted(x for i, x in enumerate(every) if x not in gone or (x[1] == 6 and every.index(x) == i))
    three = keep(step["suffix_dedup"](spark, docs, ""))
    left = {(r.doc_id, len(r.text)) for r in three.collect()}
    assert (1, len(long)) in left and (3, 200_000) in left and (None, 5000) in left and max(n for d, n in left if d == 2) < 70
    four = keep(step["mixing"](spark, docs, ""))
    assert four.columns == pipeline.COLUMNS and {(r.doc_id, r.text) for r in four.collect()} <= {(d, t) for d, t, *_ in rows}
    five = step["packing"](spark, docs, "").collect()
    assert Counter(r.doc_id for r in five if r.piece == 0) == Counter(d for d, *_ in rows)
    for name in step:
        assert step[name](spark, docs.limit(0), "").collect() == []
