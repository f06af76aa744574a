"""Reads derived from texts against a plain version: last windows, shared and null ids, short and missing texts."""

import random

import pytest

from strandweave.sources import derived

BASE = dict(zip(derived.LETTERS, derived.BASES, strict=True))


def plain(rows, length=derived.LENGTH, stride=derived.STRIDE):
    """(doc_id, off, seq) of all windows, in order."""
    out = []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        bases = "".join(BASE[c.lower()] for c in text or "" if c.isascii() and c.isalpha())
        places = list(range(0, len(bases) - length + 1, stride))
        if places and places[-1] != len(bases) - length:
            places.append(len(bases) - length)
        out += [(doc_id, off, bases[off : off + length]) for off in places]
    return out


def write(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string").toPandas().astype({"doc_id": "Int64"}).to_parquet(folder / "documents.parquet")
    return str(folder)


@pytest.mark.parametrize(("length", "stride"), [(48, 16), (12, 5), (7, 7)])
def test_every_letter_is_in_a_read(spark, tmp_path, length, stride):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCéß .,0") for _ in range(n))
    rows = [(i, word(n)) for i, n in enumerate([0, 1, 11, 12, 13, 47, 48, 49, 63, 64, 65, 80, 500, 20_000])]
    rows += [(3, word(90)), (3, word(70)), (3, None), (None, word(100)), (None, word(100)), (None, ""), (None, None), (4, "a" * 60), (4, "a" * 60)]
    rng.shuffle(rows)
    found = [tuple(r) for r in derived.raw_reads(spark, write(spark, tmp_path, rows), length, stride).collect()]
    assert found == plain(rows, length, stride)
    for doc_id, text in rows:
        n = sum(c.isascii() and c.isalpha() for c in text or "")
        if doc_id is not None and [r[0] for r in rows].count(doc_id) == 1 and n >= length:
            assert {p for d, off, _ in found if d == doc_id for p in range(off, off + length)} == set(range(n))


def test_order_does_not_depend_on_files(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i % 3 if i % 4 else None, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(20 + i % 9))) for i in range(120)]
    numbers = []
    for n in range(2):
        rng.shuffle(rows)
        (folder := tmp_path / str(n)).mkdir()
        numbers.append(sorted(tuple(r) for r in derived.reads(spark, write(spark, folder, rows)).collect()))
    good = [r[2] for r in plain(rows) if "N" not in r[2]]
    assert numbers[0] == numbers[1] == list(enumerate(good))


def test_an_empty_table_has_no_reads(spark, tmp_path):
    assert derived.reads(spark, write(spark, tmp_path, [])).collect() == []
