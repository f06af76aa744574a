import hashlib
import math
import random

import numpy as np
import pytest

from strandweave.llm import pivots, vectorcode


def frame(spark, rows, extra=True):
    names = "vec_id long, embedding array<float>, label int" + (", id long, vec int, dim int, part int, home int, w int, score int, code int, of int" if extra else "")
    return spark.createDataFrame([(*r, *range(9)) if extra else tuple(r) for r in rows], names)


def f32(v):
    return [None if x is None else float(np.float32(x)) for x in v]


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


ODD = [(900, None, 1), (901, [1.0, None, 0.0, 1.0] * 2, 1), (902, [float("nan")] + [0.0] * 7, 1), (903, [float("inf")] + [0.0] * 7, 2), (904, [0.0] * 8, 2), (None, [0.5] * 8, 1), (905, [0.25] * 8, None), (950, [-0.3] * 8, None)]


def some(n, dim=8, labels=3, seed=4, copies=0.3):
    rng = random.Random(seed)
    base = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(max(2, n // 4))]
    return [(i, f32(rng.choice(base)) if rng.random() < copies else f32([rng.gauss(0, 1) for _ in range(dim)]), rng.randrange(labels)) for i in range(n)]


# vector codes


def books_brute(rows, parts, entries, rounds, scale=1024):
    """Codes and codebooks by plain loops over integers."""
    kept = sorted(((i is None, i or 0, [math.floor(scale * x) for x in v]), lab) for i, v, lab in rows if good(v))
    cut = lambda v: [v[p * len(v) // parts : (p + 1) * len(v) // parts] for p in range(parts)]
    vectors = [cut(k[2]) for k, _ in kept]
    books = [[v[p] for v in vectors[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda part, book: min((far(part, e), n) for n, e in enumerate(book))
    for _ in range(rounds):
        new = []
        for p, book in enumerate(books):
            held = {}
            for v in vectors:
                held.setdefault(best(v[p], book)[1], []).append(v[p])
            new.append([[sum(c) // len(held[n]) for c in zip(*held[n], strict=True)] if n in held else e for n, e in enumerate(book)])
        books = new
    out = []
    for (k, lab), v in zip(kept, vectors, strict=True):
        found = [best(v[p], books[p]) for p in range(parts)]
        out.append((None if k[0] else k[1], lab, [n for _, n in found], sum(d for d, _ in found)))
    return out, books


def by_row(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0, r[2], r[3]))


@pytest.mark.parametrize(("n", "entries", "rows_a_block"), [(200, 8, 16), (60, 256, 2048), (3, 8, 2048)])
def test_codes_against_plain_loops(spark, n, entries, rows_a_block):
    rows = some(n) + ODD + [(1, [2.0] * 8, 0), (1, [2.0] * 8, 0)]  # an id again, and a row again
    coded, books = vectorcode.compress(frame(spark, rows).repartition(5), entries=entries, block_rows=rows_a_block)
    want, plain = books_brute(rows, 4, entries, 4)
    assert by_row((r.vec_id, r.label, r.code, r.error) for r in coded.collect()) == by_row(want)
    assert books[8].tolist() == plain


def test_lengths_and_cuts(spark):
    rows = some(30, dim=6) + [(100 + i, v, lab) for i, v, lab in some(20, dim=5, seed=9)] + [(200, [], 1), (201, [], 2)]
    coded, books = vectorcode.compress(frame(spark, rows), parts=2, entries=4)
    assert {d: b.shape for d, b in books.items()} == {6: (2, 4, 3), 5: (2, 4, 3), 0: (2, 2, 0)}
    got = {r.vec_id: (r.code, r.error) for r in coded.collect()}
    want, plain = books_brute([r for r in rows if len(r[1]) == 6], 2, 4, 4)
    assert books[6].tolist() == plain and {i: (c, e) for i, _, c, e in want}.items() <= got.items()
    want, _ = books_brute([(i, [*v, 0.0], lab) for i, v, lab in rows if len(v) == 5], 2, 4, 4)
    assert {i: (c, e) for i, _, c, e in want}.items() <= got.items()
    assert got[200] == got[201] == ([0, 0], 0)


def test_codes_of_nothing_and_of_too_much(spark):
    coded, books = vectorcode.compress(frame(spark, []))
    assert coded.collect() == [] and books == {}
    with pytest.raises(Exception, match="too long"):
        vectorcode.compress(frame(spark, [(1, [3e30] * 8, 1)]))


def test_sums_do_not_depend_on_the_tree(spark):
    rows = frame(spark, some(300)).repartition(17)
    books = [vectorcode.learn(vectorcode.blocks_of(rows, "vec_id", "embedding", "label", 1024, 7), vectorcode.first_books(rows, "vec_id", "embedding", 1024, 4, 16), depth=d)[8] for d in (1, 2, 4)]
    assert all((b == books[0]).all() for b in books[1:])


def test_code_query(spark, tmp_path):
    rows = some(120, dim=64) + [(900, None, 1), (905, f32([0.1] * 64), None), (906, f32([0.2] * 64), None)]
    frame(spark, rows, extra=False).write.parquet(str(tmp_path / "embeddings.parquet"))
    want, plain = books_brute(rows, 4, 256, 4)
    sha = hashlib.sha256(",".join(str(x) for book in plain for entry in book for x in entry).encode()).hexdigest()
    total = {}
    for _, lab, _, error in want:
        total[lab] = total.get(lab, 0) + error
    found = vectorcode.query(spark, str(tmp_path)).collect()
    assert sorted((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in found) == sorted((i, "".join(f"{c:02x}" for c in code), e, total[lab], sha) for i, lab, code, e in want)
    frame(spark, [], extra=False).write.parquet(str(tmp_path / "none" / "embeddings.parquet"))
    assert vectorcode.query(spark, str(tmp_path / "none")).collect() == []


# hard negatives


def mined_brute(rows, positives=5, negatives=3, every=50, scale=256):
    one = {}
    for i, v, lab in rows:
        if i is not None and lab is not None and good(v) and len(v):
            one[i] = min(one.get(i, (lab, v)), (lab, v))
    own = {i: (lab, [math.floor(scale * x) for x in v]) for i, (lab, v) in one.items()}
    out = []
    for a in (i for i in own if i % every == 0):
        score = sorted((-sum(x * y for x, y in zip(own[a][1], v, strict=True)), i, lab) for i, (lab, v) in own.items() if i != a and len(v) == len(own[a][1]))
        for s, p, _ in [r for r in score if r[2] == own[a][0]][:positives]:
            fit = [(t, n) for t, n, lab in score if lab != own[a][0] and 50 * -s <= 100 * -t <= 95 * -s][:negatives]
            out += [(a, p, k + 1, n, -s, -t) for k, (t, n) in enumerate(fit)]
    return sorted(out)


def mined(df, **options):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in pivots.mine(df, **options).collect())


@pytest.mark.parametrize(("copies", "options"), [(0.3, {}), (0.9, {"block_rows": 20, "query_rows": 2, "pivots": 5}), (0.0, {"block_rows": 40, "pivots": 3})])
def test_mining_against_brute_force(spark, copies, options):
    rows = some(260, copies=copies) + ODD + [(100, [0.5] * 8, 1), (7, [3.0] * 8, 0), (7, [3.0] * 8, 0), (50, [1.0, 2.0], 1), (300, [1.0, 2.0], 1), (301, [1.5, 2.0], 1), (302, [1.0, 1.0], 0)]
    want = mined_brute(rows)
    assert len(want) > 40
    assert mined(frame(spark, rows), **options) == want


def test_mining_small_cases(spark):
    assert mined(frame(spark, [])) == []
    assert mined(frame(spark, ODD)) == []
    assert mined(frame(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.75], 2)])) == [(0, 1, 1, 2, 65536, 49152)]
    assert mined(frame(spark, [(0, [1.0], 1), (1, [-1.0], 1), (2, [-0.75], 2)])) == []  # a negative positive has no window
    assert mined(frame(spark, [(0, [1.0], 1), (1, [0.0], 1), (2, [0.0], 2), (3, [0.0], 3)])) == [(0, 1, 1, 2, 0, 0), (0, 1, 2, 3, 0, 0)]


def test_brackets_hold_and_rule_out():
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((20, 1, 12)) * 300 + rng.standard_normal((20, 50, 12)) * 9).reshape(-1, 12).astype(np.int64)
    top = float((x.astype(float) ** 2).sum(axis=1).max())
    points = pivots.lifted(x[::70], top)
    q = x[::97]
    to, held = pivots.apart(np.hstack([q.astype(float), np.zeros((len(q), 1))]), points), pivots.apart(pivots.lifted(x, top), points)
    score = q @ x.T
    base = (q.astype(float) ** 2).sum(axis=1) + top
    low = np.sort(score, axis=1)[:, -5]
    for high in (np.full(len(q), pivots.HIGHEST), low + 40_000):
        ok = pivots.bracketed(to, *pivots.reach(base, low, high), held)
        assert ok[(score >= low[:, None]) & (score <= high[:, None])].all()
        assert ok.mean() < 0.7
    big = np.array([[1 << 30, 1], [1 << 30, 2]], dtype=np.int64)
    assert pivots.scores_of(big[:1], big, 2.0**61)[0].tolist() == [(1 << 60) + 1, (1 << 60) + 2]


def test_anchors_may_be_chosen(spark):
    from pyspark.sql import functions as F

    rows = some(80)
    found = mined(frame(spark, rows), is_anchor=F.col("id") == 3, positives=2, negatives=1)
    assert found == [r for r in mined_brute(rows, 2, 1, every=3) if r[0] == 3]
