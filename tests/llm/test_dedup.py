import hashlib
import pickle
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from strandweave.llm import itq, minhash, mtree, suffix
from strandweave.llm.colbwt import repeated, suffixes
from strandweave.llm.common import _mark, components
from strandweave.llm.shingles import shingle_set


def reach(nodes, links):
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    want = reach(linked, [x for x in links if x[0] != x[1]])
    assert found == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_of_more_than_2_to_the_24_edges(spark):
    n = 18_000_000
    edges = spark.range(1, n + 1).selectExpr("id AS u", "0L AS v")
    mark = _mark(edges)
    assert mark[0] == n
    assert mark == _mark(edges.repartition(3))
    assert mark != _mark(edges.selectExpr("u", "IF(u = 5, -1L, v) AS v"))


def test_components_raise_when_rounds_run_out(spark):
    with pytest.raises(RuntimeError, match="not final"):
        components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"), rounds=1)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def shingles_of(text, k):
    w = words_of(text)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def test_shingles():
    for t in [None, "", "  ", "One", "one", "a b", "A b c a b", "a\x1cb  é\tÉ", "x y " * 50]:
        for k in (1, 2, 5):
            s = shingle_set(t, k)
            assert len(s) == len(shingles_of(t, k))
            assert (np.diff(s.view(np.int64).astype(object)) != 0).all()
    assert (shingle_set("ONE two", 2) == shingle_set("one Two", 2)).all()
    assert len(np.intersect1d(shingle_set("one", 2), shingle_set("one one", 2))) == 0


def test_hashes_of_long_structured_words():
    """Words whose letters follow the Thue-Morse sequence and its complement, which collide in any polynomial modulo 2**64."""
    for n in (512, 1024, 2048, 4096):
        one = "".join("ab"[i.bit_count() % 2] for i in range(n))
        two = one.translate(str.maketrans("ab", "ba"))
        for pattern in ("{}", "x {}", "{} x", "a b {} c"):
            for k in (1, 2, 5):
                a, b = (shingle_set(pattern.format(w), k) for w in (one, two))
                assert len(np.intersect1d(a, b)) == len(shingles_of(pattern.format(one), k) & shingles_of(pattern.format(two), k))


def test_minhash_on_long_structured_words(docs_of):
    one = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, one), (2, two), (3, "x " + one), (4, "x " + two), (5, one + "a"), (6, one.upper()), (7, long), (8, long + " end"), (9, long.replace("w", "v"))]
    found = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs_of(rows)).collect())
    assert found == near_brute(rows, 2)
    assert [f[2] for f in found] == [1, 2, 3, 4, 5, 1, 7, 7, 9]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10_000)}"
    return " ".join(words)


def near_brute(rows, k):
    own = [(d, shingles_of(t, k)) for d, t in rows]
    links = [(a, b) for i, (a, x) in enumerate(own) for b, y in own[:i] if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y)]
    low = reach({d for d, _ in own if d is not None}, links)
    return sorted(((d if d is not None else -1), len(s), low.get(d, -1), d is None or low[d] == d) for d, s in own)


def test_minhash_against_brute_force(docs_of, odd):
    rng = random.Random(6)
    rows = list(odd)
    for g in range(12):
        base = [f"w{rng.randrange(10_000)}" for _ in range(rng.choice([3, 8, 20, 120]))]
        for j in range(rng.choice([1, 3, 9])):
            rows.append((1000 + 50 * g + j, edited(rng, base, rng.choice([0, 1, len(base) // 20]))))
    base = [f"w{i}" for i in range(100)]
    rows += [(5000 + i, edited(rng, base, 4)) for i in range(60)]  # near copies of what isn't there
    for k in (2, 5):
        found = minhash.near_duplicates(docs_of(rows), k=k).collect()
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1, r.kept) for r in found)
        assert got == near_brute(rows, k)
    assert minhash.near_duplicates(docs_of([])).collect() == []


def just_below(rng, n, edits, families):
    """Copies of one text just below the threshold to each other; some in families that share half of their edits."""
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(n):
        words = list(base)
        if families and i % 3 == 0:
            shared = random.Random(i // 12)
            for _ in range(edits // 2):
                words[shared.randrange(len(words))] = f"v{shared.randrange(1000)}"
        for _ in range(edits // 2 if families and i % 3 == 0 else edits):
            at = rng.randrange(len(words))
            words[at : at + 1] = [f"w{rng.randrange(10_000)}"] * rng.choice([0, 1, 1, 1, 2])
        rows.append((i, " ".join(words)))
    return rows


def test_minhash_many_copies_just_below_the_threshold(docs_of):
    rng = random.Random(16)
    short = [(1000 + i, " ".join(f"w{j}" for j in range(rng.randint(60, 120)))) for i in range(20)]
    for rows in (just_below(rng, 500, 7, True), just_below(rng, 200, 6, True) + short):
        got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs_of(rows)).collect())
        want = near_brute(rows, 2)
        assert 10 < sum(w[3] for w in want) < len(want)
        assert got == want


def test_minhash_texts_that_share_an_id(docs_of):
    rng = random.Random(17)
    one, two = [" ".join(f"{w}{rng.randrange(1000)}" for _ in range(60)) for w in "ab"]
    rows = [(3, one), (3, two), (3, two), (5, two + " more"), (7, one), (9, "quite another text")]
    found = sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(docs_of(rows)).collect())
    assert found == [(3, 3), (3, 3), (3, 3), (5, 3), (7, 3), (9, 9)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=30).map(lambda b: bytes(x % 3 + 97 for x in b)), max_size=8))
def test_column_wise_transform(documents):
    doc, offset, lcp = suffixes(documents)
    want = sorted((d[o:], i, o) for i, d in enumerate(documents) for o in range(len(d)))
    assert [(i, o) for _, i, o in want] == list(zip(doc.tolist(), offset.tolist(), strict=True))
    for t in range(1, len(want)):
        a, b = want[t - 1][0], want[t][0]
        assert lcp[t] == next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    owners = np.array([i // 2 for i in range(len(documents))])
    least = {}
    for d, o in zip(documents, owners.tolist(), strict=True):
        for i in range(len(d) - 3):
            least[d[i : i + 4]] = min(least.get(d[i : i + 4], o), o)
    hits = {(i, j) for i, d in enumerate(documents) for j in range(len(d) - 3) if least[d[j : j + 4]] < owners[i]}
    assert set(repeated(documents, owners, 4)) == hits


def suffix_brute(rows, n=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - n + 1) if d is not None else ():
            first[b[i : i + n]] = min(first.get(b[i : i + n], d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1) if d is not None else ():
            if first[b[i : i + n]] < d:
                gone[i : i + n] = b"\1" * n
        out.append((-1 if d is None else d, len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def suffix_found(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, len((r.text or "").encode()), sum(s.past - s.first for s in r.removed), len(r.removed), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in df.collect())


def test_suffix_dedup_against_brute_force(docs_of, odd):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(rng.randint(8, 40))) for _ in range(6)]
    rows = list(odd) + [(None, passages[0]), (20, passages[0]), (20, passages[0]), (21, passages[0][:50]), (22, passages[0][:49])]
    for i in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 4))]
        text = " ".join(parts)
        if rng.random() < 0.5 and text:
            at = rng.randrange(len(text))
            text = text[:at] + "#" + text[at + 1 :]
        rows.append((rng.randrange(30, 90), text))
    rows += [(200 + i, f"{word()} All rights reserved by the owner. {word()}" * 2) for i in range(40)]
    rows += [(300, "ab" * 400), (301, "ab" * 90 + "c"), (302, "z" * 49), (303, "z" * 200), (304, "z" * 60)]
    found = suffix.dedup(docs_of(rows), transform_bytes=500)
    assert suffix_found(found) == suffix_brute(rows)
    assert "row" in found.columns  # the input's own columns stay
    assert suffix.dedup(docs_of([])).collect() == []
    names = ["removed", "kept", "found_row", "ranges", "meeting", "first", "tag"]
    clash = docs_of(rows).select("*", *(F.lit(i).alias(c) for i, c in enumerate(names)))
    assert suffix_found(suffix.dedup(clash, transform_bytes=1 << 18)) == suffix_brute(rows)
    assert set(suffix.dedup(clash).columns) == set(clash.columns)
    text = suffix.dedup(docs_of([(1, "é" * 40), (2, "xé" + "é" * 39)], extra=False), as_text=True).collect()
    assert {r.doc_id: r.kept for r in text} == {1: "é" * 40, 2: "x"}


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def some_vectors(n=150, dim=24, seed=2):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 3, dim))
    x = np.concatenate([base, base + 0.2 * rng.standard_normal(base.shape), rng.standard_normal((n - 2 * len(base), dim))]).astype(np.float32)
    rows = [(i, v.tolist(), int(i % 2)) for i, v in enumerate(x)]
    rows += [(900 + i, x[3].tolist(), 1) for i in range(12)]
    rows += [(1000, None, 1), (1001, [0.0] * dim, 1), (1002, [float("nan")] * dim, 1), (1003, x[0].tolist(), None), (1004, [None] * dim, 0), (1005, [float("inf")] * dim, 0), (1006, [], 0), (1007, [1.0, 2.0], 0), (1008, [2.0, 4.0], 0), (None, x[3].tolist(), 1)]
    return rows


def good(v):
    return v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v)


def test_itq_against_brute_force(spark):
    rows = some_vectors()
    links = []
    for i, (a, x, p) in enumerate(rows):
        for b, y, q in rows[:i]:
            if None not in (a, b, p, q) and p == q and good(x) and good(y) and len(x) == len(y):
                n = np.linalg.norm(np.float64(x)) * np.linalg.norm(np.float64(y))
                if n and np.dot(np.float64(x), np.float64(y)) / n >= 0.93:
                    links.append((a, b))
    low = reach({r[0] for r in rows if r[0] is not None}, links)
    want = sorted((-1, 0, -1, True) if i is None else (i, sum(i in e for e in links), low[i], low[i] == i) for i, _, _ in rows)
    for block in (512, 5):
        found = itq.near_vectors(vectors(spark, rows), block=block).collect()
        got = sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, -1 if r.component_id is None else r.component_id, r.kept) for r in found)
        assert got == want and len(links) > 60
    assert itq.near_vectors(vectors(spark, [])).collect() == []


def turned(rng, x, cosine):
    """Unit vectors at these cosines to unit vectors x."""
    y = rng.standard_normal(x.shape)
    y -= (x * y).sum(axis=1)[:, None] * x
    c = np.broadcast_to(cosine, len(x))[:, None]
    return c * x + np.sqrt(1 - c**2) * y / np.linalg.norm(y, axis=1)[:, None]


def test_itq_tables_at_the_threshold():
    rng = np.random.default_rng(9)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    a, b = (itq.codes(v, *itq.learn(x)).view(np.int64) for v in (x, turned(rng, x, 0.9301)))
    assert (np.bitwise_count((a ^ b).view(np.uint64)) <= itq.radius(64)).mean() > 0.999
    for width in (4, 7, 10, 12):
        masks = itq.masks(64, width)
        assert (((a ^ b)[:, None] & masks[None]) == 0).any(axis=1).mean() > 0.99
        assert set(np.bitwise_count(masks.view(np.uint64)).tolist()) == {width}


def test_itq_recall_end_to_end(spark):
    """Thousands of vectors with planted pairs from the threshold upwards, and a crowd that two thirds of a label belong to."""
    rng = np.random.default_rng(19)
    x = rng.standard_normal((2500, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    pairs = turned(rng, x[:1200], rng.uniform(0.93, 1.0, 1200))
    crowd = turned(rng, np.repeat(x[:1], 500, axis=0), 0.965)
    every = np.concatenate([x, pairs, crowd]).astype(np.float32)
    label = np.concatenate([np.arange(2500) % 4, np.arange(1200) % 4, np.full(500, 7)])
    label[1200:1450] = 7  # the crowd's label has others, too
    found = {r.vec_id: r.n_links for r in itq.near_vectors(vectors(spark, [(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(every, label, strict=True))]), cell=16).collect()}
    y = every.astype(np.float64)
    y /= np.linalg.norm(y, axis=1)[:, None]
    hit = (y @ y.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(hit, False)
    want, got = hit.sum(axis=1), np.array([found[i] for i in range(len(y))])
    assert (got <= want).all() and want[:3700].sum() > 2000
    assert got[:3700].sum() >= 0.99 * want[:3700].sum() and got[3700:].sum() >= 0.99 * want[3700:].sum()


def test_mtree_against_brute_force(spark):
    rows = some_vectors()
    rows = [(r[0], r[1], r[2]) for r in rows] + [(1050, rows[3][1], 1), (1100, [1.0, 2.0], 0)]
    valid = [(i, np.floor(256 * np.float64(v)).astype(np.int64)) for i, v, _ in rows if i is not None and good(v)]
    want = []
    for i, x in valid:
        if i % 50 == 0:
            best = sorted(((-int(x @ y), j) for j, y in valid if j != i and len(x) == len(y)))[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    for size in (8192, 40):
        found = mtree.top_k(vectors(spark, rows), tree_rows=size, query_rows=3).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == sorted(want)
    assert mtree.top_k(vectors(spark, [])).collect() == []


@pytest.mark.parametrize("size", [8192, 10])
def test_mtree_repeated_ids(spark, size):
    """An id stands for one vector, as query and as candidate."""
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], 0) for i in range(1, 60)]
    rows += [rows[49], rows[49], rows[2], (50, [9.0, 9.0, 9.0, 9.0], 1), (7, [-9.0, 1.0, 0.0, 0.0], 1), (7, None, 1)]
    frame = vectors(spark, rows)
    one = {}
    for i, v, *_ in frame.select("vec_id", "embedding").collect():
        if good(v):
            one[i] = min(one.get(i, v), v)
    own = {i: [int(np.floor(256 * x)) for x in v] for i, v in one.items()}
    want = sorted((-sum(a * b for a, b in zip(own[50], v, strict=True)), i) for i, v in own.items() if i != 50)[:5]
    found = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in mtree.top_k(frame, tree_rows=size, query_rows=3).collect())
    assert found == [(50, k + 1, i, -s) for k, (s, i) in enumerate(want)] and len({f[2] for f in found}) == 5


def test_mtree_prunes_and_is_exact():
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((40, 1, 16)) * 300 + rng.standard_normal((40, 60, 16)) * 9).reshape(-1, 16).astype(np.int64)
    tree = mtree.MTree(x, np.arange(len(x)), leaf=16, fanout=4)
    for i in range(0, len(x), 97):
        want = sorted(((int(-(x[i] @ x[j])), j) for j in range(len(x)) if j != i))[:5]
        assert tree.search(x[i], i, 5) == [(-s, j) for s, j in want]
        some = np.arange(i % 7, len(x), 97)
        scores, ids = tree.search_many(x[some], some, 5, np.array([int(np.sort(x[j] @ np.delete(x, j, axis=0).T)[-5]) for j in some]))
        for r, j in enumerate(some.tolist()):
            assert list(zip((-scores[r]).tolist(), ids[r].tolist(), strict=True)) == sorted(((int(-(x[j] @ x[o])), o) for o in range(len(x)) if o != j))[:5]
    tree.seen = 0
    tree.search_many(x[::50], np.arange(0, len(x), 50), 5)
    assert tree.seen < 0.5 * len(x[::50]) * len(x)  # the bounds rule out most of the vectors of other clusters
    again = pickle.loads(pickle.dumps(tree))
    assert again.search(x[3], 3, 5) == tree.search(x[3], 3, 5)
    huge = np.array([[1 << 30, 1], [1 << 30, 2], [3, 1 << 29]], dtype=np.int64)
    assert mtree.MTree(huge, np.arange(3)).search(huge[0], 0, 2)[0] == ((1 << 60) + 2, 1)
