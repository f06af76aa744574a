import random

from hypothesis import given, settings
from hypothesis import strategies as st
from model import BAD, complement, fp
from pyspark.sql import functions as F

from strandweave.functions import bases
from strandweave.functions.fingerprint import DUAL, Hash, combine, fingerprint, fingerprinted, prefix_fingerprints, prefix_sums, split, suffix_fingerprints
from strandweave.operators.diagnostics import collision_rate
from strandweave.operators.reads import base_column, distinct_reads, duplicate_groups, duplicates_removed, length_summary, lengths_and_offsets, orient, transpose, with_fingerprint


def column(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, seq string").select("i", expr.alias("x")).collect()
    return [r.x for r in sorted(rows, key=lambda r: r.i)]


def strings(n=40):
    rng = random.Random(3)
    return ["".join(rng.choice("ACGT") for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_filter_characters(spark):
    every = [chr(c) for c in range(1, 128)]
    assert [c for c, bad in zip(every, column(spark, every, bases.is_low_quality(F.col("seq"))), strict=True) if bad] == [c for c in every if c in BAD]


def test_codes_complement_and_packing(spark):
    s = strings()
    assert column(spark, s, bases.reverse_complement(F.col("seq"))) == [complement(x) for x in s]
    assert column(spark, ["acgt"], bases.reverse_complement(F.col("seq"))) == ["ACGT"]
    assert column(spark, list("ACTGactg"), bases.encode(F.col("seq"))) == [1, 2, 3, 4] * 2
    assert column(spark, s, bases.unpack(bases.pack(F.col("seq")), F.length("seq"))) == s
    assert column(spark, ["ACTG", "G"], bases.pack(F.col("seq"))) == ["1B", "C0"]


def test_fingerprints(spark):
    s = strings() + ["A", "C", "T", "G", "ACGT", "GATTACA"]
    assert column(spark, s, fingerprint(F.col("seq"))) == [fp(x) for x in s]
    assert fp("GATTACA") == 291675524534355
    assert column(spark, ["GATTACA"], DUAL[0].prefixes(F.col("seq")))[0][-1] == 67911
    assert (DUAL[0].inverse, DUAL[1].inverse) == (107374182, 76695840)


def test_rolls_and_concatenation(spark):
    s = [x for x in strings() if len(x) > 3]
    n = len(min(s, key=len))
    s = [x[:n] for x in s]
    h, first, last = split(fingerprint(F.col("seq"))), bases.encode(F.substring("seq", 1, 1)), bases.encode(F.substring("seq", n, 1))
    assert column(spark, s, combine(*(k.next_suffix(x, first, n) for k, x in zip(DUAL, h, strict=True)))) == [fp(x[1:]) for x in s]
    assert column(spark, s, combine(*(k.previous_prefix(x, last) for k, x in zip(DUAL, h, strict=True)))) == [fp(x[:-1]) for x in s]
    a, b = split(fingerprint(F.substring("seq", 1, 2))), split(fingerprint(F.substring("seq", 3, n)))
    assert column(spark, s, combine(*(k.concat(x, y, F.lit(n - 2)) for k, x, y in zip(DUAL, a, b, strict=True)))) == [fp(x) for x in s]
    # a state smaller than the code it loses must not wrap
    assert spark.range(1).select(DUAL[0].previous_prefix(F.lit(2).cast("long"), F.lit(3).cast("long"))).first()[0] == 429496727


def test_rolled_fingerprints(spark):
    s = [x for x in strings() if len(x) > 3]
    longest = max(map(len, s))
    assert column(spark, s, prefix_fingerprints(F.col("seq"), 3)) == [[fp(x[:n]) for n in range(3, len(x))] for x in s]
    assert column(spark, s, suffix_fingerprints(F.col("seq"), 3, longest)) == [[fp(x[-n:]) for n in range(3, len(x))] for x in s]


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="ACGT", max_size=40), st.text(alphabet="ACGT", max_size=40))
def test_monoid_law_of_the_model(a, b):
    p, r = DUAL[0].prime, DUAL[0].radix
    h = lambda s: fp(s) >> 32
    assert h(a + b) == (h(a) * pow(r, len(b), p) + h(b)) % p


def test_per_read_operators(spark):
    reads = spark.createDataFrame([(0, "ACGT"), (1, "GGCC"), (2, "ACGT")], "ordinal long, seq string")
    assert [(r.ordinal, r.len, r.offset) for r in lengths_and_offsets(reads).orderBy("ordinal").collect()] == [(0, 4, 0), (1, 4, 4), (2, 4, 8)]
    assert length_summary(reads).first() == (3, 4, 4, True)
    assert {(r.pos, r.bases) for r in transpose(reads).collect()} == {(0, "AGA"), (1, "CGC"), (2, "GCG"), (3, "TCT")}
    assert [r.base for r in base_column(reads, 1).orderBy("ordinal").collect()] == ["C", "G", "C"]
    keyed = with_fingerprint(orient(reads))
    assert {r.id for r in distinct_reads(keyed).collect()} == {r.id for r in distinct_reads(keyed, "fp").collect()} == {0, 2}
    assert {r.min_id: r.n for r in duplicate_groups(keyed).collect()} == {0: 4, 2: 2}
    assert duplicates_removed(keyed).first() == (6, 2, 4)


def test_collisions(spark):
    reads = spark.createDataFrame([(i, s) for i, s in enumerate(sorted({x for x in strings(300) if x}))], "ordinal long, seq string")
    real = collision_rate(reads).first()
    assert real.rate_percent == 0 and real.n_shared_fps == 0
    pair = (Hash(5, 3), Hash(7, 3))
    tiny = collision_rate(reads, pair).first()
    want = len({fp(r.seq, 5, 3, 7, 3) for r in reads.collect()})
    assert tiny.n_fps == want and abs(tiny.rate_percent - (1 - want / tiny.n_strings) * 100) < 1e-9
    assert collision_rate(reads, pair, "suffix", 3).first().n_strings <= 4**3 + 4**2 + 4


def test_scanned_fingerprints_equal_those_of_columns(spark):
    rng = random.Random(9)
    reads = ["".join(rng.choice("ACGTacgtR") for _ in range(n)) for n in (*range(40), 48, 48, 200)]
    frame = spark.createDataFrame(list(enumerate(reads)), "ordinal long, seq string").repartition(3)
    for pair in (DUAL, (Hash(1009, 5), Hash(13, 7))):
        rows = fingerprinted(frame, "seq", pair).withColumn("want", fingerprint(F.col("seq"), pair)).collect()
        assert len(rows) == len(reads) and all(r.fp == r.want for r in rows)
    sums = prefix_sums(frame).withColumns({f"w{i}": F.aggregate(k.prefixes(F.col("seq")), F.lit(0).cast("long"), lambda a, e: a + e) for i, k in enumerate(DUAL)}).collect()
    assert len(sums) == len(reads) and all((r.sum_h1, r.sum_h2) == (r.w0, r.w1) for r in sums)


def test_transpose_shuffles_reads_whole(spark):
    rng = random.Random(8)
    reads = ["".join(rng.choice("ACGT") for _ in range(7)) for _ in range(50)]
    frame = spark.createDataFrame(list(enumerate(reads)), "ordinal long, seq string").repartition(5)
    found = transpose(frame, 16)
    assert sorted((r.pos, r.block, r.bases) for r in found.collect()) == sorted((p, b, "".join(s[p] for s in reads[16 * b : 16 * b + 16])) for p in range(7) for b in range(4))
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    assert transpose(frame.limit(0)).collect() == []
