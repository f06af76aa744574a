"""Anchors: few rows for each read, and all overlaps found, whatever the letters and the reads' length."""

import random

import pytest
from model import all_overlaps

from strandweave.functions.fingerprint import DUAL, Hash
from strandweave.operators import diagnostics
from strandweave.operators.anchors import Anchors
from strandweave.operators.diagnostics import collisions_by_round
from strandweave.operators.overlap import candidates
from strandweave.operators.runs import overlap_runs
from strandweave.operators.reads import both_strands
from strandweave.plans.assemble import stored_strands, unique_oriented
from strandweave.plans.storage import materialize


def cut(rng, letters, size, n, genome=300):
    text = "".join(rng.choice(letters) for _ in range(genome))
    return [text[i : i + size] for i in (rng.randrange(genome - size) for _ in range(n))]


def frame(spark, reads):
    return materialize(unique_oriented(spark.createDataFrame(list(enumerate(reads)), "ordinal long, seq string")))


@pytest.mark.parametrize(("letters", "size", "least"), [("ACGT", 48, 32), ("ACGTR", 48, 32), ("AC", 70, 20), ("acGT", 20, 11)])
def test_all_overlaps_once_from_few_rows(spark, letters, size, least):
    reads = cut(random.Random(7), letters, size, 60)
    uniq = frame(spark, reads)
    want = all_overlaps({r.id: r.seq for r in uniq.collect()}, least)
    anchors = Anchors.of(uniq, least)
    assert anchors.packed == (letters == "ACGT")
    n = uniq.count()
    assert anchors.rows(uniq, source=False).count() == n
    if size == 48:  # 16 lengths, so 16 rows for each source before
        assert anchors.rows(uniq, source=True).count() < 5 * n
    for hot in (1000, 1):
        found = [tuple(r) for r in candidates(uniq, least, hot=hot).collect()]
        assert len(found) == len(set(found)) and set(found) == want
    runs = [tuple(r) for r in overlap_runs(uniq, least).expand().collect()]
    assert len(runs) == len(set(runs)) and set(runs) == want


def test_reads_of_several_lengths_are_an_error(spark):
    reads = spark.createDataFrame([(0, "ACGTAC"), (2, "ACGTACG")], "id long, seq string")
    with pytest.raises(ValueError, match="one length"):
        candidates(reads, 3)


def test_collision_rounds_shuffle_reads_whole(spark):
    """Prefixes of prefixes, reads within others and of several lengths: each string is counted once."""
    rng = random.Random(10)
    reads = sorted({"".join(rng.choice("AC") for _ in range(n)) for n in (2, 3, 5, 5, 5, 6, 6, 6, 6, 7, 7, 8, 9, 9, 9)} | {"ACACAC", "ACACA", "ACACACA"})
    frame = spark.createDataFrame(list(enumerate(reads)), "id long, seq string").repartition(3)
    found = collisions_by_round(frame, 3, (Hash(11, 5), Hash(3, 7)))
    want = {}
    for s in reads:
        for n in range(3, len(s)):
            want.setdefault((n, "prefix"), set()).add(s[:n])
            want.setdefault((n, "suffix"), set()).add(s[-n:])
    assert {(r.ovlp, r.side): r.n_strings for r in found.collect()} == {k: len(v) for k, v in want.items()}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1  # by side, not by length


@pytest.mark.parametrize(("letters", "size", "least"), [("AC", 9, 4), ("ACGT", 10, 5), ("AT", 11, 6), ("AT", 8, 2), ("ACGT", 48, 32), ("ACGN", 9, 4)])
@pytest.mark.parametrize("pair", [(Hash(11, 5), Hash(3, 7)), DUAL])
def test_collisions_of_both_strands_in_one_order(spark, monkeypatch, letters, size, least, pair):
    """One shuffle of packed strings, without a row for each length, gives what the general form does."""
    monkeypatch.setattr(diagnostics, "TASK_STRINGS", 10)
    reads = cut(random.Random(13), letters, size, 60) + ["A" * size, "ACGT" * (size // 4) + "A" * (size % 4), "AC" + "T" * (size - 2), "AC" + "T" * (size - 3) + "A"]
    strands = stored_strands(spark.createDataFrame(list(enumerate(reads)), "ordinal long, seq string"))
    found, want = diagnostics.strand_collisions(strands, least, pair), collisions_by_round(both_strands(strands), least, pair)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.dtypes == want.dtypes
    assert ("Generate" in found._jdf.queryExecution().optimizedPlan().toString()) == (letters == "ACGN" or least < 4)
