"""Blocks of strings: packing, strands and distinct strings of odd letters and lengths; what reads are stored as."""

import random

import pyarrow as pa
import pytest
from model import complement, fp

from strandweave.functions.blocks import restored, squeeze
from strandweave.operators.reads import orient, with_fingerprint
from strandweave.plans import storage
from strandweave.plans.assemble import stored_unique, unique_oriented
from strandweave.sources import derived

MIXED = ["ACGT", "ACG", "AC", "", "AAAA", "AAA", "TTTT", "acgt", "acga", "PQGT", "TTTP", "ACGTACGTA", "é", "CCé", "a", "A", "AAAA"]


def plain(reads):
    switch = str.maketrans("ACGTacgt", "TGCATGCA")
    every = [(2 * i + k, s) for i, r in enumerate(reads) for k, s in enumerate((r, r.translate(switch)[::-1]))]
    least = {}
    for i, s in every:
        least.setdefault(s, i)
    return every, {i: s for s, i in least.items()}


def frame(spark, reads):
    return spark.createDataFrame(list(enumerate(reads)), "ordinal long, seq string")


def test_squeezed_strings_differ_and_come_back():
    texts = ["ACGT"[:n] + "A" * m for n in range(5) for m in range(6)] + MIXED
    codes = [squeeze(t) for t in texts]
    assert len(set(codes)) == len(set(texts))
    assert restored(pa.array(codes, type=pa.binary())).to_pylist() == texts
    assert restored(pa.array(codes[:1], type=pa.binary()).slice(0, 0)).to_pylist() == []


@pytest.mark.parametrize("seed", range(3))
def test_distinct_strings_of_both_strands(spark, seed):
    rng = random.Random(seed)
    reads = MIXED + ["".join(rng.choice("ACGTac") for _ in range(rng.randint(0, 4))) for _ in range(60)]
    reads += [complement(r) for r in reads if set(r) <= set("ACGT")]
    rng.shuffle(reads)
    every, want = plain(reads)
    assert sorted(map(tuple, orient(frame(spark, reads)).collect())) == sorted(every)
    for found in (unique_oriented(frame(spark, reads)), stored_unique(frame(spark, reads))):
        rows = [tuple(r) for r in found.collect()]
        assert len(rows) == len(want) and dict(rows) == want


def test_fingerprints_of_any_length(spark):
    reads = ["ACGT" * n + "G" * m for n in range(7) for m in range(4)]
    found = {r.id: r.fp for r in with_fingerprint(orient(frame(spark, reads))).collect()}
    assert found == {2 * i + k: fp(s) for i, r in enumerate(reads) for k, s in enumerate((r, complement(r)))}


def test_reads_are_stored_as_documents_and_strings_in_pairs(spark, tmp_path):
    rows = [(i, "abcdefghij " * 40) for i in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string").toPandas().to_parquet(tmp_path / "documents.parquet")
    storage._made.append([])
    reads = derived.reads(spark, str(tmp_path))
    unique = stored_unique(reads)
    documents, pairs = (spark.read.parquet(p).count() for p in storage._made.pop())
    assert reads.count() == 6 * 23 and documents == 6
    assert unique.count() > pairs
