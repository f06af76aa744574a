import random

import pytest

from strandweave.operators.reads import with_fingerprint
from strandweave.plans.matrix import BaseMatrix
from strandweave.operators.reads import both_strands, read_strands
from strandweave.plans.assemble import unique_oriented
from strandweave.streaming.distinct import read_distinct, read_distinct_strands, smallest_strands, write_distinct


def some_reads(n, size=9, seed=2):
    rng = random.Random(seed)
    return ["".join(rng.choice("ACGTacgt") for _ in range(size)) for _ in range(n)]


def frame(spark, reads, first=0):
    return spark.createDataFrame([(first + i, r) for i, r in enumerate(reads)], "ordinal long, seq string").repartition(3)


def test_columns_after_appends(spark, tmp_path):
    reads = some_reads(103)
    matrix = BaseMatrix(spark, (tmp_path / "m").as_uri(), block=16)
    assert matrix.columns().collect() == [] and matrix.append(frame(spark, [])) == 0
    ends = [0, 5, 7, 16, 64, 70, 103]  # within a block, at its end, over many
    files = set()
    for a, z in zip(ends, ends[1:], strict=False):
        assert matrix.append(frame(spark, reads[a:z], a)) == z
        got = {(r.pos, r.block): r.bases for r in matrix.columns().collect()}
        assert got == {(p, b): "".join(r[p] for r in reads[16 * b : min(16 * b + 16, z)]).upper() for p in range(9) for b in range(-(-z // 16))}
        now = {p: p.stat().st_mtime_ns for p in (tmp_path / "m").rglob("*.parquet")}
        assert files <= set(now.items())  # what was written before is as it was
        files = set(now.items())
    for p in (0, 8):
        assert [r.base for r in matrix.column(p).orderBy("ordinal").collect()] == [r[p].upper() for r in reads]
    assert matrix.column(9).collect() == []
    with pytest.raises(ValueError, match="go on"):
        matrix.append(frame(spark, reads[:3], 200))


def test_a_column_reads_its_own_files_only(spark, tmp_path):
    matrix = BaseMatrix(spark, (tmp_path / "m").as_uri(), block=16)
    matrix.append(frame(spark, some_reads(40)))
    column = matrix.column(3)
    files = {f for f in column.inputFiles() if "pos=3" in f}
    plan = column._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(pos" in plan and "(pos" in plan.split("PartitionFilters:")[1].split("]")[0]
    from pyspark.sql import functions as F

    read = {r.f for r in matrix.rows().where("pos = 3").select(F.input_file_name().alias("f")).distinct().collect()}
    assert read == files


def test_an_append_that_was_cut_off(spark, tmp_path):
    reads = some_reads(50)
    matrix = BaseMatrix(spark, (tmp_path / "m").as_uri(), block=16)
    matrix.append(frame(spark, reads[:20]))
    from strandweave.plans.matrix import turned

    rows = turned(frame(spark, some_reads(9, seed=5), 20), 16)
    rows.write.partitionBy("pos").parquet(f"{matrix.folder}/columns/append=1")  # its mark is missing
    assert [r.base for r in matrix.column(2).orderBy("ordinal").collect()] == [r[2].upper() for r in reads[:20]]
    matrix.append(frame(spark, reads[20:], 20))
    assert [r.base for r in matrix.column(2).orderBy("ordinal").collect()] == [r[2].upper() for r in reads]


def test_distinct_reads_of_a_stream(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, rng.choice(["ACGT", "GGTA", "TTTT", "CCAG", "ACCA"]) + rng.choice("ACGT")) for i in range(60)]
    rng.shuffle(rows)
    want = {s: min(i for i, t in rows if t == s) for s in {t for _, t in rows}}
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in (rows[:25], rows[25:26], rows[26:]):  # a start for each, from the checkpoint of the one before
        with_fingerprint(spark.createDataFrame(part, "id long, seq string")).repartition(3).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id long, seq string, fp long").option("maxFilesPerTrigger", 2).parquet(source)
        write_distinct(stream, target, state).awaitTermination()
    found = {r.seq: r.id for r in read_distinct(spark, target).collect()}
    assert found == want
    assert read_distinct(spark, target).count() == len(want)
    assert len(list((tmp_path / "out").iterdir())) >= 4


def test_stream_of_both_strands(spark, tmp_path):
    """A row for each read, packed, whatever the order of files; a string that is its own complement has one id."""
    rng = random.Random(8)
    reads = ["".join(rng.choice("ACGT") for _ in range(4)) for _ in range(150)] + ["ACGT", "ACGN"]
    rows = read_strands(spark.createDataFrame(list(enumerate(reads)), "ordinal long, seq string")).select("code", "x", "y")
    assert rows.count() < len(reads) + 3
    rows.orderBy("x", ascending=False).repartition(6).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("code binary, x long, y long").option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    before = spark.conf.get("spark.sql.streaming.minBatchesToRetain")
    write_distinct(stream, f"{tmp_path}/out", f"{tmp_path}/state", smallest_strands).awaitTermination()
    assert spark.conf.get("spark.sql.streaming.minBatchesToRetain") == before
    found = {(r.id, r.seq) for r in both_strands(read_distinct_strands(spark, f"{tmp_path}/out")).collect()}
    assert found == {(r.id, r.seq) for r in unique_oriented(spark.createDataFrame(list(enumerate(reads)), "ordinal long, seq string")).collect()}
