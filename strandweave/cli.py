"""Command line: FASTQ in, overlap graph out."""

from __future__ import annotations

import argparse
import logging
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandweave.config import Config, size_to_bytes
from strandweave.operators.graph import per_length
from strandweave.operators.runs import strand_runs
from strandweave.plans.assemble import build_graph, run_summary, stored_strands
from strandweave.plans.shipping import ship
from strandweave.plans.storage import cleanup, use_folder
from strandweave.sinks.csr import write_csr
from strandweave.sinks.writers import write
from strandweave.sources.fastq import equal_length, read_fastq
from strandweave.sources.fastq_source import scan_reads
from strandweave.timing import Timings, log


def parse(argv: list[str] | None = None) -> Config:
    p = argparse.ArgumentParser(prog="strandweave", description="Greedy suffix-prefix overlap graph of equal-length reads.")
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("-o", "--min-overlap", type=int, default=31)
    p.add_argument("-m", "--split-bytes", type=size_to_bytes, default=1 << 30)
    p.add_argument("-r", "--task-bytes", type=size_to_bytes, default=1 << 30)
    p.add_argument("-b", "--base-block", type=size_to_bytes, default=32 << 20, help="accepted and ignored")
    p.add_argument("-c", "--pair-block", type=size_to_bytes, default=64 << 20, help="accepted and ignored")
    p.add_argument("--format", choices=["binary", "gfa", "csv", "adjacency", "csr", "csr-binary"], default="binary", help="csr-binary holds all overlaps")
    p.add_argument("--wide-ids", action="store_true", help="64-bit ids in binary records")
    p.add_argument("--all-overlaps", action="store_true")
    p.add_argument("--reader", choices=["ranges", "text"], default="ranges", help="byte ranges of files that Python reaches, or lines of files that Spark reaches")
    p.add_argument("--incomplete", choices=["strict", "drop"], default="strict")
    return Config(**vars(p.parse_args(argv)))


def main(argv: list[str] | None = None) -> Timings:
    config, timings = parse(argv), Timings()
    logging.basicConfig(level=logging.INFO, format="%(levelname)s %(message)s")
    spark = SparkSession.builder.appName("strandweave").getOrCreate()
    for k, v in config.spark_settings().items():
        spark.conf.set(k, v)
    use_folder(spark, f"{config.output.rstrip('/')}.tmp")  # beside the output, in the store that all executors write to
    ship(spark)
    try:
        with timings.phase("map"):
            if config.reader == "ranges":
                reads = scan_reads(spark, config.input, config.incomplete, config.range_bytes)
            else:
                reads = read_fastq(spark, config.input, config.incomplete)
            equal_length(reads)
        if config.format == "csr-binary":
            with timings.phase("reduce"):
                runs = strand_runs(stored_strands(reads), config.min_overlap)
            with timings.phase("write"):
                write_csr(runs, config.output)
            return _done(timings)
        with timings.phase("reduce"):
            graph = build_graph(reads, config.min_overlap, config.all_overlaps)
        with timings.phase("write"):
            write(graph.edges, graph.reads, config.output, config.format, config.wide_ids)
        counts = run_summary(graph).first().asDict()
        log.info(", ".join(f"{v} {k.removeprefix('n_').replace('_', ' ')}" for k, v in counts.items()))
        for r in per_length(graph.edges).orderBy(F.desc("ovlp")).collect():  # a row for each length
            log.info("length %d: %d edges, %d sources, %d sinks", r["ovlp"], r["n_edges"], r["n_src"], r["n_dst"])
    finally:
        cleanup(spark)
    return _done(timings)


def _done(timings: Timings) -> Timings:
    Path("timings.csv").write_text(timings.csv())
    return timings


if __name__ == "__main__":
    main()
