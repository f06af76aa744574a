"""Give executors the package, if the driver runs it from a folder that they don't have; set the session up for long texts."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Bytes of a batch that goes between the JVM and Python, where the session has not set it: each running task holds a few batches
#: outside the heap on both sides, at Spark's own default 64 MB each, whatever the number of rows.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20)

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the application as a zip archive, once, and bound the bytes of the session's batches if nobody has."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    context = spark.sparkContext
    if context.applicationId in _done:
        return
    top = Path(__file__).resolve().parents[2]
    if not top.is_dir():  # it runs from an archive already
        return
    _done.add(context.applicationId)
    archive = Path(tempfile.mkdtemp(prefix="strandweave-")) / "strandweave_package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for p in sorted((top / "strandweave").rglob("*.py")):
            out.write(p, p.relative_to(top))
    context.addPyFile(str(archive))
