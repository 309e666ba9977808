"""Makes this package importable in Python workers, wherever they run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


#: Rows of an Arrow batch, where the session hasn't chosen another number than Spark's default: rows
#: here hold whole texts, and a batch of 10,000 long ones would not fit beside an executor's heap.
BATCH_ROWS, _DEFAULT_ROWS = 1000, "10000"


def ship(spark: SparkSession) -> None:
    """Hand the package's sources to the executors, once for each Spark context, and bound Arrow batches."""
    context = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == _DEFAULT_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if getattr(context, "_lexforge_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="lexforge-")) / "lexforge_sources.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(PACKAGE.rglob("*.py")):
            out.write(source, source.relative_to(PACKAGE.parent))
    context.addPyFile(str(archive))
    context._lexforge_shipped = True
