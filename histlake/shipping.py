"""Gives executors this package, wherever they start."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

HOME = Path(__file__).resolve().parent
_shipped: set[str] = set()
#: Whole texts go to Python workers in small batches, unless the session says otherwise.
ARROW_BYTES, DEFAULT_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def ship(spark: SparkSession) -> None:
    """Adds the package's source as a Python file of the application, once."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    path = Path(tempfile.mkdtemp()) / f"{HOME.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(HOME.rglob("*.py")):
            z.write(p, p.relative_to(HOME.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def small_batches(spark: SparkSession) -> None:
    """Lowers Spark's own bound for batches to Python for good: plans read it when they run."""
    if spark.conf.get(ARROW_BYTES) == DEFAULT_BYTES:
        spark.conf.set(ARROW_BYTES, "4m")
