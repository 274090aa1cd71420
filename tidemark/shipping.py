"""Executors import this package from a zip that the driver hands out, so that no folder needs to be shared for code."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


#: Rows in an Arrow batch, where the session leaves it at Spark's default: rows may hold texts of 100 kB and more.
BATCH, DEFAULT_BATCH = "500", "10000"


def ship(spark: SparkSession) -> SparkSession:
    """Make `tidemark` importable in the Python workers of this session; done once for each Spark context."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == DEFAULT_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return spark
    top = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent).as_posix())
    sc.addPyFile(str(path))
    sc._tidemark_shipped = True
    return spark
