"""Makes this package importable in the Python workers of any cluster."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's source to the executors, once for each Spark application."""
    context = spark.sparkContext
    if getattr(context, "_gridtide_shipped", False):
        return spark
    top = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="spark-source-")) / "gridtide_source.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    context.addPyFile(str(target))
    context._gridtide_shipped = True
    return spark
