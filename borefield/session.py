"""Session settings the jobs rely on, and shipping this package to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def configure(spark: SparkSession) -> SparkSession:
    """Months are calendar months of the stored instant, so the session's zone is pinned."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give executors this package, once a context, so that jobs run where it isn't installed."""
    context = spark.sparkContext
    if getattr(context, "_borefield_shipped", False):
        return
    root = Path(__file__).parent
    path = Path(tempfile.mkdtemp(prefix="borefield-")) / "borefield.zip"
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(path))
    context._borefield_shipped = True
