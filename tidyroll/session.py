"""Session settings that the reports count on, and the library for Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# Adaptive execution is on by default; it is named here because the plain joins leave hot keys
# to it, and because a join may be split even where that costs its consumer a shuffle.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def with_settings(builder: SparkSession.Builder) -> SparkSession.Builder:
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    return builder


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the library to the session's Python workers, wherever the driver was started.

    Needed where executors don't have the library installed. Spark copies the archive to each
    executor itself; a session gets it once.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    # the driver's own copy, which Spark's file server hands out
    archive = Path(tempfile.mkdtemp(prefix="tidyroll-")) / "tidyroll.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
