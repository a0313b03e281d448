"""Session settings shared by tests, the bench and stand-alone use."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Settings the operators are written for. A cluster's own values win: nothing here is set on a running session.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "scenarium", master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS; keyword arguments override them, with ``__`` for the dots of a setting's name."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers: nothing to do where the executors' PYTHONPATH has it, else it is
    added to the application's files, once."""
    root = Path(__file__).resolve().parents[1]
    path = spark._jvm.System.getenv("PYTHONPATH") or ""
    app = spark.sparkContext.applicationId
    if str(root) in path.split(":") or app in _shipped:
        return
    _shipped.add(app)
    archive = Path(tempfile.mkdtemp(prefix="scenarium-")) / "scenarium.zip"  # served by the driver, so it stays
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted((root / "scenarium").rglob("*.py")):
            z.write(file, file.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
