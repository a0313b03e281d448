"""Tables written to the folder that all executors share.

Iterative operators cut their lineage by writing a step as Parquet and reading it again. Unlike a cached or locally
checkpointed step such a table survives the loss of executors, and unlike ``DataFrame.checkpoint`` it is computed once
and can be read by column.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from threading import Lock

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
#: Steps of one run after which the driver collects its garbage: only then do Spark's shuffles and broadcasts of steps that no plan
#: refers to any more leave the executors' disks and memory.
RELEASE = 8


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where that is unset, a temporary folder stands in for it if the master is local, and
    only then: on a cluster each machine would have one of its own."""
    found = spark.conf.get(SETTING, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{SETTING} is not set: steps need a folder that all executors share")
        app = spark.sparkContext.applicationId
        found = _own.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="scenarium-")
        _own[app] = found
    return found.rstrip("/")


def application_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/scenarium/{spark.sparkContext.applicationId}"


def sweep(spark: SparkSession) -> None:
    """Delete all tables of this application. Results that are not written or collected yet can't be read afterwards."""
    delete(spark, application_folder(spark))


class Scratch:
    """Intermediate tables of one run of an operator, each under a name of its own in the shared folder."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{application_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        self._lock = Lock()

    def write(self, df: DataFrame, name: str = "step") -> DataFrame:
        """Write ``df`` and return a reader of what was written, with the schema known (no inference job)."""
        return self._written(df, name)

    def counted(self, df: DataFrame, name: str = "step") -> tuple[DataFrame, int]:
        """As ``write``, with the number of rows, which the writing tasks count (no job of its own)."""
        back, n = self.observed(df, name, F.count(F.lit(1)))
        return back, n

    def observed(self, df: DataFrame, name: str, *aggregates: Column) -> tuple:
        """As ``write``, with aggregates over the rows written."""
        seen = Observation()
        back = self._written(df.observe(seen, *[c.alias(f"a{i}") for i, c in enumerate(aggregates)]), name)
        got = seen.get
        return back, *[got[f"a{i}"] for i in range(len(aggregates))]

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        with self._lock:
            self._n += 1
            path = f"{self.root}/{self._n:04d}-{name}"
            due = self._n % RELEASE == 0
        schema = df.schema
        df.write.mode("overwrite").parquet(path)
        if due:
            self.spark._jvm.System.gc()
        back = self.spark.read.schema(schema).parquet(path)
        back._scenarium_path = path  # type: ignore[attr-defined]
        return back

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables that no plan will read any more."""
        for table in tables:
            path = getattr(table, "_scenarium_path", None)
            if path:
                delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, whatever its scheme."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def together(spark: SparkSession, *tasks: Callable[[], DataFrame]) -> list[DataFrame]:
    """Results of functions that run jobs of their own and don't need each other's, run at the same time."""
    with ThreadPoolExecutor(len(tasks)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(task)) for task in tasks]]
