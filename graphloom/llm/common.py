"""What the operators of this subpackage share: tables, working tables in the cluster's shared folder, small helpers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names for working values that df has not, in any case."""
    taken, mark = {c.lower() for c in df.columns}, "_"
    while any(f"{mark}{n}".lower() in taken for n in names):
        mark += "_"
    return [f"{mark}{n}" for n in names]


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever they run with the same installation."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if PACKAGE_ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([PACKAGE_ROOT, *paths])


def release() -> None:
    """Gives memory that a Python worker no longer uses back to the machine, as workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def released(run):
    """run, a function over batches, with the memory given back at its end."""

    def all_of(batches):
        yield from run(batches)
        release()

    return all_of


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir; where it is unset (tests, local mode), a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Workspace:
    """Working tables of one run, as Parquet in the shared folder.

    A table that is written and read again cuts the lineage: a lost executor costs a re-read, not the
    whole plan. `keep` returns the table as it was read back. Shuffle files of what was written are no longer
    needed, so the driver's garbage is collected for Spark's cleaner to delete them. The folder goes when
    the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.tables: list[str] = []
        atexit.register(self.drop)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        at = f"{self.path}/{name}-{uuid.uuid4().hex[:8]}"
        self._written(lambda: df.write.option("compression", "zstd").parquet(at))
        return self.spark.read.schema(df.schema).parquet(at)

    def keep_bucketed(self, df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
        """As keep, but rows lie by buckets of a column: what needs them together by it reads them so, without a shuffle."""
        known = f"{name}_{uuid.uuid4().hex}"
        self._written(lambda: df.write.option("compression", "zstd").option("path", f"{self.path}/{known}").bucketBy(buckets, column).saveAsTable(known))
        self.tables.append(known)
        return self.spark.table(known)

    def _written(self, write) -> None:
        """Writes, and has the shuffle files of that write deleted, which nothing reads again."""
        conf = self.spark.conf
        before = conf.get(_CLEANUP, "false")
        conf.set(_CLEANUP, "true")
        try:
            write()
        finally:
            conf.set(_CLEANUP, before)
        gc.collect()  # Python holds the JVM's plans, and these their shuffles
        self.spark.sparkContext._jvm.System.gc()

    def drop(self) -> None:
        try:
            for known in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {known}")
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(self.path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session may have ended before
            pass


def sha256_hex(column) -> "F.Column":
    return F.sha2(column, 256)
