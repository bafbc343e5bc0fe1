"""Sessions, and cutting long lineages."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "graphloom", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine is tested with; on a cluster make your own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(name)
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession, name: str | None = None) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir, or a new name below it. Unset, a local session gets a folder of its own; a cluster must set it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/") + (f"/{name}-{uuid.uuid4().hex}" if name else "")


_written: dict[str, SparkSession] = {}


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again; the table goes when the driver ends."""
    at = shared_folder(df.sparkSession, name)
    if not _written:
        atexit.register(_drop)
    _written[at] = df.sparkSession
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def _drop() -> None:
    for at, spark in _written.items():
        try:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session may have ended before
            return


def cut(df: DataFrame) -> DataFrame:
    """df as it is now: later plans start at a table in the shared folder, and a lost executor costs no more than a re-read.

    A table and not checkpoint(): that keeps the old plan's estimate of size, which grows with every join of every round.
    """
    return kept(df, "cut")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
