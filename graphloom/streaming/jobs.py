"""Incremental jobs: file sources read once per file, state and offsets in a checkpoint, run to the end of what is there.

Each returns the table its sink wrote, so an incremental run can be held against a batch one. On a schedule, call the
same function again with the same folder: only new files are read.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract
from ..session import shared_folder
from .state import first_within


def _folder(spark: SparkSession, folder: str | None) -> str:
    return folder or shared_folder(spark, "stream")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{os.path.dirname(path)}/{name}.parque[t]")


def run(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Writes what is there to Parquet, exactly once for each input file, and reads the sink."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}/offsets").option("path", f"{folder}/rows").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def message_patterns(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """A pattern for each long assistant message."""
    return run(extract.message_patterns(read(spark, sf_dir, "conversations")), _folder(spark, folder))


def first_seen(spark: SparkSession, sf_dir: str, folder: str | None = None, ttl: str = "7 days") -> DataFrame:
    """Each conversation once, however often it comes again within `ttl` of its arrival; what is remembered is that long and no longer."""
    arrivals = read(spark, sf_dir, "conversations").select("conv_id", F.current_timestamp().alias("at"))
    return run(first_within(arrivals, "conv_id", "at", ttl), _folder(spark, folder)).select("conv_id")


def event_counts(spark: SparkSession, sf_dir: str, folder: str | None = None, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """event_type, day, n in tumbling windows. Windows that the watermark has not closed are merged in from the last batch."""
    folder = _folder(spark, folder)
    events = read(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    counts = events.groupBy(F.window("at", width), "event_type").agg(F.count(F.lit(1)).alias("n"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("day"), "n", F.lit(number).cast("long").alias("batch")).write.mode("append").parquet(f"{folder}/rows")

    q = counts.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/offsets").foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(f"{folder}/rows")
    return rows.groupBy("event_type", "day").agg(F.max_by("n", "batch").alias("n"))


def sessions(spark: SparkSession, sf_dir: str, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user's events, as a batch of the same plan a stream would run."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("at", F.col("ts").cast("timestamp"))
    return events.groupBy("user_id", F.session_window("at", gap)).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
