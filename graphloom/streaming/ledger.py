"""Tables that a stream's batches are written to so that a batch that comes twice changes nothing, and the tracker of files and sessions on them.

A batch is one folder, named by its number and written over when it comes again: that is the ledger. A reader sees the batches in their order;
`replace` marks a batch that earlier ones do not reach past. `compact` folds the batches up to one into a snapshot, itself a batch that replaces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.dedup import changed_files
from ..operators.traverse import endpoints_exist, strongest_of_each
from ..schema import _struct


class BatchTable:
    """Rows by batch under a folder. schema: of the rows, without the column batch."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _rows(self, name: str) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField("batch", T.LongType())])
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def batches(self) -> DataFrame:
        """batch, replaces: the ledger."""
        try:
            return self.spark.read.schema("replaces boolean, batch long").json(f"{self.path}/ledger")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], "replaces boolean, batch long")

    def write(self, rows: DataFrame, batch: int, replaces: bool = False) -> None:
        """Writes a batch, in place of what a try before it has left. A batch counts once it is in the ledger, which is written last."""
        rows.to(self.schema).write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch}")
        self.spark.range(1).select(F.lit(replaces).alias("replaces")).write.mode("overwrite").json(f"{self.path}/ledger/batch={batch}")

    def has(self, batch: int) -> bool:
        return not self.batches().where(F.col("batch") == batch).isEmpty()

    def read(self, before: int | None = None) -> DataFrame:
        """Rows and their batch, of the batches in the ledger (up to but not with `before`), from the last that replaces on."""
        listed = self.batches() if before is None else self.batches().where(F.col("batch") < before)
        low, numbers = listed.agg(F.max(F.when(F.col("replaces"), F.col("batch"))), F.collect_list("batch")).first()  # one number a batch
        wanted = [b for b in numbers if low is None or b >= low]
        return self._rows("rows").where(F.col("batch").isin(wanted) if wanted else F.lit(False))

    def compact(self, batch: int, fold: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
        """Makes `batch`, the last there is, a snapshot of all up to it, folded."""
        whole = fold(self.read(batch + 1)).select(*self.schema.names)
        beside = BatchTable(self.spark, f"{self.path}/compacting", self.schema)
        beside.write(whole, batch)
        self.write(beside.read(), batch, replaces=True)


# ---- edges of each batch of new nodes


def append_edges(table: BatchTable, edges: DataFrame, nodes: DataFrame, batch: int) -> None:
    """The edges of a batch whose ends exist and that no earlier batch has (by ends and type), the heaviest of each; what came before, or a try of this batch, makes no difference."""
    new = strongest_of_each(endpoints_exist(edges, nodes))
    known = table.read(before=batch).select("src", "dst", "rel_type").distinct()
    table.write(new.join(known, ["src", "dst", "rel_type"], "left_anti"), batch)


def relationships(new_nodes: DataFrame, known: DataFrame, derive: Callable[[DataFrame, DataFrame], DataFrame], table: BatchTable, folder: str, notify: Callable[[DataFrame, int], None] | None = None) -> None:
    """For each batch of new nodes (a stream): edges from them to all known nodes. A batch that is tried again writes the same; notify gets what it wrote, and its number to tell repeats."""

    def step(batch: DataFrame, number: int) -> None:
        append_edges(table, derive(batch, known), known.unionByName(batch, allowMissingColumns=True), number)
        if notify:
            notify(table.read().where(F.col("batch") == number).drop("batch"), number)

    q = new_nodes.writeStream.option("checkpointLocation", f"{folder}/offsets").foreachBatch(step).trigger(availableNow=True).start()
    q.awaitTermination()


# ---- scanned files and scan sessions

CHANGE = _struct(
    normalized_path=T.StringType(), file_size=T.LongType(), last_modified=T.DoubleType(), content_hash=T.StringType(), project_id=T.StringType(),
    scan_status=T.StringType(), error_message=T.StringType(), at=T.TimestampNTZType(), session=T.LongType(),
)
SESSION = _struct(session=T.LongType(), at=T.TimestampNTZType(), total=T.LongType(), ends=T.BooleanType())
STATUSES = ("pending", "processing", "completed", "failed")


class Tracker:
    """Files by path and what became of them: each batch holds changes, a file is as its last change says."""

    def __init__(self, spark: SparkSession, path: str):
        self.changes = BatchTable(spark, f"{path}/changes", CHANGE)
        self.sessions_begun = BatchTable(spark, f"{path}/sessions", SESSION)

    def put(self, rows: DataFrame, batch: int, replaces: bool = False) -> None:
        """Files as found (status processing where none is given)."""
        full = rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in CHANGE.fields if f.name not in rows.columns})
        full = full.withColumn("scan_status", F.coalesce("scan_status", F.lit("processing")))
        self.changes.write(full.select(*CHANGE.names), batch, replaces)

    def mark(self, files: DataFrame, status: str, batch: int) -> None:
        """Files (normalized_path, at, session, and error_message if failed) get a status; other properties stay. Paths that are not known change nothing."""
        if status not in STATUSES:
            raise ValueError(f"status must be one of {STATUSES}")
        given = files.select("normalized_path", F.col("at").alias("_at"), F.col("session").alias("_session"), (F.col("error_message") if status == "failed" else F.lit(None).cast("string")).alias("_error"))
        rows = self.files(before=batch).join(given, "normalized_path").withColumns({"scan_status": F.lit(status), "error_message": F.col("_error"), "at": F.col("_at"), "session": F.col("_session")})
        self.changes.write(rows.select(*CHANGE.names), batch)

    def files(self, before: int | None = None) -> DataFrame:
        """One row for each path: its last change."""
        last = Window.partitionBy("normalized_path").orderBy(F.col("batch").desc(), F.col("at").desc_nulls_last(), "scan_status")
        return self.changes.read(before).withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k", "batch")

    def compact(self, batch: int) -> None:
        last = Window.partitionBy("normalized_path").orderBy(F.col("batch").desc(), F.col("at").desc_nulls_last(), "scan_status")
        self.changes.compact(batch, lambda rows: rows.withColumn("_k", F.row_number().over(last)).where("_k = 1"))

    def to_scan(self, listing: DataFrame) -> DataFrame:
        """Files of a listing (path, file_size, last_modified, content_hash) that are new or were changed since."""
        return changed_files(listing, self.files()).where("scan").drop("scan")

    def begin(self, session: int, at: DataFrame | str, total: int) -> None:
        self._session(2 * session, session, at, total, False)

    def end(self, session: int, at: str) -> None:
        self._session(2 * session + 1, session, at, None, True)

    def _session(self, batch: int, session: int, at, total: int | None, ends: bool) -> None:
        row = self.changes.spark.range(1).select(F.lit(session).cast("long").alias("session"), F.lit(at).cast("timestamp_ntz").alias("at"), F.lit(total).cast("long").alias("total"), F.lit(ends).alias("ends"))
        self.sessions_begun.write(row, batch)

    def sessions(self) -> DataFrame:
        """session, start_time, end_time, total_files, processed_files, failed_files, skipped_files, status: counters from what became of the files each session touched last."""
        s = self.sessions_begun.read().groupBy("session").agg(F.min(F.when(~F.col("ends"), F.col("at"))).alias("start_time"), F.max(F.when(F.col("ends"), F.col("at"))).alias("end_time"), F.max("total").alias("total_files"))
        last = Window.partitionBy("session", "normalized_path").orderBy(F.col("batch").desc(), F.col("at").desc_nulls_last(), "scan_status")
        touched = self.changes.read().where("session is not null").withColumn("_k", F.row_number().over(last)).where("_k = 1")
        n = touched.groupBy("session").agg(F.count_if(F.col("scan_status") == "completed").alias("processed_files"), F.count_if(F.col("scan_status") == "failed").alias("failed_files"), F.count(F.lit(1)).alias("_touched"))
        out = s.join(n, "session", "left").na.fill(0, ["processed_files", "failed_files", "_touched"])
        skipped = F.greatest(F.coalesce("total_files", F.lit(0)) - F.col("_touched"), F.lit(0)).alias("skipped_files")
        return out.select("session", "start_time", "end_time", "total_files", "processed_files", "failed_files", skipped, F.when(F.col("end_time").isNull(), "running").otherwise("completed").alias("status"))
