"""Validation, writing and migration of nodes."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..schema import BOUNDS, EDGE, NODE, OPTIONAL, PREFIX


def clean_list(c: Column) -> Column:
    """Items stripped, blanks and nulls gone."""
    return F.filter(F.transform(c, strip), lambda x: x.isNotNull() & (x != ""))


def errors(kind: Column | None = None) -> Column:
    """Names of the fields out of bounds, by node type."""
    found = []
    kind = F.col("type") if kind is None else kind
    for t, fields in BOUNDS.items():
        for f, (low, high) in fields.items():
            n = F.char_length(f)
            bad = (n < low) | (n > high)
            bad = F.coalesce(bad, F.lit(f not in OPTIONAL))
            found.append(F.when((kind == t) & bad, F.lit(f)))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def validate(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with errors)."""
    judged = nodes.withColumn("errors", errors())
    return judged.where(F.size("errors") == 0).drop("errors"), judged.where(F.size("errors") > 0)


def text(kind: Column | None = None) -> Column:
    """The text of a node: its type's fields with a blank between."""
    kind = F.col("type") if kind is None else kind
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    d = F.concat(blank("description"), F.lit(" "), blank("rationale"))
    p = F.concat(blank("name"), F.lit(" "), blank("implementation"), F.lit(" "), blank("context"))
    f = F.concat(blank("attempt"), F.lit(" "), blank("reason_failed"), F.lit(" "), blank("lesson_learned"))
    return strip(F.when(kind == "Decision", d).when(kind == "Pattern", p).when(kind == "Failure", f))


def new_row(spark: SparkSession, kind: str, **fields) -> DataFrame:
    """A node of one row, with an id and the time; ValueError if a field is out of bounds."""
    for f, (low, high) in BOUNDS[kind].items():
        v = fields.get(f)
        if v is None and f in OPTIONAL:
            continue
        if v is None or not low <= len(v) <= high:
            raise ValueError(f"{f} must have {low} to {high} characters")
    for f in ("alternatives", "related_to"):
        if fields.get(f) is not None:
            fields[f] = [x.strip() for x in fields[f] if x and x.strip()]
    row = {"id": f"{PREFIX[kind]}-{uuid.uuid4().hex[:8]}", "type": kind, "timestamp": datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None), "source_files": [], **fields}
    return spark.createDataFrame([tuple(row.get(f.name) for f in NODE.fields)], NODE)


def related_edges(nodes: DataFrame) -> DataFrame:
    """A RELATES_TO edge for each entry of related_to."""
    rows = nodes.select(F.col("id").alias("src"), F.explode("related_to").alias("dst"), F.col("timestamp").alias("created_at"))
    return rows.select("src", "dst", F.lit("RELATES_TO").alias("rel_type"), F.lit(None).cast("double").alias("weight"), "created_at", F.lit(None).cast("string").alias("reasoning"), F.lit(None).cast("boolean").alias("llm_classified")).to(EDGE)


def add_source_file(nodes: DataFrame, node_id: str, file: str) -> DataFrame:
    return nodes.withColumn("source_files", F.when(F.col("id") == node_id, F.array_union(F.coalesce("source_files", F.array().cast("array<string>")), F.array(F.lit(file)))).otherwise(F.col("source_files")))


def migrate_tags(nodes: DataFrame, source: str, collection: str, project: str, at: Column) -> DataFrame:
    """Rows without a source get all three tags and the time."""
    old = F.col("source").isNull() | (F.col("source") == "")
    put = lambda c, v: F.when(old, v).otherwise(F.col(c)) if c in nodes.columns else F.when(old, v)
    return nodes.withColumns({"source": put("source", F.lit(source)), "collection": put("collection", F.lit(collection)), "project": put("project", F.lit(project)), "migrated_at": F.when(old, at)})


def backfill_timestamps(nodes: DataFrame, at: Column) -> DataFrame:
    return nodes.withColumn("timestamp", F.coalesce("timestamp", at))


def write(nodes: DataFrame, path: str, mode: str = "append") -> None:
    """Nodes as Parquet, a folder for each type."""
    nodes.write.partitionBy("type").mode(mode).parquet(path)


def append_edges(spark: SparkSession, edges: DataFrame, nodes: DataFrame, path: str, known: DataFrame | None = None) -> DataFrame:
    """Writes the edges whose ends exist and that (by ends and type) are not known; returns what was written."""
    from .traverse import endpoints_exist

    new = endpoints_exist(edges, nodes)
    if known is not None:
        new = new.join(known.select("src", "dst", "rel_type"), ["src", "dst", "rel_type"], "left_anti")
    new.write.mode("append").parquet(path)
    return new
