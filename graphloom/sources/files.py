"""Readers of Markdown, message and list files, and writers of reports."""

from __future__ import annotations

import fnmatch
import json
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Names that make a folder a project, and folders that are skipped.
PROJECT_MARKERS = (".git", "README.md", "pyproject.toml", "package.json", "Cargo.toml", "go.mod", "pom.xml", "build.gradle", "CMakeLists.txt", ".project", "setup.py", "composer.json")
SKIPPED = ("venv", "__pycache__", "node_modules", "dist", "build", "target", ".pytest_cache", ".mypy_cache", "logs", "tmp", "temp")


# Parts of a path that a simple scan leaves out.
SIMPLE_EXCLUDES = ("venv", "__pycache__", ".git", "node_modules", "dist", "build")


def simple_markdown(spark: SparkSession, root: str) -> DataFrame:
    """As markdown, without any file whose path holds one of SIMPLE_EXCLUDES."""
    return markdown(spark, root, SIMPLE_EXCLUDES)


def _excluded(path: Column, patterns) -> Column:
    """A pattern with * or ? is matched as a whole, others as a part of the path."""
    out = F.lit(False)
    for p in patterns:
        out = out | (path.rlike(fnmatch.translate(p).replace(r"\Z", r"\z")) if any(c in p for c in "*?") else F.contains(path, F.lit(p)))
    return out


def markdown(spark: SparkSession, root: str, exclude=("venv",), newer_than: str | None = None) -> DataFrame:
    """path, text, modified, file_size of Markdown files below a folder; hidden files and folders and excluded paths go."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md")
    if newer_than:
        reader = reader.option("modifiedAfter", newer_than)
    hidden = F.col("path").rlike(r"/\.[^/]+")
    files = reader.load(root).where(~hidden & ~_excluded(F.col("path"), exclude))
    return files.select("path", F.decode("content", "UTF-8").alias("text"), F.col("modificationTime").alias("modified"), F.col("length").alias("file_size"), F.md5("content").alias("content_hash"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; a line that does not parse is dropped."""
    full = schema + ", _corrupt string"
    rows = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", True).json(path)
    return rows.where("_corrupt is null").drop("_corrupt")


def json_lines_until_bad(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As json_lines, but a line that does not parse ends its file: what stands before it counts. A file is one value, so for files that fit one."""
    lines = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("k", "line")).where(F.trim("line") != "")
    parsed = lines.select("file", "k", F.from_json("line", schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    bad = F.min(F.when(F.col("r._corrupt").isNotNull(), F.col("k"))).over(Window.partitionBy("file"))
    return parsed.withColumn("bad", bad).where(F.col("bad").isNull() | (F.col("k") < F.col("bad"))).select("r.*").drop("_corrupt")


def write_timeline(rows: DataFrame, path: str) -> None:
    """A timeline's rows, a thousand at most (more are an error), as one JSON list, oldest first."""
    found = [json.loads(r) for r in rows.orderBy("timestamp", "id").limit(1001).toJSON().collect()]
    if len(found) > 1000:
        raise ValueError("an export holds at most 1000 rows; write longer timelines as a table")
    with open(path, "w") as f:
        json.dump(found, f, indent=2)


def query_list(spark: SparkSession, path: str) -> DataFrame:
    """query: the lines that are neither blank nor comments."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("query")).where((F.col("query") != "") & ~F.startswith("query", F.lit("#")))


def search_results(spark: SparkSession, answers: list[str]) -> DataFrame:
    """conversation_id, content, relevance_score from a search service's JSON answers: results under results.results, results or at the top."""
    item = "array<struct<id:string,conversation_id:string,document:string,content:string,distance:double>>"
    rows = spark.createDataFrame([(a,) for a in answers], "answer string")
    nested = F.from_json(F.get_json_object("answer", "$.results.results"), item)
    flat = F.from_json(F.get_json_object("answer", "$.results"), item)
    top = F.from_json("answer", item)
    rows = rows.select(F.explode(F.coalesce(nested, flat, top)).alias("r"))
    return rows.select(F.coalesce("r.conversation_id", "r.id").alias("conversation_id"), F.coalesce("r.content", "r.document").alias("content"), (1 - F.coalesce("r.distance", F.lit(0.5))).alias("relevance_score"))


def projects(root: str) -> list[dict]:
    """Direct subfolders that hold a marker; a listing on the driver, of one folder."""
    out = []
    for name in sorted(os.listdir(root)):
        path = os.path.join(root, name)
        if os.path.isdir(path) and not name.startswith(".") and name.lower() not in SKIPPED and any(os.path.exists(os.path.join(path, m)) for m in PROJECT_MARKERS):
            out.append({"id": f"{os.path.basename(root.rstrip('/'))}_{name}", "path": path})
    return out


def write_report(rows: DataFrame, path: str, title: str, most: int = 1000) -> None:
    """A short report as Markdown and JSON beside it; `rows` are a result of a few lines: more than `most` are an error."""
    found = [r.asDict(True) for r in rows.limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"a report holds at most {most} rows; write larger results as a table")
    with open(path + ".json", "w") as f:
        json.dump(found, f, default=str, indent=1)
    with open(path + ".md", "w") as f:
        f.write(f"# {title}\n\n")
        if found:
            f.write("| " + " | ".join(found[0]) + " |\n|" + "-|" * len(found[0]) + "\n")
            f.writelines("| " + " | ".join(str(v) for v in r.values()) + " |\n" for r in found)
