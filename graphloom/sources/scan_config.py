"""Scans of Markdown folders as a configuration file describes them: where, what not, how old, how duplicates are told, and only what is new."""

from __future__ import annotations

import datetime
import json
import os
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalised_path
from ..operators import dedup, extract
from ..session import cut
from ..streaming.ledger import Tracker
from .files import markdown

try:
    import yaml
except ImportError:  # JSON files can be read without it
    yaml = None

MODES = ("none", "exact", "smart")


@dataclass
class ScanConfig:
    project_paths: list[str] = field(default_factory=list)
    excluded_patterns: list[str] = field(default_factory=list)
    file_age_filter_days: float | None = None
    dry_run: bool = False
    database_path: str | None = None
    dedup_mode: str = "smart"
    similarity_threshold: float = 0.85
    min_content_length: int = 50
    max_alternatives: int = 5
    incremental: bool = True
    resume_on_failure: bool = True

    def __post_init__(self):
        if self.dedup_mode not in MODES:
            raise ValueError(f"deduplication.mode must be one of {', '.join(MODES)}")
        if not 0 < self.similarity_threshold <= 1:
            raise ValueError("deduplication.similarity_threshold must be above 0 and at most 1")

    @classmethod
    def of(cls, given: dict) -> ScanConfig:
        """From the sections of a file; what it does not name has its default, other sections are left to their readers."""
        flat = {k: v for k, v in given.items() if k in {f.name for f in fields(cls)}}
        d, e, s = (given.get(k) or {} for k in ("deduplication", "extraction", "scan_mode"))
        if "mode" in d or "enabled" in d:
            flat["dedup_mode"] = d.get("mode", "smart") if d.get("enabled", True) else "none"
        for section, names in ((d, ("similarity_threshold",)), (e, ("min_content_length", "max_alternatives")), (s, ("incremental", "resume_on_failure"))):
            flat |= {n: section[n] for n in names if section.get(n) is not None}
        return cls(**{k: v for k, v in flat.items() if v is not None or k in ("file_age_filter_days", "database_path")})

    @classmethod
    def load(cls, path: str) -> ScanConfig:
        with open(path) as f:
            if path.endswith(".json"):
                return cls.of(json.load(f))
            if yaml is None:
                raise ImportError("reading YAML needs the yaml package; a .json file of the same sections needs none")
            return cls.of(yaml.safe_load(f) or {})


def listing(spark: SparkSession, config: ScanConfig, now: datetime.datetime | None = None) -> DataFrame:
    """path, text, file_size, last_modified (seconds), content_hash, project_id (the root's name) of the Markdown files below the roots that are there."""
    newer = None
    if config.file_age_filter_days is not None:
        newer = ((now or datetime.datetime.now()) - datetime.timedelta(days=config.file_age_filter_days)).strftime("%Y-%m-%dT%H:%M:%S")
    found = None
    for root in config.project_paths:
        if not os.path.isdir(root):
            continue
        files = markdown(spark, root, exclude=config.excluded_patterns, newer_than=newer).withColumn("project_id", F.lit(os.path.basename(root.rstrip("/"))))
        found = files if found is None else found.union(files)
    if found is None:
        return spark.createDataFrame([], "path string, text string, file_size long, last_modified double, content_hash string, project_id string")
    path = F.regexp_replace("path", r"^file:/*", "/")
    return found.select(path.alias("path"), "text", "file_size", F.col("modified").cast("double").alias("last_modified"), "content_hash", "project_id").dropDuplicates(["path"])


def due(config: ScanConfig, files: DataFrame, tracker: Tracker) -> DataFrame:
    """The files to read: all, or, incrementally, the new and changed ones, with those that an interrupted scan left in work."""
    if not config.incremental:
        return files
    new = tracker.to_scan(files)
    if config.resume_on_failure:
        left = tracker.files().where("scan_status in ('processing', 'failed')").select(F.col("normalized_path").alias("_p"))
        again = files.join(left, normalised_path(F.col("path")) == F.col("_p"), "left_semi")
        new = new.unionByName(again).dropDuplicates(["path"])
    return new


def scan(spark: SparkSession, config: ScanConfig, tracker: Tracker, batch: int, at: str, known: DataFrame | None = None) -> DataFrame:
    """Sections of known classes (path, project_id, place, class, text and their fields, content_hash) of the files that are due.

    Three batches of the tracker from `batch` on: files are in work, then completed. A dry run tells the files and writes nothing.
    Duplicates: exact drops sections whose normalised text came before (in this scan or in `known`: text); smart also those like a
    known one by the threshold.
    """
    files = listing(spark, config)
    files = cut(due(config, files, tracker))
    if config.dry_run:
        return files.select("path", "project_id", "file_size")
    when, session = F.lit(at).cast("timestamp_ntz").alias("at"), F.lit(batch).cast("long").alias("session")
    tracker.begin(batch, at, files.count())
    work = files.select(normalised_path(F.col("path")).alias("normalized_path"), "file_size", "last_modified", "content_hash", "project_id", when, session)
    tracker.put(work, batch)
    parts = extract.sections(files, "path", least=config.min_content_length).join(files.select("path", "project_id"), "path")
    parts = parts.withColumn("key", F.concat_ws(":", "path", F.lpad("place", 6, "0")))
    if config.dedup_mode != "none":
        parts = dedup.exact(parts, "text", "key").where("NOT is_duplicate").drop("canonical", "is_duplicate")
        if known is not None:
            parts = parts.join(known.select(dedup.normalised_hash(F.col("text")).alias("content_hash")).distinct(), "content_hash", "left_anti")
            if config.dedup_mode == "smart":
                old = known.select(F.col("text"), F.concat(F.lit("known:"), F.md5("text")).alias("key")).distinct()
                like = dedup.best_match(parts.select("key", "text"), old, "key", "text", config.similarity_threshold)
                parts = parts.join(like.select(F.col("new_id").alias("key")), "key", "left_anti")
    found = extract.section_nodes(parts.drop("key"))
    found = cut(found.withColumn("alternatives", F.slice("alternatives", 1, config.max_alternatives)))
    tracker.mark(work.select("normalized_path", "at", "session", F.lit(None).cast("string").alias("error_message")), "completed", batch + 1)
    tracker.end(batch, at)
    return found
