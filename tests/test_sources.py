"""Scans, files, reports and records on small inputs with known answers."""

import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from graphloom.api import KnowledgeGraph
from graphloom.functions import text as X
from graphloom.operators import dedup, extract, search, stats
from graphloom.sources import files, scan_config
from graphloom.streaming.ledger import Tracker

BODY = "We chose one log for all services because two were out of step.\nInstead of two logs there is one now."


def put(root, name, text):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


@pytest.fixture
def tree(tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    put(a, "one.md", f"# Decision: log\n{BODY}\n# Notes\n{BODY}\n# Pattern\nshort\n")
    put(a, "deep/two.md", f"# Decision: log\n{BODY}\n")
    put(a, "venv/no.md", f"# Decision\n{BODY}\n")
    put(a, ".git/no.md", f"# Decision\n{BODY}\n")
    put(b, "three.md", f"# Failure of the build\nIt failed as the disk was full and nobody looked.\nLesson: look at disks.\n")
    return tmp_path


def config(tree, **given):
    return scan_config.ScanConfig(project_paths=[str(tree / "a"), str(tree / "b"), str(tree / "none")], excluded_patterns=["venv"], **given)


def test_scan_and_scan_again(spark, tree, tmp_path):
    tracker = Tracker(spark, str(tmp_path / "t"))
    c = config(tree, dedup_mode="exact")
    assert config(tree, dry_run=True) and scan_config.scan(spark, config(tree, dry_run=True), tracker, 0, "2024-01-01 00:00:00").count() == 3 and tracker.files().count() == 0
    first = scan_config.scan(spark, c, tracker, 0, "2024-01-01 00:00:00").collect()
    assert sorted((r["class"], r.project_id) for r in first) == [("decision", "a"), ("failure", "b")]
    assert {r.scan_status for r in tracker.files().collect()} == {"completed"} and tracker.sessions().first().processed_files == 3
    assert scan_config.scan(spark, c, tracker, 10, "2024-01-02 00:00:00").count() == 0
    put(tree / "b", "four.md", f"# Decision: disk\nWe chose larger disks since the old ones were always full of logs.\n")
    put(tree / "b", "five.md", f"# Decision: log\n{BODY}\nAlso.")
    known = spark.createDataFrame([(f"# Decision: log\n{BODY}",)], "text string")
    again = scan_config.scan(spark, config(tree), tracker, 20, "2024-01-03 00:00:00", known).collect()
    assert [os.path.basename(r.path) for r in again] == ["four.md"]  # five is like what is known
    assert scan_config.scan(spark, config(tree, incremental=False, dedup_mode="none"), tracker, 30, "2024-01-04 00:00:00").count() == 5


def test_interrupted_scan_is_resumed(spark, tree, tmp_path):
    tracker = Tracker(spark, str(tmp_path / "t"))
    listed = scan_config.listing(spark, config(tree))
    tracker.put(listed.select(X.normalised_path(F.col("path")).alias("normalized_path"), "file_size", "last_modified", "content_hash"), 0)
    assert scan_config.due(config(tree), listed, tracker).count() == 3 and scan_config.due(config(tree, resume_on_failure=False), listed, tracker).count() == 0


def test_age_and_config_files(spark, tree, tmp_path):
    old = datetime.datetime.now() + datetime.timedelta(days=10)
    assert scan_config.listing(spark, config(tree, file_age_filter_days=5), old).count() == 0 and scan_config.listing(spark, config(tree, file_age_filter_days=20), old).count() == 3
    given = {"project_paths": ["/x"], "file_age_filter_days": None, "max_workers": 6, "deduplication": {"enabled": True, "mode": "exact", "similarity_threshold": 0.9}, "extraction": {"min_content_length": 40}, "scan_mode": {"incremental": False}, "graph_database": {"port": 1}}
    path = put(tmp_path, "c.json", json.dumps(given))
    c = scan_config.ScanConfig.load(path)
    assert (c.project_paths, c.dedup_mode, c.similarity_threshold, c.min_content_length, c.incremental, c.max_alternatives) == (["/x"], "exact", 0.9, 40, False, 5)
    assert scan_config.ScanConfig.of({"deduplication": {"enabled": False, "mode": "smart"}}).dedup_mode == "none"
    if scan_config.yaml:
        assert scan_config.ScanConfig.load(put(tmp_path, "c.yaml", scan_config.yaml.safe_dump(given))) == c
    with pytest.raises(ValueError):
        scan_config.ScanConfig.of({"deduplication": {"mode": "often"}})


def test_simple_scan(spark, tree):
    put(tree / "a", "rebuild/no.md", "x")
    assert sorted(os.path.basename(r.path) for r in files.simple_markdown(spark, str(tree / "a")).collect()) == ["one.md", "two.md"]


def test_json_lines(spark, tmp_path):
    put(tmp_path, "j/a.jsonl", '{"a": 1}\n\n{"a": 2}\nbroken\n{"a": 3}\n')
    put(tmp_path, "j/b.jsonl", '{"a": 9}\n')
    assert sorted(r.a for r in files.json_lines(spark, str(tmp_path / "j"), "a int").collect()) == [1, 2, 3, 9]
    assert sorted(r.a for r in files.json_lines_until_bad(spark, str(tmp_path / "j"), "a int").collect()) == [1, 2, 9]


@pytest.mark.parametrize("text,objects", [
    ('x {"a": 1} y {"b": {"c": 2}} z', ['{"a": 1}', '{"b": {"c": 2}}']), ("{ {1} {2}", ["{1}", "{2}"]), ("}{", []), ("", []), ("{{{}}}", ["{{{}}}"]), ("a } {b} é{c\n}", ["{b}", "{c\n}"]),
])
def test_balanced_objects(spark, text, objects):
    assert spark.createDataFrame([(text,)], "t string").select(X.balanced_objects(F.col("t"))).first()[0] == objects


@pytest.mark.parametrize("answer,kind", [
    ('<think>{"type": "failure"}</think>```json\n{"type": "decision"}\n```', "decision"), ('First {"type": "pattern"} and then {"type": "other"}', "pattern"), ('{"type": "none"}', None),
    ('{"type": "decision", "x": {"y": {"z": 1}}} trailing { brace', "decision"), ("no json", None), (None, None), ('{"type": "pattern"} {"type": "failure"}', "failure"), ('{"x": {"type": "decision"}}', None),
])
def test_answers(spark, answer, kind):
    got = spark.createDataFrame([(answer,)], "t string").select(F.get_json_object(X.answer_object(F.col("t")), "$.type")).first()[0]
    assert got == kind


def test_records(spark):
    text = "## One\n**ID:** d1\n**Decision:** Use one log\n**Context:** Two were too many\n**Tags:** TypeScript, logs\n## Two\n**ID:** b1\n**Breakthrough:** Logs merge\n**Technical Details:** By time\n**Difficulty:** hard\n## Three\n**ID:** n1\n**Priority:** high\n"
    got = {r.record_id: r for r in extract.record_nodes(extract.structured_records(spark.createDataFrame([(text,)], "text string"))).collect()}
    assert sorted(got) == ["b1", "d1"]
    assert (got["d1"].type, got["d1"].description, got["d1"].rationale, got["d1"].alternatives) == ("Decision", "Use one log", "Two were too many", ["Continue with errors", "Systematic fix approach"])
    assert (got["b1"].type, got["b1"].name, got["b1"].implementation, got["b1"].context, got["b1"].use_cases) == ("Pattern", "Logs merge", "By time", "Breakthrough difficulty: hard", ["Logs merge"])


def test_statistics(spark):
    same = spark.createDataFrame([(k, t) for k, t in enumerate("aaabbc")], "id int, text string")
    assert tuple(dedup.pattern_stats(same, "text", 2).first()) == (3, 1, pytest.approx(5 / 3), 2) and tuple(dedup.pattern_stats(same.limit(0), "text", 2).first()) == (0, 0, 0.0, 2)
    runs = spark.createDataFrame([(k, c) for k, c in enumerate((5, 5, 9, 7))], "no int, n long")
    assert [(r.no, r.last_count, r.new, r.needed) for r in stats.syncs(runs, "no", "n", 3).collect()] == [(3, 9, 0, False), (2, 5, 4, True), (1, 5, 0, False)]
    work = spark.createDataFrame([(1, 10, 5.0), (2, 30, 5.0)], "no int, items long, seconds double")
    got = [(r.done, r.rate, r.avg_rate, r.pct, r.eta_seconds) for r in stats.progress(work, "no", "items", "seconds", 100).orderBy("no").collect()]
    assert got == [(10, 2.0, 2.0, 10.0, 45), (40, 4.0, 3.0, 40.0, 20)]
    projects = spark.createDataFrame([("p1", "/w/p1"), ("p2", "/w/x/p2"), ("p3", "/we/p3"), ("p4", "/w")], "id string, path string")
    assert [(r.root, r.n, r.project_ids) for r in stats.projects_by_root(projects, ["/w/x", "/w/"]).orderBy("root").collect()] == [("/w", 2, ["p1", "p4"]), ("/w/x", 1, ["p2"])]


def test_status_report(spark):
    nodes = spark.createDataFrame([("a", "Decision"), ("b", "Pattern"), ("c", "Pattern")], "id string, type string")
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    rows = {r.metric: r.value for r in stats.status(nodes, edges).collect()}
    assert rows == {"nodes": 3, "edges": 1, "density": pytest.approx(1 / 6), "avg_degree": pytest.approx(2 / 3), "type Decision": 1, "type Pattern": 2}
    assert "**Nodes**: 3" in stats.status_text(stats.status(nodes, edges)) and "No knowledge" in stats.status_text(stats.status(nodes.limit(0), edges.limit(0)))


def test_timeline_export(spark, tmp_path):
    rows = spark.createDataFrame([(datetime.datetime(2024, 1, 2), "b", "x"), (datetime.datetime(2024, 1, 1), "a", "y")], "timestamp timestamp_ntz, id string, content string")
    files.write_timeline(rows, str(tmp_path / "t.json"))
    assert [r["id"] for r in json.loads((tmp_path / "t.json").read_text())] == ["a", "b"]


def test_conditions_and_neighbours(spark):
    nodes = spark.createDataFrame([("a", "Decision", "use Redis", "s1", 1), ("b", "Decision", "use redis", "s2", 3), ("c", "Failure", None, "s1", 2)], "id string, type string, description string, source string, timestamp int")
    edges = spark.createDataFrame([("a", "b", "R"), ("a", "gone", "R")], "src string, dst string, rel_type string")
    assert [r.id for r in search.having(nodes, description_has="Redis").collect()] == ["a"] and search.having(nodes, "Decision", source_in=["s1"]).count() == 1
    assert [r.id for r in search.recent(nodes, "Decision", 1).collect()] == ["b"]
    assert sorted((r.id, r.neighbour) for r in search.with_neighbours(nodes, edges, nodes).select("id", F.coalesce("neighbour", F.lit("-")).alias("neighbour")).collect()) == [("a", "b"), ("b", "-"), ("c", "-")]


def test_connect_and_pages(spark, tmp_path):
    kg = KnowledgeGraph(spark, str(tmp_path / "g"))
    a = kg.add_decision("Use one log only", "There were too many of them before")["decision_id"]
    b = kg.add_pattern("One log", "Write everything to one place", context="Services of all kinds")["pattern_id"]
    assert kg.connect_decisions(a, b, "IMPLEMENTS", 0.5)["status"] == "created" and kg.connect_decisions(a, b, "IMPLEMENTS")["status"] == "exists" and kg.edges.count() == 1
    with pytest.raises(ValueError, match="no such node: x"):
        kg.connect_decisions(a, "x")
    first = kg.page(limit=1).first().id
    assert [first, kg.page(first, 5).first().id] == sorted([a, b]) and kg.page(max(a, b)).count() == 0
