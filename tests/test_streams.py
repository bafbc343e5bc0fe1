"""Ledgers, trackers and state of streams."""

import datetime
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from graphloom.schema import EDGE
from graphloom.session import shared_folder
from graphloom.streaming import ledger, state

T0 = datetime.datetime(2024, 1, 1)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def edge_rows(spark, *rows):
    return spark.createDataFrame([(*r, None, None, None) for r in rows], EDGE)


def test_a_batch_run_twice_gives_one_result(spark, tmp_path):
    nodes = spark.createDataFrame([(c,) for c in "abcd"], "id string")
    table = ledger.BatchTable(spark, str(tmp_path / "edges"), EDGE)
    first = edge_rows(spark, ("a", "b", "R", 0.5), ("a", "b", "R", 0.7), ("a", "x", "R", 1.0), ("b", "c", "R", 0.1))
    second = edge_rows(spark, ("a", "b", "R", 0.9), ("c", "d", "R", 0.2))
    for _ in range(2):
        ledger.append_edges(table, first, nodes, 0)
    for _ in range(2):
        ledger.append_edges(table, second, nodes, 1)
    ledger.append_edges(table, first, nodes, 0)  # an old batch comes again
    assert rows_of(table.read(), "src", "dst", "weight", "batch") == [("a", "b", 0.7, 0), ("b", "c", 0.1, 0), ("c", "d", 0.2, 1)]
    assert table.has(1) and not table.has(2) and table.read(before=1).count() == 2


def test_half_written_batch_does_not_count(spark, tmp_path):
    table = ledger.BatchTable(spark, str(tmp_path / "t"), EDGE)
    assert table.read().count() == 0
    edge_rows(spark, ("a", "b", "R", 0.5)).write.parquet(str(tmp_path / "t/rows/batch=0"))  # died before the ledger
    assert table.read().count() == 0
    table.write(edge_rows(spark, ("c", "d", "R", 0.5)), 0)
    assert rows_of(table.read(), "src") == [("c",)]


def test_replace_and_compact(spark, tmp_path):
    table = ledger.BatchTable(spark, str(tmp_path / "t"), EDGE)
    for k in range(3):
        table.write(edge_rows(spark, (f"a{k}", "b", "R", 0.5)), k)
    table.compact(2)
    assert rows_of(table.read(), "src", "batch") == [("a0", 2), ("a1", 2), ("a2", 2)]
    table.write(edge_rows(spark, ("z", "b", "R", 0.5)), 3, replaces=True)
    table.write(edge_rows(spark, ("y", "b", "R", 0.5)), 4)
    assert rows_of(table.read(), "src") == [("y",), ("z",)]


def test_stream_of_nodes(spark, tmp_path):
    known = spark.createDataFrame([("k1",), ("k2",)], "id string")
    table = ledger.BatchTable(spark, str(tmp_path / "edges"), EDGE)
    derive = lambda new, old: new.crossJoin(old.select(F.col("id").alias("dst"))).select(F.col("id").alias("src"), "dst", F.lit("R").alias("rel_type"), F.lit(0.5).alias("weight"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in EDGE.fields[4:]))
    told = []
    for k in range(2):
        spark.createDataFrame([(f"n{k}",)], "id string").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id string").parquet(str(tmp_path / "in"))
        ledger.relationships(stream, known, derive, table, str(tmp_path / "run"), lambda rows, b: told.append((b, rows.count())))
    assert rows_of(table.read(), "src", "dst") == [("n0", "k1"), ("n0", "k2"), ("n1", "k1"), ("n1", "k2")] and told == [(0, 2), (1, 2)]


def test_tracker(spark, tmp_path):
    tracker = ledger.Tracker(spark, str(tmp_path / "t"))
    found = spark.createDataFrame([(f"d:/{c}.md", 10, 1.0, f"h{c}", T0, 1) for c in "abc"], "normalized_path string, file_size long, last_modified double, content_hash string, at timestamp_ntz, session long")
    tracker.begin(1, "2024-01-01 00:00:00", 5)
    tracker.put(found, 0)
    done = lambda *names: spark.createDataFrame([(f"d:/{c}.md", T0 + datetime.timedelta(hours=1), 1, f"bad {c}") for c in names], "normalized_path string, at timestamp_ntz, session long, error_message string")
    for _ in range(2):
        tracker.mark(done("a", "nobody"), "completed", 1)
        tracker.mark(done("b"), "failed", 2)
    assert rows_of(tracker.files(), "normalized_path", "scan_status", "error_message", "file_size") == [("d:/a.md", "completed", None, 10), ("d:/b.md", "failed", "bad b", 10), ("d:/c.md", "processing", None, 10)]
    running = tracker.sessions().first()
    assert (running.total_files, running.processed_files, running.failed_files, running.skipped_files, running.status) == (5, 1, 1, 2, "running")
    tracker.end(1, "2024-01-01 02:00:00")
    assert tracker.sessions().first().status == "completed" and tracker.sessions().first().end_time == T0 + datetime.timedelta(hours=2)
    before = rows_of(tracker.files(), *tracker.files().columns)
    tracker.compact(2)
    assert rows_of(tracker.files(), *tracker.files().columns) == before
    listing = spark.createDataFrame([("/mnt/d/a.md", 10, 1.0, "ha"), ("/mnt/d/b.md", 11, 1.0, "hb"), ("/mnt/d/c.md", 99, 2.0, "x"), ("/mnt/d/new.md", 1, 1.0, "n")], "path string, file_size long, last_modified double, content_hash string")
    assert rows_of(tracker.to_scan(listing), "path") == [("/mnt/d/b.md",), ("/mnt/d/new.md",)]
    with pytest.raises(ValueError):
        tracker.mark(done("a"), "unheard of", 3)


def test_breaker():
    calls = []

    def ask(x):
        calls.append(x)
        if x == "slow":
            raise TimeoutError
        if x == "bad":
            raise ValueError
        return x.upper()

    b = state.Breaker(most=2, enough=2, rest=3)
    run = lambda *items: [b.call(ask, lambda i: f"({i})", x)[1] for x in items]
    assert run("ok", "slow", "bad", "slow", "ok") == ["asked", "timeout", "error", "timeout", "asked"] and b.mode == "closed"  # an error takes one timeout back
    assert run("slow") == ["timeout"] and b.mode == "open"
    assert run("ok", "ok", "ok") == ["open"] * 3 and b.mode == "half_open"
    assert run("slow") == ["timeout"] and b.mode == "open"
    assert run("a", "b", "c", "ok", "ok") == ["open", "open", "open", "asked", "asked"] and b.state == ("closed", 0, 0, 0)


def as_stream(spark, tmp_path, df, name):
    df.write.mode("append").parquet(str(tmp_path / name))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / name))


def run_once(stream, tmp_path, name):
    q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"{name}-c")).option("path", str(tmp_path / f"{name}-out")).trigger(availableNow=True).start()
    q.awaitTermination()
    return q, stream.sparkSession.read.schema(stream.schema).parquet(str(tmp_path / f"{name}-out"))


def test_first_within_and_its_state(spark, tmp_path):
    day = lambda d, i: (i, T0 + datetime.timedelta(days=d))
    seen, kept = [], []
    for step in range(6):
        batch = [day(10 * step, f"only{step}-{k}") for k in range(50)] + [day(10 * step, "again"), day(10 * step + 1, "again"), day(10 * step + 6, f"only{step}-0")]
        stream = as_stream(spark, tmp_path, spark.createDataFrame(batch, "id string, ts timestamp_ntz"), "in")
        q, out = run_once(state.first_within(stream, "id", "ts", "7 days"), tmp_path, "first")
        kept.append(max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]))
    got = [r.id for r in out.collect()]
    assert got.count("again") == 6 and len(got) == len(set(got)) + 5 == 6 * 51
    assert kept[-1] <= kept[2] + 60  # not 300 keys


def test_guarded_stream(spark, tmp_path):
    def ask(x):
        if x.startswith("slow"):
            raise TimeoutError
        return x.upper()

    rows = [("s", k, "slow" if k < 3 else "ok") for k in range(10)] + [("t", 0, "fine")]
    df = spark.createDataFrame(rows, "service string, no long, item string")
    make = lambda: state.guarded(as_stream(spark, tmp_path, df.where("no < 5"), "g"), "service", "item", "no", ask, lambda x: "none", 3, 2, 4)
    run_once(make(), tmp_path, "guard")
    df.where("no >= 5").write.mode("append").parquet(str(tmp_path / "g"))
    stream = state.guarded(spark.readStream.schema(df.schema).parquet(str(tmp_path / "g")), "service", "item", "no", ask, lambda x: "none", 3, 2, 4)
    _, out = run_once(stream, tmp_path, "guard")
    got = {(r.service, r.no): (r.answer, r.how) for r in out.collect()}
    how = [got["s", k][1] for k in range(10)]
    assert how == ["timeout"] * 3 + ["open"] * 4 + ["asked"] * 3 and got["t", 0] == ("FINE", "asked")


def test_shared_folder_must_be_set_on_a_cluster():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session)
