"""Operators without a query of their own, on small inputs with known answers."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from graphloom.api import KnowledgeGraph
from graphloom.functions import text as X
from graphloom.operators import analytics, dedup, extract, relate, stats, traverse, vectors
from graphloom.sources import files
from graphloom.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_readers(spark, tmp_path):
    for name, text in (("a/x.md", "# One"), ("a/.hidden/y.md", "no"), ("a/venv/z.md", "no"), ("a/skip_me.md", "no"), ("a/n.txt", "no")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = files.markdown(spark, str(tmp_path / "a"), exclude=("venv", "*skip*")).collect()
    assert [(r.text, r.file_size, r.content_hash) for r in got] == [("# One", 5, spark.range(1).select(F.md5(F.lit("# One"))).first()[0])]
    assert files.markdown(spark, str(tmp_path / "a"), newer_than="2999-01-01T00:00:00").count() == 0
    (tmp_path / "q.txt").write_text("# no\n\n  one \ntwo\n")
    assert sorted(r["query"] for r in files.query_list(spark, str(tmp_path / "q.txt")).collect()) == ["one", "two"]
    for name in ("p1/README.md", "p2/none.txt", ".p3/README.md", "venv/README.md"):
        (tmp_path / "w" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "w" / name).write_text("x")
    assert [p["id"] for p in files.projects(str(tmp_path / "w"))] == ["w_p1"]
    answers = ['{"results": {"results": [{"id": "a", "document": "x", "distance": 0.25}]}}', '[{"conversation_id": "b", "content": "y"}]']
    assert sorted((r.conversation_id, r.content, r.relevance_score) for r in files.search_results(spark, answers).collect()) == [("a", "x", 0.75), ("b", "y", 0.5)]


def test_report(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "n int, t string")
    files.write_report(rows, str(tmp_path / "r"), "Numbers")
    assert "| 2 | b |" in (tmp_path / "r.md").read_text()
    with pytest.raises(ValueError):
        files.write_report(rows, str(tmp_path / "r"), "Numbers", most=1)


def test_extraction(spark):
    long_ = "Title line\n" + "words of it " * 20
    docs = spark.createDataFrame([(1, f"intro\n## {long_}\n## short"), (2, "x" * 120), (3, "small")], "doc_id int, text string")
    got = {(r.doc_id, r.name) for r in extract.second_level_patterns(docs).collect()}
    assert got == {(1, "Title line"), (2, "x" * 80)}
    row = extract.capped(spark.createDataFrame([("d" * 300, ["a"] * 9)], "description string, alternatives array<string>")).first()
    assert (len(row.description), len(row.alternatives)) == (200, 5)
    said = extract.by_model(spark.createDataFrame([(k, "t" * (50 + 100 * k)) for k in range(3)], "doc_id long, text string"), lambda texts: [str(len(t)) for t in texts])
    assert sorted((r.doc_id, r.answer) for r in said.collect()) == [(1, "150"), (2, "250")]
    each = extract.by_model_each(spark.createDataFrame([(1, "t" * 3000)], "doc_id long, text string"), lambda texts: [f"{len(texts)} {len(texts[0])}"])
    assert each.first().answer == "1 2000"
    assert tuple(spark.range(1).select(*X.source_tags(F.lit("alpha_1")), *X.source_tags(F.lit("other"))).first()) == (*X.TAGS[0], *X.TAGS[1])


def test_gather_orders_by_relevance(spark):
    hits = spark.createDataFrame([(1, 1, "a", 0.2), (1, 2, "b", 0.9), (2, 1, "a", 1.0), (2, 2, "c", 0.5), (2, 3, "d", 0.8)], "query_no int, rank int, id string, relevance_score double")
    got = extract.gather(hits, spark.createDataFrame([("d",)], "id string"), ordered=True).collect()
    assert [(r.id, r.relevance_score) for r in got] == [("b", 0.9), ("c", 0.5), ("a", 0.2)]


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "path string, n int")
    got = dedup.upsert(old, spark.createDataFrame([("b", 9), ("c", 3)], "path string, n int"), "path")
    assert sorted(tuple(r) for r in got.collect()) == [("a", 1), ("b", 9), ("c", 3)]


def test_relations(spark):
    texts = spark.createDataFrame([("n1", "caching with redis everywhere"), ("k1", "redis was chosen"), ("k2", "nothing of the kind"), ("k3", "caching layers")], "id string, text string")
    found = relate.related_by_keyword(texts.where("id = 'n1'"), texts.where("id <> 'n1'"), lambda t: F.split(t, " "))
    assert sorted(tuple(r) for r in found.collect()) == [("n1", "k1"), ("n1", "k3")]
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0])], "id string, embedding array<float>")
    like = relate.similarity_edges(vectors, 0.7)
    assert sorted((r.src, r.dst, round(r.weight, 2)) for r in like.collect()) == [("a", "b", 0.6), ("b", "a", 0.6)]
    named = relate.reclassified(like, lambda frames: (f.assign(rel_type="ALTERNATIVE_TO") for f in frames))
    assert {r.rel_type for r in named.collect()} == {"ALTERNATIVE_TO"} and relate.reclassified(like) is like
    more = spark.createDataFrame([("a", "b", "SEMANTICALLY_SIMILAR", 0.9), ("a", "x", "R", 1.0)], like.schema)
    new = relate.new_edges({"one": like, "two": more}, vectors)
    assert sorted((r.src, r.dst, round(r.weight, 2)) for r in new.collect()) == [("a", "b", 0.9), ("b", "a", 0.6)]


@pytest.mark.parametrize("own,shared,step", [(5, 3, 4), (50, 20, 7), (3072, 1024, 1024)])
def test_word_overlap_joins_blocks_only(spark, monkeypatch, own, shared, step):
    """One join, of blocks: no row for a word that two sets share. Columns that words share lose no pair."""
    import random

    for name, value in (("OWN", own), ("SHARED", shared), ("STEP", step)):
        monkeypatch.setattr(relate, name, value)
    r = random.Random(4)
    texts = [(k, " ".join(f"word{int(60 * r.random() ** 2)}" for _ in range(r.randint(0, 30)))) for k in range(60)]
    df = spark.createDataFrame(texts, "id long, text string")
    found = relate.word_overlap(df, df, 0.3, 1.0, split=200)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1
    sets = {k: set(t.split()) for k, t in texts}
    want = {(a, b): len(x & y) / len(x | y) for a, x in sets.items() for b, y in sets.items() if a != b and x and y and len(x & y) / len(x | y) > 0.3}
    assert {(q.src, q.dst): q.weight for q in found.collect()} == pytest.approx(want) and len(want) > 20


@pytest.mark.parametrize("split", [1, 2, 20_000])
def test_word_overlap_against_all_pairs(spark, split):
    import random

    r = random.Random(3)
    words = [f"word{k}" for k in range(60)]
    side = lambda n: [(f"{n}{k}", " ".join(r.choice(words[: r.choice((8, 20, 60))]) for _ in range(r.randint(0, 40)))) for k in range(40)]
    a, b = side("a"), side("b")
    for above in (0.3, 0.5, 0.8):
        got = relate.word_overlap(spark.createDataFrame(a, "id string, text string"), spark.createDataFrame(b, "id string, text string"), above, 1.0, split=split)
        want = {}
        for i, x in a:
            for j, y in b:
                x_, y_ = set(x.split()), set(y.split())
                if x_ and y_ and len(x_ & y_) / len(x_ | y_) > above:
                    want[i, j] = pytest.approx(len(x_ & y_) / len(x_ | y_))
        assert {(e.src, e.dst): e.weight for e in got.collect()} == want and (want or above > 0.3)


def test_sessions_of_events(spark):
    got = jobs.sessions(spark, SF)
    events = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "ts").toPandas().sort_values(["user_id", "ts"])
    new = (events.user_id != events.user_id.shift()) | (events.ts - events.ts.shift() >= pd.Timedelta("30 minutes"))
    assert got.count() == int(new.sum()) and got.agg(F.sum("n")).first()[0] == len(events)


def test_label_propagation_settles_where_labels_would_swing(spark):
    nodes = spark.createDataFrame([(k,) for k in range(8)], "id long")
    edges = spark.createDataFrame([(a, b) for a in range(4) for b in range(4, 8)], "src long, dst long")
    found = {r.id: r.community for r in analytics.label_propagation(nodes, edges, rounds=1).collect()}
    assert len(found) == 8 and len(set(found.values())) <= 2


def test_reports_on_missing_edges(spark):
    nodes = spark.createDataFrame([(c, "x") for c in "abcd"], "id string, community string")
    edges = spark.createDataFrame([("a", "b", "R", 1.0), ("b", "c", "R", 1.0), ("c", "d", "R", 1.0)], "src string, dst string, rel_type string, weight double")
    low = analytics.gap_reports(nodes.select("id"), edges, communities=nodes, listed=2).where("severity = 'LOW'").first()
    assert (low.affected_nodes, low.recommendation, low.metrics) == (["a", "b"], "Add 3 missing connections within communities", {"potential_connections": 3.0, "count": 4.0})
    assert sorted((r.id, r.missing) for r in analytics.weak_members(nodes, edges).collect()) == [("a", 2), ("b", 1), ("c", 1), ("d", 2)]
    gaps = analytics.community_pair_gaps(nodes.withColumn("community", F.when(F.col("id") < "c", "x").otherwise("y")), edges.where("src <> 'b'"))
    assert [tuple(r) for r in analytics.severities(gaps).collect()] == [("disconnected_clusters", "HIGH", 1)] and analytics.critical(gaps, ["c1"]).count() == 1
    assert analytics.questions(gaps).count() == 3


def test_topics(spark):
    rows = spark.createDataFrame([("g", 1, ["a", "b"]), ("g", 2, ["b"]), ("g", 3, ["a", "a", "c"]), ("h", 1, ["z"])], "g string, no int, words array<string>")
    assert [tuple(r) for r in analytics.topics(rows, "words", "g", 1).orderBy("g").collect()] == [("g", "a", 3), ("h", "z", 1)]
    assert [tuple(r) for r in analytics.topics(rows, "words", "g", 1, nodes=2, order="no").orderBy("g").collect()] == [("g", "b", 2), ("h", "z", 1)]


def test_paths(spark):
    rows = [("a", "b", "R"), ("a", "b", "S"), ("b", "c", "R"), ("a", "d", "R"), ("d", "c", "R"), ("c", "e", "R"), ("b", "d", "R"), ("a", "a", "R")]
    edges = spark.createDataFrame(rows, "src string, dst string, rel_type string")

    def brute(start, end, most, directed):
        links = {(a, b, t) for a, b, t in rows if a != b} | (set() if directed else {(b, a, t) for a, b, t in rows if a != b})
        out, walks = [], [([start], [])]
        for _ in range(most):
            walks = [([*p, b], [*ts, t]) for p, ts in walks for a, b, t in links if a == p[-1] and b not in p and p[-1] != end]
            out += [(tuple(p), tuple(ts), len(ts)) for p, ts in walks if p[-1] == end]
        return sorted(out)

    for start, end, most, directed in (("a", "c", 4, False), ("a", "e", 3, False), ("a", "c", 1, False), ("a", "e", 5, True), ("e", "a", 5, True), ("a", "b", 2, False)):
        got = traverse.all_paths(edges, start, end, most, directed).collect()
        assert sorted((tuple(r.path), tuple(r.types), r.length) for r in got) == brute(start, end, most, directed)


def test_edge_quality(spark):
    edges = spark.createDataFrame([("R", "why", 0.5), ("SEMANTICALLY_SIMILAR", "", None), ("R", None, 0.1)], "rel_type string, reasoning string, weight double")
    assert tuple(stats.edge_quality(edges).first()) == (3, 1, 2, pytest.approx(2 / 3))


def test_resources_prompts_and_metrics(spark, tmp_path):
    kg = KnowledgeGraph(spark, str(tmp_path / "g"))
    assert "No knowledge" in kg.resource("stats")
    kg.add_decision("Use one log only", "There were too many of them before")
    assert '"isolated_count": 1' in kg.resource("gaps") and "**Nodes**: 1" in kg.resource("stats")
    assert "caches" in kg.prompt("analyze_architecture", topic="caches") and "system design" in kg.prompt("analyze_architecture") and "detect_gaps" in kg.prompt("find_knowledge_gaps")
    for bad in (lambda: kg.resource("x"), lambda: kg.prompt("x")):
        with pytest.raises(ValueError):
            bad()
    assert kg.query_decisions("the log").count() == 1 and kg.search_metrics()["searches"] == 1 and kg.search_metrics()["keywords"] == 1
    assert KnowledgeGraph(spark, str(tmp_path / "h")).search_metrics()["planning_ms"] == 0.0


def test_a_type_is_read_from_its_folder(spark, tmp_path):
    kg = KnowledgeGraph(spark, str(tmp_path / "g"))
    kg.add_decision("Use one log only", "There were too many of them before")
    kg.add_pattern("One log", "Write everything to one place", context="Services of all kinds")
    plan = kg.nodes.where("type = 'Pattern'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(type" in plan and kg.nodes.where("type = 'Pattern'").count() == 1
    assert isinstance(kg.nodes.first().timestamp, datetime.datetime)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_products_of_several_blocks(spark, monkeypatch, kind):
    """Pairs without an order meet once, in one of the two orders of their blocks; blocks are bounded by their components."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(k * 7 % 300, v.tolist()) for k, v in enumerate(x)] + [(900, None), (901, [0.0] * 6)], f"id long, embedding array<{kind}>")
    ids = np.arange(300) * 7 % 300
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    cosine = np.zeros((300, 300))
    cosine[np.ix_(ids, ids)] = unit @ unit.T
    monkeypatch.setattr(vectors, "CELLS", 6 * 70)
    got = [(r.a, r.b, round(r.score, 9)) for r in vectors.similar_pairs(df, 0.7).collect()]
    assert sorted(got) == [(a, b, round(float(cosine[a, b]), 9)) for a in range(300) for b in range(a + 1, 300) if cosine[a, b] >= 0.7]
    near = {(r.src, r["rank"]): r.dst for r in vectors.nearest(df, 5).collect()}
    assert near == {(a, k + 1): b for a in range(300) for k, b in enumerate([b for b in sorted(range(300), key=lambda b: (-cosine[a, b], b)) if b != a][:5])}


def test_components_and_counts_leave_no_row_for_each_pair(spark, monkeypatch):
    """Three tight groups, of which two touch: thousands of similar pairs, but links and counts no more than vectors of the blocks that meet."""
    rng = np.random.default_rng(6)
    x = np.repeat(np.eye(3), 60, 0) + rng.normal(size=(180, 3)) * 0.02
    x = np.concatenate([x, [[1.0, 1.0, 0.0]], [[-1.0, -1.0, -1.0]]])
    group = [None if k % 17 == 3 else k % 4 for k in range(182)]
    df = spark.createDataFrame([(k, v.tolist(), g) for k, (v, g) in enumerate(zip(x, group))] + [(900, None, 1)], "id long, embedding array<double>, part int")
    monkeypatch.setattr(vectors, "CELLS", 3 * 50)
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    pairs = [(a, b) for a in range(182) for b in range(a + 1, 182) if unit[a] @ unit[b] >= 0.6]
    forest = vectors.similar_forest(df, 0.6)
    assert len(pairs) > 5000 and forest.count() < 4 * 182 * 4
    assert all(a < b for a, b in forest.collect())
    edges = lambda rows: spark.createDataFrame(rows, "src long, dst long")
    same = lambda e: sorted(tuple(r) for r in analytics.components(df.select("id"), e).collect())
    found = same(forest.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    assert found == same(edges(pairs)) and len({c for _, c in found}) == 4
    parts = df.select("id", F.col("part").cast("long").alias("community"))
    counted = vectors.similar_counts(df, 0.6, "part")
    as_set = lambda d: sorted((tuple(r) for r in d.select("c1", "c2", "edges").collect()), key=str)
    assert as_set(counted) == as_set(analytics.community_edges(parts, edges(pairs)))
    for f in (analytics.weak_connections, analytics.community_pair_gaps, analytics.modularity):
        rows = lambda d: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.collect()), key=str)
        assert rows(f(parts, edges(pairs))) == rows(f(parts, counts=counted))
