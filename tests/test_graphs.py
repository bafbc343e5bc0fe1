"""Hand-made graphs with known answers."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import analytics as A
from graphloom.operators import traverse as G


def graph(spark, nodes, edges):
    n = spark.createDataFrame([(x,) for x in nodes], "id string")
    return n, spark.createDataFrame([(*e, "R", 1.0) for e in edges], "src string, dst string, rel_type string, weight double")


def table(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


TRIANGLES = ("abcdef", [("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("e", "f"), ("f", "d"), ("c", "d")])


def test_path(spark):
    n, e = graph(spark, "abcd", [("a", "b"), ("b", "c"), ("c", "d")])
    assert table(A.betweenness(n, e), "id", "score") == pytest.approx({"a": 0, "b": 2 / 3, "c": 2 / 3, "d": 0})
    assert G.shortest_path(e, "a", "d").first() == (["a", "b", "c", "d"], 3)
    assert G.shortest_path(e, "a", "d", 2).count() == 0


def test_star(spark):
    n, e = graph(spark, "xabcd", [("x", c) for c in "abcd"])
    assert table(A.betweenness(n, e), "id", "score") == pytest.approx({"x": 1, "a": 0, "b": 0, "c": 0, "d": 0})
    assert table(A.clustering(n, e), "id", "coefficient")["x"] == 0


@pytest.mark.parametrize("mode", ["shortest", "trail"])
def test_walks_from_few_ids_leave_the_edges_where_they_are(spark, monkeypatch, mode):
    """No step deals all edges out by a key: the ids or paths it starts from are small tables, and are broadcast."""
    plans = []

    def watched(df, keep=G.cut):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df)

    monkeypatch.setattr(G, "cut", watched)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 20_000)  # the edges are larger
    e = spark.range(20_000).select(F.concat(F.lit("a"), F.col("id") % 5000).alias("src"), F.concat(F.lit("a"), (F.col("id") * 7 + 1) % 5000).alias("dst"))
    try:
        got = {(r.id, r.distance) for r in G.find_related(e, spark.createDataFrame([("a3",), ("a3",)], "id string"), 2, mode).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert ("a22", 1) in got and ("a155", 2) in got
    steps = [p for p in plans if "Join" in p]
    assert len(steps) == 2 and not any("SortMergeJoin" in p or "ShuffledHashJoin" in p for p in steps)


def test_first_edge_in_a_triangle(spark):
    """The first by a, then b, whether it lies among the first ids or only triangles find it; b need not be a's first neighbour."""
    _, e = graph(spark, "", [("a", "b"), ("b", "c"), ("c", "d"), ("d", "b2"), ("d", "x"), ("x", "c"), ("y", "x"), ("y", "d"), ("b", "b")])
    for few in (1, 2, 100):
        assert G.first_in_triangle(e, few) == ("c", "d")
    _, e = graph(spark, "", [("a", "b"), ("a", "y"), ("a", "z"), ("z", "y")])
    assert G.first_in_triangle(e) == ("a", "y") and G.first_in_triangle(e.where("dst <> 'z'")) is None


def test_paths_do_not_pair_all_neighbours(spark, monkeypatch):
    """all_paths_between sorts no table of every two neighbours of every node: the neighbourhoods joined are of at most 100 ids."""
    from graphloom.plans import queries as plans

    names = []
    monkeypatch.setattr(G, "first_in_triangle", lambda e, few=100, f=G.first_in_triangle: (names.append(few), f(e, few))[1])
    assert plans.queries()["all_paths_between"](spark, "/root/testdata/sf0.001").count() > 0 and names == [100]


def test_triangle_modes(spark):
    _, e = graph(spark, "abc", [("a", "b"), ("b", "c"), ("c", "a")])
    start = spark.createDataFrame([("a",)], "id string")
    assert table(G.find_related(e, start, 3), "id", "distance") == {"b": 1, "c": 1}
    trail = {(r.id, r.distance) for r in G.find_related(e, start, 3, "trail").collect()}
    assert ("a", 3) in trail and ("b", 2) in trail
    assert G.find_related(e, start, 0).count() == 0


def test_two_triangles(spark):
    n, e = graph(spark, *TRIANGLES)
    assert table(A.betweenness(n, e), "id", "score") == pytest.approx({"a": 0, "b": 0, "c": 0.6, "d": 0.6, "e": 0, "f": 0})
    assert sum(table(A.clustering(n, e), "id", "coefficient").values()) / 6 == pytest.approx(7 / 9)
    for solve in (A.greedy_communities, A.louvain):
        found = solve(n, e)
        assert table(found, "id", "community") == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "d"}
        assert A.modularity(found, e).first()[0] == pytest.approx(5 / 14)


def test_apart_with_lone_node(spark):
    n, e = graph(spark, "abcdefz", TRIANGLES[1][:6])
    assert len(set(table(A.components(n, e), "id", "component").values())) == 3
    row = A.detect_gaps(n, e).first()
    assert (row.isolated_nodes, row.isolated_count, row.disconnected_clusters, row.largest_cluster_size) == (["z"], 1, 3, 3)
    kinds = [r.gap_type for r in A.gap_reports(n, e).collect()]
    assert sorted(kinds) == ["disconnected_clusters", "disconnected_clusters", "isolated_nodes"]


@pytest.mark.parametrize("k,severity", [(6, "CRITICAL"), (5, "HIGH")])
def test_lone_nodes(spark, k, severity):
    n, e = graph(spark, "abcdef"[:k], [])
    assert A.gap_reports(n, e).first().severity == severity


def test_empty(spark):
    n, e = graph(spark, "", [])
    row = A.detect_gaps(n, e).first()
    assert (row.isolated_count, row.disconnected_clusters, row.total_nodes, row.total_edges, row.avg_degree) == (0, 0, 0, 0, 0)


def test_parallel_edges_and_loops(spark):
    n, e = graph(spark, "ab", [("a", "b"), ("a", "a")])
    e = e.union(spark.createDataFrame([("a", "b", "S", 2.0)], e.schema))
    assert G.undirected(e).count() == 1 and G.strongest_of_each(e).count() == 3 and G.full_graph_edges(e).count() == 2
    assert G.isolated(n, e).count() == 0
