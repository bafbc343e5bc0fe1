"""The tools from SQL against the same tools of the API."""

import pytest
from pyspark.sql import functions as F

from graphloom import tools
from graphloom.api import KnowledgeGraph
from graphloom.operators import nodes as N
from graphloom.schema import EDGE, NODE, conform
from graphloom.sources import driver_tables as S

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("graph"))
    nodes = conform(S.nodes(spark, SF).where("doc_id < 60"), NODE)
    N.write(nodes, f"{at}/nodes")
    edges = N.related_edges(nodes).join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select(*EDGE.names)
    edges.write.parquet(f"{at}/edges")
    kg = KnowledgeGraph(spark, at)
    tools.register(kg)
    return kg


def rows(df, *columns):
    return [tuple(round(v, 9) if isinstance(v, float) else v for v in (r[c] for c in columns)) for r in df.collect()]


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_find_related(spark, graph, depth):
    start = graph.nodes.orderBy("timestamp").offset(29).first().id
    got = spark.sql(f"SELECT id, distance, type FROM find_related('{start}', {depth})")
    assert sorted(rows(got, "id", "distance", "type")) == sorted(rows(graph.find_related(start, depth), "id", "distance", "type")) and got.count() == 2 * depth


def test_find_related_default_and_join(spark, graph):
    start = graph.nodes.orderBy("timestamp").offset(10).first().id
    assert spark.sql(f"SELECT count(*) FROM find_related('{start}') r JOIN kg_nodes n ON n.id = r.id").first()[0] == 2
    assert spark.sql("SELECT * FROM find_related('nobody', 3)").count() == 0


@pytest.mark.parametrize("topic,a,b", [("Ting", "2024-01-02 00:00:00", "2024-02-02 00:00:00"), ("", "2024-01-02", "2024-01-03"), ("x", "2024-02-02", "2024-01-02"), ("x", "no time", "2024-01-02")])
def test_get_timeline(spark, graph, topic, a, b):
    columns = ("timestamp", "type", "id", "content")
    assert rows(spark.sql(f"SELECT * FROM get_timeline('{topic}', '{a}', '{b}')"), *columns) == rows(graph.get_timeline(topic, a, b), *columns)


@pytest.mark.parametrize("question", ["what was made about thing and the ting or tion in Q1 2024", "how about thing", "ting in Q2 2031", "the", "over the Café über tion"])
def test_query_decisions(spark, graph, question):
    columns = ("id", "content", "score", "rrf")
    assert rows(spark.sql(f"SELECT * FROM query_decisions('{question}')"), *columns) == rows(graph.query_decisions(question), *columns)


def test_detect_gaps(spark, graph):
    assert spark.sql("SELECT * FROM detect_gaps()").collect() == graph.detect_gaps().collect()


def test_adding(spark, graph):
    before = graph.nodes.count()
    spark.sql("INSERT INTO kg_nodes BY NAME SELECT * FROM add_decision(description => 'Use one log', rationale => 'There were too many of them before', alternatives => array('two logs', ' '))")
    spark.sql("INSERT INTO kg_nodes BY NAME SELECT * FROM add_pattern(name => 'One log', implementation => 'Write everything to one place', context => 'Services of all kinds', use_cases => array('x'))")
    spark.sql("INSERT INTO kg_nodes BY NAME SELECT * FROM add_failure(attempt => 'Two logs here', reason_failed => 'They went out of step', lesson_learned => 'Write everything to one place only')")
    added = spark.sql("SELECT * FROM kg_nodes WHERE description = 'Use one log' OR name = 'One log' OR attempt = 'Two logs here' ORDER BY type").collect()
    assert [(r.id[:2], r.type) for r in added] == [("D-", "Decision"), ("F-", "Failure"), ("P-", "Pattern")] and added[0].alternatives == ["two logs"]
    assert graph.nodes.count() == before + 3
    assert spark.sql("SELECT id FROM query_decisions('log')").count() >= 3
    with pytest.raises(Exception, match="rationale must have 20 to 2000 characters"):
        spark.sql("SELECT * FROM add_decision(description => 'Use one log', rationale => 'short')").collect()
    with pytest.raises(Exception, match="no such field"):
        spark.sql("SELECT * FROM add_pattern(name => 'x', size => 3)").collect()
