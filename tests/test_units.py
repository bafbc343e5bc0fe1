"""Operators on small inputs with known answers."""

import pytest
from pyspark.sql import functions as F

from graphloom.api import KnowledgeGraph
from graphloom.functions import text as X
from graphloom.operators import dedup, extract, nodes, relate, search


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("r")).first().r


def test_fusion(spark):
    g = spark.createDataFrame([("x", 1), ("y", 2), ("x", 3)], "key string, rank int")
    v = spark.createDataFrame([("y", 1)], "key string, rank int")
    found = {r.key: r.score for r in search.fuse([g, v]).collect()}
    assert found == pytest.approx({"x": 1 / 61 + 1 / 63, "y": 1 / 62 + 1 / 61}) and found["y"] > found["x"]


@pytest.mark.parametrize("a,b,weight", [("alpha beta gamma", "beta gamma delta", 0.5), ("alpha beta", "beta alpha", 0.8), ("aaaa bbbb cccc dddd eeee ffff gggg", "aaaa bbbb cccc hhhh iiii jjjj", None)])
def test_word_overlap(spark, a, b, weight):
    of = lambda i, t: spark.createDataFrame([(i, t)], "id string, text string")
    found = [r.weight for r in relate.word_overlap(of("p", a), of("d", b)).collect()]
    assert found == ([] if weight is None else [pytest.approx(weight)])


def test_prefix_and_cap(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], "id int, text string")
    assert [r.id for r in dedup.first_of_prefix(texts, "text", "id").orderBy("id").collect()] == [1, 2, 4]
    same = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "c")], "id int, text string")
    assert [r.id for r in dedup.pattern_cap(same, "text", "id", 2).orderBy("id").collect()] == [1, 2, 4]


def test_clean_list(spark):
    df = spark.createDataFrame([(["a", " ", "", None],)], "l array<string>")
    assert df.select(nodes.clean_list(F.col("l"))).first()[0] == ["a"]


@pytest.mark.parametrize("n,ok", [(9, False), (10, True), (1000, True), (1001, False)])
def test_bounds(spark, n, ok):
    if ok:
        assert nodes.new_row(spark, "Decision", description="x" * n, rationale="r" * 20).count() == 1
    else:
        with pytest.raises(ValueError):
            nodes.new_row(spark, "Decision", description="x" * n, rationale="r" * 20)


def test_words(spark):
    assert one(spark, "What about caching in Q3 2024", X.query_words(F.col("t"))) == ["caching"]
    a, b = X.quarter_bounds(F.col("t"))
    assert str(one(spark, "in Q1 2024", b)) == "2024-03-31" and str(one(spark, "in q4 2023", a)) == "2023-10-01"
    assert one(spark, "none", a) is None
    assert one(spark, "We chose A over B, instead of C. Done", X.scored_class(F.col("t"))) == "decision"
    assert one(spark, "nothing here", X.scored_class(F.col("t"))) is None
    assert one(spark, "<think>x</think>```json\n{\"type\": \"pattern\"}\n```", X.repaired_json(F.col("t"))) == '{"type": "pattern"}'
    assert one(spark, "/mnt/D/A/b.md", X.normalised_path(F.col("t"))) == "d:/a/b.md"


def test_sections(spark):
    md = "intro\n# A decision on caching\nWe chose Redis because it is fast and simple.\ninstead of memcached\n# Other\nnothing\n# The failure\n" + "x" * 30
    df = spark.createDataFrame([(1, md), (2, None), (3, ""), (4, "# decision\n" + "y" * 39), (5, "# decision\n" + "y" * 40)], "doc_id int, text string")
    found = extract.section_nodes(extract.sections(df)).orderBy("doc_id").collect()
    assert [(r.doc_id, r["class"]) for r in found] == [(1, "decision"), (5, "decision")]
    assert found[0].description.startswith("We chose Redis") and found[0].alternatives == ["instead of memcached"]


def test_windowed(spark):
    df = spark.createDataFrame([("c", "first we decided to use parquet files everywhere. end"), ("d", None)], "conv_id string, text string")
    rows = extract.windowed(df).collect()
    assert [(r["class"], r.capture) for r in rows] == [("decision", "use parquet files everywhere. end")]


def test_best_match(spark):
    new = spark.createDataFrame([(1, "the quick brown fox jumps over the dog"), (2, "something else entirely, not alike")], "id int, text string")
    known = spark.createDataFrame([(10, "the quick brown fox jumps over the log"), (11, "the quick brown fox")], "id int, text string")
    assert [(r.new_id, r.known_id) for r in dedup.best_match(new, known, "id", "text").collect()] == [(1, 10)]


def test_best_match_against_all_pairs(spark):
    import difflib
    import random

    r = random.Random(3)
    words = [[r.choice("lorem ipsum dolor sit amet consectetur adipiscing elit sed do".split()) for _ in range(r.randint(2, 90))] for _ in range(12)]
    texts = ["hello world", "hello worlds", "one middle end", "one muddle end", "Hello   World", "", "", None, "a b" + " " * 40 + "c", "a b c d"]
    texts += [" ".join(w) for w in words] + [" ".join(x[:-1] + "q" if k % 2 else x for k, x in enumerate(w)) for w in words]
    rows = list(enumerate(texts))
    norm = lambda t: " ".join(t.lower().split())
    want = []
    for i, x in rows:
        ratios = [(-difflib.SequenceMatcher(None, norm(x), norm(y)).ratio(), j) for j, y in rows if j != i and x is not None and y is not None]
        if ratios and -min(ratios)[0] >= 0.85:
            want.append((i, min(ratios)[1], -min(ratios)[0]))
    df = spark.createDataFrame(rows, "id int, text string")
    assert sorted(map(tuple, dedup.best_match(df, df, "id", "text").collect())) == want and {0, 1, 2, 3} <= {w[0] for w in want}


def test_fuzzy_query_reads_all_documents(spark, tmp_path):
    from graphloom.plans import queries as plans

    long = " ".join(f"word{k * k % 97}" for k in range(120))
    rows = [(1, long, 700), (2, long + " end", 704), (3, "short text here", 15), (4, "short text heré", None)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.new_id for r in plans.queries()["fuzzy_difflib"](spark, str(tmp_path)).collect()) == [1, 2, 3, 4]


def test_tools(spark, tmp_path):
    kg = KnowledgeGraph(spark, f"file://{tmp_path}")
    assert kg.query_decisions("anything").count() == 0
    first = kg.call("add_decision", description="Use Parquet for storage", rationale="Columnar files are fast to scan")["decision_id"]
    second = kg.call("add_decision", description="Use Spark for queries", rationale="It reads Parquet files well", related_to=[first, "D-missing0"])["decision_id"]
    kg.call("add_pattern", name="Batching", implementation="Write many rows at a time", context="Any storage layer")
    kg.call("add_failure", attempt="Row by row writes", reason_failed="It was far too slow", lesson_learned="Always write in batches of rows")
    assert kg.nodes.count() == 4 and kg.edges.count() == 1
    assert [r.id for r in kg.call("find_related", node_id=first, depth=1).collect()] == [second]
    assert first in [r.id for r in kg.call("query_decisions", query="what about parquet").collect()]
    assert kg.call("get_timeline", topic="parquet", start="2020-01-01", end="2100-01-01").count() == 2
    assert kg.call("get_timeline", topic="", start="2100-01-01", end="2020-01-01").count() == 0
    assert kg.call("detect_gaps").first().isolated_count == 2
    assert kg.clusters().count() == 4 and kg.search("Batching").count() == 1 and kg.usage["add_decision"] == 2
    with pytest.raises(ValueError):
        kg.call("no_tool")


def test_partitions_do_not_matter(spark):
    from graphloom.plans import queries as plans

    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted(map(tuple, plans.queries()["hierarchy_jaccard"](spark, "/root/testdata/sf0.001").collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1]
