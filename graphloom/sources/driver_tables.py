"""A knowledge graph made of the driver tables, and the same in SQL.

nodes: knowledge nodes from documents. things and edges: a property graph of regions, nations, customers, suppliers
(foreign keys), conversation turns (each led to the next) and vectors (similar ones linked).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.vectors import similar_counts, similar_forest, similar_pairs

SIMILAR = 0.35


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    part = lambda a, n: F.substring("text", a, n)
    kind = F.element_at(F.array(F.lit("Decision"), F.lit("Pattern"), F.lit("Failure")), (F.col("doc_id") % 3 + 1).cast("int"))
    name = lambda key: F.concat(F.substring(kind, 1, 1), F.lit("-"), F.substring(F.md5(key.cast("string")), 1, 8))
    of = lambda t, c: F.when(F.col("type") == t, c)
    d = d.withColumn("type", kind).withColumn("id", name(F.col("doc_id")))
    return d.select(
        "doc_id", "id", "type",
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("doc_id").cast("int"))).alias("timestamp"),
        F.array(F.concat(F.lit("docs/projects/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))).alias("source_files"),
        F.col("lang").alias("source"), F.col("source").alias("project"),
        of("Decision", part(1, 1000)).alias("description"), of("Decision", part(1001, 2000)).alias("rationale"),
        of("Pattern", part(1, 100)).alias("name"), of("Pattern", part(1, 3000)).alias("implementation"), of("Pattern", part(101, 1000)).alias("context"),
        of("Failure", part(1, 1000)).alias("attempt"), of("Failure", part(1001, 2000)).alias("reason_failed"), of("Failure", part(201, 2000)).alias("lesson_learned"),
        F.when(F.col("doc_id") >= 3, F.array(F.concat(F.substring("type", 1, 1), F.lit("-"), F.substring(F.md5((F.col("doc_id") - 3).cast("string")), 1, 8)))).otherwise(F.array().cast("array<string>")).alias("related_to"),
    )


NODES_SQL = """nodes as (
    select doc_id, ['D','P','F'][(doc_id % 3 + 1)::int] || '-' || substr(md5(doc_id::varchar), 1, 8) as id,
        ['Decision','Pattern','Failure'][(doc_id % 3 + 1)::int] as type,
        timestamp '2024-01-01 00:00:00' + to_hours(doc_id::int) as timestamp,
        ['docs/projects/' || source || '/' || doc_id || '.md'] as source_files, lang as source, source as project,
        case when doc_id % 3 = 0 then substr(text, 1, 1000) end as description, case when doc_id % 3 = 0 then substr(text, 1001, 2000) end as rationale,
        case when doc_id % 3 = 1 then substr(text, 1, 100) end as name, case when doc_id % 3 = 1 then substr(text, 1, 3000) end as implementation,
        case when doc_id % 3 = 1 then substr(text, 101, 1000) end as context,
        case when doc_id % 3 = 2 then substr(text, 1, 1000) end as attempt, case when doc_id % 3 = 2 then substr(text, 1001, 2000) end as reason_failed,
        case when doc_id % 3 = 2 then substr(text, 201, 2000) end as lesson_learned,
        case when doc_id >= 3 then [['D','P','F'][(doc_id % 3 + 1)::int] || '-' || substr(md5((doc_id - 3)::varchar), 1, 8)] else []::varchar[] end as related_to
    from documents)"""


def similar(spark: SparkSession, sf_dir: str, threshold: float = SIMILAR) -> DataFrame:
    """a, b, score of the pairs of vectors (a < b) with at least that cosine."""
    return similar_pairs(table(spark, sf_dir, "embeddings"), threshold, "vec_id", "embedding")


SIMILAR_SQL = f"""unit as (
    select vec_id, list_transform(embedding, lambda x: x::double) as v, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as n from embeddings),
alike as (
    select * from (select x.vec_id as a, y.vec_id as b, list_inner_product(x.v, y.v) / (x.n * y.n) as score from unit x join unit y on x.vec_id < y.vec_id)
    where score >= {SIMILAR})"""


def things(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, type, label of all nodes of the property graph."""
    t = lambda n: table(spark, sf_dir, n)
    row = lambda df, prefix, key, kind, label: df.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("type"), F.col(label).cast("string").alias("label"))
    turns = t("conversations").select(F.concat_ws(":", F.lit("t"), "conv_id", "turn").alias("id"), F.lit("Turn").alias("type"), F.col("role").alias("label"))
    return (
        row(t("region"), "r:", "r_regionkey", "Region", "r_name").union(row(t("nation"), "n:", "n_nationkey", "Nation", "n_name"))
        .union(row(t("customer"), "c:", "c_custkey", "Customer", "c_name")).union(row(t("supplier"), "s:", "s_suppkey", "Supplier", "s_name"))
        .union(turns).union(row(t("embeddings"), "v:", "vec_id", "Vector", "label"))
    )


THINGS_SQL = """things as (
    select 'r:' || r_regionkey as id, 'Region' as type, r_name as label from region union all
    select 'n:' || n_nationkey, 'Nation', n_name from nation union all
    select 'c:' || c_custkey, 'Customer', c_name from customer union all
    select 's:' || s_suppkey, 'Supplier', s_name from supplier union all
    select 't:' || conv_id || ':' || turn, 'Turn', role from conversations union all
    select 'v:' || vec_id, 'Vector', label::varchar from embeddings)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, rel_type, weight of the property graph."""
    t = lambda n: table(spark, sf_dir, n)
    fk = lambda df, p, a, q, b, kind: df.select(F.concat(F.lit(p), F.col(a).cast("string")).alias("src"), F.concat(F.lit(q), F.col(b).cast("string")).alias("dst"), F.lit(kind).alias("rel_type"), F.lit(1.0).alias("weight"))
    conv = t("conversations").select("conv_id", "turn")
    after = conv.select(F.col("conv_id"), (F.col("turn") - 1).alias("turn"))
    chain = conv.join(after, ["conv_id", "turn"]).select(F.concat_ws(":", F.lit("t"), "conv_id", "turn").alias("src"), F.concat_ws(":", F.lit("t"), "conv_id", F.col("turn") + 1).alias("dst"), F.lit("LED_TO").alias("rel_type"), F.lit(0.5).alias("weight"))
    like = similar(spark, sf_dir).select(F.concat(F.lit("v:"), F.col("a").cast("string")).alias("src"), F.concat(F.lit("v:"), F.col("b").cast("string")).alias("dst"), F.lit("SEMANTICALLY_SIMILAR").alias("rel_type"), F.col("score").alias("weight"))
    return (
        fk(t("nation"), "n:", "n_nationkey", "r:", "n_regionkey", "DEPENDS_ON").union(fk(t("customer"), "c:", "c_custkey", "n:", "c_nationkey", "IMPLEMENTS"))
        .union(fk(t("supplier"), "s:", "s_suppkey", "n:", "s_nationkey", "ADDRESSES")).union(chain).union(like)
    )


EDGES_SQL = f"""{SIMILAR_SQL},
edges as (
    select 'n:' || n_nationkey as src, 'r:' || n_regionkey as dst, 'DEPENDS_ON' as rel_type, 1.0::double as weight from nation union all
    select 'c:' || c_custkey, 'n:' || c_nationkey, 'IMPLEMENTS', 1.0::double from customer union all
    select 's:' || s_suppkey, 'n:' || s_nationkey, 'ADDRESSES', 1.0::double from supplier union all
    select 't:' || x.conv_id || ':' || x.turn, 't:' || y.conv_id || ':' || y.turn, 'LED_TO', 0.5::double
    from conversations x join conversations y on x.conv_id = y.conv_id and y.turn = x.turn + 1 union all
    select 'v:' || a, 'v:' || b, 'SEMANTICALLY_SIMILAR', score from alike)"""


def vector_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))


def vector_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst (src < dst) of similar vectors."""
    return similar(spark, sf_dir).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def vector_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: links with the components of vector_edges, as many as vectors for each pair of blocks at most."""
    return similar_forest(table(spark, sf_dir, "embeddings"), SIMILAR, "vec_id", "embedding").select(F.col("a").alias("src"), F.col("b").alias("dst"))


def label_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """c1, c2, edges: vector_edges counted by the labels of their ends."""
    return similar_counts(table(spark, sf_dir, "embeddings"), SIMILAR, "label", "vec_id", "embedding")
