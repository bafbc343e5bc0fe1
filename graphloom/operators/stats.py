"""Counts, shares and reports over nodes, edges and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .traverse import degrees


def by(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def shares(df: DataFrame, key: str) -> DataFrame:
    """key, n, pct; the total is over the groups, not the rows."""
    return by(df, key).withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def connectivity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: total, connected, isolated, avg_edges, pct."""
    d = nodes.select("id").join(degrees(edges), "id", "left")
    row = d.agg(F.count(F.lit(1)).alias("total"), F.count("degree").alias("connected"), F.coalesce(F.sum("degree"), F.lit(0)).alias("ends"))
    return row.select("total", "connected", (F.col("total") - F.col("connected")).alias("isolated"), F.try_divide(F.col("ends"), F.col("total")).alias("avg_edges"), F.try_divide(100.0 * F.col("connected"), F.col("total")).alias("pct"))


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density of a directed graph with parallel edges."""
    n, m = nodes.agg(F.count(F.lit(1)).alias("nodes")), edges.agg(F.count(F.lit(1)).alias("edges"))
    return n.crossJoin(m).withColumn("density", F.try_divide(F.col("edges").cast("double"), F.col("nodes") * (F.col("nodes") - 1)))


def time_range(nodes: DataFrame) -> DataFrame:
    """One row: first, last, whole days between."""
    row = nodes.agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    return row.withColumn("days", F.floor(F.timestamp_diff("SECOND", F.col("first"), F.col("last")) / 86400).cast("long"))


def top_words(df: DataFrame, words: Column, k: int = 10) -> DataFrame:
    return df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "word").limit(k)


def filled(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row: total and, for each condition, the share of rows that meet it."""
    return df.agg(F.count(F.lit(1)).alias("total"), *(F.avg(F.coalesce(c, F.lit(False)).cast("double")).alias(k) for k, c in conditions.items()))


def project_of(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"/projects?/([^/]+)", 1), F.lit(""))


def rolling_rate(batches: DataFrame, order: str, ok: str, total: str, last: int = 10) -> DataFrame:
    """batches with rate and the mean of the last ten rates. A run's batches are few, so one window holds them."""
    rate = F.try_divide(F.col(ok).cast("double"), F.col(total))
    w = Window.partitionBy(F.lit(1)).orderBy(order).rowsBetween(1 - last, 0)
    return batches.withColumn("rate", rate).withColumn("rolling", F.avg("rate").over(w))


def progress(batches: DataFrame, order: str, processed: str, seconds: str, whole: int, last: int = 10) -> DataFrame:
    """batches with done and pct of the whole, rate (done a second since the start), its mean over the last ten batches, and eta_seconds at that rate."""
    w = Window.partitionBy(F.lit(1)).orderBy(order)
    done, spent = F.sum(processed).over(w), F.sum(seconds).over(w)
    out = batches.withColumn("done", done).withColumn("rate", F.coalesce(F.try_divide(F.col("done").cast("double"), spent.cast("double")), F.lit(0.0)))
    out = out.withColumn("avg_rate", F.avg("rate").over(w.rowsBetween(1 - last, 0)))
    eta = F.when(F.col("avg_rate") > 0, F.floor((whole - F.col("done")) / F.col("avg_rate"))).otherwise(0).cast("long")
    return out.withColumn("pct", F.col("done") * 100.0 / whole if whole else F.lit(0.0)).withColumn("eta_seconds", eta)


def syncs(runs: DataFrame, order: str, count: str, keep: int = 100) -> DataFrame:
    """The last `keep` runs with the count before and new (what a run has more; none if it has less): needed says whether there is anything to sync."""
    before = F.coalesce(F.lag(count).over(Window.partitionBy(F.lit(1)).orderBy(order)), F.lit(0))  # runs of a schedule are few
    rows = runs.withColumn("last_count", before).withColumn("new", F.greatest(F.col(count) - F.col("last_count"), F.lit(0))).withColumn("needed", F.col("new") > 0)
    return rows.orderBy(F.col(order).desc()).limit(keep)


def edge_quality(edges: DataFrame) -> DataFrame:
    """One row: total, with_reasoning, with_confidence (a weight), llm_share (edges of another type than SEMANTICALLY_SIMILAR)."""
    other = F.count_if(F.col("rel_type") != "SEMANTICALLY_SIMILAR").cast("double")
    return edges.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.length("reasoning") > 0).alias("with_reasoning"), F.count("weight").alias("with_confidence"), F.try_divide(other, F.count(F.lit(1))).alias("llm_share"))


def projects_by_root(projects: DataFrame, roots: list[str]) -> DataFrame:
    """root, n, project_ids of projects (id, path) by the first of the roots that is the path or holds it; others are left out."""
    root = F.lit(None).cast("string")
    for r in reversed(roots):
        r = r.rstrip("/")
        root = F.when((F.col("path") == r) | F.startswith("path", F.lit(r + "/")), F.lit(r)).otherwise(root)
    found = projects.select("id", root.alias("root")).where("root is not null")
    return found.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("id")).alias("project_ids"))  # projects of a root are few


def status(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """metric, value: nodes, edges, density, average degree, and nodes of each type; an empty graph has zeros."""
    row = density(nodes, edges).withColumn("density", F.coalesce("density", F.lit(0.0))).withColumn("avg_degree", F.coalesce(F.try_divide(2.0 * F.col("edges"), "nodes"), F.lit(0.0)))
    names = ["nodes", "edges", "density", "avg_degree"]
    whole = row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names))).alias("m")).select("m.*")
    return whole.union(by(nodes, "type").select(F.concat(F.lit("type "), "type"), F.col("n").cast("double")))


def status_text(rows: DataFrame, title: str = "Knowledge graph") -> str:
    """The status (a row a metric) as a Markdown report; an empty graph's says so and how to begin."""
    found = {r.metric: r.value for r in rows.collect()}
    if not found.get("nodes"):
        return f"# {title}\n\nNo knowledge has been added yet.\n\n- **Nodes**: 0\n- **Edges**: 0\n- **Density**: n/a\n\nAdd a first node with add_decision, add_pattern or add_failure.\n"
    shown = lambda k, v: f"{v:.6f}" if k == "density" else f"{v:.2f}" if k == "avg_degree" else f"{v:,.0f}"
    return f"# {title}\n\n" + "".join(f"- **{k.capitalize()}**: {shown(k, v)}\n" for k, v in found.items())


def delta(before: DataFrame, after: DataFrame, key: str = "type") -> DataFrame:
    """key, before, after, change."""
    a, b = by(before, key).withColumnRenamed("n", "before"), by(after, key).withColumnRenamed("n", "after")
    return a.join(b, key, "full_outer").na.fill(0).withColumn("change", F.col("after") - F.col("before"))
