"""Search and ranking: keyword search, rank fusion, reranking, timelines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOP_QUERY

FIELDS = ("description", "rationale", "name", "implementation", "context", "attempt", "reason_failed", "lesson_learned")


def decompose(query: str) -> dict:
    """keywords and, where a quarter is named, first and last day, of a question."""
    plain = re.sub(r"in\s+(timeframe|period)", "", re.sub(r"in\s+Q[1-4]\s*\d{4}", "", query, flags=re.I), flags=re.I)
    words = [w for w in re.findall(r"\w+", plain.lower()) if w not in STOP_QUERY][:10]
    out = {"original": query, "semantic": plain.strip(), "keyword": words, "temporal": None}
    if m := re.search(r"Q([1-4])\s*(\d{4})", query, re.I):
        q, year = int(m[1]), int(m[2])
        last = {1: "03-31", 2: "06-30", 3: "09-30", 4: "12-31"}[q]
        out["temporal"] = (f"{year}-{3 * q - 2:02d}-01", f"{year}-{last}")
    return out


def content(fields=FIELDS) -> Column:
    return F.concat_ws(" ", *fields)


def keyword_search(nodes: DataFrame, keywords: list[str], each: int = 10, most: int = 5, fields=FIELDS) -> DataFrame:
    """keyword, place, id, content: for each of the first five keywords the first ten nodes (by id) that hold it in a field, lower-cased.

    One scan: a node is matched against all keywords at once and only its hits are ranked.
    """
    words = keywords[:most]
    hits = F.array(*(F.when(F.coalesce(sum((F.coalesce(F.contains(F.lower(f), F.lit(w.lower())), F.lit(False)).cast("int") for f in fields), F.lit(0)) > 0, F.lit(False)), F.struct(F.lit(k).alias("place"), F.lit(w).alias("keyword"))) for k, w in enumerate(words)))
    found = nodes.select("id", content(fields).alias("content"), F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("hit"))
    rank = F.row_number().over(Window.partitionBy("place").orderBy("id"))
    return found.select("id", "content", "hit.place", "hit.keyword").withColumn("rank", rank).where(F.col("rank") <= each)


def fuse(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (key, rank) lists: key, score = sum of 1 / (k + rank); a key that stands twice in a list adds twice."""
    union = None
    for df in lists:
        df = df.select("key", (F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("part"))
        union = df if union is None else union.union(df)
    return union.groupBy("key").agg(F.sum("part").alias("score"))


def lexical_score(text: Column, keywords: list[str]) -> Column:
    """Share of the keywords that stand in the text, the default reranker."""
    words = sorted(set(keywords))
    if not words:
        return F.lit(0.0)
    return sum((F.contains(F.lower(text), F.lit(w)).cast("double") for w in words), F.lit(0.0)) / len(words)


def hybrid_search(nodes: DataFrame, query: str, timeframe: tuple[str, str] | None = None, vector_hits: DataFrame | None = None, reranker=None, top: int = 15) -> DataFrame:
    """id, content, score, rrf of the best nodes: keyword hits (and hits of a vector search as id, rank) fused by rank, then reranked.

    A time frame, given or named in the question, filters the nodes. reranker: a function of (query, column) to a column.
    """
    parts = decompose(query)
    frame = timeframe or parts["temporal"]
    if frame and "timestamp" in nodes.columns:
        nodes = nodes.where(F.to_date("timestamp").between(F.lit(frame[0]).cast("date"), F.lit(frame[1]).cast("date")))
    hits = keyword_search(nodes, parts["keyword"]) if parts["keyword"] else None
    lists = []
    if hits is not None:
        whole = F.row_number().over(Window.orderBy("place", "rank"))  # at most 50 rows
        lists.append(hits.select(F.col("id").alias("key"), whole.alias("rank")))
    if vector_hits is not None:
        lists.append(vector_hits.select(F.col("id").alias("key"), "rank"))
    if not lists:
        return nodes.select("id", content().alias("content"), F.lit(0.0).alias("score"), F.lit(0.0).alias("rrf")).limit(0)
    fused = fuse(lists).withColumnRenamed("score", "rrf")
    found = nodes.select("id", content().alias("content")).join(F.broadcast(fused), F.col("id") == F.col("key")).drop("key")
    score = reranker(query, F.col("content")) if reranker else lexical_score(F.col("content"), parts["keyword"])
    return found.withColumn("score", score).orderBy(F.col("score").desc(), F.col("rrf").desc(), "id").limit(top).select("id", "content", "score", "rrf")


def any_property(df: DataFrame, text: str) -> DataFrame:
    """Rows any of whose columns, as text, holds it; case counts."""
    hit = F.lit(False)
    for c in df.columns:
        hit = hit | F.coalesce(F.contains(F.col(c).cast("string"), F.lit(text)), F.lit(False))
    return df.where(hit)


def with_neighbours(hits: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """hits (id) with rel_type and neighbour of each edge that leads from them to a node; hits without one once, with nulls."""
    out = edges.select(F.col("src").alias("id"), "rel_type", F.col("dst").alias("neighbour")).join(nodes.select(F.col("id").alias("neighbour")).distinct(), "neighbour", "left_semi")
    return hits.join(out, "id", "left")


def having(nodes: DataFrame, kind: str | None = None, **conditions) -> DataFrame:
    """Nodes, of one type if named, whose properties hold a text (`field_has="text"`, case counts), are one of some values (`field_in=[...]`) or equal one (`field=...`)."""
    out = nodes if kind is None else nodes.where(F.col("type") == kind)
    for name, v in conditions.items():
        if name.endswith("_has"):
            out = out.where(F.contains(F.col(name[:-4]), F.lit(v)))
        elif name.endswith("_in"):
            out = out.where(F.col(name[:-3]).isin(list(v)))
        else:
            out = out.where(F.col(name) == v)
    return out


def recent(nodes: DataFrame, kind: str, n: int = 5) -> DataFrame:
    """The last n nodes of a type, the newest first."""
    return nodes.where(F.col("type") == kind).orderBy(F.col("timestamp").desc_nulls_last(), "id").limit(n)


def timeline(nodes: DataFrame, start: str, end: str, topic: str = "", most: int = 1000, limit_first: bool = False) -> DataFrame:
    """timestamp, type, id, content of nodes within the times (both included) that hold the topic, oldest first.

    limit_first cuts to the first `most` before the topic is looked for. Times that do not parse, or end before they start, give no row.
    """
    a, b = (F.try_to_timestamp(F.lit(t)).cast("timestamp_ntz") for t in (start, end))
    rows = nodes.where(F.col("timestamp").between(a, b) & (a <= b))
    rows = rows.select("timestamp", F.lower("type").alias("type"), "id", content([f for f in FIELDS if f in nodes.columns]).alias("content"))
    holds = F.contains(F.lower("content"), F.lit(topic.lower())) if topic else F.lit(True)
    order = ["timestamp", "id"]
    if limit_first:
        return rows.orderBy(*order).limit(most).where(holds).orderBy(*order)
    return rows.where(holds).orderBy(*order).limit(most)


def within(nodes: DataFrame, start: str, end: str, **equal) -> DataFrame:
    """Nodes by equal properties within the times, both included."""
    for c, v in equal.items():
        nodes = nodes.where(F.col(c) == v)
    return nodes.where(F.col("timestamp").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def swim_lanes(nodes: DataFrame) -> DataFrame:
    """project, first, last, nodes; nodes without a project under Uncategorized."""
    lane = F.coalesce(F.nullif("project", F.lit("")), F.lit("Uncategorized")).alias("project")
    return nodes.groupBy(lane).agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.count(F.lit(1)).alias("nodes"))
