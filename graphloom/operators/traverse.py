"""Traversal and patterns over edges (src, dst, rel_type, weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .triangles import triangles


def symmetric(edges: DataFrame) -> DataFrame:
    """Every edge seen from both ends; a self-loop once."""
    flipped = edges.withColumns({"src": F.col("dst"), "dst": F.col("src")}).where("src <> dst")
    return edges.unionByName(flipped)


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct pairs u < v, parallel edges and self-loops gone."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()


def neighbours(edges: DataFrame, node_id: str) -> DataFrame:
    """One row for each edge at a node, both directions: rel_type, neighbour, direction."""
    out = edges.where(F.col("src") == node_id).select("rel_type", F.col("dst").alias("neighbour"), F.lit("out").alias("direction"))
    return out.union(edges.where(F.col("dst") == node_id).select("rel_type", "src", F.lit("in"))).orderBy("rel_type", "neighbour")


def find_related(edges: DataFrame, start: DataFrame, depth: int = 1, mode: str = "shortest") -> DataFrame:
    """id, distance of what is within `depth` steps of the start ids (column id), in either direction.

    shortest: the least distance, without the start; each round joins only the frontier. trail: every distance at
    which a path that uses no edge twice arrives, as a property-graph pattern counts them; the start may come back.
    """
    if depth < 1:
        return start.select("id", F.lit(0).alias("distance")).limit(0)
    if mode == "shortest":
        # repeated edges go with the repeated ids of a step, so the edges themselves are never dealt out for it
        links = symmetric(cut(edges.select("src", "dst")))
        frontier = cut(start.select("id").distinct())  # a table's size is known: a small one is broadcast, and the edges stay where they are
        reached = frontier.select("id", F.lit(0).alias("distance"))
        for d in range(1, depth + 1):
            step = frontier.join(links, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
            frontier = cut(step.join(reached, "id", "left_anti"))
            reached = reached.union(frontier.select("id", F.lit(d)))
        return reached.where("distance > 0")
    numbered = cut(edges.select("src", "dst", F.xxhash64(*sorted(edges.columns)).alias("h")).withColumn("edge", F.struct("h", F.monotonically_increasing_id())).select("src", "dst", "edge"))
    links = symmetric(numbered).select(F.col("src").alias("at"), "dst", "edge")
    paths = cut(start.select(F.col("id").alias("at"), F.array().cast("array<struct<h:bigint,col2:bigint>>").alias("used")))
    found = None
    for d in range(1, depth + 1):
        paths = cut(paths.join(links, "at").where(~F.array_contains("used", F.col("edge"))).select(F.col("dst").alias("at"), F.array_append("used", F.col("edge")).alias("used")))
        here = paths.select(F.col("at").alias("id"), F.lit(d).alias("distance")).distinct()
        found = here if found is None else found.union(here)
    return found


def subgraph(edges: DataFrame, start: DataFrame, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """Ids within depth of the start, with the start, and the edges that have both ends among them."""
    edges = cut(edges)
    ids = cut(find_related(edges, start, depth).select("id").union(start.select("id")).distinct())
    inside = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return ids, inside


def full_graph_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst): the first type, the largest weight."""
    return edges.groupBy("src", "dst").agg(F.min("rel_type").alias("rel_type"), F.max("weight").alias("weight"))


def typed(edges: DataFrame, rel_type: str) -> DataFrame:
    return edges.where(F.col("rel_type") == rel_type)


def chains(edges: DataFrame, rel_type: str, most: int = 3) -> DataFrame:
    """start, end, length, path for each directed path of one type with 1 to `most` steps."""
    step = typed(edges, rel_type).select(F.col("src").alias("at"), F.col("dst").alias("to"))
    paths = step.select(F.col("at").alias("start"), F.col("to").alias("end"), F.array("at", "to").alias("path"))
    out = paths
    for _ in range(most - 1):
        paths = paths.join(step, F.col("end") == F.col("at")).where(~F.array_contains("path", F.col("to"))).select("start", F.col("to").alias("end"), F.array_append("path", F.col("to")).alias("path"))
        out = out.union(paths)
    return out.withColumn("length", F.size("path") - 1)


def all_paths(edges: DataFrame, start: str, end: str, most: int = 3, directed: bool = False) -> DataFrame:
    """path (ids), types, length for each path of 1 to `most` edges of any type between two ids that meets no node twice, parallel edges of unlike types apart.

    Half of each path is walked from either end and the halves are joined where they meet, so the work is that of the halves' number, not of all walks
    of full length from one end.
    """
    spark = edges.sparkSession
    links = (edges if directed else symmetric(edges.select("src", "dst", "rel_type"))).where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"), "rel_type").distinct()
    links = cut(links)

    def halves(at: str, stop: str, steps: int, back: bool) -> list[DataFrame]:
        out = [spark.createDataFrame([(at, [at], [])], "at string, path array<string>, types array<string>")]
        near, far = ("b", "a") if back else ("a", "b")
        for _ in range(steps):
            step = out[-1].where(F.col("at") != stop).join(links, F.col("at") == F.col(near)).where(~F.array_contains("path", F.col(far)))
            out.append(cut(step.select(F.col(far).alias("at"), F.array_append("path", F.col(far)).alias("path"), F.array_append("types", F.col("rel_type")).alias("types"))))
        return out

    ahead, behind = halves(start, end, (most + 1) // 2, False), halves(end, start, most // 2, True)
    found = None
    for n in range(1, most + 1):
        a = ahead[(n + 1) // 2]
        b = behind[n // 2].select("at", F.slice(F.reverse("path"), 2, most).alias("rest"), F.reverse("types").alias("rest_types"))
        met = a.join(b, "at").where(~F.arrays_overlap("path", "rest"))
        met = met.select(F.concat("path", "rest").alias("path"), F.concat("types", "rest_types").alias("types"), F.lit(n).alias("length"))
        found = met if found is None else found.union(met)
    return found


def first_in_triangle(edges: DataFrame, few: int = 100) -> tuple | None:
    """a, b: the first edge (seen from both ends, in the order of a, then b) whose ends have a common neighbour; None if there is none.

    Only the neighbourhoods of few nodes are joined: the first ids are looked at, and beyond them the first that triangles (counted in blocks) find.
    """
    pairs = cut(undirected(edges))
    both = pairs.select(F.col("u").alias("a"), F.col("v").alias("b")).union(pairs.select("v", "u"))

    def first(ids: DataFrame):
        near = cut(both.join(F.broadcast(ids.select(F.col("id").alias("a"))), "a", "left_semi"))
        c = near.select("a", F.col("b").alias("c"))
        return near.join(both.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").join(c, ["a", "c"], "left_semi").orderBy("a", "b").select("a", "b").first()

    found = first(cut(both.select(F.col("a").alias("id")).distinct().orderBy("id").limit(few)))
    if found is None:
        found = first(cut(triangles(pairs).where("triangles > 0").orderBy("id").select("id").limit(1)))
    return found and tuple(found)


def shortest_path(edges: DataFrame, start: str, end: str, most: int = 5) -> DataFrame:
    """path (array of ids), length: the first of the shortest paths by the order of its ids; no row if there is none within `most` steps."""
    spark = edges.sparkSession
    links = symmetric(edges.select("src", "dst").distinct()).distinct()
    paths = spark.createDataFrame([(start, [start])], "at string, path array<string>")
    seen = paths.select("at")
    for _ in range(most):
        step = paths.join(links, F.col("at") == F.col("src")).select(F.col("dst").alias("at"), F.array_append("path", F.col("dst")).alias("path"))
        paths = cut(step.join(seen, "at", "left_anti").groupBy("at").agg(F.min("path").alias("path")))
        hit = paths.where(F.col("at") == end)
        if hit.limit(1).count():
            return hit.select("path", (F.size("path") - 1).alias("length"))
        seen = seen.union(paths.select("at"))
    return paths.limit(0).select("path", (F.size("path") - 1).alias("length"))


def degrees(edges: DataFrame) -> DataFrame:
    """id, degree: edges at each node that has any, both directions."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (with id) at no edge."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    return nodes.join(ends, "id", "left_anti")


def lacking(nodes: DataFrame, edges: DataFrame, rel_type: str) -> DataFrame:
    """Nodes that no edge of the type points to."""
    return nodes.join(typed(edges, rel_type).select(F.col("dst").alias("id")).distinct(), "id", "left_anti")


def collected(nodes: DataFrame, edges: DataFrame, rel_type: str) -> DataFrame:
    """id and the sorted ids that point to it by the type; an empty list where none does."""
    to = typed(edges, rel_type).groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_list("src")).alias("sources"))
    return nodes.select("id").join(to, "id", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))


def strongest(edges: DataFrame, above: float, k: int = 20, rel_type: str = "SEMANTICALLY_SIMILAR") -> DataFrame:
    return typed(edges, rel_type).where(F.col("weight") > above).orderBy(F.col("weight").desc(), "src", "dst").limit(k)


def endpoints_exist(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes; what an edge sink writes."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def strongest_of_each(edges: DataFrame, seq: Column | None = None) -> DataFrame:
    """One edge for each (src, dst, rel_type): the heaviest; of equal weights the first by seq."""
    order = Window.partitionBy("src", "dst", "rel_type").orderBy(F.col("weight").desc_nulls_last(), *([seq] if seq is not None else []))
    return edges.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")
