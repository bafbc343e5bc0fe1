"""Graph analytics: components, centrality, communities, gaps. Undirected unless said; nodes have a column id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .centrality import betweenness
from .communities import greedy_communities, louvain  # noqa: F401  part of this module's names
from .traverse import isolated, undirected
from .triangles import triangles
from .votes import VOTES, neighbourhoods, voted


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component: the smallest id each node can reach.

    Labels fall to the least label of the neighbourhood and then to the label of the label, so the rounds grow with the
    logarithm of the diameter. Each round is written to the checkpoint folder.
    """
    pairs = undirected(edges)
    links = cut(pairs.select(F.col("u").alias("a"), F.col("v").alias("b")).union(pairs.select("v", "u")))
    labels = cut(nodes.select("id", F.col("id").alias("component")))
    while True:
        near = links.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("component").alias("low"))
        stepped = labels.join(near, F.col("id") == F.col("a"), "left").select("id", F.least("component", "low").alias("component"), F.col("component").alias("old"))
        hop = stepped.select(F.col("id").alias("_i"), F.col("component").alias("_c"))
        jumped = cut(stepped.join(hop, F.col("component") == F.col("_i"), "left").select("id", F.least("component", "_c").alias("component"), "old"))
        if not jumped.where("component <> old").limit(1).count():
            return jumped.select("id", "component")
        labels = jumped.select("id", "component")


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = 20, per_bucket: int = VOTES) -> DataFrame:
    """id, community: each round every node takes the most frequent label around it, its own counted, ties to the smaller; ends when none would change.

    All nodes move at once; where that has not settled after `rounds`, labels may swing between two states, so from then on only the half that a hash of
    id and round names moves. A thousand rounds without an end are an error, not a result. Neighbourhoods are packed once in buckets of about `per_bucket` ends, and
    a round moves these and a label for each node that a bucket asks for: votes are counted inside.
    """
    pairs = cut(undirected(edges))
    ids = nodes.select("id").distinct()
    links = pairs.select(F.col("u").alias("a"), F.col("v").alias("b")).union(pairs.select("v", "u")).join(ids.withColumnRenamed("id", "b"), "b", "left_semi").join(ids.withColumnRenamed("id", "a"), "a", "left_semi")
    near, asked = neighbourhoods(links.select("a", "b").union(ids.select("id", "id")), -(-(2 * pairs.count() + ids.count()) // per_bucket))
    labels = cut(ids.select("id", F.col("id").alias("community")))
    for turn in range(1000):
        both = cut(voted(near, asked, labels))
        if both.where("community <> new").isEmpty():
            return labels
        moves = F.lit(True) if turn < rounds else F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(2)) == 0
        labels = both.select("id", F.when(moves, F.col("new")).otherwise(F.col("community")).alias("community"))
    raise RuntimeError("labels did not settle in 1000 rounds")


def community_edges(communities: DataFrame, edges: DataFrame) -> DataFrame:
    """c1, c2, edges: edges inside each community (c1 = c2) and between each two (c1 < c2, or c1 is null) that have any."""
    c = lambda side: communities.select(F.col("id").alias(side), F.col("community").alias(f"c_{side}"))
    turned = F.coalesce(F.col("c_u") > F.col("c_v"), F.col("c_v").isNull())
    first, second = F.when(turned, F.col("c_v")).otherwise(F.col("c_u")), F.when(turned, F.col("c_u")).otherwise(F.col("c_v"))
    return undirected(edges).join(c("u"), "u").join(c("v"), "v").groupBy(first.alias("c1"), second.alias("c2")).agg(F.count(F.lit(1)).alias("edges"))


def modularity(communities: DataFrame, edges: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """One row: modularity of a partition (id, community). counts: as community_edges gives them, if every node of an edge has a community and they are known already."""
    m = undirected(edges).agg(F.count(F.lit(1)).alias("m")) if counts is None else counts.agg(F.sum("edges").alias("m"))
    counts = community_edges(communities, edges) if counts is None else counts
    inner = counts.where("c1 = c2").select(F.col("c1").alias("community"), F.col("edges").alias("inner"))
    degree = counts.select(F.explode(F.array("c1", "c2")).alias("community"), "edges").groupBy("community").agg(F.sum("edges").alias("degree"))
    part = F.coalesce("inner", F.lit(0)) / F.col("m") - F.pow(F.col("degree") / (2 * F.col("m")), 2)
    return degree.join(inner, "community", "left").crossJoin(F.broadcast(m)).agg(F.sum(part).alias("modularity"))


def community_summary(communities: DataFrame, top: int = 10, sample: int = 5) -> DataFrame:
    """community, size, first_id, sample_nodes (its first ids) of the largest communities."""
    found = communities.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first_id"))
    found = found.orderBy(F.col("size").desc(), "community").limit(top)
    return found.join(samples(communities.join(found.select("community"), "community", "left_semi"), sample), "community").orderBy(F.col("size").desc(), "community")


def samples(communities: DataFrame, n: int = 5) -> DataFrame:
    """community, sample_nodes: the first n ids of each; no more are brought together."""
    first = communities.withColumn("_k", F.row_number().over(Window.partitionBy("community").orderBy("id"))).where(F.col("_k") <= n)
    return first.groupBy("community").agg(F.array_sort(F.collect_list("id")).alias("sample_nodes"))


def weak_members(communities: DataFrame, edges: DataFrame) -> DataFrame:
    """id, community, missing: nodes that lack an edge to others of their community, and to how many."""
    size = communities.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    c = lambda side: communities.select(F.col("id").alias(side), F.col("community").alias(f"c_{side}"))
    inner = undirected(edges).join(c("u"), "u").join(c("v"), "v").where("c_u = c_v").select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("inner"))
    found = communities.join(size, "community").join(inner, "id", "left").withColumn("missing", F.col("size") - 1 - F.coalesce("inner", F.lit(0)))
    return found.where("missing > 0").select("id", "community", "missing")


def cluster_gaps(communities: DataFrame, edges: DataFrame | None = None, least: int = 2, weak: int = 2, sample: int = 5, counts: DataFrame | None = None) -> DataFrame:
    """community_pair_gaps with size and first ids of both communities."""
    known = communities.groupBy("community").agg(F.count(F.lit(1)).alias("size")).join(samples(communities, sample), "community")
    of = lambda k: known.select(F.col("community").alias(f"c{k}"), F.col("size").alias(f"size{k}"), F.col("sample_nodes").alias(f"sample{k}"))
    return community_pair_gaps(communities, edges, least, weak, counts).join(of(1), "c1").join(of(2), "c2")


def severities(gaps: DataFrame) -> DataFrame:
    """gap_type, severity, n."""
    return gaps.groupBy("gap_type", "severity").agg(F.count(F.lit(1)).alias("n"))


def topics(members: DataFrame, words: str, group: str, top: int = 3, nodes: int | None = None, order: str | None = None) -> DataFrame:
    """group, word, n: the most frequent words of each group (ties to the first in the alphabet), over all its rows or its first `nodes` in an order. members: group, words (arrays)."""
    if nodes is not None:
        members = members.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("_k") <= nodes)
    n = members.select(group, F.explode(words).alias("word")).groupBy(group, "word").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.col("n").desc(), "word"))
    return n.withColumn("_k", rank).where(F.col("_k") <= top).drop("_k")


def questions(gaps: DataFrame) -> DataFrame:
    """c1, c2, question: three for each gap between communities."""
    a, b = (F.concat(F.lit("cluster "), F.col(c).cast("string")) for c in ("c1", "c2"))
    first = F.concat(F.when(F.col("edges") == 0, "What links ").otherwise("How strong is the tie of "), a, F.lit(" and "), b, F.lit("?"))
    more = (F.concat(F.lit("Which pattern of "), a, F.lit(" would serve "), b, F.lit("?")), F.concat(F.lit("Did a failure in "), b, F.lit(" touch "), a, F.lit("?")))
    return gaps.select("c1", "c2", F.explode(F.array(first, *more)).alias("question"))


def critical(gaps: DataFrame, order: list[str], severity: str = "HIGH", n: int = 10) -> DataFrame:
    """The first n gaps of a severity."""
    return gaps.where(F.col("severity") == severity).orderBy(*order).limit(n)


def weak_connections(communities: DataFrame, edges: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """community, size, edges, missing: pairs inside each community without an edge. counts: community_edges, if known."""
    counts = community_edges(communities, edges) if counts is None else counts
    both = counts.where("c1 = c2").select(F.col("c1").alias("community"), "edges")
    size = communities.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    return size.join(both, "community", "left").select("community", "size", F.coalesce("edges", F.lit(0)).alias("edges"), (F.floor(F.col("size") * (F.col("size") - 1) / 2) - F.coalesce("edges", F.lit(0))).cast("long").alias("missing"))


def community_pair_gaps(communities: DataFrame, edges: DataFrame | None = None, least: int = 2, weak: int = 2, counts: DataFrame | None = None) -> DataFrame:
    """c1, c2, edges, gap_type, severity for pairs of communities of at least that size with no or few edges between.

    Pairs are of communities, not of nodes; the list of communities of a least size is what is paired. counts: community_edges, if known.
    """
    counts = community_edges(communities, edges) if counts is None else counts
    large = communities.groupBy("community").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("community")
    pairs = large.select(F.col("community").alias("c1")).join(large.select(F.col("community").alias("c2")), F.col("c1") < F.col("c2"))
    between = counts.where("c1 <> c2")
    found = pairs.join(between, ["c1", "c2"], "left").withColumn("edges", F.coalesce("edges", F.lit(0))).where(F.col("edges") <= weak)
    none = F.col("edges") == 0
    return found.withColumn("gap_type", F.when(none, "disconnected_clusters").otherwise("weak_connection")).withColumn("severity", F.when(none, "HIGH").otherwise("MEDIUM"))


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, triangles, degree, coefficient. Triangles are counted where blocks of edges meet, from the end of smaller degree, so a hub costs no square."""
    return coefficients(nodes, triangles(cut(undirected(edges))))


def coefficients(nodes: DataFrame, counts: DataFrame) -> DataFrame:
    """id, triangles, degree, coefficient of nodes, from the counts of those at an edge."""
    full = nodes.select("id").join(counts, "id", "left").na.fill(0, ["degree", "triangles"])
    return full.withColumn("coefficient", F.when(F.col("degree") > 1, 2.0 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1))).otherwise(F.lit(0.0)))


def health(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, average clustering, average degree, connectivity (share of nodes at an edge).

    Pairs are made and dealt out once, for their triangles; edges and nodes at no edge are counted from the degrees found there.
    """
    n = nodes.select("id").distinct().agg(F.count(F.lit(1)).alias("nodes"))
    counts = cut(triangles(cut(undirected(edges))))
    m = counts.agg(F.coalesce((F.sum("degree") / 2).cast("long"), F.lit(0)).alias("edges"))
    c = coefficients(nodes, counts).agg(F.avg("coefficient").alias("avg_clustering"))
    others = edges.where(~F.coalesce(F.col("src") != F.col("dst"), F.lit(False)))  # loops, which triangles leave out
    lone = isolated(nodes.join(counts.select("id"), "id", "left_anti"), others).agg(F.count(F.lit(1)).alias("isolated"))
    row = n.crossJoin(m).crossJoin(c).crossJoin(lone)
    return row.select("nodes", "edges", F.try_divide(2.0 * F.col("edges"), F.col("nodes") * (F.col("nodes") - 1)).alias("density"), "avg_clustering", F.try_divide(2.0 * F.col("edges"), "nodes").alias("avg_degree"), (1 - F.try_divide("isolated", "nodes")).alias("connectivity"))


def detect_gaps(nodes: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    """One row: isolated nodes (the first ten), counts, components, largest, bridges, totals, average degree, connectivity; zeros for an empty graph."""
    lone = cut(isolated(nodes, edges).select("id"))
    comp = components(nodes, edges).groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    first = lambda df, order, c: df.orderBy(*order).limit(top).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(c).cast("string").alias("_v")))).alias("rows")).select(F.transform("rows", lambda r: r["_v"]))
    isolates = lone.orderBy("id").limit(top).agg(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")).alias("isolated_nodes"))
    bridge = betweenness(nodes, edges).select("id", F.round("score", 9).alias("score")).where("score > 0").orderBy(F.col("score").desc(), "id").limit(top)
    bridges = bridge.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "id"))), lambda r: r["id"].cast("string")).alias("bridge_nodes"))
    count = lone.agg(F.count(F.lit(1)).alias("isolated_count"))
    sizes = comp.agg(F.count(F.lit(1)).alias("disconnected_clusters"), F.coalesce(F.max("size"), F.lit(0)).alias("largest_cluster_size"))
    totals = nodes.select("id").distinct().agg(F.count(F.lit(1)).alias("total_nodes")).crossJoin(undirected(edges).agg(F.count(F.lit(1)).alias("total_edges")))
    row = isolates.crossJoin(count).crossJoin(sizes).crossJoin(bridges).crossJoin(totals)
    return row.withColumn("avg_degree", F.round(F.coalesce(F.try_divide(2 * F.col("total_edges"), F.col("total_nodes")), F.lit(0.0)), 2)).withColumn("connectivity", F.round(1 - F.coalesce(F.try_divide("isolated_count", "total_nodes"), F.lit(0.0)), 3))


def gap_members(nodes: DataFrame, edges: DataFrame, bridge_above: float = 0.1, least: int = 2, communities: DataFrame | None = None) -> DataFrame:
    """gap_type, part, id, measure: every node that a report is about, one row each.

    isolated_nodes; disconnected_clusters (parts are components of `least` nodes or more, if there are several); bridge_nodes (measure is betweenness);
    weak_connections, given communities (part is the community, measure the number of edges that lack).
    """
    kind = nodes.schema["id"].dataType
    none = F.lit(None).cast(kind)
    row = lambda df, name, part, measure: df.select(F.lit(name).alias("gap_type"), part.cast(kind).alias("part"), "id", measure.cast("double").alias("measure"))
    lone = row(isolated(nodes.select("id").distinct(), edges), "isolated_nodes", none, F.lit(None))
    comp = cut(components(nodes, edges))
    sizes = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    several = sizes.agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    parts = comp.join(sizes.join(F.broadcast(several), F.lit(True)), "component")  # one row
    bridges = betweenness(nodes, edges).where(F.col("score") > bridge_above)
    out = lone.union(row(parts, "disconnected_clusters", F.col("component"), F.lit(None))).union(row(bridges, "bridge_nodes", none, F.col("score")))
    if communities is not None:
        out = out.union(row(weak_members(communities, edges), "weak_connections", F.col("community"), F.col("missing")))
    return out


def gap_reports(nodes: DataFrame, edges: DataFrame, bridge_above: float = 0.1, least: int = 2, communities: DataFrame | None = None, listed: int = 1000) -> DataFrame:
    """gap_type, affected_nodes, severity, recommendation, metrics: isolated nodes, components of two or more, bridges, and, given communities, edges that lack inside them.

    affected_nodes holds the first `listed` ids in their order, metrics their number; gap_members has them all as rows.
    """
    members = cut(gap_members(nodes, edges, bridge_above, least, communities))
    by = ["gap_type", "part"]
    weak = F.col("gap_type") == "weak_connections"
    members = members.withColumn("part", F.when(~weak, F.col("part")))  # one report for all communities
    first = members.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("_k") <= listed)
    first = first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")).alias("affected_nodes"))
    sums = members.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("measure").alias("s"), F.avg("measure").alias("a"))
    both = sums.join(first, (sums.gap_type == first.gap_type) & sums.part.eqNullSafe(first.part)).select(sums.gap_type, "affected_nodes", "n", "s", "a")
    is_ = lambda name: F.col("gap_type") == name
    severity = F.when(is_("isolated_nodes"), F.when(F.col("n") > 5, "CRITICAL").otherwise("HIGH")).when(is_("disconnected_clusters"), "HIGH").when(is_("bridge_nodes"), "MEDIUM").otherwise("LOW")
    lacking = (F.col("s") / 2).cast("long").cast("string")
    advice = (
        F.when(is_("isolated_nodes"), "Connect isolated nodes to related knowledge").when(is_("disconnected_clusters"), "Bridge this cluster to the others").when(is_("bridge_nodes"), "Add paths around bridge nodes")
        .otherwise(F.concat(F.lit("Add "), lacking, F.lit(" missing connections within communities")))
    )
    pair = lambda k, v: F.create_map(F.lit(k), v)
    metrics = (
        F.when(is_("isolated_nodes"), pair("count", F.col("n"))).when(is_("disconnected_clusters"), pair("size", F.col("n")))
        .when(is_("bridge_nodes"), F.map_concat(pair("avg_betweenness", F.col("a")), pair("count", F.col("n")))).otherwise(F.map_concat(pair("potential_connections", F.col("s") / 2), pair("count", F.col("n"))))
    )
    return both.select("gap_type", "affected_nodes", severity.alias("severity"), advice.alias("recommendation"), metrics.alias("metrics"))
