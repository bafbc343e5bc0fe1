"""More queries over the driver tables: paged sources, connectivity, communities and centrality without a driver, paths, sinks."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import analytics as A
from ..operators import connectivity as CN
from ..operators import dedup as D
from ..operators import extract as E
from ..operators import relate as R
from ..operators import search as Q
from ..operators import stats as B
from ..operators import substring as SS
from ..operators import traverse as G
from ..session import cut, shared_folder
from ..sources import driver_tables as S
from ..sources import paged as P
from ..sources.driver_tables import EDGES_SQL, NODES_SQL, THINGS_SQL
from .queries import GRAPH_SQL, NODE_TEXT_SQL, PAGE_SQL, PART_SQL, WORDS, graph, parts, query

#: SQL of queries that are registered elsewhere.
SQL: dict[str, str] = {}

# ---- paged stores and search services


def _stored_turns(spark, sf):
    """The turns of conversations as a paged store of records with metadata."""
    turns = S.table(spark, sf, "conversations")
    of = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    metadata = F.map_from_entries(F.filter(F.array(F.struct(F.lit("conversation_id").alias("k"), F.col("conv_id").cast("string").alias("v")), F.struct(F.lit("role").alias("k"), F.col("role").alias("v")), F.struct(F.lit("source").alias("k"), F.when(F.col("turn") % 2 == 0, "desktop").alias("v"))), lambda e: e["v"].isNotNull()))
    folder = shared_folder(spark, "turns")
    P.write_pages(turns.select(F.concat(of("conv_id", 12), F.lit(":"), of("turn", 6)).alias("id"), F.col("text").alias("document"), metadata.alias("metadata")), folder, 500)
    return folder


@query("select lpad(conv_id::varchar, 12, '0') || ':' || lpad(turn::varchar, 6, '0') as id, conv_id::varchar as conv_id, coalesce(role, 'unknown') as role, case when turn % 2 = 0 then 'desktop' else 'unknown' end as source, 'unknown' as project, md5(text) as digest from conversations")
def paged_store_messages(spark, sf):
    P.register(spark)
    rows = spark.read.format("paged_store").option("path", _stored_turns(spark, sf)).option("page_size", 200).option("parts", 16).load()
    return P.messages(rows).select("id", "conv_id", "role", "source", "project", F.md5("content").alias("digest"))


@query("with t as (select conv_id::varchar as conv_id, count(*) as turns, count(*) filter (where turn % 2 = 0) as desktop, sum(length(text))::bigint as chars from conversations where role = 'assistant' group by 1) select * from t")
def paged_store_assistants(spark, sf):
    """The store itself leaves out records of other roles."""
    P.register(spark)
    rows = spark.read.format("paged_store").option("path", _stored_turns(spark, sf)).option("where", json.dumps({"role": "assistant"})).load()
    return P.messages(rows).groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col("source") == "desktop").alias("desktop"), F.sum(F.char_length("content")).alias("chars"))


HITS = ", ".join(f"({k}, '{w}')" for k, w in enumerate(WORDS))


@query(f"""with w as (select * from (values {HITS}) t(no, word)), n as (select no, word, doc_id, source, len(regexp_extract_all(lower(text), word))::bigint as n from documents, w where contains(lower(text), word)),
    top as (select *, row_number() over (partition by no order by n desc, doc_id) as place from n), found as (select * from top where place <= 50),
    first as (select * from (select *, row_number() over (partition by doc_id order by no, place) as k from found) where k = 1)
    select doc_id::varchar as id, word as query, place::int as place, source, round(case when n % 3 = 0 then 0.5::double else 1 - 1.0::double / (1 + n) end, 9) as relevance from first""")
def search_service_gather(spark, sf):
    """Hits of five questions, from answers in the three shapes that a service gives, some without a distance: each document once, with the query it came first for."""
    P.register(spark)
    d = S.table(spark, sf, "documents")
    hits = None
    for no, word in enumerate(WORDS):
        n = F.regexp_count(F.lower("text"), F.lit(word))
        top = d.where(F.contains(F.lower("text"), F.lit(word))).select("doc_id", "text", "source", n.alias("n")).orderBy(F.col("n").desc(), "doc_id").limit(50)
        hit = F.struct(F.col("doc_id").cast("string").alias("id"), F.substring("text", 1, 200).alias("document"), F.struct("source").alias("metadata"), F.when(F.col("n") % 3 != 0, 1.0 / (1 + F.col("n"))).alias("distance"))
        listed = top.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "doc_id", hit.alias("hit")))), lambda e: e["hit"]).alias("l"))
        answer = (F.to_json(F.struct(F.struct(F.col("l").alias("results")).alias("results"))), F.to_json(F.struct(F.col("l").alias("results"))), F.to_json("l"))[no % 3]
        one = listed.select(F.lit(word).alias("query"), answer.alias("answer"))
        hits = one if hits is None else hits.union(one)
    folder = shared_folder(spark, "answers")
    P.write_answers(hits, folder)
    found = spark.read.format("search_service").option("path", folder).option("queries", json.dumps(WORDS)).option("each", 2).load()
    number = F.array_position(F.array(*map(F.lit, WORDS)), F.col("query"))
    first = E.gather(found.select(number.alias("query_no"), F.col("place").alias("rank"), F.col("conversation_id").alias("id"), "relevance_score", "query", "place", "source"), ordered=True)
    return first.select("id", "query", "place", "source", F.round("relevance_score", 9).alias("relevance"))


# ---- centrality, connectivity, gaps

#: Numbers of walks of each length are summed until the longest shortest path is behind; the first length at which a pair has any is its distance, and their number that of its shortest paths.
BETWEEN_SQL = (
    "with recursive " + GRAPH_SQL + """, n as (select count(*) as n from embeddings),
walk(s, v, d, w) as (select vec_id, vec_id, 0, 1.0::double from embeddings union all select s, l.b, d + 1, sum(w) from walk join links l on l.a = walk.v where d < 64 group by s, l.b, d + 1),
far as (select s, v, min(d) as d, arg_min(w, d) as w from walk group by s, v),
mid as (select a.v as id, sum(a.w * b.w / c.w) as score from far a join far b on a.v = b.s join far c on c.s = a.s and c.v = b.v where a.s <> a.v and b.v <> a.v and a.s <> b.v and a.d + b.d = c.d group by a.v),
between_ as (select vec_id as id, coalesce(score, 0.0::double) / ((n - 1) * (n - 2)) as score from embeddings left join mid on vec_id = id, n)"""
)
SQL["betweenness_round6"] = BETWEEN_SQL + " select id, round(score, 6) as score from between_"
SQL["bridges_top10"] = BETWEEN_SQL + ", r as (select id, round(score, 9) as score from between_ where score > 0) select id, score from r order by score desc, id limit 10"
GAPS_SQL = BETWEEN_SQL + """, reach as (select s as id, min(v) as component from far group by s), comp as (select component, count(*) as size from reach group by 1),
lone as (select vec_id as id from embeddings where vec_id not in (select a from links)), bridge as (select id, round(score, 9) as score from between_ where round(score, 9) > 0 order by 2 desc, 1 limit 10)"""
SQL["detect_gaps_summary"] = GAPS_SQL + """ select (select coalesce(string_agg(id::varchar, ',' order by id), '') from (select id from lone order by id limit 10)) as isolated_nodes, (select count(*) from lone) as isolated_count,
(select count(*) from comp) as disconnected_clusters, (select max(size) from comp) as largest_cluster_size, (select coalesce(string_agg(id::varchar, ',' order by score desc, id), '') from bridge) as bridge_nodes,
(select n from n) as total_nodes, (select count(*) from alike) as total_edges, round(2.0::double * (select count(*) from alike) / (select n from n), 2) as avg_degree, round(1 - (select count(*) from lone)::double / (select n from n), 3) as connectivity"""
REPORTS_SQL = GAPS_SQL + """, high as (select count(*) as k from between_ where score > 0.1),
reports as (select 'isolated_nodes' as gap_type, case when count(*) > 5 then 'CRITICAL' else 'HIGH' end as severity, count(*)::int as affected, 'Connect isolated nodes to related knowledge' as recommendation from lone having count(*) > 0
union all select 'disconnected_clusters', 'HIGH', size::int, 'Bridge this cluster to the others' from comp where size >= 2 and (select count(*) from comp where size >= 2) > 1
union all select 'bridge_nodes', 'MEDIUM', k::int, 'Add paths around bridge nodes' from high where k > 0)"""
SQL["gap_reports"] = REPORTS_SQL + " select * from reports"


@query(REPORTS_SQL + """, c as (select vec_id as id, label::bigint as community from embeddings), size as (select community, count(*) as n from c group by 1),
inner_ as (select x.id, count(*) as k from c x join links l on l.a = x.id join c y on y.id = l.b and y.community = x.community group by 1),
weak as (select c.id, size.n - 1 - coalesce(k, 0) as missing from c join size using (community) left join inner_ on inner_.id = c.id where size.n - 1 - coalesce(k, 0) > 0),
all_ as (select gap_type, severity, affected from reports union all select 'weak_connections', 'LOW', count(*)::int from weak having count(*) > 0) select gap_type, severity, count(*) as n, sum(affected)::bigint as affected from all_ group by 1, 2""")  # fmt: skip
def gap_severities(spark, sf):
    """Reports with those on edges that lack inside given communities, by kind."""
    reports = A.gap_reports(*graph(spark, sf), communities=parts(spark, sf))
    affected = F.coalesce(F.col("metrics")["count"], F.col("metrics")["size"]).cast("long")
    sums = reports.groupBy("gap_type").agg(F.sum(affected).alias("affected"))
    return A.severities(reports).join(sums, "gap_type")


@query(f"with {PART_SQL}, size as (select community, count(*) as n from c group by 1), inner_ as (select x.id, count(*) as k from c x join links l on l.a = x.id join c y on y.id = l.b and y.community = x.community group by 1) select c.id, c.community, n - 1 - coalesce(k, 0) as missing from c join size using (community) left join inner_ on inner_.id = c.id where n - 1 - coalesce(k, 0) > 0")
def weak_members(spark, sf):
    return A.weak_members(parts(spark, sf), S.vector_edges(spark, sf))


@query("select label::bigint as community, count(*) as size, array_to_string(list_sort(list(vec_id))[1:5], ',') as sample from embeddings group by 1 order by size desc, community limit 10")
def community_samples(spark, sf):
    return A.community_summary(parts(spark, sf)).select("community", "size", F.array_join(F.col("sample_nodes").cast("array<string>"), ",").alias("sample"))


@query(f"with {PART_SQL}, s as (select community, count(*) as size, array_to_string(list_sort(list(id))[1:5], ',') as sample from c group by 1), b as (select least(cu, cv) as c1, greatest(cu, cv) as c2, count(*) as edges from ends where cu <> cv group by 1, 2) select x.community as c1, y.community as c2, coalesce(edges, 0) as edges, case when coalesce(edges, 0) = 0 then 'HIGH' else 'MEDIUM' end as severity, x.size as size1, y.size as size2, x.sample as sample1, y.sample as sample2 from s x join s y on x.community < y.community left join b on b.c1 = x.community and b.c2 = y.community where x.size >= 2 and y.size >= 2 and coalesce(edges, 0) <= 3 order by c1, c2 limit 10")
def critical_cluster_gaps(spark, sf):
    """The first ten gaps of high severity, or fewer connections than four, between communities, with what they hold."""
    gaps = A.cluster_gaps(parts(spark, sf), weak=3, counts=S.label_edges(spark, sf)).drop("gap_type")
    return gaps.withColumns({f"sample{k}": F.array_join(F.col(f"sample{k}").cast("array<string>"), ",") for k in (1, 2)}).orderBy("c1", "c2").limit(10)


@query()
def node_connectivity(spark, sf):
    return CN.average_node_connectivity(*graph(spark, sf)).withColumn("average", F.round("average", 9))


# ---- paths and properties

ENDS_SQL = "like_ as (select src as a, dst as b from edges where rel_type = 'SEMANTICALLY_SIMILAR' union all select dst, src from edges where rel_type = 'SEMANTICALLY_SIMILAR'), ends_ as (select x.a, x.b from like_ x join like_ y on y.a = x.a join like_ z on z.a = y.b and z.b = x.b order by x.a, x.b limit 1)"


@query(f"with recursive {EDGES_SQL}, {ENDS_SQL}, both_ as (select distinct src, dst, rel_type from (select src, dst, rel_type from edges union all select dst, src, rel_type from edges)), p(here, path, types) as (select a, [a], []::varchar[] from ends_ union all select e.dst, list_append(path, e.dst), list_append(types, e.rel_type) from p join both_ e on e.src = p.here where len(path) <= 6 and not list_contains(path, e.dst) and p.here <> (select b from ends_)) select array_to_string(path, '>') as path, array_to_string(types, '>') as types, (len(path) - 1)::int as length from p where here = (select b from ends_)")
def all_paths_between(spark, sf):
    """All paths of up to six edges between the first two alike vectors that are both like a third."""
    e = cut(S.edges(spark, sf).select("src", "dst", "rel_type"))
    a, b = G.first_in_triangle(G.typed(e, "SEMANTICALLY_SIMILAR"))
    return G.all_paths(e, a, b, 6).select(F.array_join("path", ">").alias("path"), F.array_join("types", ">").alias("types"), "length")


@query(f"with {THINGS_SQL}, {EDGES_SQL}, hit as (select id, type from things where contains(id, '1:') or contains(type, '1:') or contains(label, '1:')) select hit.id, hit.type, e.rel_type, e.dst as neighbour from hit left join (select * from edges where dst in (select id from things)) e on e.src = hit.id")
def any_property_neighbours(spark, sf):
    things = S.things(spark, sf)
    return Q.with_neighbours(Q.any_property(things, "1:").select("id", "type"), S.edges(spark, sf), things)


@query(f"with {NODES_SQL} select id, type, source from nodes where (type = 'Pattern' and contains(name, 'tion') and source in ('fr', 'de')) or id in (select id from nodes where type = 'Failure' order by timestamp desc, id limit 5)")
def property_conditions(spark, sf):
    n = S.nodes(spark, sf)
    return Q.having(n, "Pattern", name_has="tion", source_in=["fr", "de"]).unionByName(Q.recent(n, "Failure")).select("id", "type", "source")


PATTERNS = ("tion", "é", "e t", "ting and", "zzzzz")


@query("select p as pattern, doc_id from documents, (select unnest([" + ", ".join(f"'{p}'" for p in PATTERNS) + "]) as p) where contains(text, p)")
def substring_index(spark, sf):
    """Documents that hold each of some texts, from a trigram index over all of them."""
    folder = shared_folder(spark, "trigrams")
    SS.build(S.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), folder)
    found = None
    for p in PATTERNS:
        one = SS.contains(spark, folder, p).select(F.lit(p).alias("pattern"), F.col("id").alias("doc_id"))
        found = one if found is None else found.union(one)
    return found


# ---- batches that may come twice


@query(f"with {NODES_SQL}, r as (select id as src, unnest(related_to) as dst from nodes) select src, dst, 'RELATES_TO' as rel_type, count(*)::bigint as n from r where dst in (select id from nodes) group by 1, 2")
def streamed_relationships(spark, sf):
    """Edges from related_to as documents stream in, by a job that is then run again and whose batch is tried a second time."""
    from ..operators import nodes as N
    from ..schema import EDGE, NODE, conform
    from ..streaming import jobs, ledger

    folder = shared_folder(spark, "ledger")
    known = conform(S.nodes(spark, sf), NODE)
    stream = jobs.read(spark, sf, "documents").select("doc_id")
    table = ledger.BatchTable(spark, f"{folder}/edges", EDGE)
    numbered = S.nodes(spark, sf)
    derive = lambda new, _: N.related_edges(conform(numbered.join(new, "doc_id", "left_semi"), NODE))
    for _ in range(2):
        ledger.relationships(stream.withColumn("id", F.lit(None).cast("string")), known, derive, table, f"{folder}/run")
    ledger.append_edges(table, N.related_edges(known), known, 0)
    return table.read().groupBy("src", "dst", "rel_type").agg(F.count(F.lit(1)).alias("n"))


@query("with s as (select *, ts::timestamp as marked, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) select 'd:/' || user_id || '.md' as path, case when event_type = 'error' then 'failed' else 'completed' end as status, marked from s where k = 1")
def tracker_status(spark, sf):
    """Files (one for each user of events) after every event marked them, the last one told by time: completed, or failed for an error."""
    from pyspark.sql import Window

    from ..streaming import ledger

    e = S.table(spark, sf, "events")
    path = F.concat(F.lit("d:/"), F.col("user_id").cast("string"), F.lit(".md")).alias("normalized_path")
    tracker = ledger.Tracker(spark, shared_folder(spark, "tracker"))
    tracker.put(e.groupBy(path).agg(F.min(F.col("ts").cast("timestamp_ntz")).alias("at")), 0)
    last = e.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc()))).where("k = 1")
    marks = last.select(path, F.col("ts").cast("timestamp_ntz").alias("at"), F.lit(1).cast("long").alias("session"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("error_message"), "event_type")
    for _ in range(2):
        tracker.mark(marks.where("event_type = 'error'"), "failed", 1)
        tracker.mark(marks.where("event_type <> 'error'"), "completed", 2)
    tracker.compact(2)
    return tracker.files().select(F.col("normalized_path").alias("path"), F.col("scan_status").alias("status"), F.col("at").alias("marked"))


# ---- the graph's own tables, tools and pages


def _stored_graph(spark, sf):
    """Nodes and their RELATES_TO edges in folders, as the façade writes them."""
    from ..api import KnowledgeGraph
    from ..operators import nodes as N
    from ..schema import NODE, conform

    at = shared_folder(spark, "graph")
    nodes = conform(S.nodes(spark, sf), NODE)
    N.write(nodes, f"{at}/nodes")
    kg = KnowledgeGraph(spark, at)
    N.append_edges(spark, N.related_edges(kg.nodes), kg.nodes, f"{at}/edges")
    return kg


@query(f"with {NODES_SQL}, one as (select doc_id as d from nodes where type = 'Failure' order by timestamp limit 1 offset 20), r as (select n.id, n.type, abs(n.doc_id - d) // 3 as distance from nodes n, one where n.doc_id % 3 = d % 3 and n.doc_id <> d and abs(n.doc_id - d) <= 12), t as (select lower(type) as type, count(*) as n from nodes where timestamp between timestamp '2024-01-02 00:00:00' and timestamp '2024-01-30 00:00:00' and contains(lower(concat_ws(' ', description, rationale, name, implementation, context, attempt, reason_failed, lesson_learned)), 'ting') group by 1) select 'find_related' as tool, id as key, distance::bigint as n from r union all select 'get_timeline', type, n from t")
def tools_in_sql(spark, sf):
    """Tools called from SQL: nodes within four steps of the twenty-first failure, and nodes of a month by type (under a thousand)."""
    from .. import tools

    kg = _stored_graph(spark, sf)
    tools.register(kg, "tooled", with_gaps=False)
    start = kg.nodes.where("type = 'Failure'").orderBy("timestamp").offset(20).first().id
    return spark.sql(f"""SELECT 'find_related' AS tool, id AS key, CAST(distance AS BIGINT) AS n FROM find_related('{start}', 4)
        UNION ALL SELECT 'get_timeline', type, count(*) FROM get_timeline('Ting', '2024-01-02 00:00:00', '2024-01-30 00:00:00') GROUP BY type""")


@query(f"with {NODES_SQL}, {NODE_TEXT_SQL}, p as (select id, type, text, row_number() over (order by id) as k from texts where text <> '') select ((k - 1) // 100)::int as page, count(*) as n, min(id) as first, max(id) as last, sum(length(text))::bigint as chars from p where k <= 300 group by 1")
def keyset_pages(spark, sf):
    """The first three pages of a hundred nodes, each behind the last id of the one before."""
    kg, after, pages = _stored_graph(spark, sf), None, None
    for k in range(3):
        page = kg.page(after, 100)
        one = page.agg(F.lit(k).alias("page"), F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.max("id").alias("last"), F.sum(F.char_length("text")).alias("chars")).where("n > 0")
        pages = one if pages is None else pages.union(one)
        after = page.agg(F.max("id")).first()[0] or after
    return pages


# ---- small reports


@query("with g as (select substr(text, 1, 200) as k, count(*) as n from documents group by 1) select count(*) as total_patterns, sum(greatest(n - 2, 0))::bigint as pattern_skips, round(avg(least(n, 2)), 9) as avg_per_pattern, 2 as max_duplicates_per_pattern from g")
def pattern_stats(spark, sf):
    return D.pattern_stats(S.table(spark, sf, "documents"), "text", 2).withColumn("avg_per_pattern", F.round("avg_per_pattern", 9))


RUNS_SQL = "runs as (select day, sum(n) over (order by day)::bigint as messages from (select ts::date as day, count(*) as n from events group by 1))"


@query(f"with {RUNS_SQL}, l as (select *, coalesce(lag(messages) over (order by day), 0) as last_count from runs) select day, messages, last_count::bigint as last_count, greatest(messages - last_count, 0)::bigint as new, messages > last_count as needed from l order by day desc limit 100")
def sync_checks(spark, sf):
    from pyspark.sql import Window

    days = S.table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    runs = days.select("day", F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("day")).alias("messages"))
    return B.syncs(runs, "day", "messages")


@query("with d as (select ts::date as day, count(*) as n, 3600.0::double as spent from events group by 1), c as (select *, sum(n) over (order by day)::bigint as done, (sum(n) over (order by day))::double / sum(spent) over (order by day) as rate, (select count(*) from events) as whole from d) select day, done, round(rate, 9) as rate, round(avg(rate) over (order by day rows between 9 preceding and current row), 9) as avg_rate, round(done * 100.0::double / whole, 9) as pct from c")
def ingestion_progress(spark, sf):
    e = S.table(spark, sf, "events")
    days = e.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n")).withColumn("spent", F.lit(3600.0))
    return B.progress(days, "day", "n", "spent", e.count()).select("day", "done", *(F.round(c, 9).alias(c) for c in ("rate", "avg_rate", "pct")))


@query(f"with {NODES_SQL}, p as (select distinct project as id, 'docs/projects/' || project as path from nodes) select case when starts_with(id, 'src1') then 'docs/projects' else 'docs' end as root, count(*) as n, array_to_string(list_sort(list(id)), ',') as projects from p group by 1")
def projects_by_root(spark, sf):
    """Projects under two roots; the first root is that of projects whose name begins with src1."""
    p = S.nodes(spark, sf).select(F.col("project").alias("id"), F.concat(F.lit("docs/projects/"), "project").alias("path")).distinct()
    p = p.withColumn("path", F.when(F.startswith("id", F.lit("src1")), F.col("path")).otherwise(F.concat(F.lit("docs/other/"), "id")))
    return B.projects_by_root(p, ["docs/projects", "docs"]).select("root", "n", F.array_join("project_ids", ",").alias("projects"))


@query(f"with {THINGS_SQL}, {EDGES_SQL}, c as (select (select count(*) from things)::double as n, (select count(*) from edges)::double as m) select 'nodes' as metric, n as value from c union all select 'edges', m from c union all select 'density', round(m / (n * (n - 1)), 9) from c union all select 'avg_degree', round(2 * m / n, 9) from c union all select 'type ' || type, count(*)::double from things group by type")
def status_metrics(spark, sf):
    return B.status(S.things(spark, sf), S.edges(spark, sf)).withColumn("value", F.round("value", 9))


def _answers(spark, sf):
    """What a model might say on each document, in three forms."""
    d = S.table(spark, sf, "documents")
    begin = F.regexp_replace(F.substring("text", 1, 40), r"[{}<>`\"\\]", "")
    i = F.col("doc_id").cast("string")
    said = (
        F.when(F.col("doc_id") % 3 == 0, F.concat(begin, F.lit(' {"type": "pattern", "of": {"n": '), i, F.lit('}} and {"type": "other"} ')))
        .when(F.col("doc_id") % 3 == 1, F.concat(F.lit('<think>{"type": "failure"}</think>```json\n{"type": "decision", "of": {"n": '), i, F.lit("}}\n```")))
        .otherwise(F.concat(F.lit("{ "), begin, F.lit(' {"type": "failure", "of": {"n": '), i, F.lit(', "in": {"x": {}}}} and no more')))
    )
    return d.select("doc_id", said.alias("answer"))


@query("select doc_id, ['pattern', 'decision', 'failure'][(doc_id % 3 + 1)::int] as type, doc_id as n from documents where text is not null")
def nested_answers(spark, sf):
    found = _answers(spark, sf).select("doc_id", X.answer_object(F.col("answer")).alias("o"))
    return found.select("doc_id", F.get_json_object("o", "$.type").alias("type"), F.get_json_object("o", "$.of.n").cast("long").alias("n"))


@query("select 'r' || doc_id as record_id, case when lang = 'en' then 'Decision' else 'Pattern' end as type, case when lang = 'en' then 'Chose ' || source end as description, case when lang = 'en' then 'In ' || lang end as rationale, case when lang = 'en' and source = 'src1' then 2 when lang = 'en' then 0 end as alternatives, case when lang <> 'en' then 'Found ' || source end as name, case when lang <> 'en' then 'Breakthrough difficulty: ' || case when lang = 'fr' then 'hard' else 'medium' end end as context from documents")
def record_nodes(spark, sf):
    """Records made of documents' columns, eight lines each at most, read back and turned to nodes."""
    en = F.col("lang") == "en"
    lines = F.concat_ws(
        "\n", F.lit("## A record"), F.concat(F.lit("**ID:** r"), F.col("doc_id").cast("string")), F.when(en, F.concat(F.lit("**Decision:** Chose "), "source")), F.when(~en, F.concat(F.lit("**Breakthrough:** Found "), "source")),
        F.concat(F.lit("**Context:** In "), "lang"), F.when(F.col("source") == "src1", F.lit("**Tags:** TypeScript, x")), F.when(F.col("lang") == "fr", F.lit("**Difficulty:** hard")),
    )
    records = E.structured_records(S.table(spark, sf, "documents").select(lines.alias("text")))
    return E.record_nodes(records).select("record_id", "type", "description", "rationale", F.when(F.col("alternatives").isNotNull(), F.size("alternatives")).alias("alternatives"), "name", "context")


@query(f"with {EDGES_SQL} select count(*) as total, count(*) filter (where weight >= 0.9) as with_reasoning, count(*) filter (where rel_type <> 'LED_TO') as with_confidence, round(count(*) filter (where rel_type <> 'SEMANTICALLY_SIMILAR')::double / count(*), 9) as llm_share from edges")
def edge_quality_fields(spark, sf):
    """Edges of which some have a reason (those of weight 0.9 or more) and some no weight (those between turns)."""
    e = S.edges(spark, sf).withColumn("reasoning", F.when(F.col("weight") >= 0.9, "a foreign key").otherwise("")).withColumn("weight", F.when(F.col("rel_type") != "LED_TO", F.col("weight")))
    return B.edge_quality(e).withColumn("llm_share", F.round("llm_share", 9))


SQL["shortest_path_exists"] = f"""with recursive {EDGES_SQL}, place as (select c_custkey as c, n_nationkey as n, n_regionkey as r from customer join nation on c_nationkey = n_nationkey),
first as (select r, n from place where c = 1), other as (select min(c) as c from place, first where place.r = first.r and place.n <> first.n),
e as (select src, dst from edges where rel_type in ('DEPENDS_ON', 'IMPLEMENTS')), both_ as (select src, dst from e union select dst, src from e),
walk(id, d) as (select 'c:1', 0 union select b.dst, d + 1 from walk join both_ b on b.src = walk.id where d < 5)
select true as found, min(d)::int as length from walk where id = (select 'c:' || c from other) having min(d) is not null"""


@query("with unit as (select 'v' || lpad(vec_id::varchar, 9, '0') as id, list_transform(embedding, lambda x: x::double) as v, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as n from embeddings), p as (select x.id as src, y.id as dst, list_inner_product(x.v, y.v) / (x.n * y.n) as score from unit x join unit y on x.id <> y.id), r as (select *, row_number() over (partition by src order by score desc, dst) as rank from p where score >= 0.35) select src, dst, 'SEMANTICALLY_SIMILAR' as rel_type, round(score * 0.6, 6) as weight from r where rank <= 49")
def similarity_edges(spark, sf):
    """Edges to the nearest 49 over 0.35, weight 0.6 of the cosine, between rows named by strings as nodes are."""
    e = S.table(spark, sf, "embeddings").select(F.concat(F.lit("v"), F.lpad(F.col("vec_id").cast("string"), 9, "0")).alias("id"), "embedding")
    return R.similarity_edges(e, 0.35).withColumn("weight", F.round("weight", 6))


# ---- sections with their fields


def _any_of(words) -> str:
    return "(" + " or ".join(f"contains(lower(x), '{w}')" for w in words) + ")"


SQL["section_fields"] = rf"""with t as (select page_id as doc_id, {PAGE_SQL} as whole from pages),
s as (select doc_id, starts_with(whole, '#') as at_once, string_split(chr(10) || whole, chr(10) || '#')[2:] as parts from t),
p as (select doc_id, at_once, unnest(parts) as part, generate_subscripts(parts, 1) as k from s),
h as (select doc_id, (k - at_once::int)::int as place, lower(split_part(part, chr(10), 1)) as head, trim('#' || part, chr(32) || chr(10) || chr(9) || chr(13)) as text from p),
c as (select *, case when contains(head, 'the') or contains(head, 'der') then 'decision' when contains(head, 'e') then 'pattern' when contains(head, 'a') then 'failure' end as class from h),
l as (select *, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, chr(32) || chr(10) || chr(9) || chr(13))), lambda x: x <> '' and not starts_with(x, '#')) as lines from c where class is not null and length(text) > 50),
f as (select *, nullif(array_to_string(lines[2:3], ' '), '') as two, nullif(regexp_extract(text, '(?m)^#+\s+(.+)$', 1), '') as title, list_filter(lines, lambda x: {_any_of(X.LESSON_LINES)})[1] as lesson from l)
select doc_id, place, class, case when class = 'decision' then substr(lines[1], 1, 200) end as description,
    case when class = 'decision' then coalesce(substr(two, 1, 300), substr(lines[1], 1, 200)) end as rationale,
    case when class = 'decision' then coalesce(array_to_string(list_transform(list_filter(lines, lambda x: {_any_of(X.ALTERNATIVE_LINES)}), lambda x: substr(x, 1, 100))[1:3], '|'), '') end as alternatives,
    case when class = 'pattern' then substr(coalesce(title, lines[1]), 1, 80) end as name, case when class = 'pattern' then substr(coalesce(array_to_string(lines[1:2], ' '), ''), 1, 300) end as context,
    case when class = 'pattern' then substr(coalesce(array_to_string(lines, ' '), ''), 1, 500) end as implementation, case when class = 'pattern' then coalesce(substr(lines[1], 1, 100), '') end as use_cases,
    case when class = 'failure' then substr(lines[1], 1, 200) end as attempt, case when class = 'failure' then coalesce(substr(lines[2], 1, 300), 'See documentation') end as reason_failed,
    case when class = 'failure' then substr(lesson, 1, 300) end as lesson_learned, case when class = 'failure' then substr(lines[list_position(lines, lesson) + 1], 1, 200) end as alternative_solution
from f"""
