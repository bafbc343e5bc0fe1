"""The seven tools as table functions of SQL: SELECT * FROM find_related('D-12345678', 2).

Reading tools are SQL functions over two tables of the graph, so their bodies are planned with the query that calls them. Writing tools are
Python functions that check their arguments and give one row, to be inserted: INSERT INTO kg_nodes SELECT * FROM add_decision(...).
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult

from .api import KnowledgeGraph
from .functions.text import STOP_QUERY
from .operators.search import FIELDS
from .schema import BOUNDS, NODE, OPTIONAL, PREFIX
from .session import kept, ship

#: Steps that find_related follows at most in SQL, where each is a join of its own.
DEPTH = 5


def _adds(kind: str) -> type:
    """A table function that gives a node of a type from named arguments; an error if a field is out of bounds."""

    class Adds:
        @staticmethod
        def analyze(**given: AnalyzeArgument) -> AnalyzeResult:
            if unknown := set(given) - {*BOUNDS[kind], "alternatives", "related_to", "use_cases", "source_files"}:
                raise ValueError(f"no such field: {', '.join(sorted(unknown))}")
            return AnalyzeResult(NODE)

        def eval(self, **fields):
            for f, (low, high) in BOUNDS[kind].items():
                v = fields.get(f)
                if not (v is None and f in OPTIONAL) and (v is None or not low <= len(v) <= high):
                    raise ValueError(f"{f} must have {low} to {high} characters")
            for f in ("alternatives", "related_to"):
                if fields.get(f) is not None:
                    fields[f] = [x.strip() for x in fields[f] if x and x.strip()]
            now = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
            row = {"id": f"{PREFIX[kind]}-{uuid.uuid4().hex[:8]}", "type": kind, "timestamp": now, "source_files": [], **fields}
            yield tuple(row.get(f.name) for f in NODE.fields)

    return Adds


def _related(nodes: str, edges: str) -> str:
    steps = ["links as (select src as a, dst as b from {e} union select dst, src from {e})".format(e=edges), "r1 as (select distinct b as id from links where a = node_id and depth >= 1)"]
    steps += [f"r{k} as (select distinct b as id from links join r{k - 1} on a = r{k - 1}.id where depth >= {k})" for k in range(2, DEPTH + 1)]
    found = " union all ".join(f"select id, {k} as d from r{k}" for k in range(1, DEPTH + 1))
    return f"""with {", ".join(steps)}, near as (select id, min(d) as distance from ({found}) where id <> node_id group by id)
        select near.id, near.distance, n.type, n.description, n.rationale, n.alternatives, n.name, n.implementation, n.attempt, n.lesson_learned from near join {nodes} n on n.id = near.id"""


def _timeline(nodes: str) -> str:
    content = f"concat_ws(' ', {', '.join(FIELDS)})"
    return f"""select timestamp, lower(type), id, {content} from {nodes}
        where timestamp between try_to_timestamp(first_day)::timestamp_ntz and try_to_timestamp(last_day)::timestamp_ntz and contains(lower({content}), lower(topic)) order by timestamp, id limit 1000"""


def _decisions(nodes: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_QUERY)
    content = f"concat_ws(' ', {', '.join(FIELDS)})"
    holds = " or ".join(f"contains(lower(n.{f}), word)" for f in FIELDS)
    plain = r"lower(regexp_replace(regexp_replace(question, '(?i)in\\s+Q[1-4]\\s*\\d{4}', ''), '(?i)in\\s+(timeframe|period)', ''))"
    quarter = r"nullif(regexp_extract(question, '(?i)Q([1-4])\\s*(\\d{4})', %d), '')::int"
    return f"""with w as (select slice(filter(regexp_extract_all({plain}, '[\\\\p{{L}}\\\\p{{N}}_]+', 0), x -> x not in ({stop})), 1, 10) as words, {quarter % 1} as q, {quarter % 2} as y),
        nodes_ as (select n.*, words from {nodes} n, w where q is null or n.timestamp::date between make_date(y, q * 3 - 2, 1) and last_day(make_date(y, q * 3, 1))),
        k as (select posexplode(slice(words, 1, 5)) as (place, word) from w),
        hits as (select n.id, place, row_number() over (partition by place order by n.id) as rank from nodes_ n, k where {holds}),
        ranked as (select id, row_number() over (order by place, rank) as r from hits where rank <= 10),
        fused as (select id, sum(1.0D / (60 + r)) as rrf from ranked group by id),
        scored as (select n.id, {content} as content, rrf, aggregate(array_distinct(words), 0D, (a, x) -> a + if(contains(lower({content}), x), 1D, 0D)) / size(array_distinct(words)) as score from nodes_ n join fused f on n.id = f.id)
        select id, content, score, rrf from scored order by score desc, rrf desc, id limit 15"""


def register(graph: KnowledgeGraph, prefix: str = "kg", with_gaps: bool = True) -> None:
    """Makes the tables {prefix}_nodes and {prefix}_edges over the graph's folders, and the seven functions, known to the session.

    What is inserted through the tables is seen by the functions at once; after writes past them, or for gaps as of now, call this again.
    detect_gaps() reads what was found at registration, as its rounds are no single plan; without `with_gaps` it is left out.
    """
    spark: SparkSession = graph.spark
    ship(spark)
    nodes, edges, gaps = (f"{prefix}_{n}" for n in ("nodes", "edges", "gaps"))
    for name, folder, schema, part in ((nodes, "nodes", graph.nodes.schema, "PARTITIONED BY (type)"), (edges, "edges", graph.edges.schema, "")):
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {part} LOCATION '{graph.path}/{folder}'")
        if part:
            spark.sql(f"MSCK REPAIR TABLE {name}")

    def make(head: str, returns: str, body: str) -> None:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS TABLE ({returns}) RETURN {body}")

    make(
        "find_related(node_id STRING, depth INT DEFAULT 1)",
        "id STRING, distance INT, type STRING, description STRING, rationale STRING, alternatives ARRAY<STRING>, name STRING, implementation STRING, attempt STRING, lesson_learned STRING", _related(nodes, edges),
    )
    make("get_timeline(topic STRING, first_day STRING, last_day STRING)", "timestamp TIMESTAMP_NTZ, type STRING, id STRING, content STRING", _timeline(nodes))
    make("query_decisions(question STRING)", "id STRING, content STRING, score DOUBLE, rrf DOUBLE", _decisions(nodes))
    if with_gaps:
        found = graph.detect_gaps()
        kept(found, "gaps").createOrReplaceTempView(gaps)
        make("detect_gaps()", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema.fields), f"SELECT * FROM {gaps}")
    for kind in BOUNDS:
        spark.udtf.register(f"add_{kind.lower()}", F.udtf(_adds(kind)))
