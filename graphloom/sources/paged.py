"""Paged stores and search services, read by `spark.read.format(...)`.

`paged_store`: records (id, document, metadata) that a service or a folder hands out in pages ordered by id. Each partition
is a range of ids and walks its pages by the last id seen, so what comes before a page is never counted through again, and a lost task walks
its own range again. Filters on id narrow the ranges, or name the very ids to fetch.

`search_service`: hits of one query after another from a service that answers in JSON; a partition is some of the queries.

Both take `path`: an http(s) address, or a folder that all executors can read (written by `write_pages`, `write_answers`).
An address answers GET {path}/count and {path}/get (limit, offset, after, start, until, ids, where) with ids, documents and metadatas,
and POST {path}/search of {query, limit}. Call `register(spark)` first.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import islice

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

from ..session import ship

RECORD = "id string, document string, metadata map<string,string>"
HIT = "query string, place int, conversation_id string, content string, metadata map<string,string>, source string, relevance_score double"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def register(spark: SparkSession) -> None:
    """Makes both formats known to the session, with filter pushdown."""
    ship(spark)
    spark.conf.set(PUSHDOWN, "true")
    for source in (PagedStore, SearchService):
        spark.dataSource.register(source)


# ---- where pages come from


@dataclass(frozen=True)
class Range(InputPartition):
    """Ids above `after`, from `start` on, up to and with `until`; or the ids named. None: no bound."""

    after: str | None = None
    start: str | None = None
    until: str | None = None
    ids: tuple[str, ...] | None = None

    def __contains__(self, i: str) -> bool:
        return (self.after is None or i > self.after) and (self.start is None or i >= self.start) and (self.until is None or i <= self.until) and (self.ids is None or i in self.ids)

    def meets(self, first: str, last: str) -> bool:
        """Whether ids from first to last may hold one of the range."""
        named = self.ids is None or any(first <= i <= last for i in self.ids)
        return named and (self.after is None or last > self.after) and (self.start is None or last >= self.start) and (self.until is None or first <= self.until)


def _holds(metadata: dict, where: dict) -> bool:
    return all(metadata.get(k) == v for k, v in where.items())


class HttpPages:
    """Pages from an address. A request that fails is tried again; if it fails to the end the read fails, as rows must not be lost unseen."""

    def __init__(self, path: str, timeout: float, tries: int):
        self.path, self.timeout, self.tries = path.rstrip("/"), timeout, tries

    def ask(self, what: str, body: dict | None = None, **given):
        given = {k: v for k, v in given.items() if v is not None}
        url = f"{self.path}/{what}" + ("?" + urllib.parse.urlencode(given) if given else "")
        request = urllib.request.Request(url, None if body is None else json.dumps(body).encode(), {"Content-Type": "application/json"})
        for k in range(self.tries):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    return json.load(answer)
            except (OSError, ValueError) as e:  # no connection, a status of an error, no JSON
                if k + 1 == self.tries or (isinstance(e, urllib.error.HTTPError) and e.code < 500):
                    raise
                time.sleep(0.1 * 2**k)

    def splits(self, parts: int) -> list[str]:
        """Ids that cut the store into about so many ranges: the ids that stand at even places."""
        step = -(-self.ask("count")["count"] // parts)
        return [i for k in range(1, parts) if step for i in self.ask("get", limit=1, offset=k * step - 1)["ids"]]

    def page(self, of: Range, limit: int, where: dict) -> list[tuple]:
        found = self.ask("get", limit=limit, after=of.after, start=of.start, until=of.until, ids=None if of.ids is None else json.dumps(of.ids), where=json.dumps(where) if where else None)
        rows = zip(found["ids"], found["documents"], found["metadatas"], strict=True)
        return [(str(i), d, {k: None if v is None else str(v) for k, v in (m or {}).items()}) for i, d, m in rows]

    def answer(self, query: str, limit: int):
        return self.ask("search", {"query": query, "limit": limit})


class FolderPages:
    """Pages from JSON files and a list of them (first and last id, rows); only pages that a range meets are opened."""

    def __init__(self, path: str):
        self.files, self.root = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
        self.root = self.root.rstrip("/")
        self._pages: list[dict] | None = None
        self._open: tuple[str, list] = ("", [])
        self.opened = 0

    def _lines(self, name: str) -> list[dict]:
        with self.files.open_input_file(name) as f:
            return [json.loads(line) for line in f.read().splitlines() if line.strip()]

    def _json_files(self, folder: str) -> list[str]:
        found = self.files.get_file_info(pafs.FileSelector(f"{self.root}/{folder}", allow_not_found=True))
        return sorted(x.path for x in found if x.is_file and x.path.endswith(".json"))

    def pages(self) -> list[dict]:
        if self._pages is None:
            self._pages = sorted((row for name in self._json_files("list") for row in self._lines(name)), key=lambda p: p["first"])
            self._lasts = [p["last"] for p in self._pages]
        return self._pages

    def splits(self, parts: int) -> list[str]:
        """Last ids of pages, as even in rows as pages allow."""
        step = max(1, -(-sum(p["n"] for p in self.pages()) // parts))
        out, seen = [], 0
        for p in self.pages()[:-1]:
            seen += p["n"]
            if seen >= step * (len(out) + 1):
                out.append(p["last"])
        return out

    def _rows(self, name: str) -> list[tuple]:
        if self._open[0] != name:
            self._open = (name, sorted((r["id"], r.get("document"), r.get("metadata") or {}) for r in self._lines(f"{self.root}/pages/{name}")))
            self.opened += 1
        return self._open[1]

    def page(self, of: Range, limit: int, where: dict) -> list[tuple]:
        out: list[tuple] = []
        pages = self.pages()
        begin = bisect_left(self._lasts, max(of.after or "", of.start or ""))
        for p in islice(pages, begin, None):
            if of.until is not None and p["first"] > of.until or len(out) >= limit:
                break
            if of.meets(p["first"], p["last"]):
                out += [r for r in self._rows(p["name"]) if r[0] in of and _holds(r[2], where)]
        return out[:limit]

    def answer(self, query: str, limit: int):
        names = self._json_files(f"answers/key={key_of(query)}")
        return json.loads(self._lines(names[0])[0]["answer"]) if names else []


def key_of(query: str) -> str:
    return hashlib.md5(query.encode()).hexdigest()


def _client(options: dict):
    path = options["path"]
    return HttpPages(path, float(options.get("timeout", 30)), int(options.get("tries", 3))) if path.startswith(("http://", "https://")) else FolderPages(path)


# ---- the paged store


class PagedStore(DataSource):
    """Options: path; page_size (1000 records a request); parts (8 ranges); where (JSON: metadata that records must have)."""

    @classmethod
    def name(cls) -> str:
        return "paged_store"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(dict(self.options))


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.bounds = options, Range()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Narrows the range by filters on id. Strict upper bounds are left to Spark as well."""
        for f in filters:
            if getattr(f, "attribute", None) != ("id",) or not _narrows(f):
                yield f
                continue
            self.bounds = _narrowed(self.bounds, f)
            if isinstance(f, (LessThan, StringStartsWith)):
                yield f

    def partitions(self) -> list[Range]:
        of, parts = self.bounds, max(1, int(self.options.get("parts", 8)))
        if of.ids is not None:
            ids = sorted(i for i in set(of.ids) if i in replace(of, ids=None))
            size = -(-len(ids) // parts) or 1
            return [Range(ids=tuple(ids[k : k + size])) for k in range(0, len(ids), size)]
        inner = sorted({i for i in _client(self.options).splits(parts) if i in of})
        ends = [*inner, None]
        return [replace(of, after=a if k else of.after, start=None if k else of.start, until=b if b is not None else of.until) for k, (a, b) in enumerate(zip([None, *inner], ends, strict=True))]

    def read(self, partition: Range) -> Iterator[tuple]:
        client, size = _client(self.options), max(1, int(self.options.get("page_size", 1000)))
        where = json.loads(self.options.get("where", "{}"))
        while True:
            rows = client.page(partition, size, where)
            yield from rows
            if len(rows) < size:
                return
            partition = replace(partition, after=rows[-1][0], start=None)


def _narrows(f: Filter) -> bool:
    if isinstance(f, In):
        return all(isinstance(v, str) for v in f.value)
    return isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, StringStartsWith)) and isinstance(f.value, str)


def _narrowed(of: Range, f: Filter) -> Range:
    most = lambda a, b: b if a is None else max(a, b)
    least = lambda a, b: b if a is None else min(a, b)
    if isinstance(f, (EqualTo, In)):
        named = set(f.value if isinstance(f, In) else (f.value,))
        return replace(of, ids=tuple(sorted(named if of.ids is None else named & set(of.ids))))
    if isinstance(f, GreaterThan):
        return replace(of, after=most(of.after, f.value))
    if isinstance(f, GreaterThanOrEqual):
        return replace(of, start=most(of.start, f.value))
    if isinstance(f, StringStartsWith):
        return replace(of, start=most(of.start, f.value), until=of.until if (end := _behind(f.value)) is None else least(of.until, end))
    return replace(of, until=least(of.until, f.value))


def _behind(prefix: str) -> str | None:
    """The first string behind all that begin so; None if there is none."""
    while prefix and ord(prefix[-1]) == 0x10FFFF:
        prefix = prefix[:-1]
    if not prefix:
        return None
    k = ord(prefix[-1]) + 1
    return prefix[:-1] + chr(0xE000 if 0xD800 <= k < 0xE000 else k)


# ---- the search service


@dataclass
class Queries(InputPartition):
    queries: tuple[tuple[int, str], ...]


class SearchService(DataSource):
    """Options: path; queries (a JSON list); limit (50 hits a query); each (queries a partition, 1); errors (fail, or skip: a query that fails has no hits)."""

    @classmethod
    def name(cls) -> str:
        return "search_service"

    def schema(self) -> str:
        return HIT

    def reader(self, schema) -> DataSourceReader:
        return SearchReader(dict(self.options))


class SearchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.queries = options, list(dict.fromkeys(json.loads(options["queries"])))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("query",):
                wanted = f.value if isinstance(f, In) else (f.value,)
                self.queries = [q for q in self.queries if q in wanted]
            else:
                yield f

    def partitions(self) -> list[Queries]:
        each = max(1, int(self.options.get("each", 1)))
        return [Queries(tuple(enumerate(self.queries))[k : k + each]) for k in range(0, len(self.queries), each)]

    def read(self, partition: Queries) -> Iterator[tuple]:
        client, limit = _client(self.options), int(self.options.get("limit", 50))
        for _, query in partition.queries:
            try:
                found = hits_of(client.answer(query, limit))
            except (OSError, ValueError):
                if self.options.get("errors", "fail") != "skip":
                    raise
                continue
            for place, h in enumerate(found[:limit], 1):
                metadata = {k: v if isinstance(v, str) or v is None else json.dumps(v) for k, v in (h.get("metadata") or {}).items()}
                distance = h.get("distance")
                yield (
                    query, place, _text(h.get("conversation_id") or metadata.get("conversation_id") or h.get("id")), _text(h.get("content") or h.get("document")), metadata,
                    _text(h.get("source") or metadata.get("source")), 1.0 - float(0.5 if distance is None else distance),
                )


def _text(v) -> str | None:
    return v if v is None or isinstance(v, str) else str(v)


def hits_of(answer) -> list[dict]:
    """The list of hits, under results.results, under results, or the answer itself; another shape has none."""
    if isinstance(answer, dict):
        answer = answer.get("results")
        if isinstance(answer, dict):
            answer = answer.get("results")
    return [h for h in answer if isinstance(h, dict)] if isinstance(answer, list) else []


# ---- folders


def write_pages(records: DataFrame, folder: str, page_rows: int = 1000) -> None:
    """Records (id, document, metadata) as pages in order of id, and the list of pages. Ids must differ: a repeated or null one is an error.

    One shuffle by ranges of ids; the list has a row for each page.
    """
    spark = records.sparkSession
    rows = records.select(F.col("id").cast("string").alias("id"), "document", "metadata")
    rows.repartitionByRange("id").sortWithinPartitions("id").write.option("maxRecordsPerFile", page_rows).json(f"{folder}/pages")
    pages = spark.read.schema(RECORD).json(f"{folder}/pages").groupBy(F.col("_metadata.file_name").alias("name"))
    pages = pages.agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))
    pages.where("n > 0").coalesce(1).write.json(f"{folder}/list")
    listed = spark.read.schema("name string, first string, last string, n long, ids long").json(f"{folder}/list")
    ends = listed.select(F.explode(F.when(F.col("first") == F.col("last"), F.array("first")).otherwise(F.array("first", "last"))).alias("id"))
    if listed.where("n <> ids").limit(1).count() or ends.groupBy("id").count().where("count > 1").limit(1).count():
        raise ValueError("ids of a paged store must differ and not be null")


def write_answers(answers: DataFrame, folder: str) -> None:
    """Answers (query, answer: JSON) of a search service, one folder for each query."""
    answers.select(F.md5("query").alias("key"), "query", "answer").write.partitionBy("key").json(f"{folder}/answers")


def messages(records: DataFrame) -> DataFrame:
    """Chat messages of a store's records: the metadata as columns, with the values of those that lack one."""
    m = lambda k, otherwise: F.coalesce(F.col("metadata")[k], F.lit(otherwise)).alias("conv_id" if k == "conversation_id" else k)
    unknown = [m(k, "unknown") for k in ("conversation_id", "role", "project", "source")]
    return records.select("id", F.col("document").alias("content"), *unknown, *(m(k, "") for k in ("timestamp", "cwd", "git_branch")))
