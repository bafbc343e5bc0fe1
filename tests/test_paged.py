"""Paged stores and search services: folders and a service on this machine, against what they hold."""

import json
import random
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from graphloom.sources import paged

RECORDS = sorted((f"{r:05d}" if r % 7 else f"é{r}", f"text {r}" if r % 5 else None, {"role": "user" if r % 3 else "assistant", "n": str(r)} if r % 11 else {}) for r in random.Random(4).sample(range(90_000), 1234))


class Service(BaseHTTPRequestHandler):
    asked, fail = [], 0

    def log_message(self, *_):
        pass

    def send(self, answer, status=200):
        body = json.dumps(answer).encode()
        self.send_response(status)
        self.end_headers()
        self.wfile.write(body)

    def do_GET(self):
        url = urlparse(self.path)
        q = {k: v[0] for k, v in parse_qs(url.query).items()}
        Service.asked.append((url.path, q))
        if Service.fail:
            Service.fail -= 1
            return self.send({}, 503)
        if url.path == "/count":
            return self.send({"count": len(RECORDS)})
        rows = [r for r in RECORDS if r[0] > q.get("after", "") and r[0] >= q.get("start", "") and ("until" not in q or r[0] <= q["until"])]
        rows = [r for r in rows if ("ids" not in q or r[0] in json.loads(q["ids"])) and all(r[2].get(k) == v for k, v in json.loads(q.get("where", "{}")).items())]
        rows = rows[int(q.get("offset", 0)) :][: int(q["limit"])]
        return self.send({"ids": [r[0] for r in rows], "documents": [r[1] for r in rows], "metadatas": [r[2] for r in rows]})

    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if asked["query"] == "bad":
            return self.send({"message": "no"}, 400)
        hit = {"id": 7, "document": f"about {asked['query']}", "metadata": {"source": "s", "tags": ["a"]}, "distance": 0.25}
        return self.send({"nested": {"results": {"results": [hit, {"conversation_id": "c", "content": "x"}]}}, "flat": {"results": [hit]}, "bare": [hit, "junk"]}.get(asked["query"], {"other": 1}))


@pytest.fixture(scope="module")
def service():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("store"))
    rows = spark.createDataFrame(RECORDS, paged.RECORD).repartition(3)
    paged.write_pages(rows, at + "/all", 50)
    return at


@pytest.fixture(scope="module", params=["folder", "service"])
def store(request, spark, service, folder):
    paged.register(spark)
    path = folder + "/all" if request.param == "folder" else service
    return lambda **options: spark.read.format("paged_store").options(path=path, **options).load()


def rows_of(df):
    return sorted((r.id, r.document, r.metadata) for r in df.collect())


@pytest.mark.parametrize("options", [{}, {"page_size": 7, "parts": 3}, {"page_size": 10_000, "parts": 1}, {"parts": 500}])
def test_whole_store(store, options):
    assert rows_of(store(**options)) == RECORDS


def test_metadata_condition(store):
    assert rows_of(store(page_size=20, where=json.dumps({"role": "assistant"}))) == [r for r in RECORDS if r[2].get("role") == "assistant"]


A, B = RECORDS[300][0], RECORDS[700][0]


@pytest.mark.parametrize("condition,holds", [
    (f"id > '{A}'", lambda i: i > A), (f"id >= '{A}' and id < '{B}'", lambda i: A <= i < B), (f"id > '{A}' and id <= '{B}'", lambda i: A < i <= B), (f"id = '{A}'", lambda i: i == A),
    (f"id in ('{A}', '{B}', 'none')", lambda i: i in (A, B)), (f"id in ('{A}', '{B}') and id > '{A}'", lambda i: i == B), ("id like '01%'", lambda i: i.startswith("01")), ("id like 'é%'", lambda i: i.startswith("é")),
    (f"id > '{B}' and id < '{A}'", lambda i: False), ("id is null", lambda i: False), ("document = 'text 3'", None), (f"id <> '{A}'", lambda i: i != A),
])
def test_filters(store, condition, holds):
    want = [r for r in RECORDS if (r[1] == "text 3" if holds is None else holds(r[0]))]
    assert rows_of(store(page_size=20, parts=4).where(condition)) == want


def test_what_a_range_asks_for(spark, service, folder):
    paged.register(spark)
    Service.asked.clear()
    found = spark.read.format("paged_store").options(path=service, page_size=100).load().where(F.col("id").isin(A, B)).collect()
    asked = [q for p, q in Service.asked if p == "/get"]
    assert len(found) == 2 and sorted(i for q in asked for i in json.loads(q["ids"])) == sorted([A, B])
    pages = paged.FolderPages(folder + "/all")
    assert [r[0] for r in pages.page(paged.Range(after=A, until=B), 10, {})] == [r[0] for r in RECORDS[301:311]] and pages.opened <= 2


def test_tries_again_and_fails_aloud(spark, service):
    paged.register(spark)
    Service.fail = 1
    assert spark.read.format("paged_store").options(path=service, parts=1).load().count() == len(RECORDS)
    with pytest.raises(Exception, match="404|503|refused|URLError|HTTP"):
        spark.read.format("paged_store").options(path="http://127.0.0.1:9", parts=1, tries=1, timeout=1).load().count()


def test_empty_store_and_repeated_ids(spark, tmp_path):
    paged.register(spark)
    paged.write_pages(spark.createDataFrame([], paged.RECORD), str(tmp_path / "none"))
    assert spark.read.format("paged_store").option("path", str(tmp_path / "none")).load().count() == 0
    for k, ids in enumerate((["a", "b", "a"], ["a", None])):
        with pytest.raises(ValueError):
            paged.write_pages(spark.createDataFrame([(i, "x", {}) for i in ids], paged.RECORD), str(tmp_path / f"bad{k}"))


def test_search_shapes(spark, service):
    paged.register(spark)
    ask = lambda *queries, **options: spark.read.format("search_service").options(path=service, queries=json.dumps(queries), **options).load()
    got = {(r["query"], r.place): r for r in ask("nested", "flat", "bare", "other").collect()}
    assert sorted(got) == [("bare", 1), ("flat", 1), ("nested", 1), ("nested", 2)]
    r = got["flat", 1]
    assert (r.conversation_id, r.content, r.source, r.relevance_score, r.metadata) == ("7", "about flat", "s", 0.75, {"source": "s", "tags": '["a"]'})
    assert (got["nested", 2].relevance_score, got["nested", 2].metadata, got["nested", 2].source) == (0.5, {}, None)
    assert ask("flat", "bad", errors="skip").count() == 1 and ask("bad", "flat").where("query = 'flat'").count() == 1
    with pytest.raises(Exception, match="400"):
        ask("bad").count()


def test_messages_have_defaults(spark):
    rows = spark.createDataFrame([("1", "t", {"role": "user", "cwd": "/x"}), ("2", None, {})], paged.RECORD)
    got = [tuple(r) for r in paged.messages(rows).orderBy("id").collect()]
    assert got == [("1", "t", "unknown", "user", "unknown", "unknown", "", "/x", ""), ("2", None, "unknown", "unknown", "unknown", "unknown", "", "", "")]
