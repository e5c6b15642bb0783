"""Payloads by windows: pushed ranges are in the requests, bodies are landed as they came, restarts ask for nothing again."""

import json
import threading
from datetime import UTC, date, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest

from tallyforge.sources import landing

#: Bytes that a parser would change.
BODY = b'{"accounts" : [ ],\n "errors":["\xc3\xa9"] , "from": "%s"}\n'


@pytest.fixture
def server():
    asked, headers = [], []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = parse_qs(urlsplit(self.path).query)
            day = lambda k: datetime.fromtimestamp(int(q[k][0]), UTC).date().isoformat()
            asked.append((day("start-date"), day("end-date")))
            headers.append(self.headers.get("Authorization"))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(BODY % asked[-1][0].encode())

        def log_message(self, *_):
            pass

    found = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=found.serve_forever, daemon=True).start()
    yield f"http://u%40x:p@127.0.0.1:{found.server_port}/bridge", asked, headers
    found.shutdown()


@pytest.fixture
def source(spark):
    name = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    spark.dataSource.register(landing.LandingSource)
    yield spark
    spark.conf.set(name, before)


def test_windows():
    day = date.fromisoformat
    assert [(str(w.start), str(w.end)) for w in landing.windows(day("2024-01-30"), day("2024-02-05"), 3)] == [("2024-01-30", "2024-02-01"), ("2024-02-02", "2024-02-04"), ("2024-02-05", "2024-02-05")]
    assert landing.windows(day("2024-01-02"), day("2024-01-01"), 3) == []
    with pytest.raises(ValueError):
        landing.Landing({"url": "http://x", "days": "91"})


def test_a_range_of_days_is_asked_for_and_landed(source, server, tmp_path):
    url, asked, headers = server
    table = source.read.format("landing").options(url=url, root=str(tmp_path), days=10, until="2024-12-31").load()
    some = table.where("start >= date'2024-03-01' and end < date'2024-03-26' and length(body) > 3")
    rows = sorted(some.collect())
    assert sorted(asked) == [("2024-03-01", "2024-03-11"), ("2024-03-11", "2024-03-21"), ("2024-03-21", "2024-03-26")]  # the end is not included
    assert [(str(r.start), str(r.end)) for r in rows] == [("2024-03-01", "2024-03-10"), ("2024-03-11", "2024-03-20"), ("2024-03-21", "2024-03-25")]
    for r in rows:
        landed = (tmp_path / f"{r.start}_{r.end}.json").read_bytes()
        assert landed == BODY % str(r.start).encode() and r.body.encode() == landed and json.loads(r.body)["accounts"] == []
    assert set(headers) == {"Basic dUB4OnA="}
    assert some.count() == 3 and len(asked) == 3  # landed windows are not asked for again
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(".")]


def test_nothing_is_kept_without_a_root(source, server):
    url, asked, _ = server
    table = source.read.format("landing").options(url=url, until="2024-01-03").load()
    assert [r.path for r in table.where("start = date'2024-01-02'").collect()] == [None] and asked == [("2024-01-02", "2024-01-04")]
    with pytest.raises(Exception, match="first day"):
        source.read.format("landing").options(url=url, until="2024-01-03").load().collect()
    both = [landing.payloads(source, date(2024, 1, a), date(2024, 1, b), url=url, days=2, until="2024-02-01") for a, b in ((1, 3), (5, 5))]
    assert [len(x.collect()) for x in both] == [2, 1] and asked[1:] == [("2024-01-01", "2024-01-03"), ("2024-01-03", "2024-01-04"), ("2024-01-05", "2024-01-06")]


def test_a_stream_goes_on_where_it_was(source, server, tmp_path):
    url, asked, _ = server

    def run(until):
        stream = source.readStream.format("landing").options(url=url, root=str(tmp_path / "land"), days=7, until=until, **{"from": "2024-01-01"}).load()
        query = stream.select("start", "end", "sha256").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        try:
            assert query.awaitTermination(90)
        finally:
            query.stop()
        return sorted((str(r.start), str(r.end)) for r in source.read.parquet(str(tmp_path / "out")).collect())

    first = run("2024-01-10")
    assert first == [("2024-01-01", "2024-01-07"), ("2024-01-08", "2024-01-10")] and len(asked) == 2
    assert run("2024-01-10") == first and len(asked) == 2  # a restart reads nothing again
    assert run("2024-01-12") == [*first, ("2024-01-11", "2024-01-12")] and asked[2:] == [("2024-01-11", "2024-01-13")]
