"""Decisions, classifier, sources, sinks and streams."""

import json
import threading
from datetime import date
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from tallyforge.plans import decisions, naive_bayes, proposals, views
from tallyforge.sources import api, files, sinks
from tallyforge.streaming import replay

LOG = "seq bigint, field string, source string, by string, action string, activity_id string, merchant string, value string, note string, check boolean, accepted boolean, confidence double, rule_id string, reverts bigint"


def rows(spark):
    data = [("1", 1, "M", "M", "d", None, "v", 0.9), ("2", 2, "M", "M", None, "card", "v", 0.4), ("3", 3, "", "", None, None, "w", 0.99)]
    return spark.createDataFrame(data, "id string, ord int, merchant string, name string, account_value string, cardmember_value string, guess string, guess_confidence double")


def kept(log):
    """The log as it is read back after an action has been written."""
    return log.sparkSession.createDataFrame(log.collect(), log.schema)


def labels(spark, log, **more):
    return {r.id: (r.label_source, r.label) for r in decisions.resolve(rows(spark), log, **more).collect()}


def test_precedence_masks_and_undo(spark):
    log = spark.createDataFrame([], LOG)
    assert labels(spark, log) == {"1": ("account", "d"), "2": ("cardmember", "card"), "3": (None, None)}
    assert labels(spark, log, threshold=0.9)["3"] == ("model", "w")
    one = kept(decisions.labelled(log, rows(spark), "x", "me", "a1", merchant="M"))
    assert labels(spark, one) == {"1": ("merchant", "x"), "2": ("merchant", "x"), "3": (None, None)}
    same = kept(decisions.labelled(one, rows(spark), "x", "me", "a2", merchant="M"))
    assert same.count() == one.count()
    two = kept(decisions.labelled(one, rows(spark), None, "me", "a3", merchant="M"))
    assert labels(spark, two)["1"] == (None, None)  # a null of a merchant masks the account's default
    three = kept(decisions.labelled(two, rows(spark), None, "me", "a4", ids=["1"]))
    assert labels(spark, three)["1"] == ("user", None)
    back = kept(decisions.undone(kept(decisions.undone(three, "me")), "me"))
    assert labels(spark, back) == labels(spark, one)
    assert [r.reverted for r in decisions.history(back).orderBy("seq").collect()] == [False, True, True]
    assert [r.seq for r in back.orderBy("seq").collect()] == [1, 2, 3, 4, 5]


def test_accepting_keeps_provenance_only_of_the_same_guess(spark):
    items = spark.createDataFrame([("1", "v"), ("2", "other")], "id string, value string")
    log = kept(decisions.accepted(spark.createDataFrame([], LOG), rows(spark), items, "me", "a"))
    assert {r.activity_id: r.confidence for r in log.collect()} == {"1": 0.9, "2": None}
    named = kept(decisions.renamed(log, ["M"], "  New   name ", "me", "b"))
    assert [tuple(r) for r in decisions.names(named).collect()] == [("M", "New name")]
    assert decisions.names(decisions.renamed(named, ["M"], "M", "me", "c")).count() == 0


def examples(spark):
    data = [(str(i), [f"m:{'AB'[i % 2]}{i % 6}", f"w:{'left right'.split()[i % 2]}"], "LR"[i % 2], 1.0) for i in range(60)]
    return spark.createDataFrame(data, "id string, features array<string>, label string, weight double")


def test_classifier_and_calibration(spark):
    rows = examples(spark)
    model = naive_bayes.fit(rows, ["L", "R"])
    scored = naive_bayes.scores(rows, model)
    assert all(r.guess == "LR"[int(r.id) % 2] for r in naive_bayes.best(scored).collect())
    assert {round(r.s, 9) for r in scored.groupBy("id").agg(F.sum("posterior").alias("s")).collect()} == {1.0}
    top = {r.id: r.reasons[0].feature for r in naive_bayes.reasons(rows, model, scored).collect()}
    assert top["0"] == "w:left"
    held = naive_bayes.out_of_fold(rows, ["L", "R"])
    assert held.count() == 60
    pairs = spark.createDataFrame([(p / 100, p % 10 < p // 10) for p in range(1, 100)], "posterior double, correct boolean")
    slope, intercept = naive_bayes.fit_calibration(pairs)
    assert slope > 0
    found = pairs.select("posterior", naive_bayes.calibrated(F.col("posterior"), slope, intercept).alias("c")).orderBy("posterior").collect()
    assert [r.c for r in found] == sorted(r.c for r in found)
    assert naive_bayes.fit_calibration(pairs.limit(0)) == (1.0, 0.0)


def test_thresholds_and_gate(spark):
    pairs = spark.createDataFrame([("a", 0.8, "a")] * 40 + [("a", 0.6, "b")] * 10, "guess string, confidence double, truth string")
    assert naive_bayes.threshold(pairs) == 0.61
    assert naive_bayes.threshold(pairs.limit(3)) is None
    assert naive_bayes.may_apply(pairs, 0.7) and not naive_bayes.may_apply(pairs, 0.5)


def test_model_answers_are_asked_for_once(spark):
    asked = spark.createDataFrame([("A", ["x"]), ("B", ["y"])], "merchant string, notes array<string>")
    none = spark.createDataFrame([], "merchant string, facts string")
    answers = proposals.ask(asked, none, lambda cards: [{"category_id": "c", "p": 0.5} for _ in cards])
    assert answers.count() == 2
    known = answers.where("merchant = 'A'").select("merchant", "facts")
    assert [r.merchant for r in proposals.ask(asked, known, lambda cards: [{"category_id": None, "p": 1} for _ in cards]).collect()] == ["B"]


@pytest.mark.parametrize("order", list(views.ORDERS))
def test_queue_orders(spark, order):
    data = [("1", 1, "A", "A", 10.0, date(2024, 1, 1), 0.5), ("2", 2, "B", "B", 30.0, date(2024, 1, 3), 0.9), ("3", 3, "", "", 1.0, date(2024, 1, 2), 0.1)]
    table = spark.createDataFrame(data, "id string, ord int, merchant string, name string, amount double, day date, guess_confidence double").selectExpr("*", "guess_confidence posterior", "cast(null as string) label", "cast(null as string) label_source", "array() category_ids", "1.0 visible_amount", "false foreign_event")
    found = [r.key for r in views.queue(table, order).collect()]
    want = {"impact": ["A", "B", "#3"], "low-confidence": ["#3", "A", "B"], "high-confidence": ["B", "A", "#3"], "newest": ["B", "#3", "A"], "oldest": ["A", "#3", "B"], "amount": ["B", "A", "#3"], "merchant": ["#3", "A", "B"]}
    assert found == want[order]
    assert [r.key for r in views.queue(table, order, ["^A$"]).collect()][-1] == "A"


def snapshot(path, amount, at, day="2024-01-01"):
    folder = path / day
    folder.mkdir(parents=True, exist_ok=True)
    txn = {"id": "t", "posted": 1700000000, "amount": amount, "description": "d", "payee": f"p{at}"}
    (folder / f"{at}.json").write_text(json.dumps({"accounts": [{"id": "a", "balance": "1", "balance-date": at, "transactions": [txn]}]}))


def test_sources(spark, tmp_path):
    snapshot(tmp_path / "raw", "1", 5)
    snapshot(tmp_path / "raw", "2", 6, "2024-01-02")
    (tmp_path / "raw/2024-01-02/bad.json").write_text("{")
    read = files.snapshots(spark, str(tmp_path / "raw/*/*.json"))
    assert read.count() == 2 and files.accounts(read).count() == 2
    assert [(r.key, r.payee) for r in files.extras(read).collect()] == [("src:a:t", "p6")]
    (tmp_path / "x.csv").write_bytes('﻿Id,Text\n1,"a ""b"""\n2, \n1,last\n'.encode())
    assert [tuple(r) for r in files.exports(spark, str(tmp_path / "x.csv"), ["k:", "{Id}"], "Text").collect()] == [("k:1", "last", None)]
    (tmp_path / "x.ofx").write_bytes("<STMTTRN><DTPOSTED>20240105120000<TRNAMT>-3.50<MEMO>caf\xe9 J DOE</STMTTRN>\n<STMTTRN><DTPOSTED>20240106<TRNAMT>4<MEMO>x</STMTTRN>".encode("latin-1"))
    lines = files.statement_lines(spark, str(tmp_path / "x.ofx"), [("DOE", "jane"), ("caf", "other")]).orderBy("line").collect()
    assert [(r.day, float(r.amount), r.value) for r in lines] == [(date(2024, 1, 5), 3.5, "jane"), (date(2024, 1, 6), 4.0, None)]
    (tmp_path / "log.jsonl").write_text('{"seq": 1, "field": "spender"}\n\n')
    assert files.decision_log(spark, str(tmp_path / "log.jsonl")).count() == 1
    (tmp_path / "c.json").write_text('{"version": 2}')
    with pytest.raises(Exception, match="version"):
        files.configuration(spark, str(tmp_path / "c.json"), "version int", 1).collect()
    assert files.newest(spark, str(tmp_path / "*.json")).count() == 1


def test_paged_source(spark):
    class Pages(BaseHTTPRequestHandler):
        def do_GET(self):
            page = int(self.path.rpartition("/")[2])
            body = json.dumps([{"id": f"{page}-{i}"} for i in range(2 if page < 2 else 1)]).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(api.PagedSource)
    url = f"http://127.0.0.1:{server.server_port}/{{page}}"
    assert spark.read.format("paged").option("url", url).option("size", 2).load().count() == 5
    server.shutdown()
    assert api.window(45, date(2024, 2, 14)) == (date(2024, 1, 1), date(2024, 2, 14))
    with pytest.raises(ValueError):
        api.window(91, date(2024, 1, 1))
    assert api.request_url("https://u:p@host/x", date(1970, 1, 2), date(1970, 1, 2), True, True) == "https://host/x/accounts?start-date=86400&end-date=172800&pending=1&balances-only=1"


def test_sinks(spark, tmp_path):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert sorted(tuple(r) for r in sinks.published(table, new, ["id"], str(tmp_path / "t")).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    sinks.land(table, str(tmp_path / "land"))
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.land(table, str(tmp_path / "land"))
    sinks.swap(table, str(tmp_path / "s"))
    sinks.swap(new, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2


def test_stream_keeps_the_newest_version_whatever_the_order(spark, tmp_path):
    landing, table = tmp_path / "in", str(tmp_path / "table")
    run = lambda: replay.merge_stream(spark, f"{landing}/*", files.SNAPSHOT, ["source_id", "txn_id"], "as_of", table, str(tmp_path / "ck"), replay.transactions).awaitTermination()
    snapshot(landing, "2", 9)
    run()
    snapshot(landing, "1", 5, "2024-01-02")
    run()
    found = spark.read.parquet(f"{table}/v{replay.current_version(spark, table)}").collect()
    assert [(r.txn_id, r.amount, r.as_of) for r in found] == [("t", "2", 9)]
    run()
    assert spark.read.parquet(f"{table}/v{replay.current_version(spark, table)}").count() == 1


def test_due_and_healthy(spark):
    runs = spark.createDataFrame([("2024-01-01 06:01:00", True)], "started string, ok boolean").selectExpr("cast(started as timestamp) started", "ok")
    for now, want in (("2024-01-01 07:00:00", False), ("2024-01-02 05:59:00", False), ("2024-01-02 06:00:00", True)):
        assert replay.due(runs, now).first().due is want
    failed = runs.selectExpr("started", "false ok")
    assert replay.due(failed, "2024-01-01 06:30:00").first().due is False and replay.due(failed, "2024-01-01 07:30:00").first().due is True
    assert replay.healthy(runs, "2024-01-02 06:00:00").first().healthy and not replay.healthy(runs, "2024-01-02 09:00:00").first().healthy
