"""The composed sync: what is planned, published by one commit, and taken back when anything is refused."""

import shutil
from dataclasses import fields, replace
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyforge.plans import sync
from tallyforge.sources import scratch, store
from tallyforge.sources.store import Store

DAY = date(2024, 3, 10)
D = Decimal
SCHEMAS = {
    "sources": "source_id string, currency string, balance decimal(28,10), balance_day date, balance_utc_day date, as_of date",
    "mapping": "source_id string, action string, local_sync boolean, account_id string, liability_id string, source_scope string, history_through date, zone string, purchase_account string, per_unit boolean",
    "accounts": "account_id string, account_kind string, account_currency string, is_active boolean, mode string",
    "transactions": "source_id string, txn_id string, pos int, pending boolean, posted_day date, posted_at timestamp, amount decimal(18,2), description string",
    "activities": "id string, account_id string, status string, day date, amount decimal(18,2), currency string, kind string, group_id string, comment string, key string, metadata string",
    "positions": "source_id string, position_id string, symbol string, description string, quantity decimal(28,10), value decimal(28,10), currency string, cost_basis decimal(28,10), purchase_price decimal(28,10)",
    "snapshots": "account_id string, day date, kind string, cash decimal(28,10)",
    "liabilities": "id string, value decimal(28,10), day date, currency string",
}


def mapped(source, account=None, liability=None, buyer=None):
    return (source, "sync", True, account, liability, "account", date(2024, 1, 1), "UTC", buyer, False)


def bought(source, txn, amount, description="Coffee", day=DAY):
    return (source, txn, 0, False, day, None, D(amount), description)


ROWS = {
    "sources": [(s, "USD", D(b), DAY, None, DAY + timedelta(days=1)) for s, b in (("sum", "-12.50"), ("seen", "70"), ("fund", "300"), ("loan", "-900"), ("odd", "3"), ("empty", "0"), ("late", "5"), ("card", "-4"))] + [("nowhere", "USD", D(1), DAY, None, DAY)],
    "mapping": [mapped("sum", "A"), mapped("seen", "B"), mapped("fund", "C"), mapped("loan", None, "L"), mapped("odd", "E"), mapped("empty", "Z", None, "sum"), mapped("late", "N"), mapped("card", "K")],
    "accounts": [("A", "CASH", "USD", True, "TRANSACTIONS"), ("B", "CASH", "USD", True, "HOLDINGS"), ("C", "SECURITIES", "USD", True, "TRANSACTIONS"), ("E", "CASH", "EUR", True, "HOLDINGS"), ("Z", "CASH", "USD", True, "HOLDINGS"), ("N", "CASH", "USD", True, "HOLDINGS"), ("K", "CREDIT_CARD", "USD", True, "TRANSACTIONS")],
    "transactions": [bought("sum", "t1", "-10"), bought("sum", "t2", "-2.5", "Tea"), bought("seen", "t3", "7"), bought("odd", "t4", "1"), bought("card", "t5", "-4"), bought("card", "t6", "-9", day=DAY + timedelta(days=1))],
    "activities": [],
    "positions": [("fund", "p1", "AAA", "Fund A", D(10), D(200), "USD", D(150), None), ("fund", "p2", "BBB", "Fund B", D(4), D(90), "USD", None, None), ("fund", "c", "", "Cash", D(10), D(10), "USD", None, None)],
    "snapshots": [("Z", date(2024, 3, 1), "MANUAL_ENTRY", D(55)), ("N", DAY + timedelta(days=2), "MANUAL_ENTRY", D(1)), ("B", DAY + timedelta(days=5), "CALCULATED", D(1))],
    "liabilities": [("L", D(1000), date(2024, 3, 1), "USD")],
}


def world(spark, **changed):
    return sync.World(**{k: spark.createDataFrame(changed.get(k, ROWS[k]), s) for k, s in SCHEMAS.items()})


@pytest.fixture(scope="module")
def planned(spark):
    """The first sync's plan, computed once."""
    found = sync.plan(world(spark))
    return sync.Plan(**{f.name: scratch.written(getattr(found, f.name)) for f in fields(found)})


@pytest.fixture(scope="module")
def before_sync(spark, tmp_path_factory):
    """The folder of a store with the application's tables before the first sync."""
    folder = tmp_path_factory.mktemp("store") / "s"
    s, w = Store(spark, str(folder)), world(spark)
    empty = lambda schema: spark.createDataFrame([], schema)
    with s.begin() as t:
        t.create("activities", w.activities, sync.TABLES["activities"], 4)
        t.create("snapshots", w.snapshots.withColumn("currency", F.lit("USD")), sync.TABLES["snapshots"], 4)
        t.create("positions", empty("account_id string, asset_id string, day date, quantity decimal(28,10), average_cost decimal(28,10), cost_from string"), sync.TABLES["positions"], 4)
        t.create("quotes", empty("asset_id string, day date, price decimal(28,10), currency string"), sync.TABLES["quotes"], 4)
        t.create("accounts", w.accounts, sync.TABLES["accounts"], 4)
        t.create("liabilities", w.liabilities, sync.TABLES["liabilities"], 4)
    return folder


@pytest.fixture
def s(spark, before_sync, tmp_path):
    shutil.copytree(before_sync, tmp_path / "s")
    return Store(spark, str(tmp_path / "s"))


def now(s, w):
    """The world as the store has it."""
    return replace(w, activities=s.read("activities"), accounts=s.read("accounts"), snapshots=s.read("snapshots").drop("currency"), liabilities=s.read("liabilities"))


def state(s):
    return {name: sorted((tuple(r) for r in s.read(name).collect()), key=str) for name in sync.TABLES}


def told(rows):
    return {(r.step, r.owner, r.detail) for r in rows if r.step in ("error", "warning")}


def test_plan_of_every_kind_of_account(planned):
    rows = planned.rows().collect()
    assert {(r.owner, r.amount) for r in rows if r.step == "create"} == {("A", D(10)), ("A", D("2.5")), ("B", D(7)), ("K", D(4)), ("K", D(9))}
    assert {(r.owner, r.amount) for r in rows if r.step == "snapshot"} == {("B", D(70)), ("C", D(10))}
    assert {(r.amount, r.detail) for r in rows if r.step == "position"} == {(D(10), "provider"), (D(4), None)}
    assert {r.amount for r in rows if r.step == "quote"} == {D(20), D("22.5")}
    assert [(r.owner, r.detail) for r in rows if r.step == "mode"] == [("C", "HOLDINGS")]
    assert [(r.owner, r.amount) for r in rows if r.step == "valuation"] == [("L", D(900))]
    assert {(r.owner, r.amount) for r in rows if r.step == "expected"} == {("A", D("-12.5")), ("B", D(70)), ("C", D(300)), ("K", D(-13))}
    assert told(rows) == {
        ("error", "odd", "currency differs"), ("error", "nowhere", "not mapped"), ("warning", "fund", "positions without an acquisition cost"),
        ("warning", "empty", "an empty balance without a purchase: kept the last one"), ("warning", "late", "kept a newer balance"),
    }


def test_an_account_with_an_error_writes_nothing(spark):
    some = [*ROWS["transactions"], bought("seen", "t9", "3", day=DAY)]
    by_hand = [("x", "B", "VOID", DAY, D(3), "USD", "DEPOSIT", None, "", "src:seen:t9", None)]
    off = [(s, c, b + 1 if s in ("sum", "fund") else b, *rest) for s, c, b, *rest in ROWS["sources"]]
    rows = sync.plan(world(spark, transactions=some, activities=by_hand, sources=off)).rows().collect()
    assert {r.owner for r in rows if r.step == "create"} == {"K"} and not [r for r in rows if r.step in ("snapshot", "quote", "mode")]
    assert {("error", "seen", "error: not posted"), ("error", "sum", "does not reconcile"), ("error", "fund", "positions do not add up to the balance")} <= told(rows)


def test_publishing_twice_changes_nothing(spark, s, planned):
    assert sync.publish(s, planned, 100) == 2
    first = state(s)
    assert len(first["activities"]) == 5 and len(first["quotes"]) == 2 and ("C", "SECURITIES", "USD", True, "HOLDINGS") in first["accounts"] and first["liabilities"][0][:2] == ("L", D(900))
    again = sync.plan(now(s, world(spark)))
    assert again.activities.isEmpty() and again.modes.isEmpty() and again.valuations.isEmpty()
    sync.publish(s, again, 100)
    assert state(s) == first
    with pytest.raises(ValueError, match="older"):
        sync.publish(s, again, 99)
    assert state(s) == first and not s.vacuum(keep=3)


def test_a_refused_quote_takes_everything_back(s, planned):
    before = state(s)
    with pytest.raises(ValueError, match="quotes"):
        sync.publish(s, replace(planned, quotes=planned.quotes.withColumn("price", F.when(F.col("price") != 20, F.col("price")))), 100)
    assert state(s) == before and s.versions() == [1] and not s.vacuum()


@pytest.mark.parametrize("table", ["activities", "quotes", "manifest"])
def test_a_crash_at_any_table_is_seen_by_nobody(s, planned, monkeypatch, table):
    before, real = state(s), store.Transaction.upsert

    def crash(*_):
        raise KeyboardInterrupt

    def upsert(self, name, *rest, **more):
        real(self, name, *rest, **more)
        if name == table:
            crash()

    monkeypatch.setattr(store.Transaction, "upsert", upsert)
    monkeypatch.setattr(store.Transaction, "abort", lambda self: None)
    if table == "manifest":
        monkeypatch.setattr(s, "write_manifest", crash)
    with pytest.raises(KeyboardInterrupt):
        sync.publish(s, planned, 100)
    monkeypatch.undo()
    assert state(s) == before and s.vacuum() and state(s) == before
    if table == "manifest":
        sync.publish(s, planned, 100)
        assert len(s.read("activities").collect()) == 5


def test_positions_keep_the_providers_number_and_their_names_are_not_written(spark):
    import uuid

    from tallyforge import catalog
    from tallyforge.sources import scratch

    kept = []
    planned = sync.plan(catalog._world(spark, "/root/testdata/sf0.001"), lambda t: (kept.append(t.columns), scratch.written(t))[1])
    assert any("position_id" in c for c in kept) and not any("asset_id" in c for c in kept)
    rows = planned.positions.limit(50).collect()
    assert rows and all(r.asset_id == str(uuid.uuid5(uuid.NAMESPACE_URL, f"src:{r.account_id}:{r.position_id}")) for r in rows)
    assert {r.key for r in planned.rows("position_id").where("step = 'quote'").collect()} >= {r.position_id for r in rows}
