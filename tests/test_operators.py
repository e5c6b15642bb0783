"""Joins, plans, rules and holdings on small tables."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import money
from tallyforge.operators import asof, balances, holdings, merge_plan, rules, validation

SOURCE = "source_id string, txn_id string, pos int, pending boolean, posted_day date, posted_at timestamp, amount decimal(18,2), description string"
MAPPING = "source_id string, account_id string, account_kind string, currency string, history_through date, zone string"
LEDGER = "id string, account_id string, status string, day date, amount decimal(28,10), currency string, kind string, group_id string, comment string, key string, metadata string"


def entities(spark):
    d, c = Decimal("12.50"), date(2024, 1, 10)
    source = [("s", "1", 0, False, c, None, d, "Shop"), ("s", "1", 1, False, c, None, d, "Shop again"), ("s", "2", 0, True, c, None, d, "later"), ("s", "3", 0, False, date(2023, 1, 1), None, -d, "old"), ("s", "4", 0, None, c, None, -d, "Transfer to savings")]
    return spark.createDataFrame(source, SOURCE), spark.createDataFrame([("s", "a", "CASH", "USD", date(2023, 12, 31), "UTC")], MAPPING), spark.createDataFrame([], LEDGER)


def test_a_second_run_changes_nothing(spark):
    source, mapping, ledger = entities(spark)
    first = merge_plan.plan(source, mapping, ledger)
    assert {(r.txn_id, r.op) for r in first.collect()} == {("1", "create"), ("3", "before cutoff"), ("4", "create")}
    after = merge_plan.applied(ledger, merge_plan.payloads(first))
    again = {r.txn_id: r.op for r in merge_plan.plan(source, mapping, after).collect()}
    assert again == {"1": "noop", "3": "before cutoff", "4": "noop"}
    changed = source.withColumn("amount", F.when(F.col("txn_id") == "1", Decimal("13.00")).otherwise(F.col("amount")).cast("decimal(18,2)"))
    updates = merge_plan.payloads(merge_plan.plan(changed, mapping, after))
    assert [(r.op, float(r.amount), r.comment) for r in updates.collect()] == [("update", 13.0, "Shop")]
    edited = after.withColumn("amount", F.col("amount") + 1)
    assert {r.op for r in merge_plan.plan(source, mapping, edited).collect()} == {"error: edited by hand", "before cutoff"}


def test_aliases_and_several_matches(spark):
    source, mapping, ledger = entities(spark)
    own = [("x", "a", "POSTED", date(2024, 1, 10), Decimal(12.5), "USD", "DEPOSIT", None, "c", "src:s:1", None), ("y", "a", "POSTED", date(2024, 1, 10), Decimal(12.5), "USD", "DEPOSIT", None, "c", "src:a:1", None)]
    two = spark.createDataFrame(own, LEDGER)
    assert {r.txn_id: r.op for r in merge_plan.plan(source, mapping, two).collect()}["1"] == "error: several activities"
    missing = spark.createDataFrame([("s", "4", "gone")], "source_id string, txn_id string, activity_id string")
    assert {r.txn_id: r.op for r in merge_plan.plan(source, mapping, ledger, missing).collect()}["4"] == "error: alias to a missing activity"
    one = spark.createDataFrame(own[:1], LEDGER)
    assert {r.txn_id: r.op for r in merge_plan.plan(source, mapping, one).collect()}["1"] == "noop"
    assert merge_plan.overlaps(one.withColumn("key", F.lit("manual")), mapping).count() == 1
    assert merge_plan.overlaps(one, mapping).count() == 0


def test_pending_flags_and_payload_problems(spark):
    rows = spark.createDataFrame([('{"pending": true}',), ('{"pending": "false"}',), ('{"pending": 1}',), ('{"pending": null}',), ("{}",), ('{"pending": false}',)], "j string")
    found = [r[0] for r in rows.select(validation.pending_flag(F.parse_json("j"))).collect()]
    assert found == ["pending", "invalid", "invalid", "invalid", "posted", "posted"]
    data = [("s", "1", False, "NaN", "5", "a"), ("s", None, False, "1", "5", "a"), ("s", "2", False, "1", "0", "a"), ("s", "3", False, "1", "5", "a"), ("s", "3", False, "2", "5", "a"), ("s", "4", True, "x", "0", "a")]
    problems = validation.payload_problems(spark.createDataFrame(data, "source_id string, txn_id string, pending boolean, amount string, posted string, description string"))
    assert sorted((r.txn_id or "", r.code) for r in problems.collect()) == [("", "transaction without id"), ("1", "amount is not finite"), ("2", "no valid date"), ("3", "conflicting versions")]


def test_account_states_keep_the_good_accounts(spark):
    sources = spark.createDataFrame([(s, c, Decimal(1), date(2024, 1, 1), date(2024, 1, 9)) for s, c in (("1", "USD"), ("2", ""), ("3", "https://x"), ("4", "USD"), ("5", "EUR"), ("6", "USD"))], "source_id string, currency string, balance decimal(18,2), balance_day date, as_of date")
    mapping = spark.createDataFrame([(s, "sync", True, s, None, None) for s in "12345"], "source_id string, action string, local_sync boolean, account_id string, liability_id string, source_scope string")
    accounts = spark.createDataFrame([(s, "CASH", "USD", True) for s in "1235"], "account_id string, account_kind string, account_currency string, is_active boolean")
    found = {r.source_id: r.code for r in validation.account_states(sources, mapping, accounts).collect()}
    assert found == {"1": None, "2": "currency is missing", "3": "not a currency", "4": "no such account", "5": "currency differs", "6": "not mapped"}


def test_band_match_is_mutual(spark):
    lines = spark.createDataFrame([("l1", date(2024, 1, 5), 7), ("l2", date(2024, 2, 5), 8), ("l3", date(2024, 3, 1), 9), ("l4", date(2024, 3, 2), 9)], "line_id string, line_day date, k int")
    rows = spark.createDataFrame([("r1", date(2024, 1, 8), 7), ("r0", date(2024, 1, 9), 7), ("r2", date(2024, 2, 4), 8), ("r3", date(2024, 2, 7), 8), ("r4", date(2024, 3, 1), 9)], "row_id string, row_day date, k int")
    assert [tuple(r) for r in asof.one_to_one(lines, rows, ["k"]).collect()] == [("l1", "r1")]


def test_runs_and_last_before(spark):
    seen = spark.createDataFrame([("a", d, q) for d, q in ((1, 5), (2, 7), (3, 5), (4, 5))] + [("b", 1, None), ("b", 2, None)], "k string, d int, q int")
    runs = {r.k: (r.value, r.since, r.days) for r in asof.current_run(seen, ["k"], "d", "q").collect()}
    assert runs == {"a": (5, 3, 2), "b": (None, 1, 2)}
    facts = spark.createDataFrame([("a", 1), ("a", 3), ("c", 3)], "k string, at int")
    strict = {(r.k, r["at"]): r.q for r in asof.before(facts, seen, ["k"], "at", "d").collect()}
    assert strict == {("a", 1): None, ("a", 3): 7, ("c", 3): None}
    assert {(r.k, r["at"]): r.q for r in asof.before(facts, seen, ["k"], "at", "d", strict=False).collect()}[("a", 3)] == 5


def roll(flows, quantity="12", old="10", basis="100", prices=(("2024-01-05", "11"),), lag=0):
    """The rolled cost of one asset; flows: (day, amount, share), share None for a description that is not listed."""
    spark = SparkSession.getActiveSession()
    as_day, q = date.fromisoformat, "decimal(28,10)"
    steps = spark.createDataFrame([("a", "s", "n", date(2024, 1, 1), date(2024, 1, 31), Decimal(old), Decimal(basis), Decimal(quantity), lag)], f"asset_id string, source_id string, name_key string, start date, end date, old_quantity {q}, old_basis {q}, quantity {q}, settlement_days int")
    rows = spark.createDataFrame([("s", as_day(d), Decimal(a), f"d{k}", False) for k, (d, a, _) in enumerate(flows)], f"source_id string, posted_day date, amount {q}, description string, pending boolean")
    shares = spark.createDataFrame([("s", f"d{k}", "n", Decimal(x)) for k, (_, _, x) in enumerate(flows) if x is not None], f"source_id string, description string, name_key string, share {q}")
    quotes = spark.createDataFrame([("a", as_day(d), Decimal(p)) for d, p in prices], f"asset_id string, day date, price {q}")
    (found,) = holdings.rolled_forward(steps, rows, shares, quotes).collect()
    return found.rolled_cost


def test_rolled_cost(spark):
    assert roll([("2024-01-05", "22", "1")]) == round((Decimal(100) + 22) / 12, 10)
    assert roll([], quantity="8") == Decimal(10)
    assert roll([("2024-01-05", "22", None)]) is None
    assert roll([("2024-01-05", "22", "1"), ("2024-01-06", "-5", None)]) is None
    assert roll([("2024-01-05", "60", "1")]) is None
    assert roll([("2024-02-05", "22", "1")]) is None
    assert roll([("2024-01-05", "22", "0")]) is None
    assert roll([("2024-01-30", "22", "1")], lag=3) is None
    assert roll([("2024-01-05", "44", "0.5")]) == round((Decimal(100) + 22) / 12, 10)


def test_rolled_cost_in_spark_and_precedence(spark):
    d = date(2024, 1, 5)
    steps = spark.createDataFrame([("asset", "s", "F", date(2024, 1, 1), date(2024, 1, 31), Decimal(10), Decimal(100), Decimal(12), 0)], "asset_id string, source_id string, name_key string, start date, end date, old_quantity decimal(28,10), old_basis decimal(28,10), quantity decimal(28,10), settlement_days int")
    flows = spark.createDataFrame([("s", d, Decimal(22), "buy", False), ("s", d, Decimal(5), "other", True)], "source_id string, posted_day date, amount decimal(28,10), description string, pending boolean")
    shares = spark.createDataFrame([("s", "buy", "F", Decimal(1))], "source_id string, description string, name_key string, share decimal(28,10)")
    prices = spark.createDataFrame([("asset", d, Decimal(11))], "asset_id string, day date, price decimal(28,10)")
    found = holdings.rolled_forward(steps, flows, shares, prices).collect()
    assert found[0].rolled_cost == round(Decimal(122) / 12, 10)  # an amount of money, as all others
    names = "source_id string, position_id string, symbol string, description string, quantity decimal(28,10), value decimal(28,10), currency string, cost_basis decimal(28,10), purchase_price decimal(28,10)"
    rows = [("s", "1", "A", "a", 2, 20, "USD", 10, 7), ("s", "2", "B", "b", 2, 20, None, 0, 7), ("s", "3", "C", "c", 2, 20, "USD", None, None), ("s", "4", "", "cash", 1, 5, "USD", None, None), ("s", "5", "D", "d", -1, 5, "USD", None, None), ("s", "6", "E", "e", 0, 0, "USD", None, None)]
    rows = [tuple(Decimal(x) if isinstance(x, int) else x for x in r) for r in rows]
    accounts = spark.createDataFrame([("s", "USD", False, Decimal(70))], "source_id string, currency string, per_unit boolean, balance decimal(28,10)")
    planned = {r.position_id: (r.cost_from, r.problem) for r in holdings.planned(spark.createDataFrame(rows, names), accounts).collect()}
    assert planned == {"1": ("provider", None), "2": ("purchase price", None), "3": (None, None), "5": (None, "negative or without quantity")}
    assert [r.ok for r in holdings.reconciled(spark.createDataFrame(rows, names), accounts).collect()] == [True]


RULES = [
    ({"match": "contains", "pattern": "shop", "is_global": True}, True),
    ({"match": "starts_with", "pattern": "shop", "is_global": True}, False),
    ({"match": "exact", "pattern": "corner shop", "is_global": True}, True),
    ({"match": "regex", "pattern": "^Corner", "is_global": True}, True),
    ({"match": "regex", "pattern": "^corner", "is_global": True}, False),
    ({"match": "regex", "pattern": "(", "is_global": True}, False),
    ({"match": "contains", "pattern": "shop", "is_global": False, "account_id": "b"}, False),
    ({"match": "contains", "pattern": "shop", "is_global": True, "amount_op": "gt"}, False),
    ({"match": "contains", "pattern": "shop", "is_global": True, "amount_op": "between", "amount_value": 1, "amount_value2": 5}, True),
    ({"match": "contains", "pattern": "shop", "is_global": True, "amount_op": "between", "amount_value": 1}, False),
    ({"match": "other", "pattern": "shop", "is_global": True}, False),
]


@pytest.mark.parametrize("rule,want", RULES)
def test_rule_matches(spark, rule, want):
    row = spark.createDataFrame([("a", "FEE", "-4.0", "Corner Shop")], "account_id string, kind string, amount string, notes string")
    found = rules.first_match(row, [rule | {"id": "r", "category_id": "c"}]).collect()[0].rule_id
    assert (found == "r") is want


def test_balances(spark):
    accounts = spark.createDataFrame([("a", "CASH", "USD", Decimal(10), date(2024, 1, 1)), ("b", "CASH", "USD", Decimal(0), date(2024, 1, 1))], "account_id string, account_kind string, currency string, balance decimal(28,10), balance_day date")
    rows = spark.createDataFrame([("a", "POSTED", "DEPOSIT", Decimal(10), "USD", date(2024, 1, 1), None), ("a", "POSTED", "FEE", Decimal(3), "USD", date(2024, 1, 2), None), ("b", "POSTED", "DEPOSIT", None, "USD", date(2024, 1, 1), None)], "account_id string, status string, kind string, amount decimal(28,10), currency string, day date, utc_day date")
    found = {r.account_id: (float(r.expected), float(r.actual), r.problem) for r in balances.projection(accounts, rows).collect()}
    assert found == {"a": (7.0, 7.0, None), "b": (0.0, 0.0, "not a cash-only ledger in one currency")}
    assert money.HALF_CENT == "0.005"
