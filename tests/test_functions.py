"""Scalar functions against small tables of examples."""

import hashlib
import random
import re
import uuid
from datetime import date, datetime
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import money, stats, text

KINDS = [
    ("Coffee shop", "-4.10", "CREDIT_CARD", "WITHDRAWAL"),
    ("AUTOPAY 12", "250.00", "CREDIT_CARD", "TRANSFER_IN"),
    ("Payment - thank you", "80", "CREDIT_CARD", "TRANSFER_IN"),
    ("payment received", "80", "CREDIT_CARD", "TRANSFER_IN"),
    ("Returned goods", "12", "CREDIT_CARD", "CREDIT"),
    ("Interest Paid", "0.05", "CASH", "INTEREST"),
    (" interest ", "0.05", "CASH", "INTEREST"),
    ("Interest payment", "-0.05", "CASH", "WITHDRAWAL"),
    ("Interest adjustment", "0.05", "CASH", "DEPOSIT"),
    ("VENMO  CASHOUT", "20", "CASH", "TRANSFER_IN"),
    ("venmo cashout", "-20", "CASH", "WITHDRAWAL"),
    ("Transfer to joint savings", "-20", "CASH", "TRANSFER_OUT"),
    ("online transfer 7 from checking", "20", "CASH", "TRANSFER_IN"),
    ("CHASE CREDIT CRD AUTOPAY", "-99", "CASH", "TRANSFER_OUT"),
    ("Bank P2P 4411", "0", "CASH", "TRANSFER_IN"),
    ("Payroll", "1000", "CASH", "DEPOSIT"),
    (None, "-1", "CASH", "WITHDRAWAL"),
]


def test_cash_kinds(spark):
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(KINDS)], "i int, d string, a string, k string, want string")
    found = rows.withColumn("got", money.cash_kind(F.col("d"), money.lenient(F.col("a")), F.col("k"))).orderBy("i").collect()
    assert [r.got for r in found] == [r.want for r in found]


KEYS = [
    ("SQ *BLUE BOTTLE 12", "BLUE BOTTLE"),
    ("POS DEBIT corner shop", "CORNER SHOP"),
    ("Paypal *ACME", "ACME"),
    ("card purchase", "CARD PURCHASE"),
    ("H&M store 44", "H&M STORE"),
    ("Joe's", "JOE'S"),
    ("12 34", ""),
    ("", ""),
    (None, ""),
    ("a b c", "A B"),
]


def test_merchant_keys_and_their_patterns(spark):
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(KEYS)], "i int, d string, want string")
    found = rows.withColumn("got", text.merchant_key(F.col("d"))).orderBy("i").collect()
    assert [r.got for r in found] == [r.want for r in found]
    for r in found:
        if r.want:
            assert re.search(text.merchant_pattern(r.want), r.d)
    assert not re.search(text.merchant_pattern("BLUE BOTTLE"), "BLUE BOTTLES")
    assert not re.search(text.merchant_pattern("ACME"), "ACME TOOLS")


def test_merchant_pattern_finds_the_descriptions_of_its_key(spark):
    rng = random.Random(3)
    words = ["SQ", "POS", "ACME", "Tools", "x1", "O'NEIL", "web"]
    said = sorted({rng.choice(["", "12 ", "#"]) + rng.choice([" ", "*", " 7 "]).join(rng.choices(words, k=rng.randint(0, 4))) + rng.choice(["", " 9", "!"]) for _ in range(150)})
    keys = {r.d: r.k for r in spark.createDataFrame([(d,) for d in said], "d string").select("d", text.merchant_key(F.col("d")).alias("k")).collect()}
    for key in sorted(set(keys.values()) - {""}):
        assert {d for d in said if re.search(text.merchant_pattern(key), d)} == {d for d in said if keys[d] == key}, key


@pytest.mark.parametrize("zone", ["UTC", "Pacific/Kiritimati", "Etc/GMT+12", "America/New_York", "Australia/Lord_Howe"])
def test_day_anchor_is_on_the_day_in_both_zones(spark, zone):
    days = [date(2024, 1, 1), date(2024, 3, 10), date(2024, 10, 6), date(2024, 11, 3)]
    rows = spark.createDataFrame([(d,) for d in days], "d date")
    for r in rows.select("d", F.unix_seconds(money.day_anchor(F.col("d"), zone)).alias("s")).collect():
        assert datetime.fromtimestamp(r.s, ZoneInfo("UTC")).date() == r.d
        assert datetime.fromtimestamp(r.s, ZoneInfo(zone)).date() == r.d


def test_amounts(spark):
    rows = spark.createDataFrame([("1.5",), ("NaN",), ("x",), (None,), ("-9007199254740991.01",)], "a string")
    assert [str(r[0]) for r in rows.select(money.lenient(F.col("a"))).collect()] == ["1.5000000000", "0E-10", "0E-10", "0E-10", "-9007199254740991.0100000000"]
    with pytest.raises(Exception, match="finite"):
        rows.select(money.strict(F.col("a"))).collect()
    assert [r[0] for r in rows.select(money.is_money(F.col("a"))).collect()] == [True, False, False, False, True]


def test_epoch_days_and_currencies(spark):
    rows = spark.createDataFrame([("86400", "USD"), ("0", ""), (None, None), ("x", "https://unit"), ("1700000000", " ")], "e string, c string")
    found = rows.select(money.epoch_day(F.col("e")).alias("d"), money.is_currency(F.col("c")).alias("ok")).collect()
    assert [r.d for r in found] == [date(1970, 1, 2), None, None, None, date(2023, 11, 14)]
    assert [r.ok for r in found] == [True, False, False, False, False]
    accounts = spark.createDataFrame([("", "3", [("EUR", "1"), ("EUR", "2")]), ("", "3", [("EUR", "1"), ("USD", "2")]), ("CHF", "3", []), ("", "4", [("EUR", "1")])], "c string, b string, h array<struct<currency: string, market_value: string>>")
    assert [r[0] for r in accounts.select(money.account_currency(F.col("c"), F.col("b"), F.col("h"))).collect()] == ["EUR", "", "CHF", ""]


def test_uuid5_and_folds(spark):
    names = [f"src:acct:{i}" for i in range(50)]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    for r in rows.select("n", money.uuid5(money.NAMESPACE_URL, F.col("n")).alias("u"), stats.fold(F.col("n")).alias("f")).collect():
        assert r.u == str(uuid.uuid5(uuid.NAMESPACE_URL, r.n))
        assert r.f == int(hashlib.sha1(r.n.encode()).hexdigest(), 16) % 5


def test_features_and_descriptions(spark):
    rows = spark.createDataFrame([("FEE", "SQ *Blue Bottle the shop9", "BLUE BOTTLE", "-7.0", date(2024, 1, 1), ["c1"], "5812", 3600 * 7), ("WITHDRAWAL", "12", "", None, date(2024, 1, 7), None, None, None)], "k string, n string, m string, a string, d date, c array<string>, mcc string, t bigint")
    found = rows.select(text.features(*(F.col(x) for x in ("k", "n", "m")), F.col("a").cast("double"), *(F.col(x) for x in ("d", "c", "mcc", "t")), "UTC").alias("f")).collect()
    assert found[0].f == ["type:fee", "m:BLUE BOTTLE", "w:BLUE", "w:BOTTLE", "amt:3", "dow:Mon", "cat:c1", "mcc:5812", "hr:06"]
    assert found[1].f == ["amt:0", "dow:Sun"]
    said = spark.createDataFrame([("amt:3",), ("hr:06",), ("cat:c1",), ("m:X Y",), ("dow:Mon",)], "f string").select(text.described(F.col("f"), F.lit(None).cast("string"))).collect()
    assert [r[0] for r in said] == ["amount $7-15", "06:00-09:00", "category c1", "merchant X Y", "Mon"]


def test_span_probability(spark):
    reply = '{"category": "é Food", "confidence": 1}'
    data = reply.encode()
    cuts = [0, 15, 16, 20, len(data)]
    parts = [("", list(data[a:b]), -0.5 * i) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    rows = spark.createDataFrame([(parts, reply), (parts[:-1], reply), (None, reply)], "t array<struct<token: string, bytes: array<int>, logprob: double>>, c string")
    found = [r[0] for r in rows.select(stats.span_probability(F.col("t"), F.col("c"))).collect()]
    assert found[0] == pytest.approx(2.718281828459045 ** -(0.5 + 1.0 + 1.5)) and found[1] is None and found[2] is None
