"""Projected and actual balances, and shapes of positions, compared with a tolerance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import money
from . import asof


def tolerance(difference: Column, limit: str) -> Column:
    return F.abs(difference) <= F.lit(limit).cast(money.MONEY)


def projection(accounts: DataFrame, activities: DataFrame) -> DataFrame:
    """accounts (account_id, account_kind, currency, balance, balance_day) with ``expected``, ``actual`` and ``problem``.

    expected: the balance and all posted amounts after its UTC day; actual: all posted amounts. Activities: account_id,
    status, kind, amount, currency, day, utc_day (the provider's, if known). Amounts are summed within partitions first.
    """
    posted = activities.where("status = 'POSTED'").join(accounts.select("account_id", "account_kind", "balance_day", F.col("currency").alias("own_currency")), "account_id")
    value = money.activity_amount(F.col("kind"), F.col("amount"), F.col("account_kind"))
    after = F.coalesce("utc_day", "day") > F.col("balance_day")
    bad = F.col("amount").isNull() | (F.col("currency") != F.col("own_currency"))
    sums = posted.groupBy("account_id").agg(F.sum(F.when(after, value)).alias("later"), F.sum(value).alias("actual"), F.max(bad).alias("unfit"), F.max(value.isNull()).alias("strange"))
    joined = accounts.join(sums, "account_id", "left")
    zero = F.lit(0).cast("decimal(38,10)")
    joined = joined.withColumn("expected", F.col("balance") + F.coalesce("later", zero)).withColumn("actual", F.coalesce("actual", zero))
    problem = F.when(F.coalesce("unfit", F.lit(False)), "not a cash-only ledger in one currency").when(~tolerance(F.col("actual") - F.col("expected"), money.HALF_CENT), "does not reconcile")
    strange = F.when(F.coalesce("strange", F.lit(False)), "an activity of a kind that is no cash activity")
    return joined.withColumn("problem", F.coalesce(strange, F.when(F.col("account_kind") == "CASH", problem))).drop("later", "unfit", "strange")


def readable(snapshots: DataFrame, modes: DataFrame, today: str) -> DataFrame:
    """Each account's last snapshot up to today that its mode reads: calculated ones by transactions, observed ones by holdings.

    snapshots: account_id, day, kind, cash, valid (null: valid); modes: account_id, mode. Of several of one day the one with the least kind and cash.
    """
    fits = (F.col("kind") == "CALCULATED") == (F.col("mode") == "TRANSACTIONS")
    seen = snapshots.join(modes.where(F.col("mode").isin("TRANSACTIONS", "HOLDINGS")).select("account_id", "mode"), "account_id")
    return asof.latest(seen.where(fits & F.coalesce("valid", F.lit(True)) & (F.col("day") <= F.lit(today).cast("date"))).select("account_id", "mode", "day", "kind", "cash"), ["account_id"], "day")


def settled(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(account_id, ok): expected totals against those of two reads of the ledger, which must agree with each other.

    expected: account_id, total; actual: account_id, attempt, total. The last two attempts count.
    """
    last = actual.agg(F.max("attempt")).first()[0] or 0
    reads = actual.where(F.col("attempt") > last - 2).groupBy("account_id").agg(F.count_distinct("total").alias("different"), F.count("*").alias("reads"), F.max_by("total", "attempt").alias("seen"))
    ok = (F.col("different") == 1) & (F.col("reads") == 2) & tolerance(F.col("seen") - F.col("total"), money.HALF_CENT)
    return expected.join(reads, "account_id", "left").select("account_id", F.coalesce(ok, F.lit(False)).alias("ok"))


def shape_difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(account_id, ok, missing, extra, off) of positions (account_id, asset_id, quantity, value) on both sides."""
    left, right = expected.alias("e"), actual.alias("a")
    both = left.join(right, (F.col("e.account_id") == F.col("a.account_id")) & (F.col("e.asset_id") == F.col("a.asset_id")), "full_outer")
    quantity, value = (F.col(f"e.{c}") - F.col(f"a.{c}") for c in ("quantity", "value"))
    off = ~(tolerance(quantity, "0.00000001") & tolerance(value, money.HALF_CENT))
    count = lambda test, name: F.count_if(test).alias(name)
    sums = both.groupBy(F.coalesce("e.account_id", "a.account_id").alias("account_id")).agg(count(F.col("a.asset_id").isNull(), "missing"), count(F.col("e.asset_id").isNull(), "extra"), count(off, "off"))
    return sums.withColumn("ok", (F.col("missing") + F.col("extra") + F.col("off")) == 0)


def inactive_with_value(accounts: DataFrame, values: DataFrame) -> DataFrame:
    """Accounts that are neither active nor archived and have a value other than zero anywhere; nothing is netted."""
    nonzero = values.groupBy("account_id").agg(F.max(F.col("value") != 0).alias("nonzero"))
    return accounts.where(~F.col("is_active") & ~F.coalesce("is_archived", F.lit(False))).join(nonzero.where("nonzero"), "account_id", "left_semi")


def unpaired_transfers(activities: DataFrame, accounts: DataFrame) -> DataFrame:
    """(account_id, in_scope, legs): posted transfers without a group, and whether their account is in ``accounts``."""
    alone = activities.where(F.col("kind").isin(*money.TRANSFERS) & F.col("group_id").isNull() & (F.col("status") == "POSTED"))
    known = accounts.select("account_id", F.lit(True).alias("known"))
    counted = alone.groupBy("account_id").agg(F.count("*").alias("legs")).join(known, "account_id", "left")
    return counted.select("account_id", F.coalesce("known", F.lit(False)).alias("in_scope"), "legs")


def unexplained_zeros(sources: DataFrame, snapshots: DataFrame, transactions: DataFrame, limit: str = "0.05") -> DataFrame:
    """source_id, kept_day: empty balances whose last one no transaction of the purchase account explains.

    sources: source_id, account_id, purchase_account, balance, balance_day; snapshots: account_id, day, kind, cash;
    transactions: source_id, posted_day, amount.
    """
    empty = sources.where("balance = 0 and purchase_account is not null")
    seen = snapshots.where("kind <> 'CALCULATED'").select("account_id", "day", "cash")
    last = asof.before(empty, seen, ["account_id"], "balance_day", "day").where("day is not null and cash <> 0")
    bought = transactions.select(F.col("source_id").alias("purchase_account"), F.abs("amount").alias("paid"), "posted_day")
    since = F.col("r.posted_day") >= F.date_sub("l.day", 7)
    return asof.near(last, bought, ["purchase_account"], ("cash", "paid"), limit, "left_anti", since).select("source_id", F.col("day").alias("kept_day"))
