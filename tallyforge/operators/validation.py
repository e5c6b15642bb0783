"""Checks of provider payloads: rows of (key, code), never an exception for one account's sake."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import money


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys on more than one row, with their number."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def conflicts(rows: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """Keys with more than one different payload."""
    return rows.groupBy(*keys).agg(F.count_distinct(F.struct(*payload)).alias("versions")).where("versions > 1")


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key. Only the least order is found for a key, by partial aggregation."""
    payload = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min(F.struct(*order, *(c for c in payload if c not in order))).alias("first"))
    return best.select(*keys, *(F.col(f"first.{c}") for c in payload))


def pending_flag(transaction: F.Column) -> F.Column:
    """'posted', 'pending' or 'invalid' of a transaction variant; only a missing flag or a JSON boolean is valid."""
    flag = F.schema_of_variant(F.variant_get(transaction, "$.pending", "variant"))
    value = F.try_variant_get(transaction, "$.pending", "boolean")
    return F.when(flag.isNull(), "posted").when(flag != "BOOLEAN", "invalid").when(value, "pending").otherwise("posted")


def payload_problems(transactions: DataFrame) -> DataFrame:
    """(source_id, txn_id, code) of posted transactions that make a payload unusable."""
    posted = transactions.where(~F.coalesce("pending", F.lit(False)))
    checks = [
        (F.coalesce("txn_id", F.lit("")) == "", "transaction without id"),
        (~money.is_money(F.col("amount")), "amount is not finite"),
        (F.coalesce(F.col("posted").cast("string").try_cast("bigint"), F.lit(0)) <= 0, "no valid date"),
    ]
    each = [posted.where(test).select("source_id", "txn_id", F.lit(code).alias("code")) for test, code in checks]
    known = posted.where(F.coalesce("txn_id", F.lit("")) != "")
    twice = conflicts(known, ["source_id", "txn_id"], ["amount", "posted", "description"])
    each.append(twice.select("source_id", "txn_id", F.lit("conflicting versions").alias("code")))
    return reduce(DataFrame.unionByName, each)


def account_states(sources: DataFrame, mapping: DataFrame, accounts: DataFrame, stale_days: int = 3) -> DataFrame:
    """Each source account with its mapping, its account, the first failing ``code`` (null: none) and ``warning``.

    sources: source_id, currency, balance, balance_day, as_of; mapping: source_id, action, local_sync, account_id,
    liability_id, source_scope; accounts: account_id, account_kind, account_currency, is_active.
    """
    joined = sources.join(mapping, "source_id", "left").join(accounts, "account_id", "left")
    code = (
        F.when(F.col("action").isNull(), "not mapped")
        .when((F.col("action") == "exclude") | ~F.coalesce("local_sync", F.lit(True)), "skipped")
        .when(F.coalesce(F.trim("currency"), F.lit("")) == "", "currency is missing")
        .when(~money.is_currency(F.col("currency")), "not a currency")
        .when(F.col("liability_id").isNotNull(), "liability")
        .when(F.col("account_kind").isNull(), "no such account")
        .when(~F.coalesce("is_active", F.lit(True)), "inactive")
        .when(F.col("account_currency") != F.col("currency"), "currency differs")
        .when((F.col("account_kind") != "SECURITIES") & (F.col("source_scope") == "investments"), "scope differs")
    )
    warning = F.when(F.datediff("as_of", "balance_day") > stale_days, "balance is old")
    return joined.withColumn("code", code).withColumn("warning", warning)
