"""What to create, update or leave when provider transactions meet the ledger; running it twice changes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import money
from .validation import first_seen


def keyed(transactions: DataFrame, mapping: DataFrame, prefix: str = "src") -> DataFrame:
    """Posted transactions, the first of each id, with their day in the account's zone and both keys they may have.

    transactions: source_id, txn_id, pos, pending, posted_day, posted_at, amount, description; mapping: source_id,
    account_id, account_kind, currency, history_through, zone.
    """
    posted = first_seen(transactions.where(~F.coalesce("pending", F.lit(False))), ["source_id", "txn_id"], ["pos"])
    rows = posted.join(mapping, "source_id")
    day = money.day_in(F.col("posted_at"), F.coalesce("zone", F.lit("UTC")), F.col("posted_day"))
    key = lambda owner: F.concat_ws(":", F.lit(prefix), F.col(owner), F.col("txn_id"))
    return rows.withColumn("day", day).withColumn("key", key("source_id")).withColumn("old_key", key("account_id")).withColumn("new_kind", money.cash_kind(F.col("description"), F.col("amount"), F.col("account_kind")))


def matches(rows: DataFrame, activities: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(source_id, txn_id, n, activity_id): the different activities that each transaction may be.

    Equi-joins by either key, and by alias (source_id, txn_id, activity_id), whatever the activity's account.
    """
    names = ["source_id", "txn_id"]
    known = activities.where(F.coalesce("key", F.lit("")) != "").select("key", F.col("id").alias("activity_id"))
    by_key = rows.select(*names, F.explode(F.array_distinct(F.array("key", "old_key"))).alias("key")).join(known, "key").select(*names, "activity_id")
    if aliases is not None:
        by_key = by_key.unionByName(rows.select(*names).join(aliases, names).select(*names, "activity_id"))
    return by_key.groupBy(*names).agg(F.count_distinct("activity_id").alias("n"), F.min("activity_id").alias("activity_id"))


def overlaps(activities: DataFrame, mapping: DataFrame, aliases: DataFrame | None = None, prefix: str = "src") -> DataFrame:
    """Account ids with a posted activity after the cutoff that is neither ours by key nor an alias."""
    posted = activities.where("status = 'POSTED'").select("id", "account_id", "day", F.coalesce("key", F.lit("")).alias("key"))
    rows = posted.join(mapping.select("account_id", "source_id", "history_through"), "account_id").where("day > history_through")
    own = [F.startswith("key", F.concat(F.lit(f"{prefix}:"), F.col(c).cast("string"), F.lit(":"))) for c in ("source_id", "account_id")]
    rows = rows.where(~own[0] & ~own[1])
    if aliases is not None:
        rows = rows.join(aliases.select(F.col("activity_id").alias("id")), "id", "left_anti")
    return rows.select("account_id").distinct()


def _verdict(previous: Column) -> Column:
    """The operation for a transaction with its only match ``a``; codes of errors begin with 'error'."""
    a = lambda c: F.col(f"a_{c}")
    amount = money.activity_amount(a("kind"), a("amount"), F.col("account_kind"))
    transfer = F.col("new_kind").isin(*money.TRANSFERS)
    external = transfer & a("group_id").isNull()
    was = lambda name: F.try_variant_get(previous, f"$.source.{name}", "string")
    has = was("date").isNotNull()
    differs = ~amount.eqNullSafe(F.col("amount")) | ~a("day").eqNullSafe(F.col("day"))
    edited = ~amount.eqNullSafe(money.lenient(was("amount"))) | ~a("day").cast("string").eqNullSafe(was("date"))
    same = (money.lenient(was("amount")) == F.col("amount")) & (was("date") == F.col("day").cast("string")) & was("description").eqNullSafe(F.col("description"))
    flow = F.coalesce(F.try_variant_get(previous, "$.flow.is_external", "boolean"), F.lit(False)) == external
    return (
        F.when(a("status") != "POSTED", "error: not posted")
        .when(a("account_id") != F.col("account_id"), "error: other account")
        .when(a("currency") != F.col("currency"), "error: other currency")
        .when(~has & differs, "error: different amount or date")
        .when(~has, "noop")
        .when(edited, "error: edited by hand")
        .when(same & flow & (~transfer | (a("kind") == F.col("new_kind"))), "noop")
        .otherwise("update")
    )


def plan(transactions: DataFrame, mapping: DataFrame, activities: DataFrame, aliases: DataFrame | None = None, prefix: str = "src") -> DataFrame:
    """One row per transaction with ``op``: create, update, noop, before cutoff, or an error.

    activities: id, account_id, status, day, amount, currency, kind, group_id, comment, key, metadata (JSON text).
    """
    rows = keyed(transactions, mapping, prefix)
    found = rows.join(matches(rows, activities, aliases), ["source_id", "txn_id"], "left")
    named = activities.select(*(F.col(c).alias(f"a_{c}") for c in ("id", "account_id", "status", "day", "amount", "currency", "kind", "group_id", "comment", "metadata")))
    joined = found.join(named, F.col("activity_id") == F.col("a_id"), "left")
    op = (
        F.when(F.coalesce("n", F.lit(0)) > 1, "error: several activities")
        .when(F.col("activity_id").isNotNull() & F.col("a_id").isNull(), "error: alias to a missing activity")
        .when(F.col("a_id").isNotNull(), _verdict(money.metadata(F.col("a_metadata"))))
        .when(F.col("day") <= F.col("history_through"), "before cutoff")
        .otherwise("create")
    )
    return joined.withColumn("op", op)


def payloads(planned: DataFrame, zone: str = "UTC") -> DataFrame:
    """Rows to write for creates and updates. A comment changes only if it still is the previous description."""
    transfer = F.col("new_kind").isin(*money.TRANSFERS)
    previous = F.try_variant_get(money.metadata(F.col("a_metadata")), "$.source.description", "string")
    comment = F.when(F.col("a_id").isNull() | F.col("a_comment").eqNullSafe(previous), F.col("description")).otherwise(F.col("a_comment"))
    utc_day = F.when(F.col("posted_at").isNotNull(), F.col("posted_day"))  # told apart where the day was moved to the account's zone
    source = F.struct(F.col("amount").cast("string").alias("amount"), F.col("day").cast("string").alias("date"), "description", utc_day.cast("string").alias("utcDate"))
    meta = F.to_json(F.struct(source.alias("source"), F.struct((transfer & F.col("a_group_id").isNull()).alias("is_external")).alias("flow")))
    return planned.where("op in ('create', 'update')").select(
        "op", F.col("a_id").alias("id"), "account_id", F.col("new_kind").alias("kind"), F.lit("POSTED").alias("status"), "day",
        money.day_anchor(F.col("day"), zone).alias("at"), F.abs("amount").alias("amount"), "currency", comment.alias("comment"), "key",
        F.col("a_group_id").alias("group_id"), meta.alias("metadata"),
    )


def applied(activities: DataFrame, changes: DataFrame) -> DataFrame:
    """The ledger after the changes: replaced rows by id, new rows under their keys."""
    columns = ["id", "account_id", "status", "day", "amount", "currency", "kind", "group_id", "comment", "key", "metadata"]
    new = changes.withColumn("id", F.coalesce("id", "key")).select(*columns)
    return activities.select(*columns).join(new.select("id"), "id", "left_anti").select(*columns).unionByName(new)


def unlinked(activities: DataFrame, changes: DataFrame) -> DataFrame:
    """(id, group_id, problem) of both legs of transfers whose leg changes in kind or signed amount.

    A group that does not have exactly one counterpart is a problem.
    """
    before = activities.where("group_id is not null").select("id", "group_id", F.col("kind").alias("old_kind"), F.col("amount").alias("old_amount"))
    size = before.groupBy("group_id").agg(F.count("*").alias("legs"))
    signed = lambda k, a: money.activity_amount(F.col(k), F.col(a), F.lit(None).cast("string"))
    touched = before.join(changes.where("op = 'update'").select("id", "kind", "amount"), "id")
    changed = touched.where((F.col("old_kind") != F.col("kind")) | ~signed("old_kind", "old_amount").eqNullSafe(signed("kind", "amount")))
    groups = changed.select("group_id").distinct().join(size, "group_id")
    return before.select("id", "group_id").join(groups, "group_id").select("id", "group_id", F.when(F.col("legs") != 2, "no single counterpart").alias("problem"))
