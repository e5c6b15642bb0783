"""Queries over the driver's tables, one for each ledger operator, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import money, stats, text
from .operators import asof, balances, holdings, merge_plan, pattern_index, rules, selection, validation
from .plans import adapters as ad
from .plans import actions, decisions, evaluation, naive_bayes, paging, proposals, sync, upkeep, views
from .sources import scratch, sinks, store
from .streaming import replay, settling

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    """Register a query under its function's name."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def real(name: str) -> F.Column:
    return F.col(name).cast("double").alias(name)


# Merchants and scalar functions


@query(
    f"""WITH x AS (SELECT {ad.key_sql(ad.WORDS_SQL.format("description"))} AS key, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, CAST(l_shipdate AS DATE) AS day
  FROM (SELECT *, CASE l_linenumber % 3 WHEN 0 THEN 'SQ *' || p_name WHEN 1 THEN 'POS 12 ' || p_name ELSE p_name END AS description FROM lineitem JOIN part ON l_partkey = p_partkey))
SELECT key, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total, min(day) AS first, max(day) AS last FROM x GROUP BY key ORDER BY total DESC, key"""
)
def merchant_queue(spark, folder):
    lines, part = ad.table(spark, folder, "lineitem"), ad.table(spark, folder, "part").select("p_partkey", "p_name")
    n = F.col("l_linenumber") % 3
    description = F.when(n == 0, F.concat(F.lit("SQ *"), "p_name")).when(n == 1, F.concat(F.lit("POS 12 "), "p_name")).otherwise(F.col("p_name"))
    # the key is a function of the part and n, so it is computed once for each of them, not for each line
    sums = lines.groupBy("l_partkey", n.alias("l_linenumber")).agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("t"), F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"))
    keyed = sums.join(part, F.col("l_partkey") == F.col("p_partkey")).withColumn("key", text.merchant_key(description))
    found = keyed.groupBy("key").agg(F.sum("n").alias("n"), F.sum("t").cast("double").alias("total"), F.to_date(F.min("a")).alias("first"), F.to_date(F.max("b")).alias("last"))
    return found.orderBy(F.col("total").desc(), "key")


@query(f"WITH {ad.TX_SQL} SELECT account_kind, kind, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total FROM tx GROUP BY ALL")
def cash_kind_counts(spark, folder):
    return ad.transactions(spark, folder).groupBy("account_kind", "kind").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"))


@query(f"WITH {ad.TX_SQL} SELECT account_id, CAST(sum({ad.SIGNED_SQL}) AS DOUBLE) AS total FROM tx GROUP BY account_id")
def activity_amount_totals(spark, folder):
    rows = ad.transactions(spark, folder)
    signed = money.activity_amount(F.col("kind"), F.col("amount"), F.col("account_kind"))
    return rows.groupBy("account_id").agg(F.sum(signed).cast("double").alias("total"))


@query(
    f"""WITH {ad.TX_SQL} SELECT id, list_filter(list_concat([CASE WHEN kind <> 'WITHDRAWAL' THEN 'type:' || lower(kind) END, CASE WHEN merchant <> '' THEN 'm:' || merchant END],
  CASE WHEN merchant <> '' THEN list_transform(list_filter(list_distinct({ad.WORDS_SQL.format("description")}), lambda w: NOT list_contains({ad.NOISE_SQL}, w)
     AND w NOT IN ('OF', 'THE', 'AND', 'FOR', 'INC', 'LLC', 'COM', 'WWW', 'CORP') AND length(w) > 2 AND NOT regexp_matches(w, '[0-9]')), lambda w: 'w:' || w) ELSE [] END,
  ['amt:' || CAST(floor(log2(CAST(abs(amount) AS DOUBLE) + 1)) AS INTEGER), 'dow:' || (['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'])[isodow(day)]]), lambda x: x IS NOT NULL).list_sort().array_to_string('|') AS features FROM tx"""
)
def row_features(spark, folder):
    none = F.lit(None).cast("string")
    found = text.features(F.col("kind"), F.col("description"), F.col("merchant"), F.col("amount"), F.col("day"), F.array().cast("array<string>"), none, F.lit(None).cast("long"), "UTC")
    return ad.transactions(spark, folder).select("id", F.array_join(F.array_sort(found), "|").alias("features"))


@query(
    """SELECT 'hr:' || lpad(CAST((hour(ts) // 3) * 3 AS VARCHAR), 2, '0') AS hr, 'amt:' || CAST(floor(log2(abs(value) + 1)) AS INTEGER) AS amt,
  'dow:' || (['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'])[isodow(ts)] AS dow, count(*) AS n FROM events GROUP BY ALL"""
)
def feature_buckets(spark, folder):
    e = ad.table(spark, folder, "events")
    part = lambda prefix, x: F.concat(F.lit(prefix), x)
    hour = text.hour_bucket(F.unix_seconds(F.col("ts").cast("timestamp")), "UTC")
    return e.groupBy(part("hr:", hour).alias("hr"), part("amt:", text.amount_bucket(F.col("value")).cast("string")).alias("amt"), part("dow:", text.day_name(F.col("ts"))).alias("dow")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS id, list_sum(list_transform(string_split(sha1(c_name), ''), lambda d: instr('0123456789abcdef', d) - 1))::INTEGER % 5 AS fold FROM customer")
def fold_assignment(spark, folder):
    return ad.table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), stats.fold(F.col("c_name")).alias("fold"))


# Validation and the merge plan


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) = 1")
def first_seen_dedup(spark, folder):
    rows = ad.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return validation.first_seen(rows, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark, folder):
    return validation.repeated(ad.table(spark, folder, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, count(DISTINCT (l_partkey, l_suppkey)) AS versions FROM lineitem GROUP BY ALL HAVING count(DISTINCT (l_partkey, l_suppkey)) > 1")
def conflict_detection(spark, folder):
    return validation.conflicts(ad.table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])


def _ledger(spark, folder) -> DataFrame:
    """Activities made from three of four transactions, some of them changed since."""
    rows, n = ad.transactions(spark, folder).where("id % 4 <> 0"), F.col("id")
    before = F.when(n % 10 == 1, F.col("amount") - F.when(F.col("amount") < 0, F.lit(-1)).otherwise(1)).otherwise(F.col("amount")).cast("decimal(18,2)")
    stored = F.abs(before) + F.when(n % 25 == 3, 5).otherwise(0)
    source = F.struct(before.cast("string").alias("amount"), F.col("day").cast("string").alias("date"), "description")
    meta = F.to_json(F.struct(source.alias("source"), F.struct(F.col("kind").isin(*money.TRANSFERS).alias("is_external")).alias("flow")))
    return rows.select(F.concat(F.lit("a"), "id").alias("id"), F.col("account_id").cast("string").alias("account_id"), F.when(n % 50 == 2, "VOID").otherwise("POSTED").alias("status"), "day", stored.cast("decimal(18,2)").alias("amount"), F.lit("USD").alias("currency"), "kind", F.lit(None).cast("string").alias("group_id"), F.col("description").alias("comment"), F.concat_ws(":", F.lit("src"), "account_id", "id").alias("key"), meta.alias("metadata"))


def _sources(spark, folder) -> tuple[DataFrame, DataFrame]:
    rows = ad.transactions(spark, folder)
    source = rows.select(F.col("account_id").cast("string").alias("source_id"), F.col("id").cast("string").alias("txn_id"), F.lit(0).alias("pos"), F.lit(False).alias("pending"), F.col("day").alias("posted_day"), F.lit(None).cast("timestamp").alias("posted_at"), "amount", "description")
    c = ad.table(spark, folder, "customer")
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "CREDIT_CARD").otherwise("CASH")
    mapping = c.select(F.col("c_custkey").cast("string").alias("source_id"), F.col("c_custkey").cast("string").alias("account_id"), kind.alias("account_kind"), F.lit("USD").alias("currency"), F.lit("1996-12-31").cast("date").alias("history_through"), F.lit("UTC").alias("zone"))
    return source, mapping


OPS_SQL = """CASE WHEN id % 4 = 0 THEN CASE WHEN day <= DATE '1996-12-31' THEN 'before cutoff' ELSE 'create' END
  WHEN id % 50 = 2 THEN 'error: not posted' WHEN id % 25 = 3 THEN 'error: edited by hand' WHEN id % 10 = 1 THEN 'update' ELSE 'noop' END"""


@query(f"WITH {ad.TX_SQL} SELECT {OPS_SQL} AS op, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total FROM tx GROUP BY ALL")
def txn_merge_plan(spark, folder):
    source, mapping = _sources(spark, folder)
    planned = merge_plan.plan(source, mapping, _ledger(spark, folder))
    return planned.groupBy("op").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"))


@query(f"WITH {ad.TX_SQL}, p AS (SELECT *, {OPS_SQL} AS op FROM tx) SELECT op, kind, count(*) AS n, CAST(sum(abs(amount)) AS DOUBLE) AS total FROM p WHERE op IN ('create', 'update') GROUP BY ALL")
def merge_payloads(spark, folder):
    source, mapping = _sources(spark, folder)
    made = merge_plan.payloads(merge_plan.plan(source, mapping, _ledger(spark, folder)))
    return made.groupBy("op", "kind").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"))


@query(f"WITH {ad.TX_SQL} SELECT CAST(account_id AS VARCHAR) AS account_id FROM tx WHERE id % 5 = 0 AND day > DATE '1997-12-31' AND status = 'POSTED' GROUP BY account_id")
def foreign_overlap_guard(spark, folder):
    rows = ad.transactions(spark, folder)
    key = F.when(F.col("id") % 5 == 0, F.concat(F.lit("manual:"), "id")).otherwise(F.concat_ws(":", F.lit("src"), "account_id", "id"))
    activities = rows.select(F.col("id").cast("string").alias("id"), F.col("account_id").cast("string").alias("account_id"), "status", "day", key.alias("key"))
    mapping = ad.table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("account_id"), F.col("c_custkey").cast("string").alias("source_id"), F.lit("1997-12-31").cast("date").alias("history_through"))
    return merge_plan.overlaps(activities, mapping)


def _grouped(spark, folder) -> tuple[DataFrame, DataFrame]:
    rows = ad.transactions(spark, folder).withColumn("group_id", F.concat(F.lit("g"), F.floor(F.col("id") / 2)))
    changes = rows.where("id % 6 = 0").select(F.lit("update").alias("op"), "id", F.lit("WITHDRAWAL").alias("kind"), F.abs("amount").alias("amount"))
    return rows, changes


@query(
    f"""WITH {ad.TX_SQL}, g AS (SELECT *, 'g' || (id // 2) AS group_id FROM tx), changed AS (SELECT DISTINCT group_id FROM g WHERE id % 6 = 0 AND (kind <> 'WITHDRAWAL' OR amount > 0)),
size AS (SELECT group_id, count(*) AS legs FROM g GROUP BY group_id) SELECT id, group_id, CASE WHEN legs <> 2 THEN 'no single counterpart' END AS problem FROM g JOIN changed USING (group_id) JOIN size USING (group_id)"""
)
def transfer_pairs_unlinked(spark, folder):
    rows, changes = _grouped(spark, folder)
    return merge_plan.unlinked(rows, changes)


@query(
    f"""WITH {ad.TX_SQL} SELECT account_id, account_id % 2 = 0 AS in_scope, count(*) AS legs FROM tx WHERE kind IN ('TRANSFER_IN', 'TRANSFER_OUT') AND status = 'POSTED' AND id % 3 <> 1 GROUP BY account_id"""
)
def unpaired_transfers(spark, folder):
    rows = ad.transactions(spark, folder).withColumn("group_id", F.when(F.col("id") % 3 == 1, F.lit("g")))
    scope = ad.table(spark, folder, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("account_id"))
    return balances.unpaired_transfers(rows, scope)


# As-of joins, bands, runs


@query(f"WITH {ad.EV_SQL} SELECT user_id, event_id, CAST(value AS DOUBLE) AS value FROM ev WHERE event_type IN ('purchase', 'view') AND ts < TIMESTAMP '2024-01-21' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1")
def latest_snapshot_asof(spark, folder):
    where = F.col("event_type").isin("purchase", "view") & (F.col("ts") < F.lit("2024-01-21").cast("timestamp_ntz"))
    return asof.latest(ad.events(spark, folder), ["user_id"], "ts", where, ["event_id"]).select("user_id", "event_id", real("value"))


@query(
    f"""WITH {ad.EV_SQL} SELECT a.event_id, b.event_id AS seen_event_id, CAST(b.value AS DOUBLE) AS seen_value FROM (SELECT * FROM ev WHERE event_type = 'signup') a
ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND a.ts > b.ts"""
)
def strict_asof(spark, folder):
    signups = ad.events(spark, folder, "signup").select("event_id", "user_id", "ts")
    bought = ad.events(spark, folder, "purchase").select("user_id", F.col("ts").alias("seen_ts"), F.col("event_id").alias("seen_event_id"), F.col("value").alias("seen_value"))
    return asof.before(signups, bought, ["user_id"], "ts", "seen_ts").select("event_id", "seen_event_id", real("seen_value"))


@query(
    f"""WITH {ad.EV_SQL} SELECT event_id, CAST(value AS DOUBLE) AS value FROM ev a WHERE event_type = 'purchase' AND EXISTS (SELECT 1 FROM ev b WHERE b.event_type = 'click' AND b.user_id = a.user_id
  AND abs(a.value - b.value) <= 0.05 AND b.ts >= a.ts - INTERVAL 7 DAY)"""
)
def purchase_range_semi(spark, folder):
    a, b = ad.events(spark, folder, "purchase"), ad.events(spark, folder, "click").select("user_id", "value", "ts")
    found = asof.near(a, b, ["user_id"], ("value", "value"), "0.05", also=F.col("r.ts") >= F.col("l.ts") - F.expr("INTERVAL 7 DAYS"))
    return found.select("event_id", real("value"))


@query(
    """WITH l AS (SELECT event_id AS line_id, user_id, CAST(floor(value / 10) AS BIGINT) AS cell, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'click'),
r AS (SELECT event_id AS row_id, user_id, CAST(floor(value / 10) AS BIGINT) AS cell, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'view'),
p AS (SELECT line_id, row_id FROM l JOIN r USING (user_id, cell) WHERE abs(l.d - r.d) <= 3), one AS (SELECT * FROM p QUALIFY count(*) OVER (PARTITION BY line_id) = 1)
SELECT line_id, row_id FROM one QUALIFY count(*) OVER (PARTITION BY row_id) = 1"""
)
def cardmember_band_match(spark, folder):
    e = ad.table(spark, folder, "events").select("event_id", "event_type", "user_id", F.floor(F.col("value") / 10).alias("cell"), F.to_date("ts").alias("d"))
    lines = e.where("event_type = 'click'").select(F.col("event_id").alias("line_id"), F.col("d").alias("line_day"), "user_id", "cell")
    rows = e.where("event_type = 'view'").select(F.col("event_id").alias("row_id"), F.col("d").alias("row_day"), "user_id", "cell")
    return asof.one_to_one(lines, rows, ["user_id", "cell"])


@query(
    """WITH q AS (SELECT user_id, ts, CAST(floor(value / 40) AS BIGINT) AS quantity FROM events), l AS (SELECT *, first_value(quantity) OVER (PARTITION BY user_id ORDER BY ts DESC) AS value FROM q),
b AS (SELECT *, sum(CASE WHEN quantity <> value THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts DESC) AS broken FROM l)
SELECT user_id, value, min(ts) AS since, max(ts) AS until, count(*) AS days FROM b WHERE broken = 0 GROUP BY ALL"""
)
def quantity_island(spark, folder):
    e = ad.table(spark, folder, "events").select("user_id", "ts", F.floor(F.col("value") / 40).alias("quantity"))
    return asof.current_run(e, ["user_id"], "ts", "quantity")


# Balances and holdings


def _accounts(spark, folder) -> DataFrame:
    c = ad.table(spark, folder, "customer")
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "CREDIT_CARD").otherwise("CASH")
    return c.select(F.col("c_custkey").alias("account_id"), kind.alias("account_kind"), F.lit("USD").alias("currency"), F.col("c_acctbal").cast("decimal(18,2)").alias("balance"), F.lit("1998-06-30").cast("date").alias("balance_day"))


@query(
    f"""WITH {ad.TX_SQL}, p AS (SELECT account_id, {ad.SIGNED_SQL} AS v, day, id FROM tx WHERE status = 'POSTED'),
s AS (SELECT account_id, sum(CASE WHEN day > DATE '1998-06-30' THEN v END) AS later, sum(v) AS actual, max(CASE WHEN id % 97 = 0 THEN 1 ELSE 0 END) AS unfit FROM p GROUP BY account_id),
j AS (SELECT c_custkey AS account_id, c_mktsegment <> 'BUILDING' AS cash, CAST(c_acctbal AS DECIMAL(18,2)) + coalesce(later, 0) AS expected, coalesce(actual, 0) AS actual, coalesce(unfit, 0) AS unfit FROM customer LEFT JOIN s ON c_custkey = account_id)
SELECT account_id, CAST(expected AS DOUBLE) AS expected, CAST(actual AS DOUBLE) AS actual,
 CASE WHEN cash THEN CASE WHEN unfit = 1 THEN 'not a cash-only ledger in one currency' WHEN abs(actual - expected) > 0.005 THEN 'does not reconcile' END END AS problem FROM j"""
)
def balance_projection(spark, folder):
    rows = ad.transactions(spark, folder).drop("account_kind").withColumn("currency", F.when(F.col("id") % 97 == 0, "EUR").otherwise("USD")).withColumn("utc_day", F.lit(None).cast("date"))
    return balances.projection(_accounts(spark, folder), rows).select("account_id", real("expected"), real("actual"), "problem")


def _positions(spark, folder) -> DataFrame:
    lines = ad.table(spark, folder, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("quantity"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("value"))
    n, dec = F.col("l_partkey"), lambda x: x.cast(money.MONEY)
    return lines.select(
        F.col("l_suppkey").cast("string").alias("source_id"), n.cast("string").alias("position_id"), F.when(n % 50 == 0, "").otherwise(F.concat(F.lit("S"), n)).alias("symbol"), F.when(n % 50 == 0, "Cash").otherwise("Fund").alias("description"),
        dec(F.col("quantity")).alias("quantity"), dec(F.col("value")).alias("value"), F.lit("USD").alias("currency"), F.when(n % 5 == 0, dec(F.col("value"))).alias("cost_basis"), F.when(n % 5 == 1, dec(n)).alias("purchase_price"), n.alias("n"),
    )


def _owners(spark, folder) -> DataFrame:
    return ad.table(spark, folder, "supplier").select(F.col("s_suppkey").cast("string").alias("source_id"), F.lit("USD").alias("currency"), F.lit(True).alias("per_unit"))


POS_SQL = "pos AS (SELECT l_suppkey, l_partkey AS n, sum(CAST(l_quantity AS DECIMAL(18,2))) AS quantity, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS value FROM lineitem GROUP BY ALL)"


@query(
    f"""WITH {POS_SQL}, c AS (SELECT *, CASE WHEN n % 5 = 0 THEN 'provider' WHEN n % 5 = 1 AND n > 0 THEN 'purchase price' WHEN n % 5 = 2 THEN 'verified' WHEN n % 5 = 3 THEN 'retained' END AS cost_from FROM pos WHERE n % 50 <> 0)
SELECT CAST(l_suppkey AS VARCHAR) AS source_id, cost_from, count(*) AS n, CAST(sum(value) AS DOUBLE) AS value, CAST(max(CASE n % 5 WHEN 0 THEN value WHEN 1 THEN n WHEN 2 THEN 7 WHEN 3 THEN 2 END) AS DOUBLE) AS most FROM c GROUP BY ALL"""
)
def cost_precedence(spark, folder):
    positions = _positions(spark, folder)
    verified = positions.where("n % 5 = 2").select("source_id", F.col("symbol").alias("name_key"), F.lit(7).cast(money.MONEY).alias("unit_cost"), F.lit(None).cast(money.MONEY).alias("verified_quantity"), F.lit(None).cast(money.MONEY).alias("verified_basis"))
    asset = money.uuid5(money.NAMESPACE_URL, F.concat_ws(":", F.lit("src"), "source_id", "position_id"))
    current = positions.where("n % 5 = 3").select(asset.alias("asset_id"), F.col("quantity").alias("held_quantity"), (F.col("quantity") * 2).cast(money.MONEY).alias("held_basis"))
    planned = holdings.planned(positions, _owners(spark, folder), current, verified)
    return planned.groupBy("source_id", "cost_from").agg(F.count("*").alias("n"), F.sum("value").cast("double").alias("value"), F.max("average_cost").cast("double").alias("most"))


@query(
    f"""WITH {POS_SQL} SELECT CAST(l_suppkey AS VARCHAR) AS source_id, CAST(sum(CASE WHEN n % 50 <> 0 THEN value ELSE 0 END) AS DOUBLE) AS invested, CAST(sum(CASE WHEN n % 50 = 0 THEN value ELSE 0 END) AS DOUBLE) AS cash, l_suppkey % 7 <> 0 AS ok FROM pos GROUP BY l_suppkey"""
)
def holdings_reconcile(spark, folder):
    positions = _positions(spark, folder)
    off = F.when(F.col("source_id").cast("long") % 7 == 0, 1).otherwise(0)
    accounts = positions.groupBy("source_id").agg(F.sum("value").alias("v")).select("source_id", (F.col("v") + off).alias("balance"))
    return holdings.reconciled(positions, accounts).select("source_id", real("invested"), real("cash"), "ok")


@query(
    f"""WITH {POS_SQL} SELECT CAST(l_suppkey AS VARCHAR) AS account_id, count(*) FILTER (n % 11 = 0) AS missing, count(*) FILTER (n % 17 = 0 AND n % 11 <> 0) AS extra, count(*) FILTER (n % 13 = 0 AND n % 11 <> 0 AND n % 17 <> 0) AS off,
 count(*) FILTER (n % 11 = 0 AND n % 17 <> 0) AS really_missing FROM pos GROUP BY l_suppkey""".replace("count(*) FILTER (n % 11 = 0) AS missing, ", "").replace("really_missing", "missing")
)
def position_shape_difference(spark, folder):
    rows = _positions(spark, folder).select(F.col("source_id").alias("account_id"), F.col("position_id").alias("asset_id"), "quantity", "value", "n")
    expected, actual = rows.where("n % 17 <> 0"), rows.where("n % 11 <> 0")
    actual = actual.withColumn("quantity", F.col("quantity") + F.when(F.col("n") % 13 == 0, F.lit("0.000001").cast(money.MONEY)).otherwise(F.lit(0)))
    return balances.shape_difference(expected, actual).drop("ok")


@query("SELECT c_custkey AS account_id FROM customer WHERE c_custkey % 4 = 0 AND c_custkey % 8 <> 0 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice <> 0)")
def inactive_value_warnings(spark, folder):
    accounts = ad.table(spark, folder, "customer").select(F.col("c_custkey").alias("account_id"), (F.col("c_custkey") % 4 != 0).alias("is_active"), (F.col("c_custkey") % 8 == 0).alias("is_archived"))
    return balances.inactive_with_value(accounts, ad.table(spark, folder, "orders").select(F.col("o_custkey").alias("account_id"), F.col("o_totalprice").alias("value"))).select("account_id")


@query("SELECT c_custkey AS account_id, c_custkey % 3 = 0 AS ok FROM customer")
def settled_balances(spark, folder):
    c = ad.table(spark, folder, "customer").select(F.col("c_custkey").alias("account_id"), F.col("c_acctbal").cast("decimal(18,2)").alias("total"))
    n = F.col("account_id") % 3
    reads = c.select("account_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("attempt"), "total")
    reads = reads.withColumn("total", F.col("total") + F.when((n == 1) & (F.col("attempt") == 3), 1).when(n == 2, 2).otherwise(0))
    return balances.settled(c, reads)


@query(
    """WITH s AS (SELECT user_id, ts, CAST(value AS DECIMAL(18,2)) AS cash FROM events WHERE event_type = 'view'),
last AS (SELECT a.user_id, arg_max(s.ts, s.ts) AS ts, arg_max(s.cash, s.ts) AS cash FROM (SELECT DISTINCT user_id FROM events) a JOIN s ON s.user_id = a.user_id AND CAST(s.ts AS DATE) < DATE '2024-01-25' GROUP BY a.user_id)
SELECT CAST(user_id AS VARCHAR) AS source_id, CAST(ts AS DATE) AS kept_day FROM last WHERE cash <> 0 AND NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'purchase' AND e.user_id = last.user_id
 AND abs(CAST(e.value AS DECIMAL(18,2)) - cash) <= 5 AND CAST(e.ts AS DATE) >= CAST(last.ts AS DATE) - 7)"""
)
def unexplained_zeros(spark, folder):
    e = ad.events(spark, folder)
    user = F.col("user_id").cast("string")
    sources = e.select(user.alias("source_id"), user.alias("account_id"), user.alias("purchase_account"), F.lit(0).alias("balance"), F.lit("2024-01-25").cast("date").alias("balance_day")).distinct()
    views_only = e.where("event_type = 'view'").withColumn("day", F.to_date("ts"))
    last_of_day = views_only.groupBy(user.alias("account_id"), "day").agg(F.max_by("value", "ts").alias("cash")).withColumn("kind", F.lit("MANUAL_ENTRY"))
    bought = e.where("event_type = 'purchase'").select(user.alias("source_id"), F.to_date("ts").alias("posted_day"), F.col("value").alias("amount"))
    return balances.unexplained_zeros(sources, last_of_day, bought, "5")


@query("SELECT c_custkey AS id, CAST(c_acctbal AS DECIMAL(18,2))::DOUBLE AS value FROM customer WHERE c_custkey % 4 = 0 OR c_custkey % 4 = 1 OR (c_custkey % 4 = 2 AND c_custkey % 3 = 0)")
def liability_upserts(spark, folder):
    c, k = ad.table(spark, folder, "customer"), F.col("c_custkey")
    value, day = F.col("c_acctbal").cast("decimal(18,2)"), F.lit("2024-02-01").cast("date")
    observed = c.select(k.alias("id"), value.alias("value"), day.alias("day"))
    current = c.where("c_custkey % 4 <> 0").select(k.alias("id"), (value + F.when(k % 3 == 0, 1).otherwise(0)).alias("value"), F.when(k % 4 == 1, F.date_sub(day, 1)).when(k % 4 == 3, F.date_add(day, 1)).otherwise(day).alias("day"))
    return sinks.valuations(current, observed).select("id", real("value"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 6 = 0 THEN 'new' ELSE c_mktsegment END AS segment FROM customer UNION ALL SELECT -c_custkey - 1, 'new' FROM customer WHERE c_custkey % 10 = 0")
def keyed_upsert(spark, folder):
    c = ad.table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    changed = c.where("id % 6 = 0").select("id", F.lit("new").alias("segment")).unionByName(c.where("id % 10 = 0").select((-F.col("id") - 1).alias("id"), F.lit("new").alias("segment")))
    return sinks.upserted(c, changed, ["id"])


# Rules


RULES = [
    {"id": "r1", "match": "contains", "pattern": "ring", "category_id": "c1", "priority": 1, "is_global": True},
    {"id": "r2", "match": "starts_with", "pattern": "pos", "category_id": "c2", "priority": 5, "is_global": True, "kind": "WITHDRAWAL"},
    {"id": "r3", "match": "regex", "pattern": "(?i)^payment", "category_id": "c3", "priority": 3, "is_global": True, "amount_op": "gt", "amount_value": 100000.0},
    {"id": "r4", "match": "exact", "pattern": "bank P2P", "category_id": "c4", "priority": 3, "is_global": True, "amount_op": "between", "amount_value": 1000.0, "amount_value2": 200000.0},
    {"id": "r5", "match": "regex", "pattern": "(unclosed", "category_id": "c5", "priority": 9, "is_global": True},
    {"id": "r6", "match": "contains", "pattern": "interest", "category_id": None, "priority": 9, "is_global": True},
    {"id": "r7", "match": "contains", "pattern": "a", "category_id": "c7", "priority": 0, "is_global": False, "account_id": 7},
    {"id": "r8", "match": "other", "pattern": "a", "category_id": "c8", "priority": 9, "is_global": True},
]
RULE_SQL = """CASE WHEN starts_with(upper(description), 'POS') AND kind = 'WITHDRAWAL' THEN 'r2' WHEN regexp_matches(description, '(?i)^payment') AND abs(amount) > 100000 THEN 'r3'
  WHEN upper(description) = 'BANK P2P' AND abs(amount) BETWEEN 1000 AND 200000 THEN 'r4' WHEN contains(upper(description), 'RING') THEN 'r1' WHEN account_id = 7 AND contains(upper(description), 'A') THEN 'r7' END"""


def _matched(spark, folder) -> DataFrame:
    return rules.first_match(ad.transactions(spark, folder).withColumnRenamed("description", "notes"), RULES)


@query(f"WITH {ad.TX_SQL} SELECT id, {RULE_SQL} AS rule_id FROM tx")
def rule_first_match(spark, folder):
    return _matched(spark, folder).select("id", "rule_id")


DEFAULTS = {"1": {"default": "A", "patterns": {"(?i)ring": "B", "(?i)pos": "C"}}, "2": {"default": None, "patterns": {"^Pay": "D"}}, "3": {"default": "E"}}


@query(
    f"""WITH {ad.TX_SQL} SELECT id, CASE account_id WHEN 1 THEN CASE WHEN regexp_matches(description, '(?i)ring') THEN 'B' WHEN regexp_matches(description, '(?i)pos') THEN 'C' ELSE 'A' END
  WHEN 2 THEN CASE WHEN regexp_matches(description, '^Pay') THEN 'D' END WHEN 3 THEN 'E' END AS value FROM tx"""
)
def account_default_first_pattern(spark, folder):
    rows = ad.transactions(spark, folder).withColumnRenamed("description", "notes")
    return rules.account_default(rows, DEFAULTS, "value").select("id", "value")


# Decisions


@query(f"WITH {ad.LOG_SQL} SELECT seq, source, value FROM alive")
def live_decisions(spark, folder):
    return decisions.live(ad.decision_log(spark, folder)).select("seq", "source", "value")


@query(f"WITH {ad.LOG_SQL} SELECT seq, seq IN (SELECT reverts FROM lg WHERE reverts IS NOT NULL) AS reverted FROM lg WHERE reverts IS NULL")
def decision_history(spark, folder):
    return decisions.history(ad.decision_log(spark, folder)).select("seq", "reverted")


@query(f"WITH {ad.LOG_SQL}, m AS (SELECT arg_max(action, seq) AS action FROM alive WHERE author = 'u1') SELECT seq, value FROM alive WHERE author = 'u1' AND action = (SELECT action FROM m)")
def undo_last_action(spark, folder):
    return decisions.last_action(ad.decision_log(spark, folder), "u1").select("seq", "value")


@query(f"WITH {ad.LOG_SQL}, l AS (SELECT * FROM alive WHERE merchant IS NOT NULL QUALIFY row_number() OVER (PARTITION BY merchant ORDER BY seq DESC) = 1) SELECT merchant, value AS name FROM l WHERE value IS NOT NULL")
def merchant_names(spark, folder):
    return decisions.names(ad.decision_log(spark, folder).withColumn("field", F.lit("merchant-name")))


def _resolved(spark, folder) -> DataFrame:
    return decisions.resolve(ad.labelled_rows(spark, folder), ad.decision_log(spark, folder), threshold=0.8)


@query(f"WITH {ad.RESOLVED_SQL} SELECT id, label_source, label FROM res")
def resolve_label(spark, folder):
    return _resolved(spark, folder).select("id", "label_source", "label")


@query(
    f"""WITH {ad.LOG_SQL}, {ad.ROWS_SQL}, cand AS (SELECT cr.id, a.source, a.value, a.seq FROM cr JOIN alive a ON a.activity_id = cr.id WHERE a.source <> 'model' AND NOT blind
   UNION ALL SELECT cr.id, a.source, a.value, a.seq FROM cr JOIN alive a ON a.merchant = cr.merchant WHERE NOT blind
   UNION ALL SELECT id, 'account', account_value, 0 FROM cr WHERE account_value IS NOT NULL UNION ALL SELECT id, 'cardmember', cardmember_value, 0 FROM cr WHERE cardmember_value IS NOT NULL),
best AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY id ORDER BY CASE source WHEN 'user' THEN 4 WHEN 'app-ui' THEN 4 WHEN 'merchant' THEN 3 WHEN 'cardmember' THEN 2 ELSE 1 END DESC, seq DESC) = 1)
SELECT cr.id, source AS label_source, value AS label FROM cr LEFT JOIN (SELECT * FROM best WHERE value IS NOT NULL OR source IN ('user', 'app-ui')) b USING (id)"""
)
def training_labels(spark, folder):
    return decisions.resolve(ad.labelled_rows(spark, folder), ad.decision_log(spark, folder), training=True).select("id", "label_source", "label")


@query(
    f"""WITH {ad.RESOLVED_SQL} SELECT CASE WHEN label IS NULL THEN 'unlabeled' WHEN label_source = 'model' THEN 'model ' || format('{{:.1f}}', floor(label_confidence * 10) / 10) || '+' ELSE label_source END AS band, count(*) AS rows FROM res GROUP BY ALL"""
)
def label_status_bands(spark, folder):
    return views.status(_resolved(spark, folder))


@query(
    """WITH s AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 6 = 0 THEN 'foreign' WHEN c_custkey % 2 = 0 THEN 'e1' END AS event_id, CASE WHEN c_custkey % 2 = 0 THEN 'me' END AS value, CASE WHEN c_custkey % 3 <> 1 THEN 'me' END AS applied FROM customer)
SELECT id, value, applied FROM s WHERE event_id IS DISTINCT FROM 'foreign' AND value IS DISTINCT FROM applied"""
)
def reconcile_external_edits(spark, folder):
    k = F.col("c_custkey")
    c = ad.table(spark, folder, "customer")
    shown = c.select(k.alias("id"), F.when(k % 6 == 0, "foreign").when(k % 2 == 0, "e1").alias("event_id"), F.when(k % 2 == 0, "me").alias("value"))
    return decisions.external_edits(shown, c.where("c_custkey % 3 <> 1").select(k.alias("id"), F.lit("me").alias("applied")), ["e1"])


@query(f"WITH {ad.RESOLVED_SQL} SELECT id, label AS desired, CASE WHEN label IS NULL THEN 'cleared' ELSE 'set' END AS operation FROM res WHERE label IS DISTINCT FROM (CASE WHEN k % 2 = 0 THEN guess END)")
def label_changes(spark, folder):
    rows = _resolved(spark, folder)
    return decisions.changes(rows, rows.select("id", F.when(F.col("ord") % 2 == 0, F.col("guess")).alias("value")))


# Views


@query(
    f"""WITH {ad.RESOLVED_SQL}, q AS (SELECT *, abs(amount) AS a, greatest(abs(amount), 0.01) AS w, {ad.OPEN_SQL} AS open FROM res WHERE {ad.UNDONE_SQL})
SELECT name AS key, count(*) AS rows, round(sum(CASE WHEN open THEN (1 - guess_confidence) * a ELSE a END), 4) AS value, round(sum(a), 4) AS total, min(day) AS first, max(day) AS last, round(sum(w * guess_confidence) / sum(w), 9) AS guess_confidence FROM q GROUP BY name"""
)
def work_queue(spark, folder):
    found = views.queue(_resolved(spark, folder), "impact", ["^M1$"])
    return found.select("key", "rows", F.round("value", 4).alias("value"), F.round("total", 4).alias("total"), "first", "last", F.round("guess_confidence", 9).alias("guess_confidence"))


@query(f"WITH {ad.RESOLVED_SQL} SELECT id, guess, guess_confidence, posterior FROM res WHERE NOT held_out AND {ad.OPEN_SQL} AND guess_confidence BETWEEN 0.1 AND 0.9 AND contains(upper(name || ' ' || notes || ' ' || account), 'BUILD') ORDER BY guess_confidence DESC, posterior DESC, k LIMIT 50 OFFSET 2")
def predictions_page(spark, folder):
    return views.predictions(_resolved(spark, folder), low=0.1, high=0.9, text="build", down=True, offset=2, limit=50).select("id", "guess", "guess_confidence", "posterior")


def _audited(spark, folder) -> DataFrame:
    rows = _resolved(spark, folder)
    return rows.withColumn("category", F.array_join("category_ids", ", ")).withColumn("spender_origin", F.when(F.col("label_source").isNotNull(), views.origin(F.col("label_source"), F.lit("labeling serve")))).withColumn("category_origin", F.when(F.size("category_ids") > 0, "app rule"))


ORIGIN_SQL = "CASE label_source WHEN 'model' THEN 'Spender model' WHEN 'account' THEN 'Account default' WHEN 'cardmember' THEN 'Card issuer' WHEN 'app-ui' THEN 'You (in the app)' WHEN 'user' THEN 'You' WHEN 'merchant' THEN 'You' END"


@query(f"WITH {ad.RESOLVED_SQL} SELECT id, label, label_confidence FROM res WHERE label IS NOT NULL AND (label_confidence IS NULL OR label_confidence BETWEEN 0.85 AND 1) AND {ORIGIN_SQL} = 'You' ORDER BY coalesce(label_confidence, 1), name, day, id LIMIT 100")
def audit_page(spark, folder):
    return views.audit(_audited(spark, folder), "You", 0.85, 1.0, limit=100).select("id", "label", "label_confidence")


@query(f"WITH {ad.RESOLVED_SQL} SELECT DISTINCT origin FROM (SELECT {ORIGIN_SQL} AS origin FROM res UNION ALL SELECT 'app rule' FROM res WHERE len(category_ids) > 0) WHERE origin IS NOT NULL")
def distinct_origins(spark, folder):
    return views.origins(_audited(spark, folder))


@query("SELECT c_custkey AS id FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') ORDER BY sha1(CAST(c_custkey AS VARCHAR)) LIMIT 100")
def check_sample(spark, folder):
    rows = ad.table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("account_id"))
    return views.check_sample(rows, ["BUILDING", "MACHINERY"]).select("id")


@query(
    """WITH g AS (SELECT c_custkey AS id, CASE WHEN c_nationkey = 5 THEN 'extra' ELSE CASE c_nationkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'needs' WHEN 2 THEN 'wants' END END AS grp FROM customer)
SELECT id, CASE grp WHEN 'needs' THEN 'Need' WHEN 'wants' THEN 'Want' END AS need_want FROM g WHERE grp IS NOT NULL"""
)
def need_want(spark, folder):
    n = F.col("n_nationkey")
    categories = ad.table(spark, folder, "nation").select(F.concat(F.lit("n"), n).alias("category_id"), F.concat(F.lit("p"), n % 5).alias("parent_id"))
    group_of = spark.createDataFrame([("p1", "needs"), ("p2", "wants"), ("n5", "extra")], "category_id string, group_key string")
    rows = ad.table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.array(F.lit("unknown"), F.concat(F.lit("n"), "c_nationkey")).alias("category_ids"))
    return views.need_want(rows, categories, group_of, {"needs": "Need", "wants": "Want"})


@query(
    f"""WITH {ad.TX_SQL}, {ad.LOG_SQL}, m AS (SELECT {RULE_SQL} AS rule_id, count(*) AS n FROM tx GROUP BY ALL), keys AS (SELECT 'M' || (account_id % 40) AS merchant, count(*) AS n FROM tx GROUP BY ALL),
l AS (SELECT * FROM alive WHERE merchant IS NOT NULL QUALIFY row_number() OVER (PARTITION BY merchant ORDER BY seq DESC) = 1)
SELECT r.id, 'Category' AS kind, r.c AS sets, r.p AS pattern, coalesce(n, 0) AS rows, 'app' AS source FROM (VALUES ('r1', 'c1', 'contains ring'), ('r2', 'c2', 'starts_with pos'), ('r7', 'c7', 'contains a')) r(id, c, p) LEFT JOIN m ON m.rule_id = r.id
UNION ALL SELECT 'spender:' || seq, 'Spender', value, 'merchant ' || merchant, coalesce(n, 0), 'labeler' FROM l LEFT JOIN keys USING (merchant) WHERE value IS NOT NULL"""
)
def rules_list_union(spark, folder):
    table = spark.createDataFrame([(r["id"], r["category_id"], r["match"], r["pattern"], None) for r in RULES if r["id"] in ("r1", "r2", "r7")], "id string, category_id string, match string, pattern string, preset_id string")
    rows = ad.transactions(spark, folder).select(F.concat(F.lit("M"), F.col("account_id") % 40).alias("merchant"))
    return views.rules_list(table, _matched(spark, folder).select("rule_id"), ad.decision_log(spark, folder), rows)


@query("SELECT r_name AS org, s_name AS name, 'USD' AS currency, format('{:,.2f}', CAST(s_acctbal AS DOUBLE)) AS balance, count(*) OVER (PARTITION BY r_name) AS accounts FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def account_report(spark, folder):
    s, n, r = (ad.table(spark, folder, t) for t in ("supplier", "nation", "region"))
    rows = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return views.account_report(rows.select(F.col("r_name").alias("org"), F.col("s_name").alias("name"), F.lit("USD").alias("currency"), F.col("s_acctbal").alias("balance")))


# Merchants and proposals


def _merchant_rows(spark, folder) -> DataFrame:
    rows, n = ad.transactions(spark, folder), F.col("id")
    ids = F.when((n % 7 == 0) & (F.length("merchant") % 3 != 0), F.array(F.concat(F.lit("c"), F.length("merchant") % 4))).otherwise(F.array().cast("array<string>"))
    words = F.transform(F.split("merchant", " "), lambda w: F.concat(F.lit("w:"), w))
    return rows.select("id", n.alias("ord"), "merchant", "kind", "amount", ids.alias("category_ids"), F.lit(0).alias("splits"), F.when(n % 14 == 0, "manual").otherwise("rule").alias("source"), words.alias("features"), F.col("description").alias("notes"), F.lit(None).cast("string").alias("payee"), F.lit(None).cast("string").alias("mcc"), "account_kind")


MR_SQL = "mr AS (SELECT id, merchant, kind, amount, account_kind, description, CASE WHEN id % 7 = 0 AND length(merchant) % 3 <> 0 THEN 'c' || (length(merchant) % 4) END AS c, id % 14 = 0 AS manual FROM tx)"


@query(f"WITH {ad.TX_SQL}, {MR_SQL} SELECT merchant, CAST(sum(abs(amount)) AS DOUBLE) AS dollars FROM mr WHERE merchant <> '' GROUP BY merchant HAVING NOT bool_or(c IS NOT NULL OR starts_with(kind, 'TRANSFER'))")
def candidate_dollars(spark, folder):
    return proposals.uncategorized(_merchant_rows(spark, folder).withColumn("amount", F.col("amount").cast("decimal(18,2)")))


@query(
    f"""WITH {ad.TX_SQL}, {MR_SQL} SELECT merchant, CASE WHEN max(c) IN ('c1', 'c2') THEN max(c) END AS category_id, CASE WHEN bool_or(manual) THEN 'manual' ELSE 'rule' END AS source FROM mr WHERE merchant <> '' GROUP BY merchant
HAVING count(DISTINCT c) = 1 AND NOT bool_or(starts_with(kind, 'TRANSFER'))"""
)
def known_merchants(spark, folder):
    return proposals.known(_merchant_rows(spark, folder), ["c1", "c2"])


@query(
    f"""WITH {ad.TX_SQL}, {MR_SQL}, k AS (SELECT merchant, kind, count(*) AS n, min(id) AS o FROM mr WHERE merchant <> '' GROUP BY ALL), t AS (SELECT merchant, string_agg(kind, '|' ORDER BY n DESC, o) AS kinds FROM (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY merchant ORDER BY n DESC, o) <= 5) GROUP BY merchant)
SELECT merchant, count(*) AS transactions, floor(median(abs(CAST(amount AS DOUBLE)))) AS typical_amount, any_value(kinds) AS kinds FROM mr JOIN t USING (merchant) GROUP BY merchant"""
)
def merchant_card(spark, folder):
    return proposals.cards(_merchant_rows(spark, folder)).select("merchant", "transactions", F.floor("typical_amount").cast("double").alias("typical_amount"), F.array_join("kinds", "|").alias("kinds"))


@query(
    f"""WITH {ad.TX_SQL}, {MR_SQL}, w AS (SELECT DISTINCT unnest(string_split(merchant, ' ')) AS w FROM mr WHERE merchant = 'SMALL RING'), o AS (SELECT DISTINCT id, c FROM (SELECT id, c, unnest(string_split(merchant, ' ')) AS w FROM mr WHERE merchant <> 'SMALL RING') JOIN w USING (w))
SELECT c AS category_id, count(*) AS votes FROM o WHERE c IS NOT NULL GROUP BY c"""
)
def similar_merchant_votes(spark, folder):
    return proposals.similar_votes(_merchant_rows(spark, folder), "SMALL RING")


@query(
    f"""WITH {ad.TX_SQL}, {MR_SQL}, a AS (SELECT merchant, 'c' || (length(merchant) % 4) AS category_id, (length(merchant) * 37 % 100) / 100 AS confidence FROM mr WHERE merchant <> '' GROUP BY merchant),
u AS (SELECT merchant FROM mr WHERE merchant <> '' GROUP BY merchant HAVING NOT bool_or(c IS NOT NULL OR starts_with(kind, 'TRANSFER'))) SELECT merchant, category_id, confidence FROM a JOIN u USING (merchant) WHERE confidence >= 0.3"""
)
def confident_proposals(spark, folder):
    rows = _merchant_rows(spark, folder)
    asked = rows.where("merchant <> ''").select("merchant").distinct()
    proposed = asked.select("merchant", F.concat(F.lit("c"), F.length("merchant") % 4).alias("category_id"), (F.length("merchant") * 37 % 100 / 100).alias("confidence"))
    return proposals.chosen(proposed, rows, 0.3)


# Classifier


def _examples(spark, folder) -> DataFrame:
    rows = ad.transactions(spark, folder)
    features = F.array(F.concat(F.lit("m:"), "merchant"), F.concat(F.lit("type:"), F.lower("kind")), F.concat(F.lit("dow:"), text.day_name(F.col("day"))), F.concat(F.lit("amt:"), text.amount_bucket(F.col("amount")).cast("string")))
    label = F.concat(F.lit("k"), (F.length("merchant") + F.col("account_id")) % 3)
    return rows.select("id", features.alias("features"), label.alias("label"), F.when(F.col("id") % 4 == 0, 0.3).otherwise(1.0).alias("weight"), "day", "merchant")


EX_SQL = """ex AS (SELECT id, ['m:' || merchant, 'type:' || lower(kind), 'dow:' || (['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'])[isodow(day)], 'amt:' || CAST(floor(log2(CAST(abs(amount) AS DOUBLE) + 1)) AS INTEGER)] AS features,
  'k' || ((length(merchant) + account_id) % 3) AS label, CASE WHEN id % 4 = 0 THEN 0.3 ELSE 1.0 END::DOUBLE AS weight, day, merchant FROM tx)"""
NB_SQL = """fe AS (SELECT id, label, weight, unnest(features) AS feature FROM {train}), fs AS (SELECT label, feature, sum(weight) AS weight, count(*) AS seen FROM fe GROUP BY ALL),
cl AS (SELECT label, sum(weight) AS prior FROM {train} GROUP BY label), ct AS (SELECT label, sum(weight) AS total FROM fe GROUP BY label), v AS (SELECT count(DISTINCT feature) AS v FROM fe), w AS (SELECT sum(prior) AS w, count(*) AS k FROM cl)"""


@query(f"WITH {ad.TX_SQL}, {EX_SQL}, {NB_SQL.format(train='ex')} SELECT label, feature, round(weight, 6) AS weight, seen FROM fs")
def nb_stats(spark, folder):
    model = naive_bayes.fit(_examples(spark, folder), ["k0", "k1", "k2"])
    return model.feature_stats.select("label", "feature", F.round("weight", 6).alias("weight"), "seen")


@query(
    f"""WITH {ad.TX_SQL}, {EX_SQL}, tr AS (SELECT * FROM ex WHERE id % 5 <> 0), {NB_SQL.format(train='tr')}, q AS (SELECT id, unnest(features) AS feature FROM ex), known AS (SELECT q.* FROM q WHERE feature IN (SELECT feature FROM fs)),
sc AS (SELECT i.id, cl.label, ln((prior + 1) / (w + k)) + coalesce(sum(CASE WHEN kn.feature IS NOT NULL THEN ln((coalesce(fs.weight, 0) + 0.5) / (total + 0.5 * (v + 1))) END), 0) AS s
  FROM (SELECT id FROM ex) i CROSS JOIN cl JOIN ct USING (label) CROSS JOIN v CROSS JOIN w LEFT JOIN known kn ON kn.id = i.id LEFT JOIN fs ON fs.label = cl.label AND fs.feature = kn.feature GROUP BY i.id, cl.label, prior, w, k),
p AS (SELECT id, label, exp(s - max(s) OVER (PARTITION BY id)) / sum(exp(s - max_s)) OVER (PARTITION BY id) AS posterior FROM (SELECT *, max(s) OVER (PARTITION BY id) AS max_s FROM sc))
SELECT id, label, round(posterior, 6) AS posterior FROM p"""
)
def nb_predict(spark, folder):
    rows = _examples(spark, folder)
    model = naive_bayes.fit(rows.where("id % 5 <> 0"), ["k0", "k1", "k2"])
    return naive_bayes.scores(rows, model).select("id", "label", F.round("posterior", 6).alias("posterior"))


def _pairs(spark, folder) -> DataFrame:
    k = F.col("o_orderkey")
    right = (k * 7 % 100) < (k % 101)
    return ad.table(spark, folder, "orders").select(F.concat(F.lit("k"), k % 3).alias("guess"), (k % 101 / 100).alias("confidence"), F.when(right, F.concat(F.lit("k"), k % 3)).otherwise("no").alias("truth"))


PAIRS_SQL = "pr AS (SELECT 'k' || (o_orderkey % 3) AS guess, (o_orderkey % 101) / 100 AS confidence, CASE WHEN (o_orderkey * 7 % 100) < (o_orderkey % 101) THEN 'k' || (o_orderkey % 3) ELSE 'no' END AS truth FROM orders)"


@query(
    f"""WITH {PAIRS_SQL}, b AS (SELECT least(floor(confidence * 10), 9) AS bin, count(*) AS n, sum(confidence) AS c, count(*) FILTER (guess = truth) AS r, count(*) FILTER (confidence >= 0.9) AS cov, count(*) FILTER (confidence >= 0.9 AND guess = truth) AS hit FROM pr GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(r) / sum(n), 3) AS accuracy, round(sum(cov) / sum(n), 3) AS coverage, round(sum(hit) / sum(cov), 3) AS precision, round(sum(abs(c - r)) / sum(n), 3) AS calibration_error FROM b"""
)
def eval_metrics(spark, folder):
    return naive_bayes.metrics(_pairs(spark, folder), 0.9)


@query(
    f"""WITH {PAIRS_SQL}, t AS (SELECT x / 100 AS t, count(*) FILTER (confidence >= x / 100) AS covered, count(*) FILTER (confidence >= x / 100 AND guess = truth) AS hit FROM range(50, 100) r(x) CROSS JOIN pr GROUP BY ALL)
SELECT min(t) AS threshold FROM t WHERE covered >= 30 AND hit / covered >= 0.95"""
)
def threshold_search(spark, folder):
    return spark.createDataFrame([(naive_bayes.threshold(_pairs(spark, folder)),)], "threshold double")


@query(f"WITH {ad.TX_SQL}, {EX_SQL}, o AS (SELECT *, row_number() OVER (ORDER BY day, id) AS n, count(*) OVER () AS c FROM ex) SELECT id, n > CAST(floor(c * 0.8) AS BIGINT) AS later FROM o")
def time_split(spark, folder):
    return naive_bayes.later_period(_examples(spark, folder)).select("id", "later")


@query(f"WITH {ad.TX_SQL}, {EX_SQL} SELECT label, count(*) AS examples, count(DISTINCT merchant) AS merchants, count(DISTINCT merchant) < 20 AS barely_learned FROM ex GROUP BY label")
def class_summary(spark, folder):
    return views.class_summary(_examples(spark, folder))


OUT_OF_FOLD_SQL = f"""WITH {ad.TX_SQL}, {EX_SQL},
ef AS (SELECT *, list_sum(list_transform(string_split(sha1(features[1]), ''), lambda d: instr('0123456789abcdef', d) - 1))::INTEGER % 5 AS fold FROM ex),
tr AS (SELECT h, ef.* FROM ef, range(5) r(h) WHERE fold <> h), fe AS (SELECT h, label, weight, unnest(features) AS feature FROM tr),
fs AS (SELECT h, label, feature, sum(weight) AS weight FROM fe GROUP BY ALL), cl AS (SELECT h, label, sum(weight) AS prior FROM tr GROUP BY ALL), ct AS (SELECT h, label, sum(weight) AS total FROM fe GROUP BY ALL),
v AS (SELECT h, count(DISTINCT feature) AS v FROM fe GROUP BY h), w AS (SELECT h, sum(prior) AS w, count(*) AS k FROM cl GROUP BY h),
kn AS (SELECT q.* FROM (SELECT id, fold AS h, unnest(features) AS feature FROM ef) q SEMI JOIN fs ON q.h = fs.h AND q.feature = fs.feature),
sc AS (SELECT i.id, i.truth, cl.label, ln((prior + 1) / (w + k)) + coalesce(sum(CASE WHEN kn.feature IS NOT NULL THEN ln((coalesce(fs.weight, 0) + 0.5) / (total + 0.5 * (v + 1))) END), 0) AS s
  FROM (SELECT id, fold AS h, label AS truth FROM ef) i JOIN cl ON cl.h = i.h JOIN ct ON ct.h = i.h AND ct.label = cl.label JOIN v ON v.h = i.h JOIN w ON w.h = i.h LEFT JOIN kn ON kn.id = i.id
  LEFT JOIN fs ON fs.h = i.h AND fs.label = cl.label AND fs.feature = kn.feature GROUP BY i.id, i.truth, cl.label, prior, w, k),
p AS (SELECT id, truth, label, exp(s - max_s) / sum(exp(s - max_s)) OVER (PARTITION BY id) AS posterior FROM (SELECT *, max(s) OVER (PARTITION BY id) AS max_s FROM sc))
SELECT id, truth, label AS guess, round(posterior, 6) AS posterior FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(posterior, 9) DESC, label) = 1"""


@query(OUT_OF_FOLD_SQL)
def out_of_fold_guesses(spark, folder):
    found = naive_bayes.out_of_fold(_examples(spark, folder), ["k0", "k1", "k2"])
    return found.select("id", "truth", "guess", F.round("posterior", 6).alias("posterior"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY ALL")
def event_tiles(spark, folder):
    e = ad.events(spark, folder)
    return replay.tiles(e).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", real("total"))


# More of the log, the days and the sources


ANCHOR_SQL = """SELECT day, zone, CASE WHEN noon >= lo AND noon < hi THEN noon WHEN lo < hi THEN make_timestamp((epoch_us(lo) + epoch_us(hi)) // 2) END AS at FROM (
SELECT day, zone, greatest(b, u) AS lo, least(e, u + INTERVAL 1 DAY) AS hi, noon FROM (SELECT day, zone, CAST(day AS TIMESTAMP) AS u,
  timezone('UTC', timezone(zone, CAST(day AS TIMESTAMP))) AS b, timezone('UTC', timezone(zone, CAST(day AS TIMESTAMP) + INTERVAL 1 DAY)) AS e, timezone('UTC', timezone(zone, CAST(day AS TIMESTAMP) + INTERVAL 12 HOUR)) AS noon
  FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), (VALUES ('UTC'), ('America/New_York'), ('Pacific/Kiritimati'), ('Etc/GMT+12'), ('Asia/Kolkata')) z(zone)))"""


@query(ANCHOR_SQL)
def day_anchor(spark, folder):
    days = ad.table(spark, folder, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    zones = [F.lit(z) for z in ("UTC", "America/New_York", "Pacific/Kiritimati", "Etc/GMT+12", "Asia/Kolkata")]
    rows = days.select("day", F.explode(F.array(*zones)).alias("zone"))
    return rows.select("day", "zone", money.day_anchor(F.col("day"), F.col("zone")).cast("timestamp_ntz").alias("at"))


@query("SELECT event_id, CAST(ts AS DATE) AS utc_day, CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE) AS bank_day FROM events")
def day_bases(spark, folder):
    e, at = ad.table(spark, folder, "events"), F.col("ts").cast("timestamp")
    return e.select("event_id", money.epoch_day(F.unix_seconds(at)).alias("utc_day"), money.day_in(at, "America/New_York", F.lit(None).cast("date")).alias("bank_day"))


@query(
    """SELECT c_custkey AS source_id, CASE WHEN c_custkey % 7 = 0 THEN 'not mapped' WHEN c_custkey % 11 = 0 THEN 'skipped' WHEN c_custkey % 13 = 0 THEN 'currency is missing' WHEN c_custkey % 17 = 0 THEN 'not a currency'
  WHEN c_custkey % 19 = 0 THEN 'liability' WHEN c_custkey % 23 = 0 THEN 'no such account' WHEN c_custkey % 29 = 0 THEN 'inactive' WHEN c_custkey % 31 = 0 THEN 'currency differs' END AS code, CASE WHEN c_custkey % 3 = 0 THEN 'balance is old' END AS warning FROM customer"""
)
def account_states(spark, folder):
    k, c = F.col("c_custkey"), ad.table(spark, folder, "customer")
    day = F.lit("2024-01-10").cast("date")
    sources = c.select(k.alias("source_id"), F.when(k % 13 == 0, "").when(k % 17 == 0, "https://unit").otherwise("USD").alias("currency"), F.lit(0).alias("balance"), F.when(k % 3 == 0, F.date_sub(day, 4)).otherwise(day).alias("balance_day"), day.alias("as_of"))
    mapping = c.where("c_custkey % 7 <> 0").select(k.alias("source_id"), F.when(k % 11 == 0, "exclude").otherwise("sync").alias("action"), F.lit(True).alias("local_sync"), k.alias("account_id"), F.when(k % 19 == 0, "l").alias("liability_id"), F.lit(None).cast("string").alias("source_scope"))
    accounts = c.where("c_custkey % 23 <> 0").select(k.alias("account_id"), F.lit("CASH").alias("account_kind"), F.when(k % 31 == 0, "EUR").otherwise("USD").alias("account_currency"), (k % 29 != 0).alias("is_active"))
    return validation.account_states(sources, mapping, accounts).select("source_id", "code", "warning")


@query(
    """WITH p AS (SELECT CAST(l_suppkey AS VARCHAR) AS source_id, CASE WHEN l_orderkey % 41 <> 0 THEN l_orderkey || '-' || l_linenumber END AS txn_id, l_linenumber = 7 AS pending, CASE WHEN l_partkey % 37 = 0 THEN 'NaN' ELSE CAST(l_partkey AS VARCHAR) END AS amount, l_orderkey % 43 AS posted FROM lineitem),
q AS (SELECT * FROM p WHERE NOT pending) SELECT code, count(*) AS n FROM (SELECT 'transaction without id' AS code FROM q WHERE txn_id IS NULL UNION ALL SELECT 'amount is not finite' FROM q WHERE amount = 'NaN' UNION ALL SELECT 'no valid date' FROM q WHERE posted = 0
UNION ALL SELECT 'conflicting versions' FROM q WHERE txn_id IS NOT NULL GROUP BY source_id, txn_id HAVING count(DISTINCT (amount, posted)) > 1) GROUP BY code"""
)
def payload_problems(spark, folder):
    n = F.col("l_orderkey")
    rows = ad.table(spark, folder, "lineitem").select(F.col("l_suppkey").cast("string").alias("source_id"), F.when(n % 41 != 0, F.concat_ws("-", n, "l_linenumber")).alias("txn_id"), (F.col("l_linenumber") == 7).alias("pending"), F.when(F.col("l_partkey") % 37 == 0, "NaN").otherwise(F.col("l_partkey").cast("string")).alias("amount"), (n % 43).cast("string").alias("posted"), F.lit("d").alias("description"))
    return validation.payload_problems(rows).groupBy("code").agg(F.count("*").alias("n"))


@query(f"WITH {ad.LOG_SQL}, m AS (SELECT arg_max(action, seq) AS action FROM alive WHERE author = 'u1') SELECT (SELECT max(seq) FROM lg) + row_number() OVER (ORDER BY seq) AS seq, seq AS reverts FROM alive WHERE author = 'u1' AND action = (SELECT action FROM m)")
def undo_entries(spark, folder):
    log = ad.decision_log(spark, folder)
    top = log.agg(F.max("seq")).first()[0] or 0
    return decisions.undone(log, "u1").where(F.col("seq") > top).select("seq", "reverts")


@query(
    f"""WITH {ad.LOG_SQL}, {ad.ROWS_SQL}, k AS (SELECT DISTINCT merchant FROM cr WHERE merchant = 'M3'), last AS (SELECT * FROM alive WHERE source = 'merchant' QUALIFY row_number() OVER (PARTITION BY merchant ORDER BY seq DESC) = 1)
SELECT k.merchant, 'new' AS value, (SELECT max(seq) FROM lg) + 1 AS seq FROM k LEFT JOIN last USING (merchant) WHERE last.value IS DISTINCT FROM 'new'"""
)
def label_merchant(spark, folder):
    log = ad.decision_log(spark, folder)
    top = log.agg(F.max("seq")).first()[0] or 0
    found = decisions.labelled(log, ad.labelled_rows(spark, folder), "new", "u1", "act", merchant="M3")
    return found.where(F.col("seq") > top).select("merchant", "value", "seq")


@query(
    f"""WITH {ad.LOG_SQL}, {ad.ROWS_SQL}, last AS (SELECT * FROM alive WHERE source = 'user' QUALIFY row_number() OVER (PARTITION BY activity_id ORDER BY seq DESC) = 1),
i AS (SELECT id, k, guess, guess_confidence, CASE WHEN k % 2 = 0 THEN guess ELSE 'mine' END AS value FROM cr WHERE k % 10 = 0)
SELECT id AS activity_id, i.value, CASE WHEN i.value = guess THEN guess_confidence END AS confidence FROM i LEFT JOIN last ON last.activity_id = id WHERE last.seq IS NULL OR last.value IS DISTINCT FROM i.value OR last.blind IS NOT NULL"""
)
def accept_predictions(spark, folder):
    log, rows = ad.decision_log(spark, folder), ad.labelled_rows(spark, folder)
    top = log.agg(F.max("seq")).first()[0] or 0
    items = rows.where("ord % 10 = 0").select("id", F.when(F.col("ord") % 2 == 0, F.col("guess")).otherwise("mine").alias("value"))
    return decisions.accepted(log, rows, items, "u1", "act").where(F.col("seq") > top).select("activity_id", "value", "confidence")


@query(f"WITH {ad.TX_SQL} SELECT r.id, count(*) FILTER (m.rule_id IS NOT NULL) AS rows FROM (VALUES ('r1'), ('r2'), ('r3'), ('r4'), ('r5'), ('r7')) r(id) LEFT JOIN (SELECT {RULE_SQL} AS rule_id FROM tx) m ON m.rule_id = r.id GROUP BY r.id")
def rule_match_counts(spark, folder):
    listed = spark.createDataFrame([(r["id"],) for r in RULES if r["category_id"] and r["match"] != "other"], "id string")
    return rules.match_counts(_matched(spark, folder), listed)


@query(f"WITH {ad.TX_SQL} SELECT DISTINCT key, id FROM (SELECT 'SMALL RING' AS key, id FROM tx WHERE merchant = 'SMALL RING' OR regexp_matches(description, '(?i)small[^a-z]+ring') UNION ALL SELECT 'BANK', id FROM tx WHERE merchant = 'BANK' OR regexp_matches(description, '(?i)^bank'))")
def descriptions_matching(spark, folder):
    rows = ad.transactions(spark, folder).select("id", "merchant", F.col("description").alias("notes"))
    wanted = spark.createDataFrame([("SMALL RING", "(?i)small[^a-z]+ring"), ("BANK", "(?i)^bank")], "key string, pattern string")
    return rules.descriptions_matching(rows, wanted)


@query("SELECT user_id, event_id, CAST(value AS DECIMAL(18,2))::DOUBLE AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def newest_answers(spark, folder):
    rows = ad.events(spark, folder).select("user_id", "event_id", "value", F.col("ts").alias("at"), F.col("event_id").alias("ord"))
    return proposals.newest(rows, "user_id").select("user_id", "event_id", real("value"))


@query("WITH k AS (SELECT user_id, max(CAST(ts AS DATE)) AS d FROM events WHERE event_type = 'view' GROUP BY user_id) SELECT event_id FROM events LEFT JOIN k USING (user_id) WHERE event_type = 'purchase' AND (d IS NULL OR CAST(ts AS DATE) >= d)")
def newer_observations(spark, folder):
    e = ad.table(spark, folder, "events").select("event_id", F.col("user_id").alias("account_id"), "event_type", F.to_date("ts").alias("day"))
    return sinks.newer_kept(e.where("event_type = 'purchase'").drop("event_type"), e.where("event_type = 'view'").select("account_id", "day")).select("event_id")


@query(
    f"""WITH {ad.TX_SQL}, {MR_SQL}, s AS (SELECT c, count(*) AS n, min(id) AS o FROM mr WHERE merchant = 'SMALL RING' AND c IS NOT NULL GROUP BY c),
w AS (SELECT DISTINCT unnest(string_split(merchant, ' ')) AS w FROM mr WHERE merchant = 'SMALL RING'), o AS (SELECT DISTINCT id, c FROM (SELECT id, c, unnest(string_split(merchant, ' ')) AS w FROM mr WHERE merchant <> 'SMALL RING') JOIN w USING (w)), v AS (SELECT c, count(*) AS n, min(id) AS o FROM o WHERE c IS NOT NULL GROUP BY c)
SELECT c AS category_id, why FROM (SELECT * FROM (SELECT c, 1 AS way, 'already used on this merchant' AS why FROM s ORDER BY n DESC, o LIMIT 1) UNION ALL SELECT * FROM (SELECT c, 3, 'most used on merchants with the same words' FROM v ORDER BY n DESC, o LIMIT 1) UNION ALL SELECT 'n0', 4, 'first category') ORDER BY way LIMIT 1"""
)
def suggest_category(spark, folder):
    n = F.col("n_nationkey")
    categories = ad.table(spark, folder, "nation").select(F.concat(F.lit("n"), n).alias("category_id"), F.lit(None).cast("string").alias("parent_id"), n.alias("sort_order"))
    none = spark.createDataFrame([], "merchant string, category_id string")
    return proposals.suggested(_merchant_rows(spark, folder), "SMALL RING", none, categories)


@query(None)
def calibration(spark, folder):
    slope, intercept = naive_bayes.fit_calibration(_pairs(spark, folder).select(F.col("confidence").alias("posterior"), (F.col("guess") == F.col("truth")).alias("correct")))
    return spark.createDataFrame([(slope, intercept)], "slope double, intercept double")


@query(None)
def prediction_reasons(spark, folder):
    rows = _examples(spark, folder)
    model = naive_bayes.fit(rows.where("id % 5 <> 0"), ["k0", "k1", "k2"])
    return naive_bayes.reasons(rows, model, naive_bayes.scores(rows, model)).select("id", F.to_json("reasons").alias("reasons"))


# Actions: what they write, and how they are taken back


def _choices(spark, folder) -> DataFrame:
    keys = _merchant_rows(spark, folder).where("merchant <> '' and length(merchant) % 2 = 0").select("merchant").distinct()
    return keys.select("merchant", F.concat(F.lit("c"), (F.length("merchant") + 1) % 4).alias("category_id"), F.lit(None).cast("string").alias("note"))


def _known_rules(spark, folder) -> DataFrame:
    own = _choices(spark, folder).where("length(merchant) % 3 = 0")
    return own.select(actions.rule_of("rules", F.col("merchant")).alias("rule_id"), F.to_json(F.struct("merchant")).alias("rule"))


CHOICES_SQL = "ch AS (SELECT DISTINCT merchant, 'c' || ((length(merchant) + 1) % 4) AS category_id FROM mr WHERE merchant <> '' AND length(merchant) % 2 = 0)"


@query(f"WITH {ad.TX_SQL}, {MR_SQL}, {CHOICES_SQL} SELECT merchant, category_id AS value, count(*) FILTER (c IS NULL) AS filled, count(*) FILTER (c <> category_id) AS kept, length(merchant) % 3 = 0 AS replaced FROM ch JOIN mr USING (merchant) GROUP BY ALL")
def categorise_keys(spark, folder):
    entries, _ = actions.categorised_keys(_choices(spark, folder), _merchant_rows(spark, folder), _known_rules(spark, folder), "me", "act")
    return entries.select("merchant", "value", "filled", "kept", F.col("previous_rule").isNotNull().alias("replaced"))


@query(f"WITH {ad.TX_SQL}, {MR_SQL}, {CHOICES_SQL} SELECT id, category_id AS value FROM mr JOIN ch USING (merchant) WHERE c IS NULL")
def categorise_keys_fills(spark, folder):
    return actions.categorised_keys(_choices(spark, folder), _merchant_rows(spark, folder), _known_rules(spark, folder), "me", "act")[1].select("id", "value")


@query(f"WITH {ad.TX_SQL}, {MR_SQL} SELECT CAST(id AS BIGINT) AS activity_id, 'c9' AS value, c AS was FROM mr WHERE id % 3 = 0")
def categorise_rows(spark, folder):
    rows = _merchant_rows(spark, folder)
    choices = rows.where("id % 3 = 0").select("id", F.lit("c9").alias("category_id"))
    entries, before = actions.categorised_rows(choices, rows, "me", "act")
    return entries.join(before.select(F.col("id").alias("activity_id"), "was"), "activity_id").select("activity_id", "value", "was")


@query(f"WITH {ad.TX_SQL}, {MR_SQL}, b AS (SELECT id, 'c1' AS value, CASE WHEN id % 5 = 0 THEN 'c2' END AS was, c FROM mr WHERE id % 2 = 0) SELECT id, CASE WHEN was IS NULL THEN 'clear' ELSE 'assign' END AS operation, was AS category_id FROM b WHERE was IS NOT NULL OR c = 'c1'")
def undo_row_inverses(spark, folder):
    rows = _merchant_rows(spark, folder)
    before = rows.where("id % 2 = 0").select("id", F.lit("c1").alias("value"), F.when(F.col("id") % 5 == 0, "c2").alias("was"))
    return actions.row_inverses(before, rows)


@query("SELECT CAST(p_partkey AS VARCHAR) AS rule_id, CASE WHEN p_partkey % 4 = 0 THEN 'delete' ELSE 'restore' END AS operation, CASE WHEN p_partkey % 4 <> 0 THEN p_name END AS rule FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 4 <> 0")
def undo_rule_inverses(spark, folder):
    k = F.col("p_partkey")
    entries = ad.table(spark, folder, "part").select(F.when(k % 3 == 0, "rule-removed").otherwise("category").alias("field"), k.cast("string").alias("rule_id"), F.when(k % 4 != 0, F.col("p_name")).alias("previous_rule"))
    return actions.rule_inverses(entries)


@query("SELECT CAST(p_partkey AS VARCHAR) AS rule_id, p_name AS previous_rule FROM part WHERE p_size < 10")
def removed_rules(spark, folder):
    p = ad.table(spark, folder, "part").select(F.col("p_partkey").cast("string").alias("rule_id"), F.col("p_name").alias("rule"), "p_size")
    return actions.rules_removed(p.drop("p_size"), p.where("p_size < 10"), "me", "act")[1].select("rule_id", "previous_rule")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 5 = 0")
def setup_inserts(spark, folder):
    c = ad.table(spark, folder, "customer").select(F.col("c_custkey").alias("id"))
    return actions.found_or_created(c.where("id % 5 = 0"), c.where("id % 3 = 0"), ["id"])


@query("SELECT min(CAST(o_orderdate AS DATE)) AS first_day FROM orders")
def first_day(spark, folder):
    return actions.first_day(ad.table(spark, folder, "orders").select(F.to_date("o_orderdate").alias("day")))


@query("SELECT CAST(p_partkey AS VARCHAR) AS merchant, row_number() OVER (ORDER BY p_size < 5 DESC, sha1(CAST(p_partkey AS VARCHAR))) - 1 AS place FROM part QUALIFY place < 100")
def asking_order(spark, folder):
    p = ad.table(spark, folder, "part").select(F.col("p_partkey").cast("string").alias("merchant"), F.when(F.col("p_size") < 5, "manual").otherwise("rule").alias("source"))
    first = actions.asking_order(p).select("merchant").limit(100)  # the order itself, of a page
    return first.select("merchant", F.monotonically_increasing_id().alias("place"))


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS place FROM events QUALIFY place < 200")
def posted_order(spark, folder):
    e = ad.table(spark, folder, "events").select("event_id", F.col("ts").alias("posted"), F.col("event_id").alias("position"))
    return actions.in_posted_order(e).limit(200).select("event_id", F.monotonically_increasing_id().alias("place"))


@query("SELECT CAST(l_suppkey AS VARCHAR) AS source_id, count(*) AS positions, count(*) FILTER (l_discount = 0) AS missing_basis FROM lineitem GROUP BY ALL")
def missing_basis(spark, folder):
    rows = ad.table(spark, folder, "lineitem").select(F.col("l_suppkey").cast("string").alias("source_id"), F.when(F.col("l_discount") != 0, F.col("l_extendedprice")).alias("average_cost"))
    return actions.without_basis(rows)


@query(
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 4 <> 0 AND c_acctbal >= 0 THEN 'HOLDINGS' ELSE 'TRANSACTIONS' END AS mode, c_custkey % 4 <> 0 AND c_acctbal < 0 AS rolled_back FROM customer"""
)
def switched_modes(spark, folder):
    c = ad.table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    staged = c.where("id % 4 <> 0").select("id", F.lit("HOLDINGS").alias("mode"), F.col("c_acctbal").alias("seen"))
    return actions.switched(c.select("id", F.lit("TRANSACTIONS").alias("mode")), staged, lambda joined: F.col("s.seen") >= 0)


@query(
    f"""WITH {ad.RESOLVED_SQL} SELECT id, day, amount, account, merchant, array_to_string(category_ids, ', ') AS category, label, label_source,
  CASE label_source WHEN 'merchant' THEN 'all of the merchant' WHEN 'user' THEN 'this row' WHEN 'app-ui' THEN 'set in the app' WHEN 'account' THEN 'account default' WHEN 'cardmember' THEN 'cardmember on statement'
    WHEN 'model' THEN 'model ' || CAST(CAST(round(label_confidence * 100) AS INTEGER) AS VARCHAR) || '%' END AS label_said, guess FROM res"""
)
def row_views(spark, folder):
    found = actions.row_views(_resolved(spark, folder))
    return found.select("id", "day", "amount", "account", "merchant", "category", "label", "label_source", "label_said", "guess")


@query(f"WITH {ad.RESOLVED_SQL} SELECT (SELECT count(DISTINCT name) FROM res WHERE {ad.UNDONE_SQL}) AS groups, (SELECT count(*) FROM res WHERE {ad.UNDONE_SQL}) AS rows, (SELECT round(sum(abs(amount)), 2) FROM res WHERE {ad.UNDONE_SQL}) AS amount, (SELECT count(*) FROM res) AS total")
def queue_counts(spark, folder):
    return actions.queue_counts(_resolved(spark, folder))


@query(
    f"""WITH {ad.RESOLVED_SQL}, m AS (SELECT *, {ad.UNDONE_SQL} AS todo FROM res), g AS (SELECT name, guess, count(*) AS n FROM m WHERE todo GROUP BY ALL), t AS (SELECT name, guess AS predicted FROM g QUALIFY row_number() OVER (PARTITION BY name ORDER BY n DESC, guess DESC) = 1)
SELECT name, count(*) FILTER (todo) AS rows, count(*) FILTER (todo AND label IS NULL) AS missing_label, count(*) FILTER (todo AND len(category_ids) = 0) AS missing_category, count(*) FILTER (NOT todo) AS elsewhere,
  round(sum(abs(amount)) FILTER (todo), 2) AS total, greatest(count(*) FILTER (todo) - 60, 0) AS more, any_value(predicted) AS predicted FROM m JOIN t USING (name) GROUP BY name"""
)
def card_summaries(spark, folder):
    return actions.card_summary(_resolved(spark, folder)).drop("keys")


@query(
    f"""WITH {ad.RESOLVED_SQL}, p AS (SELECT guess, guess_confidence AS confidence, label AS truth, label_source IN ('user', 'app-ui', 'merchant') AS hand, label_source = 'cardmember' AS card, held_out, k % 5 = 0 AS later FROM res WHERE label IS NOT NULL),
s AS (SELECT 'labels' AS slice, * FROM p WHERE hand AND NOT held_out UNION ALL SELECT 'cardmember', * FROM p WHERE card UNION ALL SELECT 'later', * FROM p WHERE hand AND later UNION ALL SELECT 'check', * FROM p WHERE hand AND held_out),
b AS (SELECT slice, least(floor(confidence * 10), 9) AS bin, count(*) AS n, sum(confidence) AS c, count(*) FILTER (guess = truth) AS r, count(*) FILTER (confidence >= 0.8) AS cov, count(*) FILTER (confidence >= 0.8 AND guess = truth) AS hit FROM s GROUP BY ALL)
SELECT slice, CAST(sum(n) AS BIGINT) AS n, round(sum(r) / sum(n), 3) AS accuracy, round(sum(cov) / sum(n), 3) AS coverage, round(sum(hit) / sum(cov), 3) AS precision, round(sum(abs(c - r)) / sum(n), 3) AS calibration_error FROM (VALUES ('labels'), ('cardmember'), ('later'), ('check')) v(slice) LEFT JOIN b USING (slice) GROUP BY slice"""
)
def evaluation_slices(spark, folder):
    rows = _resolved(spark, folder).withColumn("later", F.col("ord") % 5 == 0)
    return actions.evaluation(actions.label_slices(rows), 0.8)


@query(
    """WITH x AS (SELECT CAST(user_id AS VARCHAR) AS name, event_id, CASE WHEN user_id % 3 = 0 THEN event_type END AS payee, CASE WHEN user_id % 2 = 0 THEN 'x' || event_type END AS export FROM events),
p AS (SELECT name, payee FROM x WHERE payee IS NOT NULL GROUP BY name, payee QUALIFY row_number() OVER (PARTITION BY name ORDER BY count(*) DESC, min(event_id)) = 1), e AS (SELECT name, export FROM x WHERE export IS NOT NULL GROUP BY name, export QUALIFY row_number() OVER (PARTITION BY name ORDER BY count(*) DESC, min(event_id)) = 1)
SELECT n.name, coalesce(payee, export, n.name) AS suggestion FROM (SELECT DISTINCT name FROM x) n LEFT JOIN p USING (name) LEFT JOIN e USING (name)"""
)
def suggested_names(spark, folder):
    u = F.col("user_id")
    rows = ad.table(spark, folder, "events").select(u.cast("string").alias("name"), F.col("event_id").alias("ord"), F.when(u % 3 == 0, F.col("event_type")).alias("payee"), F.when(u % 2 == 0, F.concat(F.lit("x"), "event_type")).alias("export_name"))
    return actions.suggested_name(rows)


@query(f"WITH {ad.TX_SQL}, {ad.LOG_SQL}, l AS (SELECT * FROM alive WHERE merchant IS NOT NULL QUALIFY row_number() OVER (PARTITION BY merchant ORDER BY seq DESC) = 1), k AS (SELECT DISTINCT 'M' || (account_id % 40) AS merchant, {RULE_SQL} AS rule_id FROM tx WHERE account_id = 7) SELECT r.id, r.c AS sets FROM (VALUES ('r1', 'c1'), ('r2', 'c2'), ('r7', 'c7')) r(id, c) WHERE id IN (SELECT rule_id FROM k) UNION ALL SELECT 'spender:' || seq, value FROM l WHERE value IS NOT NULL AND merchant IN (SELECT merchant FROM k)")
def rules_of_a_card(spark, folder):
    card = _matched(spark, folder).where("account_id = 7").select(F.concat(F.lit("M"), F.col("account_id") % 40).alias("merchant"), "rule_id")
    return actions.card_rules(rules_list_union(spark, folder), card).select("id", "sets")


@query(f"WITH {ad.LOG_SQL} SELECT seq AS reverts FROM alive WHERE merchant IS NOT NULL AND seq % 3 = 0")
def labels_withdrawn(spark, folder):
    log = ad.decision_log(spark, folder)
    top = log.agg(F.max("seq")).first()[0] or 0
    return actions.labels_removed(log, log.where("seq % 3 = 0").select("seq"), "me").where(F.col("seq") > top).select("reverts")


ROLL_SQL = """WITH st AS (SELECT p_partkey AS k, 10.0::DOUBLE AS old, (100 + p_size)::DOUBLE AS basis, CASE WHEN p_partkey % 4 = 0 THEN 8.0 ELSE 12.0 END::DOUBLE AS new FROM part),
fl AS (SELECT l_partkey AS k, CAST(l_shipdate AS DATE) AS day, CASE WHEN l_linenumber = 7 THEN -1.0 ELSE l_quantity END::DOUBLE AS amount, CASE WHEN l_linenumber <= 2 THEN 1.0 WHEN l_linenumber <= 4 THEN 0.0 END::DOUBLE AS share FROM lineitem WHERE l_linenumber IN (1, 3, 7)),
f AS (SELECT k, sum(greatest(amount * share, 0)) AS bought, count(*) FILTER (amount * share <> 0) AS parts, min(day) FILTER (amount * share <> 0) AS since, coalesce(bool_or(share IS NULL AND amount > 0), false) AS ub, coalesce(bool_or(share IS NULL AND amount < 0), false) AS us FROM fl GROUP BY k),
q AS (SELECT l_partkey AS k, min(round(l_extendedprice / 4000, 2)) AS low, max(round(l_extendedprice / 4000, 2)) AS high FROM lineitem JOIN f ON f.k = l_partkey WHERE CAST(l_shipdate AS DATE) >= since GROUP BY ALL),
j AS (SELECT st.*, coalesce(bought, 0) AS bought, coalesce(parts, 0) * 0.005 AS slack, coalesce(ub, false) AS ub, coalesce(us, false) AS us, low, high, new - old AS change FROM st LEFT JOIN f USING (k) LEFT JOIN q USING (k))
SELECT CAST(k AS VARCHAR) AS asset_id, round(CASE WHEN ub THEN NULL WHEN change < 0 AND bought = 0 THEN basis / old
  WHEN change > 0 AND bought > 0 AND NOT us AND bought + slack >= greatest(change - 1, 1) * low AND bought - slack <= (change + 1) * high THEN (basis + bought) / new END, 6) AS rolled_cost FROM j"""


@query(ROLL_SQL)
def rolled_cost(spark, folder):
    li, k = ad.table(spark, folder, "lineitem"), F.col("l_partkey").cast("string")
    exact = lambda x, name: F.lit(x).cast(money.MONEY).alias(name) if not isinstance(x, F.Column) else x.cast(money.MONEY).alias(name)
    p = ad.table(spark, folder, "part")
    steps = p.select(F.col("p_partkey").cast("string").alias("asset_id"), F.col("p_partkey").cast("string").alias("source_id"), F.lit("n").alias("name_key"), F.lit("1900-01-01").cast("date").alias("start"), F.lit("2100-01-01").cast("date").alias("end"), exact(10, "old_quantity"), exact(F.col("p_size") + 100, "old_basis"), exact(F.when(F.col("p_partkey") % 4 == 0, 8).otherwise(12), "quantity"), F.lit(2).alias("settlement_days"))
    rows = li.where("l_linenumber in (1, 3, 7)").select(k.alias("source_id"), F.to_date("l_shipdate").alias("posted_day"), exact(F.when(F.col("l_linenumber") == 7, F.lit(-1.0)).otherwise(F.col("l_quantity")), "amount"), F.col("l_linenumber").cast("string").alias("description"), F.lit(False).alias("pending"))
    shares = p.select(F.col("p_partkey").cast("string").alias("source_id"), F.explode(F.array(F.lit("1"), F.lit("3"))).alias("description"), F.lit("n").alias("name_key")).withColumn("share", F.when(F.col("description") == "1", 1).otherwise(0).cast(money.MONEY))
    quotes = li.select(k.alias("asset_id"), F.to_date("l_shipdate").alias("day"), exact(F.round(F.col("l_extendedprice") / 4000, 2), "price"))
    found = holdings.rolled_forward(steps, rows, shares, quotes)
    return found.select("asset_id", F.round(F.col("rolled_cost").cast("double"), 6).alias("rolled_cost"))


@query(
    f"""WITH {ad.TX_SQL}, r AS (SELECT 'r' || p_partkey AS id, p_partkey AS k, p_name AS name, p_brand AS brand FROM part),
t AS (SELECT id AS row_id, account_id, kind, abs(amount) AS size, description, upper(description) AS up FROM tx),
m AS (SELECT row_id, r.id, r.k FROM t, r WHERE (r.k % 3 <> 0 OR account_id = r.k) AND (r.k % 5 <> 0 OR size > 50000) AND CASE r.k % 4 WHEN 0 THEN contains(up, upper(r.name)) WHEN 1 THEN starts_with(up, upper('sq *' || r.name))
    WHEN 2 THEN up = upper('POS 12 ' || r.name || ' ' || r.brand) ELSE regexp_matches(description, '^(?:SQ \\*|POS [0-9]+ )?' || r.name || '.*') END
  UNION ALL SELECT row_id, 'short', 1000000 FROM t WHERE regexp_matches(description, 'b.[a-z]k') UNION ALL SELECT row_id, 'one', 1000001 FROM t WHERE kind = 'DEPOSIT' AND contains(up, 'E'))
SELECT t.row_id AS id, rule_id FROM t LEFT JOIN (SELECT row_id, id AS rule_id FROM m QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY k % 7 DESC, k) = 1) USING (row_id)"""
)
def rule_index_match(spark, folder):
    """A rule for every part, and two without a literal, against all transactions: found by index, no list on the driver."""
    k, m = F.col("p_partkey"), F.col("p_partkey") % 4
    kinds = F.when(m == 0, "contains").when(m == 1, "starts_with").when(m == 2, "exact").otherwise("regex")
    pattern = F.when(m == 0, F.col("p_name")).when(m == 1, F.concat(F.lit("sq *"), "p_name")).when(m == 2, F.concat(F.lit("POS 12 "), "p_name", F.lit(" "), "p_brand")).otherwise(F.concat(F.lit(r"^(?:SQ \*|POS [0-9]+ )?"), "p_name", F.lit(".*")))
    some = lambda test, x: F.when(test, x)
    listed = ad.table(spark, folder, "part").select(F.concat(F.lit("r"), k).alias("id"), k.alias("pos"), kinds.alias("match"), pattern.alias("pattern"), F.lit("c").alias("category_id"), (k % 7).alias("priority"), (k % 3 != 0).alias("is_global"), k.cast("string").alias("account_id"), F.lit(None).cast("string").alias("kind"), some(k % 5 == 0, "gt").alias("amount_op"), some(k % 5 == 0, 50000.0).alias("amount_value"), F.lit(None).cast("double").alias("amount_value2"))
    more = [("short", 1000000, "regex", "b.[a-z]k", "c", 1000000 % 7, True, None, None, None, None, None), ("one", 1000001, "contains", "e", "c", 1000001 % 7, True, None, "DEPOSIT", None, None, None), ("broken", 1, "regex", "(unclosed", "c", 9, True, None, None, None, None, None)]
    listed = listed.unionByName(spark.createDataFrame(more, listed.schema))
    return pattern_index.first_match(ad.transactions(spark, folder).withColumnRenamed("description", "notes"), listed).select("id", "rule_id")


SENT_SQL = """WITH st AS (SELECT p_partkey AS k, CAST(100 + p_size AS DECIMAL(18,6)) AS basis, ['10', '10.000', '10.5', '9.75'][1 + p_partkey % 4] AS old_sent, CASE p_partkey % 5 WHEN 0 THEN '12.000' WHEN 1 THEN '12' WHEN 2 THEN '12.5' WHEN 3 THEN '8.25' ELSE '40.00' END AS new_sent FROM part),
d AS (SELECT *, CAST(old_sent AS DECIMAL(18,6)) AS old, CAST(new_sent AS DECIMAL(18,6)) AS new, greatest(length(split_part(old_sent, '.', 2)), length(split_part(new_sent, '.', 2))) AS places FROM st),
fl AS (SELECT l_partkey AS k, CAST(l_shipdate AS DATE) AS day, CAST(CASE WHEN l_linenumber = 4 THEN -l_quantity / 10000 ELSE l_quantity END AS DECIMAL(18,6)) AS amount, CASE WHEN l_linenumber = 1 THEN CAST(0.75 AS DECIMAL(6,4)) ELSE CAST(1 AS DECIMAL(6,4)) END AS share FROM lineitem WHERE l_linenumber IN (1, 3, 4) AND l_suppkey % 10 = 1),
f AS (SELECT k, sum(greatest(amount * share, 0)) AS bought, sum(greatest(-amount * share, 0)) AS sold, count(*) AS parts, min(day) AS since FROM fl GROUP BY k),
q AS (SELECT l_partkey AS k, CAST(min(round(l_extendedprice / 4000, 2)) AS DECIMAL(18,6)) AS low, CAST(max(round(l_extendedprice / 4000, 2)) AS DECIMAL(18,6)) AS high FROM lineitem JOIN f ON f.k = l_partkey WHERE CAST(l_shipdate AS DATE) >= since GROUP BY ALL),
j AS (SELECT d.*, coalesce(bought, 0)::DOUBLE AS bought, coalesce(sold, 0)::DOUBLE AS sold, coalesce(parts, 0) * 0.005 AS slack, low::DOUBLE AS low, high::DOUBLE AS high, (new - old)::DOUBLE AS change, (basis / old)::DOUBLE AS average, power(10, -places) AS digit FROM d LEFT JOIN f USING (k) LEFT JOIN q USING (k))
SELECT CAST(k AS VARCHAR) AS asset_id, sold > 0 AS has_sold, round(CASE WHEN change < 0 AND bought = 0 THEN average
  WHEN change > 0 AND bought > 0 AND average * (sold / low - sold / high) < 0.005 AND bought + slack >= greatest(change + sold / high - digit, digit) * low AND bought - slack <= (change + sold / low + digit) * high
    THEN (basis::DOUBLE - average * (sold / low + sold / high) / 2 + bought) / new::DOUBLE END, 5) AS rolled_cost FROM j"""


@query(SENT_SQL)
def rolled_cost_as_sent(spark, folder):
    """Roll-forward of quantities as texts, with zeros behind the point, fractions, and sales that have a share."""
    li, p, n = ad.table(spark, folder, "lineitem"), ad.table(spark, folder, "part"), F.col("p_partkey")
    sent = lambda texts, by: F.element_at(F.array(*map(F.lit, texts)), (1 + n % by).cast("int"))
    steps = p.select(n.cast("string").alias("asset_id"), n.cast("string").alias("source_id"), F.lit("n").alias("name_key"), F.lit("1900-01-01").cast("date").alias("start"), F.lit("2100-01-01").cast("date").alias("end"), sent(["10", "10.000", "10.5", "9.75"], 4).alias("old_quantity"), (F.col("p_size") + 100).cast(money.MONEY).alias("old_basis"), sent(["12.000", "12", "12.5", "8.25", "40.00"], 5).alias("quantity"), F.lit(2).alias("settlement_days"))
    key = F.col("l_partkey").cast("string")
    amount = F.when(F.col("l_linenumber") == 4, -F.col("l_quantity") / 10000).otherwise(F.col("l_quantity")).cast(money.MONEY)
    rows = li.where("l_linenumber in (1, 3, 4) and l_suppkey % 10 = 1").select(key.alias("source_id"), F.to_date("l_shipdate").alias("posted_day"), amount.alias("amount"), F.col("l_linenumber").cast("string").alias("description"), F.lit(False).alias("pending"))
    shares = p.select(n.cast("string").alias("source_id"), F.explode(F.array(F.lit("1"), F.lit("3"), F.lit("4"))).alias("description"), F.lit("n").alias("name_key")).withColumn("share", F.when(F.col("description") == "1", "0.75").otherwise("1").cast(money.MONEY))
    quotes = li.select(key.alias("asset_id"), F.to_date("l_shipdate").alias("day"), F.round(F.col("l_extendedprice") / 4000, 2).cast(money.MONEY).alias("price"))
    found = holdings.rolled_forward(steps, rows, shares, quotes)
    sold = holdings.flow_sums(steps, rows, shares).select("asset_id", (F.coalesce("sold", F.lit(0)) > 0).alias("has_sold"))
    return found.join(sold, "asset_id", "left").select("asset_id", F.coalesce("has_sold", F.lit(False)).alias("has_sold"), F.round(F.col("rolled_cost").cast("double"), 5).alias("rolled_cost"))


# The composed sync and its publication


def _world(spark, folder) -> sync.World:
    """Customers are cash and card accounts with the orders as transactions, suppliers are securities accounts; some of all kinds are unfit."""
    day = lambda d: F.lit(d).cast("date")
    k, s, none = F.col("c_custkey"), F.col("s_suppkey"), lambda kind: F.lit(None).cast(kind)
    tx = ad.transactions(spark, folder)
    signed = money.activity_amount(F.col("kind"), F.col("amount"), F.col("account_kind"))
    told = tx.where((F.col("id") % 4 != 0) | (F.col("day") > day("1996-12-31"))).where(F.col("day") <= day("1998-06-30")).groupBy(F.col("account_id").alias("c_custkey")).agg(F.sum(signed).alias("told"))
    customers = ad.table(spark, folder, "customer").join(told, "c_custkey", "left")
    balance = F.when(k % 17 == 0, -F.abs("c_acctbal").cast("decimal(18,2)")).when((k % 2 == 0) & (F.col("c_mktsegment") != "BUILDING"), F.when(k % 8 == 0, 0).otherwise(F.col("c_acctbal").cast("decimal(18,2)")))
    balance = balance.otherwise(F.coalesce("told", F.lit(0)) + F.when(k % 3 == 0, 1).otherwise(0)).cast(money.MONEY)
    positions = _positions(spark, folder).drop("n").withColumn("source_id", F.concat(F.lit("s"), "source_id"))
    value = positions.groupBy("source_id").agg(F.sum("value").alias("balance"))
    name = F.concat(F.lit("s"), s)
    suppliers = ad.table(spark, folder, "supplier").withColumn("source_id", name).join(value, "source_id")
    sources = customers.select(k.cast("string").alias("source_id"), F.lit("USD").alias("currency"), balance.alias("balance"), day("1998-06-30").alias("balance_day"), none("date").alias("balance_utc_day"), F.when(k % 10 == 9, day("1998-07-10")).otherwise(day("1998-07-01")).alias("as_of"))
    sources = sources.unionByName(suppliers.select("source_id", F.lit("USD").alias("currency"), (F.col("balance") + F.when(s % 7 == 0, 1).otherwise(0)).cast(money.MONEY).alias("balance"), day("1998-06-30").alias("balance_day"), none("date").alias("balance_utc_day"), day("1998-07-01").alias("as_of")))
    common = [F.lit(True).alias("local_sync"), F.lit("account").alias("source_scope"), day("1996-12-31").alias("history_through"), F.lit("UTC").alias("zone")]
    mapping = customers.where(k % 11 != 0).select(k.cast("string").alias("source_id"), F.when(k % 13 == 0, "exclude").otherwise("sync").alias("action"), k.cast("string").alias("account_id"), F.when(k % 17 == 0, F.concat(F.lit("l"), k)).alias("liability_id"), *common, k.cast("string").alias("purchase_account"), F.lit(False).alias("per_unit"))
    mapping = mapping.unionByName(suppliers.select("source_id", F.lit("sync").alias("action"), F.col("source_id").alias("account_id"), none("string").alias("liability_id"), *common, none("string").alias("purchase_account"), F.lit(True).alias("per_unit")))
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "CREDIT_CARD").otherwise("CASH")
    by_holdings = F.when(kind == "CASH", k % 2 == 0).otherwise(k % 23 == 0)
    mode = lambda test: F.when(test, "HOLDINGS").otherwise("TRANSACTIONS").alias("mode")
    accounts = customers.select(k.cast("string").alias("account_id"), kind.alias("account_kind"), F.lit("USD").alias("account_currency"), (k % 19 != 0).alias("is_active"), mode(by_holdings))
    accounts = accounts.unionByName(suppliers.select(F.col("source_id").alias("account_id"), F.lit("SECURITIES").alias("account_kind"), F.lit("USD").alias("account_currency"), F.lit(True).alias("is_active"), mode(s % 2 == 0)))
    seen = lambda late: F.when(late, day("1998-07-05")).otherwise(day("1998-06-01")).alias("day")
    snapshots = customers.select(k.cast("string").alias("account_id"), seen(k % 3 == 0), F.lit("MANUAL_ENTRY").alias("kind"), F.lit(5).cast(money.MONEY).alias("cash"))
    snapshots = snapshots.unionByName(suppliers.select(F.col("source_id").alias("account_id"), seen(s % 5 == 0), F.lit("MANUAL_ENTRY").alias("kind"), F.lit(0).cast(money.MONEY).alias("cash")))
    strange = customers.where(k % 29 == 0).select(k.cast("string").alias("source_id"), F.lit("p").alias("position_id"), F.lit("X").alias("symbol"), F.lit("X").alias("description"), *(F.lit(1).cast(money.MONEY).alias(c) for c in ("quantity", "value")), F.lit("USD").alias("currency"), *(none(money.MONEY).alias(c) for c in ("cost_basis", "purchase_price")))
    liabilities = customers.where(k % 17 == 0).select(F.concat(F.lit("l"), k).alias("id"), F.lit(10).cast(money.MONEY).alias("value"), day("1998-06-01").alias("day"), F.lit("USD").alias("currency"))
    tables = (sources, mapping, accounts, _sources(spark, folder)[0], _ledger(spark, folder), positions.unionByName(strange), snapshots, liabilities)
    return sync.World(*(scratch.written(t, "world") for t in tables))


SYNC_SQL = f"""WITH {ad.TX_SQL}, {POS_SQL},
p AS (SELECT *, {OPS_SQL} AS op, 'src:' || account_id || ':' || id AS key FROM tx),
told AS (SELECT account_id, sum({ad.SIGNED_SQL}) FILTER (day <= DATE '1998-06-30') AS told, sum({ad.SIGNED_SQL}) AS all_told FROM tx WHERE id % 4 <> 0 OR day > DATE '1996-12-31' GROUP BY account_id),
c AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS owner, c_mktsegment = 'BUILDING' AS card, c_mktsegment <> 'BUILDING' AND c_custkey % 2 = 0 AS seen, coalesce(told, 0) AS told,
   CASE WHEN c_mktsegment <> 'BUILDING' AND c_custkey % 8 = 0 THEN 0 ELSE CAST(c_acctbal AS DECIMAL(18,2)) END AS observed, abs(CAST(c_acctbal AS DECIMAL(18,2))) AS owed, coalesce(all_told, 0) AS all_told,
   CASE WHEN c_custkey % 11 = 0 THEN 'not mapped' WHEN c_custkey % 13 = 0 THEN 'skipped' WHEN c_custkey % 17 = 0 THEN 'liability' WHEN c_custkey % 19 = 0 THEN 'inactive' END AS code
   FROM customer LEFT JOIN told ON account_id = c_custkey),
bad AS (SELECT k, p.key, op AS detail FROM c JOIN p ON p.account_id = k WHERE code IS NULL AND op LIKE 'error%'
   UNION ALL SELECT k, NULL, 'a card needs transaction tracking' FROM c WHERE code IS NULL AND card AND k % 23 = 0
   UNION ALL SELECT k, NULL, 'a cash account with positions' FROM c WHERE code IS NULL AND NOT card AND k % 29 = 0),
sums AS (SELECT k, NULL AS key, 'does not reconcile' AS detail FROM c WHERE code IS NULL AND NOT card AND NOT seen AND k % 3 = 0 AND k NOT IN (SELECT k FROM bad)),
good AS (SELECT * FROM c WHERE code IS NULL AND k NOT IN (SELECT k FROM bad) AND k NOT IN (SELECT k FROM sums)),
shown AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'newer' WHEN observed = 0 THEN 'zero' ELSE 'ok' END AS what FROM good WHERE seen),
s AS (SELECT l_suppkey AS k, 's' || l_suppkey AS owner, sum(value) AS total, sum(CASE WHEN n % 50 = 0 THEN value ELSE 0 END) AS cash, count(*) FILTER (n % 50 <> 0 AND n % 5 NOT IN (0, 1)) AS uncosted FROM pos GROUP BY l_suppkey),
fine AS (SELECT * FROM s WHERE k % 5 <> 0 AND k % 7 <> 0)
SELECT op AS step, owner, key, day, abs(amount)::DOUBLE AS amount, kind AS detail FROM p JOIN good ON k = p.account_id WHERE op IN ('create', 'update')
UNION ALL SELECT 'snapshot', owner, NULL, DATE '1998-06-30', observed::DOUBLE, 'MANUAL_ENTRY' FROM shown WHERE what = 'ok'
UNION ALL SELECT 'snapshot', owner, NULL, DATE '1998-06-30', cash::DOUBLE, 'MANUAL_ENTRY' FROM fine
UNION ALL SELECT 'position', owner, CAST(n AS VARCHAR), DATE '1998-06-30', quantity::DOUBLE, CASE n % 5 WHEN 0 THEN 'provider' WHEN 1 THEN 'purchase price' END FROM fine JOIN pos ON l_suppkey = k WHERE n % 50 <> 0
UNION ALL SELECT 'quote', owner, CAST(n AS VARCHAR), DATE '1998-06-30', (CAST(value * 100 AS BIGINT) * 10000 // CAST(quantity * 100 AS BIGINT)) / 10000, 'USD' FROM fine JOIN pos ON l_suppkey = k WHERE n % 50 <> 0
UNION ALL SELECT 'mode', owner, NULL, NULL, NULL, 'HOLDINGS' FROM fine WHERE k % 2 = 1
UNION ALL SELECT 'valuation', 'l' || k, NULL, DATE '1998-06-30', owed::DOUBLE, NULL FROM c WHERE code = 'liability'
UNION ALL SELECT 'expected', owner, NULL, NULL, (all_told + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END)::DOUBLE, 'TRANSACTIONS' FROM good WHERE NOT seen
UNION ALL SELECT 'expected', owner, NULL, NULL, observed::DOUBLE, 'HOLDINGS' FROM shown WHERE what = 'ok'
UNION ALL SELECT 'expected', owner, NULL, NULL, total::DOUBLE, 'HOLDINGS' FROM fine
UNION ALL SELECT 'error', CAST(k AS VARCHAR), key, NULL, NULL, detail FROM (SELECT * FROM bad UNION ALL SELECT * FROM sums)
UNION ALL SELECT 'error', owner, NULL, NULL, NULL, code FROM c WHERE code = 'not mapped'
UNION ALL SELECT 'error', owner, NULL, NULL, NULL, 'positions do not add up to the balance' FROM s WHERE k % 5 <> 0 AND k % 7 = 0
UNION ALL SELECT 'warning', owner, NULL, NULL, NULL, 'balance is old' FROM c WHERE k % 10 = 9 AND coalesce(code, '') <> 'skipped'
UNION ALL SELECT 'warning', owner, '1998-07-05', NULL, NULL, 'kept a newer balance' FROM shown WHERE what = 'newer'
UNION ALL SELECT 'warning', owner, '1998-06-01', NULL, NULL, 'an empty balance without a purchase: kept the last one' FROM shown WHERE what = 'zero'
UNION ALL SELECT 'warning', owner, '1998-07-05', NULL, NULL, 'kept newer holdings' FROM s WHERE k % 5 = 0
UNION ALL SELECT 'warning', owner, CAST(uncosted AS VARCHAR), NULL, NULL, 'positions without an acquisition cost' FROM fine WHERE uncosted > 0"""


@query(SYNC_SQL)
def sync_plan(spark, folder):
    """Every row that one payload would write, and all errors and warnings; positions are shown by the provider's number."""
    found = sync.plan(_world(spark, folder)).rows("position_id")
    amount = F.when(F.col("step") == "quote", F.floor(F.col("amount") * 10000) / 10000).otherwise(F.col("amount").cast("double"))
    return found.select("step", "owner", "key", "day", amount.alias("amount"), "detail")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 6 = 0 THEN 'new' ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT -c_custkey - 1, 'new' FROM customer WHERE c_custkey % 10 = 0")
def bucketed_upsert(spark, folder):
    """Customers in a bucketed store after one commit of replaced, new and removed rows."""
    kept = store.Store(spark, scratch.folder(spark, "store"))
    c = ad.table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    changed = c.where("id % 6 = 0").select("id", F.lit("new").alias("segment")).unionByName(c.where("id % 10 = 0").select((-F.col("id") - 1).alias("id"), F.lit("new").alias("segment")))
    with kept.begin() as t:
        t.create("customers", c, ["id"], 16)
    with kept.begin() as t:
        t.upsert("customers", changed, verify=True)
        t.remove("customers", c.where("id % 7 = 0").select("id"))
    return kept.read("customers")


# Stable reads, medians, pages, sums that are kept up


@query(
    """WITH r AS (SELECT c_custkey AS k, n AS attempt, CAST(c_acctbal AS DECIMAL(18,2)) + CASE WHEN (c_custkey + n) % 3 = 0 OR c_custkey % 10 = 0 THEN 1 WHEN n % 2 = 0 THEN 0.004 ELSE 0 END AS total, CAST(c_acctbal AS DECIMAL(18,2)) AS expected
  FROM customer, (SELECT unnest(range(1, 19)) AS n) WHERE n <= 1 + c_custkey % 18), o AS (SELECT *, abs(total - expected) <= 0.005 AS ok FROM r WHERE attempt <= 15),
s AS (SELECT *, ok AND coalesce(lag(ok) OVER (PARTITION BY k ORDER BY attempt), false) AS stable FROM o),
e AS (SELECT k, min(attempt) FILTER (stable) AS first, max(attempt) AS last FROM s GROUP BY k)
SELECT CAST(e.k AS VARCHAR) AS account_id, first IS NOT NULL AS settled, CAST(coalesce(first, last) AS INTEGER) AS attempts, CAST(total AS DOUBLE) AS total FROM e JOIN o ON o.k = e.k AND o.attempt = coalesce(first, last) WHERE first IS NOT NULL OR last >= 15"""
)
def settled_reads(spark, folder):
    c, k, n = ad.table(spark, folder, "customer"), F.col("c_custkey"), F.col("attempt")
    rows = c.select(k, F.col("c_acctbal").cast("decimal(18,2)").alias("expected"), F.explode(F.sequence(F.lit(1), (1 + k % 18).cast("int"))).alias("attempt"))
    off = F.when(((k + n) % 3 == 0) | (k % 10 == 0), F.lit("1")).when(n % 2 == 0, F.lit("0.004")).otherwise(F.lit("0")).cast(money.MONEY)
    return settling.settled(rows.select(k.alias("account_id"), "attempt", "expected", (F.col("expected") + off).alias("total"))).withColumn("total", real("total"))


@query("SELECT l_returnflag AS flag, median(CAST(l_extendedprice AS DOUBLE)) AS median FROM lineitem GROUP BY l_returnflag")
def exact_medians(spark, folder):
    """Three keys, one of which has half of all rows."""
    return selection.medians(ad.table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice"), "flag", "l_extendedprice")


@query(f"WITH {ad.RESOLVED_SQL}, p AS (SELECT id, guess, guess_confidence, row_number() OVER (ORDER BY guess_confidence DESC, k) - 1 AS place FROM res WHERE NOT held_out AND {ad.OPEN_SQL}) SELECT place, id, guess, guess_confidence FROM p WHERE place >= 20 AND place < 30 OR place > 34 AND place <= 44")
def indexed_pages(spark, folder):
    """The third page of ten unlabeled rows, and the ten rows after a cursor, from the same index."""
    rows = _resolved(spark, folder)
    rows = rows.where(~F.col("held_out") & views.unlabeled(rows))
    index = paging.PageIndex(rows.select("id", "ord", "guess", "guess_confidence"), [F.col("guess_confidence").desc(), F.col("ord").asc()], 15)
    return index.page(2, 10).unionByName(index.after(34, 10)).select("place", "id", "guess", "guess_confidence")


@query(
    f"""WITH {ad.TX_SQL}, {EX_SQL}, fin AS (SELECT * FROM ex WHERE id % 11 <> 0), {NB_SQL.format(train="fin")}
SELECT label, feature, round(weight, 4) AS weight, seen FROM fs UNION ALL SELECT label, NULL, round(sum(weight), 4), count(*) FROM fin GROUP BY label"""
)
def nb_sums_kept_up(spark, folder):
    """Sums of earlier examples with what has changed since added and taken away: other labels, new examples, examples that are gone."""
    now, n = _examples(spark, folder).select("id", "features", "label", "weight"), F.col("id")
    before = now.where("id % 3 <> 0").withColumn("label", F.when(n % 7 == 0, "k0").otherwise(F.col("label")))
    changed = (n % 3 == 0) | (n % 7 == 0) | (n % 11 == 0)
    signed = before.where(changed).withColumn("sign", F.lit(-1)).unionByName(now.where(changed & (n % 11 != 0)).withColumn("sign", F.lit(1)))
    total = upkeep.added(upkeep.sums(before), upkeep.sums(signed, F.col("sign")))
    whole = total.groupBy("label", "feature").agg(F.sum("weight").cast("double").alias("weight"), F.sum("seen").alias("seen"))
    return whole.select("label", "feature", F.round("weight", 4).alias("weight"), "seen")


# Row by row: the merge plan, its payloads, problems, costs; cards and explanations


@query(f"WITH {ad.TX_SQL} SELECT CAST(account_id AS VARCHAR) AS source_id, CAST(id AS VARCHAR) AS txn_id, {OPS_SQL} AS op, day, CAST(amount AS DOUBLE) AS amount, kind, CASE WHEN id % 4 <> 0 THEN 'a' || id END AS activity_id FROM tx")
def merge_plan_rows(spark, folder):
    source, mapping = _sources(spark, folder)
    planned = merge_plan.plan(source, mapping, _ledger(spark, folder))
    return planned.select("source_id", "txn_id", "op", "day", real("amount"), F.col("new_kind").alias("kind"), "activity_id")


@query(
    f"""WITH {ad.TX_SQL}, p AS (SELECT *, {OPS_SQL} AS op FROM tx) SELECT op, CASE WHEN op = 'update' THEN 'a' || id END AS id, CAST(account_id AS VARCHAR) AS account_id, kind, day, CAST(abs(amount) AS DOUBLE) AS amount, description AS comment,
  'src:' || account_id || ':' || id AS key, '{{"source":{{"amount":"' || amount || '","date":"' || day || '","description":"' || description || '"}},"flow":{{"is_external":' || (kind IN ('TRANSFER_IN', 'TRANSFER_OUT')) || '}}}}' AS metadata FROM p WHERE op IN ('create', 'update')"""
)
def merge_payload_rows(spark, folder):
    source, mapping = _sources(spark, folder)
    made = merge_plan.payloads(merge_plan.plan(source, mapping, _ledger(spark, folder)))
    return made.select("op", "id", "account_id", "kind", "day", real("amount"), "comment", "key", "metadata")


@query(
    """WITH p AS (SELECT CAST(l_suppkey AS VARCHAR) AS source_id, CASE WHEN l_orderkey % 41 <> 0 THEN l_orderkey || '-' || l_linenumber END AS txn_id, l_linenumber = 7 AS pending, CASE WHEN l_partkey % 37 = 0 THEN 'NaN' ELSE CAST(l_partkey AS VARCHAR) END AS amount, l_orderkey % 43 AS posted FROM lineitem),
q AS (SELECT * FROM p WHERE NOT pending) SELECT source_id, txn_id, 'transaction without id' AS code FROM q WHERE txn_id IS NULL UNION ALL SELECT source_id, txn_id, 'amount is not finite' FROM q WHERE amount = 'NaN' UNION ALL SELECT source_id, txn_id, 'no valid date' FROM q WHERE posted = 0
UNION ALL SELECT source_id, txn_id, 'conflicting versions' FROM q WHERE txn_id IS NOT NULL GROUP BY source_id, txn_id HAVING count(DISTINCT (amount, posted)) > 1"""
)
def payload_problem_rows(spark, folder):
    n = F.col("l_orderkey")
    rows = ad.table(spark, folder, "lineitem").select(F.col("l_suppkey").cast("string").alias("source_id"), F.when(n % 41 != 0, F.concat_ws("-", n, "l_linenumber")).alias("txn_id"), (F.col("l_linenumber") == 7).alias("pending"), F.when(F.col("l_partkey") % 37 == 0, "NaN").otherwise(F.col("l_partkey").cast("string")).alias("amount"), (n % 43).cast("string").alias("posted"), F.lit("d").alias("description"))
    return validation.payload_problems(rows)


@query(
    f"""WITH {POS_SQL} SELECT CAST(l_suppkey AS VARCHAR) AS source_id, CAST(n AS VARCHAR) AS position_id, CASE WHEN n % 5 = 0 THEN 'provider' WHEN n % 5 = 1 THEN 'purchase price' WHEN n % 5 = 2 THEN 'verified' WHEN n % 5 = 3 THEN 'retained' END AS cost_from,
 CAST(CASE n % 5 WHEN 0 THEN value WHEN 1 THEN n WHEN 2 THEN 7 WHEN 3 THEN 2 END AS DOUBLE) AS average_cost, CAST(quantity AS DOUBLE) AS quantity, CAST(value AS DOUBLE) AS value FROM pos WHERE n % 50 <> 0"""
)
def cost_rows(spark, folder):
    positions = _positions(spark, folder)
    none = F.lit(None).cast(money.MONEY)
    verified = positions.where("n % 5 = 2").select("source_id", F.col("symbol").alias("name_key"), F.lit(7).cast(money.MONEY).alias("unit_cost"), none.alias("verified_quantity"), none.alias("verified_basis"))
    asset = money.uuid5(money.NAMESPACE_URL, F.concat_ws(":", F.lit("src"), "source_id", "position_id"))
    current = positions.where("n % 5 = 3").select(asset.alias("asset_id"), F.col("quantity").alias("held_quantity"), (F.col("quantity") * 2).cast(money.MONEY).alias("held_basis"))
    return holdings.planned(positions, _owners(spark, folder), current, verified).select("source_id", "position_id", "cost_from", real("average_cost"), real("quantity"), real("value"))


@query(
    f"""WITH {ad.EV_SQL}, m AS (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'HOLDINGS' ELSE 'TRANSACTIONS' END AS mode FROM ev GROUP BY ALL),
s AS (SELECT ev.user_id, mode, CAST(ts AS DATE) AS day, CASE WHEN event_type IN ('view', 'click') THEN 'CALCULATED' ELSE 'MANUAL_ENTRY' END AS kind, value AS cash, event_type <> 'error' AS valid FROM ev JOIN m USING (user_id))
SELECT CAST(user_id AS VARCHAR) AS account_id, day, kind, CAST(cash AS DOUBLE) AS cash FROM s WHERE (kind = 'CALCULATED') = (mode = 'TRANSACTIONS') AND valid AND day <= DATE '2024-01-20' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY day DESC, kind, cash) = 1"""
)
def readable_snapshots(spark, folder):
    e, user = ad.events(spark, folder), F.col("user_id").cast("string").alias("account_id")
    kind = F.when(F.col("event_type").isin("view", "click"), "CALCULATED").otherwise("MANUAL_ENTRY")
    snapshots = e.select(user, F.to_date("ts").alias("day"), kind.alias("kind"), F.col("value").alias("cash"), (F.col("event_type") != "error").alias("valid"))
    modes = e.select(user, F.when(F.col("user_id") % 2 == 0, "HOLDINGS").otherwise("TRANSACTIONS").alias("mode")).distinct()
    return balances.readable(snapshots, modes, "2024-01-20").select("account_id", "day", "kind", real("cash"))


@query(
    f"""WITH {ad.RESOLVED_SQL}, m AS (SELECT *, {ad.UNDONE_SQL} AS todo, greatest(abs(amount), 0.01) AS w FROM res), i AS (SELECT * FROM m WHERE todo),
g AS (SELECT name, string_agg(guess || '=' || n, ',' ORDER BY n DESC, guess) AS predicted FROM (SELECT name, guess, count(*) AS n FROM i GROUP BY ALL) GROUP BY name),
l AS (SELECT name, string_agg(label || '=' || n, ',' ORDER BY n DESC, label) AS labelled FROM (SELECT name, label, count(*) AS n FROM i WHERE label_source IN ('user', 'merchant') AND label IS NOT NULL GROUP BY ALL) GROUP BY name),
s AS (SELECT name, count(*) AS rows, count(*) FILTER (label IS NULL) AS missing_label, count(*) FILTER (len(category_ids) = 0) AS missing_category, round(sum(abs(amount)), 2) AS total, round(sum(w * guess_confidence) / sum(w), 3) AS confidence, greatest(count(*) - 60, 0) AS more FROM i GROUP BY name),
o AS (SELECT name, count(*) AS elsewhere FROM m WHERE NOT todo GROUP BY name)
SELECT s.*, coalesce(elsewhere, 0) AS elsewhere, predicted, labelled FROM s LEFT JOIN o USING (name) LEFT JOIN g USING (name) LEFT JOIN l USING (name)"""
)
def card_details(spark, folder):
    spoken = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("=", x["value"], x["n"])), ",").alias(c)
    found = views.card_details(_resolved(spark, folder))
    return found.select("name", "rows", "missing_label", "missing_category", "total", "confidence", "more", "elsewhere", spoken("predicted"), spoken("labelled"))


@query(
    f"""WITH {ad.RESOLVED_SQL}, x AS (SELECT *, k % 7 = 1 AS split, CASE WHEN k % 3 = 0 THEN category_ids[1] END AS category_id, CASE WHEN k % 2 = 0 THEN 'rule' WHEN k % 5 = 0 THEN 'import' END AS category_source, k % 4 = 0 AS ours, k % 8 = 0 AS preset, k % 12 = 0 AS logged FROM res),
y AS (SELECT *, CASE WHEN split THEN 'the app' WHEN category_source = 'rule' THEN CASE WHEN ours AND logged THEN 'You' WHEN ours AND preset THEN 'app preset' ELSE 'app rule' END WHEN logged THEN 'You' ELSE 'You (in the app)' END AS who FROM x)
SELECT id, CASE label_source WHEN 'merchant' THEN 'all of ' || name WHEN 'user' THEN 'this row' WHEN 'app-ui' THEN 'set in the app' WHEN 'account' THEN 'account default' WHEN 'cardmember' THEN 'cardmember on statement' WHEN 'model' THEN 'model ' || CAST(round(label_confidence * 100) AS INTEGER) || '%' END AS label_said_by,
 {ORIGIN_SQL} AS label_origin, CASE label_source WHEN 'merchant' THEN 'a rule for every charge of ' || name WHEN 'user' THEN 'labelled by hand, this row only' WHEN 'app-ui' THEN 'edited in the app, which wins' WHEN 'account' THEN 'the account''s default' WHEN 'cardmember' THEN 'the issuer''s file names the cardmember' WHEN 'model' THEN 'the model''s prediction' END
   || CASE WHEN k % 2 = 0 THEN ' · set 2024-05-06' ELSE '' END || CASE WHEN k % 3 = 0 THEN ' · r1 · r2' ELSE '' END || CASE WHEN k % 5 = 0 THEN ' · note: n' ELSE '' END AS label_why,
 CASE WHEN split OR category_id IS NOT NULL THEN who END AS category_origin, CASE WHEN split THEN 'split' WHEN category_id IS NULL THEN NULL WHEN category_source = 'rule' THEN CASE WHEN ours AND preset THEN 'preset' ELSE 'rule' END ELSE coalesce(category_source, 'manual') END AS category_said_by,
 CASE WHEN split THEN 'split across categories' WHEN category_id IS NOT NULL THEN CASE WHEN category_source = 'rule' AND ours THEN 'rule ''R'' (contains x)' WHEN category_source = 'rule' THEN 'a rule that no longer matches this row' WHEN category_source IS NULL THEN 'set by hand' ELSE 'source: ' || category_source END || ' · originator: ' || who END AS category_why FROM y"""
)
def explained_rows(spark, folder):
    rows, k, none = _resolved(spark, folder), F.col("ord"), F.lit(None).cast("string")
    when = lambda test, x: F.when(test, x)
    rows = rows.select(
        "*", F.lit("labeling serve").alias("label_by"), when(k % 2 == 0, "2024-05-06T07:08:09").alias("label_at"), F.lit(False).alias("label_accepted"), when(k % 3 == 0, F.array(F.lit("r1"), F.lit("r2"))).alias("label_reasons"), when(k % 5 == 0, "n").otherwise("").alias("label_note"),
        when(k % 3 == 0, F.get("category_ids", F.lit(0))).alias("category_id"), (k % 7 == 1).alias("split"), when(k % 2 == 0, "rule").when(k % 5 == 0, "import").otherwise(none).alias("category_source"),
        F.lit("R").alias("rule_name"), when(k % 4 == 0, F.get("category_ids", F.lit(0))).alias("rule_category"), F.lit("contains x").alias("rule_pattern"), (k % 8 == 0).alias("rule_preset"), when(k % 12 == 0, F.struct(F.lit("user").alias("source"), F.lit("labeling serve").alias("by"))).alias("category_entry"),
    )
    return views.explained(rows).select("id", "label_said_by", "label_origin", "label_why", "category_origin", "category_said_by", "category_why")


@query(None)
def evaluation_report(spark, folder):
    """Fits and all: unseen merchants, a later period and the blind check set of customers as rows and events as decisions."""
    rows = ad.labelled_rows(spark, folder)
    features = F.array(F.concat(F.lit("m:"), "merchant"), F.concat(F.lit("acc:"), "account"), F.concat(F.lit("amt:"), text.amount_bucket(F.col("amount")).cast("string")))
    return evaluation.report(rows.withColumn("features", features), ad.decision_log(spark, folder), ["v0", "v1", "v2", "d0", "d1", "card"], 0.5)
