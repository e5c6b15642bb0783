"""The driver's tables read as ledger entities, in Spark and as SQL for the oracle (the same rules, written twice)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money, text


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    """id, account_id, account_kind, amount, day, description, kind, merchant, status: one per order."""
    orders, customer, part = (table(spark, folder, n) for n in ("orders", "customer", "part"))
    key = F.col("o_orderkey")
    words = {0: F.lit("Interest Paid"), 1: F.lit("VENMO  CASHOUT 12"), 2: F.lit("Online transfer to savings account"), 3: F.lit("CHASE CREDIT CRD AUTOPAY"), 4: F.lit("Payment - thank you"), 5: F.concat(F.lit("SQ *"), "p_name"), 6: F.concat(F.lit("POS 12 "), "p_name", F.lit(" "), "p_brand"), 7: F.lit("bank p2p")}
    description = F.col("p_name")
    for k, w in words.items():
        description = F.when(key % 9 == k, w).otherwise(description)
    few = part.where("p_partkey < 200").select("p_partkey", "p_name", "p_brand")  # 200 rows
    rows = orders.join(customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(few), key % 200 == F.col("p_partkey"))
    rows = rows.select(
        key.alias("id"), F.col("o_custkey").alias("account_id"), F.when(F.col("c_mktsegment") == "BUILDING", "CREDIT_CARD").otherwise("CASH").alias("account_kind"),
        F.when(key % 3 == 0, F.col("o_totalprice")).otherwise(-F.col("o_totalprice")).cast("decimal(18,2)").alias("amount"), F.to_date("o_orderdate").alias("day"), description.alias("description"),
        F.when(F.col("o_orderstatus") == "P", "PENDING").otherwise("POSTED").alias("status"),
    )
    return rows.withColumn("kind", money.cash_kind(F.col("description"), F.col("amount"), F.col("account_kind"))).withColumn("merchant", text.merchant_key(F.col("description")))


NOISE_SQL = "[" + ", ".join(f"'{w}'" for w in text.NOISE) + "]"


def key_sql(words: str) -> str:
    """Merchant key of a list of words."""
    start = f"coalesce(list_position(list_transform({words}, lambda y: list_contains({NOISE_SQL}, y)), false), 0)"
    return f"array_to_string(list_slice({words}, greatest({start}, 1), greatest({start}, 1) + 1), ' ')"


WORDS_SQL = "regexp_extract_all(upper({}), '[A-Z][A-Z0-9''&]*')"
KIND_SQL = r"""CASE WHEN account_kind = 'CREDIT_CARD' THEN CASE WHEN amount < 0 THEN 'WITHDRAWAL'
         WHEN regexp_matches(lower(description), '\b(autopay|automatic payment|payment\W+(?:received|thank))') THEN 'TRANSFER_IN' ELSE 'CREDIT' END
     WHEN regexp_matches(trim(lower(description)), '^(interest (paid|payment|earned)|interest)$') THEN CASE WHEN amount >= 0 THEN 'INTEREST' ELSE 'WITHDRAWAL' END
     WHEN amount > 0 AND regexp_matches(lower(description), '\bvenmo\s+cashout\b') THEN 'TRANSFER_IN'
     WHEN regexp_matches(lower(description), '\btransfer (?:to|from|.* (?:to|from)) .*(?:account|savings|checking|spending)|\b(?:citi|chase|amex|credit card|credit crd) .*?(?:autopay|payment)|\bbank p2p\b')
         THEN CASE WHEN amount >= 0 THEN 'TRANSFER_IN' ELSE 'TRANSFER_OUT' END
     WHEN amount >= 0 THEN 'DEPOSIT' ELSE 'WITHDRAWAL' END"""
TX_SQL = f"""raw_tx AS (SELECT o_orderkey AS id, o_custkey AS account_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'CREDIT_CARD' ELSE 'CASH' END AS account_kind,
     CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice ELSE -o_totalprice END AS DECIMAL(18,2)) AS amount, CAST(o_orderdate AS DATE) AS day,
     CASE o_orderkey % 9 WHEN 0 THEN 'Interest Paid' WHEN 1 THEN 'VENMO  CASHOUT 12' WHEN 2 THEN 'Online transfer to savings account'
       WHEN 3 THEN 'CHASE CREDIT CRD AUTOPAY' WHEN 4 THEN 'Payment - thank you' WHEN 5 THEN 'SQ *' || p_name
       WHEN 6 THEN 'POS 12 ' || p_name || ' ' || p_brand WHEN 7 THEN 'bank p2p' ELSE p_name END AS description,
     CASE WHEN o_orderstatus = 'P' THEN 'PENDING' ELSE 'POSTED' END AS status
   FROM orders JOIN customer ON o_custkey = c_custkey JOIN part ON p_partkey = o_orderkey % 200),
tx AS (SELECT *, {KIND_SQL} AS kind, {key_sql(WORDS_SQL.format("description"))} AS merchant FROM raw_tx)"""
SIGNED_SQL = """CASE WHEN kind = 'INTEREST' AND account_kind = 'CREDIT_CARD' THEN -abs(amount) WHEN kind IN ('DEPOSIT', 'CREDIT', 'INTEREST', 'DIVIDEND', 'TRANSFER_IN') THEN amount
     WHEN kind IN ('WITHDRAWAL', 'EXPENSE', 'FEE', 'TAX', 'TRANSFER_OUT') THEN -abs(amount) END"""


def events(spark: SparkSession, folder: str, kind: str | None = None) -> DataFrame:
    found = table(spark, folder, "events").select("event_id", "user_id", "event_type", "ts", F.col("value").cast("decimal(18,2)").alias("value"))
    return found if kind is None else found.where(F.col("event_type") == kind)


EV_SQL = "ev AS (SELECT event_id, user_id, event_type, ts, CAST(value AS DECIMAL(18,2)) AS value FROM events)"


def decision_log(spark: SparkSession, folder: str) -> DataFrame:
    """A decision for each event; some clear, some revert an earlier one."""
    e, n = table(spark, folder, "events"), F.col("event_id")
    source = F.when(F.col("event_type") == "purchase", "user").when(F.col("event_type") == "signup", "app-ui").when(F.col("event_type") == "error", "model").otherwise("merchant")
    of_merchant = source == "merchant"
    reverts = F.when(n % 17 == 0, n - 5)
    return e.select(
        n.alias("seq"), F.when(reverts.isNull(), F.lit("spender")).otherwise("spender").alias("field"), source.alias("source"), F.concat(F.lit("u"), n % 3).alias("by"), F.concat(F.lit("a"), F.floor(n / 4)).alias("action"),
        F.when(~of_merchant, F.col("user_id").cast("string")).alias("activity_id"), F.when(of_merchant, F.concat(F.lit("M"), F.col("user_id") % 40)).alias("merchant"),
        F.when(n % 11 != 0, F.concat(F.lit("v"), n % 3)).alias("value"), F.lit(None).cast("string").alias("note"), (n % 13 == 0).alias("check"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("rule_id"), reverts.alias("reverts"),
    )


LOG_SQL = """lg0 AS (SELECT event_id AS seq, CASE event_type WHEN 'purchase' THEN 'user' WHEN 'signup' THEN 'app-ui' WHEN 'error' THEN 'model' ELSE 'merchant' END AS source,
     'u' || (event_id % 3) AS author, 'a' || (event_id // 4) AS action, user_id, CASE WHEN event_id % 11 <> 0 THEN 'v' || (event_id % 3) END AS value,
     event_id % 13 = 0 AS blind, CASE WHEN event_id % 17 = 0 THEN event_id - 5 END AS reverts FROM events),
lg AS (SELECT *, CASE WHEN source <> 'merchant' THEN CAST(user_id AS VARCHAR) END AS activity_id, CASE WHEN source = 'merchant' THEN 'M' || (user_id % 40) END AS merchant FROM lg0),
alive AS (SELECT * FROM lg WHERE reverts IS NULL AND seq NOT IN (SELECT reverts FROM lg WHERE reverts IS NOT NULL))"""


def labelled_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows to label: a customer each, with defaults and guesses."""
    c, k = table(spark, folder, "customer"), F.col("c_custkey")
    return c.select(
        k.cast("string").alias("id"), k.alias("ord"), F.concat(F.lit("M"), k % 40).alias("merchant"), F.when(k % 5 != 0, F.concat(F.lit("d"), F.col("c_nationkey") % 2)).alias("account_value"), F.when(k % 7 == 0, F.lit("card")).alias("cardmember_value"),
        F.concat(F.lit("v"), k % 3).alias("guess"), (k % 100 / 100).alias("guess_confidence"), (k % 1000 / 1000).alias("posterior"), F.col("c_mktsegment").alias("account"), F.col("c_acctbal").alias("amount"),
        F.date_add(F.lit("2024-01-01").cast("date"), (k % 300).cast("int")).alias("day"), F.col("c_name").alias("notes"), F.concat(F.lit("M"), k % 40).alias("name"), F.when(k % 3 == 0, F.array(F.concat(F.lit("n"), F.col("c_nationkey")))).otherwise(F.array().cast("array<string>")).alias("category_ids"),
        F.when(k % 10 == 1, 0.0).otherwise(1.0).alias("visible_amount"), (k % 20 == 3).alias("foreign_event"), (k % 9 == 0).alias("held_out"),
    )


ROWS_SQL = """cr AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_custkey AS k, 'M' || (c_custkey % 40) AS merchant, CASE WHEN c_custkey % 5 <> 0 THEN 'd' || (c_nationkey % 2) END AS account_value,
     CASE WHEN c_custkey % 7 = 0 THEN 'card' END AS cardmember_value, 'v' || (c_custkey % 3) AS guess, (c_custkey % 100) / 100 AS guess_confidence, (c_custkey % 1000) / 1000 AS posterior, c_mktsegment AS account, c_acctbal AS amount,
     CAST(DATE '2024-01-01' + CAST(c_custkey % 300 AS INTEGER) AS DATE) AS day, c_name AS notes, 'M' || (c_custkey % 40) AS name, CASE WHEN c_custkey % 3 = 0 THEN ['n' || c_nationkey] ELSE [] END AS category_ids,
     CASE WHEN c_custkey % 10 = 1 THEN 0.0 ELSE 1.0 END AS visible_amount, c_custkey % 20 = 3 AS foreign_event, c_custkey % 9 = 0 AS held_out FROM customer)"""
RESOLVED_SQL = (
    LOG_SQL
    + ",\n"
    + ROWS_SQL
    + """,
cand AS (SELECT cr.id, a.source, a.value, a.seq, NULL AS confidence FROM cr JOIN alive a ON a.activity_id = cr.id WHERE a.source <> 'model'
   UNION ALL SELECT cr.id, a.source, a.value, a.seq, NULL FROM cr JOIN alive a ON a.merchant = cr.merchant
   UNION ALL SELECT id, 'account', account_value, 0, NULL FROM cr WHERE account_value IS NOT NULL
   UNION ALL SELECT id, 'cardmember', cardmember_value, 0, NULL FROM cr WHERE cardmember_value IS NOT NULL
   UNION ALL SELECT id, 'model', guess, 0, guess_confidence FROM cr WHERE guess_confidence >= 0.8),
best AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY id ORDER BY CASE source WHEN 'user' THEN 4 WHEN 'app-ui' THEN 4 WHEN 'merchant' THEN 3 WHEN 'cardmember' THEN 2 WHEN 'account' THEN 1 ELSE 0 END DESC, seq DESC) = 1),
res AS (SELECT cr.*, b.source AS label_source, b.value AS label, b.confidence AS label_confidence FROM cr LEFT JOIN (SELECT * FROM best WHERE value IS NOT NULL OR source IN ('user', 'app-ui')) b USING (id))"""
)
OPEN_SQL = "(visible_amount <> 0 AND NOT foreign_event AND label IS NULL)"
UNDONE_SQL = f"({OPEN_SQL} OR (visible_amount <> 0 AND NOT foreign_event AND coalesce(label_source IN ('user', 'merchant', 'app-ui'), false) AND len(category_ids) = 0))"
