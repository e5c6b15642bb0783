"""Readers of snapshots, exports, statements, logs and configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRANSACTION = "struct<id: string, posted: bigint, amount: string, description: string, memo: string, pending: variant, payee: string, mcc: string, transacted_at: bigint>"
HOLDING = "struct<id: string, symbol: string, description: string, shares: string, market_value: string, currency: string, cost_basis: string, purchase_price: string>"
ACCOUNT = f"struct<id: string, name: string, org: struct<name: string, domain: string>, currency: string, balance: string, `balance-date`: bigint, `available-balance`: string, transactions: array<{TRANSACTION}>, holdings: array<{HOLDING}>>"
SNAPSHOT = f"errors array<string>, errlist array<string>, accounts array<{ACCOUNT}>"
LOG = "seq bigint, at string, field string, source string, by string, action string, activity_id string, merchant string, value string, note string, check boolean, accepted boolean, confidence double, reasons array<string>, model string, rule_id string, reverts bigint"


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Provider snapshots, one JSON document a file, with their path; unreadable files are left out."""
    read = spark.read.schema(SNAPSHOT).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return read.where("accounts is not null").select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"))


def accounts(read: DataFrame) -> DataFrame:
    return read.select("path", F.posexplode("accounts").alias("pos", "a")).select("path", "pos", F.col("a.id").alias("source_id"), F.col("a.name").alias("name"), F.col("a.org.name").alias("org"), F.col("a.currency").alias("currency"), F.col("a.balance").alias("balance"), F.col("a.balance-date").alias("balance_at"), F.col("a.holdings").alias("holdings"))


def transactions(read: DataFrame) -> DataFrame:
    """Transactions of all accounts in a snapshot's order; ``flag`` is the raw pending flag."""
    each = read.select("path", F.explode("accounts").alias("a")).select("path", F.col("a.id").alias("source_id"), F.posexplode("a.transactions").alias("pos", "t"))
    flag = F.schema_of_variant(F.col("t.pending"))
    pending = F.try_variant_get("t.pending", "$", "boolean")
    return each.select("path", "source_id", "pos", F.col("t.id").alias("txn_id"), F.col("t.posted").alias("posted"), F.timestamp_seconds("t.posted").alias("posted_at"), F.col("t.amount").alias("amount"), F.col("t.description").alias("description"), flag.alias("flag"), F.coalesce(pending, F.lit(False)).alias("pending"), F.col("t.payee").alias("payee"), F.col("t.mcc").alias("mcc"), F.col("t.transacted_at").alias("transacted_at"))


def extras(read: DataFrame, prefix: str = "src") -> DataFrame:
    """(key, payee, mcc, transacted_at) of every transaction; the last file by path, then the last place, wins."""
    key = F.concat_ws(":", F.lit(prefix), "source_id", "txn_id")
    last = transactions(read).groupBy(key.alias("key")).agg(F.max_by(F.struct("payee", "mcc", "transacted_at"), F.struct("path", "pos")).alias("x"))
    return last.select("key", "x.*")


def exports(spark: SparkSession, path: str, key: list[str], text: str, merchant: str | None = None) -> DataFrame:
    """(key, description, merchant) of a CSV export; ``key`` alternates text and {column}. Blank texts are left out, the last line wins."""
    read = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    parts = [F.col(p[1:-1]) if p.startswith("{") else F.lit(p) for p in key]
    rows = read.select(F.concat(*parts).alias("key"), F.col(text).alias("description"), (F.col(merchant) if merchant else F.lit(None).cast("string")).alias("merchant"), F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("line"))
    rows = rows.where(F.trim(F.coalesce("description", F.lit(""))) != "")
    last = rows.groupBy("key").agg(F.max_by(F.struct("description", "merchant"), F.struct("path", "line")).alias("x"))
    return last.select("key", "x.*")


def statement_lines(spark: SparkSession, path: str, patterns: list[tuple[str, str]]) -> DataFrame:
    """(path, line, day, amount, memo, value, pattern) of OFX statements, value by the first pattern found in the memo."""
    blob = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "ISO-8859-1").alias("text"))
    each = blob.select("path", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?s)<STMTTRN>(.*?)</STMTTRN>"), F.lit(1))).alias("line", "block"))
    tag = lambda name: F.trim(F.regexp_extract("block", rf"<{name}>([^<\r\n]*)", 1))
    memo = tag("MEMO")
    value = pattern = None
    for p, v in patterns:
        value = F.when(memo.rlike(p), v) if value is None else value.when(memo.rlike(p), v)
        pattern = F.when(memo.rlike(p), p) if pattern is None else pattern.when(memo.rlike(p), p)
    none = F.lit(None).cast("string")
    amount = F.abs(tag("TRNAMT").try_cast("decimal(18,2)"))
    return each.select("path", "line", F.to_date(F.substring(tag("DTPOSTED"), 1, 8), "yyyyMMdd").alias("day"), amount.alias("amount"), memo.alias("memo"), (none if value is None else value).alias("value"), (none if pattern is None else pattern).alias("pattern"))


def decision_log(spark: SparkSession, path: str) -> DataFrame:
    """The append-only log, JSON lines; blank lines are left out."""
    return spark.read.schema(LOG).json(path).where("seq is not null")


def configuration(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """One JSON document; a wrong version fails the query."""
    read = spark.read.schema(schema).option("multiLine", True).json(path)
    if version is None:
        return read
    ok = F.col("version") == version
    return read.withColumn("version", F.when(ok, F.col("version")).otherwise(F.raise_error(F.lit(f"version must be {version}")).cast("int")))


def listing(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, modified, length) of files, without reading them."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.col("modificationTime").alias("modified"), "length")


def newest(spark: SparkSession, pattern: str) -> DataFrame:
    return listing(spark, pattern).orderBy(F.col("modified").desc(), F.col("path").desc()).limit(1)


def spending(rows: DataFrame) -> DataFrame:
    return rows.where("cash_flow_bucket = 'spending'")


def with_descriptions(rows: DataFrame, described: DataFrame) -> DataFrame:
    """Rows whose blank notes are replaced by an export's description of the same key; ``source_notes`` keeps the original."""
    blank = F.trim(F.coalesce("notes", F.lit(""))) == ""
    joined = rows.join(described.select("key", "description"), "key", "left")
    return joined.withColumn("source_notes", F.coalesce("notes", F.lit(""))).withColumn("notes", F.when(blank, F.col("description")).otherwise(F.col("notes"))).drop("description")


def category_ids(assignments: Column, splits: Column, taxonomy: str = "spending_categories") -> Column:
    """Ids of a row's assigned and split categories of one taxonomy, in order."""
    own = lambda a: F.transform(F.filter(F.coalesce(a, F.array()), lambda x: x["taxonomy_id"] == taxonomy), lambda x: x["category_id"])
    return F.concat(own(assignments), own(splits))
