"""Snapshots as they land, merged into the ledger's source rows; late corrections replace what they correct."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def newest_versions(old: DataFrame, new: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """The newest row of each key by the stamp in the row, whatever order the files came in."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in keys]
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(stamp, *(c for c in rest if c != stamp))).alias("x"))
    return last.select(*keys, *(F.col(f"x.{c}") for c in rest))


def merge_stream(spark: SparkSession, landing: str, schema: str, keys: list[str], stamp: str, table: str, checkpoint: str, each: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Merge all files that have landed so far into the Parquet table, and stop.

    Batches write version folders beside each other and then a marker row, so that a batch that runs twice writes the
    same version again.
    """
    stream = spark.readStream.schema(schema).option("multiLine", True).json(landing)

    def merge(batch: DataFrame, number: int) -> None:
        rows = each(batch) if each else batch
        versions = current_version(spark, table, before=number)
        old = spark.read.parquet(f"{table}/v{versions}") if versions is not None else rows.limit(0)
        newest_versions(old, rows, keys, stamp).write.mode("overwrite").parquet(f"{table}/v{number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_version(spark: SparkSession, table: str, before: int | None = None) -> int | None:
    """The last complete version folder (before a number)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    found = [s.getPath() for s in fs.listStatus(path)]
    numbers = [int(p.getName()[1:]) for p in found if p.getName()[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    numbers = [n for n in numbers if before is None or n < before]
    return max(numbers, default=None)


def transactions(batch: DataFrame) -> DataFrame:
    """Transactions of a batch of snapshots, stamped with the snapshot's balance time."""
    each = batch.where("accounts is not null").select(F.explode("accounts").alias("a"))
    rows = each.select(F.col("a.id").alias("source_id"), F.col("a.balance-date").alias("as_of"), F.explode("a.transactions").alias("t"))
    return rows.select("source_id", F.col("t.id").alias("txn_id"), "as_of", F.col("t.posted").alias("posted"), F.col("t.amount").alias("amount"), F.col("t.description").alias("description"))


def due(runs: DataFrame, now: str, at_hour: int = 6, retry_minutes: int = 60) -> DataFrame:
    """One row (due): whether a daily run should start: none has succeeded since today's hour, and none failed just now.

    runs: started, ok.
    """
    moment = F.lit(now).cast("timestamp")
    today = F.date_trunc("day", moment) + F.make_interval(hours=F.lit(at_hour))
    start = F.when(moment >= today, today).otherwise(today - F.expr("INTERVAL 1 DAY"))
    sums = runs.agg(F.max(F.when(F.col("ok"), F.col("started"))).alias("last_ok"), F.max("started").alias("last"))
    done = F.coalesce(F.col("last_ok") >= start, F.lit(False))
    waiting = F.coalesce(F.col("last") > moment - F.make_interval(mins=F.lit(retry_minutes)), F.lit(False))
    return sums.select((~done & ~waiting).alias("due"))


def healthy(runs: DataFrame, now: str, stale_hours: int = 26) -> DataFrame:
    """One row (healthy): whether the last run is recent and without errors."""
    last = runs.agg(F.max_by("ok", "started").alias("ok"), F.max("started").alias("started"))
    return last.select((F.coalesce("ok", F.lit(False)) & F.coalesce(F.col("started") >= F.lit(now).cast("timestamp") - F.make_interval(hours=F.lit(stale_hours)), F.lit(False))).alias("healthy"))


def tiles(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by event-time window and type; works on streams (append mode) and tables."""
    stamped = events.withWatermark("ts", late) if events.isStreaming else events
    found = stamped.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("window.start").alias("start"), "event_type", "n", "total")

