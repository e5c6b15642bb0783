"""Writers: immutable landings, keyed upserts, appended logs, swapped state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def land(df: DataFrame, path: str) -> None:
    """Write once; an existing folder is an error."""
    df.write.mode("errorifexists").parquet(path)


def upserted(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The table with rows replaced by key, and new ones."""
    return table.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes.select(*table.columns))


def removed(table: DataFrame, keys: DataFrame) -> DataFrame:
    return table.join(keys, keys.columns, "left_anti")


def published(table: DataFrame, changes: DataFrame, keys: list[str], path: str) -> DataFrame:
    """Write an upsert next to ``path`` and read it back; fails unless every change is there as sent."""
    spark = table.sparkSession
    out = f"{path.rstrip('/')}-{uuid.uuid4().hex[:12]}"
    upserted(table, changes, keys).write.parquet(out)
    back = spark.read.parquet(out)
    missing = changes.select(*table.columns).exceptAll(back.select(*table.columns)).limit(1).count()
    if missing:
        raise ValueError("not all changes were kept")
    return back


def valuations(current: DataFrame, observed: DataFrame) -> DataFrame:
    """Liabilities (id, value, day) to write: of a newer day, or of the same day with another value."""
    joined = observed.alias("o").join(current.alias("c"), "id", "left")
    newer = F.col("c.day").isNull() | (F.col("o.day") > F.col("c.day")) | ((F.col("o.day") == F.col("c.day")) & ~F.col("o.value").eqNullSafe(F.col("c.value")))
    return joined.where(newer).select("id", "o.value", "o.day")


def newer_kept(observed: DataFrame, kept: DataFrame) -> DataFrame:
    """Observations (account_id, day) that are not older than what is kept."""
    last = kept.groupBy("account_id").agg(F.max("day").alias("kept_day"))
    return observed.join(last, "account_id", "left").where(F.col("kept_day").isNull() | (F.col("day") >= F.col("kept_day"))).drop("kept_day")


def swap(df: DataFrame, path: str) -> None:
    """Replace a folder's content: written aside, then the old folder is renamed away and the new one renamed in.

    Nothing is deleted before the new content is in place. After a crash between the two renames there is no folder of
    that name for a moment, but both contents are whole beside it, and ``recover`` puts one back.
    """
    spark: SparkSession = df.sparkSession
    aside, before = (f"{path.rstrip('/')}.{word}-{uuid.uuid4().hex[:12]}" for word in ("new", "old"))
    df.write.parquet(aside)
    jvm = spark.sparkContext._jvm
    target, source, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, aside, before))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"could not rename {path} to {before}")
    if not fs.rename(source, target):
        raise OSError(f"could not rename {aside} to {path}; the old content is {before}")
    fs.delete(old, True)


def recover(spark: SparkSession, path: str) -> bool:
    """Put back what a swap that did not end left beside ``path``: the new content if it is whole, else the old."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        return False
    beside = [x.getPath() for word in ("new", "old") for x in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{target}.{word}-*"))]
    for found in beside:
        if fs.exists(jvm.org.apache.hadoop.fs.Path(found, "_SUCCESS")):
            return bool(fs.rename(found, target))
    return False


def report(df: DataFrame, path: str) -> None:
    """A small result as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)
