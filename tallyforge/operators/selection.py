"""Exact medians by refining histograms: no task holds a key's values, however many a key has."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch

#: Cells of a histogram.
CELLS = 4096


def medians(rows: DataFrame, key: str, value: str, name: str = "median") -> DataFrame:
    """(key, median): the middle value of each key, or the mean of the two in the middle; nulls and NaN do not count.

    Each turn counts the values between two bounds in CELLS cells, partially before any shuffle, and goes on with the
    least and greatest value of the cell that holds the middle, until they are equal: every turn narrows the bounds by
    CELLS or more. Keys that are done are not read for again.
    """
    data = rows.select(F.col(key).alias("key_"), F.col(value).cast("double").alias("v_")).where("v_ is not null and not isnan(v_)")
    data = scratch.written(data, "values")  # read once a turn
    sums = data.groupBy("key_").agg(F.count(F.lit(1)).alias("n"), F.min("v_").alias("low"), F.max("v_").alias("high"))
    ranks = F.explode(F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))).alias("rank")
    state = scratch.written(sums.select("key_", ranks, F.lit(0).cast("long").alias("below"), "low", "high"), "medians")
    done = []
    while True:
        done.append(state.where("low = high"))
        left = state.where("low < high")
        if left.isEmpty():
            break
        bounds = left.select(F.col("key_").alias("of_"), "rank", "below", "low", "high")
        inside = data.join(bounds, F.col("key_").eqNullSafe(F.col("of_")) & F.col("v_").between(F.col("low"), F.col("high")))
        cell = F.least(F.floor((F.col("v_") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * CELLS), F.lit(CELLS - 1))
        counts = inside.groupBy("key_", "rank", "below", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("v_").alias("low"), F.max("v_").alias("high"))
        up_to = F.sum("n").over(Window.partitionBy("key_", "rank").orderBy("cell"))  # CELLS rows at most
        found = counts.withColumn("upto", F.col("below") + up_to).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
        state = scratch.written(found.select("key_", "rank", (F.col("upto") - F.col("n")).alias("below"), "low", "high"), "medians")
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return every.groupBy(F.col("key_").alias(key)).agg(((F.min("low") / 2) + (F.max("low") / 2)).alias(name))
