"""Pages of a sorted table from an index of ranges: a page reads the ranges that it lies in, however far back it is."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import scratch

#: Rows of a range, about; ranges from which on smaller ones are made larger, up to that.
PER_RANGE, MANY = 50_000, 256


class PageIndex:
    """Rows sorted by range and written once, with each range's number of rows.

    order: columns that put the rows in one order (an id last); every row has a ``place`` from 0, which is a cursor.
    The driver holds one number a range: a range has ``per_range`` rows, more where that made over MANY ranges, and
    PER_RANGE at most (or ``per_range``, if that is more).
    """

    def __init__(self, rows: DataFrame, order: list[Column], per_range: int = PER_RANGE):
        names = [f"order_{k}_" for k in range(len(order))]
        rows = scratch.written(rows, "paged")  # counted, sampled and dealt out
        n = rows.count()
        ranges = max(1, -(-n // max(per_range, min(PER_RANGE, -(-n // MANY)))))
        place = F.monotonically_increasing_id()
        dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("place", place).withColumn("range_", F.shiftright("place", 33))
        self.columns, self.path = rows.columns, scratch.folder(rows.sparkSession, "pages")
        dealt.drop(*names).write.partitionBy("range_").parquet(self.path)
        self.table = rows.sparkSession.read.schema(dealt.schema).parquet(self.path)
        counts = {r[0]: r[1] for r in self.table.groupBy("range_").count().collect()}  # a row a range
        self.ranges = sorted(counts)
        self.begin = [0, *accumulate(counts[r] for r in self.ranges)]

    @property
    def total(self) -> int:
        return self.begin[-1]

    def between(self, start: int, end: int) -> DataFrame:
        """Rows with places from ``start`` to before ``end``, in order; only their ranges are read."""
        first, last = bisect_right(self.begin, start) - 1, bisect_right(self.begin, max(end, 1) - 1) - 1
        met = list(enumerate(self.ranges))[max(first, 0) : last + 1] if start < self.total and end > start else []
        shift = F.lit(0).cast("long")
        for k, r in met:
            shift = F.when(F.col("range_") == r, self.begin[k]).otherwise(shift)
        placed = self.table.where(F.col("range_").isin([r for _, r in met])).withColumn("place", shift + F.col("place").bitwiseAND((1 << 33) - 1))
        return placed.where((F.col("place") >= start) & (F.col("place") < end)).orderBy("place").select("place", *self.columns)

    def page(self, number: int, size: int) -> DataFrame:
        """The page of that number, from 0."""
        return self.between(number * size, (number + 1) * size)

    def after(self, place: int, size: int) -> DataFrame:
        """The rows after a cursor (-1: from the start)."""
        return self.between(place + 1, place + 1 + size)
