"""Waiting until an account's total stays where it should: two equal reads in a row, at most so many attempts.

The same rule twice: over a table of reads, and as keyed state with a timer over a stream of them.
Reads: account_id, attempt (from 1), expected, total (null: could not be read). Results: account_id, settled, attempts,
total (of the last read that counts).
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import money

#: Attempts at most, and matching reads in a row.
ATTEMPTS, STABLE = 15, 2
RESULT = "account_id string, settled boolean, attempts int, total decimal(28,10)"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def settled(reads: DataFrame) -> DataFrame:
    """Each account's result from all its reads so far; an account that is still being asked has none.

    Only the first ATTEMPTS reads of an account count, so however many it has, the rows in order are that few.
    """
    counted = reads.where(F.col("attempt").between(1, ATTEMPTS))
    close = F.abs(F.col("total") - F.col("expected")) <= F.lit(money.HALF_CENT).cast(money.MONEY)
    counted = counted.select("account_id", "attempt", "total", F.coalesce(close, F.lit(False)).alias("ok"))
    of = Window.partitionBy("account_id").orderBy("attempt")
    last = counted.withColumn("stable", F.col("ok") & F.lag("ok", STABLE - 1, False).over(of))
    sums = last.groupBy("account_id").agg(F.min(F.when(F.col("stable"), F.struct("attempt", "total"))).alias("first"), F.max(F.struct("attempt", "total")).alias("end"))
    done = F.col("first").isNotNull()
    sums = sums.where(done | (F.col("end.attempt") >= ATTEMPTS))
    return sums.select(F.col("account_id").cast("string"), done.alias("settled"), F.coalesce("first.attempt", "end.attempt").cast("int").alias("attempts"), F.coalesce("first.total", "end.total").cast(money.MONEY).alias("total"))


class Settling(StatefulProcessor):
    """State of an account: attempts, matching reads in a row, last total; a timer gives up on one that is not read any more."""

    def __init__(self, patience_ms: int | None):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("reads", "attempts int, stable int, done boolean, total string, timer long")

    def _seen(self) -> tuple[int, int, bool, str | None, int | None]:
        return tuple(self.state.get()) if self.state.exists() else (0, 0, False, None, None)

    def _result(self, key: tuple, settled: bool, attempts: int, total: str | None) -> Row:
        return Row(account_id=key[0], settled=settled, attempts=attempts, total=None if total is None else Decimal(total))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        attempts, stable, done, total, timer = self._seen()
        out = []
        for r in sorted(rows, key=lambda r: r.attempt):
            if done or r.attempt <= attempts or r.attempt > ATTEMPTS:  # one that was seen already, or too many
                continue
            attempts, total = r.attempt, None if r.total is None else str(r.total)
            stable = stable + 1 if r.total is not None and abs(r.total - r.expected) <= Decimal(money.HALF_CENT) else 0
            done = stable >= STABLE or attempts >= ATTEMPTS
            if done:
                out.append(self._result(key, stable >= STABLE, attempts, total))
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = None
        if not done and self.patience_ms is not None:
            timer = timerValues.getCurrentProcessingTimeInMs() + self.patience_ms
            self.handle.registerTimer(timer)
        self.state.update((attempts, stable, done, total, timer))
        return iter(out)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:  # noqa: N802, N803
        attempts, stable, done, total, _ = self._seen()
        if done:
            return iter([])
        self.state.update((attempts, stable, True, total, None))
        return iter([self._result(key, False, attempts, total)])

    def close(self) -> None:
        pass


def settled_stream(reads: DataFrame, patience_ms: int | None = 15_000) -> DataFrame:
    """Results of a stream of reads, each account's once; after ``patience_ms`` without a read an account has not settled.

    None: no timers, for streams that are run until nothing is left (``availableNow``), which timers would keep going.
    The session's state store has to be PROVIDER (``spark.sql.streaming.stateStore.providerClass``).
    """
    typed = reads.select(F.col("account_id").cast("string").alias("account_id"), F.col("attempt").cast("int").alias("attempt"), F.col("expected").cast(money.MONEY).alias("expected"), F.col("total").cast(money.MONEY).alias("total"))
    return typed.groupBy("account_id").transformWithState(Settling(patience_ms), RESULT, "Append", "None" if patience_ms is None else "ProcessingTime")
