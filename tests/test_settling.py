"""Stable reads: the stream and the table give the same results, and timers give up."""

import random
import time
from decimal import Decimal

import pytest

from tallyforge.streaming import settling

READS = "account_id string, attempt int, expected decimal(28,10), total decimal(28,10)"


def some_reads(seed=4, accounts=40):
    rng, rows = random.Random(seed), []
    for k in range(accounts):
        for attempt in range(1, rng.choice([1, 2, 3, 6, 15, 20]) + 1):
            total = rng.choice([Decimal(10), Decimal("10.004"), Decimal("10.006"), Decimal(9), None])
            rows.append((f"a{k}", attempt, Decimal(10), total))
    rows += [("never", n, Decimal(10), Decimal(9)) for n in range(1, 18)] + [("at last", n, Decimal(10), Decimal(10 if n >= 14 else n)) for n in range(1, 16)]
    return rows


def brute(rows):
    found = {}
    for account in {r[0] for r in rows}:
        stable = 0
        for _, attempt, expected, total in sorted((r for r in rows if r[0] == account), key=lambda r: r[1])[:15]:
            stable = stable + 1 if total is not None and abs(total - expected) <= Decimal("0.005") else 0
            if stable == 2 or attempt == 15:
                found[account] = (stable == 2, attempt, total)
                break
    return found


def results(df):
    return {r.account_id: (r.settled, r.attempts, r.total) for r in df.collect()}


def test_table_of_reads(spark):
    rows = some_reads()
    assert results(settling.settled(spark.createDataFrame(rows, READS))) == brute(rows)
    assert results(settling.settled(spark.createDataFrame([], READS))) == {}


@pytest.fixture
def with_states(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, settling.PROVIDER)
    yield spark
    spark.conf.set(name, before)


def test_stream_of_reads_agrees_with_the_table(with_states, tmp_path):
    spark, rows = with_states, some_reads()
    path, out = str(tmp_path / "reads"), str(tmp_path / "out")

    def run():
        stream = spark.readStream.schema(READS).parquet(path)
        query = settling.settled_stream(stream, None).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        try:
            assert query.awaitTermination(120)
        finally:
            query.stop()

    for low, high in ((0, 2), (2, 9), (9, 30)):  # attempts come in three batches, some rows twice
        some = [r for r in rows if low < r[1] <= high]
        spark.createDataFrame(some + some[:5], READS).write.mode("append").parquet(path)
        run()
    found = spark.read.schema(settling.RESULT).parquet(out)
    assert results(found) == brute(rows) and found.count() == len(brute(rows))


def test_a_timer_gives_up_on_an_account(with_states, tmp_path):
    spark, path = with_states, str(tmp_path / "reads")
    spark.createDataFrame([("a", 1, Decimal(1), Decimal(1))], READS).write.parquet(path)
    query = settling.settled_stream(spark.readStream.schema(READS).parquet(path), 500).writeStream.format("memory").queryName("gave_up").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="300 milliseconds").start()
    try:
        until = time.time() + 90
        while time.time() < until and spark.table("gave_up").isEmpty():
            time.sleep(0.5)
        assert results(spark.table("gave_up")) == {"a": (False, 1, Decimal(1))}
    finally:
        query.stop()
