"""Ranges, histograms, digests and sums that are kept up, against plain Python and full fits."""

import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import money, stats
from tallyforge.operators import asof, balances, holdings, selection
from tallyforge.plans import decisions, naive_bayes, paging, upkeep
from tallyforge.sources.store import Store


def test_medians_against_sorting(spark):
    rng = random.Random(3)
    rows = [(None if k % 50 == 0 else f"k{rng.choice([0, 0, 0, 1, 2])}", rng.choice([rng.random() * 10**rng.randrange(-3, 9), 5.0, -1.5, None])) for k in range(3000)]
    rows += [("one", 2.5), ("two", 1.0), ("two", 2.0), ("same", 7.0), ("same", 7.0), ("none", None), ("nan", float("nan")), ("far", -1e308), ("far", 1e308), ("far", 3.0)]
    found = {r.k: r.median for r in selection.medians(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    want = {}
    for k in {r[0] for r in rows}:
        values = [v for key, v in rows if key == k and v is not None and v == v]
        if values:
            want[k] = statistics.median(values)
    assert found == pytest.approx(want) and found.keys() == want.keys()
    assert selection.medians(spark.createDataFrame([], "k string, v double"), "k", "v").count() == 0


def test_pages_from_an_index(spark):
    rng = random.Random(8)
    rows = [(k, rng.randrange(5)) for k in range(500)]
    rng.shuffle(rows)
    index = paging.PageIndex(spark.createDataFrame(rows, "id int, v int").repartition(3), [F.col("v").desc(), F.col("id").asc()], 40)
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert index.total == 500 and len(index.ranges) > 5
    for number, size in ((0, 7), (3, 50), (9, 50), (10, 50), (2, 200)):
        got = index.page(number, size).collect()
        assert [(r.id, r.v) for r in got] == want[number * size : (number + 1) * size] and [r.place for r in got] == list(range(number * size, min(500, (number + 1) * size)))
    assert [(r.id, r.v) for r in index.after(97, 3).collect()] == want[98:101] and index.after(499, 5).count() == 0
    assert re.search(r"PartitionFilters: \[range_#\d+L? IN \(", index.page(3, 10)._jdf.queryExecution().toString())
    empty = paging.PageIndex(spark.createDataFrame([], "id int, v int"), [F.col("id")])
    assert empty.total == 0 and empty.page(0, 10).count() == 0


def test_version_is_of_the_rows_not_of_their_order(spark):
    rows = [(str(k), f"l{k % 3}", 0.3 if k % 2 else 1.0) for k in range(300)]
    of = lambda some, parts: spark.createDataFrame(some, "id string, label string, weight double").repartition(parts).agg(stats.version(F.col("id"), F.col("label"), F.col("weight")).alias("v")).first().v
    first = of(rows, 1)
    assert len(first) == 10 and of(rows[::-1], 7) == first
    assert len({first, of(rows[1:], 1), of([*rows, rows[0]], 1), of([("0", "l0", 0.3), *rows[1:]], 1), of([("0", None, 1.0), *rows[1:]], 1), of([], 1)}) == 6
    assert "collect_list" not in spark.createDataFrame(rows, "id string, label string, weight double").agg(stats.version(F.col("id"), F.col("label"), F.col("weight")))._jdf.queryExecution().toString()


LOG = "seq long, field string, source string, by string, action string, activity_id string, merchant string, value string, note string, check boolean, confidence double, rule_id string, reverts long"


def test_numbers_of_many_entries(spark):
    log = spark.createDataFrame([(7, "spender", "user", "me", "a", "1", None, "x", None, None, None, None, None)], LOG)
    entries = spark.range(5000).select(F.sha1(F.col("id").cast("string")).alias("activity_id"), F.lit("spender").alias("field")).repartition(9)
    found = decisions.appended(log, entries, ["activity_id"]).where("seq > 7").select("seq", "activity_id").collect()
    assert sorted(r.seq for r in found) == list(range(8, 5008))
    assert [r.activity_id for r in sorted(found)] == sorted(r.activity_id for r in found)
    assert decisions.appended(log, entries.limit(0), ["activity_id"]).count() == 1


def test_a_name_that_is_given_again_adds_nothing(spark):
    log = spark.createDataFrame([], LOG)
    once = decisions.renamed(log, ["ACME", "BOLT"], " Shop ", "me", "a1")
    assert once.count() == 2
    again = decisions.renamed(once, ["ACME", "CORP"], "Shop", "me", "a2")
    assert sorted(r.merchant for r in again.where("action = 'a2'").collect()) == ["CORP"]
    assert decisions.renamed(again, ["ACME"], "ACME", "me", "a3").where("action = 'a3'").first().value is None


def brute_before(facts, seen, strict):
    out = []
    for k, at in facts:
        known = [(d, v) for key, d, v in seen if key == k and at is not None and (d < at if strict else d <= at)]
        out.append((k, at, max(known)[1] if known else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("strict", [True, False])
def test_as_of_on_a_hot_key(spark, strict):
    rng = random.Random(5)
    key = lambda: rng.choice(["hot"] * 4 + ["a", "b", None])
    facts = [(key(), rng.randrange(9000)) for _ in range(300)] + [("hot", None), ("none", 4), ("hot", 50), ("hot", 50)]
    seen = [(key(), rng.randrange(9000), rng.randrange(100)) for _ in range(60)] + [("hot", 50, 1), ("hot", 50, 9)]
    found = asof.before(spark.createDataFrame(facts, "k string, at int"), spark.createDataFrame(seen, "k string, d int, v int"), ["k"], "at", "d", strict)
    assert sorted(((r.k, r["at"], r.v) for r in found.collect()), key=str) == brute_before(facts, seen, strict)
    assert "hashpartitioning(k" in found._jdf.queryExecution().toString() and "cell_" in found._jdf.queryExecution().toString()


def test_zero_balances_and_near_purchases(spark):
    sources = spark.createDataFrame([("s", "A", "p", 0, "2024-02-01"), ("t", "B", "p", 0, "2024-02-01")], "source_id string, account_id string, purchase_account string, balance int, balance_day string").withColumn("balance_day", F.to_date("balance_day"))
    snapshots = spark.createDataFrame([("A", "2024-01-20", "X", 55), ("B", "2024-01-20", "X", 70), ("A", "2024-01-25", "CALCULATED", 1)], "account_id string, day string, kind string, cash int").select("account_id", F.to_date("day").alias("day"), "kind", F.col("cash").cast("decimal(28,10)").alias("cash"))
    bought = spark.createDataFrame([("p", "2024-01-14", "-55.04"), ("p", "2024-01-12", "-70"), ("q", "2024-01-30", "-70")], "source_id string, posted_day string, amount string").select("source_id", F.to_date("posted_day").alias("posted_day"), F.col("amount").cast("decimal(18,2)").alias("amount"))
    assert [tuple(map(str, r)) for r in balances.unexplained_zeros(sources, snapshots, bought).collect()] == [("t", "2024-01-20")]


def test_sums_after_random_actions_and_undos_are_those_of_a_full_fit(spark, tmp_path):
    rng = random.Random(12)
    rows = [(str(k), f"M{k % 5}", rng.choice(["d0", None]), rng.choice(["c0", None, None]), [f"m:M{k % 5}", f"amt:{k % 3}", "amt:0"]) for k in range(60)]
    table = spark.createDataFrame(rows, "id string, merchant string, account_value string, cardmember_value string, features array<string>")
    log = spark.createDataFrame([], LOG)
    store = Store(spark, str(tmp_path))
    with store.begin() as t:
        t.create(upkeep.TABLE, upkeep.sums(upkeep.examples(table, log)), upkeep.KEYS, 4)
    entries, seq = [], 0
    for action in range(4):
        new = []
        for _ in range(rng.randrange(1, 5)):
            seq += 1
            if entries and rng.random() < 0.35:
                new.append((seq, "spender", None, "me", f"a{action}", None, None, None, None, None, None, None, rng.choice(entries)[0]))
            else:
                of_row = rng.random() < 0.5
                new.append((seq, "spender", "user" if of_row else "merchant", "me", f"a{action}", str(rng.randrange(60)) if of_row else None, None if of_row else f"M{rng.randrange(5)}", rng.choice(["u", "v", None]), None, rng.random() < 0.2, None, None, None))
        upkeep.keep_up(store, table, spark.createDataFrame(entries, LOG), spark.createDataFrame(new, LOG), seq)
        if action == 1:  # twice: passed over
            upkeep.keep_up(store, table, spark.createDataFrame(entries, LOG), spark.createDataFrame(new, LOG), seq)
        entries += new
    content = lambda df: sorted(map(str, df.select(*upkeep.KEYS, "weight", "seen").collect()))
    stored = store.read(upkeep.TABLE)
    assert content(stored) == content(upkeep.sums(upkeep.examples(table, spark.createDataFrame(entries, LOG))))
    whole, part = upkeep.model(stored, ["u", "v", "d0", "c0"]), upkeep.model(stored, ["u", "v", "d0", "c0"], held=0)
    assert whole.weight >= part.weight and whole.vocabulary >= part.vocabulary


def test_rows_of_equal_features_are_scored_once(spark):
    rng = random.Random(4)
    rows = [(str(k), None if k % 40 == 0 else [f"m:M{k % 7}", f"dow:{rng.randrange(3)}", *([None] if k % 30 == 0 else [])], "LR"[k % 7 > 2], 1.0) for k in range(400)]
    table = spark.createDataFrame(rows, "id string, features array<string>, label string, weight double")
    model = naive_bayes.fit(table, ["L", "R"])
    want = {r.id: (r.guess, round(r.posterior, 9)) for r in naive_bayes.best(naive_bayes.scores(table, model)).collect()}
    assert {r.id: (r.guess, round(r.posterior, 9)) for r in naive_bayes.guesses(table, model).collect()} == want and len(want) == 400
    _, patterns = naive_bayes._patterns(table.select("id", F.lit(0).alias("model"), "features"))
    assert patterns.count() == len({str(r[1]) for r in rows})
    held = naive_bayes.out_of_fold(table, ["L", "R"])
    assert held.count() == 400 and {(r.id, r.truth) for r in held.collect()} == {(r[0], r[2]) for r in rows}
    names = spark.createDataFrame([(f"n{k}",) for k in range(50)] + [(None,), ("",)], "name string")
    import hashlib

    assert all(r.fold == (None if r.name is None else int(hashlib.sha1(r.name.encode()).hexdigest(), 16) % 5) for r in names.withColumn("fold", stats.fold(F.col("name"))).collect())


def test_small_ranges_are_made_larger_where_there_are_many(spark):
    index = paging.PageIndex(spark.range(6000).repartition(3), [F.col("id")], 2)
    assert index.total == 6000 and len(index.ranges) <= paging.MANY
    assert [r.id for r in index.page(299, 10).collect()] == list(range(2990, 3000)) and [r.id for r in index.after(5997, 9).collect()] == [5998, 5999]


def test_repeated_positions_are_told_by_their_ids(spark):
    rows = [("a", "1", 1), ("a", "2", 2), ("b", "1", 1), ("b", "1", 1), ("c", None, 3), ("d", "2", 5)]
    table = spark.createDataFrame(rows, "source_id string, position_id string, value int").select("*", F.lit("X").alias("symbol"), F.lit("X").alias("description"))
    table = table.withColumn("value", F.col("value").cast(money.MONEY))
    accounts = table.groupBy("source_id").agg(F.sum("value").alias("balance")).unionByName(spark.createDataFrame([("e", 0)], "source_id string, balance int").withColumn("balance", F.col("balance").cast("decimal(38,10)")))
    assert {r.source_id for r in holdings.repeated_positions(table).collect()} == {"b", "c"}
    got = holdings.reconciled(table, accounts)
    assert {r.source_id: r.ok for r in got.collect()} == {"a": True, "b": False, "c": False, "d": True, "e": True}
    assert "Expand" not in got._jdf.queryExecution().toString()
