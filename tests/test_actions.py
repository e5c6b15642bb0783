"""Actions: categories by rule and by hand and back again, batches, removals, mode switches."""

from pyspark.sql import functions as F

from tallyforge.plans import actions
from tallyforge.sources import sinks

ROWS = "id string, merchant string, notes string, category_ids array<string>"


def world(spark):
    return spark.createDataFrame([("1", "ACME", "SQ *Acme", []), ("2", "ACME", "Acme", ["c1"]), ("3", "OTHER", "acme!", []), ("4", "ACME", "Acme", ["c2"]), ("5", "", "", [])], ROWS)


def test_categories_by_rule_and_back(spark):
    rows = world(spark)
    choices = spark.createDataFrame([("ACME", "c1", "why"), ("NOBODY", "c2", None)], "merchant string, category_id string, note string")
    own = choices.where("merchant = 'ACME'").select(actions.rule_of("rules", F.col("merchant")).alias("rule_id"), F.lit("{}").alias("rule"))
    entries, before = actions.categorised_keys(choices, rows, own, "me", "a1")
    assert {r.merchant: (r.filled, r.kept, r.previous_rule, r.note) for r in entries.collect()} == {"ACME": (2, 1, "{}", "why"), "NOBODY": (0, 0, None, None)}
    assert sorted((r.id, r.value, r.was) for r in before.collect()) == [("1", "c1", None), ("3", "c1", None)]
    filled = rows.join(before, "id", "left").withColumn("category_ids", F.when(F.col("value").isNotNull() & (F.col("id") != "3"), F.array("value")).otherwise(F.col("category_ids")))
    assert sorted((r.id, r.operation, r.category_id) for r in actions.row_inverses(before, filled).collect()) == [("1", "clear", None)]
    assert sorted(r.operation for r in actions.rule_inverses(entries).collect()) == ["delete", "restore"]


def test_categories_by_hand_and_back(spark):
    rows = world(spark)
    entries, before = actions.categorised_rows(spark.createDataFrame([("2", "c9"), ("5", "c9"), ("nope", "c9")], "id string, category_id string"), rows, "me", "a2")
    assert sorted(r.activity_id for r in entries.collect()) == ["2", "5"]
    after = rows.withColumn("category_ids", F.array(F.lit("c9")))
    assert sorted((r.id, r.operation, r.category_id) for r in actions.row_inverses(before, after).collect()) == [("2", "assign", "c1"), ("5", "clear", None)]


def test_batches_ask_again_what_is_open(spark):
    proposals = spark.createDataFrame([(f"m{k:02d}", "c") for k in range(7)], "merchant string, category_id string")
    done, seen = [], []

    def apply(batch):
        got = [r.merchant for r in batch.orderBy("merchant").collect()]
        seen.append(got)
        done.extend([*got, "m05"])  # something else categorises m05 meanwhile

    rounds = actions.applied_in_batches(proposals, lambda: proposals.where(~F.col("merchant").isin(done or [""])), apply, size=3)
    assert rounds == 3 and seen == [["m00", "m01", "m02"], ["m03", "m04"], ["m06"]]


def test_rules_and_modes(spark):
    rules = spark.createDataFrame([("r1", "{1}"), ("r2", "{2}")], "rule_id string, rule string")
    left, entries = actions.rules_removed(rules, rules.where("rule_id = 'r2'"), "me", "a3")
    assert [r.rule_id for r in left.collect()] == ["r1"]
    assert [(r.rule_id, r.operation, r.rule) for r in actions.rule_inverses(entries).collect()] == [("r2", "restore", "{2}")]
    current = spark.createDataFrame([(1, "T"), (2, "T"), (3, "T")], "id int, mode string")
    staged = spark.createDataFrame([(1, "H", True), (2, "H", None)], "id int, mode string, ok boolean")
    found = actions.switched(current, staged, lambda j: F.col("s.ok"))
    assert sorted((r.id, r.mode, r.rolled_back) for r in found.collect()) == [(1, "H", False), (2, "T", True), (3, "T", False)]
    assert actions.first_day(spark.createDataFrame([], "day date")).first()[0].isoformat() == "2000-01-01"


def test_a_swap_that_did_not_end_is_recovered(spark, tmp_path):
    path = f"{tmp_path}/state"
    sinks.swap(spark.range(3), path)
    sinks.swap(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and not sinks.recover(spark, path)
    (tmp_path / "state").rename(tmp_path / "state.old-1")  # the crash came between the two renames
    spark.range(7).write.parquet(f"{path}.new-2")
    assert sinks.recover(spark, path) and spark.read.parquet(path).count() == 7
