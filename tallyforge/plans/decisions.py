"""The append-only log of decisions, and the labels that follow from it.

An entry: seq, at, field, source, by, action, activity_id, merchant, value, note, check, accepted, confidence, model,
rule_id, reverts. A null value is a decision too: an explicit clear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch

#: The strength of each source.
RANK = {"user": 4, "app-ui": 4, "merchant": 3, "cardmember": 2, "account": 1, "model": 0}
#: Weights of training examples by source.
TRAIN_WEIGHT = {"user": 1.0, "app-ui": 1.0, "merchant": 1.0, "cardmember": 0.3, "account": 0.3}


def rank(source: Column) -> Column:
    chosen = None
    for name, strength in RANK.items():
        chosen = F.when(source == name, strength) if chosen is None else chosen.when(source == name, strength)
    return chosen


def live(log: DataFrame) -> DataFrame:
    """Entries that are neither reverted nor revert another."""
    reverted = log.where("reverts is not null").select(F.col("reverts").alias("seq")).distinct()
    return log.where("reverts is null").join(reverted, "seq", "left_anti")


def history(log: DataFrame) -> DataFrame:
    """All decisions with whether they have been reverted."""
    reverted = log.where("reverts is not null").select(F.col("reverts").alias("seq")).distinct().withColumn("gone", F.lit(True))
    return log.where("reverts is null").join(reverted, "seq", "left").withColumn("reverted", F.coalesce("gone", F.lit(False))).drop("gone")


def last_of(entries: DataFrame, *keys: str) -> DataFrame:
    """The newest entry of each key."""
    rest = [c for c in entries.columns if c not in (*keys, "seq")]
    last = entries.groupBy(*keys).agg(F.max_by(F.struct("seq", *rest), "seq").alias("e"))
    return last.select(*keys, "e.seq", *(F.col(f"e.{c}") for c in rest))


def names(log: DataFrame) -> DataFrame:
    """(merchant, name): display names in force; a blank one takes the name away."""
    given = live(log).where("field = 'merchant-name' and merchant is not null")
    return last_of(given.select("merchant", "seq", "value"), "merchant").where("coalesce(value, '') <> ''").select("merchant", F.col("value").alias("name"))


def candidates(rows: DataFrame, log: DataFrame, field: str = "spender") -> DataFrame:
    """(id, source, value, seq, check, confidence) of all live decisions on a row or on its merchant."""
    entries = live(log).where(F.col("field") == field).select("activity_id", F.col("merchant").alias("of"), "source", "value", "seq", F.coalesce("check", F.lit(False)).alias("check"), "confidence")
    by_row = rows.select("id").join(entries.where("activity_id is not null"), F.col("id") == F.col("activity_id"))
    by_merchant = rows.select("id", "merchant").join(entries.where("of is not null"), F.col("merchant") == F.col("of"))
    columns = ["id", "source", "value", "seq", "check", "confidence"]
    return by_row.select(*columns).unionByName(by_merchant.select(*columns))


def strongest(entries: DataFrame, key: str) -> DataFrame:
    """(key, entry): the strongest and then newest live decision of each row or merchant, one row a key."""
    entry = F.struct(rank(F.col("source")).alias("rank"), F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), "source", "value", F.col("confidence").cast("double").alias("confidence"))
    return entries.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(entry, F.struct(entry["rank"], entry["seq"])).alias("entry"))


def resolve(rows: DataFrame, log: DataFrame, training: bool = False, threshold: float | None = None) -> DataFrame:
    """rows (id, merchant, account_value, cardmember_value, guess, guess_confidence) with label_source and label.

    The strongest source wins, then the newest decision. A null decision of a weaker source still masks what is below
    it and leaves the row without a label; that of a user is a label of its own (label_source set, label null).
    ``threshold``: guesses of at least that confidence count. ``training``: neither guesses nor blind checks do.

    The log is reduced to one entry for each row and each merchant first (the order is total, so the strongest of the
    strongest is the strongest), and a row meets at most one of each kind.
    """
    entries = live(log).where("field = 'spender' and source <> 'model'")
    if training:
        entries = entries.where(~F.coalesce("check", F.lit(False)))
    entries = entries.select("activity_id", "merchant", "source", "value", "seq", "confidence")
    own = strongest(entries, "activity_id").select(F.col("activity_id").alias("own_key_"), F.col("entry").alias("own_entry_"))
    shared = strongest(entries, "merchant").select(F.col("merchant").alias("shared_key_"), F.col("entry").alias("shared_entry_"))
    joined = rows.join(own, F.col("id") == F.col("own_key_"), "left").join(shared, F.col("merchant") == F.col("shared_key_"), "left")

    def base(source: str, value: str, confidence: Column) -> Column:
        return F.struct(F.lit(RANK[source]).alias("rank"), F.lit(0).cast("long").alias("seq"), F.lit(source).alias("source"), F.col(value).alias("value"), confidence.alias("confidence"))

    none = F.lit(None).cast("double")
    defaults = [F.when(F.col("account_value").isNotNull(), base("account", "account_value", none)), F.when(F.col("cardmember_value").isNotNull(), base("cardmember", "cardmember_value", none))]
    if threshold is not None and not training:
        defaults.append(F.when(F.col("guess_confidence") >= threshold, base("model", "guess", F.col("guess_confidence").cast("double"))))
    best = joined.withColumn("best_", F.array_max(F.array_compact(F.array("own_entry_", "shared_entry_", *defaults))))
    counts = F.col("best_.value").isNotNull() | F.col("best_.source").isin("user", "app-ui")
    label = lambda name: F.when(counts, F.col(f"best_.{name}"))
    return best.select(*(F.col(f"`{c}`") for c in rows.columns), label("source").alias("label_source"), label("value").alias("label"), label("confidence").alias("label_confidence"))


def last_action(log: DataFrame, by: str) -> DataFrame:
    """The live entries of the author's newest action."""
    own = live(log).where(F.col("by") == by)
    newest = own.agg(F.max_by(F.coalesce("action", F.concat(F.lit("seq:"), F.col("seq"))), "seq").alias("newest"))
    return own.join(F.broadcast(newest), F.coalesce("action", F.concat(F.lit("seq:"), F.col("seq"))) == F.col("newest")).drop("newest")  # one row


def appended(log: DataFrame, entries: DataFrame, order: list[str]) -> DataFrame:
    """``log`` and the entries with the next seqs, in order; entries are what one action adds.

    The entries are sorted by range and written; a range's first number is the number of entries in the ranges before.
    """
    top = log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("top"))
    ranged = entries.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place_", F.monotonically_increasing_id())
    ranged = scratch.written(ranged, "entries").withColumn("range_", F.shiftright("place_", 33))
    before = F.sum("n").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    ends = ranged.groupBy("range_").agg(F.count(F.lit(1)).alias("n")).select("range_", F.coalesce(before, F.lit(0)).alias("before_"))
    numbered = ranged.join(F.broadcast(ends), "range_").crossJoin(F.broadcast(top))
    seq = F.col("top") + F.col("before_") + F.col("place_").bitwiseAND((1 << 33) - 1) + 1
    return log.unionByName(numbered.withColumn("seq", seq).drop("range_", "before_", "place_", "top"), allowMissingColumns=True)


def undone(log: DataFrame, by: str) -> DataFrame:
    """``log`` with reverts of the author's newest action."""
    entries = last_action(log, by).select("field", F.col("seq").alias("reverts"), F.lit(by).alias("by"))
    return appended(log, entries, ["reverts"])


def without_repeats(entries: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """Entries that do not repeat the last one of the same source on the same row or merchant (``key``)."""
    same = ["field", "source", key]
    last = last_of(live(log).where(F.col(key).isNotNull()).select(*same, "seq", "value", "note", "check"), *same)
    joined = entries.alias("e").join(last.alias("l"), [F.col(f"e.{c}") == F.col(f"l.{c}") for c in same], "left")
    repeat = F.col("l.seq").isNotNull()
    for c in ("value", "note", "check"):
        repeat = repeat & F.col(f"e.{c}").eqNullSafe(F.col(f"l.{c}"))
    return joined.where(~repeat).select("e.*")


def labelled(log: DataFrame, rows: DataFrame, value: str | None, by: str, action: str, ids: list[str] | None = None, merchant: str | None = None, note: str | None = None, check: bool | None = None) -> DataFrame:
    """``log`` with a decision on rows, or on all raw keys shown under a merchant's name (rows: id, merchant, name)."""
    lit = lambda x, kind: F.lit(x).cast(kind)
    common = [F.lit("spender").alias("field"), lit(value, "string").alias("value"), F.lit(by).alias("by"), F.lit(action).alias("action"), lit(note, "string").alias("note"), lit(check, "boolean").alias("check")]
    if merchant is not None:
        keys = rows.where((F.col("name") == merchant) & (F.col("merchant") != "")).select("merchant").distinct()
        entries, key = keys.select("merchant", F.lit("merchant").alias("source"), *common), "merchant"
    else:
        entries, key = rows.where(F.col("id").isin(ids or [])).select(F.col("id").alias("activity_id"), F.lit("user").alias("source"), *common), "activity_id"
    return appended(log, without_repeats(entries, log, key), [key])


def accepted(log: DataFrame, rows: DataFrame, items: DataFrame, by: str, action: str) -> DataFrame:
    """``log`` with predictions confirmed (items: id, value); their provenance only where the guess is still that value."""
    joined = items.join(rows.select("id", "guess", "guess_confidence"), "id")
    same = F.col("guess") == F.col("value")
    entries = joined.select(
        F.col("id").alias("activity_id"), F.lit("spender").alias("field"), F.lit("user").alias("source"), "value", F.lit(by).alias("by"), F.lit(action).alias("action"),
        F.lit(True).alias("accepted"), F.when(same, F.col("guess_confidence")).alias("confidence"), F.lit(None).cast("string").alias("note"), F.lit(None).cast("boolean").alias("check"),
    )
    return appended(log, without_repeats(entries, log, "activity_id"), ["activity_id"])


def renamed(log: DataFrame, merchants: list[str], name: str | None, by: str, action: str) -> DataFrame:
    """``log`` with a display name for raw merchant keys; a name that is the key itself, or blank, takes it away."""
    spark = log.sparkSession
    keys = spark.createDataFrame([(m,) for m in merchants], "merchant string")
    from ..functions.text import clean_name

    value = F.nullif(clean_name(F.lit(name).cast("string")), F.col("merchant"))
    entries = keys.select("merchant", F.lit("merchant-name").alias("field"), F.lit("merchant").alias("source"), value.alias("value"), F.lit(by).alias("by"), F.lit(action).alias("action"), F.lit(None).cast("string").alias("note"), F.lit(None).cast("boolean").alias("check"))
    return appended(log, without_repeats(entries, log, "merchant"), ["merchant"])


def external_edits(shown: DataFrame, applied: DataFrame, known_events: list[str]) -> DataFrame:
    """Rows whose shown value is not what was last written, apart from those with an event that is not ours.

    shown: id, event_id, value; applied: id, applied.
    """
    joined = shown.where(F.col("event_id").isNull() | F.col("event_id").isin(known_events)).join(applied, "id", "left")
    return joined.where(~F.col("value").eqNullSafe(F.col("applied"))).select("id", "value", "applied")


def changes(resolved: DataFrame, shown: DataFrame) -> DataFrame:
    """Rows to write: (id, desired, operation set or cleared) where the label differs from what is shown (id, value)."""
    joined = resolved.select("id", F.col("label").alias("desired")).join(shown.select("id", "value"), "id", "left")
    return joined.where(~F.col("desired").eqNullSafe(F.col("value"))).select("id", "desired", F.when(F.col("desired").isNull(), "cleared").otherwise("set").alias("operation"))
