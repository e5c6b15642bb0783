"""The classifier's sums kept up to date: what an action changes is added and subtracted, nothing is counted again.

Sums are rows (fold, label, feature, weight, seen), with a null feature for a class's own: weights are exact decimals, so that taking
away leaves what was there before. The rows whose training label an action can change are those of its entries, of
the entries that it reverts, and of their merchants; they are resolved before and after it, and only they.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import Store
from . import decisions, naive_bayes

WEIGHT = "decimal(28,4)"
KEYS = ["fold", "label", "feature"]
TABLE = "classifier_sums"


def sums(examples: DataFrame, sign: Column | None = None) -> DataFrame:
    """Sums of examples (id, features, label, weight); ``sign`` (1 or -1) says whether one is added or taken away."""
    sign = F.lit(1) if sign is None else sign
    fold = naive_bayes.fold_column(F.col("features"), F.col("id")).alias("fold")
    own = examples.select(fold, "label", F.col("weight").cast(WEIGHT).alias("weight"), sign.cast("int").alias("sign"), F.explode(F.concat(F.array(F.lit(None).cast("string")), "features")).alias("feature"))
    return own.groupBy(*KEYS).agg(F.sum(F.col("weight") * F.col("sign")).cast(WEIGHT).alias("weight"), F.sum("sign").cast("long").alias("seen"))


def added(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Sums after changes; what is not seen any more is gone."""
    both = stored.select(*KEYS, "weight", "seen").unionByName(changes.select(*KEYS, "weight", "seen"))
    total = both.groupBy(*KEYS).agg(F.sum("weight").cast(WEIGHT).alias("weight"), F.sum("seen").cast("long").alias("seen"))
    return total.where("seen <> 0")


def touched(rows: DataFrame, log: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows (with id and merchant) whose label new entries of the log may change."""
    reverted = log.join(entries.where("reverts is not null").select(F.col("reverts").alias("seq")).distinct(), "seq", "left_semi")
    named = entries.select("activity_id", "merchant").unionByName(reverted.select("activity_id", "merchant"))
    ids, merchants = (named.select(F.col(c).alias(k)).where(f"{k} is not null").distinct() for c, k in (("activity_id", "id"), ("merchant", "merchant")))
    found = rows.join(ids, "id", "left_semi").select("id").unionByName(rows.join(merchants, "merchant", "left_semi").select("id")).distinct()
    return rows.join(found, "id", "left_semi")


def examples(rows: DataFrame, log: DataFrame) -> DataFrame:
    """Training examples (id, features, label, weight) of rows (as for ``decisions.resolve``, with features)."""
    weight = None
    for source, w in decisions.TRAIN_WEIGHT.items():
        weight = F.when(F.col("label_source") == source, w) if weight is None else weight.when(F.col("label_source") == source, w)
    return decisions.resolve(rows, log, training=True).where("label is not null").select("id", "features", "label", weight.alias("weight")).where("weight is not null")


def changes(rows: DataFrame, log: DataFrame, entries: DataFrame) -> DataFrame:
    """What entries, appended to ``log``, add to the sums and take away from them."""
    some = touched(rows, log, entries)
    before = examples(some, log).withColumn("sign", F.lit(-1))
    after = examples(some, log.unionByName(entries, allowMissingColumns=True)).withColumn("sign", F.lit(1))
    return sums(before.unionByName(after), F.col("sign")).where("seen <> 0 or weight <> 0")


def keep_up(store: Store, rows: DataFrame, log: DataFrame, entries: DataFrame, mark: int) -> int:
    """Fold an action into the stored sums by one commit, once: an action up to the stored mark is passed over.

    Only sums that the action touches are read and written. mark: the entries' greatest seq.
    """
    with store.begin() as t:
        if mark > t.base.marks.get(TABLE, -1):
            delta = changes(rows, log, entries)
            stored = t.read(TABLE)
            same = lambda a, b: a["fold"].eqNullSafe(b["fold"]) & a["label"].eqNullSafe(b["label"]) & a["feature"].eqNullSafe(b["feature"])
            old = stored.join(delta.select(*KEYS), same(stored, delta), "left_semi")
            total = old.select(*KEYS, "weight", "seen").unionByName(delta.select(*KEYS, "weight", "seen")).groupBy(*KEYS).agg(F.sum("weight").cast(WEIGHT).alias("weight"), F.sum("seen").cast("long").alias("seen"))
            gone = total.where("seen = 0").select(*KEYS)
            t.upsert(TABLE, total.where("seen <> 0"))
            t.remove(TABLE, gone)
            t.mark(TABLE, mark)
    return t.next.version


def model(stored: DataFrame, classes: list[str], held: int | None = None) -> naive_bayes.Statistics:
    """The classifier of stored sums; without one fold, if it is held out."""
    used = stored if held is None else stored.where(F.col("fold") != held)
    whole = used.groupBy("label", "feature").agg(F.sum("weight").cast("double").alias("weight"), F.sum("seen").alias("seen"))
    features, prior = whole.where("feature is not null"), whole.where("feature is null").select("label", F.col("weight").alias("prior"))
    total = features.groupBy("label").agg(F.sum("weight").alias("total"))
    listed = stored.sparkSession.createDataFrame([(c, k) for k, c in enumerate(classes)], "label string, ord int")
    by_class = listed.join(prior, "label", "left").join(total, "label", "left").fillna(0.0, ["prior", "total"])
    size, weight = whole.agg(F.count_distinct("feature"), F.sum(F.when(F.col("feature").isNull(), F.col("weight")))).first()  # one row
    return naive_bayes.Statistics(classes, by_class, features, size, weight or 0.0)
