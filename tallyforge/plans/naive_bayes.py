"""A naive-Bayes classifier whose statistics, scores, folds and calibration are DataFrame aggregations.

Examples: id, features (array), label, weight. Prior (p + 1) / (total + classes); likelihood
(c + 0.5) / (t + 0.5 (v + 1)); features never seen in training are ignored, repeated ones count each time.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..sources import scratch

ALPHA = 0.5
BINS = 10
#: Reasons seen fewer times rank below all others; reasons must make their class at least 25 % likelier.
STRONG, MIN_LIFT = 3, math.log(1.25)


@dataclass
class Statistics:
    """class_stats: label, ord, prior, total; feature_stats: label, feature, weight, seen; vocabulary size and weight of all."""

    classes: list[str]
    class_stats: DataFrame
    feature_stats: DataFrame
    vocabulary: int
    weight: float


def fit(examples: DataFrame, classes: list[str]) -> Statistics:
    """Sums by class and feature, from one pass over the examples: a class's own sums are those of a null feature."""
    spark = examples.sparkSession
    exploded = examples.select("label", "weight", F.explode(F.concat(F.array(F.lit(None).cast("string")), "features")).alias("feature"))
    sums = scratch.written(exploded.groupBy("label", "feature").agg(F.sum("weight").alias("weight"), F.count("*").alias("seen")), "classifier")
    features, prior = sums.where("feature is not null"), sums.where("feature is null").select("label", F.col("weight").alias("prior"))
    total = features.groupBy("label").agg(F.sum("weight").alias("total"))
    every = spark.createDataFrame([(c, k) for k, c in enumerate(classes)], "label string, ord int")
    by_class = every.join(prior, "label", "left").join(total, "label", "left").fillna(0.0, ["prior", "total"])
    size, weight = sums.agg(F.count_distinct("feature"), F.sum(F.when(F.col("feature").isNull(), F.col("weight")))).first()  # one row
    return Statistics(classes, by_class, features, size, weight or 0.0)


def _scored(rows: DataFrame, features: DataFrame, models: DataFrame, classes: list[str]) -> DataFrame:
    """(id, label, ord, posterior) of rows (id, model, features) by the model that each one names.

    features: model, feature, label, weight; models: model, vocabulary, weight, classes (array of prior and total in
    the order of ``classes``). A feature's weights are side by side in one row, so a row's features are joined once and
    summed once for all classes.
    """
    wide = features.groupBy("model", "feature").agg(*(F.ln((F.coalesce(F.sum(F.when(F.col("label") == c, F.col("weight"))), F.lit(0.0)) + ALPHA) / ALPHA).alias(f"g{k}") for k, c in enumerate(classes)))
    found = rows.select("id", "model", F.explode("features").alias("feature")).join(wide, ["model", "feature"])
    sums = found.groupBy("id").agg(F.count("*").alias("n"), F.array(*(F.sum(f"g{k}") for k in range(len(classes)))).alias("gains"))
    every = rows.select("id", "model").join(sums, "id", "left").join(F.broadcast(models), "model")  # a row a fold

    def log_score(k: int) -> Column:
        prior, total = F.col("classes")[k]["prior"], F.col("classes")[k]["total"]
        empty = F.ln(ALPHA / (total + ALPHA * (F.col("vocabulary") + 1)))
        return F.ln((prior + 1) / (F.col("weight") + len(classes))) + F.coalesce("n", F.lit(0)) * empty + F.coalesce(F.col("gains")[k], F.lit(0.0))

    scores = every.select("id", F.array(*(log_score(k) for k in range(len(classes)))).alias("s")).withColumn("top", F.array_max("s"))
    powers = scores.select("id", F.transform("s", lambda x: F.exp(x - F.col("top"))).alias("e"))
    whole = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    labels = F.array(*map(F.lit, classes))
    return powers.withColumn("whole", whole).select("id", "whole", F.posexplode("e").alias("ord", "e")).select("id", F.get(labels, F.col("ord")).alias("label"), "ord", (F.col("e") / F.col("whole")).alias("posterior"))


def _patterns(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` (model, features and others) and their different (id, model, features), written: rows of one pattern have one score."""
    different = rows.select("model", "features").distinct().withColumn("id", F.monotonically_increasing_id())
    return rows, scratch.written(different.select("id", "model", "features"), "patterns")


def _of_pattern(rows: DataFrame, patterns: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with what was ``found`` (id of the pattern and others) for their pattern."""
    kept = scratch.written(patterns.join(found, "id").select(F.col("model").alias("model_"), F.col("features").alias("features_"), *(c for c in found.columns if c != "id")), "pattern-scores")
    return rows.join(kept, (F.col("model") == F.col("model_")) & F.col("features").eqNullSafe(F.col("features_"))).drop("model_", "features_")


def guesses(rows: DataFrame, model: Statistics) -> DataFrame:
    """(id, guess, posterior) of rows (id, features), as ``best`` of their ``scores``; equal features are scored once."""
    asked, patterns = _patterns(rows.select("id", F.lit(0).alias("model"), "features"))
    return _of_pattern(asked, patterns, best(scores(patterns.select("id", "features"), model))).select("id", "guess", "posterior")


def scores(rows: DataFrame, model: Statistics) -> DataFrame:
    """(id, label, ord, posterior) of every row and class."""
    one = F.lit(0).alias("model")
    of_class = F.array_sort(F.collect_list(F.struct("ord", "prior", "total")))
    models = model.class_stats.agg(of_class.alias("classes")).select(one, F.lit(model.vocabulary).alias("vocabulary"), F.lit(model.weight).alias("weight"), "classes")
    return _scored(rows.select("id", one, "features"), model.feature_stats.select(one, "feature", "label", "weight"), models, model.classes)


def best(scored: DataFrame) -> DataFrame:
    """(id, guess, posterior): the likeliest class, the first as listed on a tie."""
    top = scored.groupBy("id").agg(F.max_by(F.struct("label", "posterior"), F.struct("posterior", -F.col("ord"))).alias("t"))
    return top.select("id", F.col("t.label").alias("guess"), F.col("t.posterior").alias("posterior"))


def reasons(rows: DataFrame, model: Statistics, scored: DataFrame, most: int = 3) -> DataFrame:
    """(id, reasons): the features that speak most for a row's class against the next one, with times seen.

    Features seen STRONG times or more come first; MIN_LIFT is the least that counts.
    """
    order = Window.partitionBy("id").orderBy(F.col("posterior").desc(), "ord")  # a row a class
    top = scored.withColumn("r", F.row_number().over(order)).where("r <= 2").groupBy("id").agg(F.max(F.when(F.col("r") == 1, F.col("label"))).alias("first"), F.max(F.when(F.col("r") == 2, F.col("label"))).alias("second"))
    totals = F.broadcast(model.class_stats.select("label", "total"))  # a row a class
    found = rows.select("id", F.explode(F.array_distinct("features")).alias("feature")).join(top, "id")
    for side in ("first", "second"):
        own = model.feature_stats.select("feature", F.col("label").alias(side), F.col("weight").alias(f"w_{side}"), F.col("seen").alias(f"n_{side}"))
        found = found.join(own, ["feature", side], "left").join(totals.select(F.col("label").alias(side), F.col("total").alias(f"t_{side}")), side)
    like = lambda s: F.ln((F.coalesce(f"w_{s}", F.lit(0.0)) + ALPHA) / (F.col(f"t_{s}") + ALPHA * (model.vocabulary + 1)))
    lifted = found.withColumn("lift", like("first") - like("second")).where((F.col("lift") >= MIN_LIFT) & (F.coalesce("n_first", F.lit(0)) > 0))
    item = F.struct((F.col("n_first") < STRONG).alias("weak"), (-F.col("lift")).alias("minus"), "feature", F.col("n_first").alias("seen"))
    ranked = lifted.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(item)), 1, most).alias("x"))
    return ranked.select("id", F.transform("x", lambda r: F.struct(r["feature"].alias("feature"), (-r["minus"]).alias("lift"), r["seen"].alias("seen"))).alias("reasons"))


def fold_column(features: Column, identity: Column) -> Column:
    """Fold of a row: by its merchant feature, so that a merchant is never on both sides, else by its id."""
    merchant = F.get(F.filter(features, lambda f: F.startswith(f, F.lit("m:"))), F.lit(0))
    return stats.fold(F.coalesce(merchant, identity.cast("string")))


def out_of_fold(examples: DataFrame, classes: list[str], k: int = 5) -> DataFrame:
    """(id, truth, guess, posterior): each example by a model that never saw its merchant.

    Sums by fold are taken once; the model of a held fold is what the other folds' sums make, so that features seen
    only in the held one are not in its vocabulary.
    """
    folded = scratch.written(examples.select("id", "features", "label", "weight", fold_column(F.col("features"), F.col("id")).alias("model")), "folded")
    every = F.explode(F.array(*map(F.lit, range(k)))).alias("held")

    def others(sums: DataFrame, keys: list[str]) -> DataFrame:
        """Weights and counts of all folds but the held one."""
        return sums.select("*", every).where("held <> model").groupBy("held", *keys).agg(F.sum("weight").alias("weight"), F.sum("seen").alias("seen")).withColumnRenamed("held", "model")

    count = F.count("*").alias("seen")
    features = others(folded.select("model", "label", "weight", F.explode("features").alias("feature")).groupBy("model", "label", "feature").agg(F.sum("weight").alias("weight"), count), ["label", "feature"])
    prior = others(folded.groupBy("model", "label").agg(F.sum("weight").alias("weight"), count), ["label"])
    total = features.groupBy("model", "label").agg(F.sum("weight").alias("total"))
    listed = examples.sparkSession.createDataFrame([(c, o, h) for o, c in enumerate(classes) for h in range(k)], "label string, ord int, model int")
    by_class = listed.join(prior.select("model", "label", F.col("weight").alias("prior")), ["model", "label"], "left").join(total, ["model", "label"], "left").fillna(0.0, ["prior", "total"])
    models = by_class.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("ord", "prior", "total"))).alias("classes"))
    size = features.groupBy("model").agg(F.count_distinct("feature").alias("vocabulary"))
    weight = prior.groupBy("model").agg(F.sum("weight").alias("weight"))
    models = models.join(size, "model").join(weight, "model").select("model", "vocabulary", "weight", "classes")
    asked, patterns = _patterns(folded.select("id", F.col("label").alias("truth"), "model", "features"))
    found = best(_scored(patterns, features.select("model", "feature", "label", "weight"), models, classes))
    return _of_pattern(asked, patterns, found).select("id", "truth", "guess", "posterior")


def calibrated(p: Column, slope: float, intercept: float) -> Column:
    return F.round(stats.sigmoid(slope * stats.logit(p) + intercept), 3)


def fit_calibration(pairs: DataFrame) -> tuple[float, float]:
    """Platt's slope and intercept for (posterior, correct).

    A logistic regression on the log odds, by Spark's own solver. Platt's smoothed targets are weights: a pair with
    target t is an example of class 1 with weight t and one of class 0 with weight 1 - t. Pairs of equal log odds
    are summed first.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    n, right = pairs.agg(F.count("*"), F.count_if("correct")).first()
    if not n:
        return 1.0, 0.0
    target = F.when(F.col("correct"), (right + 1) / (right + 2)).otherwise(1 / (n - right + 2))
    sums = pairs.groupBy(stats.logit(F.col("posterior")).alias("z")).agg(F.sum(target).alias("yes"), F.sum(1 - target).alias("no"))
    classes = F.array(*(F.struct(F.lit(label).alias("label"), F.col(weight).alias("weight")) for label, weight in ((1.0, "yes"), (0.0, "no"))))
    examples = VectorAssembler(inputCols=["z"], outputCol="features").transform(sums.select("z", F.inline(classes)))
    model = LogisticRegression(weightCol="weight", maxIter=200, tol=1e-12, standardization=False).fit(examples)
    return round(max(float(model.coefficients[0]), 1e-3), 6), round(float(model.intercept), 6)


def fit_calibrations(pairs: DataFrame, folds: int = 5, turns: int = 50) -> dict[int | None, tuple[float, float]]:
    """Platt's slope and intercept without each fold, and (None) of all, for (fold, posterior, correct): as ``fit_calibration``.

    Newton's method for all of them at once: every turn is one sum over the written counts by fold and log odds, whose
    result is one row.
    """
    z = stats.logit(F.col("posterior")).alias("z")
    counts = scratch.written(pairs.groupBy("fold", z).agg(F.count_if("correct").alias("r"), F.count_if(~F.col("correct")).alias("w")), "calibration")
    keys: list[int | None] = [*range(folds), None]
    used = {k: F.lit(True) if k is None else F.col("fold") != k for k in keys}
    sizes = counts.agg(*(F.coalesce(F.sum(F.when(used[k], F.col(c))), F.lit(0)).alias(f"{c}{i}") for i, k in enumerate(keys) for c in "rw")).first()
    at = {k: (0.0, math.log((sizes[f"r{i}"] + 1) / (sizes[f"w{i}"] + 1))) for i, k in enumerate(keys)}
    loss: dict[int | None, float] = {}
    step = {k: (0.0, 0.0) for k in keys}
    left = {k for i, k in enumerate(keys) if sizes[f"r{i}"] + sizes[f"w{i}"]}
    found: dict[int | None, tuple[float, float]] = {k: (1.0, 0.0) for k in keys if k not in left}
    for _ in range(turns):
        if not left:
            break
        wanted = []
        for k in sorted(left, key=str):
            i = keys.index(k)
            (a, b), right, wrong = at[k], sizes[f"r{i}"], sizes[f"w{i}"]
            n, margin = F.col("r") + F.col("w"), F.lit(a) * F.col("z") + b
            yes = F.col("r") * ((right + 1) / (right + 2)) + F.col("w") * (1 / (wrong + 2))
            p = stats.sigmoid(margin)
            off, curve = n * p - yes, n * p * (1 - p)
            cost = n * (F.greatest(margin, F.lit(0.0)) + F.log1p(F.exp(-F.abs(margin)))) - yes * margin
            parts = {"l": cost, "g0": off, "g1": off * F.col("z"), "h0": curve, "h1": curve * F.col("z"), "h2": curve * F.col("z") * F.col("z")}
            wanted += [F.sum(F.when(used[k], x)).alias(f"{c}{i}") for c, x in parts.items()]
        row = counts.agg(*wanted).first()
        for k in sorted(left, key=str):
            i = keys.index(k)
            cost, g0, g1, h0, h1, h2 = (row[f"{c}{i}"] for c in ("l", "g0", "g1", "h0", "h1", "h2"))
            if k in loss and cost > loss[k] + 1e-12 * abs(loss[k]):  # too far: half the way back
                step[k] = tuple(s / 2 for s in step[k])
                at[k] = tuple(x - s for x, s in zip(at[k], step[k], strict=True))
                continue
            loss[k] = cost
            h0, h2 = h0 + 1e-12, h2 + 1e-12
            det = h0 * h2 - h1 * h1
            move = (-(h0 * g1 - h1 * g0) / det, -(h2 * g0 - h1 * g1) / det) if det > 1e-18 else (0.0, -g0 / h0)
            step[k], at[k] = move, (at[k][0] + move[0], at[k][1] + move[1])
            if max(map(abs, move)) < 1e-9:
                left.discard(k)
                found[k] = at[k]
    found |= {k: at[k] for k in left}
    return {k: (round(max(a, 1e-3), 6), round(b, 6)) for k, (a, b) in found.items()}


def metrics(pairs: DataFrame, threshold: float) -> DataFrame:
    """One row: n, accuracy, coverage, precision (null if nothing is covered) and calibration error of (guess, confidence, truth)."""
    right, sure = (F.col("guess") == F.col("truth")).cast("int"), F.col("confidence") >= threshold
    bins = pairs.groupBy(F.least(F.floor(F.col("confidence") * BINS), F.lit(BINS - 1)).alias("bin")).agg(
        F.count("*").alias("n"), F.sum("confidence").alias("c"), F.sum(right).alias("r"), F.count_if(sure).alias("covered"), F.sum(F.when(sure, right)).alias("hit")
    )
    n = F.sum("n")
    return bins.agg(
        n.alias("n"), F.round(F.sum("r") / n, 3).alias("accuracy"), F.round(F.sum("covered") / n, 3).alias("coverage"),
        F.round(F.try_divide(F.sum("hit"), F.sum("covered")), 3).alias("precision"), F.round(F.sum(F.abs(F.col("c") - F.col("r"))) / n, 3).alias("calibration_error"),
    )


def threshold(pairs: DataFrame, precision: float = 0.95, least: int = 30) -> float | None:
    """The lowest confidence of 0.50 to 0.99 at which at least ``least`` guesses are covered with that precision."""
    cut = F.least(F.floor(F.round(F.col("confidence") * 100, 6)), F.lit(99)).cast("int")
    bins = pairs.where(F.col("guess").isNotNull() & (F.col("confidence") >= 0.5)).groupBy(cut.alias("cut")).agg(F.count("*").alias("n"), F.sum((F.col("guess").eqNullSafe(F.col("truth"))).cast("int")).alias("r"))
    counts = {r["cut"]: (r["n"], r["r"]) for r in bins.collect()}  # 50 rows at most
    covered = right = 0
    found = None
    for percent in range(99, 49, -1):
        n, r = counts.get(percent, (0, 0))
        covered, right = covered + n, right + r
        if covered >= least and right / covered >= precision:
            found = percent
    return None if found is None else found / 100


def may_apply(checked: DataFrame, limit: float, least: int = 30, precision: float = 0.95) -> bool:
    """Whether enough blind labels above the limit are right for guesses to be applied (guess, confidence, truth)."""
    n, right = checked.where(F.col("confidence") >= limit).agg(F.count("*"), F.sum((F.col("guess") == F.col("truth")).cast("int"))).first()
    return n >= least and right / n >= precision


def later_period(examples: DataFrame, share: float = 0.8) -> DataFrame:
    """Examples with ``later``: beyond the first int(share * n), in order of day and id.

    The cut is found from counts by day, and only its day's rows are ranked.
    """
    n = examples.count()
    cut = int(n * share)
    days = examples.groupBy("day").agg(F.count("*").alias("n"))
    upto = days.withColumn("upto", F.sum("n").over(Window.orderBy("day")))  # a row a day
    at = upto.where(F.col("upto") > cut).orderBy("day").limit(1).collect()
    if not at:
        return examples.withColumn("later", F.lit(False))
    day, before = at[0]["day"], at[0]["upto"] - at[0]["n"]
    on = examples.where(F.col("day") == day).withColumn("later", F.row_number().over(Window.partitionBy("day").orderBy("id")) > cut - before)
    return examples.where(F.col("day") != day).withColumn("later", F.col("day") > F.lit(day)).unionByName(on)
