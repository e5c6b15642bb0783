"""Category proposals of a local model for merchants: who to ask about, what to show, and how far to trust it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import selection
from ..sources import scratch
from . import naive_bayes


def uncategorized(rows: DataFrame) -> DataFrame:
    """(merchant, dollars) of merchants none of whose rows has a category or is a transfer, most dollars first."""
    flags = rows.where("merchant <> ''").groupBy("merchant").agg(F.max((F.size("category_ids") > 0) | F.startswith("kind", F.lit("TRANSFER"))).alias("known"), F.sum(F.abs(F.col("amount").cast("decimal(28,10)"))).cast("double").alias("dollars"))
    return flags.where("not known").select("merchant", "dollars").orderBy(F.col("dollars").desc(), "merchant")


def known(rows: DataFrame, allowed: list[str]) -> DataFrame:
    """(merchant, category_id, source) of merchants with exactly one category and no split; a category that is not
    allowed is null; source: manual if any row's is, else rule."""
    each = rows.where("merchant <> ''").select("merchant", "splits", "source", F.explode_outer("category_ids").alias("category_id"), "kind")
    sums = each.groupBy("merchant").agg(
        F.count_distinct("category_id").alias("n"), F.max("category_id").alias("category_id"), F.max("splits").alias("splits"),
        F.max((F.col("source") == "manual").cast("int")).alias("manual"), F.max(F.startswith("kind", F.lit("TRANSFER"))).alias("transfer"),
    )
    one = sums.where("n = 1 and splits = 0 and not transfer")
    return one.select("merchant", F.when(F.col("category_id").isin(allowed), F.col("category_id")).alias("category_id"), F.when(F.col("manual") == 1, "manual").otherwise("rule").alias("source"))


def top_values(rows: DataFrame, key: str, value: str, most: int = 5) -> DataFrame:
    """(key, values): the most frequent values of each key, the first seen (least ``ord``) on a tie."""
    counts = rows.where(F.coalesce(F.col(value).cast("string"), F.lit("")) != "").groupBy(key, value).agg(F.count("*").alias("n"), F.min("ord").alias("ord"))
    rank = Window.partitionBy(key).orderBy(F.col("n").desc(), "ord")
    return counts.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= most).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", value))), lambda x: x[value]).alias("values"))


def cards(rows: DataFrame) -> DataFrame:
    """What a model is shown of each merchant: no days, account names, numbers or categories."""
    own = rows.where("merchant <> ''")
    base = own.groupBy("merchant").agg(F.count("*").alias("transactions"))
    typical = selection.medians(own.select("merchant", F.abs(F.col("amount").cast("double")).alias("size")), "merchant", "size", "typical_amount")
    base = base.join(typical, "merchant", "left").withColumn("typical_amount", F.round("typical_amount", 2))
    for column, name in (("notes", "descriptions"), ("payee", "payees"), ("mcc", "mccs"), ("account_kind", "account_kinds"), ("kind", "kinds")):
        base = base.join(top_values(own, "merchant", column).withColumnRenamed("values", name), "merchant", "left")
    return base


def ask(asked: DataFrame, answered: DataFrame, model: Callable[[list[dict]], list[dict]]) -> DataFrame:
    """New answers (merchant, facts, category_id, p) for cards without one of the same facts.

    ``model`` takes and gives a list of dicts; it is called in the tasks, once for each batch of cards.
    """
    facts = stats.fingerprint(F.struct(*(c for c in asked.columns if c != "merchant")))
    new = asked.withColumn("facts", facts).join(answered.select("merchant", "facts"), ["merchant", "facts"], "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = model(frame.to_dict("records"))
            yield pd.DataFrame({"merchant": frame["merchant"], "facts": frame["facts"], "category_id": [x.get("category_id") for x in found], "p": [float(x["p"]) for x in found]})

    return new.mapInPandas(run, "merchant string, facts string, category_id string, p double")


def newest(answers: DataFrame, *keys: str) -> DataFrame:
    """The newest answer of each key, by ``at`` and then ``ord``."""
    rest = [c for c in answers.columns if c not in keys]
    last = answers.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("at", "ord")).alias("a"))
    return last.select(*keys, *(F.col(f"a.{c}") for c in rest))


def evaluated(answers: DataFrame, truth: DataFrame) -> tuple[DataFrame, tuple[float, float]]:
    """Held-out confidences (merchant, guess, confidence, truth, source) and the calibration of all answers.

    answers: merchant, p, category_id; truth: merchant, category_id, source. Each fold is calibrated by the others.
    """
    rows = answers.where("p is not null").select("merchant", F.col("p").alias("posterior"), F.col("category_id").alias("guess")).join(truth.withColumnRenamed("category_id", "truth"), "merchant")
    rows = rows.withColumn("fold", stats.fold(F.col("merchant"))).withColumn("correct", F.col("guess").eqNullSafe(F.col("truth")))
    rows = scratch.written(rows, "evaluated")
    fits = naive_bayes.fit_calibrations(rows.select("fold", "posterior", "correct"))
    pick = lambda k: F.coalesce(*(F.when(F.col("fold") == fold, fits[fold][k]) for fold in range(5)))
    z = pick(0) * stats.logit(F.col("posterior")) + pick(1)
    return rows.select("merchant", "guess", F.round(stats.sigmoid(z), 3).alias("confidence"), "truth", "source"), fits[None]


def chosen(proposals: DataFrame, rows: DataFrame, threshold: float | None) -> DataFrame:
    """Confident proposals for merchants none of whose rows has a category or is a transfer."""
    if threshold is None:
        return proposals.limit(0)
    open_merchants = uncategorized(rows).select("merchant")
    return proposals.where(F.col("category_id").isNotNull() & (F.col("confidence") >= threshold)).join(open_merchants, "merchant", "left_semi").orderBy("merchant")


def similar_votes(rows: DataFrame, merchant: str) -> DataFrame:
    """(category_id, votes) on other merchants' rows that share a word feature with the merchant's rows."""
    own = rows.where(F.col("merchant") == merchant)
    words = own.select(F.explode(F.filter("features", lambda f: F.startswith(f, F.lit("w:")))).alias("word")).distinct()
    others = rows.where(F.col("merchant") != merchant).select("id", "ord", "category_ids", F.explode(F.array_distinct("features")).alias("word"))
    hit = others.join(words, "word", "left_semi").select("id", "ord", "category_ids").distinct()
    return hit.select("ord", F.explode("category_ids").alias("category_id")).groupBy("category_id").agg(F.count("*").alias("votes"), F.min("ord").alias("ord")).orderBy(F.col("votes").desc(), "ord").drop("ord")


def suggested(rows: DataFrame, merchant: str, proposals: DataFrame, categories: DataFrame) -> DataFrame:
    """One row (category_id, why): used on the merchant, else proposed, else by shared words, else the first of the top level."""
    same = rows.where(F.col("merchant") == merchant).select("ord", F.explode("category_ids").alias("category_id")).groupBy("category_id").agg(F.count("*").alias("n"), F.min("ord").alias("ord"))
    ways = [
        same.orderBy(F.col("n").desc(), "ord").limit(1).select("category_id", F.lit(1).alias("way"), F.lit("already used on this merchant").alias("why")),
        proposals.where((F.col("merchant") == merchant) & F.col("category_id").isNotNull()).limit(1).select("category_id", F.lit(2).alias("way"), F.lit("local model").alias("why")),
        similar_votes(rows, merchant).limit(1).select("category_id", F.lit(3).alias("way"), F.lit("most used on merchants with the same words").alias("why")),
        categories.where("parent_id is null").orderBy(F.coalesce("sort_order", F.lit(0)), "category_id").limit(1).select("category_id", F.lit(4).alias("way"), F.lit("first category").alias("why")),
    ]
    every = ways[0]
    for way in ways[1:]:
        every = every.unionByName(way)
    return every.orderBy("way").limit(1).drop("way")
