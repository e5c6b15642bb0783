"""First matching rule of each row, as one flat CASE expression compiled from the rules."""

from __future__ import annotations

import math

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pattern_index


def compiles(spark, pattern: str) -> bool:
    """Whether the engine's regular expressions accept the pattern."""
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
        return True
    except IllegalArgumentException:
        return False


def condition(rule: dict, regex_ok: bool = True) -> Column:
    """Whether a rule matches a row with account_id, kind, amount and notes."""
    test = F.lit(True)
    if not rule.get("is_global"):
        test = test & F.coalesce(F.col("account_id") == F.lit(rule.get("account_id")), F.lit(False))
    if rule.get("kind"):
        test = test & (F.col("kind") == rule["kind"])
    if op := rule.get("amount_op"):
        size, low, high = F.abs(F.coalesce(F.col("amount").cast("double"), F.lit(0.0))), rule.get("amount_value"), rule.get("amount_value2")
        if low is None:
            return F.lit(False)
        test = test & {
            "eq": size == low, "gt": size > low, "gte": size >= low, "lt": size < low, "lte": size <= low,
            "between": size.between(low, high if high is not None else -math.inf),
        }[op]
    notes, pattern, kind = F.coalesce("notes", F.lit("")), rule.get("pattern") or "", rule.get("match")
    upper = F.upper(notes)
    if kind == "regex":
        return test & notes.rlike(pattern) if regex_ok else F.lit(False)
    text = {"contains": lambda: F.contains(upper, F.lit(pattern.upper())), "starts_with": lambda: F.startswith(upper, F.lit(pattern.upper())), "exact": lambda: upper == pattern.upper()}
    return test & text[kind]() if kind in text else F.lit(False)


def first_match(rows: DataFrame, rules: list[dict], name: str = "rule_id") -> DataFrame:
    """``rows`` with the id of the first rule that has a category and matches, by priority, then as listed.

    The rule list is configuration on the driver; a CASE stops at the first match, in generated code, without a join.
    """
    chosen = None
    for rule in sorted((r for r in rules if r.get("category_id")), key=lambda r: -(r.get("priority") or 0)):
        ok = rule.get("match") != "regex" or compiles(rows.sparkSession, rule.get("pattern") or "")
        test = condition(rule, ok)
        chosen = F.when(test, F.lit(rule["id"])) if chosen is None else chosen.when(test, F.lit(rule["id"]))
    return rows.withColumn(name, chosen if chosen is not None else F.lit(None).cast("string"))


def account_default(rows: DataFrame, accounts: dict[str, dict], name: str = "account_value") -> DataFrame:
    """``rows`` with the value of the account's first matching pattern, else the account's default.

    accounts: account id to {default, patterns: {regex: value}} in order.
    """
    chosen = None
    for account, setting in accounts.items():
        own = F.col("account_id").cast("string") == account
        for pattern, value in setting.get("patterns", {}).items():
            test = own & F.coalesce("notes", F.lit("")).rlike(pattern)
            chosen = F.when(test, value) if chosen is None else chosen.when(test, value)
        chosen = F.when(own, setting.get("default")) if chosen is None else chosen.when(own, setting.get("default"))
    return rows.withColumn(name, chosen if chosen is not None else F.lit(None).cast("string"))


def match_counts(matched: DataFrame, rules: DataFrame, name: str = "rule_id") -> DataFrame:
    """Each rule with the rows it decides."""
    counts = matched.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("rows"))
    return rules.join(counts, rules["id"] == counts[name], "left").drop(name).fillna(0, ["rows"])


def descriptions_matching(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """(key, id): rows whose own merchant key is the wanted one or whose notes match its pattern.

    patterns: key, pattern; any number of them, found by the literals that they have (``pattern_index``).
    """
    wanted = patterns.select(F.col("key").alias("wanted"), "pattern")
    by_key = rows.join(wanted.select("wanted"), F.col("merchant") == F.col("wanted")).select(F.col("wanted").alias("key"), "id")
    text = F.coalesce("notes", F.lit(""))
    fit = pattern_index.matches(rows.select(text.alias("text")), wanted.select(F.col("wanted").alias("id"), F.lit("regex").alias("match"), "pattern"))
    by_text = rows.join(fit.select("text", F.col("id").alias("key")), text == F.col("text")).select("key", "id")
    return by_key.unionByName(by_text).distinct()
