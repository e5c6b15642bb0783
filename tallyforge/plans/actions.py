"""Actions on labelled rows: what each one writes, adds to the log, and how it is taken back.

Rows: id, merchant, notes, category_ids (array), and what ``views`` needs. Category entries of the log carry rule_id and
previous_rule (the rule as JSON, null if there was none). What rows had before is a table beside the log, a row for each
of them (id, value, was), so that an action on any number of rows is never one large entry.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import money, text
from . import decisions, naive_bayes, paging, views


def rule_of(prefix: str, merchant: Column) -> Column:
    """The id of a merchant's own rule."""
    return money.uuid5(money.NAMESPACE_URL, F.concat(F.lit(f"{prefix}/"), merchant))


def rows_of_keys(choices: DataFrame, rows: DataFrame) -> DataFrame:
    """(merchant, id, own, category_ids): rows of each chosen merchant key, or whose notes have that key.

    A key's pattern matches the notes that have the key, so both ways are joins by equality; no row meets a pattern.
    """
    keys = choices.select("merchant").distinct()
    own = rows.where("merchant <> ''").select("merchant", "id", "category_ids").join(keys, "merchant")
    said = rows.select(text.merchant_key(F.col("notes")).alias("merchant"), "id", "category_ids").join(keys, "merchant")
    both = own.withColumn("own", F.lit(True)).unionByName(said.withColumn("own", F.lit(False)))
    return both.groupBy("merchant", "id").agg(F.max("own").alias("own"), F.first("category_ids").alias("category_ids"))


def categorised_keys(choices: DataFrame, rows: DataFrame, rules: DataFrame, by: str, action: str, prefix: str = "rules") -> tuple[DataFrame, DataFrame]:
    """A rule for each chosen merchant key (choices: merchant, category_id, note); rules: rule_id, rule (JSON).

    Gives the entries of the log, which name the rules to upsert, with the number of the merchant's rows that keep
    another category; and what rows had before (id, value, was), which are those that the rules fill: rules fill only
    rows without a category.
    """
    matched = rows_of_keys(choices, rows).join(choices.select("merchant", "category_id"), "merchant")
    empty = F.size("category_ids") == 0
    keeps = F.col("own") & ~empty & ~F.array_contains("category_ids", F.col("category_id"))
    sums = matched.groupBy("merchant").agg(F.count_if(empty).alias("filled"), F.count_if(keeps).alias("kept"))
    joined = choices.withColumn("rule_id", rule_of(prefix, F.col("merchant"))).join(sums, "merchant", "left").join(rules.select("rule_id", F.col("rule").alias("previous_rule")), "rule_id", "left")
    entries = joined.select(
        F.lit("category").alias("field"), F.lit("merchant").alias("source"), F.lit(by).alias("by"), F.lit(action).alias("action"), "merchant", F.col("category_id").alias("value"), "note",
        "rule_id", "previous_rule", F.coalesce("filled", F.lit(0)).cast("long").alias("filled"), F.coalesce("kept", F.lit(0)).cast("long").alias("kept"),
    )
    before = matched.where(empty).groupBy("id").agg(F.min_by("category_id", "merchant").alias("value")).withColumn("was", F.lit(None).cast("string"))
    return entries, before


def categorised_rows(choices: DataFrame, rows: DataFrame, by: str, action: str) -> tuple[DataFrame, DataFrame]:
    """Entries of the log for rows given a category by hand (choices: id, category_id), and what they had (id, value, was)."""
    joined = choices.join(rows.select("id", F.get("category_ids", F.lit(0)).alias("was")), "id")
    entries = joined.select(F.lit("category").alias("field"), F.lit("user").alias("source"), F.lit(by).alias("by"), F.lit(action).alias("action"), F.col("id").alias("activity_id"), F.col("category_id").alias("value"))
    return entries, joined.select("id", F.col("category_id").alias("value"), "was")


def rule_inverses(entries: DataFrame) -> DataFrame:
    """(rule_id, operation, rule): what undoing category and removed-rule entries does to rules."""
    own = entries.where("field in ('category', 'rule-removed') and rule_id is not null and (field = 'category' or previous_rule is not null)")
    return own.select("rule_id", F.when(F.col("previous_rule").isNotNull(), "restore").otherwise("delete").alias("operation"), F.col("previous_rule").alias("rule"))


def row_inverses(before: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, operation, category_id): rows that go back to the category they had, or to none if they still have the one given.

    before: id, value, was, of the action that is undone.
    """
    joined = before.join(rows.select("id", "category_ids"), "id", "left")
    still = F.coalesce(F.array_contains("category_ids", F.col("value")), F.lit(False))
    return joined.where(F.col("was").isNotNull() | still).select("id", F.when(F.col("was").isNotNull(), "assign").otherwise("clear").alias("operation"), F.col("was").alias("category_id"))


def rules_removed(rules: DataFrame, wanted: DataFrame, by: str, action: str) -> tuple[DataFrame, DataFrame]:
    """The rules (rule_id, rule) without the wanted ones, and the log's entries from which undo restores them."""
    gone = rules.join(wanted.select("rule_id").distinct(), "rule_id", "left_semi")
    entries = gone.select(F.lit("rule-removed").alias("field"), F.lit("user").alias("source"), F.lit(by).alias("by"), F.lit(action).alias("action"), "rule_id", F.col("rule").alias("previous_rule"))
    return rules.join(wanted.select("rule_id").distinct(), "rule_id", "left_anti"), entries


def labels_removed(log: DataFrame, wanted: DataFrame, by: str) -> DataFrame:
    """``log`` with reverts of live labels given to merchants (wanted: seq)."""
    own = decisions.live(log).where("field = 'spender' and merchant is not null").join(wanted.select("seq").distinct(), "seq", "left_semi")
    reverts = own.select("field", F.col("seq").alias("reverts"), F.lit(by).alias("by"), F.lit("removed among the rules").alias("note"))
    return decisions.appended(log, reverts, ["reverts"])


def found_or_created(wanted: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """The rows to insert so that every wanted key exists."""
    return wanted.dropDuplicates(keys).join(existing.select(*keys).distinct(), keys, "left_anti")


def first_day(rows: DataFrame, default: str = "2000-01-01") -> DataFrame:
    """One row: the first day of all rows, or the default without any."""
    return rows.agg(F.coalesce(F.min("day"), F.lit(default).cast("date")).alias("first_day"))


def asking_order(merchants: DataFrame) -> DataFrame:
    """Merchants (merchant, source) in the order in which they are asked about: categorised by hand first, then by SHA-1."""
    return merchants.orderBy((F.coalesce("source", F.lit("")) != "manual").asc(), F.sha1(F.col("merchant").cast("binary")))


def in_posted_order(rows: DataFrame) -> DataFrame:
    """Transactions by the time they were posted, equal ones by their position in the payload."""
    return rows.orderBy("posted", "position")


def without_basis(planned: DataFrame) -> DataFrame:
    """(source_id, positions, missing_basis): positions of each account, and those without an average cost."""
    return planned.groupBy("source_id").agg(F.count("*").alias("positions"), F.count_if(F.col("average_cost").isNull()).alias("missing_basis"))


def applied_in_batches(proposals: DataFrame, open_now: Callable[[], DataFrame], apply: Callable[[DataFrame], None], size: int = 50) -> int:
    """Apply proposals ``size`` at a time, in order of merchant; each batch keeps only merchants that are open by then.

    ``open_now`` reads the merchants still without a category again. Gives the number of batches. The merchants are
    sorted once, into an index whose pages are the batches; a batch is handed over as a table.
    """
    index = paging.PageIndex(proposals.select("merchant").where("merchant is not null").distinct(), [F.col("merchant").asc()])
    rounds = -(-index.total // size)
    for number in range(rounds):
        batch = index.page(number, size).select("merchant")
        still = batch.join(open_now().select("merchant").distinct(), "merchant", "left_semi")
        apply(proposals.join(still, "merchant", "left_semi"))
    return rounds


def switched(current: DataFrame, staged: DataFrame, accepted: Callable[[DataFrame], Column]) -> DataFrame:
    """Rows (id, mode) of ``staged`` where an account's observation is accepted, else as they are in ``current``.

    A mode changes with its observation or not at all: one that is rejected leaves the account's row as it was.
    """
    joined = current.alias("c").join(staged.alias("s"), "id", "left")
    good = F.col("s.mode").isNotNull() & F.coalesce(accepted(joined), F.lit(False))
    return joined.select("id", F.when(good, F.col("s.mode")).otherwise(F.col("c.mode")).alias("mode"), (F.col("s.mode").isNotNull() & ~good).alias("rolled_back"))


def evaluation(slices: dict[str, DataFrame], threshold: float) -> DataFrame:
    """(slice, n, accuracy, coverage, precision, calibration_error) of each named table of (guess, confidence, truth)."""
    out = None
    for name, pairs in slices.items():
        own = naive_bayes.metrics(pairs, threshold).select(F.lit(name).alias("slice"), "*")
        out = own if out is None else out.unionByName(own)
    return out


def label_slices(resolved: DataFrame) -> dict[str, DataFrame]:
    """The slices of an evaluation from rows with label_source, label, guess, guess_confidence, held_out and later.

    Labels by hand, cardmembers, the later period and the blind check set, each apart.
    """
    pairs = resolved.where("label is not null").select(F.col("guess"), F.col("guess_confidence").alias("confidence"), F.col("label").alias("truth"), "label_source", "held_out", "later")
    by_hand = F.col("label_source").isin("user", "app-ui", "merchant")
    wanted = {"labels": by_hand & ~F.col("held_out"), "cardmember": F.col("label_source") == "cardmember", "later": by_hand & F.col("later"), "check": by_hand & F.col("held_out")}
    return {name: pairs.where(some).select("guess", "confidence", "truth") for name, some in wanted.items()}


#: How a label's source is said.
SAID = {"merchant": "all of the merchant", "user": "this row", "app-ui": "set in the app", "account": "account default", "cardmember": "cardmember on statement"}


def row_views(resolved: DataFrame, blind: bool = False) -> DataFrame:
    """The wide row that is shown: ids and facts, label, who made it, how it is said, and the guess (null if blind)."""
    said = F.try_element_at(F.create_map(*(F.lit(x) for p in SAID.items() for x in p)), F.col("label_source"))
    said = F.when(F.col("label_source") == "model", F.concat(F.lit("model "), F.format_number(F.round(F.coalesce("label_confidence", F.lit(0.0)) * 100), 0), F.lit("%"))).otherwise(said)
    shown = lambda c: F.when(F.lit(not blind), F.col(c)).alias(c)
    return resolved.select(
        "id", "day", F.coalesce(F.col("amount").cast("double"), F.lit(0.0)).alias("amount"), "account", F.coalesce("notes", F.lit("")).alias("notes"), "merchant", "name",
        F.array_join("category_ids", ", ").alias("category"), F.col("label"), "label_source", F.when(F.col("label_source").isNotNull(), said).alias("label_said"), "label_confidence", shown("guess"), shown("guess_confidence"),
    )


def queue_counts(rows: DataFrame) -> DataFrame:
    """One row: groups, rows and dollars of the work left, and all rows."""
    left = rows.where(views.incomplete(rows))
    key = F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("#"), F.col("id").cast("string")))
    sums = left.agg(F.count_distinct(key).alias("groups"), F.count("*").alias("rows"), F.round(F.sum(F.abs(F.col("amount").cast("double"))), 2).alias("amount"))
    return sums.crossJoin(rows.agg(F.count("*").alias("total")))  # one row each


def card_summary(rows: DataFrame, most: int = 60) -> DataFrame:
    """Of each name with work left: keys, rows, more than are shown, what is missing, dollars, labels elsewhere, guesses.

    One aggregation over all rows gives every card's summary; the rows of one card are ``views.card``.
    """
    left = views.incomplete(rows)
    guesses = rows.where("name <> ''").where(left).groupBy("name", "guess").agg(F.count("*").alias("n"))
    top = guesses.groupBy("name").agg(F.max_by("guess", F.struct("n", "guess")).alias("predicted"))
    in_work = lambda c: F.count_if(left & c)
    sums = rows.where("name <> ''").groupBy("name").agg(
        F.array_sort(F.collect_set("merchant")).alias("keys"), F.count_if(left).alias("rows"), in_work(F.col("label").isNull()).alias("missing_label"), in_work(F.size("category_ids") == 0).alias("missing_category"),
        F.count_if(~left).alias("elsewhere"), F.round(F.sum(F.when(left, F.abs(F.col("amount").cast("double")))), 2).alias("total"),
    )
    return sums.where("rows > 0").withColumn("more", F.greatest(F.col("rows") - most, F.lit(0))).join(top, "name", "left")


def suggested_name(rows: DataFrame) -> DataFrame:
    """(name, suggestion): the most frequent payee of a merchant's rows, else of its export names, else the name itself."""

    def vote(column: str) -> DataFrame:
        counts = rows.where(F.coalesce(column, F.lit("")) != "").groupBy("name", column).agg(F.count("*").alias("n"), F.min("ord").alias("first"))
        return counts.groupBy("name").agg(F.max_by(column, F.struct("n", -F.col("first"))).alias(f"voted_{column}"))

    every = rows.select("name").where("name <> ''").distinct().join(vote("payee"), "name", "left").join(vote("export_name"), "name", "left")
    return every.select("name", F.coalesce("voted_payee", "voted_export_name", "name").alias("suggestion"))


def card_rules(listed: DataFrame, rows: DataFrame) -> DataFrame:
    """The rules (of ``views.rules_list``) that concern some rows (merchant, rule_id): by their merchant or their match."""
    keys = rows.select(F.concat(F.lit("merchant "), "merchant").alias("pattern")).distinct()
    matched = rows.where("rule_id is not null").select(F.col("rule_id").alias("id")).distinct()
    return listed.join(keys, "pattern", "left_semi").unionByName(listed.join(matched, "id", "left_semi")).distinct()
