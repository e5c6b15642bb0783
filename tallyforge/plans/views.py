"""Work queue, audit, predictions, status and rule lists over resolved rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Orders of the queue (aggregate, larger first) and sort keys of predictions.
ORDERS = {
    "impact": ("value", True), "low-confidence": ("confidence", False), "high-confidence": ("confidence", True), "newest": ("last", True),
    "oldest": ("first", False), "amount": ("total", True), "merchant": ("key", False),
}
SORTS = ("date", "description", "account", "amount", "category", "needWant", "value", "confidence")
ORIGINS = {"labeling serve": "You", "coordinator for user": "You", "categorizer agent": "Categorizer agent", "labeling llm": "Local LLM"}
BY_SOURCE = {"model": "Spender model", "account": "Account default", "cardmember": "Card issuer", "app-ui": "You (in the app)"}


def unlabeled(rows: DataFrame) -> Column:
    """Counts as spending, has no event of someone else's, and no label."""
    return (F.coalesce("visible_amount", F.lit(1.0)) != 0) & ~F.coalesce("foreign_event", F.lit(False)) & F.col("label").isNull()


def incomplete(rows: DataFrame) -> Column:
    """Unlabeled, or labelled by hand without a category."""
    by_hand = F.col("label_source").isin("user", "merchant", "app-ui") & (F.size("category_ids") == 0)
    return unlabeled(rows) | ((F.coalesce("visible_amount", F.lit(1.0)) != 0) & ~F.coalesce("foreign_event", F.lit(False)) & F.coalesce(by_hand, F.lit(False)))


def queue(rows: DataFrame, order: str = "impact", defer: list[str] | None = None) -> DataFrame:
    """Merchants with work left: id, name, merchant, amount, day, guess_confidence, posterior, label columns.

    Confidence is the mean over a merchant's rows, weighted by amount. Ids are in the order of the rows' ``ord``.
    Merchants that match a ``defer`` pattern come last.
    """
    open_rows = rows.where(incomplete(rows))
    key = F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("#"), F.col("id").cast("string")))
    amount = F.abs(F.coalesce(F.col("amount").cast("double"), F.lit(0.0)))
    weight = F.greatest(amount, F.lit(0.01))
    value = F.when(unlabeled(rows), (1 - F.col("guess_confidence")) * amount).otherwise(amount)
    mean = lambda c: (F.sum(weight * F.col(c)) / F.sum(weight)).alias(c)
    groups = open_rows.groupBy(key.alias("key")).agg(
        F.count("*").alias("rows"), F.sum(value).alias("value"), F.sum(amount).alias("total"), F.min("day").alias("first"), F.max("day").alias("last"),
        mean("guess_confidence"), mean("posterior"), F.collect_set(F.coalesce(F.nullif("merchant", F.lit("")), key)).alias("keys"), F.min("ord").alias("ord"),
    )
    groups = groups.withColumn("confidence", F.struct("guess_confidence", "posterior"))
    field, down = ORDERS.get(order, ORDERS["impact"])
    late = F.exists("keys", lambda k: k.rlike("|".join(f"(?:{p})" for p in defer))) if defer else F.lit(False)
    by = F.col(field).desc() if down else F.col(field).asc()
    return groups.withColumn("deferred", late).orderBy("deferred", by, "ord").drop("ord", "confidence")


def check_sample(rows: DataFrame, accounts: list[str], size: int = 100) -> DataFrame:
    """A fixed sample of the rows of some accounts: the first by SHA-1 of the id."""
    return rows.where(F.col("account_id").isin(accounts)).orderBy(F.sha1(F.col("id").cast("string").cast("binary"))).limit(size)


def status(rows: DataFrame) -> DataFrame:
    """(band, rows) by label source; the model's by tenth of confidence."""
    tenth = F.format_number(F.floor(F.col("label_confidence") * 10) / 10, 1)
    band = F.when(F.col("label").isNull(), "unlabeled").when(F.col("label_source") == "model", F.concat(F.lit("model "), tenth, F.lit("+"))).otherwise(F.col("label_source"))
    return rows.groupBy(band.alias("band")).agg(F.count("*").alias("rows")).orderBy("band")


def origin(source: Column, by: Column) -> Column:
    """Who made a label."""
    pick = lambda names, key: F.try_element_at(F.create_map(*(F.lit(x) for p in names.items() for x in p)), key)
    return F.coalesce(pick(BY_SOURCE, F.coalesce(source, F.lit(""))), pick(ORIGINS, F.coalesce(by, F.lit(""))), F.nullif(by, F.lit("")), F.lit("unknown"))


def audit(rows: DataFrame, wanted: str = "", low: float = 0.0, high: float = 1.0, text: str = "", limit: int = 1000) -> DataFrame:
    """Labelled rows by originator, confidence (none counts as inside) and text; least confidence first."""
    found = rows.where(F.col("label").isNotNull() | (F.coalesce("category", F.lit("")) != ""))
    found = found.where(F.col("label_confidence").isNull() | F.col("label_confidence").between(low, high))
    if wanted:
        found = found.where((F.col("spender_origin") == wanted) | (F.col("category_origin") == wanted))
    if text:
        found = found.where(F.contains(F.upper(F.concat_ws("", "notes", "account", "name")), F.lit(text.upper())))
    return found.orderBy(F.coalesce("label_confidence", F.lit(1.0)), "name", "day", "id").limit(limit)


def origins(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode(F.array("spender_origin", "category_origin")).alias("origin")).where("origin is not null").distinct().orderBy("origin")


def predictions(rows: DataFrame, value: str = "", low: float = 0.0, high: float = 1.0, text: str = "", sort: str = "confidence", down: bool = False, offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of unlabeled rows outside the check set (held_out), sorted by one of SORTS."""
    found = rows.where(~F.coalesce("held_out", F.lit(False)) & unlabeled(rows) & F.col("guess_confidence").between(low, high))
    if value:
        found = found.where(F.col("guess") == value)
    if text:
        found = found.where(F.contains(F.upper(F.concat_ws(" ", "name", F.coalesce("notes", F.lit("")), "account")), F.lit(text.upper())))
    keys = {
        "date": [F.col("day")], "description": [F.upper(F.coalesce("notes", F.lit("")))], "account": [F.col("account")], "amount": [F.abs(F.col("amount").cast("double"))],
        "category": [F.coalesce("category", F.lit(""))], "needWant": [F.coalesce("need_want", F.lit(""))], "value": [F.col("guess")], "confidence": [F.col("guess_confidence"), F.col("posterior")],
    }[sort]
    return found.orderBy(*(k.desc() if down else k.asc() for k in keys), "ord").offset(offset).limit(min(limit, 500))


def need_want(rows: DataFrame, categories: DataFrame, group_of: DataFrame, meaning: dict[str, str]) -> DataFrame:
    """(id, need_want): of a row's categories in order, the first whose own group, or else parent's, is known."""
    parent = categories.join(group_of.select(F.col("category_id").alias("parent_id"), F.col("group_key").alias("parent_key")), "parent_id", "left")
    groups = categories.select("category_id").join(group_of, "category_id", "left").join(parent.select("category_id", "parent_key"), "category_id", "left")
    groups = groups.select("category_id", F.coalesce("group_key", "parent_key").alias("group")).where(F.col("group").isNotNull())
    found = rows.select("id", F.posexplode("category_ids").alias("pos", "category_id")).join(groups, "category_id")
    first = found.groupBy("id").agg(F.min_by("group", "pos").alias("group"))
    named = F.try_element_at(F.create_map(*(F.lit(x) for p in meaning.items() for x in p)), F.col("group")) if meaning else F.lit(None).cast("string")
    return first.select("id", named.alias("need_want"))


def rules_list(rules: DataFrame, matched: DataFrame, log: DataFrame, rows: DataFrame) -> DataFrame:
    """All rules that decide labels: category rules with their matches, and names and spenders given to merchants."""
    from . import decisions

    entries = decisions.live(log)
    mine = entries.where("field = 'category' and rule_id is not null").groupBy("rule_id").agg(F.min_by("merchant", "seq").alias("of"))
    counts = matched.where("rule_id is not null").groupBy("rule_id").agg(F.count("*").alias("n"))
    found = rules.where("category_id is not null").join(mine, rules["id"] == mine["rule_id"], "left").drop("rule_id").join(counts, rules["id"] == counts["rule_id"], "left")
    pattern = F.when(F.col("of").isNotNull(), F.concat(F.lit("merchant "), "of")).otherwise(F.concat_ws(" ", "match", "pattern"))
    source = F.when(F.col("of").isNotNull(), "labeler (in the app)").when(F.col("preset_id").isNotNull(), "preset").otherwise("app")
    category = found.select("id", F.lit("Category").alias("kind"), F.col("category_id").alias("sets"), pattern.alias("pattern"), F.coalesce("n", F.lit(0)).alias("rows"), source.alias("source"))
    given = decisions.last_of(entries.where("merchant is not null and field in ('spender', 'merchant-name')").select("field", "merchant", "seq", "value"), "field", "merchant").where("coalesce(value, '') <> ''")
    keys = rows.groupBy("merchant").agg(F.count("*").alias("n"))
    given = given.join(keys, "merchant", "left")
    kind = F.when(F.col("field") == "spender", "Spender").otherwise("Name")
    by_merchant = given.select(F.concat_ws(":", "field", "seq").alias("id"), kind.alias("kind"), F.col("value").alias("sets"), F.concat(F.lit("merchant "), "merchant").alias("pattern"), F.coalesce("n", F.lit(0)).alias("rows"), F.lit("labeler").alias("source"))
    return category.unionByName(by_merchant)


def card(rows: DataFrame, most: int = 60) -> DataFrame:
    """The newest rows of one queue entry."""
    return rows.orderBy(F.col("day").desc(), "ord").limit(most)


def class_summary(examples: DataFrame, barely: int = 20) -> DataFrame:
    """(label, examples, merchants, barely_learned) of the training examples."""
    counts = examples.groupBy("label").agg(F.count("*").alias("examples"), F.count_distinct("merchant").alias("merchants"))
    return counts.withColumn("barely_learned", F.col("merchants") < barely)


def account_report(accounts: DataFrame) -> DataFrame:
    """Institutions and accounts in order, balances with two decimals, and each institution's number of accounts."""
    from pyspark.sql import Window

    count = F.count("*").over(Window.partitionBy("org"))
    return accounts.select("org", "name", "currency", F.format_number("balance", 2).alias("balance"), count.alias("accounts")).orderBy("org", "name")


def _votes(rows: DataFrame, value: str, name: str) -> DataFrame:
    """(name, votes): each different value of a card with its number, most frequent first, then by value."""
    counts = rows.where(F.col(value).isNotNull()).groupBy("name", value).agg(F.count("*").alias("n"))
    item = F.struct((-F.col("n")).alias("less"), F.col(value).alias("value"), "n")
    return counts.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n"))).alias(name))


def card_details(rows: DataFrame, most: int = 60) -> DataFrame:
    """Of each name with work left: rows, more than are shown, what is missing, dollars, labels elsewhere, all guesses with
    their numbers, the queue's confidence, and labels by hand with their numbers (as classes are few, so are the votes of a card).

    Only the name's rows that are in the queue count, but for ``elsewhere``.
    """
    left = incomplete(rows)
    own = rows.where(F.coalesce("name", F.lit("")) != "")
    inside = own.where(left)
    amount = F.abs(F.coalesce(F.col("amount").cast("double"), F.lit(0.0)))
    weight = F.greatest(amount, F.lit(0.01))
    sums = inside.groupBy("name").agg(
        F.count("*").alias("rows"), F.count_if(F.col("label").isNull()).alias("missing_label"), F.count_if(F.size("category_ids") == 0).alias("missing_category"), F.round(F.sum(amount), 2).alias("total"),
        F.round(F.sum(weight * F.col("guess_confidence")) / F.sum(weight), 3).alias("confidence"),
    )
    elsewhere = own.where(~left).groupBy("name").agg(F.count("*").alias("elsewhere"))
    by_hand = inside.where(F.col("label_source").isin("user", "merchant"))
    joined = sums.join(elsewhere, "name", "left").join(_votes(inside, "guess", "predicted"), "name", "left").join(_votes(by_hand, "label", "labelled"), "name", "left")
    return joined.withColumn("more", F.greatest(F.col("rows") - most, F.lit(0))).fillna(0, ["elsewhere"])


def explained(rows: DataFrame) -> DataFrame:
    """Rows with what a reader is told of the label and of the category: who (``_origin``), how (``_by``) and why (``_why``).

    rows: id, name, label_source, label_by, label_at, label_accepted, label_confidence, label_reasons, label_note;
    category_id, split (whether it is split), category_source (rule, manual or another), and of the rule that matches the
    row: rule_name, rule_category, rule_pattern, rule_preset; category_entry (source, by): the log's last category
    decision on that rule or row. Without a label or category the columns are null.
    """
    source = F.col("label_source")
    name, percent = F.coalesce("name", F.lit("")), F.round(F.coalesce("label_confidence", F.lit(0.0)) * 100).cast("int").cast("string")
    of = lambda texts: F.coalesce(*(F.when(source == k, v) for k, v in texts.items()))
    by = of({
        "merchant": F.concat(F.lit("all of "), name), "user": F.when(F.coalesce("label_accepted", F.lit(False)), "this row (accepted prediction)").otherwise("this row"),
        "app-ui": F.lit("set in the app"), "account": F.lit("account default"), "cardmember": F.lit("cardmember on statement"), "model": F.concat(F.lit("model "), percent, F.lit("%")),
    })
    why = of({
        "merchant": F.concat(F.lit("a rule for every charge of "), name), "user": F.lit("labelled by hand, this row only"), "app-ui": F.lit("edited in the app, which wins"),
        "account": F.lit("the account's default"), "cardmember": F.lit("the issuer's file names the cardmember"), "model": F.lit("the model's prediction"),
    })
    extra = F.concat(
        F.coalesce(F.concat(F.lit(" · set "), F.substring(F.col("label_at").cast("string"), 1, 10)), F.lit("")),
        F.coalesce(F.array_join(F.transform("label_reasons", lambda r: F.concat(F.lit(" · "), r)), ""), F.lit("")),
        F.coalesce(F.concat(F.lit(" · note: "), F.nullif("label_note", F.lit(""))), F.lit("")),
    )
    found = rows.withColumns({"label_origin": F.when(source.isNotNull(), origin(source, F.col("label_by"))), "label_said_by": by, "label_why": F.concat(why, extra)})
    split, by_rule = F.coalesce("split", F.lit(False)), F.col("category_source") == "rule"
    ours = F.coalesce(F.col("rule_category") == F.col("category_id"), F.lit(False))
    preset = ours & F.coalesce("rule_preset", F.lit(False))
    has = split | F.col("category_id").isNotNull()
    kind = F.coalesce(F.nullif("category_source", F.lit("")), F.lit("manual"))
    told = F.when(F.col("category_entry").isNotNull(), origin(F.col("category_entry.source"), F.col("category_entry.by")))
    who = F.when(split, "the app").when(by_rule, F.coalesce(F.when(ours, told), F.when(preset, "app preset"), F.lit("app rule"))).otherwise(F.coalesce(told, F.lit("You (in the app)")))
    reason = (
        F.when(by_rule & ours, F.concat(F.lit("rule '"), "rule_name", F.lit("' ("), "rule_pattern", F.lit(")")))
        .when(by_rule, "a rule that no longer matches this row")
        .when(kind == "manual", "set by hand")
        .otherwise(F.concat(F.lit("source: "), kind))
    )
    return found.withColumns({
        "category_origin": F.when(has, who), "category_said_by": F.when(has, F.when(split, "split").when(by_rule, F.when(preset, "preset").otherwise("rule")).otherwise(kind)),
        "category_why": F.when(has, F.when(split, "split across categories").otherwise(F.concat(reason, F.lit(" · originator: "), who))),
    })
