"""Many text patterns against many rows: an index from literals to patterns finds candidates, the pattern itself decides.

A pattern that matches a text has its literal in it, and so each three letters of the literal. Every pattern is filed
under the three letters that are rarest in the texts at hand; texts meet it there and nowhere else. Patterns without a
literal of three letters are kept in blocks, and each text is put to each block: a stated list against all texts.
Patterns are rows of a table; nothing of them goes through the driver but their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import scratch

#: Letters that a pattern is filed under; patterns of a block.
GRAM, BLOCK = 3, 256
#: A character that no pattern has.
_CUT = "\x00"
#: Escapes whose end is not told by two characters, and flags that change what letters match.
_LONG_ESCAPE = r"\\[xupPcN0kQE]|\(\?[a-zA-Z]*[ux]"


def compiles(pattern: Column) -> Column:
    """Whether the engine's regular expressions accept the pattern."""
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("matches"), pattern, F.lit("")).isNotNull()


def literal(pattern: Column) -> Column:
    """The longest text that every match of a regular expression has in it, in upper case; null if there is none.

    Escapes, classes, groups, quantifiers and what they apply to are cut out; an alternative outside groups leaves nothing.
    """
    text = F.regexp_replace(pattern, r"\\.", _CUT)
    text = F.regexp_replace(text, r"\[\^?\]?[^\]]*\]", _CUT)
    for _ in range(4):
        text = F.regexp_replace(text, r"\([^()]*\)", _CUT)
    text = F.regexp_replace(text, r"(?s).(?:[?*]|\{[^}]*\})", _CUT)
    text = F.regexp_replace(text, r"[.^$+?*{}\]]", _CUT)
    pieces = F.split(text, _CUT)
    longest = F.aggregate(pieces, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    good = ~pattern.rlike(_LONG_ESCAPE) & ~text.rlike(r"[|()\[]") & (F.length(longest) >= GRAM)
    return F.when(good, F.upper(longest))


def grams(text: Column) -> Column:
    """The different runs of GRAM letters."""
    last = F.length(text) - (GRAM - 1)
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


def _fits(kind: Column, pattern: Column, text: Column, upper: Column) -> Column:
    shout = F.upper(pattern)
    return (
        F.when(kind == "regex", F.rlike(text, pattern))
        .when(kind == "contains", F.contains(upper, shout))
        .when(kind == "starts_with", F.startswith(upper, shout))
        .when(kind == "exact", upper == shout)
        .otherwise(F.lit(False))
    )


def fitting(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(text, match, pattern) of all different texts (text) and different patterns (match, pattern; null is '') that fit.

    match: regex, contains, starts_with or exact; all but regex without regard to case. An expression that is none fits
    nothing, any other kind of match neither.
    """
    texts = texts.select("text").where("text is not null").distinct()
    kinds = patterns.where(F.col("match").isin("regex", "contains", "starts_with", "exact")).select("match", F.coalesce("pattern", F.lit("")).alias("pattern")).distinct()
    sound = kinds.where((F.col("match") != "regex") | compiles(F.col("pattern")))
    plain = F.upper("pattern")
    filed = sound.withColumn("literal", F.when(F.col("match") == "regex", literal(F.col("pattern"))).when(F.length(plain) >= GRAM, plain))
    keys = filed.where("literal is not null").select("match", "pattern", F.explode(grams(F.col("literal"))).alias("gram"))
    spread = texts.select("text", F.explode(grams(F.upper("text"))).alias("gram")).join(keys.select("gram").distinct(), "gram", "left_semi")
    counts = spread.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # three letters that no text has leave the pattern without a match
    rarest = keys.join(counts, "gram", "left").groupBy("match", "pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least"))
    rarest = rarest.where("least.n > 0").select("match", "pattern", F.col("least.gram").alias("gram"))
    found = spread.join(rarest, "gram").where(_fits(F.col("match"), F.col("pattern"), F.col("text"), F.upper("text"))).select("text", "match", "pattern")
    short = filed.where("literal is null").select("match", "pattern")
    blocks = -(-short.count() // BLOCK)
    if not blocks:
        return found
    packed = short.groupBy(F.pmod(F.xxhash64("match", "pattern"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("match", "pattern")).alias("block_patterns"))
    shout = F.upper("text")
    each = texts.crossJoin(packed).select("text", F.explode("block_patterns").alias("p"))  # blocks of a stated list
    return found.unionByName(each.where(_fits(F.col("p.match"), F.col("p.pattern"), F.col("text"), shout)).select("text", "p.match", "p.pattern"))


def matches(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(text, id) of all different texts (text) and patterns (id, match, pattern) that fit, as ``fitting``."""
    named = patterns.select("id", "match", F.coalesce("pattern", F.lit("")).alias("pattern"))
    return fitting(texts, patterns).join(named, ["match", "pattern"]).select("text", "id")


def choices(rows: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rules that texts may take, in order: (text_, shared_) for all accounts, (text__, account_, single_) for one; see ``first_match``."""
    text = F.coalesce("notes", F.lit(""))
    said = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    op = said("amount_op")
    asks = ["account", "of_kind", "op", "low", "high"]
    usable = rules.where(F.coalesce("category_id", F.lit("")) != "").withColumn("everyone", F.coalesce("is_global", F.lit(False))).where("everyone or account_id is not null").select(
        "match", F.coalesce("pattern", F.lit("")).alias("pattern"), F.when(~F.col("everyone"), F.col("account_id").cast("string")).alias("account"), said("kind").alias("of_kind"), op.alias("op"),
        F.when(op.isNotNull(), F.col("amount_value")).alias("low"), F.when(op.isNotNull(), F.col("amount_value2")).alias("high"), F.struct((-F.coalesce("priority", F.lit(0))).alias("less"), "pos", "id").alias("at"),
    )
    own = scratch.written(usable.groupBy("match", "pattern", *asks).agg(F.min("at").alias("at")), "rules")
    fit = scratch.written(fitting(rows.select(text.alias("text")), own.select("match", "pattern")), "fitting")
    listed = fit.join(own, ["match", "pattern"]).groupBy("text", *asks).agg(F.min("at").alias("at"))
    end = listed.where(" and ".join(f"{c} is null" for c in ("account", "of_kind", "op"))).select(F.col("text").alias("of"), F.col("at").alias("end"))
    useful = scratch.written(listed.join(end, F.col("text") == F.col("of"), "left").where("end is null or at <= end").select("text", *asks, "at"), "choices")
    listed = F.sort_array(F.collect_list(F.struct("at", "of_kind", "op", "low", "high")))
    shared = scratch.written(useful.where("account is null").groupBy(F.col("text").alias("text_")).agg(listed.alias("shared_")), "choices")
    single = useful.where("account is not null").groupBy(F.col("text").alias("text__"), F.col("account").alias("account_")).agg(listed.alias("single_"))
    return shared, scratch.written(single, "choices")


def first_match(rows: DataFrame, rules: DataFrame, name: str = "rule_id") -> DataFrame:
    """``rows`` with the id of the first rule that has a category and matches, by priority, then by ``pos``; as ``rules.first_match``.

    rules: id, pos, match, pattern, category_id, priority, is_global, account_id, kind, amount_op, amount_value,
    amount_value2; rows: account_id, kind, amount, notes. Of the rules of a text that ask the same only the first counts, and none behind
    the first that asks nothing else: first among rules of one pattern, then of all patterns that fit. What is left for all
    accounts is listed by text, what is for one account by text and account; a row takes the first of both lists that it meets.
    """
    text = F.coalesce("notes", F.lit(""))
    shared, single = choices(rows, rules)
    size = F.abs(F.coalesce(F.col("amount").cast("double"), F.lit(0.0)))

    def meets(c: Column) -> Column:
        op, low, high = c["op"], c["low"], c["high"]
        amount = F.when(op == "eq", size == low).when(op == "gt", size > low).when(op == "gte", size >= low).when(op == "lt", size < low).when(op == "lte", size <= low)
        amount = amount.when(op == "between", size.between(low, F.coalesce(high, F.lit(float("-inf"))))).otherwise(F.lit(False))
        kind = c["of_kind"].isNull() | F.coalesce(F.col("kind") == c["of_kind"], F.lit(False))
        return kind & (op.isNull() | F.coalesce(amount, F.lit(False)))

    joined = rows.join(shared, text == F.col("text_"), "left").join(single, (text == F.col("text__")) & (F.col("account_id").cast("string") == F.col("account_")), "left")
    first = lambda c: F.get(F.filter(c, meets), F.lit(0))["at"]
    return joined.withColumn(name, F.least(first("shared_"), first("single_"))["id"]).drop("text_", "shared_", "text__", "account_", "single_")
