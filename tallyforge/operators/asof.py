"""Rows as of a day, nearby rows, and runs of an unchanged value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, TimestampNTZType, TimestampType


def latest(rows: DataFrame, keys: list[str], day: str, where: Column | None = None, tie: list[str] | None = None) -> DataFrame:
    """The row of each key with the last day (then the least ``tie``). One partial aggregation, no sort of a key's rows."""
    rows = rows if where is None else rows.where(where)
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max(day).alias("last_"))
    own = rows.join(last, keys).where(F.col(day) == F.col("last_")).drop("last_")
    order = [*(tie or []), *(c for c in rest if c not in (tie or []))]
    best = own.groupBy(*keys).agg(F.min(F.struct(*order)).alias("row_"))
    return best.select(*keys, *(F.col(f"row_.{c}") for c in rest))


def _cell(at: str, kind: DataType) -> Column:
    """Ranges of the time axis: a month of days, an hour of instants, 1,024 numbers."""
    if isinstance(kind, DateType):
        return F.trunc(at, "month")
    return F.date_trunc("hour", F.col(at)) if isinstance(kind, (TimestampType, TimestampNTZType)) else F.floor(F.col(at) / 1024)


def _same(left: str, right: str, names: list[str]) -> Column:
    test = F.lit(True)
    for n in names:
        test = test & F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}"))
    return test


def before(facts: DataFrame, observations: DataFrame, keys: list[str], day: str, observed: str, strict: bool = True) -> DataFrame:
    """``facts`` with the last observation of their key before (or on) their day; of equal ones the greatest.

    The answer depends on a key and a day only, so both sides are reduced to one row for each of them first. A key's
    days are cut into ranges; within a range the last observation is carried forward, and each range's last one is
    handed to the ranges after it: one row a key and range. So a key with a third of all rows is many ranges in many
    tasks, and no task sorts a key's rows.
    """
    values = [c for c in observations.columns if c not in keys]
    asked = facts.select(*keys, F.col(day).alias("at_")).distinct().select(*keys, "at_", F.lit(0 if strict else 1).alias("rank_"))
    seen = observations.groupBy(*keys, F.col(observed).alias("at_")).agg(F.max(F.struct(*values)).alias("seen_"))
    stream = asked.withColumn("seen_", F.lit(None).cast(seen.schema["seen_"].dataType)).unionByName(seen.withColumn("rank_", F.lit(1 if strict else 0)))
    stream = stream.withColumn("cell_", _cell("at_", stream.schema["at_"].dataType))
    inside = Window.partitionBy(*keys, "cell_").orderBy("at_", "rank_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = stream.withColumn("carried_", F.last("seen_", ignorenulls=True).over(inside)).where("seen_ is null")
    ranges = stream.groupBy(*keys, "cell_").agg(F.max_by("seen_", F.when(F.col("seen_").isNotNull(), F.col("at_"))).alias("end_"))
    earlier = Window.partitionBy(*keys).orderBy("cell_").rowsBetween(Window.unboundedPreceding, -1)
    handed = ranges.withColumn("handed_", F.last("end_", ignorenulls=True).over(earlier))
    answers = carried.alias("c").join(handed.alias("h"), _same("c", "h", [*keys, "cell_"]), "left")
    answers = answers.select(*(F.col(f"c.{k}").alias(f"{k}_of_") for k in keys), F.col("c.at_").alias("at_"), F.coalesce("carried_", "handed_").alias("answer_"))
    same = F.col(f"f.{day}").eqNullSafe(F.col("a.at_"))
    for k in keys:
        same = same & F.col(f"f.{k}").eqNullSafe(F.col(f"a.{k}_of_"))
    joined = facts.alias("f").join(answers.alias("a"), same, "left")
    return joined.select("f.*", *(F.col(f"answer_.{c}").alias(c if c not in facts.columns else f"seen_{c}") for c in values))


def near(left: DataFrame, right: DataFrame, keys: list[str], value: tuple[str, str], tolerance: str, how: str = "left_semi", also: Column | None = None) -> DataFrame:
    """Rows of ``left`` with a row of ``right`` of equal keys whose value differs by ``tolerance`` at most.

    Values are cut into cells one tolerance wide, and a row meets its own cell and both neighbours, so the join is an
    equi-join however many rows a key has. ``also``: a further condition on both.
    """
    a, b = value
    # tolerance as a decimal in both, so that cells are exact
    cell = lambda c: F.floor(F.col(c).cast("decimal(28,10)") / F.lit(tolerance).cast("decimal(28,10)"))
    spread = right.withColumn("cell_", F.explode(F.array(cell(b) - 1, cell(b), cell(b) + 1)))
    return left.withColumn("cell_", cell(a)).alias("l").join(spread.alias("r"), _all(keys, a, b, tolerance, also), how).drop("cell_")


def _all(keys: list[str], a: str, b: str, tolerance: str, also: Column | None) -> Column:
    test = (F.col("l.cell_") == F.col("r.cell_")) & (F.abs(F.col(f"l.{a}").cast("decimal(28,10)") - F.col(f"r.{b}").cast("decimal(28,10)")) <= F.lit(tolerance).cast("decimal(28,10)"))
    for k in keys:
        test = test & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    return test if also is None else test & also


def one_to_one(lines: DataFrame, rows: DataFrame, keys: list[str], days: int = 3) -> DataFrame:
    """(line_id, row_id): a line's only row with equal keys within ``days``, where it is that row's only such line.

    lines: line_id, line_day and keys; rows: row_id, row_day and keys. Days are dealt into cells as wide as the window,
    so a key with many rows is joined cell by cell.
    """
    cell = lambda c: F.floor(F.unix_date(F.col(c)) / (days + 1)).cast("int")
    spread = lines.withColumn("cell_", F.explode(F.array(cell("line_day") - 1, cell("line_day"), cell("line_day") + 1)))
    pairs = spread.join(rows.withColumn("cell_", cell("row_day")), [*keys, "cell_"]).where(F.abs(F.datediff("line_day", "row_day")) <= days)
    single = pairs.groupBy("line_id").agg(F.count("*").alias("n"), F.min("row_id").alias("row_id")).where("n = 1")
    return single.groupBy("row_id").agg(F.count("*").alias("n"), F.min("line_id").alias("line_id")).where("n = 1").select("line_id", "row_id")


def current_run(observations: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    """Of each key: its last value, the first day of the unbroken run of that value, and the days in the run."""
    last = observations.groupBy(*keys).agg(F.max_by(value, day).alias("value"), F.max(day).alias("until"))
    joined = observations.join(last, keys)
    broken = joined.groupBy(*keys).agg(F.max(F.when(~F.col(value).eqNullSafe(F.col("value")), F.col(day))).alias("other_day"))
    run = joined.join(broken, keys).where(F.col("other_day").isNull() | (F.col(day) > F.col("other_day")))
    return run.groupBy(*keys).agg(F.first("value").alias("value"), F.min(day).alias("since"), F.max("until").alias("until"), F.count("*").alias("days"))
