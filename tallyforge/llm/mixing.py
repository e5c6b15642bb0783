"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a shuffled order, repeated up to ``repeats`` times. A document's virtual
finish time is the number of its source's words up to its end divided by the source's target (in whole words), so all
sources reach their targets at virtual time 1. A document that is being taken at time 1 is two pieces, with a finish
time each. All pieces are sorted by finish time over all sources, their words are summed in that order, and the stream
is truncated where the sum reaches the total budget; what a document gives is the sum of its pieces before that point.

Targets: sources in code-point order, null last, weigh 5, 2, 1 and so on; the budget (all sources' words) is shared by
weight, no target is above ``repeats`` times its source's words, and what is above is shared again among the others.

Both orders, of each source's shuffled documents and of all finish times, are sorts by range, and running sums are
taken within a range and over the ranges, so neither a source nor a group of equal rows is ever in one task: equal rows
are counted first and then numbered, RANGE at a time. Sizes of null or empty texts are 0, and such documents take
nothing. Equal rows are separate documents; rows with one doc_id, or none, are shuffled by text as well. Only doc_id,
source and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import work

#: Equal rows that are numbered at once.
RANGE = 2_000
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), repeats: int = 3, budget: float | None = None) -> DataFrame:
    """(source, source_size, weight, target) of one row per source (source, source_size).

    Sharing again and again what is above the limits ends where target = least(limit, level * weight) for the one level
    at which targets sum to the budget. In order of limit / weight the first sources have their limits; the level
    is what they leave, shared by the weight of the rest. The windows run over one row per source.
    """
    every = Window.partitionBy()
    order = Window.orderBy("ratio", "rank")
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", F.element_at(cycle, (F.col("rank") - 1) % len(weights) + 1))
    ranked = ranked.withColumn("most", F.col("source_size") * float(repeats)).withColumn("ratio", F.col("most") / F.col("weight"))
    total = F.least(F.lit(float(budget)) if budget is not None else F.sum("source_size").over(every).cast("double"), F.sum("most").over(every))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("level", (total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # the level of the first source, in this order, that stays below its limit; if all have their limits, no level is needed
    level = F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "rank", "level"))).over(every)["level"]
    return ranked.withColumn("target", F.least("most", F.coalesce(level * F.col("weight"), F.col("most")))).select("source", "source_size", "weight", "target")


def in_order(rows: DataFrame, keys: list[str], amount: str, before: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``amount`` over all rows before each one, in the order of ``keys`` (nulls first)."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            values = batch.column(amount).to_numpy()
            up_to = np.cumsum(values) + total
            yield pa.record_batch([*batch.columns, pa.array(up_to - values), pa.array(np.full(len(batch), k), pa.int32())], [*batch.schema.names, before, "range"])
            total = int(up_to[-1]) if len(up_to) else total

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    sorted_rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = work.written(sorted_rows.mapInArrow(summed, f"{schema}, `{before}` long, `range` int"), name)
    sums = ranged.groupBy("range").agg(F.sum(amount).alias("range_sum"))  # a row a range
    sums = sums.select(F.col("range").alias("of"), F.coalesce(F.sum("range_sum").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return ranged.join(sums, F.col("range") == F.col("of")).withColumn(before, F.col(before) + F.col("base")).drop("range", "of", "base")


def documents(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, size, text_hash, copy, place: a row a document; equal ones have different copies and places."""
    each = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"))
    counted = each.groupBy("doc_id", "source", "size", "text_hash").agg(F.count("*").alias("n"))
    blocks = counted.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {RANGE}"))))
    copies = F.sequence(F.col("block") * RANGE, F.least(F.col("n"), (F.col("block") + 1) * RANGE) - 1)
    one = blocks.select("doc_id", "source", "size", "text_hash", F.explode(copies).alias("copy"))
    return work.written(one.withColumn("place", F.xxhash64(F.lit(seed), "doc_id", "text_hash", "copy")), "sizes")


def queued(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), repeats: int = 3, budget: float | None = None, seed: int = 0) -> DataFrame:
    """Each document's place in its source's queue: start (words before it), with source_size, target and cut (whole words)."""
    one = documents(docs, seed)
    sizes = one.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sizes, weights, repeats, budget).withColumn("cut", F.round("target").cast("long"))
    before = Window.orderBy(F.col("source").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)  # a row a source
    goal = work.written(goal.withColumn("first", F.coalesce(F.sum("source_size").over(before), F.lit(0))), "targets")
    placed = in_order(one, ["source", "place", "doc_id", "text_hash", "copy"], "size", "at", "queues")
    same = F.col("q.source").eqNullSafe(F.col("s.source"))
    return placed.alias("q").join(goal.alias("s"), same).select("q.doc_id", "q.source", "q.size", "q.text_hash", "q.copy", "q.place", "s.source_size", "s.target", "s.cut", (F.col("q.at") - F.col("s.first")).alias("start"))


def pieces(queue: DataFrame) -> DataFrame:
    """What each pass over each document can give: (words, finish), cut in two where virtual time 1 falls inside."""
    passes = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.expr("(cut - 1) div source_size")))
    each = queue.where("size > 0 and cut > 0").select("*", F.explode(passes).alias("pass"))
    each = each.withColumn("begin", F.col("start") + F.col("pass") * F.col("source_size")).withColumn("end", F.col("begin") + F.col("size"))
    inside = (F.col("begin") < F.col("cut")) & (F.col("cut") < F.col("end"))
    part = lambda a, b: F.struct((b - a).alias("words"), (b / F.col("cut")).alias("finish"))
    whole, head, tail = part(F.col("begin"), F.col("end")), part(F.col("begin"), F.col("cut")), part(F.col("cut"), F.col("end"))
    return each.select(*queue.columns, "begin", F.inline(F.when(inside, F.array(head, tail)).otherwise(F.array(whole))))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), repeats: int = 3, budget: float | None = None, seed: int = 0) -> DataFrame:
    """doc_id, source, text_hash, size, source_size, target, start (words of its source before it), taken.

    ``budget``: words in all, those of the input if None.
    """
    queue = work.written(queued(docs, weights, repeats, budget, seed), "queue")
    limit = queue.groupBy("source").agg(F.first("cut").alias("cut")).agg(F.coalesce(F.sum("cut"), F.lit(0)).alias("limit"))  # one row
    row = ["doc_id", "source", "size", "text_hash", "copy"]
    order = ["finish", "source", "place", "begin", "doc_id", "text_hash", "copy"]
    stream_rows = in_order(pieces(queue).select(*row, "place", "begin", "words", "finish"), order, "words", "total", "stream")
    kept = stream_rows.crossJoin(F.broadcast(limit)).where("total < limit")
    kept = kept.select(*row, F.least(F.col("words"), F.col("limit") - F.col("total")).alias("taken"), *(F.lit(None).cast(t).alias(c) for c, t in (("source_size", "long"), ("target", "double"), ("start", "long"))))
    both = kept.unionByName(queue.select(*row, F.lit(0).cast("long").alias("taken"), "source_size", "target", "start"))
    found = both.groupBy(*row).agg(F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.max("start").alias("start"), F.sum("taken").alias("taken"))
    return found.select("doc_id", "source", "text_hash", "size", "source_size", "target", "start", "taken")


def stream(mix: DataFrame) -> DataFrame:
    """The mixture in order: a row for each time that a document is taken, with its virtual finish and words taken."""
    times = F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)
    passes = mix.where("taken > 0").select("*", F.explode(times).alias("pass"))
    begin = F.col("source_size") * F.col("pass") + F.col("start")
    taken = F.least(F.col("size"), F.round("target").cast("long") - begin)
    return passes.withColumn("words", taken).withColumn("finish", (begin + F.col("size")) / F.col("target")).orderBy("finish", "source", "doc_id")


def remixed(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), repeats: int = 3) -> DataFrame:
    """``docs`` with each row as often as the mix takes its document; one that is cut at the end is taken whole.

    A source so exceeds its target by less than one document.
    """
    mix = mixed(docs, weights, repeats).where("taken > 0")
    keyed = mix.groupBy(F.col("doc_id").alias("id"), "source", F.col("text_hash").alias("hash"))
    keyed = work.written(keyed.agg(F.sum(F.ceil(F.col("taken") / F.col("size"))).cast("int").alias("copies"), F.count("*").alias("rows")), "copies")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("of"), F.xxhash64("text").alias("hash"))
    if keyed.where("rows > 1").limit(1).count():  # equal rows: one of them, as often as all of them are taken
        whole = whole.dropDuplicates(["id", "of", "hash"])
    d, k = whole.alias("d"), keyed.alias("k")
    same = F.col("d.id").eqNullSafe(F.col("k.id")) & F.col("d.of").eqNullSafe(F.col("k.source")) & (F.col("d.hash") == F.col("k.hash"))
    again = d.join(k, same).select("d.doc", F.explode(F.sequence(F.lit(1), F.col("k.copies"))))
    return again.select("doc.*")
