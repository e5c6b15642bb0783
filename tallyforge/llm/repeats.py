"""Repeated byte strings, removed wherever they occur, found by grouping hashed windows in anchored buckets.

What is removed is every byte covered by a ``LENGTH``-byte string that starts at more than one place. Suffixes matter
only as far as their first LENGTH bytes, and only where those can repeat, so windows of LENGTH bytes are grouped in buckets.
No Burrows-Wheeler transform, suffix order or common-prefix array is built.

1. Anchors. Of the grams of GRAM bytes inside a window of LENGTH bytes, the one with the least hash is its anchor, a
   function of the window's content: equal windows have equal anchors at equal places. A text is cut into segments, each
   the windows of one anchor. Nothing repeats except among segments of one gram, and equal segments (by hash, with their
   gram: 128 bits) are repeats from end to end and need no comparison; one of each different kind stays.
2. Merging. Segments of one gram come together, from all shards. Their windows start as one block for each distance to
   the anchor. Letters are strings of LETTER bytes; from a window's last letter to its first, each round steps back by
   one letter and splits the blocks by its hash. Windows alone in their block drop out. A block's common prefix after k rounds is k letters long; blocks of two or more after the last
   round are the repeated intervals.
   A gram with more than KINDS different segments is merged in buckets of a few windows with the same inner part.
3. Intervals are joined to ranges in each text and cut out of it.

Texts that occur more than once are repeats as a whole if they have LENGTH bytes; one copy takes part in the merging.
Null texts are empty; shorter ones keep all bytes. Hashes of 64 bits are compared within a gram's 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import work
from .text import Hasher, Texts, mix, steps

LENGTH = 400
GRAM = 100
LETTER = 40
#: Different segments of one gram that are merged in one bucket; beyond, buckets have WIDTH windows each.
KINDS = 2000
WIDTH = 16
#: Segments that a task merges at once, and those of the bucket at the end of them.
TOGETHER = 6000


def anchors(texts: Texts) -> tuple[np.ndarray, ...]:
    """Of each segment: text, first window, windows, anchor's distance from the first window, gram and segment hashes."""
    data, none = texts.data, tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    n = len(data)
    if n < LENGTH:
        return none
    h = Hasher(data)
    place = np.arange(n - GRAM + 1)
    gram = h.rolling(place, place + GRAM)
    mask = np.uint64((1 << n.bit_length()) - 1)
    marked = (gram & ~mask) | place.astype(np.uint64)
    width = LENGTH - GRAM + 1
    padded = np.full(-(-len(marked) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(marked)] = marked
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(rows, axis=1).ravel()
    windows = n - LENGTH + 1
    least = (np.minimum(ahead[:windows], behind[width - 1 : width - 1 + windows]) & mask).astype(np.int64)
    size = np.diff(texts.at)
    last = np.repeat(texts.at[1:], size)[:windows] - LENGTH
    p = np.flatnonzero(np.arange(windows) <= last)
    if not len(p):
        return none
    a = least[p]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)])
    first = p[new]
    count = np.diff(np.append(np.flatnonzero(new), len(p)))
    doc = np.searchsorted(texts.at, first, "right") - 1
    return doc, first - texts.at[doc], count, a[new] - first, gram[a[new]], h(first, first + count + LENGTH - 1)


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("key"), text.alias("text"))


def segments(docs: DataFrame) -> DataFrame:
    """(key, start, windows, ahead, gram, segment) of every segment of every text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in steps(batches):
            doc, start, count, ahead, gram, segment = anchors(texts)
            yield pa.record_batch([part.column("key").take(pa.array(doc)), pa.array(start), pa.array(count, pa.int32()), pa.array(ahead, pa.int32()), pa.array(gram.view(np.int64)), pa.array(segment.view(np.int64))], ["key", "start", "windows", "ahead", "gram", "segment"])

    rows = docs.select("key", "text").mapInArrow(cut, "key binary, start long, windows int, ahead int, gram long, segment long")
    return work.written(rows.withColumn("place", F.xxhash64("key", "start")), "segments", compression="zstd")


def extracted(chosen: DataFrame) -> DataFrame:
    """(bucket, key, start, windows, ahead, data) of the segments listed in ``reps`` of each text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                text, key, out = np.frombuffer(batch.column("text")[i].as_py().encode(), np.uint8), batch.column("key")[i].as_py(), []
                h = None
                for r in batch.column("reps")[i].as_py():
                    start, windows, ahead, gram = r["start"], r["windows"], r["ahead"], r["gram"]
                    if r["kinds"] <= KINDS:
                        out.append((gram, key, start, windows, ahead, text[start : start + windows + LENGTH - 1].tobytes()))
                        continue
                    h = h or Hasher(text)
                    away = ahead  # windows at distances [low, low + WIDTH) from the anchor, and what they all contain
                    while away > ahead - windows:
                        low = away // WIDTH * WIDTH
                        low_end = max(low, ahead - windows + 1)
                        first, n, anchor = start + ahead - away, away - low_end + 1, start + ahead
                        inner = h(np.array([anchor - low]), np.array([anchor - low - WIDTH + 1 + LENGTH]))
                        bucket = mix(inner + np.uint64(low) + np.uint64(gram & 0xFFFFFFFFFFFFFFFF)).view(np.int64)[0]
                        out.append((int(bucket), key, first, n, anchor - first, text[first : first + n + LENGTH - 1].tobytes()))
                        away = low_end - 1
                names = ["bucket", "key", "start", "windows", "ahead", "data"]
                kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.record_batch([pa.array(list(x), k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds], names)

    return chosen.select("key", "text", "reps").mapInArrow(cut, "bucket long, key binary, start long, windows int, ahead int, data binary")


def refine(block: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks split by the letter before, and which of their members are not alone."""
    _, block, count = np.unique(mix(letter ^ (block.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), return_inverse=True, return_counts=True)
    return block, count[block] > 1


def merge(bucket: np.ndarray, windows: np.ndarray, ahead: np.ndarray, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segment, window) of every window that another one of its bucket equals; segment i is ``data[at[i]:at[i + 1]]``."""
    h = Hasher(data)
    segment = np.repeat(np.arange(len(windows)), windows)
    window = np.arange(len(segment)) - np.repeat(np.cumsum(windows) - windows, windows)
    start = at[segment] + window
    distance = (ahead[segment] - window).astype(np.uint64)
    block, alive = refine(distance, mix(bucket.view(np.uint64)[segment]))
    kept = np.flatnonzero(alive)
    block = block[kept]
    for k in range(LENGTH // LETTER - 1, -1, -1):
        begin = start[kept] + k * LETTER
        block, alive = refine(block, h(begin, begin + LETTER))
        kept, block = kept[alive], block[alive]
    return segment[kept], window[kept]


def merged(parts: DataFrame) -> DataFrame:
    """(key, start, end) of the ranges that the merging finds."""

    def run(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        size = np.array([len(x) for x in rows.column("data").to_pylist()], np.int64)
        data = np.frombuffer(b"".join(rows.column("data").to_pylist()), np.uint8)
        windows, ahead, begin = (rows.column(c).to_numpy().astype(np.int64) for c in ("windows", "ahead", "start"))
        segment, window = merge(rows.column("bucket").to_numpy(), windows, ahead, data, np.concatenate([[0], np.cumsum(size)]))
        new = np.concatenate([[True], (segment[1:] != segment[:-1]) | (window[1:] != window[:-1] + 1)])[: len(segment)]
        first = np.flatnonzero(new)
        last = np.append(first, len(segment))[1:] - 1
        at = begin[segment[first]]
        return pa.record_batch([rows.column("key").combine_chunks().take(pa.array(segment[first])), pa.array(at + window[first]), pa.array(at + window[last] + LENGTH)], ["key", "start", "end"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for begin in range(0, len(batch), TOGETHER):
                held.append(batch.slice(begin, TOGETHER))
                n += len(held[-1])
                if n < TOGETHER:
                    continue
                table = pa.Table.from_batches(held)
                bucket = table.column("bucket").to_numpy()
                cut = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on
                if cut:
                    yield run(table.slice(0, cut))
                    held, n = table.slice(cut).to_batches(), len(table) - cut
        if held:
            yield run(pa.Table.from_batches(held))

    return parts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(together, "key binary, start long, end long")


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, starts and ends of the removed ranges, kept_sha256, kept (bytes; null: see below).

    ``kept`` is null where nothing or everything is removed. starts and ends are null there as well.
    """
    texts = keyed(docs)
    copies = work.written(texts.groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id")).where("copies > 1"), "copies")
    cut = segments(texts)
    kinds = work.written(cut.groupBy("gram", "segment").agg(F.min("place").alias("least"), F.max("place").alias("most")), "kinds", compression="zstd")
    grams = kinds.groupBy("gram").agg(F.count("*").alias("kinds"), F.max((F.col("least") != F.col("most")).cast("int")).alias("again")).where("kinds > 1 or again > 0")
    wanted = kinds.join(grams.select("gram", "kinds"), "gram").where("kinds > 1 or least <> most").select("gram", "segment", "kinds", "least", (F.col("least") != F.col("most")).alias("equal"))
    hits = cut.join(wanted, ["gram", "segment"]).where((F.col("equal")) | (F.col("place") == F.col("least")))
    span = F.when(F.col("equal"), F.struct(F.col("start").alias("start"), (F.col("start") + F.col("windows") + LENGTH - 1).alias("end")))
    rep = F.when((F.col("kinds") > 1) & (F.col("place") == F.col("least")), F.struct("start", "windows", "ahead", "gram", "kinds"))
    of_text = work.written(hits.groupBy("key").agg(F.collect_set(span).alias("spans"), F.collect_set(rep).alias("reps")), "hits", compression="zstd")
    one = of_text.join(copies.select("key", "doc_id"), "key", "left").select("key", F.col("doc_id").alias("chosen"), "spans", "reps")

    # a text with copies is chosen by one doc_id as well, so that its copies are dealt out by theirs
    alone = one.where("chosen is null").select("key", F.lit(None).cast("long").alias("chosen"), "spans", "reps")
    first = texts.select("key", "doc_id").join(alone.select("key"), "key", "left_semi").distinct()
    alone = alone.drop("chosen").join(first.withColumnRenamed("doc_id", "chosen"), "key").select("key", "chosen", "spans", "reps")
    chosen = one.where("chosen is not null").unionByName(alone)
    same = (F.col("t.key") == F.col("c.key")) & F.col("t.doc_id").eqNullSafe(F.col("c.chosen"))
    found = texts.alias("t").join(chosen.alias("c"), same, "left")
    known = F.col("c.key").isNotNull()
    read = work.written(found.select("t.doc_id", "t.key", F.octet_length("t.text").cast("long").alias("n_bytes"), F.when(~known, F.sha2(F.col("t.text").cast("binary"), 256)).alias("sha"), F.when(known, F.col("t.text")).alias("text"), "spans", "reps"), "texts", compression="zstd")

    more = merged(extracted(read.where(F.size("reps") > 0)))
    more = more.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("more"))
    held = read.where("text is not null").join(more, "key", "left").select("doc_id", "key", "n_bytes", "text", F.concat("spans", F.coalesce("more", F.array())).alias("spans"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), 64):
                part, out = batch.slice(begin, 64), []
                for r in part.to_pylist():
                    data = r["text"].encode()
                    starts, ends = joined(r["spans"])
                    pieces = b"".join(data[a:b] for a, b in zip([0, *ends], [*starts, len(data)], strict=True))
                    out.append({"doc_id": r["doc_id"], "key": r["key"], "n_bytes": len(data), "n_removed": len(data) - len(pieces), "starts": starts, "ends": ends, "kept_sha256": hashlib.sha256(pieces).hexdigest(), "kept": pieces})
                yield pa.RecordBatch.from_pylist(out, schema=RESULT)

    result = held.mapInArrow(cut_out, "doc_id long, key binary, n_bytes long, n_removed long, starts array<long>, ends array<long>, kept_sha256 string, kept binary")
    rest = read.where("text is null").select("doc_id", "key", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(None).cast("array<long>").alias("starts"), F.lit(None).cast("array<long>").alias("ends"), F.col("sha").alias("kept_sha256"), F.lit(None).cast("binary").alias("kept"))
    both = result.unionByName(rest).join(copies.select("key", "copies"), "key", "left")
    whole = F.col("copies").isNotNull() & (F.col("n_bytes") >= LENGTH)
    return both.select(
        "doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(~whole, F.col("starts")).alias("starts"), F.when(~whole, F.col("ends")).alias("ends"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"), F.when(~whole, F.col("kept")).alias("kept"),
        F.when(whole, 1).otherwise(F.coalesce(F.size("starts"), F.lit(0))).cast("long").alias("n_spans"),
    )


RESULT = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def joined(spans: list[dict]) -> tuple[list[int], list[int]]:
    """Ranges that touch or overlap, as one."""
    starts, ends = [], []
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if starts and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends
