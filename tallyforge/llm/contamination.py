"""Benchmark passages in training documents, found in a distributed positional inverted index.

``build_index`` splits the documents into blocks of about a megabyte. A block's row has its documents, their first word
numbers, all its terms (64-bit word hashes, ascending) and their postings: keys term << 32 | position, ascending. A
phrase is intersected where its documents are, so no posting list is ever gathered over the corpus.

``search`` works from the rarest test terms. The postings of test terms are cut out of the index (by a bit filter of
fixed size, whose false hits cost space only), and counted over all blocks. Each window of a test item then has a
rarest term in the corpus, and is looked up by that: the blocks that hold the term are where it may occur. There, the
term's positions, moved by its offset, are intersected with those of the next rarer terms in turn (``slack`` 0: exact
phrases; else every term within so many words of its place, seen from the rarest one). Windows that lack a term in the
corpus are looked up nowhere. Of the test items, only the filter goes through the driver.

Words are the runs of lower-case letters, digits and characters outside ASCII, after lowering A-Z. Null or empty texts
have no words. Items with a null id are left out, as are items without words; items with one id count once. Repeated
documents are judged one by one. Only doc_id, text and item_id, text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import work
from .text import ALNUM, Hasher, Texts, find, pack_sorted, steps, unpack_sorted

INDEX = "block long, doc_ids array<long>, word_at array<int>, terms binary, postings binary"
#: Bytes of benchmark text that a task cuts into words at once.
ITEMS_AT_ONCE = 32 << 20
#: Bits of the filter of test terms: 2 MB, whatever the benchmark.
FILTER_BITS = 24
#: Windows that are intersected with a block in one row.
WINDOWS_AT_ONCE = 50_000


def word_hashes(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the first word of each text."""
    starts, ends, first = texts.runs(ALNUM)
    return Hasher(texts.data)(starts, ends), first


def _numbers() -> Iterator[int]:
    """Numbers that no other task has; a retried task has the same ones."""
    at = TaskContext.get().partitionId() << 32
    while True:
        yield at
        at += 1


def _postings(term: np.ndarray, position: np.ndarray) -> np.ndarray:
    return term.astype(np.uint64) << np.uint64(32) | position.astype(np.uint64)


def build_index(docs: DataFrame) -> DataFrame:
    """The positional index of all terms of ``docs``, written to the shared folder."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _numbers()
        for part, texts in steps(batches, lower=True):
            h, first = word_hashes(texts)
            position = np.argsort(h, kind="stable")
            ordered = h[position]
            new = np.ones(len(h), bool)
            new[1:] = ordered[1:] != ordered[:-1]
            postings = _postings(np.cumsum(new) - 1, position)
            ids = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column("doc_id"))
            at = pa.ListArray.from_arrays(pa.array([0, len(first)], pa.int32()), pa.array(first, pa.int32()))
            yield pa.record_batch([pa.array([next(number)]), ids, at, pa.array([pack_sorted(ordered[new])], pa.binary()), pa.array([pack_sorted(postings)], pa.binary())], ["block", "doc_ids", "word_at", "terms", "postings"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(blocks, INDEX)
    return work.written(rows, "positional-index", **{"parquet.block.size": 16 << 20, "compression": "zstd"})


def item_words(benchmark: DataFrame) -> DataFrame:
    """(row, item, words): the word hashes of each item's text, in order; one row for equal ones."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _numbers()
        for part, texts in steps(batches, lower=True, size=ITEMS_AT_ONCE):
            h, first = word_hashes(texts)
            some = np.flatnonzero(np.diff(first))
            words = [h[first[k] : first[k + 1]].tobytes() for k in some]
            yield pa.record_batch([pa.array([next(number) for _ in some], pa.int64()), part.column("item").take(pa.array(some)), pa.array(words, pa.binary())], ["row", "item", "words"])

    read = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("item is not null").distinct()
    return work.written(read.mapInArrow(cut, "row long, item string, words binary"), "items")


def item_terms(items: DataFrame) -> DataFrame:
    """(row, term): the different words of each item."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, words in zip(batch.column("row").to_pylist(), batch.column("words").to_pylist(), strict=True):
                different = np.unique(np.frombuffer(words, np.int64))
                yield pa.record_batch([pa.array(np.full(len(different), row)), pa.array(different)], ["row", "term"])

    return items.mapInArrow(terms, "row long, term long")


def term_filter(terms: DataFrame) -> np.ndarray:
    """A bit for each value of the terms' upper FILTER_BITS bits; at most 2**FILTER_BITS / 64 rows reach the driver."""
    slot = F.shiftrightunsigned("term", 64 - FILTER_BITS)
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int")))
    rows = terms.groupBy(F.shiftright(slot, 6).cast("int").alias("at")).agg(bits.alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def postings_of_items(index: DataFrame, terms: DataFrame) -> DataFrame:
    """The index with the postings of terms that pass the filter of test terms."""
    shared = index.sparkSession.sparkContext.broadcast(term_filter(terms))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            out = []
            for terms, postings in zip(batch.column("terms").to_pylist(), batch.column("postings").to_pylist(), strict=True):
                terms, postings = unpack_sorted(terms), unpack_sorted(postings)
                slot = terms >> np.uint64(64 - FILTER_BITS)
                keep = (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
                number = np.cumsum(keep) - 1
                term = (postings >> np.uint64(32)).astype(np.int64)
                kept = keep[term]
                out.append((pack_sorted(terms[keep]), pack_sorted(_postings(number[term[kept]], postings[kept] & np.uint64(0xFFFFFFFF)))))
            columns = [pa.array([x[k] for x in out], pa.binary()) for k in range(2)]
            yield pa.record_batch([*(batch.column(c) for c in ("block", "doc_ids", "word_at")), *columns], batch.schema.names)

    return work.written(index.mapInArrow(cut, INDEX), "test-postings", compression="zstd")


def term_blocks(slices: DataFrame) -> DataFrame:
    """(term, block, n): how often a block has each of its terms."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, terms, postings in zip(*(batch.column(c).to_pylist() for c in ("block", "terms", "postings")), strict=True):
                terms = unpack_sorted(terms)
                n = np.bincount((unpack_sorted(postings) >> np.uint64(32)).astype(np.int64), minlength=len(terms))
                yield pa.record_batch([pa.array(terms.view(np.int64)), pa.array(np.full(len(terms), block)), pa.array(n.astype(np.int64))], ["term", "block", "n"])

    return work.written(slices.select("block", "terms", "postings").mapInArrow(counted, "term long, block long, n long"), "term-blocks")


def windows(items: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """(item, words, rarest, order): each window of an item whose words all occur, with its rarest term and the offsets by rarity.

    counts: (term, n) over the corpus. An item of fewer words than ``window`` is one window.
    """
    known = item_terms(items).join(counts, "term").groupBy("row").agg(F.collect_list(F.struct("term", "n")).alias("known"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, words, known in zip(*(batch.column(c).to_pylist() for c in ("item", "words", "known")), strict=True):
                words = np.frombuffer(words, np.int64)
                term, count = (np.array([x[c] for x in known], np.int64) for c in ("term", "n"))
                by = np.argsort(term)
                at, there = find(term[by], words)
                count = np.where(there, count[by][at], 0)
                n = min(window, len(words))
                each = np.lib.stride_tricks.sliding_window_view(count, n)
                alive = np.flatnonzero((each > 0).all(axis=1))
                order = np.argsort(each[alive], axis=1, kind="stable").astype(np.uint16)
                grams = np.lib.stride_tricks.sliding_window_view(words, n)[alive]
                rarest = grams[np.arange(len(alive)), order[:, 0]] if len(alive) else np.zeros(0, np.int64)
                yield pa.record_batch([pa.array([item] * len(alive), pa.string()), pa.array([g.tobytes() for g in grams], pa.binary()), pa.array(rarest), pa.array([o.tobytes() for o in order], pa.binary())], ["item", "words", "rarest", "order"])

    found = items.join(known, "row").select("item", "words", "known").mapInArrow(cut, "item string, words binary, rarest long, order binary")
    return work.written(found.distinct(), "windows")


def intersect(terms: np.ndarray, postings: np.ndarray, wanted: np.ndarray, rarest: np.ndarray, slack: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) pairs at which each window of terms occurs in a block; rarest: each one's offsets by rarity."""
    term, there = find(terms, wanted.ravel())
    term, there = term.reshape(wanted.shape), there.reshape(wanted.shape).all(axis=1)
    begin = np.searchsorted(postings, np.arange(len(terms) + 1, dtype=np.uint64) << np.uint64(32))
    alive = np.flatnonzero(there)
    term, rarest = term[alive], rarest[alive].astype(np.int64)
    lead = term[np.arange(len(term)), rarest[:, 0]] if len(term) else np.zeros(0, np.int64)
    n = begin[lead + 1] - begin[lead]
    row = np.repeat(np.arange(len(term)), n)
    within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    place = (postings[np.repeat(begin[lead], n) + within] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = place - rarest[row, 0]
    ok = start >= 0
    row, start = row[ok], start[ok]
    for k in range(1, wanted.shape[1]):
        offset = rarest[row, k]
        key = term[row, offset].astype(np.uint64) << np.uint64(32)
        at = start + offset
        if slack:
            low, high = (np.searchsorted(postings, key | np.maximum(at + d, 0).astype(np.uint64)) for d in (-slack, slack + 1))
            ok = high > low
        else:
            ok = find(postings, key | at.astype(np.uint64))[1]
        row, start = row[ok], start[ok]
    return alive[row], start


def _joined(starts: np.ndarray, ends: np.ndarray) -> tuple[list[int], list[int]]:
    """Ranges that touch or overlap, as one."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    return starts[new].tolist(), ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)].tolist()


def found_in_blocks(slices: DataFrame, looked_up: DataFrame, slack: int) -> DataFrame:
    """(block, document's place in it, starts, ends, hits): hit word ranges of documents, and the windows' words.

    looked_up: (block, words, order). Its rows of a block come to it WINDOWS_AT_ONCE or so at a time.
    """
    many = looked_up.groupBy("block").agg(F.count("*").alias("n"))
    part = F.pmod(F.xxhash64("words"), F.expr(f"1 + n div {WINDOWS_AT_ONCE}"))
    lists = looked_up.join(many, "block").groupBy("block", part.alias("part")).agg(F.collect_list(F.struct("words", "order")).alias("wanted"))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                at, out = np.array(r["word_at"]), []
                terms, postings = unpack_sorted(r["terms"]), unpack_sorted(r["postings"])
                for size in sorted({len(w["words"]) for w in r["wanted"]}):
                    own = [w for w in r["wanted"] if len(w["words"]) == size]
                    n = size // 8
                    wanted = np.frombuffer(b"".join(w["words"] for w in own), np.uint64).reshape(-1, n)
                    order = np.frombuffer(b"".join(w["order"] for w in own), np.uint16).reshape(-1, n)
                    window, start = intersect(terms, postings, wanted, order, slack)
                    doc = np.searchsorted(at, start, "right") - 1
                    ok = start + n <= at[doc + 1]
                    out += [(d, s - at[d], s - at[d] + n, own[w]["words"]) for d, s, w in zip(doc[ok], start[ok], window[ok], strict=True)]
                out.sort(key=lambda x: x[0])
                edges = np.flatnonzero(np.diff([-1, *(x[0] for x in out)])).tolist() + [len(out)]
                rows = []
                for a, b in zip(edges, edges[1:], strict=False):
                    starts, ends = _joined(np.array([x[1] for x in out[a:b]]), np.array([x[2] for x in out[a:b]]))
                    rows.append({"block": r["block"], "place": int(out[a][0]), "starts": starts, "ends": ends, "hits": list({x[3] for x in out[a:b]})})
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("block", pa.int64()), ("place", pa.int32()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("hits", pa.list_(pa.binary()))]))

    rows = slices.join(lists, "block").select("block", "word_at", "terms", "postings", "wanted")
    return work.written(rows.mapInArrow(hits, "block long, place int, starts array<int>, ends array<int>, hits array<binary>"), "hits")


def _merged(found: DataFrame) -> DataFrame:
    """One row per document: block, place, starts, ends."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [_joined(np.array(s), np.array(e)) for s, e in zip(batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), strict=True)]
            ranges = [pa.array([x[k] for x in both], pa.list_(pa.int32())) for k in range(2)]
            yield pa.record_batch([batch.column("block"), batch.column("place"), *ranges], ["block", "place", "starts", "ends"])

    each = found.groupBy("block", "place").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends")))
    return each.mapInArrow(merge, "block long, place int, starts array<int>, ends array<int>")


def search(index: DataFrame, benchmark: DataFrame, window: int = 13, slack: int = 0) -> DataFrame:
    """One row per document, hit or not: doc_id, n_words, n_hit, merged hit ranges (starts, ends) and item_ids."""
    items = item_words(benchmark)
    slices = postings_of_items(index, item_terms(items))
    by_block = term_blocks(slices)
    wanted = windows(items, by_block.groupBy("term").agg(F.sum("n").alias("n")), window)
    different = wanted.select("words", "rarest", "order").distinct()
    found = found_in_blocks(slices, by_block.join(different, by_block["term"] == different["rarest"]).select("block", "words", "order"), slack)
    of_window = wanted.select("words", "item").distinct()
    named = found.select("block", "place", F.explode("hits").alias("words")).distinct().join(of_window, "words").groupBy("block", "place").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    hit = _merged(found).join(named, ["block", "place"])
    n = F.size("doc_ids")
    each = F.arrays_zip(F.col("doc_ids").alias("doc_id"), F.slice("word_at", F.lit(1), n).alias("first"), F.slice("word_at", F.lit(2), n).alias("last"))
    docs = slices.select("block", F.posexplode(each).alias("place", "x")).select("block", "place", "x.doc_id", (F.col("x.last") - F.col("x.first")).cast("long").alias("n_words"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    n_hit = F.coalesce(F.aggregate("ends", F.lit(0).cast("long"), lambda a, x: a + x) - F.aggregate("starts", F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
    return docs.join(hit, ["block", "place"], "left").select("doc_id", "n_words", n_hit.alias("n_hit"), none("starts", "int"), none("ends", "int"), none("item_ids", "string"))


def judged(docs: DataFrame, benchmark: DataFrame, window: int = 13, slack: int = 0) -> DataFrame:
    """doc_id, n_words, n_hit, starts and ends of hit word ranges, item_ids (sorted strings), contaminated."""
    found = search(build_index(docs), benchmark, window, slack)
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """``docs`` without the contaminated ones. A text's verdict holds for all rows with that text."""
    read = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    bad = judged(read, benchmark, window).where("contaminated").select(F.col("doc_id").alias("bad_text")).distinct()
    return docs.join(bad, F.xxhash64(docs["text"]) == bad["bad_text"], "left_anti")
