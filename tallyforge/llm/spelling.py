"""Spelling variants: words that differ by one code point, found by two-dimensional range reporting.

The words of one length, in forward order, are points whose second coordinate is their place in reverse order. A word
with an edit at position i matches the points in the interval of its prefix (forward) and of its suffix (reverse); a
wavelet tree over the second coordinates reports them. The vocabulary is cut into shards, ranges of the order by
(length, word) of about ``SHARD`` words each; a query goes to the shards that its shortest prefix can reach. One pass
over words takes the edits behind the middle, one over reversed words those before it, so that the shared part is never
shorter than half of the word and few shards are met.

Nulls: a null text has no words, a null doc_id counts as the empty text in the damage rule. Empty tables give no rows.
Repeated rows count as often as they occur. Words may be of any length. Columns other than doc_id and text are ignored.
Ties for the form of a word: the smallest word in code-point order.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Hasher, Texts, steps
from .work import written

#: Words of a shard.
SHARD = 1 << 15
#: Words shorter than this, or rarer than LEAST, are no words.
SHORTEST, LEAST = 5, 3
#: One of so many runs of a document loses a code point.
DAMAGE = 97
#: Bytes of text counted at once, cells (words times positions) searched at once.
STEP, CELLS = 4 << 20, 1 << 19
#: Lengths in bytes up to which checksums are advanced by table.
TABLED = 64

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0xC3] = True


def _zero_byte() -> np.ndarray:
    """What a byte leaves in a CRC-32 register that a zero byte is fed to."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


_ZERO = _zero_byte()


def letter_runs(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and first runs of ASCII letters and U+00C0 to U+00FF (0xC3 and the byte after it in UTF-8)."""
    inside = _LETTER[texts.data]
    inside[1:] |= texts.data[:-1] == 0xC3
    one = np.zeros(256, bool)
    one[1] = True
    return Texts(inside.view(np.uint8), texts.at).runs(one)


def _counted(texts: Texts, names: list[bytes]) -> dict[bytes, int]:
    """Words and their counts in some texts; names: each text's doc_id and a colon."""
    starts, ends, first = letter_runs(texts)
    if not len(starts):
        return {}
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    hashes = Hasher(texts.data)(starts, ends)
    order = np.argsort(hashes, kind="stable")  # documents stay in order within a word
    h, d = hashes[order], doc[order]
    new_word = np.concatenate([[True], h[1:] != h[:-1]])
    pair = np.flatnonzero(new_word | np.concatenate([[True], d[1:] != d[:-1]]))
    times = np.diff(np.append(pair, len(order)))
    word_of = np.cumsum(new_word)[pair] - 1
    at = order[np.flatnonzero(new_word)]
    data = memoryview(np.ascontiguousarray(texts.data))
    words = [bytes(data[a:b]) for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
    crc = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    length = size - np.fromiter((w.count(b"\xc3") for w in words), np.int64, len(words))
    # the checksum of name + word: the name's, fed as many zero bytes as the word has, exclusive or the word's
    state = np.empty((min(TABLED, int(size.max())) + 1, len(names)), np.uint32)
    state[0] = np.fromiter(map(zlib.crc32, names), np.uint32, len(names))
    for k in range(1, len(state)):
        state[k] = (state[k - 1] >> np.uint32(8)) ^ _ZERO[state[k - 1] & np.uint32(255)]
    long = size[word_of] >= len(state)
    check = state[np.where(long, 0, size[word_of]), d[pair]] ^ crc[word_of]
    for k in np.flatnonzero(long).tolist():
        check[k] = zlib.crc32(words[word_of[k]], int(state[0, d[pair[k]]]))
    hit = check % DAMAGE == 0
    total = np.bincount(word_of[~hit], times[~hit], len(words)).astype(np.int64)
    found = {words[k]: int(total[k]) for k in np.flatnonzero((total > 0) & (length >= SHORTEST)).tolist()}
    for k in np.flatnonzero(hit & (length[word_of] > SHORTEST)).tolist():
        w = words[word_of[k]].decode()
        p = int(check[k]) % len(w)
        left = (w[:p] + w[p + 1 :]).encode()
        found[left] = found.get(left, 0) + int(times[k])
    return found


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in steps(batches, lower=True, size=STEP):
        names = [b"%s:" % b"" if i is None else b"%d:" % i for i in part.column("doc_id").to_pylist()]
        found = _counted(texts, names)
        if found:
            yield pa.record_batch([pa.array(found.keys(), pa.binary()).cast(pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])


def words(docs: DataFrame) -> DataFrame:
    """Words and how often they occur (word, n): runs of letters in lower case, one in DAMAGE without one code point."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


class WaveletTree:
    """Values 0 to n - 1 in some order: which of them, in a range of places, are in a range of values."""

    def __init__(self, values: np.ndarray):
        self.zeros: list[np.ndarray] = []
        for bit in range(max(1, int(len(values) - 1).bit_length()) - 1, -1, -1):
            one = (values >> bit) & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(1 - one)]).astype(np.int32))
            values = np.concatenate([values[one == 0], values[one == 1]])

    def report(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For ranges of places [lo, hi) and of values [least, end): each value found, with its range's number."""
        of, value = np.arange(len(lo)), np.zeros(len(lo), np.int64)
        for bit, zeros in zip(range(len(self.zeros) - 1, -1, -1), self.zeros, strict=True):
            lo0, hi0, begin = zeros[lo], zeros[hi], zeros[-1]
            lo, hi = np.concatenate([lo0, begin + lo - lo0]), np.concatenate([hi0, begin + hi - hi0])
            value = np.concatenate([2 * value, 2 * value + 1])
            of = np.concatenate([of, of])
            alive = np.flatnonzero((lo < hi) & (value << bit < end[of]) & ((value + 1) << bit > least[of]))
            lo, hi, value, of = lo[alive], hi[alive], value[alive], of[alive]
        return of, value


def _bound(column: np.ndarray, lo: np.ndarray, hi: np.ndarray, wanted: np.ndarray, after: bool) -> np.ndarray:
    """Where wanted bytes begin (or end) in ranges of a column that are sorted, by halves for all at once."""
    lo, hi = lo.copy(), hi.copy()
    while len(live := np.flatnonzero(lo < hi)):
        middle = (lo[live] + hi[live]) >> 1
        seen = column[middle]
        right = seen <= wanted[live] if after else seen < wanted[live]
        lo[live[right]] = middle[right] + 1
        hi[live[~right]] = middle[~right]
    return lo


def _intervals(table: np.ndarray, queries: np.ndarray, upto: int) -> tuple[np.ndarray, np.ndarray]:
    """Intervals of sorted rows that begin with each query's first 0 to ``upto`` bytes: a row for each length."""
    lo, hi = np.zeros((upto + 1, len(queries)), np.int32), np.full((upto + 1, len(queries)), len(table), np.int32)
    for k in range(upto):
        column = np.ascontiguousarray(table[:, k])
        lo[k + 1] = _bound(column, lo[k], hi[k], queries[:, k], False)
        hi[k + 1] = _bound(column, lo[k + 1], hi[k], queries[:, k], True)
    return lo, hi


class Shelf:
    """Words of one length, sorted, as rows of bytes (a code point each); searched with one edit behind the middle."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.length = rows, rows.shape[1]
        backward = np.ascontiguousarray(rows[:, ::-1])
        self.order = np.argsort(backward.view(f"S{self.length}").ravel(), kind="stable")
        self.backward = backward[self.order]
        rank = np.empty(len(rows), np.int64)
        rank[self.order] = np.arange(len(rows))
        self.tree = WaveletTree(rank)

    def search(self, queries: np.ndarray, middle: int, backward: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a query and a row that differ by the replaced or inserted byte at a place not before the middle.

        backward: the words are reversed, so that of equal inserted bytes in a row the other end's counts.
        """
        size = queries.shape[1]
        extra = self.length - size
        lo, hi = _intervals(self.rows, queries, size - 1 + extra)
        low, high = _intervals(self.backward, queries[:, ::-1], size - 1 + extra - middle)
        places = np.arange(middle, size + extra)
        behind = size - 1 + extra - places
        lo, hi, low, high = lo[places].ravel(), hi[places].ravel(), low[behind].ravel(), high[behind].ravel()
        query, place = np.tile(np.arange(len(queries)), len(places)), np.repeat(places, len(queries))
        some = np.flatnonzero((lo < hi) & (low < high))
        of, value = self.tree.report(lo[some], hi[some], low[some].astype(np.int64), high[some].astype(np.int64))
        query, place, row = query[some][of], place[some][of], self.order[value]
        new = self.rows[row, place]
        if not extra:
            good = new != queries[query, place]
        elif backward:
            good = (place == 0) | (new != queries[query, np.maximum(place - 1, 0)])
        else:
            good = (place == size) | (new != queries[query, np.minimum(place, size - 1)])
        return query[good], row[good]


def middle_of(length: int, backward: bool) -> int:
    """First place of the edits that a pass looks for in words of a length; the two passes share out all places."""
    return length - (length - 1) // 2 if backward else (length - 1) // 2


def _rows(column: pa.Array, length: int) -> np.ndarray:
    """Words of one length in code points as rows of bytes (U+0000 to U+00FF)."""
    data = np.frombuffer(b"".join(column.cast(pa.binary()).to_pylist()), np.uint8)
    second = np.concatenate([[False], data[:-1] == 0xC3])
    return np.where(second, data + np.uint8(0x40), data)[data != 0xC3].reshape(-1, length)


def _searched(backward: bool):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by (shard, length, points before queries, word): points are kept as one shelf, queries searched as they come."""
        held, now = [], None
        shelf = points = counts = None
        for batch in batches:
            if not len(batch):
                continue
            shard, length, query = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
            cut = np.flatnonzero((np.diff(shard) != 0) | (np.diff(length) != 0) | (np.diff(query) != 0)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(batch)], strict=True):
                part, key = batch.slice(a, b - a), (int(shard[a]), int(length[a]))
                if key != now:
                    held, now, shelf = [], key, None
                if query[a] < 0:
                    held.append(part)
                    continue
                if not held:
                    continue
                if shelf is None:
                    all_points = pa.Table.from_batches(held)
                    points, counts = np.array(all_points.column("key").to_pylist(), object), all_points.column("n").to_numpy()
                    shelf = Shelf(_rows(all_points.column("key").combine_chunks(), key[1]))
                size, at_once = int(query[a]), max(1, CELLS // key[1])
                for c in range(0, len(part), at_once):
                    some = part.slice(c, at_once)
                    q, row = shelf.search(_rows(some.column("key"), size), middle_of(key[1], backward), backward)
                    asked, n = np.array(some.column("key").to_pylist(), object)[q], some.column("n").to_numpy()[q]
                    near, near_n = points[row], counts[row]
                    if size < key[1]:  # an insertion is a deletion the other way round
                        asked, near, near_n = np.concatenate([asked, near]), np.concatenate([near, asked]), np.concatenate([near_n, n])
                    if len(asked):
                        yield pa.record_batch([pa.array(asked, pa.string()), pa.array(near, pa.string()), pa.array(near_n, pa.int64())], ["key", "near", "near_n"])

    return run


def _routed(bounds: list[tuple[int, str]], backward: bool):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each shard and length that a word's shortest prefix can reach."""
        for batch in batches:
            out = []
            for key, n in zip(batch.column("key").to_pylist(), batch.column("n").to_pylist(), strict=True):
                for length in (len(key), len(key) + 1):
                    prefix = key[: middle_of(length, backward)]
                    first = max(0, bisect_right(bounds, (length, prefix)) - 1)
                    last = max(0, bisect_right(bounds, (length, prefix + "\U0010ffff")) - 1)
                    out += [(shard, length, len(key), key, n) for shard in range(first, last + 1)]
            if out:
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64()]
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["shard", "length", "query", "key", "n"])

    return run


def near_words(vocabulary: DataFrame) -> DataFrame:
    """Links (word, near, near_n), in both directions, between words (word, n) that differ by one code point."""
    shards = max(1, -(-vocabulary.count() // SHARD))
    found = []
    for backward in (False, True):
        key = F.reverse("word") if backward else F.col("word")
        keyed = vocabulary.select(F.length("word").alias("length"), key.alias("key"), "n")
        cut = keyed.repartitionByRange(shards, "length", "key").withColumn("range", F.spark_partition_id())
        cut = written(cut, "spelling-ranges")
        # a row a shard: the least word of each
        ends = sorted(((r.least.length, r.least.key), r.range) for r in cut.groupBy("range").agg(F.min(F.struct("length", "key")).alias("least")).collect())
        bounds = [least for least, _ in ends]
        numbers = vocabulary.sparkSession.createDataFrame([(r, k) for k, (_, r) in enumerate(ends)], "range int, shard int")
        points = cut.join(F.broadcast(numbers), "range").select("shard", F.col("length").cast("int"), F.lit(-1).alias("query"), "key", "n")
        queries = cut.select("key", "n").mapInArrow(_routed(bounds, backward), "shard int, length int, query int, key string, n long")
        dealt = points.unionByName(queries).repartition("shard", "length").sortWithinPartitions("shard", "length", "query", "key")
        pairs = dealt.mapInArrow(_searched(backward), "key string, near string, near_n long")
        back = F.reverse if backward else F.col
        found.append(pairs.select(back("key").alias("word"), back("near").alias("near"), "near_n"))
    return found[0].unionByName(found[1])


def variants(docs: DataFrame) -> DataFrame:
    """Each word (word, n) of ``words`` with its near words' number, its form and the form's n, and its root."""
    vocabulary = written(words(docs), "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    near = near_words(vocabulary).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    has = -F.col("best.less") >= 2 * F.col("n")
    joined = vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")
    )
    forms = written(joined, "spelling-forms")
    links = forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:  # a form occurs twice as often as its word: chains are short and have no circles, and each turn doubles the steps
        links = written(links, "spelling-roots")
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = links.join(ahead, "root", "left")
        if joined.where(F.col("further").isNotNull()).isEmpty():
            break
        links = joined.select("word", F.coalesce("further", "root").alias("root"))
    return forms.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
