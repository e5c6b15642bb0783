"""Near duplicates by SimHash fingerprints, found with Golay-code keys.

A 64-bit fingerprint is cut into three segments. Of two or fewer differing bits, at least one segment has none, and the
segment after it (in a circle) has two at most. A segment, as a 23-bit word, has the indices of the codewords of the
binary Golay code that it decodes to when no bit or any one bit is flipped: one index or six. Words at distance two or
less share an index, so each fingerprint has a key for each segment together with each index of the next one; linked
fingerprints share a key, and sharing one is verified by counting the differing bits.

Keys of up to GROUP different fingerprints are compared within the group. For fingerprints of more frequent keys,
each is a neighbour of itself and of its 64 one-bit changes, and two are linked exactly if they share a neighbour, so
each neighbour's smallest fingerprint stands for its others: links grow linearly however large the group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import work
from .components import components

#: Low bits of the three segments.
CUTS = (0, 22, 43, 64)
#: Different fingerprints of one key that are compared pair by pair.
GROUP = 64
#: The generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 (a fixed value).
GENERATOR = 0b101011100011


def _spread() -> np.ndarray:
    """Each byte's bits, lowest first, as the bytes of a 64-bit value."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(bits).view(np.uint64).ravel()


SPREAD = _spread()


def majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bits set in over half of each group of hashes; group i is ``hashes[first[i]:first[i + 1]]``, zero if empty."""
    count = np.diff(first)
    out = np.zeros(len(count), np.uint64)
    full = np.flatnonzero(count)
    if not len(full):
        return out
    pieces = -(-count[full] // 255)  # a byte counts up to 255
    start = np.repeat(first[:-1][full], pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    group = np.cumsum(pieces) - pieces
    octets = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)
    for k in range(8):
        lanes = np.add.reduceat(SPREAD[octets[:, k]], start).view(np.uint8).reshape(-1, 8)
        sums = np.add.reduceat(lanes, group, axis=0, dtype=np.int64)
        most = np.packbits(2 * sums > count[full][:, None], axis=1, bitorder="little").ravel()
        out[full] |= most.astype(np.uint64) << np.uint64(8 * k)
    return out


def shingle_hashes(text: bytes, size: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of the lowered text's word shingles, repeats included."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z only, ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = max(1, len(words) - size + 1)
    starts = np.concatenate([[0], ends[: n - 1]]).tolist()
    stops = (ends[min(size, len(words)) - 1 :] - 1).tolist()
    return np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, map(slice, starts, stops)), repeat(42)), np.uint64, n)


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, text_hash and the fingerprint (mark, a signed long), written to the shared folder.

    Texts without words have zero.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), 64):
                part = batch.slice(begin, 64)
                each = [shingle_hashes((x or "").encode(), size) for x in part.column("text").to_pylist()]
                marks = majority(np.concatenate(each), np.cumsum([0, *map(len, each)]))
                yield pa.record_batch([part.column("doc_id"), part.column("text_hash"), pa.array(marks.view(np.int64))], ["doc_id", "text_hash", "mark"])

    read = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return work.written(read.mapInArrow(hashed, "doc_id long, text_hash long, mark long"), "fingerprints")


def _remainders() -> np.ndarray:
    """Of the upper 12 bits of a 23-bit word, divided by the generator."""
    out = np.arange(1 << 12, dtype=np.uint32) << 11
    for bit in range(22, 10, -1):
        out = np.where(out >> bit & 1, out ^ (GENERATOR << (bit - 11)), out)
    return out


def _decoder() -> tuple[np.ndarray, np.ndarray]:
    """Remainder table, and the error of up to three bits for each syndrome."""
    upper = _remainders()
    errors = np.zeros(1 << 11, np.uint32)
    single = np.uint32(1) << np.arange(23, dtype=np.uint32)
    two = (single[:, None] | single).ravel()
    patterns = np.unique(np.concatenate([[0], single, two, (two[:, None] | single).ravel()]).astype(np.uint32))
    errors[upper[patterns >> 11] ^ (patterns & 0x7FF)] = patterns
    return upper, errors


UPPER, ERRORS = _decoder()


def codeword(word: np.ndarray) -> np.ndarray:
    """Index (the upper 12 bits) of the codeword nearest to each 23-bit word."""
    return (word ^ ERRORS[UPPER[word >> 11] ^ (word & 0x7FF)]) >> 11


def keys(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key of every fingerprint."""
    segments = [(marks >> np.uint64(a) & np.uint64((1 << (b - a)) - 1)).astype(np.uint32) for a, b in zip(CUTS, CUTS[1:], strict=False)]
    rows, found = [], []
    for k in range(3):
        near, bits = segments[(k + 1) % 3], CUTS[(k + 1) % 3 + 1] - CUTS[(k + 1) % 3]
        flips = np.concatenate([[0], 1 << np.arange(bits)]).astype(np.uint32)
        index = np.sort(codeword(near[:, None] ^ flips), axis=1)
        new = np.ones(index.shape, bool)
        new[:, 1:] = index[:, 1:] != index[:, :-1]
        row, column = np.nonzero(new)
        rows.append(row)
        found.append(np.int64(k) << 40 | segments[k][row].astype(np.int64) << 12 | index[row, column].astype(np.int64))
    return np.concatenate(rows), np.concatenate(found)


def links(marks: DataFrame) -> DataFrame:
    """Links (a < b) whose components are those of all pairs of different fingerprints (``mark``) at distance 2 or less."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), 20_000):
                mark = batch.column("mark").slice(begin, 20_000).to_numpy()
                row, key = keys(mark.view(np.uint64))
                yield pa.record_batch([pa.array(key), pa.array(mark[row])], ["key", "mark"])

    found = work.written(marks.select("mark").mapInArrow(keyed, "key long, mark long"), "golay-keys")
    count = found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")

    few = found.join(count.where(F.col("n") <= GROUP).select("key"), "key").groupBy("key").agg(F.array_sort(F.collect_list("mark")).alias("marks"))
    near = F.transform("marks", lambda x, i: F.transform(F.filter(F.slice("marks", i + 2, GROUP), lambda y: F.bit_count(x.bitwiseXOR(y)) <= 2), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    pairs = few.select(F.inline(F.flatten(near)))

    many = found.join(count.where(F.col("n") > GROUP).select("key"), "key", "left_semi").select("mark").distinct()
    flips = F.expr("transform(sequence(0, 63), b -> mark ^ shiftleft(1L, b))")
    around = many.select("mark", F.explode(F.concat(F.array("mark"), flips)).alias("near"))
    least = around.groupBy("near").agg(F.min("mark").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = around.join(least, "near").where(F.col("a") < F.col("mark")).select("a", F.col("mark").alias("b"))
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, text_hash, mark (fingerprint, signed), root (the component's smallest fingerprint) and component_id.

    component_id is the smallest doc_id reachable over links, itself included.

    Empty, null and blank texts have fingerprint zero and are linked as others are. Equal rows are separate documents
    of one component; a null doc_id is never a component's id unless all its ids are null. Other columns are ignored.
    """
    return grouped(fingerprints(docs, size))


def grouped(marked: DataFrame) -> DataFrame:
    """``marked`` fingerprints with root and component_id."""
    different = work.written(marked.groupBy("mark").agg(F.min("doc_id").alias("least")), "different-fingerprints")
    root = components(links(different), "a", "b")
    rooted = different.join(root, different.mark == root.node, "left").select("mark", "least", F.coalesce("root", "mark").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("mark", "root", "component_id")
    return marked.join(named, "mark")


def one_of_each(docs: DataFrame, size: int = 3) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id (null last), then of the smallest text hash."""
    return firsts(docs, grouped(fingerprints(docs, size)))


def firsts(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    """``docs`` with the first row of each root of ``rooted`` (doc_id, text_hash, root).

    Of rows with equal text and doc_id, as a long, the one whose other columns come first as JSON stays.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = rooted.groupBy("root").agg(F.min(rank).alias("k")).select("k.doc_id", "k.text_hash").alias("s")
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("s.doc_id")) & (F.xxhash64("d.text") == F.col("s.text_hash"))
    kept = docs.alias("d").join(first, same, "left_semi")
    if not rooted.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        return kept
    rows = kept.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"), F.struct("*").alias("row"))
    one = F.min_by("row", F.to_json(F.col("row").dropFields("text"))).alias("row")
    return rows.groupBy("id", "hash").agg(one).select("row.*")
