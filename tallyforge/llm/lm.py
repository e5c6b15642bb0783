"""An n-gram language model of the corpus in an Elias-Fano trie, in mapped files.

Tokens are lowered words and an end for each text. The vocabulary is all of them: hashes in ascending order with their
counts; a word's number is its place. Level 2 has all pairs, level 3 all triples that occur, as ascending
codes parent * fan + child in an Elias-Fano sequence: the parent is the context's node in the level above, and the child
is the word's number at level 2, and at level 3 its place among the successors of the word before it, which the level's
pointers (first child of each node, Elias-Fano again) give. Looking a word up is so a successor search relative to its
context. Probabilities are Witten-Bell estimates, P(w | context) = a + back * P(w | shorter context), with a and back
rounded down to steps of 0.04 in log10 (a byte each), so that a context's probabilities never exceed 1 together.

Each level is cut by parent into parts, more of them the more text there is (PART), each a file in the shared folder
that is read where it is, so nothing of the model is sent to or gathered by the driver but a row per file.
A context's children are in one part, as its weights need all their counts.

Texts are cut into chunks (STEP). For each level a chunk sends every part the different codes it has there, ascending,
with how often they occur in texts to learn from. The part adds them up into its file, opens that once, looks all codes
up and sends each chunk its answers; the codes of the next level, and at last the scores, rest on them. Work so grows
with the text, not with chunks times parts. What is kept of a chunk meanwhile is its texts as places among its words,
and the answers, as files in the shared folder that are deleted at the end. One process may look words up by itself too
(``contexts``).

Null texts are empty: one end. A null doc_id is learned from. Repeated rows count as often as they occur.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import work
from .elias_fano import EliasFano
from .text import DARK, Hasher, Texts, find, from_planes, give_back, group_sums, pack_sorted, planes, steps, unpack_sorted

#: The hash that stands for the end of a text.
END = np.uint64(0x5851F42D4C957F2D)
#: Bytes of text in a chunk, about, whose n-grams are looked up together.
STEP = 8 << 20
#: Different n-grams that a task holds before it sends them on.
HELD = 1_500_000
#: Bytes of text for each part of a level, about.
PART = 16 << 20
#: Bytes of a level's files that a process looking up by itself keeps open; it opens others anew.
MAPPED = 48 << 20
BLOCK = "part int, codes binary, counts binary"
#: What a chunk asks a part: ascending codes, and how often each occurs in texts to learn from. Chunk -1 is none.
ASKED = "part int, chunk long, codes binary, counts binary"
#: A part's answers, and with chunk -1 its nodes and what it adds to the level's total.
ANSWERED = "part int, chunk long, nodes long, total long, there binary, at binary, a binary, heads binary, weights binary"
QUANTUM = 0.04
ADD = 0.1


def quantised(x: np.ndarray) -> np.ndarray:
    """Steps of QUANTUM below 1, rounded down; 255 is zero."""
    with np.errstate(divide="ignore"):
        q = np.ceil(-np.log10(np.clip(x, 0, 1)) / QUANTUM - 1e-9)
    return np.minimum(q, 255).astype(np.uint8)


VALUES = np.append(10.0 ** (-QUANTUM * np.arange(255)), 0.0)


def save(uri: str, compression: str | None = None, **arrays: np.ndarray) -> None:
    """Arrays as one row of an Arrow file, which is mapped if it is not compressed."""
    fs, path = work.filesystem(uri)
    batch = pa.record_batch([pa.array([np.ascontiguousarray(x).tobytes()], pa.large_binary()) for x in arrays.values()], list(arrays))
    temporary = f"{path}.{np.random.SeedSequence().entropy:x}.tmp"
    with fs.open_output_stream(temporary) as sink, pa.ipc.new_file(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=compression)) as file:
        file.write_batch(batch)
    work.put_in_place(fs, temporary, path)


def save_table(uri: str, table: pa.Table) -> None:
    fs, path = work.filesystem(uri)
    temporary = f"{path}.{np.random.SeedSequence().entropy:x}.tmp"
    with fs.open_output_stream(temporary) as sink, pa.ipc.new_file(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as file:
        file.write_table(table)
    work.put_in_place(fs, temporary, path)


def load(uri: str) -> dict[str, np.ndarray]:
    batch = pa.ipc.open_file(work.open_for_reading(uri)).get_batch(0)
    return {name: np.frombuffer(batch.column(name)[0].as_buffer(), np.uint8) for name in batch.schema.names}


@dataclass
class Parts:
    """A level's files: part k has parents [cuts[k], cuts[k + 1]) and nodes from base[k] on."""

    folder: str
    level: int
    cuts: np.ndarray
    base: np.ndarray
    fan: int

    @property
    def nodes(self) -> int:
        return int(self.base[-1])

    def uri(self, k: int) -> str:
        return f"{self.folder}/level{self.level}-{k:05d}.arrow"


def loaded(level: Vocabulary | Level, k: int) -> dict[str, np.ndarray]:
    """The arrays of a part; the others are closed first if they are too large together."""
    arrays = load(level.parts.uri(k))
    size = sum(x.nbytes for x in arrays.values())
    if level.bytes + size > MAPPED:
        level.open.clear()
        level.bytes = 0
    level.bytes += size
    return arrays


class Vocabulary:
    def __init__(self, parts: Parts):
        self.parts, self.open, self.bytes = parts, {}, 0

    def part(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self.open:
            arrays = loaded(self, k)
            self.open[k] = arrays["hashes"].view(np.uint64), arrays["counts"].view(np.uint32 if len(arrays["counts"]) < len(arrays["hashes"]) else np.int64)
        return self.open[k]

    def numbers(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (or -1) and count of each word hash."""
        wanted, back = np.unique(words, return_inverse=True)
        number, count = np.full(len(wanted), -1, np.int64), np.zeros(len(wanted), np.int64)
        for k, some in slices(wanted >> np.uint64(64 - BITS), self.parts.cuts):
            at, count[some] = self.within(k, wanted[some])
            number[some] = np.where(at >= 0, at + self.parts.base[k], -1)
        return number[back], count[back]

    def within(self, k: int, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in part k (or -1) and count of each word hash."""
        hashes, counts = self.part(k)
        at, there = find(hashes, words)
        return np.where(there, at, -1), np.where(there, counts[at], 0).astype(np.int64) if len(counts) else np.zeros(len(words), np.int64)


#: Vocabulary parts are cut by this many upper bits of the hash.
BITS = 32


def slices(parents: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The slice of ascending parents of each part that has some."""
    edges = np.searchsorted(parents, cuts.astype(parents.dtype))
    for k in range(len(cuts) - 1):
        if edges[k] < edges[k + 1]:
            yield k, slice(edges[k], edges[k + 1])


def different(values: np.ndarray) -> np.ndarray:
    """Whether each of the ascending values is the first of its kind."""
    return np.concatenate([[True], values[1:] != values[:-1]])[: len(values)]


def asked(parent: np.ndarray, child: np.ndarray, fan: int) -> tuple[np.ndarray, ...]:
    """Tokens of known contexts, their different codes, ascending, and the place of each one's code and context among these.

    Unknown parents and children are -1; an unknown child stands as the first one.
    """
    known = np.flatnonzero(parent >= 0)
    code, code_back = np.unique(parent[known] * fan + np.maximum(child[known], 0), return_inverse=True)  # one sort for parents too
    return known, code, code_back, (np.cumsum(different(code // fan)) - 1)[code_back]


class Level:
    """A level of the trie above the vocabulary."""

    def __init__(self, parts: Parts):
        self.parts, self.open, self.bytes = parts, {}, 0

    def part(self, k: int) -> tuple[EliasFano, EliasFano, np.ndarray, np.ndarray]:
        if k not in self.open:
            arrays = loaded(self, k)
            self.open[k] = EliasFano.of(arrays, "codes"), EliasFano.of(arrays, "pointers"), arrays["a"], arrays["back"]
        return self.open[k]

    def both(self, parent: np.ndarray, child: np.ndarray, heads: bool = True) -> tuple[np.ndarray, ...]:
        """Node (or -1) and its a (or 0) of each child of a context, first child's node (if ``heads``) and back-off weight of each context.

        Unknown parents and children are -1; an unknown context has no child and weight 1. A part is opened once.
        """
        fan, cuts, base = self.parts.fan, self.parts.cuts, self.parts.base
        known, code, code_back, wanted_back = asked(parent, child, fan)
        child, n = child[known], len(parent)
        above = code // fan
        found, value = np.full(len(code), -1, np.int64), np.zeros(len(code))
        first, weight = np.zeros(len(code), np.int64), np.ones(len(code))  # as many contexts as codes at most
        done = 0
        for k, some in slices(above, cuts):
            at, a, own, back = self.within(k, code[some], heads)
            found[some] = np.where(at >= 0, at + base[k], -1)
            value[some] = VALUES[a]
            contexts_here = slice(done, done + len(back))
            weight[contexts_here] = VALUES[back]
            if heads:
                first[contexts_here] = own + base[k]
            done += len(back)
        node, a, head, back = np.full(n, -1, np.int64), np.zeros(n), np.zeros(n, np.int64), np.ones(n)
        there = child >= 0
        node[known], a[known] = np.where(there, found[code_back], -1), np.where(there, value[code_back], 0.0)
        head[known], back[known] = first[wanted_back], weight[wanted_back]
        return node, a, head, back

    def within(self, k: int, code: np.ndarray, heads: bool = True) -> tuple[np.ndarray, ...]:
        """Of ascending codes of part k: places there (or -1) and steps of a (255 if not there); of their different contexts: first children's places (if ``heads``) and steps of back-off weights."""
        codes, pointers, weights, backs = self.part(k)
        above = code // self.parts.fan
        own = above[different(above)] - self.parts.cuts[k]
        at = codes.find(code - self.parts.cuts[k] * self.parts.fan)
        a = np.where(at >= 0, weights[at], 255).astype(np.uint8) if len(weights) else np.full(len(code), 255, np.uint8)
        return at, a, pointers.get(own) if heads else np.zeros(0, np.int64), backs[own]

    def look_up(self, parent: np.ndarray, child: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Node (or -1) and its a (or 0) of each child of a context."""
        return self.both(parent, child, heads=False)[:2]

    def of_parents(self, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First child's node and back-off weight of each context."""
        return self.both(parent, np.full(len(parent), -1))[2:]


_opened: dict[str, Vocabulary | Level] = {}


def opened(parts: Parts) -> Vocabulary | Level:
    """The part files that this worker has mapped so far."""
    key = f"{parts.folder}/{parts.level}"
    if key not in _opened:
        for old in [x for x in _opened if not x.startswith(f"{parts.folder}/")]:
            del _opened[old]
        _opened[key] = Vocabulary(parts) if parts.level == 1 else Level(parts)
    return _opened[key]


def tokens(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, and the first of each."""
    starts, ends, first = texts.runs(DARK)
    n = len(texts)
    out = np.full(len(starts) + n, END, np.uint64)
    out[np.arange(len(starts)) + np.repeat(np.arange(n), np.diff(first))] = Hasher(texts.data)(starts, ends)
    return out, first + np.arange(n + 1)


def summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending different codes with their total counts."""
    code, count = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(code, kind="stable")
    code, count = code[order], count[order]
    if not len(code):
        return code, count
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return code[first], np.add.reduceat(count, first)


def blocks(each: Iterable[np.ndarray], parent_of: Callable[[np.ndarray], np.ndarray], cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts of codes as a row for each part, whenever HELD different ones have come together."""

    def rows(code: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k, some in slices(parent_of(code), cuts):
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([pack_sorted(code[some])], pa.binary()), pa.array([planes(count[some].astype(np.uint32))], pa.binary())], ["part", "codes", "counts"])

    codes, counts, held = [], [], 0
    for codes_now in each:
        code, count = np.unique(codes_now, return_counts=True)
        codes.append(code)
        counts.append(count)
        held += len(code)
        if held > HELD:
            code, count = summed(codes, counts)
            if len(code) > HELD // 2:
                yield from rows(code, count)
                codes, counts, held = [], [], 0
            else:
                codes, counts, held = [code], [count], len(code)
    if codes:
        yield from rows(*summed(codes, counts))


def gather(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return summed([unpack_sorted(x) for x in group["codes"]], [from_planes(x, "u4").astype(np.int64) for x in group["counts"]])


@dataclass
class Model:
    vocabulary: Parts
    levels: list[Parts]
    total: int

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return (count + ADD) / (self.total + ADD * (self.vocabulary.nodes + 1))


def contexts(model: Model, texts: Texts, deeper: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, ...]]]:
    """Numbers, counts, first tokens, and for each level (context node, child, a, back-off weight) of every token.

    ``deeper``: with the (context, child) of the level above the last one as well.
    """
    hashes, first = tokens(texts)
    number, count = opened(model.vocabulary).numbers(hashes)
    begin = np.zeros(len(number), bool)
    begin[first[:-1]] = True
    context = np.concatenate([[0], number[:-1]])
    context[begin] = model.vocabulary.nodes  # the start of a text
    child, chain = number, []
    for parts in model.levels:
        more = deeper or parts is not model.levels[-1]
        node, a, head, weight = opened(parts).both(context, child, more)
        chain.append((context, child, a, weight))
        if more:  # the context is the node of the two tokens before, its child is the place among the last one's successors
            child = np.where(node >= 0, node - head, -1)
            context = np.concatenate([[-1], node[:-1]])
            context[begin] = -1
    return number, count, first, [*chain, (context, child)] if deeper else chain


def chunked(docs: DataFrame, learns: Column, folder: str, scratch: list[str]) -> DataFrame:
    """chunk, codes and counts: the words of each chunk and how often they occur in texts to learn from, written.

    A chunk's texts are a file in the folder: where each begins, and the place of every token among the chunk's words.
    Chunks have numbers at random, and those of tasks that failed are in no row.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, each, size = [], [], 0
        for part, texts in steps(batches, lower=True):
            rows.append(part.drop_columns(["text"]))
            each.append(tokens(texts))
            size += len(texts.data)
            if size >= STEP:
                yield whole(pa.Table.from_batches(rows), each)
                rows, each, size = [], [], 0
        if rows:
            yield whole(pa.Table.from_batches(rows), each)
        give_back()

    def whole(rows: pa.Table, each: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        word, index = np.unique(np.concatenate([x for x, _ in each]), return_inverse=True)
        size = np.concatenate([np.diff(first) for _, first in each])
        learned, ids = (rows.column(c).combine_chunks() for c in ("learned", "doc_id"))
        learned = learned.to_numpy(zero_copy_only=False)
        count = np.bincount(index[np.repeat(learned, size)], minlength=len(word))
        chunk = int.from_bytes(os.urandom(8), "little") >> 1
        index = np.frombuffer(planes(index.astype(np.uint32)), np.uint8)
        save(f"{folder}/{chunk:016x}.arrow", "zstd", first=np.cumsum([0, *size]), learned=learned, index=index, ids=ids.fill_null(0).to_numpy(), null=ids.is_null().to_numpy(zero_copy_only=False))
        return pa.record_batch([pa.array([chunk]), pa.array([pack_sorted(word)], pa.binary()), pa.array([planes(count.astype(np.uint32))], pa.binary())], ["chunk", "codes", "counts"])

    read = docs.select(F.col("doc_id").cast("long"), learns.alias("learned"), "text")
    return work.written(read.mapInArrow(cut, "chunk long, codes binary, counts binary"), "chunk-words", scratch, compression="zstd")


def dealt(chunk: int, code: np.ndarray, count: np.ndarray, parent: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
    """A row (see ASKED) for each part that has some of a chunk's codes, and an empty one if there are none."""
    edges = np.searchsorted(parent, cuts.astype(parent.dtype))
    some = np.flatnonzero(np.diff(edges)) if len(code) else np.zeros(1, np.int64)
    code, count = code.astype(np.uint64), count.astype(np.uint32)
    ranges = list(zip(edges[some].tolist(), edges[some + 1].tolist(), strict=True))
    columns = [pa.array(some, pa.int32()), pa.array([chunk] * len(some), pa.int64()), *(pa.array([pack(x[i:j]) for i, j in ranges], pa.binary()) for pack, x in ((pack_sorted, code), (planes, count)))]
    return pa.record_batch(columns, ["part", "chunk", "codes", "counts"])


def joined(column: pa.ChunkedArray, unpack: Callable[[bytes], np.ndarray], kind: type, add: np.ndarray | None = None) -> np.ndarray:
    """The values of all rows one after the other; ``add``: a row's first value."""
    each = [unpack(x) for x in column.to_pylist()]
    return np.concatenate([x.astype(kind) if add is None else x.astype(kind) + add[i] for i, x in enumerate(each)]) if each else np.zeros(0, kind)


def bytes_of(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.uint8)


def served(asking: DataFrame, parts: Parts, write: Callable[[int, np.ndarray, np.ndarray], tuple[int, int]] | None, answers: bool, heads: bool) -> DataFrame:
    """Answers (see ANSWERED) of every part of a level to what all chunks ask it, from its file, which ``write`` writes first.

    A part's file is opened once and asked for each different code once, in ascending order. heads: with the places of
    nodes and of contexts' first children, which the next level needs.
    """
    names = [x.split()[0] for x in ANSWERED.split(", ")]

    def part(group: pa.Table) -> pa.Table:
        k = group.column("part")[0].as_py()
        chunks = [(i, chunk) for i, chunk in enumerate(group.column("chunk").to_pylist()) if chunk >= 0]
        each = [unpack_sorted(x) for x in group.column("codes").to_pylist()]
        edges = np.cumsum([0, *map(len, each)])
        each = np.concatenate(each)
        code, back = np.unique(each, return_inverse=True)
        del each
        rows = []
        if write:
            count = np.bincount(back, weights=joined(group.column("counts"), lambda x: from_planes(x, "u4"), np.uint32), minlength=len(code)).astype(np.int64)
            rows.append((k, -1, *write(k, code[count > 0], count[count > 0]), b"", b"", b"", b"", b""))
        if answers and parts.level == 1:
            at, count = Vocabulary(parts).within(k, code)
            at, count = at[back], count[back]
            for i, chunk in chunks:
                own = at[edges[i] : edges[i + 1]]
                there = own >= 0
                rows.append((k, chunk, 0, 0, there.tobytes(), pack_sorted(own[there].astype(np.uint64)), planes(count[edges[i] : edges[i + 1]]), b"", b""))
        elif answers:
            at, a, head, weight = Level(parts).within(k, code.astype(np.int64), heads)
            context = (np.cumsum(different(code // np.uint64(parts.fan))) - 1)[back]
            at, a, new = at[back], a[back], np.concatenate([[True], context[1:] != context[:-1]])[: len(context)]
            new[edges[:-1][edges[:-1] < edges[1:]]] = True
            context, limits = context[new], np.concatenate([[0], np.cumsum(new)])[edges]
            for i, chunk in chunks:
                own, of = slice(edges[i], edges[i + 1]), context[limits[i] : limits[i + 1]]
                there = at[own] >= 0
                places = (pack_sorted(at[own][there].astype(np.uint64)), pack_sorted(head[of].astype(np.uint64))) if heads else (b"", b"")
                rows.append((k, chunk, 0, 0, there.tobytes(), places[0], a[own][there].tobytes(), places[1], weight[of].tobytes()))
        found = pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), KINDS, strict=True)], names=names)
        give_back()
        return found

    return asking.groupBy("part").applyInArrow(part, ANSWERED)


#: The types of ANSWERED's columns.
KINDS = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in ANSWERED.split(", ")]


@dataclass
class Chunk:
    """A chunk's tokens, as far as the answers of the levels tell."""

    words: dict[str, np.ndarray]
    first: np.ndarray
    count: np.ndarray
    chain: list[tuple[np.ndarray, np.ndarray]]
    context: np.ndarray
    child: np.ndarray

    def learned(self) -> np.ndarray:
        return np.repeat(self.words["learned"].view(bool), np.diff(self.first))


def answers_uri(folder: str, chunk: int, level: int) -> str:
    return f"{folder}/{chunk:016x}-{level}.arrow"


def kept(answered: DataFrame, folder: str, level: int) -> DataFrame:
    """(part, nodes, total) of the parts that were written; the answers become a file a chunk in the folder."""

    def keep(group: pa.Table) -> pa.Table:
        chunk = group.column("chunk")[0].as_py()
        if chunk >= 0:
            save_table(answers_uri(folder, chunk, level), group.select(["part", "there", "at", "a", "heads", "weights"]))
            group = group.slice(0, 0)
        return group.select(["part", "nodes", "total"])

    return answered.groupBy("chunk").applyInArrow(keep, "part int, nodes long, total long")


def followed(model: Model, folder: str, chunk: int, last: pa.Table | None = None) -> Chunk:
    """A chunk with counts, a and back-off weights of its tokens, and what it asks next.

    The answers (see ANSWERED) of the levels are files of the folder; those of the last level may be ``last``, and
    nothing is asked next then.
    """
    words = load(f"{folder}/{chunk:016x}.arrow")
    first, index = words["first"].view(np.int64), from_planes(words["index"], "u4")
    begin = np.zeros(len(index), bool)
    begin[first[:-1]] = True
    chain = []
    count = context = child = None
    for parts in [model.vocabulary, *model.levels]:
        deeper = last is None or parts.level < len(model.levels) + 1
        own = (pa.ipc.open_file(work.open_for_reading(answers_uri(folder, chunk, parts.level))).read_all() if deeper else last).sort_by("part")
        base = parts.base[own.column("part").to_numpy()] if deeper else None
        there = joined(own.column("there"), bytes_of, bool)
        node = np.full(len(there), -1, np.int64)
        if deeper:
            node[there] = joined(own.column("at"), unpack_sorted, np.int64, base)
        if parts.level == 1:
            number = node[index]
            count = joined(own.column("a"), lambda x: from_planes(x, "i8"), np.int64)[index]
            child, context = number, np.concatenate([[0], number[:-1]])
            context[begin] = model.vocabulary.nodes  # the start of a text
            continue
        known, _, code_back, context_back = asked(context, child, parts.fan)
        step = np.full(len(there), 255, np.uint8)
        step[there] = joined(own.column("a"), bytes_of, np.uint8)
        a, weight, real = np.zeros(len(index)), np.ones(len(index)), child[known] >= 0
        a[known] = np.where(real, VALUES[step[code_back]], 0.0)
        weight[known] = VALUES[joined(own.column("weights"), bytes_of, np.uint8)[context_back]]
        chain.append((a, weight))
        if deeper:  # the context is the node of the two tokens before, its child is the place among the last one's successors
            after, head = np.full(len(index), -1, np.int64), np.zeros(len(index), np.int64)
            after[known] = np.where(real, node[code_back], -1)
            head[known] = joined(own.column("heads"), unpack_sorted, np.int64, base)[context_back]
            child = np.where(after >= 0, after - head, -1)
            context = np.concatenate([[-1], after[:-1]])
            context[begin] = -1
    return Chunk(words, first, count, chain, context, child)


def walked(docs: DataFrame, learns: Column, order: int, least: int, model: Model | None, scores: bool) -> tuple[Model, DataFrame | None]:
    """The model of those of ``docs`` (doc_id, text) that ``learns`` says, or the given one, and the scores of all, if wanted (the last level's nodes are not numbered then).

    Texts become chunks. Level by level, every chunk asks the level's parts for its codes: a part sums what it is asked
    into its file, if the model is not there yet, and answers from the file, so that it is opened once whatever the
    text. The next codes rest on the answers.
    """
    spark = docs.sparkSession
    scratch: list[str] = []
    folder = work.shared_dir(spark, "chunks")
    work.make_dir(folder)
    scratch.append(folder)
    learning = model is None
    if learning:
        trie = work.shared_dir(spark, "trie")
        work.make_dir(trie)
        size = docs.where(learns).agg(F.sum(F.octet_length("text"))).first()[0] or 0
        wanted = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART)
        n_parts = 1 << (wanted - 1).bit_length()
        model = Model(Parts(trie, 1, np.arange(n_parts + 1, dtype=np.uint64) * np.uint64((1 << BITS) // n_parts), np.zeros(1, np.int64), 0), [], 0)
    words = chunked(docs, learns, folder, scratch)
    found = None
    for level in range(1, order + 1):
        if learning and level > 1:
            above = model.levels[-1] if level > 2 else model.vocabulary
            parents = above.nodes if level > 2 else above.nodes + 1
            fan = max(1, widest if level > 2 else above.nodes)
            if parents * fan >= 1 << 63:
                raise OverflowError(f"level {level}: {parents} contexts of up to {fan} children do not fit a code of 63 bits")
            model.levels.append(Parts(trie, level, np.arange(n_parts + 1, dtype=np.int64) * parents // n_parts, np.zeros(1, np.int64), fan))
        parts = model.levels[level - 2] if level > 1 else model.vocabulary
        asking = requests(words, model, folder, level)
        if learning:
            every = spark.range(len(parts.cuts) - 1).selectExpr("cast(id as int) part", "-1L chunk", "cast('' as binary) codes", "cast('' as binary) counts")
            asking = asking.unionByName(every)
        answered = served(asking, parts, writer(parts, least) if learning else None, scores or level < order, level < order)
        if scores and level == order:
            found = work.written(scored(answered.where("chunk >= 0"), model, folder), "scores")
            break
        rows = work.written(kept(answered, folder, level), "parts", scratch).collect()  # a row a file
        if learning:
            nodes, total = (np.zeros(len(parts.cuts) - 1, np.int64) for _ in "nt")
            for r in rows:
                nodes[r["part"]], total[r["part"]] = r["nodes"], r["total"]
            parts.base = np.concatenate([[0], np.cumsum(nodes)])
            if level == 1:
                model.total = int(total.sum())
            else:
                widest = int(total.max())
        work.free_shuffles(spark)
    work.delete(spark, scratch)
    return model, found


def requests(words: DataFrame, model: Model, folder: str, level: int) -> DataFrame:
    """What all chunks ask the parts of a level (see ASKED), by the answers of those above it."""
    if level == 1:
        cuts = model.vocabulary.cuts

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    code = unpack_sorted(row["codes"])
                    yield dealt(row["chunk"], code, from_planes(row["counts"], "u4"), code >> np.uint64(64 - BITS), cuts)

        return words.mapInArrow(first, ASKED)
    parts, above = model.levels[level - 2], Model(model.vocabulary, model.levels[: level - 2], model.total)

    def ask(chunk: int) -> pa.RecordBatch:
        now = followed(above, folder, chunk)
        known, code, back, _ = asked(now.context, now.child, parts.fan)
        counted = now.learned()[known] & (now.child[known] >= 0)
        return dealt(chunk, code, np.bincount(back[counted], minlength=len(code)), code // parts.fan, parts.cuts)

    def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.column("chunk").to_pylist():
                yield ask(chunk)
                give_back()

    spread = words.select("chunk").repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return spread.mapInArrow(further, ASKED)


def writer(parts: Parts, least: int) -> Callable[[int, np.ndarray, np.ndarray], tuple[int, int]]:
    """What writes a part's file, and gives its nodes and its tokens, or from level 2 on the most children of a context."""
    cuts, fan = parts.cuts, parts.fan

    def write_words(k: int, code: np.ndarray, count: np.ndarray) -> tuple[int, int]:
        save(parts.uri(k), hashes=code, counts=count.astype(np.uint32) if count.max(initial=0) < 1 << 32 else count)
        return len(code), int(count.sum())

    def write_grams(k: int, code: np.ndarray, count: np.ndarray) -> tuple[int, int]:
        low, n = int(cuts[k]), int(cuts[k + 1] - cuts[k])
        own = (code // np.uint64(fan)).astype(np.int64) - low
        occurrences = np.bincount(own, weights=count, minlength=n)
        kinds = np.bincount(own, minlength=n)
        keep = count >= least
        code, count, own = code[keep], count[keep], own[keep]
        a = VALUES[quantised(count / np.maximum(occurrences + kinds, 1)[own])] if len(own) else np.zeros(0)
        left = 1 - np.bincount(own, weights=count / np.maximum(occurrences + kinds, 1)[own], minlength=n)
        children = np.bincount(own, minlength=n)
        pointers = np.concatenate([[0], np.cumsum(children)])
        relative = code.astype(np.int64) - low * fan
        arrays = EliasFano.build(relative, max(1, n * fan)).arrays("codes") | EliasFano.build(pointers, len(code) + 1).arrays("pointers")
        save(parts.uri(k), **arrays, a=quantised(a), back=quantised(left))
        return len(code), int(children.max(initial=0))

    return write_words if parts.level == 1 else write_grams


def scored(answered: DataFrame, model: Model, folder: str) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of the texts of all chunks; ``answered``: the last level's answers."""

    def score_chunk(group: pa.Table) -> pa.Table:
        now = followed(model, folder, group.column("chunk")[0].as_py(), group)
        base = p = model.unigram(now.count)
        for a, weight in now.chain:
            p = a + weight * p
        sums = [pa.array(np.add.reduceat(np.log10(x), now.first[:-1])) for x in (base, p)]  # every text has an end
        ids = pa.array(now.words["ids"].view(np.int64), mask=now.words["null"].view(bool))
        columns = [ids, pa.array(np.diff(now.first), pa.int64()), pa.array(group_sums(now.count > 0, now.first), pa.int64()), *sums]
        give_back()
        return pa.table(columns, ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return answered.groupBy("chunk").applyInArrow(score_chunk, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def learn(docs: DataFrame, order: int = 3, least: int = 1) -> Model:
    """The model of all of ``docs`` (text)."""
    return walked(docs.select(F.lit(None).cast("long").alias("doc_id"), "text"), F.lit(True), order, least, None, False)[0]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of all of ``docs``."""
    return walked(docs, F.lit(False), len(model.levels) + 1, 1, model, True)[1]


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))


def learned_and_scored(docs: DataFrame, order: int = 3) -> DataFrame:
    """Scores of all documents by a model of those that are not held out."""
    model, found = walked(docs, ~held_out(), order, 1, None, True)
    return found.withColumn("held_out", held_out()).withColumn("train_tokens", F.lit(model.total).cast("long"))
