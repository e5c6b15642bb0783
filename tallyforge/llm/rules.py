"""Quality rules with a perplexity band for each language.

Counting and base rules take whole texts. The perplexity is that of a modified Kneser-Ney model (Chen and Goodman) of
each language's characters, of order ORDER: characters as they are, in every script and in upper and lower case. An
n-gram's code has 16 bits a character (those outside the basic plane are folded into 16), so one of ORDER characters
is 64 bits. Every lang that occurs has a model and a band of its own, a missing one as well.

Spark counts the n-grams of all documents and derives from them, by grouping and joining, the lower orders' counts of
different characters before an n-gram, the discounts of each language and order, and the interpolated probabilities and
back-off weights. They are stored as arrays of hashes (of the codes) in ascending order, a folder a language. Scoring
tasks read the folders of the languages they meet, and look all different n-grams of some texts up at once; nothing of
a model goes through the driver.

Each line is scored by its own language's model or by that of the PEERS languages of most documents that fits it best,
so texts that mix languages are not strange ones. A document is rejected if its log perplexity is outside its language's
band: median less ``below`` and median plus ``above`` times the spread (the middle half's width over 1.349, at least
0.02), all from the whole corpus. Documents of fewer than ``least`` words are judged by the base rules alone. A null
text has no words. Repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import work
from .text import DARK, Hasher, Texts, find, group_sums, mix, steps

ORDER = 4
#: Bits of a character in an n-gram's code.
BITS = 16
#: Languages whose models may score any line.
PEERS = 4
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def characters(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The character of each place of all texts, in BITS bits; the first of each text."""
    data = texts.data
    head = (data & 0xC0) != 0x80
    at = np.flatnonzero(head)
    code = data[at].astype(np.uint32)
    more = lambda rows, k: data[np.minimum(at[rows] + k, len(data) - 1)].astype(np.uint32) & 0x3F
    for low, high, mask, size in ((0xC0, 0xE0, 0x1F, 2), (0xE0, 0xF0, 0x0F, 3), (0xF0, 0x100, 0x07, 4)):
        rows = np.flatnonzero((code >= low) & (code < high) & (data[at] >= low))
        value = data[at[rows]].astype(np.uint32) & mask
        for k in range(1, size):
            value = value << np.uint32(6) | more(rows, k)
        code[rows] = value
    code = (code ^ (code >> np.uint32(BITS)) * np.uint32(0x9E37)) & np.uint32(0xFFFF)
    return code, np.concatenate([[0], np.cumsum(head)])[texts.at]


def grams(code: np.ndarray, first: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Codes of all n-grams of ``order`` characters, each text after order - 1 ends of line.

    The code's lowest bits are the character, above them the one before it, and so on.
    """
    n, pad = len(first) - 1, order - 1
    full = np.full(len(code) + n * pad, 0x0A, np.uint64)
    shift = np.repeat(np.arange(1, n + 1) * pad, np.diff(first))
    full[np.arange(len(code)) + shift] = code
    out = full.copy()
    for k in range(1, order):
        out[k:] |= full[:-k] << np.uint64(BITS * k)
    keep = np.ones(len(full), bool)
    start = first[:-1] + np.arange(n) * pad
    for k in range(pad):
        keep[start + k] = False
    return out[keep]


def language(lang: Column) -> Column:
    return F.coalesce(lang.cast("string"), F.lit(""))


def count_grams(docs: DataFrame) -> DataFrame:
    """(language, code, n): the n-grams of all documents."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def rows(name: str) -> pa.RecordBatch:
            code, n = _summed(held.pop(name))
            return pa.record_batch([pa.array([name] * len(code), pa.string()), pa.array(code.view(np.int64)), pa.array(n)], ["language", "code", "n"])

        for part, texts in steps(batches):
            names = np.array(part.column("language").to_pylist(), object)
            chars, first = characters(texts)
            code = grams(chars, first)
            for name in set(names):
                own = code[np.repeat(names == name, np.diff(first))]
                held.setdefault(name, []).append(np.unique(own, return_counts=True))
                if sum(len(c) for c, _ in held[name]) > 1_000_000:
                    held[name] = [_summed(held[name])]
                    if len(held[name][0][0]) > 500_000:
                        yield rows(name)
        for name in list(held):
            yield rows(name)

    found = docs.select("text", language(F.col("lang")).alias("language")).mapInArrow(counted, "language string, code long, n long")
    return found.groupBy("language", "code").agg(F.sum("n").alias("n"))


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code, back = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return code, np.bincount(back, weights=np.concatenate([n for _, n in parts]), minlength=len(code)).astype(np.int64)


def discounts(level: DataFrame) -> DataFrame:
    """(language, cut): the modified Kneser-Ney discounts of counts of 1, 2 and 3 or more."""
    of = level.groupBy("language").agg(*(F.count_if(F.col("n") == k).cast("double").alias(f"n{k}") for k in range(1, 5)))
    y = F.expr("n1 / (n1 + 2 * n2)")
    within = lambda x, most: F.least(F.greatest(x, F.lit(0.0)), F.lit(most))
    known = F.array(within(1 - 2 * y * F.col("n2") / F.col("n1"), 0.95), within(2 - 3 * y * F.col("n3") / F.col("n2"), 1.95), within(3 - 4 * y * F.col("n4") / F.col("n3"), 2.95))
    few = F.least("n1", "n2", "n3") == 0  # too few n-grams to tell
    return of.select("language", F.when(few, F.array(F.lit(0.5), F.lit(0.75), F.lit(0.9))).otherwise(known).alias("cut"))


def kneser_ney(counted: DataFrame, order: int = ORDER) -> DataFrame:
    """(language, level, kind, code, value): kind 0, log probability of an n-gram; kind 1, log back-off weight of a context.

    Lower orders count the different characters before an n-gram. Level 0 has the probability of an unknown character.
    """
    levels = [counted]
    for n in range(order - 1, 0, -1):
        suffix = F.col("code").bitwiseAND(F.lit((1 << BITS * n) - 1))
        levels.insert(0, work.written(levels[0].groupBy("language", suffix.alias("code")).agg(F.count("*").alias("n")), f"grams-{n}"))
    # tables of a row a language are written, so that Spark knows their size when it chooses how to join them
    flat = work.written(levels[0].groupBy("language").agg((1 / (F.count("*") + 1)).alias("p")), "unknown")
    out = flat.select("language", F.lit(0).alias("level"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("code"), F.log("p").alias("value"))
    below = flat.select("language", F.lit(0).cast("long").alias("code"), "p")
    for n, level in enumerate(levels, 1):
        cut = F.element_at("cut", F.least(F.col("n"), F.lit(3)).cast("int"))
        grams_n = level.join(work.written(discounts(level), "discounts"), "language").select("language", "code", "n", cut.alias("less"), F.shiftrightunsigned("code", BITS).alias("context"))
        contexts = grams_n.groupBy("language", "context").agg(F.sum("n").alias("total"), (F.sum("less") / F.sum("n")).alias("back"))
        suffix = F.col("code").bitwiseAND(F.lit((1 << BITS * (n - 1)) - 1)) if n > 1 else F.lit(0).cast("long")
        lower = below.select("language", F.col("code").alias("suffix"), F.col("p").alias("lower"))
        grams_n = grams_n.withColumn("suffix", suffix).join(contexts, ["language", "context"]).join(lower, ["language", "suffix"])
        below = work.written(grams_n.select("language", "code", ((F.col("n") - F.col("less")) / F.col("total") + F.col("back") * F.col("lower")).alias("p")), f"probabilities-{n}")
        row = lambda kind, code, value: (F.lit(n).alias("level"), F.lit(kind).alias("kind"), code.alias("code"), F.log(value).alias("value"))  # noqa: E731, B023
        out = out.unionByName(below.select("language", *row(0, F.col("code"), F.col("p"))))
        out = out.unionByName(contexts.select("language", *row(1, F.col("context"), F.greatest("back", F.lit(1e-12)))))
    return out


def stored(model: DataFrame, numbers: DataFrame) -> str:
    """The folder with the arrays of each language (numbers: language, number): hashes in ascending order, and values."""
    folder = work.shared_dir(model.sparkSession, "perplexity-model")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = mix(b.column("code").to_numpy().view(np.uint64)).view(np.int64) ^ np.int64(-(1 << 63))  # signed order is that of the unsigned hash
            yield pa.record_batch([*(b.column(c) for c in ("number", "level", "kind")), pa.array(key), b.column("value")], ["number", "level", "kind", "key", "value"])

    rows = model.join(numbers, "language").select("number", "level", "kind", "code", "value").mapInArrow(hashed, "number int, level int, kind int, key long, value double")
    rows = rows.repartitionByRange("number", "kind", "level", "key").sortWithinPartitions("number", "kind", "level", "key")
    rows.select("number", "kind", "level", "key", F.col("value").cast("float")).write.partitionBy("number").parquet(folder)
    return folder


@dataclass
class Model:
    """Ascending hashes of each order's n-grams with their log probabilities, and of contexts with their back-off weights."""

    unknown: float
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]

    def score(self, code: np.ndarray) -> np.ndarray:
        """Log probability of each n-gram's last character after the others."""
        out = np.full(len(code), self.unknown)
        for n, ((hashes, logs), (of, back)) in enumerate(zip(self.grams, self.contexts, strict=True), 1):
            part = code & np.uint64((1 << BITS * n) - 1)
            at, there = find(hashes, mix(part))
            seen, known = find(of, mix(part >> np.uint64(BITS)))
            lower = out + np.where(known, back[seen] if len(back) else 0.0, 0.0)
            out = np.where(there, logs[at] if len(logs) else 0.0, lower)
        return out


def load(folder: str, number: int) -> Model:
    """The model of a language from its files; without any (only empty texts) it has nothing to tell."""
    fs, path = work.filesystem(f"{folder}/number={number}")
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return Model(0.0, [], [])
    table = pads.dataset(path, filesystem=fs, format="parquet").to_table(columns=["kind", "level", "key", "value"])
    kind, level, key, value = (table.column(c).to_numpy() for c in ("kind", "level", "key", "value"))
    key = (key ^ np.int64(-(1 << 63))).view(np.uint64)
    found: tuple[list, list] = ([], [])
    for k in range(2):
        for n in range(1, int(level.max()) + 1):
            own = np.flatnonzero((kind == k) & (level == n))
            own = own[np.argsort(key[own], kind="stable")]  # files are sorted, and may be listed in any order
            found[k].append((key[own], value[own].astype(float)))
    return Model(float(value[level == 0][0]), *found)


_models: dict[tuple[str, int], Model] = {}
#: Models that a worker keeps at most.
KEPT = 16


def model_of(folder: str, number: int) -> Model:
    key = folder, number
    if key not in _models:
        for old in [k for k in _models if k[0] != folder] or (list(_models)[:1] if len(_models) >= KEPT else []):
            del _models[old]
        _models[key] = load(folder, number)
    return _models[key]


def train(docs: DataFrame) -> tuple[str, DataFrame]:
    """The folder of the models, and (language, number): languages by their number of documents."""
    ranked = docs.groupBy(language(F.col("lang")).alias("language")).agg(F.count("*").alias("n"))
    numbers = ranked.select("language", (F.row_number().over(Window.orderBy(F.col("n").desc(), "language")) - 1).cast("int").alias("number"))  # a row a language
    numbers = work.written(numbers, "languages")
    return stored(kneser_ney(work.written(count_grams(docs), f"grams-{ORDER}")), numbers), numbers


def measured(docs: DataFrame, folder: str, numbers: DataFrame) -> DataFrame:
    """doc_id, language, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, log_perplexity (per character)."""
    peers = [r.number for r in numbers.orderBy("number").limit(PEERS).collect()]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in steps(batches):
            number = part.column("number").to_numpy()
            chars, begin = characters(texts)
            code, back = np.unique(grams(chars, begin), return_inverse=True)
            line = np.unique(np.concatenate([begin, np.flatnonzero(chars == 0x0A) + 1]))
            owner = number[np.searchsorted(begin, line[:-1], "right") - 1]
            best = np.full(len(line) - 1, -np.inf)
            for k in dict.fromkeys([*peers, *number.tolist()]):
                sums = group_sums(model_of(folder, k).score(code)[back], line)
                best = np.where((owner == k) | (k in peers), np.maximum(best, sums), best)
            perplexity = -group_sums(best, np.searchsorted(line, begin)) / np.maximum(np.diff(begin), 1)
            yield pa.record_batch([part.column("doc_id"), part.column("language"), *(pa.array(x, pa.int64()) for x in base_counts(texts)), pa.array(perplexity)], ["doc_id", "language", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_perplexity"])

    read = docs.select(F.col("doc_id").cast("long"), "text", language(F.col("lang")).alias("language")).join(numbers, "language")
    return read.mapInArrow(scored, "doc_id long, language string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_perplexity double")


def repeated(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value, whether its group has it more than once, and whether an earlier one in the group equals it."""
    order = np.lexsort((value, group))
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = (group[order][1:] == group[order][:-1]) & (value[order][1:] == value[order][:-1])
    often, again = np.zeros(len(order), bool), np.zeros(len(order), bool)
    often[order], again[order] = same[:-1] | same[1:], same[:-1]
    return often, again


def base_counts(texts: Texts) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    data, h = texts.data, Hasher(texts.data)
    starts, ends, first = texts.runs(DARK)
    rows = np.arange(len(texts))
    doc = np.repeat(rows, np.diff(first))
    heads = (data & 0xC0) != 0x80  # first bytes of characters
    word_chars = group_sums(heads & DARK[data], texts.at)

    word = h(starts, ends)
    three = np.zeros(0, np.uint64)
    cover = np.zeros(len(word) + 1, np.int64)
    if len(word) >= 3:
        three = (word[:-2] * np.uint64(0x9E3779B97F4A7C15) + word[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + word[2:]
        inside = np.flatnonzero(doc[:-2] == doc[2:])
        often = inside[repeated(doc[inside], three[inside])[0]]
        np.add.at(cover, often, 1)
        np.add.at(cover, often + 3, -1)
    n_repeat = group_sums(np.cumsum(cover[:-1]) > 0, first)

    line_start, line_end, line_first = texts.lines()
    filled = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_doc = np.repeat(rows, np.diff(line_first))
    again = repeated(line_doc[filled], h(line_start[filled], line_end[filled]))[1]
    n_dup = np.bincount(line_doc[filled], weights=again, minlength=len(texts)).astype(np.int64)
    return [np.diff(first), word_chars, group_sums(SYMBOLS[data], texts.at), n_dup, n_repeat]


def bands(found: DataFrame, below: float, above: float, least: int) -> DataFrame:
    """(language, low, high) of log perplexity."""
    known = found.where(F.col("n_words") >= least).groupBy("language").agg(F.percentile_approx("log_perplexity", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 10_000).alias("q"))
    spread = F.greatest((F.col("q")[2] - F.col("q")[0]) / 1.349, F.lit(0.02))
    return known.select("language", (F.col("q")[1] - below * spread).alias("low"), (F.col("q")[1] + above * spread).alias("high"))


def judged(docs: DataFrame, below: float = 6.0, above: float = 6.0, least: int = 50) -> DataFrame:
    """The counts of each document with base_failed, log_perplexity and kept."""
    found = work.written(measured(docs, *train(docs)), "perplexity")
    limits = work.written(bands(found, below, above, least), "bands")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(True)) | (F.col("n_words") < least)
    return found.join(limits, "language", "left").withColumn("base_failed", failed).withColumn("kept", ~failed & inside)
