"""Document quality by a sparse ensemble of rules (after Friedman and Popescu, 2008).

Statistics of the whole text come first, a row each. Shallow trees over a bounded sample of labelled rows give the
candidate rules: each path from a root is a conjunction of comparisons of statistics. A logistic model with a lasso
penalty weighs the rules and drops most of them. What is left is compiled into one Spark column, so that scoring is an
expression over the statistics.

Null and empty texts have zero words and characters and every ratio 0; they are scored by the same rules. Without
labels of both kinds the score is the smoothed share of label 1. Null labels are not used; a document with several
labels has the one of the majority, 1 on a tie. Repeated rows are scored one by one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import work
from .text import DARK, Hasher, group_sums, steps

#: Labelled rows that a model is fitted on, at most (chosen by a hash of doc_id).
SAMPLE = 20_000


def _bytes(chars: str) -> np.ndarray:
    kind = np.zeros(256, bool)
    kind[list(chars.encode())] = True
    return kind


UPPER, DIGIT = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _bytes("0123456789")
SYMBOL, MARK, BANG = _bytes("#*$%&|<>{}[]@^~\\=+_"), _bytes(".,;:?"), _bytes("!")
STATS = ("words", "word_length", "upper", "digit", "symbol", "mark", "bang", "line_words", "repeated_lines", "different_words", "short_words", "longest_word", "repeated_pairs", "open_lines")


def _unique_share(group: np.ndarray, value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Different values of each group over its values."""
    order = np.lexsort((value, group))
    new = np.ones(len(order), np.int64)
    new[1:] = (group[order][1:] != group[order][:-1]) | (value[order][1:] != value[order][:-1])
    n = np.diff(first)
    return np.where(n > 0, group_sums(new, first) / np.maximum(n, 1), 0.0)


def _statistics(texts) -> np.ndarray:
    starts, ends, first = texts.runs(DARK)
    n, rows = np.diff(first), len(texts)
    doc = np.repeat(np.arange(rows), n)
    length, h = ends - starts, Hasher(texts.data)
    word = h(starts, ends)
    safe, size = np.maximum(n, 1), np.maximum(np.diff(texts.at), 1)
    share = lambda kind: group_sums(kind[texts.data], texts.at) / size
    line_start, line_end, line_first = texts.lines()
    filled = np.diff(np.searchsorted(starts, np.append(line_start, len(texts.data)))) > 0
    line_doc = np.repeat(np.arange(rows), np.diff(line_first))[filled]
    lines = np.concatenate([[0], np.cumsum(filled)])[line_first]
    line_start, line_end = line_start[filled], line_end[filled]
    count = np.maximum(np.diff(lines), 1)
    last = texts.data[line_end - 1] if len(line_end) else np.zeros(0, np.uint8)
    pair = np.append(word[:-1] * np.uint64(3) ^ word[1:], 0).astype(np.uint64) if len(word) else word
    longest = np.zeros(rows)
    if len(length):
        np.maximum.at(longest, doc, length)
    out = [
        np.log1p(n), group_sums(length, first) / safe, share(UPPER), share(DIGIT), share(SYMBOL), share(MARK), share(BANG), n / count,
        np.where(np.diff(lines) > 0, 1 - _unique_share(line_doc, h(line_start, line_end), lines), 0.0), _unique_share(doc, word, first),
        group_sums(length <= 3, first) / safe, longest, np.where(n > 0, 1 - _unique_share(doc, pair, first), 0.0), group_sums(~MARK[last], lines) / count,
    ]
    return np.stack([np.asarray(x, float) for x in out])


def with_statistics(docs: DataFrame, name: str = "stats", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with a struct of statistics of ``text``."""
    keep = docs.columns if keep is None else keep
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    kind = pa.struct([(s, pa.float64()) for s in STATS])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in steps(batches):
            found = pa.StructArray.from_arrays([pa.array(x) for x in _statistics(texts)], fields=list(kind))
            yield pa.record_batch([*(part.column(c) for c in keep), found], [*keep, name])

    read = docs if "text" in keep else docs.select(*keep, "text")
    return read.mapInArrow(measured, f"{schema}{', ' * bool(keep)}`{name}` struct<{', '.join(f'{s}: double' for s in STATS)}>")


@dataclass
class Rules:
    """A logistic model over conjunctions of (statistic, is_above, threshold)."""

    intercept: float
    rules: list[tuple[frozenset[tuple[str, bool, float]], float]] = field(default_factory=list)

    def column(self, stats: str = "stats") -> Column:
        """The score, 0 to 1, as an expression over the struct of statistics."""
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            total = total + F.when(condition(rule, stats), float(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def condition(rule: frozenset[tuple[str, bool, float]], stats: str) -> Column:
    tests = (F.col(stats)[s] > t if above else F.col(stats)[s] <= t for s, above, t in sorted(rule))
    return reduce(lambda a, b: a & b, tests)


def paths(debug: str) -> set[frozenset[tuple[str, bool, float]]]:
    """All paths from the root of a tree, given as Spark's text of the tree, as rules."""
    found, path = set(), []
    for line in debug.splitlines():
        if m := re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line):
            path = [x for x in path if x[0] < len(m[1])] + [(len(m[1]), (STATS[int(m[2])], m[3] == ">", float(m[4])))]
            found.add(frozenset(x for _, x in path))
    return found


def labelled(labels: DataFrame, label: str = "quality", limit: int = SAMPLE) -> DataFrame:
    """(doc_id, label) of rows that may be learned from: crc32(doc_id as text) mod 3 is not 1."""
    known = labels.where(F.col(label).isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("double").alias("label"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def in_order(sample: DataFrame) -> DataFrame:
    """The bounded sample, written in a fixed order, as the trees' draws depend on it: reruns give the same model."""
    return work.written(sample.repartition(1).sortWithinPartitions("doc_id", "label", *(F.col("stats")[s] for s in STATS)), "labelled")


def fit(sample: DataFrame, stats: str = "stats", trees: int = 16, depth: int = 3, penalty: float = 0.001, seed: int = 7) -> Rules:
    """Rules from a bounded sample with ``label`` and the statistics."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    seen = sample.groupBy("label").count().collect()
    count = {r["label"]: r["count"] for r in seen}
    prior = math.log((count.get(1.0, 0) + 1) / (count.get(0.0, 0) + 1))
    if len(count) < 2:
        return Rules(prior)
    flat = sample.select("label", *(F.col(stats)[s].alias(s) for s in STATS))
    vector = VectorAssembler(inputCols=list(STATS), outputCol="features")
    forest = RandomForestClassifier(labelCol="label", numTrees=trees, maxDepth=depth, maxBins=64, minInstancesPerNode=5, featureSubsetStrategy="0.5", seed=seed).fit(vector.transform(flat))
    rules = sorted(set().union(*(paths(t.toDebugString) for t in forest.trees)), key=lambda r: (len(r), sorted(r)))
    if not rules:
        return Rules(prior)
    binary = sample.select("label", *(F.when(condition(r, stats), 1.0).otherwise(0.0).alias(f"r{k}") for k, r in enumerate(rules)))
    vector = VectorAssembler(inputCols=[f"r{k}" for k in range(len(rules))], outputCol="features")
    table = vector.transform(binary).select("label", "features").cache()
    lasso = LogisticRegression(labelCol="label", elasticNetParam=1.0, regParam=penalty, maxIter=60).fit(table)
    table.unpersist()
    return Rules(lasso.intercept, [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if w])


def without_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with a score of 0.5 or more, by a model of those among them that have labels to learn from."""
    known = labelled(labels)  # SAMPLE rows at most
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    model = fit(in_order(with_statistics(chosen, keep=["doc_id", "label"])))
    name = "stats"
    while name in docs.columns:
        name += "_"
    return with_statistics(docs, name).where(model.column(name) >= 0.5).select(*docs.columns)
