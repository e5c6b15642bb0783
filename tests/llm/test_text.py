"""Hashes of words and lines: long strings that collide in sums modulo 2**64 are told apart."""

import zlib
from collections import Counter

import numpy as np
import pytest

from tallyforge.llm import contamination, lm, rules
from tallyforge.llm.text import Hasher, Texts

from .test_operators import brute_base, brute_contamination, docs


def thue_morse(n):
    """Two strings of n bytes, one the other's complement."""
    bits = [k.bit_count() & 1 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [64, 256, 1024, 2048, 4096, 8192])
def test_hashes_of_complements_differ(n):
    a, b = thue_morse(n)
    data = np.frombuffer((a + b).encode(), np.uint8)
    h = Hasher(data)(np.array([0, n]), np.array([n, 2 * n]))
    assert h[0] != h[1]


def test_operators_tell_complements_apart(spark):
    pairs = [thue_morse(n) for n in (1024, 2048, 8192)]
    rows = [(k, f"{a}\n{b}\n{a} x y\n{b} x y") for k, (a, b) in enumerate(pairs)] + [(10, pairs[0][0]), (11, pairs[0][1])]
    for r in rules.judged(docs(spark, rows)).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_base(dict(rows)[r.doc_id])
    items = [(1, pairs[1][0]), (2, pairs[0][1])]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = contamination.judged(docs(spark, rows), table).select("doc_id", "n_words", "n_hit", "item_ids", "contaminated")
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_contamination(rows, items)
    counts = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 10 for w in t.split())
    known = {i: 1 + sum(counts[w] > 0 for w in t.split()) for i, t in rows}
    assert {r.doc_id: r.n_known for r in lm.learned_and_scored(docs(spark, rows)).collect()} == known
