"""Spelling variants against brute force over all wildcard patterns."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from tallyforge.llm import spelling

from .test_operators import docs, odd

_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_words(rows):
    counts = Counter()
    for i, text in rows:
        runs = Counter(x.translate(_LOWER) for x in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""))
        for w, k in runs.items():
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += k
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def brute_variants(rows):
    words, near, holes = brute_words(rows), defaultdict(set), defaultdict(list)
    for w in words:
        for i in range(len(w)):
            holes[w[:i], w[i + 1 :]].append(w)
    for (a, b), group in holes.items():
        for x in group:
            near[x] |= {y for y in group if y != x}
            if a + b in words:
                near[x].add(a + b)
                near[a + b].add(x)
    forms = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 2 * n:
            forms[w] = best

    def root(w):
        while w in forms:
            w = forms[w]
        return w

    return {(w, forms.get(w), root(w), n, len(near[w]), words.get(forms.get(w))) for w, n in words.items()}


def corpus():
    rng = np.random.default_rng(17)
    letters = list("abcdeéßÿ")
    base = ["".join(rng.choice(letters, rng.integers(4, 9))) for _ in range(150)]
    texts = []
    for k in range(40):
        some = []
        for w in rng.choice(base, 300):
            if rng.random() < 0.2:
                p = int(rng.integers(0, len(w)))
                w = [w[:p] + w[p + 1 :], w[:p] + "x" + w[p:], w[:p] + "y" + w[p + 1 :]][rng.integers(0, 3)]
            some.append(w.upper() if rng.random() < 0.1 else w)
        texts.append((k, " ".join(some)))
    chain = ["aaaaaa"] * 3 + ["aaaaab"] * 6 + ["aaaabb"] * 12 + ["aaabbb"] * 24 + ["aabbbb"] * 48  # each the next one's form
    return [*texts, (100, " ".join(chain)), (101, "aaaaa aaaaa aaaaa aaaaaaa aaaaaaa aaaaaaa"), (102, "Straße×STRASSE÷Straße stráße 漢字 Größe groÿe")] + odd()


def found(spark, rows):
    return {tuple(r) for r in spelling.variants(docs(spark, rows)).collect()}


def test_variants_against_brute_force(spark):
    rows = corpus()
    assert found(spark, rows) == brute_variants(rows)


def test_variants_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SHARD", 20)
    rows = corpus()
    assert found(spark, rows) == brute_variants(rows)


def test_chains_of_forms_lead_to_the_last(spark):
    roots = {r[0]: r[2] for r in found(spark, corpus())}
    assert roots["aaaaaa"] == roots["aaaabb"] == "aabbbb"


def test_very_long_words(spark):
    rows = [(k, "q" * 3000 + "z" * k) for k in (0, 0, 0, 1, 1, 1)] + [(k, "é" * 70 + " " + "é" * 71) for k in range(9)]
    assert found(spark, rows) == brute_variants(rows)


def test_nothing_to_find(spark):
    assert found(spark, []) == set()
    assert found(spark, [(1, None), (2, ""), (3, "ab 12 !")]) == set()


def test_wavelet_tree_reports_every_rectangle():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 17, 64):
        values = rng.permutation(n)
        tree = spelling.WaveletTree(values)
        lo, least = rng.integers(0, n, 50), rng.integers(0, n, 50)
        hi, end = np.minimum(n, lo + rng.integers(0, n, 50)), np.minimum(n, least + rng.integers(0, n, 50))
        of, got = tree.report(lo, hi, least, end)
        want = {(q, v) for q in range(50) for v in values[lo[q] : hi[q]].tolist() if least[q] <= v < end[q]}
        assert set(zip(of.tolist(), got.tolist(), strict=True)) == want and len(of) == len(want)
