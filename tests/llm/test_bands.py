"""Perplexity bands: planted junk is rejected, clean and mixed texts are kept."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyforge.llm import rules


def test_junk_of_many_words_is_rejected_and_mixed_texts_are_kept(spark):
    rng = np.random.default_rng(5)
    vocabulary = lambda letters: ["".join(rng.choice(list(letters), rng.integers(2, 9))) for _ in range(400)]
    words = {"en": vocabulary("aeinorstl"), "de": vocabulary("bcdehugkz")}
    say = lambda lang, n=90: " ".join(rng.choice(words[lang], n))
    rows = [(i, say(lang), lang) for i, lang in enumerate(["en", "de"] * 60)]
    mess = lambda n: " ".join("".join(rng.permutation(list(w))) for w in rng.choice(words["en"], n))
    junk = [(1000 + i, f"{mess(30)} {say('en', 60)}", "en") for i in range(3)]
    mixed = [(2000 + i, f"{say('en')}\n{say('de')}\n{say('en')}", "en") for i in range(3)]
    table = spark.createDataFrame(rows + junk + mixed, "doc_id long, text string, lang string").repartition(3)
    kept = {r.doc_id: (r.base_failed, r.kept) for r in rules.judged(table).collect()}
    assert not any(failed for failed, _ in kept.values())
    assert [kept[i][1] for i, *_ in junk] == [False] * 3
    assert all(kept[i][1] for i, *_ in rows + mixed)


def brute_scores(rows, order=rules.ORDER):
    """Log perplexity of each (id, text, lang) by the best of its language's and the most frequent languages' models."""
    cut = lambda t: "\n" * (order - 1) + t
    by = defaultdict(list)
    for _, t, lang in rows:
        by[lang or ""].append(t or "")
    models = {}
    for lang, texts in by.items():
        levels = [Counter(cut(t)[k : k + order] for t in texts for k in range(len(t)))]
        while len(next(iter(levels[0]), "x")) > 1:
            levels.insert(0, Counter(g[1:] for g in levels[0]))
        tables = []
        for level in levels:
            n = [sum(c == k for c in level.values()) for k in range(1, 5)]
            if min(n[:3]) == 0:
                d = [0, 0.5, 0.75, 0.9]
            else:
                y = n[0] / (n[0] + 2 * n[1])
                d = [0] + [min(max((k + 1) - (k + 2) * y * n[k + 1] / n[k], 0), most) for k, most in enumerate((0.95, 1.95, 2.95))]
            total, left = Counter(), Counter()
            for g, c in level.items():
                total[g[:-1]] += c
                left[g[:-1]] += d[min(c, 3)]
            tables.append((level, d, total, left))
        models[lang] = (tables, 1 / (len(levels[0]) + 1))

    def p(lang, g):
        tables, out = models[lang]
        for n, (level, d, total, left) in enumerate(tables, 1):
            part = g[-n:]
            if total[part[:-1]]:
                back = left[part[:-1]] / total[part[:-1]]
                out = (level[part] - d[min(level[part], 3)]) / total[part[:-1]] + back * out if level[part] else max(back, 1e-12) * out
        return out

    peers = sorted(by, key=lambda x: (-len(by[x]), x))[: rules.PEERS]
    out = []
    for i, t, lang in rows:
        t, total = t or "", 0.0
        padded, at = cut(t), 0
        for line in t.splitlines(keepends=True):
            here = range(at, at + len(line))
            total += max(sum(math.log(p(x, padded[k : k + order])) for k in here) for x in {*peers, lang or ""})
            at += len(line)
        out.append((i, -total / max(len(t), 1)))
    return dict(out)


def test_perplexity_and_verdicts_against_brute_force(spark):
    rng = np.random.default_rng(11)
    scripts = {"en": "etaoinsh", "ru": "оеаинтсрв", "zh": "的一是不了人我在有他", "xx": "EtAoI𝒳𝒴", None: "qwz"}
    rows = []
    for k in range(160):
        lang = list(scripts)[k % 7 % 5]
        words = ["".join(rng.choice(list(scripts[lang]), 3)) for _ in range(25)]
        rows.append((k, "\n".join(" ".join(rng.choice(words, 30)) for _ in range(2)), lang))
    rows += [(500, "的@ " * 3 + " ".join("".join(chr(c) for c in rng.integers(0x400, 0x4FF, 4)) for _ in range(60)), "ru"), (501, None, "ru"), (502, "", None), (503, "few words", "en")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    found = {r.doc_id: r for r in rules.judged(table).collect()}
    want = brute_scores(rows)
    for i, value in want.items():
        assert found[i].log_perplexity == pytest.approx(value, rel=1e-5, abs=1e-6)
    for lang in scripts:
        own = sorted(r.log_perplexity for r in found.values() if r.language == (lang or "") and r.n_words >= 50)
        low, middle, high = (own[math.ceil(q * len(own)) - 1] for q in (0.25, 0.5, 0.75))
        spread = max((high - low) / 1.349, 0.02)
        for r in found.values():
            if r.language == (lang or ""):
                inside = r.n_words < 50 or middle - 6 * spread <= r.log_perplexity <= middle + 6 * spread
                assert r.kept == (inside and not r.base_failed)
    assert not found[500].kept and not found[500].base_failed
