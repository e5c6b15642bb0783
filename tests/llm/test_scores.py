"""The language model's scores against the same estimates from dictionaries."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyforge.llm import lm

from .test_operators import docs, odd


def brute_scores(rows, order=3):
    """Log10 probability of each row's tokens: Witten-Bell weights in steps, singletons as well."""
    cut = lambda t: [*(t or "").encode().lower().split(), None]
    train = [cut(t) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 10]
    words = Counter(w for t in train for w in t)
    total, kinds = sum(words.values()), len(words)
    follow = [defaultdict(Counter) for _ in range(order + 1)]
    for t in train:
        for k, w in enumerate(t):
            for n in range(2, order + 1):
                if k >= n - 2:
                    follow[n][tuple(["start", *t][k + 2 - n : k + 1])][w] += 1
    step = lambda x: lm.VALUES[lm.quantised(np.array([x]))][0]

    def p(t, k):
        out = (words[t[k]] + 0.1) / (total + 0.1 * (kinds + 1))
        for n in range(2, order + 1):
            if k < n - 2:
                break
            after = follow[n].get(tuple(["start", *t][k + 2 - n : k + 1]))
            if after is None:
                continue
            of = sum(after.values()) + len(after)
            out = (step(after[t[k]] / of) if after[t[k]] else 0) + step(1 - sum(c / of for c in after.values())) * out
        return out

    return sorted((str(i), sum(math.log10(p(cut(t), k)) for k in range(len(cut(t))))) for i, t in rows)


def test_scores_against_brute_force(spark):
    rng = np.random.default_rng(6)
    vocabulary = ["".join(rng.choice(list("abcdef"), 2)) for _ in range(20)]
    rows = [r for r in odd() if len(r[1] or "") < 10_000]
    rows += [(200 + k, " ".join(rng.choice(vocabulary, 40)) + f" once{k}") for k in range(60)]
    found = sorted((str(r.doc_id), r.score) for r in lm.learned_and_scored(docs(spark, rows)).collect())
    want = brute_scores(rows)
    assert [i for i, _ in found] == [i for i, _ in want]
    for (_, a), (_, b) in zip(found, want, strict=True):
        assert a == pytest.approx(b, rel=1e-6)


class Noted(lm.Parts):
    """Parts that note each time one of their files is opened."""

    def uri(self, k):
        with open(f"{self.folder.removeprefix('file://')}/opened", "a") as file:
            file.write(f"{self.level} {k}\n")
        return super().uri(k)


def test_a_part_is_opened_once_however_many_texts_ask_it(spark):
    rng = np.random.default_rng(8)
    texts = docs(spark, [(k, " ".join(f"w{i}" for i in rng.integers(0, 3000, 400))) for k in range(48)]).repartition(12)
    model = lm.learn(texts)
    noted = lm.Model(Noted(**vars(model.vocabulary)), [Noted(**vars(p)) for p in model.levels], model.total)
    found = sorted((r.doc_id, r.n_known, r.score) for r in lm.score(texts, noted).collect())
    with open(f"{model.vocabulary.folder.removeprefix('file://')}/opened") as file:
        times = Counter(file.read().splitlines())
    assert set(times.values()) == {1} and len(times) == 3 * (len(model.vocabulary.cuts) - 1)
    assert found == sorted((r.doc_id, r.n_known, r.score) for r in lm.score(texts, model).collect())


def test_scores_do_not_depend_on_how_texts_are_dealt_out(spark):
    rows = docs(spark, [r for r in odd() if len(r[1] or "") < 10_000])
    dealt = [sorted(((str(r.doc_id), r.base_score, r.score) for r in lm.learned_and_scored(rows.repartition(n)).collect())) for n in (1, 5)]
    assert dealt[0] == dealt[1]
