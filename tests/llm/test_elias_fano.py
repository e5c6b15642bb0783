"""Look-ups in Elias-Fano sequences against a plain search."""

import numpy as np

from tallyforge.llm.elias_fano import EliasFano


def test_ascending_values_are_found_with_one_select_and_no_sort(monkeypatch):
    selects, unique, select = [], np.unique, EliasFano._select
    monkeypatch.setattr(EliasFano, "_select", lambda self, r, zero: selects.append(len(r)) or select(self, r, zero))
    rng = np.random.default_rng(1)
    for n, universe in ((0, 1), (1, 1), (40, 64), (300, 1000), (2000, 10**6), (2000, 10**12)):
        spread = unique(rng.integers(0, universe, n))
        for values in (spread, unique(np.concatenate([spread, np.arange(min(universe, n))]))):  # short and long runs of one high part
            coded, wanted = EliasFano.build(values, universe), np.concatenate([rng.integers(0, universe, 500), values])
            for asked in (wanted, np.sort(wanted), np.sort(wanted)[::-1], wanted[:0]):
                at = np.searchsorted(values, asked)
                expected = [i if i < len(values) and values[i] == x else -1 for i, x in zip(at.tolist(), asked.tolist(), strict=True)]
                assert coded.find(asked).tolist() == expected
    values = unique(rng.integers(0, 10**6, 2000))
    coded = EliasFano.build(values, 10**6)
    monkeypatch.setattr(np, "unique", None)
    selects.clear()
    assert (coded.find(values) == np.arange(len(values))).all()
    assert len([n for n in selects if n]) == 1
