"""The pipeline's near duplicates: few queries, trees of links joined in tasks, keys compared by blocks."""

import numpy as np
import pandas as pd
import pytest

from tallyforge.llm import components, overlap, work

from .test_overlap import brute_kept, corpus, kept


def test_the_stage_takes_few_queries(spark, monkeypatch):
    names, written = [], work.written
    monkeypatch.setattr(work, "written", lambda df, name, *args, **options: names.append(name) or written(df, name, *args, **options))
    rows = corpus()
    assert kept(spark, rows) == brute_kept(rows)
    assert len(names) <= 36  # each is a query or more, whose plan, code and threads the driver holds


def test_keys_are_compared_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(overlap, "GROUP", 20)
    monkeypatch.setattr(overlap, "BLOCK", 9)
    seen, alike = [], overlap.alike
    monkeypatch.setattr(overlap, "alike", lambda sets, many, few, scratch: seen.append(many.groupBy("key").count().agg({"count": "max"}).first()[0]) or alike(sets, many, few, scratch))
    rows = corpus()
    assert kept(spark, rows) == brute_kept(rows)
    assert seen and seen[0] > 5 * 9


def test_blocks_lose_no_similar_sets():
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63 - 1, 140)
    sets = []
    for _ in range(120):  # bitmaps of two widths, which begin at 128 shingles
        own = np.concatenate([rng.choice(base, rng.integers(100, 136), replace=False), rng.integers(-(2**63), 2**63 - 1, rng.integers(0, 20))])
        sets.append(np.unique(own))
    table = pd.DataFrame({"mark": np.arange(120), "n": [len(x) for x in sets], "root": np.arange(120) // 2, "bits": [overlap.bitmap(x) for x in sets]})
    assert len({len(x) for x in table.bits}) == 2
    similar = set()
    for i in range(120):
        for j in range(i + 1, 120):
            both = len(np.intersect1d(sets[i], sets[j]))
            if i // 2 != j // 2 and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                similar.add((i, j))
    found = set(overlap.matches(table, table)[["a", "b"]].itertuples(index=False, name=None))
    assert similar and similar <= found < {(i, j) for i in range(120) for j in range(i + 1, 120)}
    apart = set(overlap.matches(table[:50], table[50:])[["a", "b"]].itertuples(index=False, name=None))
    assert apart == {(i, j) for i, j in found if i < 50 <= j}


@pytest.mark.parametrize("part", [40, 1 << 18])
def test_trees_have_the_components_of_all_links(spark, monkeypatch, part):
    monkeypatch.setattr(components, "PART", part)
    rng = np.random.default_rng(7)
    nodes = rng.choice(np.arange(-(2**62), 2**62, 2**50), 400, replace=False)
    links = [(int(nodes[i]), int(nodes[j])) for i, j in rng.integers(0, 400, (150, 2))] + [(int(nodes[i]), int(nodes[i + 1])) for i in range(60)]
    label = {x: x for link in links if link[0] != link[1] for x in link}
    while any(label[a] != label[b] for a, b in links if a != b):
        for a, b in links:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    found = components.forest(spark.createDataFrame(links, "x long, y long").repartition(7), "x", "y").collect()
    assert len(found) == len(label) and {r.node: r.root for r in found} == label


def test_no_links(spark):
    assert components.forest(spark.createDataFrame([(3, 3)], "x long, y long"), "x", "y").count() == 0


def test_edited_copies_of_a_text_are_compared_with_it_once(spark, monkeypatch):
    monkeypatch.setattr(overlap, "GROUP", 6)
    rows, longer, written, turns = [], overlap.longer, work.written, []
    monkeypatch.setattr(overlap, "longer", lambda *args: turns.append(args[3]) or longer(*args))
    monkeypatch.setattr(work, "written", lambda df, name, *args, **options: rows.append((name, found := written(df, name, *args, **options))) or found)
    read, rng = {}, np.random.default_rng(9)
    delete = work.delete
    monkeypatch.setattr(work, "delete", lambda *args: read.update({k: x.count() for k, (name, x) in enumerate(rows) if name == "overlap-many" and k not in read}) or delete(*args))
    base, texts = [f"b{k}" for k in range(150)], []
    for k in range(48):  # up to five words of others; two copies are similar if they have up to three of those
        text = list(base)
        for at in rng.choice(20, k % 6, replace=False):
            text[5 + 7 * at] = f"own{k}.{at}"
        texts.append(text)
    texts = [(k, " ".join(x)) for k, x in enumerate(texts)]
    assert kept(spark, texts) == brute_kept(texts)
    sizes = [read[k] for k in sorted(read)]
    assert not turns and sizes[0] > 300 and sizes[-1] == 0 and sum(sizes) < 4 * sizes[0]
