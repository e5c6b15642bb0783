"""The pipeline's near duplicates against brute force over all pairs."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tallyforge.llm import neardup, overlap
from tallyforge.llm.text import Texts


def brute_kept(rows):
    """Smallest doc_id of each component of Jaccard similarity 4/5 or more of five-word shingles."""
    sets = {}
    for i, text in rows:
        words = (text or "").lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    ids, label = sorted(sets), {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) > 0:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [i for i in ids if root(i) == i]


def corpus():
    """Chains of edits at similarities about 0.8, a large group of near copies, a common passage, short and empty texts."""
    rng = np.random.default_rng(11)
    words = [f"w{k}" for k in range(400)]
    say = lambda n: list(rng.choice(words, n))

    def edited(text, n):
        text = list(text)
        for k in rng.integers(0, len(text), n):
            text[k] = str(rng.choice(words))
        return text

    texts = [say(int(n)) for n in rng.integers(5, 200, 40)]
    for k in range(60):
        texts.append(edited(texts[k], int(rng.integers(0, 5))))
    base, passage = say(160), say(60)
    texts += [edited(base, int(rng.integers(1, 5))) for _ in range(90)]
    texts += [passage + say(int(n)) for n in rng.integers(4, 30, 80)]
    texts += [say(2), say(3), ["a", "b"], ["A", "b"], [], [], texts[0]]
    return [*((i, " ".join(x)) for i, x in enumerate(texts)), (len(texts), None)]


def kept(spark, rows):
    found = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "")
    return sorted(r.doc_id for r in found.collect())


def test_stage_keeps_one_of_each_component_of_similar_texts(spark):
    rows = corpus()
    assert kept(spark, rows) == brute_kept(rows)


def test_groups_compared_pair_by_pair_at_the_end(spark, monkeypatch):
    monkeypatch.setattr(overlap, "GROUP", 3)
    monkeypatch.setattr(overlap, "ROUNDS", 1)
    rows = corpus()
    assert kept(spark, rows) == brute_kept(rows)


def test_sets_with_hot_keys_get_further_keys(spark, monkeypatch):
    monkeypatch.setattr(overlap, "GROUP", 3)
    monkeypatch.setattr(overlap, "ROUNDS", 1)
    monkeypatch.setattr(overlap, "OFTEN", 10**6)  # no shingle is known to be frequent before
    turns, longer = [], overlap.longer
    monkeypatch.setattr(overlap, "longer", lambda *args: turns.append(args[3]) or longer(*args))
    rng = np.random.default_rng(5)
    say = lambda n: [f"v{k}" for k in rng.integers(0, 10**6, n)]
    passages, rows = [say(120), say(100)], []
    for k in range(60):  # 40 to 95 in a hundred of each text is a passage; each third has a near copy
        own = say(int(rng.integers(5, 90)))
        text = [*passages[k % 2], *own]
        rows.append(text)
        if k % 3 == 0:
            rows.append([*text[:-2], "x", *text[-2:]])
        if k % 5 == 0:
            rows.append([*own, *passages[k % 2]])
    rows = [(k, " ".join(x)) for k, x in enumerate(rows)]
    assert kept(spark, rows) == brute_kept(rows)
    assert len(turns) > 1


def test_copies_beyond_two_bits_are_found(spark):
    words = [f"t{k}" for k in range(100)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:50], "x", *words[51:]])), (3, " ".join(words[40:]))]
    assert kept(spark, rows) == [1, 3]  # 91 of 101 shingles shared; 56 of 96


def test_columns_of_any_name_come_along(spark):
    schema = "doc_id long, text string, text_hash string, text_hash_ string, mark string, root string, n string, keys string"
    rows = [(i, t, "a", "mine", "c", "d", "e", "f") for i, t in ((1, "one two three four five six"), (1, "one two three four five six"), (2, "other words"), (None, None), (3, ""))]
    found = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, schema), "").collect()
    assert sorted(((r.doc_id, r.text, r.text_hash, r.text_hash_, r.mark, r.root, r.n, r["keys"]) for r in found), key=str) == sorted([rows[0], rows[2], rows[4]], key=str)


def firsts(spark, rows, schema, parts):
    table = spark.createDataFrame(rows, schema).repartition(parts)
    rooted = table.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.crc32(F.coalesce("text", F.lit(""))).alias("root"))
    found = neardup.firsts(table, rooted)
    assert found.columns == table.columns
    return sorted(map(tuple, found.collect()), key=str)


def test_equal_rows_give_the_same_one_whatever_their_ids_are(spark):
    text = "one two three four five six"
    rows = [("7", text, "b"), ("07", text, "a"), (" 7", text, None), ("8", "other words", "c"), (None, "", "e"), (None, "", "d")]
    for parts in (1, 3, 6):
        assert firsts(spark, rows, "doc_id string, text string, lang string", parts) == sorted([rows[2], rows[3], rows[5]], key=str)


def test_equal_rows_with_columns_of_odd_names(spark):
    rows = [(7, "one two", "mine", 1), (7, "one two", "mine", 1), (8, "other words", "c", 4)]
    assert firsts(spark, rows, "doc_id long, text string, TEXT_HASH string, `a.b` int", 2) == rows[1:]


def test_no_documents(spark):
    assert corpus_pipeline.near_duplicates(spark, spark.createDataFrame([], "doc_id long, text string"), "").count() == 0


def test_keys_are_in_the_order_of_the_counts_of_all_texts(spark):
    parts = [f"{x}1 {x}2 {x}3 {x}4 {x}5" for x in "abcd"]
    rows = [(100 * k + j, x) for k, (x, n) in enumerate(zip(parts, (9, 5, 7, 4), strict=True)) for j in range(n)]
    keys, texts = overlap.frequent_shingles(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 5, [])
    data = np.frombuffer("".join(parts).encode(), np.uint8)
    each = [int(x[0]) for x in overlap.shingles(Texts(data, np.arange(5) * len(parts[0])))]
    number = dict(zip(keys.tolist(), texts.tolist(), strict=True))
    assert [number.get(int(overlap.counted_by(np.array([x]))[0])) for x in each] == [9, 5, 7, None]  # 4 are too few
    more = np.sort(np.array([*each, *range(1, 17)]).view(np.uint64)).view(np.int64)  # of 20, five are keys
    assert not {each[0], each[1], each[2]} & set(overlap.prefix(more, (keys, texts)).tolist())
    found = np.sort(np.array(each).view(np.uint64)).view(np.int64)
    whole = overlap.prefix(np.concatenate([found] * 5)[:20], (keys, texts)).tolist()
    assert whole == [each[3]] * 5
    assert overlap.prefix(found[found != each[3]], (keys, texts)).tolist() == [each[1]]
    assert overlap.prefix(found[found != each[3]], (keys, texts), np.array([each[1]])).tolist() == [each[2]]
