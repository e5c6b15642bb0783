"""The mixture against fair queueing written down one document at a time."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tallyforge.llm import mixing

from .test_operators import docs, water_fill


def brute_mix(rows, place, repeats=3):
    """Words taken of each row: all pieces sorted by finish time, truncated at the budget. place: shuffled order."""
    size = [len((t or "").split()) for _, t, _, _ in rows]
    total = Counter()
    for n, r in zip(size, rows, strict=True):
        total[r[3]] += n
    order = sorted(s for s in total if s is not None) + [None] * (None in total)
    goal = water_fill(total, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, repeats)
    cut = {s: int(g + 0.5) for s, g in goal.items()}
    queues = defaultdict(list)
    for k in sorted(range(len(rows)), key=lambda k: place[k]):
        queues[rows[k][3]].append(k)
    stream = []
    for s, queue in queues.items():
        at = 0
        while cut[s] and at < cut[s]:
            for k in queue:
                ends = [at + size[k]] if not at < cut[s] < at + size[k] else [cut[s], at + size[k]]
                for end in ends:
                    stream.append((end / cut[s], (s is not None, s or ""), place[k], at, k, end - at))
                    at = end
    taken, left = Counter(), sum(cut.values())
    for *_, k, n in sorted(stream):
        n = min(n, left)
        taken[k] += n
        left -= n
    return [taken[k] for k in range(len(rows))], goal


def test_words_of_each_document(spark):
    rows = [(i, "w " * (1 + i * 7 % 90), "en", ("a", "b", "c", None)[min(i % 11, 3)]) for i in range(300)]
    rows += [(None, f"null id {k} " + "x " * k, "en", "a") for k in range(40)] + [(7, "twice", "en", "b")] * 2 + [(900, "big " * 3000, "en", "tiny"), (901, None, "en", "tiny"), (902, "", "en", "empty")]
    table = docs(spark, rows)
    places = {}
    for r in mixing.documents(table, 0).collect():
        places.setdefault((r.doc_id, r.source, r.text_hash), []).append((r.place, r["copy"]))
    hashes = [r[0] for r in spark.createDataFrame([(k, r[1]) for k, r in enumerate(rows)], "k int, text string").orderBy("k").select(F.xxhash64("text")).collect()]
    place = [places[(r[0], r[3], h)].pop() for r, h in zip(rows, hashes, strict=True)]
    want, goal = brute_mix(rows, place)
    found = defaultdict(list)
    for r in mixing.mixed(table).collect():
        found[(r.doc_id, r.source, r["size"], r.text_hash)].append(r.taken)
        assert abs(r.target - goal[r.source]) < 1e-6
    expected = defaultdict(list)
    for r, h, n in zip(rows, hashes, want, strict=True):
        expected[(r[0], r[3], len((r[1] or "").split()), h)].append(n)
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in expected.items()}


def test_equal_rows_are_separate_documents(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE", 3)
    rows = [(None, "same words here", "en", "a")] * 50 + [(1, "other", "en", "b")]
    found = mixing.mixed(docs(spark, rows)).collect()
    assert len(found) == 51 and sum(r.taken for r in found if r.source == "a") == 148 and {r.taken for r in found if r.source == "b"} == {3}


def test_columns_of_any_name_come_along(spark):
    rows = docs(spark, [(k, f"w{k} " * (k + 1), "en", "a") for k in range(9)])
    named = rows.withColumn("mix_copy", F.lit(1)).withColumn("copies", F.lit("c")).withColumn("doc", F.lit("d")).withColumn("id", F.lit("i")).withColumn("hash", F.lit(2))
    out = mixing.remixed(named)
    assert out.columns == named.columns
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in named.collect()}
