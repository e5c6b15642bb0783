"""The numbered operators: edge cases with defined results, and brute force on small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import components, contamination, elias_fano, lm, mixing, neardup, quality, repeats, rules, secrets, token_files, warc, work
from tallyforge.llm.queries import tokenizer_path
from tallyforge.llm.text import Texts

#: Columns of any name may come along.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, stats string, mark int, size int, row int, k int, target double, start long, text_hash string"
BASE = "The quick brown fox jumps over the lazy dog while seven wizards mix potions in old jars. "


def docs(spark, rows):
    """(doc_id, text[, lang[, source]]) with other columns around them."""
    full = [((*r, *[None] * 4)[:4]) for r in rows]
    return spark.createDataFrame([(i, t, lang, s, None, "x", "y", 1, 2, 3, 4, 0.5, 6, "z") for i, t, lang, s in full], SCHEMA).repartition(3)


def odd(rng=np.random.default_rng(3)):
    """Null, empty, blank and very long texts, ties and repeated rows."""
    words = [bytes(rng.integers(97, 123, rng.integers(1, 9)).astype(np.uint8)).decode() for _ in range(300)]
    say = lambda n: " ".join(rng.choice(words, n))
    long = say(30_000)
    some = say(200)
    return [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, some), (5, some), (6, some + " end"), (7, "x"), (8, "Ünï cödé ß 漢字 " + say(90)), (9, say(120) + "\n" + some[:700]), (None, "no id " + say(80)), (10, say(3)), (11, f"{some[:450]}\n{some[:450]}")]


# 1


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    rows = [*odd(), (12, " lead  and \t trail "), (13, "a  b  c"), (14, "<|endoftext|> x"), (15, "  "), (16, "new\n\nline \n x")]
    found = token_files.encoded(docs(spark, rows), tokenizer_path(), length=64).orderBy("start").collect()
    plain, start = Tokenizer.from_file(tokenizer_path()), 0
    for r, (i, text) in zip(found, sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), strict=True):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.encoded(docs(spark, []), tokenizer_path()).count() == 0


def test_token_files_give_sequences_and_masks(spark):
    folder = work.shared_dir(spark, "seq")
    manifest = token_files.write(docs(spark, [(i, BASE * 4) for i in range(40)]).coalesce(1), folder, tokenizer_path(), length=16)
    k, n = next((r.shard, r.n_tokens) for r in manifest.collect())
    shard = token_files.Shard(folder, k)
    ids, mask = shard.sequence(0)
    assert len(ids) == len(mask) == 16 and mask.all()
    assert sum(int(shard.sequence(i)[1].sum()) for i in range(-(-n // 16))) == n
    assert np.concatenate(list(shard.ids(0, 16))).tolist() == ids.tolist()


# 2


def brute_repeats(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[p : p + length] for d in data for p in range(len(d) - length + 1))
    out = []
    for (i, _), d in zip(rows, data, strict=True):
        cover = [False] * len(d)
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                cover[p : p + length] = [True] * length
        kept = bytes(b for b, c in zip(d, cover, strict=True) if not c)
        runs = sum(c and (not k or not cover[k - 1]) for k, c in enumerate(cover))
        out.append((i, len(d), len(d) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_repeats_against_brute_force(spark):
    rows = [r for r in odd() if len(r[1] or "") < 10_000]
    rows += [(20, "ab" * 600), (21, "ab" * 601), (22, "c" * 399), (23, "c" * 400), (24, "d" * 401), (None, "q" * 450), (None, "q" * 450)]
    found = repeats.without_repeats(docs(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_repeats(rows, repeats.LENGTH)
    assert repeats.without_repeats(docs(spark, [])).count() == 0


def test_merging_many_kinds_in_narrow_buckets():
    rng = np.random.default_rng(5)
    core = rng.integers(97, 123, 700).astype(np.uint8)
    texts = []
    for k in range(30):
        t = core.copy()
        t[rng.integers(0, 120)] = 65 + k % 20
        t[rng.integers(560, 700)] = 65 + k % 20
        texts.append(t)
    data, at = np.concatenate(texts), np.arange(31) * 700
    doc, start, windows, ahead, gram, _ = repeats.anchors(Texts(data, at))
    rows = [(int(g), int(d), int(s), int(w), int(a), data[at[d] + s : at[d] + s + w + repeats.LENGTH - 1]) for d, s, w, a, g in zip(doc, start, windows, ahead, gram.view(np.int64), strict=True)]
    found = set()
    sizes = np.cumsum([0, *(len(r[5]) for r in rows)])
    segment, window = repeats.merge(np.array([r[0] for r in rows]), np.array([r[3] for r in rows]), np.array([r[4] for r in rows]), np.concatenate([r[5] for r in rows]), sizes)
    for s, w in zip(segment, window, strict=True):
        found.add((rows[s][1], rows[s][2] + int(w)))
    every = Counter(t[p : p + repeats.LENGTH].tobytes() for t in texts for p in range(301))
    want = {(d, p) for d, t in enumerate(texts) for p in range(301) if every[t[p : p + repeats.LENGTH].tobytes()] > 1}
    assert found == want and want


def test_grams_with_many_kinds_are_merged_in_narrow_buckets(spark, monkeypatch):
    rng = np.random.default_rng(8)
    core = "".join(chr(x) for x in rng.integers(97, 123, 900))
    texts = [core[: (a := int(rng.integers(0, 150)))] + "A" + core[a + 1 : (b := int(rng.integers(700, 900)))] + "B" + core[b + 1 :] for _ in range(12)]
    rows = list(enumerate(texts))
    reference = brute_repeats(rows, repeats.LENGTH)
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(repeats)  # the workers get the changed limit
    monkeypatch.setattr(repeats, "KINDS", 1)
    try:
        found = repeats.without_repeats(docs(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert sorted((tuple(r) for r in found.collect()), key=str) == reference
    finally:
        cloudpickle.unregister_pickle_by_value(repeats)


# 3


def test_warc_records_of_all_kinds(spark):
    pages = [(1, "http://a", "same " * 9000), (2, "http://b", "same " * 9000), (3, None, None), (4, "u", ""), (5, "u v", "é\r\n\r\n0\r\n"), (5, "u v", "é\r\n\r\n0\r\n"), (None, "n", "same " * 9000), (None, "n", "lone")]
    table = spark.createDataFrame([(i, u, h, "x") for i, u, h in pages], "page_id long, url string, html string, digest string")
    found = warc.archived(table, segment=1000)
    got = sorted((tuple(r) for r in found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "broken").collect()), key=str)
    want = []
    for i, _, h in pages:
        b = (h or "").encode()
        last = max((x for x, _, y in pages if (y or "") == (h or "")), key=lambda x: -1 if x is None else x)
        want.append((i, len(b), warc.base32_sha1(b), "response" if i == last else "revisit", None if i == last else last, False))
    assert got == sorted(want, key=str)
    assert warc.archived(table.limit(0)).count() == 0
    small = warc.archived(table, least=10**6)
    assert {r.record_type for r in small.collect()} == {"response"}


def test_chunked_framing_and_lost_segments(spark):
    assert warc.dechunked(warc.chunked(b"x" * 20000, 7)) == b"x" * 20000
    assert warc.dechunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for broken in (b"", b"5\r\nabc", b"zz\r\n", b"3\r\nabc\r\n"):
        assert warc.dechunked(broken) is None
    folder = work.shared_dir(spark, "lost")
    pages = spark.createDataFrame([(1, "u", "p" * 5000)], "page_id long, url string, html string")
    archives = warc.write(pages, folder, segment=1000)
    fs, path = work.filesystem(folder)
    name = next(r.archive for r in archives.collect() if r.n_records)
    with fs.open_input_stream(f"{path}/{name}", compression=None) as f:
        members = f.read().split(b"\x1f\x8b\x08")
    with fs.open_output_stream(f"{path}/{name}", compression=None) as f:
        f.write(b"\x1f\x8b\x08".join(m for k, m in enumerate(members) if k != 3))
    assert [(r.payload_bytes, r.broken) for r in warc.read(spark, folder, archives).collect()] == [(None, True)]


# 4


def test_quality_rules_learn_and_compile(spark):
    good = [(i, BASE * (1 + i % 5), "en") for i in range(120)]
    bad = [(i, "###$$$ " * (5 + i % 7), "en") for i in range(120, 240)]
    rows = docs(spark, [*good, *bad, (900, None), (901, "")])
    labels = spark.createDataFrame([(i, int(i < 120), "x") for i in range(240)] + [(5, None, "x"), (6, 1, "x")], "doc_id long, quality int, stats string")
    measured = work.written(quality.with_statistics(rows, keep=["doc_id"]), "stats")
    model = quality.fit(measured.join(quality.labelled(labels), "doc_id"))
    assert model.rules
    scored = {r.doc_id: r.score for r in measured.select("doc_id", model.column().alias("score")).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all((scored[i] >= 0.5) == (i < 120) for i in held)
    assert len(scored) == 242 and all(0 <= s <= 1 for s in scored.values())
    assert quality.fit(measured.join(quality.labelled(labels.where("quality = 1")), "doc_id")).rules == []
    assert quality.fit(measured.join(quality.labelled(labels.limit(0)), "doc_id")).intercept == 0
    kept = quality.without_rejected(rows, labels)
    assert kept.columns == rows.columns and {r.doc_id for r in kept.collect()} >= set(range(120))


def test_paths_of_trees():
    text = "DecisionTree\n  If (feature 2 <= 0.5)\n   If (feature 0 <= 1.0)\n    Predict: 0.0\n   Else (feature 0 > 1.0)\n    Predict: 1.0\n  Else (feature 2 > 0.5)\n   Predict: 0.0\n"
    a, b = quality.STATS[2], quality.STATS[0]
    assert quality.paths(text) == {frozenset({(a, False, 0.5)}), frozenset({(a, True, 0.5)}), frozenset({(a, False, 0.5), (b, False, 1.0)}), frozenset({(a, False, 0.5), (b, True, 1.0)})}


# 5

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_contamination(rows, items):
    cut = lambda t: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for i, text in rows:
        w, hit, found = cut(text), set(), set()
        for item, t in items:
            v = cut(t)
            if item is None or not v:
                continue
            n = min(13, len(v))
            for a in range(len(v) - n + 1):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[a : a + n]:
                        hit |= set(range(p, p + n))
                        found.add(str(item))
        out.append((i, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("at_once", [1 << 20, 300])
def test_contamination_against_brute_force(spark, monkeypatch, at_once):
    monkeypatch.setattr(contamination, "ITEMS_AT_ONCE", at_once)
    words = [f"w{k % 23}é" for k in range(60)]
    items = [(1, " ".join(words[:30])), (10, "Solo"), (2, "two, Words!"), (2, "two words"), (3, None), (4, " - "), (None, "never"), (5, " ".join(words[40:53]))]
    rows = [*odd()[:8], (30, " ".join(words)), (31, "xx " * 400 + " ".join(words[5:20])), (32, "solo SOLO two  words solo"), (33, "twowords never"), (34, " ".join(words[:12])), (34, " ".join(words[:13]))]
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, terms string")
    found = contamination.judged(docs(spark, rows), table).select("doc_id", "n_words", "n_hit", "item_ids", "contaminated")
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_contamination(rows, items)
    assert contamination.judged(docs(spark, rows), table.limit(0)).where("n_hit > 0").count() == 0
    assert contamination.judged(docs(spark, []), table).count() == 0


def test_proximity_matches(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    rows = docs(spark, [(1, "alpha x beta gamma"), (2, "alpha beta gamma"), (3, "alpha x x x beta gamma")])
    assert {r.doc_id: r.n_hit > 0 for r in contamination.judged(rows, items, slack=1).collect()} == {1: True, 2: True, 3: False}


# 6

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KEY = "aB3" + "xY9/" * 9 + "q"


def test_secrets_base_spans_and_links(spark):
    far = "word " * 200
    rows = [(1, 'ünï token = "abcdef12" secret:x token=token: abcdefgh'), (2, "AKIA" + "A" * 15 + " AKIA" + "B" * 16), (3, "f" * 24 + "g" + "a" * 23), (4, None), (5, ""), (6, f"AKIA{'Z' * 16} {KEY}"), (7, KEY), (8, f"AKIA{'Z' * 16}\n\n{KEY}"), (9, f"AKIA{'Z' * 16} {far}{far} {KEY}"), (10, "https://h.example/x password=hunter22"), (11, "https://h.example/x"), (12, "user: bob\npassword: hunter22"), (6, f"AKIA{'Z' * 16} {KEY}"), (13, "token=abc " * 3000 + "token=abcdef")]
    found = {}
    for r in secrets.secrets(docs(spark, rows)).collect():
        found.setdefault(r.doc_id, []).append([(s.kind, s.start, s.end) for s in r.found or []])
    for i, text in rows:
        text = text or ""
        want = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] + [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20] + [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        for got in found[i]:
            assert [x for x in got if x[0] in ("assign", "access", "hex")] == sorted(want, key=lambda x: x[1])
    weak = {i: [x[0] for x in g[0] if x[0] not in ("assign", "access", "hex")] for i, g in found.items()}
    assert (weak[6], weak[7], weak[8], weak[9], weak[10], weak[11], weak[12]) == (["key"], [], [], [], ["host"], [], ["user"])
    assert len(found[6]) == 2 and secrets.secrets(docs(spark, [])).count() == 0


# 7


def brute_components(marks):
    """Component id of each (doc_id, mark)."""
    label = {}
    for a in {m for _, m in marks}:
        if a in label:
            continue
        group, queue = {a}, [a]
        while queue:
            x = queue.pop()
            for y in {m for _, m in marks} - group:
                if ((x ^ y) & (2**64 - 1)).bit_count() <= 2:
                    group.add(y)
                    queue.append(y)
        ids = [i for i, m in marks if m in group and i is not None]
        label |= dict.fromkeys(group, min(ids) if ids else None)
    return sorted(((i, m, label[m]) for i, m in marks), key=str)


def test_near_duplicates_against_brute_force(spark):
    import xxhash

    rows = [*odd(), *((100 + k, BASE * 12 + f"tail{k} {k}") for k in range(40)), (200, "A  b\tC"), (201, "a B c"), (202, "two words"), (203, "two words more")]
    found = neardup.near_duplicates(docs(spark, rows))
    got = sorted((tuple(r) for r in found.select("doc_id", "mark", "component_id").collect()), key=str)
    marks = []
    for i, text in rows:
        w = (text or "").encode().lower().split()
        shingles = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        m = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
        marks.append((i, m - (1 << 64) if m >> 63 else m))
    assert got == brute_components(marks)
    kept = neardup.one_of_each(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns and kept.count() == len({c for _, _, c in got if c is not None}) + len({m for _, m, c in got if c is None})
    assert neardup.near_duplicates(docs(spark, [])).count() == 0


def test_links_of_small_and_large_groups(spark):
    rng = np.random.default_rng(2)
    centre = int(rng.integers(1 << 62))
    marks = {centre}
    while len(marks) < 260:  # more than GROUP fingerprints around one
        marks.add(centre ^ sum(1 << int(b) for b in rng.choice(62, 2)))
    marks |= {int(x) for x in rng.integers(-(1 << 62), 1 << 62, 300)}
    marks |= {m ^ 1 << int(rng.integers(62)) ^ 1 << int(rng.integers(62)) for m in list(marks)[-200:]}
    table = spark.createDataFrame([(m,) for m in marks], "mark long")
    edges = neardup.links(table).collect()
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 2 for r in edges)
    roots = {r.node: r.root for r in components.components(neardup.links(table), "a", "b").collect()}
    want = brute_components([(m, m) for m in marks])
    assert {m: roots.get(m, m) for m in marks} == {m: c for m, _, c in want}


def test_golay_keys_are_shared_within_distance_two():
    words = np.random.default_rng(4).integers(0, 1 << 23, 500).astype(np.uint32)
    flips = np.concatenate([[0], 1 << np.arange(23)]).astype(np.uint32)
    own = [set(x) for x in neardup.codeword(words[:, None] ^ flips).tolist()]
    assert {len(x) for x in own} == {1, 6}
    for a in range(23):
        other = neardup.codeword((words ^ np.uint32(1 << a) ^ np.uint32(1 << (a * 7 % 23)))[:, None] ^ flips).tolist()
        assert all(x & set(y) for x, y in zip(own, other, strict=True))


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    assert {r.node: r.root for r in components.components(chain, "a", "b").collect()} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert components.components(chain.limit(0), "a", "b").count() == 0


# 8


def water_fill(sizes, weights, repeats):
    total, open_, goal = sum(sizes.values()), set(sizes), {}
    while True:
        left, w = total - sum(goal.values()), sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / w > repeats * sizes[s] + 1e-9]
        if not over:
            return goal | {s: left * weights[s] / w for s in open_}
        for s in over:
            goal[s] = float(repeats * sizes[s])
            open_.discard(s)


def test_mixing(spark):
    rows = [(i, "w " * (1 + i % 50), "en", f"s{min(i % 9, 3)}") for i in range(400)] + [(1000, "w " * 7, None, None), (1001, None, None, "tiny"), (1002, "one", None, "tiny"), (5, "w " * 6, "en", "s3"), (5, "w " * 6, "en", "s3")]
    found = mixing.mixed(docs(spark, rows)).collect()
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    goal = water_fill(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 3)
    taken = Counter()
    for r in found:
        taken[r.source] += r.taken
        assert r.taken <= 3 * r["size"] and r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source])
    assert all(abs(taken[s] - goal[s]) <= 1 for s in sizes)
    again = mixing.mixed(docs(spark, rows).repartition(7)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    order = mixing.stream(mixing.mixed(docs(spark, rows))).collect()
    assert [r.finish for r in order] == sorted(r.finish for r in order) and sum(r.words for r in order) == sum(taken.values())
    out = mixing.remixed(docs(spark, rows))
    assert out.columns == docs(spark, []).columns and out.where("doc_id = 1001").count() == 0
    assert mixing.mixed(docs(spark, [])).count() == 0
    assert [r.target for r in mixing.mixed(docs(spark, [(1, None)])).collect()] == [0.0]


def test_running_sums_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE", 8)
    rows = [(i, "w " * (1 + i % 7), "en", "one") for i in range(300)]
    found = sorted(mixing.mixed(docs(spark, rows)).collect(), key=lambda r: r.start)
    at = 0
    for r in found:
        assert r.start == at
        at += r["size"]


# 9


def brute_base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    three = Counter(zip(w, w[1:], w[2:], strict=False))
    cover = {p for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(cover)


def test_base_rules_and_bands(spark):
    good = [(100 + i, BASE * 3 + f"number {i} and more {i}", "en") for i in range(60)]
    rows = [*((i, t, lang) for (i, t), lang in zip(odd(), ["en", "de", None, "xx"] * 4, strict=False)), (50, "a b c\n\na b c\n \na b c #$|", "fr"), (51, "q7$z " + "zqxjkvwp" * 60 + " k" * 60, "en"), *good]
    found = {}
    for r in rules.judged(docs(spark, rows)).collect():
        found.setdefault(r.doc_id, []).append(r)
    for i, text, _ in rows:
        base = brute_base(text)
        for r in found[i]:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
            assert r.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0]) and not (r.base_failed and r.kept)
    assert rules.judged(docs(spark, [])).count() == 0


def test_kneser_ney_sums_to_one_and_tells_text_apart(spark):
    folder, numbers = rules.train(docs(spark, [(1, BASE * 30, "en")]))
    assert [tuple(r) for r in numbers.collect()] == [("en", 0)]
    model = rules.load(folder, 0)
    code = lambda t: rules.grams(*rules.characters(Texts(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))))
    every = np.array(sorted({ord(c) for c in BASE}) + [ord("q") << 8], np.uint64)  # and one unknown character
    for before in code(BASE)[:40] & ~np.uint64(0xFFFF):
        assert np.exp(model.score(before | every)).sum() == pytest.approx(1, abs=1e-4)
    score = lambda t: float(model.score(code(t)).mean())
    assert score("the lazy dog") > score("zq xj kv wq")
    assert all(np.all(np.diff(h.astype(object)) > 0) for h, _ in [*model.grams, *model.contexts])


# 10


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, universe in ((0, 9), (1, 1), (500, 500), (900, 10**12), (900, 1000)):
        values = np.unique(rng.integers(0, universe, n)) if n < universe else np.arange(universe)
        coded = elias_fano.EliasFano.build(values, universe)
        assert np.array_equal(coded.get(np.arange(len(values))), values)
        wanted = np.concatenate([values, rng.integers(0, universe, 300)])
        at = {int(v): k for k, v in enumerate(values)}
        assert coded.find(wanted).tolist() == [at.get(int(w), -1) for w in wanted]


def test_language_model(spark):
    rows = [*odd(), *((100 + i, "the cat sat on the mat and " + ("the dog ran" if i % 2 else "the cat slept")) for i in range(80))]
    found = lm.learned_and_scored(docs(spark, rows)).collect()
    cut = lambda t: [*(t or "").encode().lower().split(), None]
    counts = Counter(w for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 10 for w in cut(t))
    total, kinds = sum(counts.values()), len(counts)
    by = {}
    for i, t in rows:
        w = cut(t)
        by.setdefault(i, []).append((len(w), sum(counts[x] > 0 for x in w), sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in w)))
    for r in found:
        n, known, base = by[r.doc_id][0]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and r.base_score == pytest.approx(base, rel=1e-9)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
    cats = [r for r in found if (r.doc_id or 0) >= 100]
    assert all(r.score > r.base_score for r in cats)
    assert lm.learned_and_scored(docs(spark, [])).count() == 0


def test_language_model_probabilities_sum_to_at_most_one(spark):
    rows = docs(spark, [(i, "a b a c a b d a b") for i in range(30)])
    model = lm.learn(rows)
    data = Texts(np.frombuffer(b"a b a c", np.uint8), np.array([0, 7]))
    numbers = [int(lm.opened(model.vocabulary).numbers(lm.tokens(Texts(np.frombuffer(w, np.uint8), np.array([0, len(w)])))[0][:1])[0][0]) for w in (b"a", b"b", b"c", b"d")]
    every = np.arange(model.vocabulary.nodes)
    counts = np.concatenate([lm.opened(model.vocabulary).part(k)[1] for k in range(len(model.vocabulary.cuts) - 1)])
    assert counts.sum() == model.total == 300 and lm.contexts(model, data)[0].min() >= 0
    level = lm.opened(model.levels[0])
    for context in numbers:
        a = level.look_up(np.full(len(every), context), every)[1]
        back = level.of_parents(np.array([context]))[1][0]
        p = a + back * model.unigram(counts)
        assert 0.8 < p.sum() <= 1.0 + 1e-9


# pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    rows = docs(spark, [(i, BASE * 3 + f"{i} " * 20, "en", f"s{i % 3}") for i in range(30)]).select("doc_id", "text", "lang", "source", "n_chars")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_duplicates", "decontamination", "mixture", "token_files"]
    kept = corpus_pipeline.STAGES[3][1](spark, rows, "")
    assert kept.columns == rows.columns
    last = corpus_pipeline.STAGES[4][1](spark, kept, "")
    assert last.count() == kept.count()


def test_groups_with_null_ids_keep_one_document_each(spark):
    rows = docs(spark, [(None, "alpha beta gamma delta"), (None, "alpha beta gamma delta"), (None, BASE * 3), (4, BASE * 3), (4, BASE * 3)])
    assert sorted(str(r.doc_id) for r in neardup.one_of_each(rows).select(F.col("doc_id")).collect()) == ["4", "None"]
