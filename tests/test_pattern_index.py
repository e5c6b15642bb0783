"""Patterns found by their literals: the literal is in every match, and candidates lose nothing."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import text
from tallyforge.operators import pattern_index, rules

LITERALS = {
    r"shop": "SHOP", r"(?i)^pay.*ment": "MENT", r"ab": None, r"abcd|xyz": None, r"(abc|x)yzzy": "YZZY", r"colou?r": "COLO", r"a{3}bcde": "BCDE", r"abc[def]+ghij": "GHIJ",
    r"\bword\b": "WORD", r"\x41bcdef": None, r"abc(?:d(?:e(?:f(?:g(?:h)))))": None, r"a.c": None, r"(?u)straße": None, r"x*yyy+zz": "YYY", r"[abc": None, r"": None, r"don't stop": "DON'T STOP",
}


@pytest.mark.parametrize("pattern", LITERALS)
def test_literals(spark, pattern):
    found = spark.createDataFrame([(pattern,)], "p string").select(pattern_index.literal(F.col("p"))).first()[0]
    assert found == LITERALS[pattern]


def corpus(seed=2):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeDE ") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    texts = sorted({" ".join(rng.choices(words, k=rng.randrange(0, 6))) for _ in range(150)})
    patterns = []
    for k in range(300):
        w = rng.choice(words)
        kind = rng.choice(["contains", "starts_with", "exact", "regex", "other"])
        if kind == "regex":
            w = rng.choice([re.escape(w), f"^{w}", f"{w}.*{rng.choice(words)}", f"(?i){w}", f"({w}|zz)", f"[ab]{w}?", "(", "a+b*"])
        patterns.append((f"p{k}", kind, rng.choice(texts) if kind == "exact" else w))
    return texts, patterns


def brute(texts, patterns):
    out = set()
    for t in texts:
        for i, kind, p in patterns:
            try:
                fits = bool(re.search(p, t)) if kind == "regex" else {"contains": p.upper() in t.upper(), "starts_with": t.upper().startswith(p.upper()), "exact": t.upper() == p.upper()}.get(kind, False)
            except re.error:
                fits = False
            if fits:
                out.add((t, i))
    return out


def test_matches_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(pattern_index, "BLOCK", 10)
    texts, patterns = corpus()
    found = pattern_index.matches(spark.createDataFrame([(t,) for t in [*texts, None, texts[0]]], "text string"), spark.createDataFrame(patterns, "id string, match string, pattern string"))
    assert sorted(map(tuple, found.collect())) == sorted(brute(texts, patterns))


RULE = "id string, pos int, match string, pattern string, category_id string, priority int, is_global boolean, account_id string, kind string, amount_op string, amount_value double, amount_value2 double"


def test_first_match_agrees_with_the_compiled_rules(spark):
    rng = random.Random(6)
    texts, patterns = corpus(5)
    listed = []
    for k, (i, kind, p) in enumerate(patterns[:80]):
        op = rng.choice([None, None, "gt", "lte", "eq", "between", "nonsense" if rng.random() < 0 else None])
        listed.append({"id": i, "match": kind, "pattern": p, "category_id": rng.choice(["c", "c", None]), "priority": rng.choice([0, 1, 5, None]), "is_global": rng.random() < 0.7, "account_id": rng.choice(["a", "b", None]), "kind": rng.choice([None, None, "FEE"]), "amount_op": op, "amount_value": rng.choice([3.0, 3.0, None]) if op else None, "amount_value2": rng.choice([7.0, None]) if op else None})
        listed[-1]["pos"] = k
    rows = [(k, rng.choice(["a", "b", None]), rng.choice(["FEE", "OTHER", None]), rng.choice(["3", "-5", "9.5", None]), rng.choice([*texts, None])) for k in range(400)]
    table = spark.createDataFrame(rows, "id int, account_id string, kind string, amount string, notes string")
    names = [x.split()[0] for x in RULE.split(", ")]
    given = spark.createDataFrame([tuple(r[n] for n in names) for r in listed], RULE)
    want = {r.id: r.rule_id for r in rules.first_match(table, listed).collect()}
    assert {r.id: r.rule_id for r in pattern_index.first_match(table, given).collect()} == want and any(want.values())


def test_patterns_of_merchant_keys_have_literals(spark):
    keys = ["SMALL RING", "COFFEE", "A B", "POS BANK"]
    got = spark.createDataFrame([(k, text.merchant_pattern(k)) for k in keys], "k string, p string").select("k", pattern_index.literal(F.col("p"))).collect()
    assert dict(map(tuple, got))["SMALL RING"] == "SMALL" and dict(map(tuple, got))["COFFEE"] == "COFFEE"
    rows = spark.createDataFrame([(1, "SMALL RING", "sq *small ring 5"), (2, "X", "Small  Ring"), (3, "X", "tiny ring")], "id int, merchant string, notes string")
    wanted = spark.createDataFrame([("SMALL RING", text.merchant_pattern("SMALL RING"))], "key string, pattern string")
    assert sorted(map(tuple, rules.descriptions_matching(rows, wanted).collect())) == [("SMALL RING", 1), ("SMALL RING", 2)]


def test_many_rules_of_one_pattern_leave_short_lists(spark):
    names = "id string, pos long, match string, pattern string, category_id string, priority int, is_global boolean, account_id string, kind string, amount_op string, amount_value double, amount_value2 double"
    rules = [(f"r{k}", k, "contains", "coffee", "c", 5 if k % 2 else k % 3, k % 2 == 0, str(k), None, "gt", 10.0 if k % 4 == 0 else 20.0, None) for k in range(300)]
    rules += [("last", 999, "contains", "off", "c", -1, True, None, None, None, None, None), ("never", 1000, "contains", "coffee", "c", -1, True, None, None, None, None, None)]
    rows = [(k, str(k % 310), "x", float(k % 40), "some Coffee") for k in range(620)]
    table, listed = spark.createDataFrame(rows, "row long, account_id string, kind string, amount double, notes string"), spark.createDataFrame(rules, names)
    want = {}
    for row, account, _, amount, _ in rows:
        fit = [(-r[5], r[1], r[0]) for r in rules if (r[6] or r[7] == account) and (r[9] is None or amount > r[10])]
        want[row] = min(fit)[2]
    found = pattern_index.first_match(table, listed)
    assert {r.row: r.rule_id for r in found.collect()} == want and len(set(want.values())) > 40
    shared, single = pattern_index.choices(table, listed)
    assert [len(r.shared_) for r in shared.collect()] == [3]
    assert max(len(r.single_) for r in single.collect()) == 1
