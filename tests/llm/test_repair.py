"""Conversation repair against a search of all edits, and its edges."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

from tallyforge.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, kind int, audit string, digest string, copies int, first string"
WHITE = " \t\n\x0b\x0c\r"


def brute_after(rows):
    """Each conversation's damaged rows (role, text, fault) in order, with turns."""
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        found[conv] += []
        if kind == 0:
            continue
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        found[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, some in found.items():
        some.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(f"{x[1]}\0{x[2]}".encode()).digest()))
        seen, out = set(), []
        for turn, role, text in some:
            bare = text.strip(WHITE)
            fault = "b" if not bare else "d" if (role, text) in seen else "." if bare[-1] in ".!?" else "t"
            seen.add((role, text))
            out.append((turn, role, text, fault))
        found[conv] = out
    return found


def brute_best(rows):
    """(cost, audit, repaired) over all edits, by trying every one with at most two insertions between rows."""
    best = {}

    def step(k, initials, cost, audit, said):
        if best.get((k, initials[-1:]), (10**9, "")) < (cost, audit):
            return
        best[k, initials[-1:]] = (cost, audit)
        if k == len(rows) and initials[-1:] in ("", "a"):
            results.append((cost, audit, said))
        after = {"": "u", "s": "u", "a": "u", "u": "a"}[initials[-1:]]
        name = {"u": "user", "a": "assistant"}[after]
        if audit[-2:] != "II":
            step(k, initials + after, cost + 5, audit + "I", [*said, f"{name}:"])
        if k == len(rows):
            return
        _, role, text, fault = rows[k]
        step(k + 1, initials, cost + 2, audit + "D", said)
        if fault in ".t":
            more = 5 * (fault == "t")
            step(k + 1, initials + after, cost + 1 + more, audit + "R", [*said, f"{name}:{text}"])
            if role and re.fullmatch("s?(ua)*u?", initials + role[0]):
                step(k + 1, initials + role[0], cost + more, audit + "K", [*said, f"{role}:{text}"])

    results = []
    step(0, "", 0, "", [])
    return min(results, key=lambda x: x[:2])


def brute(rows):
    out = []
    for conv, some in brute_after(rows).items():
        turns = [t for t, *_ in some if t is not None]
        faults, initials = [f for *_, f in some], [r[:1] for _, r, *_ in some]
        cost, audit, said = brute_best(some)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out.append((conv, gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows):
    full = spark.createDataFrame([(*r, 1, "x", "y", 2, "z") for r in rows], SCHEMA).repartition(3)
    got = repair.repaired(full).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return sorted(map(tuple, got.collect()), key=str)


def some_rows(seed, conversations, longest):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant"] * 3 + ["system", "tool", "", "unknown", None], ["a.", "b", "", " \n", "hey!", "Why? \n", None, "漢字", "same."]
    rows = [(c, t if rng.random() < 0.95 else None, rng.choice(roles), rng.choice([*texts, f"text {t}.", f"open {t}"])) for c in range(conversations) for t in range(rng.randrange(longest))]
    return rows + rows[:20]


def test_repair_against_all_edits(spark):
    rows = [*some_rows(5, 80, 9), *((None, t, "user", "x.") for t in range(4)), (500, None, None, None)]
    assert found(spark, rows) == brute(rows)


def test_conversations_whose_rows_are_all_dropped(spark):
    gone = [(c, 0) for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    rows = [(c, t, "user", "x.") for c, t in gone]
    assert rows and found(spark, rows) == sorted(((c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, _ in gone), key=str)


def test_blocks_give_what_one_search_gives(monkeypatch):
    rng = random.Random(9)
    for _ in range(300):
        n = rng.randrange(40)
        initials = "".join(rng.choice("uasx") for _ in range(n))
        faults = "".join(rng.choice("..tbd") for _ in range(n))
        monkeypatch.setattr(repair, "BLOCK", 1000)
        whole = repair.cheapest(initials, faults)
        for size in (1, 2, 7):
            monkeypatch.setattr(repair, "BLOCK", size)
            assert repair.cheapest(initials, faults) == whole


def test_long_conversation_and_text(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"turn {t}" + "." * (t % 7 > 0)) for t in range(20_000)]
    rows.append((2, 0, "user", "w " * 500_000 + "."))
    got = {r[0]: r for r in found(spark, rows)}
    after = brute_after(rows)
    assert len(got[1][7].replace("I", "")) == len(after[1]) and got[1][4] == sum(f == "t" for *_, f in after[1])
    assert got[2][2:5] == tuple(sum(f == x for *_, f in after[2]) for x in "bdt")


def test_no_conversations(spark):
    assert found(spark, []) == []
