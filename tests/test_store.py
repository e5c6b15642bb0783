"""Bucketed tables: commits of several tables at once, copy on write, conflicts, crashes at every step."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyforge.sources import store
from tallyforge.sources.store import Conflict, Store

SCHEMA = "id long, kind string, v string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def content(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def size(folder):
    return sum(p.stat().st_size for p in Path(folder).rglob("*") if p.is_file())


def filled(spark, folder, n=2000, buckets=16):
    s = Store(spark, str(folder))
    with s.begin() as t:
        t.create("ledger", spark.range(n).select("id", F.lit("k").alias("kind"), F.sha1(F.col("id").cast("string")).alias("v")), ["id"], buckets)
        t.create("quotes", frame(spark, [(1, "q", "a")]), ["id", "kind"], 4)
    return s


def test_two_tables_change_together(spark, tmp_path):
    s = filled(spark, tmp_path, 10)
    with s.begin() as t:
        t.upsert("ledger", frame(spark, [(3, "new", "x"), (99, "new", None)]), verify=True)
        t.upsert("quotes", frame(spark, [(1, None, "n"), (1, "q", "b")]))
        assert s.read("quotes").count() == 1  # not seen before the commit
        assert t.read("quotes").count() == 2
    assert s.current().version == 2
    assert [r for r in content(s.read("ledger")) if r[1] == "new"] == [(3, "new", "x"), (99, "new", None)] and s.read("ledger").count() == 11
    with s.begin() as t:
        t.upsert("quotes", frame(spark, [(1, None, "again")]))
        t.remove("ledger", frame(spark, [(3, "", ""), (1000, "", "")]).select("id"))
    assert content(s.read("quotes")) == [(1, "q", "b"), (1, None, "again")]
    assert s.read("ledger").count() == 10 and s.read("ledger", version=2).count() == 11


def test_random_changes_against_a_dictionary(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "MOST_FOLDERS", 2)
    rng, s, want = random.Random(3), Store(spark, str(tmp_path)), {}
    with s.begin() as t:
        t.create("t", frame(spark, []), ["id"], 4)
    for _ in range(6):
        rows = [(k, "r", str(rng.random())) for k in rng.sample(range(30), 5)]
        gone = rng.sample(range(30), 2)
        with s.begin() as t:
            t.upsert("t", frame(spark, rows), verify=True)
            t.remove("t", spark.createDataFrame([(g,) for g in gone], "id long"))
        want = {**want, **{r[0]: r for r in rows}}
        want = {k: r for k, r in want.items() if k not in gone}
        assert content(s.read("t")) == sorted(want.values(), key=str)
    assert s.vacuum() and content(s.read("t")) == sorted(want.values(), key=str) and not s.vacuum()


def test_what_is_written_grows_with_the_change(spark, tmp_path):
    s = filled(spark, tmp_path / "s", 40_000, 64)
    whole = size(tmp_path / "s" / "data")
    before = s.current().tables["ledger"].folders
    with s.begin() as t:
        t.upsert("ledger", frame(spark, [(5, "one", "x")]))
    after = s.current().tables["ledger"].folders
    assert sum(before[b] != after[b] for b in before) == 1
    assert size(tmp_path / "s" / "data") - whole < whole / 10
    with s.begin() as t:  # a new key: nothing that is there is written anew
        t.upsert("ledger", frame(spark, [(10**9, "new", "x")]))
    grown = s.current().tables["ledger"].folders
    assert all(after[b] == grown[b][: len(after[b])] for b in after) and sum(map(len, grown.values())) == sum(map(len, after.values())) + 1


def test_the_slower_of_two_commits_is_a_conflict(spark, tmp_path):
    s = filled(spark, tmp_path, 10)
    first, second = s.begin(), s.begin()
    first.upsert("ledger", frame(spark, [(1, "first", "")]))
    second.upsert("ledger", frame(spark, [(2, "second", "")]))
    first.commit()
    with pytest.raises(Conflict):
        second.commit()
    assert {r.kind for r in s.read("ledger").collect()} == {"k", "first"} and s.versions() == [1, 2]
    assert not s.vacuum(keep=2)  # the loser took back what it had staged


@pytest.mark.parametrize("step", ["deal", "stage", "second table", "manifest", "rename"])
def test_a_crash_at_any_step_changes_nothing(spark, tmp_path, monkeypatch, step):
    s = filled(spark, tmp_path, 10)
    before = content(s.read("ledger")), content(s.read("quotes"))

    def crash(*_, **__):
        raise KeyboardInterrupt

    t = s.begin()
    monkeypatch.setattr(t, "abort", lambda: None)  # the process is gone: nothing is taken back
    if step in ("deal", "stage"):
        monkeypatch.setattr(t, "_holding" if step == "deal" else "_verify", crash)
    if step == "manifest":
        monkeypatch.setattr(s, "write_manifest", crash)
    if step == "rename":
        monkeypatch.setattr(s, "rename", crash)
    with pytest.raises(KeyboardInterrupt), t:
        t.upsert("ledger", frame(spark, [(1, "new", ""), (50, "new", "")]), verify=True)
        if step == "second table":
            crash()
        t.upsert("quotes", frame(spark, [(1, "q", "b")]))
    monkeypatch.undo()
    again = Store(spark, str(tmp_path))
    assert (content(again.read("ledger")), content(again.read("quotes"))) == before and again.current().version == 1
    assert again.vacuum() and (content(again.read("ledger")), content(again.read("quotes"))) == before
    with again.begin() as retry:
        retry.upsert("ledger", frame(spark, [(1, "new", ""), (50, "new", "")]))
    assert again.read("ledger").count() == 11


def test_refused_changes_are_taken_back(spark, tmp_path):
    s = filled(spark, tmp_path, 10)
    with pytest.raises(ValueError, match="twice"), s.begin() as t:
        t.upsert("ledger", frame(spark, [(1, "a", ""), (1, "b", "")]))
    assert s.current().version == 1 and not s.vacuum()
