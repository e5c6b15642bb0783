"""Secrets in texts: keyed assignments, access identifiers, long hex strings, and credentials in several parts.

DataFrame operations only. Spark gives all matches of a pattern and the pieces between them, so a match starts where
the lengths of the pieces and matches before it end. The scan keeps lengths and matches of the few rows that have any;
everything after it works on that small table.

Parts of credentials. A bare 40-character mixed string (``key``), an endpoint (``host``) or a short account name
(``user``) means little alone. A weak candidate is reported only if an access identifier (for a key) or an assignment
(for a host or user) lies in the same scope, a paragraph, and within ``REACH`` code points of it. The interval join is
a merge in order of position: the nearest strong part before and after each candidate, from two running windows over
(row, scope), so no pairs are made.

A null text is empty and has no spans. Repeated rows are scanned one by one. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import work

#: Kind, pattern, group whose length counts, and its least length; the first three are the contract's.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
WEAK = (
    ("key", r"(?<![A-Za-z0-9/+])(?=[A-Za-z0-9/+]{0,39}[0-9/+])(?=[A-Za-z0-9/+]{0,39}[A-Z])(?=[A-Za-z0-9/+]{0,39}[a-z])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])"),
    ("host", r"(?:https?|jdbc:[a-z]+|postgres|mysql|redis|mongodb|amqp)://[A-Za-z0-9._:@/-]+"),
    ("user", r"""(?:user(?:name)?|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""),
)
#: Which strong kinds each weak kind needs near it.
NEEDS = {"key": ("access",), "host": ("assign",), "user": ("assign",)}
#: Code points between a weak candidate and the part that completes it, at most.
REACH = 400
#: Blank lines, which end a scope, among the matches.
BREAK = "break"
ORDER = [k for k, *_ in BASE] + [k for k, _ in WEAK]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, row and, for each kind, the matches and the lengths of the pieces between them (null without any)."""
    text, found = F.col("text"), []
    for kind, pattern, *rest in [*BASE, *WEAK]:
        p = F.lit(pattern)
        some = text.rlike(pattern)
        found.append(F.when(some, F.regexp_extract_all(text, p, F.lit(0))).alias(f"{kind}_match"))
        found.append(F.when(some, F.transform(F.split(text, pattern, -1), lambda x: F.length(x))).alias(f"{kind}_gap"))
        if rest and rest[0]:
            found.append(F.when(some, F.transform(F.regexp_extract_all(text, p, F.lit(rest[0])), lambda x: F.length(x))).alias(f"{kind}_size"))
    blank = r"\n[\t ]*\n"
    scopes = F.when(text.rlike(r"AKIA|(?i:pass|secret|token|api)"), F.transform(F.split(text, blank, -1), lambda x: F.length(x)))
    separators = F.when(text.rlike(r"AKIA|(?i:pass|secret|token|api)"), F.transform(F.regexp_extract_all(text, F.lit(blank), F.lit(0)), lambda x: F.length(x)))
    return docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), *found, scopes.alias("scope_gap"), separators.alias("scope_size"))


def exploded(scanned: DataFrame, kind: str, gaps: str, sizes: Column, counted: Column, least: int) -> DataFrame:
    """row, kind, k, gap, size, n, least: a row for each match, with the length of the piece before it."""
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(sizes)).alias("gap"), sizes.alias("size"), counted.alias("n"))
    rows = scanned.where(F.size(sizes) > 0).select("row", F.lit(kind).alias("kind"), F.posexplode(pairs).alias("k", "x"))
    return rows.select("row", "kind", "k", "x.gap", "x.size", "x.n", F.lit(least).alias("least"))


def spans(scanned: DataFrame) -> DataFrame:
    """row, kind, start, end, scope: the spans that count, strong ones and weak candidates.

    A match ends where the lengths of all pieces and matches up to it end: a running sum over the text's matches. The
    scope is the number of blank lines before it, counted likewise, for texts with parts to link.
    """
    each, weak, strong = None, F.lit(False), F.lit(False)
    for kind, _, *rest in [*BASE, *WEAK]:
        size = F.transform(f"{kind}_match", lambda x: F.length(x))
        own = exploded(scanned, kind, f"{kind}_gap", size, F.col(f"{kind}_size") if rest and rest[0] else size, rest[1] if rest else 0)
        each = own if each is None else each.unionByName(own)
        some = F.col(f"{kind}_match").isNotNull()
        weak, strong = (weak, strong | some) if rest else (weak | some, strong)
    breaks = exploded(scanned.where(weak & strong), BREAK, "scope_gap", F.col("scope_size"), F.col("scope_size"), 0)
    ends = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("row", "kind").orderBy("k")).cast("int")
    placed = each.unionByName(breaks).withColumn("end", ends).withColumn("start", F.col("end") - F.col("size")).where("n >= least")
    is_break = (F.col("kind") == BREAK).cast("int")
    scope = F.sum(is_break).over(Window.partitionBy("row").orderBy("start", is_break).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return placed.withColumn("scope", scope).where(F.col("kind") != BREAK).select("row", "kind", "start", "end", "scope")


def linked(found: DataFrame) -> DataFrame:
    """The weak candidates of ``found`` that a needed strong part completes."""
    by, back = (Window.partitionBy("row", "scope").orderBy(*(getattr(F.col(c), way)() for c in ("start", "end", "kind"))) for way in ("asc", "desc"))
    # frames that grow from the start only: what follows is what comes before in descending order
    before, after = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (by, back))
    strong = sorted({s for x in NEEDS.values() for s in x})
    near = found
    for s in strong:
        near = near.withColumn(f"end_{s}", F.max(F.when(F.col("kind") == s, F.col("end"))).over(before))
        near = near.withColumn(f"start_{s}", F.min(F.when(F.col("kind") == s, F.col("start"))).over(after))
    complete = F.lit(False)
    for kind, needs in NEEDS.items():
        for s in needs:
            close = (F.col("start") - F.col(f"end_{s}") <= REACH) | (F.col(f"start_{s}") - F.col("end") <= REACH)
            complete = complete | ((F.col("kind") == kind) & F.coalesce(close, F.lit(False)))
    return near.where(complete).select("row", "kind", "start", "end")


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, row, and ``found``: an array of (start, rank, kind, end) in order of start, then kind as listed."""
    scanned = work.written(scan(docs), "secret-scan")
    every = work.written(spans(scanned), "secret-spans")
    strong = every.where(F.col("kind").isin([k for k, *_ in BASE])).select("row", "kind", "start", "end")
    rank = F.array_position(F.array(*map(F.lit, ORDER)), F.col("kind"))
    both = strong.unionByName(linked(every))
    of_row = both.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end"))).alias("found"))
    return scanned.select("doc_id", "row").join(of_row, "row", "left")
