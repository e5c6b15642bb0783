"""Structure repair of conversations: the cheapest edits that give an optional system turn and user/assistant pairs.

The edits of a conversation are paths through a lattice of (row, last role): keep, give another role, delete, insert.
A* searches it, keyed by (cost so far plus heuristic, audit): the heuristic is a suffix sum over the rows ahead, two for
each row that must be deleted and two for each truncated one, which is deleted or charged five. It never exceeds the
true rest and drops by no more than an edge costs, so the first arrival at a place is the cheapest one with the least
audit. Rows are taken ``BLOCK`` at a time: at a block's end the best path to each of the four last roles goes on, what
their audits have in common is written off, and the open ends are the next block's starts; the last block ends at the
first complete path. A conversation costs time in proportion to its rows, whatever their number.

Texts are read as a stream in order: a conversation's texts are never held together, only one letter a row.

Nulls: a null conv_id, turn, role or text is one space in texts and in the damage rule; a null turn comes first. An
empty role or one with another initial can't be kept. Rows with equal turns come by role and then by the MD5 of the
text. A conversation whose rows are all dropped has zeros, an empty audit and the hash of nothing. Empty tables give no
rows. Repeated rows are duplicates. Columns other than conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import written

#: Rows searched at once.
BLOCK = 256
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5

#: Last role of the rows so far: none, system, user, assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a kept initial leads to from each last role, and where a user or assistant that is put in or renamed leads to.
KEPT = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
PUT = [USER, USER, ASSISTANT, USER]
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Complete if the last role is one of these.
COMPLETE = (START, ASSISTANT)
#: Adjacent initials that are no fault.
LEGAL = {"su", "ua", "au"}

#: A row's fault as one letter: blank, duplicate, truncated, none.
BLANK, DUPLICATE, TRUNCATED, SOUND = "bdt."

_WHITE = " \t\n\x0b\x0c\r"


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, gone, copies) after the damage rule; ``gone`` marks dropped rows."""
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), (kind == 0).alias("gone"), F.when(kind == 3, 2).otherwise(1).alias("copies")
    )


def _last_character(text: Column) -> Column:
    return F.right(F.rtrim(text, F.lit(_WHITE)), F.lit(1))


def _digest() -> Column:
    return F.unhex(F.md5(F.concat("role", F.lit("\x00"), "text")))


def with_faults(rows: DataFrame) -> DataFrame:
    """Rows with a digest of role and text, and ``fault``: of later rows, those with role and text of an earlier turn are duplicates.

    Rows of one turn that are equal are told apart where they are read in order.
    """
    last = _last_character(F.col("text"))
    known = rows.withColumn("digest", _digest()).withColumn("fault", F.when(last == "", BLANK).when(last.isin(".", "!", "?"), SOUND).otherwise(TRUNCATED))
    place = F.struct(F.col("turn").isNotNull().alias("has_turn"), F.col("turn").alias("turn"))
    first = known.where(~F.col("gone")).groupBy("conv_id", "digest").agg(F.min(place).alias("first"))
    first = first.select(F.col("conv_id").alias("conv"), F.col("digest").alias("seen"), "first")
    joined = known.join(first, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("digest") == F.col("seen")), "left")
    later = (place > F.col("first")) & (F.col("fault") != BLANK)
    return joined.withColumn("fault", F.when(later, DUPLICATE).otherwise(F.col("fault"))).select(*known.columns)


def cheapest(initials: str, faults: str) -> tuple[int, str]:
    """Cost and audit of the cheapest edits of rows given by their roles' initials and faults."""
    starts, trunk, done = [(0, "", START)], [], 0
    while True:
        end = min(done + BLOCK, len(initials))
        ends = _search(initials[done:end], faults[done:end], starts, end == len(initials))
        if end == len(initials):
            cost, tail, _ = ends[0]
            return cost, "".join(trunk) + tail
        shared = commonprefix([tail for _, tail, _ in ends])
        trunk.append(shared)
        starts, done = [(cost, tail[len(shared) :], state) for cost, tail, state in ends], end


def _search(initials: str, faults: str, starts: list[tuple[int, str, int]], last: bool) -> list[tuple[int, str, int]]:
    """A* over some rows: the best (cost, audit, last role) at their end for each last role, or of the complete ones."""
    n = len(initials)
    ahead = [0] * (n + 1)
    for k in range(n - 1, -1, -1):
        ahead[k] = ahead[k + 1] + (DELETE if faults[k] != SOUND else 0)
    queue = [(cost + ahead[0], audit, 0, state, cost) for cost, audit, state in starts]
    heapq.heapify(queue)
    settled, found = set(), []
    while queue:
        _, audit, k, state, cost = heapq.heappop(queue)
        if (k, state) in settled:
            continue
        settled.add((k, state))
        if k == n and not last:
            found.append((cost, audit, state))
        elif k == n and state in COMPLETE:
            return [(cost, audit, state)]
        edges = [("I", k, PUT[state], INSERT)]
        if k < n:
            edges.append(("D", k + 1, state, DELETE))
            if faults[k] in (SOUND, TRUNCATED):
                cut = CUT if faults[k] == TRUNCATED else 0
                edges.append(("R", k + 1, PUT[state], REROLE + cut))
                if initials[k] in KEPT[state]:
                    edges.append(("K", k + 1, KEPT[state][initials[k]], cut))
        for letter, to, then, price in edges:
            if (to, then) not in settled:
                heapq.heappush(queue, (cost + price + ahead[to], audit + letter, to, then, cost + price))
    return found


class Conversation:
    """Counts and letters of one conversation's rows in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.initials, self.faults = conv_id, [], []
        self.least = self.most = self.before = None
        self.turns = 0

    def add(self, turn: int | None, role: str, digest: bytes, fault: str) -> None:
        same = self.before == (turn, digest)
        if turn is not None:
            if self.turns == 0 or self.most != turn:
                self.turns += 1
            self.least, self.most = turn if self.least is None else self.least, turn
        self.before = (turn, digest)
        self.initials.append(role[:1] or "-")
        self.faults.append(DUPLICATE if same and fault != BLANK else fault)

    def row(self) -> tuple:
        initials, faults = "".join(self.initials), "".join(self.faults)
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        illegal = sum(initials[k : k + 2] not in LEGAL for k in range(len(initials) - 1))
        return self.conv_id, gaps, faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal, *cheapest(initials, faults)


_COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation from its rows in order."""
    now: Conversation | None = None
    names = ["conv_id", *(x.split()[0] for x in _COUNTS.split(", "))]
    kinds = [pa.int64()] * 7 + [pa.string()]
    for batch in batches:
        out = []
        for conv, turn, role, digest, fault, gone, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or conv != now.conv_id:
                if now is not None:
                    out.append(now.row())
                now = Conversation(conv)
            for _ in range(0 if gone else copies):
                now.add(turn, role, digest, fault)
        if out:
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
    if now is not None:
        yield pa.record_batch([pa.array([x], t) for x, t in zip(now.row(), kinds, strict=True)], names)


class Repaired:
    """The repaired rows of one conversation and their hash, from its rows in order and its audit."""

    def __init__(self, conv_id: int | None, audit: str):
        self.conv_id, self.audit, self.at, self.state = conv_id, audit, 0, START
        self.hash, self.begun = hashlib.sha256(), False

    def put(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) * self.begun}{role}:{text}".encode())
        self.begun = True

    def insert(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at, self.state = self.at + 1, PUT[self.state]
            self.put(NAMES[self.state], "")

    def row(self, role: str, text: str) -> None:
        self.insert()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = KEPT[self.state][role[0]]
            self.put(role, text)
        elif letter == "R":
            self.state = PUT[self.state]
            self.put(NAMES[self.state], text)

    def result(self) -> tuple[int | None, str]:
        self.insert()
        return self.conv_id, self.hash.hexdigest()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each conversation's repaired rows: its audit comes first, then its rows in order."""
    now: Repaired | None = None
    batch_of = lambda out: pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.string()), strict=True)], ["conv_id", "repaired_sha256"])
    for batch in batches:
        out = []
        for conv, kind, role, text, copies, audit in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "kind", "role", "text", "copies", "audit")), strict=True):
            if kind == 0:
                if now:
                    out.append(now.result())
                now = Repaired(conv, audit)
            for _ in range(copies):
                now.row(role, text)
        if out:
            yield batch_of(out)
    if now:
        yield batch_of([now.result()])


def repaired(rows: DataFrame) -> DataFrame:
    """Each conversation after the damage rule: gaps, counts of faults, the cheapest edits' cost and audit, the result's hash.

    Two passes in order of turns: the first reads a letter a row and finds the edits, the second applies them to the texts.
    """
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    after = with_faults(damaged(rows))
    order = [F.col("turn").asc_nulls_first(), "role", "digest"]
    short = after.select("conv_id", "turn", "role", "digest", "fault", "gone", "copies")
    found = short.repartition("conv_id").sortWithinPartitions("conv_id", *order).mapInArrow(_audited, f"conv_id long, {_COUNTS}")
    found = written(found, "repair-audits")
    none = lambda kind: F.lit(None).cast(kind)
    heads = found.select("conv_id", F.lit(0).alias("kind"), none("long").alias("turn"), none("string").alias("role"), none("binary").alias("digest"), none("string").alias("text"), F.lit(0).alias("copies"), "audit")
    lines = damaged(rows).where(~F.col("gone")).select("conv_id", F.lit(1).alias("kind"), "turn", "role", _digest().alias("digest"), "text", "copies", none("string").alias("audit"))
    stream = heads.unionByName(lines).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *order)
    hashes = stream.mapInArrow(_hashed, "conv_id long, repaired_sha256 string").withColumnRenamed("conv_id", "conv")
    return found.join(hashes, F.col("conv_id").eqNullSafe(F.col("conv"))).drop("conv")
