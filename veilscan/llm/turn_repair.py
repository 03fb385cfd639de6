"""Repair of conversation structure by depth-first branch-and-bound.

A conversation is well formed if its role initials read ``(s?(ua)+)?``. Rows are
kept, given another role, deleted, or joined by inserted empty ones; the cheapest
sequence of edits is looked for, and among these the ASCII-least audit (the
edits' initials D, I, K, R). The search keeps an explicit stack and takes edits
in ASCII order, so that prefixes come in the order of their audits: a prefix
that reaches a node (rows read, state) is of use only if it is cheaper than
every one before, which the node's entry in the dominance table tells, and a
prefix is cut if its cost and the lower bound of the rows still to come exceed
the incumbent's, or equal those of an incumbent found already.

A long conversation is searched in segments: the optimum from each state before
a segment to each state behind it; the optima are joined from segment to
segment, and what all four have in common is settled.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm.common import WORD, parts, prepare

#: Rows searched at once.
SEGMENT = 128
#: Costs.
REROLE, DELETE, INSERT, UNFINISHED = 2, 3, 2, 1
#: States: nothing yet, after a system, a user, an assistant row.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Role initials that may follow one another.
LEGAL = {"su", "ua", "au"}

REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
ROWS = "conv_id long, turn long, role string, text string, copies int"


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) of damaged conversations: by the
    CRC-32 of ``conv_id:turn`` a row of twenty each is dropped, emptied, robbed of
    its sentence ends, repeated, or made a user's. Nulls of role, text and in the
    checksum's string are one space."""
    space = "coalesce(cast({} as string), ' ')".format
    kinds = conversations.selectExpr(
        "cast(conv_id as long) conv_id", "cast(turn as long) turn", f"{space('role')} role", f"{space('text')} text",
        f"crc32(concat({space('cast(conv_id as long)')}, ':', {space('cast(turn as long)')})) % 20 kind",
    )
    return kinds.where("kind <> 0").selectExpr(
        "conv_id", "turn", "if(kind = 4, 'user', role) role",
        "case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '') else text end text",
        "if(kind = 3, 2, 1) copies",
    )


def reports(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation of ``rows`` (see ``prepared``) and of ``ids``:
    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    Rows stand in the order of their turns, nulls first, those of one turn by
    role and by MD5 of the text. Only these short keys are shuffled, not the
    texts. A duplicate is found by a marker: the first row of its role and text,
    counted with partial aggregation, comes before the row that it marks. A
    conversation streams through one task, which holds a segment of it and the
    audits of four states; the audit has a letter for each of its rows.
    """
    prepare(rows.sparkSession)
    keyed = rows.select(
        "conv_id", "turn", "role", F.unhex(F.md5("text")).alias("digest"),
        (~F.col("text").rlike(WORD)).alias("blank"), (~F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*\\z")).alias("unfinished"), "copies",
    )
    firsts = keyed.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("first"))
    markers = firsts.selectExpr(
        "conv_id", "1 kind", "first.turn", "role", "digest", "0 place", "false blank", "false unfinished", "0 copies"
    )
    heads = rows.select("conv_id")
    if ids is not None:
        heads = heads.union(ids.select(F.col("conv_id").cast("long")))
    heads = heads.distinct().selectExpr(
        "conv_id", "0 kind", "cast(null as long) turn", "'' role", "X'' digest", "0 place", "false blank", "false unfinished", "0 copies"
    )
    all_rows = keyed.selectExpr("conv_id", "1 kind", "turn", "role", "digest", "1 place", "blank", "unfinished", "copies")
    return (
        all_rows.unionByName(markers).unionByName(heads)
        .repartition(parts(rows), "conv_id")
        .sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "role", "digest", "place")
        .mapInArrow(_reported, f"conv_id long, {REPORT}")
    )


def prepared(conversations: DataFrame) -> DataFrame:
    """Conversations as rows for ``reports`` and ``repaired``; null roles and
    texts are one space."""
    return conversations.selectExpr(
        "cast(conv_id as long) conv_id", "cast(turn as long) turn", "coalesce(cast(role as string), ' ') role",
        "coalesce(cast(text as string), ' ') text", "1 copies",
    )


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of the repaired conversations: conv_id, place (from 0), edit,
    turn (null if inserted), role, text. ``found`` holds their reports."""
    return _ordered(rows, found).mapInArrow(_rows_out, "conv_id long, place long, edit string, turn long, role string, text string")


def repairs(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``reports`` with repaired_sha256, the SHA-256 of the repaired rows as
    ``role:text`` lines joined by line breaks. A conversation without rows has
    zeros, an empty audit and the hash of the empty string. Null ids form a
    conversation; empty tables give empty results; a repeated row is a duplicate;
    other columns are ignored; of a long text one row at a time is in memory."""
    return _ordered(rows, reports(rows, ids)).mapInArrow(_hashed, f"conv_id long, {REPORT}, repaired_sha256 string")


def _ordered(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Reports, each followed by the rows of its conversation in order."""
    names = [part.split()[0] for part in REPORT.split(", ")]
    heads = found.selectExpr(
        "conv_id", "0 kind", "cast(null as long) turn", "'' role", "X'' digest", "'' text", "0 copies", *names
    )
    body = rows.selectExpr(
        "conv_id", "1 kind", "turn", "role", "unhex(md5(text)) digest", "text", "copies",
        *(f"cast(null as {part.split()[1]}) {part.split()[0]}" for part in REPORT.split(", ")),
    )
    return (
        heads.unionByName(body)
        .repartition(parts(rows), "conv_id")
        .sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "role", "digest")
        .drop("digest")
    )


# ---------------------------------------------------------------------- search


def lower_bounds(rows: list[tuple[str, bool, bool]]) -> tuple[list[int], list[int]]:
    """For every suffix the least that its rows cost: from a state in which a
    system row may still be kept, and from any other.

    A row costs at least its own cheapest edit. Two rows of the same initial that
    follow one another once all forced deletions are gone need two more on one
    of them, which may serve two such pairs, or an insertion for the pair.
    """
    later, open_ = [0] * (len(rows) + 1), [0] * (len(rows) + 1)
    system, following = 0, ""
    for i in range(len(rows) - 1, -1, -1):
        initial, forced, unfinished = rows[i]
        if forced:
            later[i] = later[i + 1] + DELETE
        elif initial in "ua":
            later[i] = later[i + 1] + unfinished * UNFINISHED + (initial == following)
            following = initial
        else:
            later[i] = later[i + 1] + min(DELETE, REROLE + unfinished * UNFINISHED)
            following = ""
            if initial == "s":
                system = REROLE
        open_[i] = later[i] - system
    return open_, later


def _after(state: int) -> int:
    """The state behind a row that is inserted or given a role."""
    return ASSISTANT if state == USER else USER


def _kept(state: int, initial: str) -> int | None:
    if initial == "s":
        return SYSTEM if state == NOTHING else None
    if initial == ("a" if state == USER else "u"):
        return _after(state)
    return None


def _dive(rows: list[tuple[str, bool, bool]], state: int, goals: set[int]) -> int | None:
    """Cost of a first solution: each row's cheapest edit, then insertions."""
    cost = 0
    for initial, forced, unfinished in rows:
        if forced:
            cost += DELETE
            continue
        kept = _kept(state, initial)
        cost += unfinished * UNFINISHED + (0 if kept is not None else REROLE)
        state = _after(state) if kept is None else kept
    for _ in range(3):
        if state in goals:
            return cost
        cost, state = cost + INSERT, _after(state)
    return None


def search(rows: list[tuple[str, bool, bool]], start: int, goals: set[int]) -> tuple[int, str] | None:
    """The least (cost, audit) that leads from a state through all rows
    (initial, deletion forced, unfinished) to one of the goals."""
    count = len(rows)
    open_, later = lower_bounds(rows)
    bounds = [open_, later, later, later]
    best_cost, best = _dive(rows, start, goals), None
    if best_cost is None:
        best_cost = DELETE * count + 2 * INSERT + 1
    dominated = [[best_cost + 1] * 4 for _ in range(count + 1)]
    stack = [(0, start, 0, "")]
    while stack:
        at, state, cost, audit = stack.pop()
        bound = cost + bounds[state][at]
        if cost >= dominated[at][state] or bound > best_cost or (best is not None and bound == best_cost):
            continue
        dominated[at][state] = cost
        if at == count and state in goals:
            best_cost, best = cost, audit
        if state >= USER > max(goals):
            continue  # no way back
        after = _after(state)
        # pushed from the last letter to the first
        if at < count:
            initial, forced, unfinished = rows[at]
            more = cost + unfinished * UNFINISHED
            if not forced:
                stack.append((at + 1, after, more + REROLE, audit + "R"))
                kept = _kept(state, initial)
                if kept is not None:
                    stack.append((at + 1, kept, more, audit + "K"))
        stack.append((at, after, cost + INSERT, audit + "I"))
        if at < count:
            stack.append((at + 1, state, cost + DELETE, audit + "D"))
    return None if best is None else (best_cost, best)


class Repair:
    """The cheapest edits of a conversation whose rows come one by one."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, bool, bool]] = []
        self.settled: list[str] = []
        self.ends: dict[int, tuple[int, str]] = {NOTHING: (0, "")}

    def add(self, initial: str, forced: bool, unfinished: bool) -> None:
        if len(self.rows) == SEGMENT:
            self._join({NOTHING, SYSTEM, USER, ASSISTANT}, each=True)
        self.rows.append((initial, forced, unfinished))

    def result(self) -> tuple[int, str]:
        self._join({NOTHING, ASSISTANT}, each=False)
        cost, audit = min(self.ends.values())
        return cost, "".join(self.settled) + audit

    def _join(self, goals: set[int], each: bool) -> None:
        found: dict[int, tuple[int, str]] = {}
        for state, (cost, audit) in self.ends.items():
            for wanted in [{g} for g in goals] if each else [goals]:
                part = search(self.rows, state, wanted)
                if part is not None:
                    goal, whole = min(wanted), (cost + part[0], audit + part[1])
                    found[goal] = min(found.get(goal, whole), whole)
        common = os.path.commonprefix([audit for _, audit in found.values()])
        self.settled.append(common)
        self.ends = {state: (cost, audit[len(common) :]) for state, (cost, audit) in found.items()}
        self.rows = []


# -------------------------------------------------------------------- in tasks


class _Report:
    def __init__(self, conv_id) -> None:
        self.conv_id, self.repair = conv_id, Repair()
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.low = self.high = self.turn = None
        self.turns, self.before, self.marker = 0, None, None

    def add(self, turn, role: str, digest: bytes, blank: bool, unfinished: bool, copies: int) -> None:
        if turn is not None:
            if self.low is None:
                self.low = turn
            self.turns += turn != self.turn
            self.high = self.turn = turn
        initial = role[:1]
        for _ in range(copies):
            first = self.marker == (turn, role, digest)
            self.marker = None
            if self.before is not None:
                self.illegal += self.before + initial not in LEGAL
            self.before = initial
            self.blank += blank
            self.duplicate += not blank and not first
            cut = first and not blank and unfinished
            self.truncated += cut
            self.repair.add(initial if initial and initial in "sua" else "-", blank or not first, cut)

    def values(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        cost, audit = self.repair.result()
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [part.split() for part in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields]
    )


def _tuples(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(column.to_pylist() for column in batch.columns), strict=True)


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    report, schema = None, f"conv_id long, {REPORT}"
    for batch in batches:
        out = []
        for conv_id, kind, turn, role, digest, place, blank, unfinished, copies in _tuples(batch):
            if kind == 0:
                if report is not None:
                    out.append(report.values())
                report = _Report(conv_id)
            elif place == 0:
                report.marker = (turn, role, digest)
            else:
                report.add(turn, role, digest, blank, unfinished, copies)
        if out:
            yield _batch(out, schema)
    if report is not None:
        yield _batch([report.values()], schema)


class _Edits:
    """Repaired rows (edit, turn, role, text) of a conversation, in order."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, NOTHING

    def inserted(self) -> Iterator[tuple]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            yield self._given("I", None, "")
            self.at += 1

    def of(self, turn, role: str, text: str) -> Iterator[tuple]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = _kept(self.state, role[:1])
            yield "K", turn, role, text
        elif edit == "R":
            yield self._given("R", turn, text)

    def _given(self, edit: str, turn, text: str) -> tuple:
        self.state = _after(self.state)
        return edit, turn, "user" if self.state == USER else "assistant", text


def _events(batch: pa.RecordBatch) -> Iterator[tuple]:
    """("head", report, audit) of a conversation, then ("row", row, copies)."""
    for conv_id, kind, turn, role, text, copies, *report in _tuples(batch):
        if kind == 0:
            yield "head", (conv_id, *report), report[-1]
        else:
            yield "row", (turn, role, text), copies


def _replayed(batches: Iterator[pa.RecordBatch], begin, row, end) -> Iterator[list]:
    """Walks through reports and rows; what ``end`` and ``row`` return is output."""
    edits, held = None, None

    def close() -> list:
        if edits is None:
            return []
        out = [row(held, x) for x in edits.inserted()]
        return [x for x in (*out, end(held)) if x is not None]

    for batch in batches:
        out: list = []
        for what, value, more in _events(batch):
            if what == "head":
                out += close()
                edits, held = _Edits(more), begin(value)
            else:
                for _ in range(more):
                    out += [y for y in (row(held, x) for x in edits.of(*value)) if y is not None]
        yield out
    yield close()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def begin(report):
        return [report, hashlib.sha256(), b""]

    def row(held, done):
        held[1].update(held[2] + f"{done[2]}:{done[3]}".encode("utf-8", "surrogatepass"))
        held[2] = b"\n"

    def end(held):
        return (*held[0], held[1].hexdigest())

    schema = f"conv_id long, {REPORT}, repaired_sha256 string"
    return (_batch(out, schema) for out in _replayed(batches, begin, row, end) if out)


def _rows_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def begin(report):
        return [report[0], 0]

    def row(held, done):
        held[1] += 1
        return held[0], held[1] - 1, *done

    schema = "conv_id long, place long, edit string, turn long, role string, text string"
    return (_batch(out, schema) for out in _replayed(batches, begin, row, lambda held: None) if out)
