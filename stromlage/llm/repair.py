"""Repair of conversations whose turns are out of order, by a lightest-derivation agenda.

A conversation is legal if the initials of its roles read ``(s?(ua)+)?``. Every
way to make it so is a derivation: the item (i, state) says that the first i
rows are edited and the roles given out so far end in ``state``. A deduction
keeps, reroles or deletes the next row, or inserts a turn; it adds a cost and a
letter to the weight (cost, audit) of its antecedent. Such functions are
monotone and never below their argument, so items popped from the agenda in the
order of their weights are final, and the first goal item popped is lightest.

Rows of a conversation stream through one task in order, since the hash of the
repaired text is one chain; memory stays bounded: after each block of rows only
the final items at its end, four at most, are carried on, each with its running
hash and an audit that shares what it has in common with the others.
"""

import hashlib
import heapq
import itertools
from collections.abc import Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stromlage.llm.common import WORD

#: Costs and letters of the edits; equal costs go by the letters in ASCII order.
DELETE, INSERT, KEEP, REROLE = "D", "I", "K", "R"
COST = {DELETE: 3, INSERT: 2, KEEP: 0, REROLE: 2}
#: What an undeleted truncated row adds.
TRUNCATED_COST = 1

#: What was given out so far: nothing, or rows that end in s, u or a.
START, S, U, A = range(4)
GOALS = (START, A)
#: Where a kept row leads by its role's initial.
KEPT = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (A, "u"): U, (U, "a"): A}
#: The role that a reroled or inserted turn takes, and where it leads.
GIVEN = {START: ("user", U), S: ("user", U), A: ("user", U), U: ("assistant", A)}
#: Neighbouring initials without fault.
LEGAL = {"su", "ua", "au"}

#: Rows taken at once.
BLOCK = 64

BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
GOAL = (-1, -1)


class Row(NamedTuple):
    role: str
    text: str
    fault: str | None


class Stem(NamedTuple):
    """An audit as a chain of pieces; shared between the items that have it in common."""

    before: "Stem | None"
    piece: str

    def text(self) -> str:
        pieces, at = [], self
        while at is not None:
            pieces.append(at.piece)
            at = at.before
        return "".join(reversed(pieces))


class Final(NamedTuple):
    """A final item at the end of a block: state, cost, stem, audit beyond it, running hash."""

    state: int
    cost: int
    stem: Stem
    tail: str
    sha: Any


def edits(row: Row, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, next state) of what may be done with a row."""
    yield DELETE, COST[DELETE], state
    if row.fault in (BLANK, DUPLICATE):
        return
    more = TRUNCATED_COST if row.fault == TRUNCATED else 0
    after = KEPT.get((state, row.role[:1]))
    if after is not None:
        yield KEEP, COST[KEEP] + more, after
    yield REROLE, COST[REROLE] + more, GIVEN[state][1]


def lightest(rows: list[Row], starts: list[Final], last: bool) -> tuple[dict, list[tuple]]:
    """(item -> (weight, antecedent, letter), final items at the end in order): the agenda over one block.

    The starts' stems are in order and none is a prefix of another, so that
    (cost, stem's number, tail) orders whole audits. With ``last`` the first
    goal item ends the work; else the items at the end of the block do.
    """
    n, chart, ends = len(rows), {}, []
    # The running number: one audit may be reached with its insertion before or after a block's end.
    agenda = [((x.cost, number, x.tail), place, (0, x.state), None, "") for place, (number, x) in enumerate(_numbered(starts))]
    counter = itertools.count(len(agenda))
    heapq.heapify(agenda)

    def deduce(weight: tuple, item: tuple, letter: str, cost: int, to: tuple) -> None:
        if to not in chart:
            heapq.heappush(agenda, ((weight[0] + cost, weight[1], weight[2] + letter), next(counter), to, item, letter))

    while agenda:
        weight, _, item, before, letter = heapq.heappop(agenda)
        if item in chart:
            continue
        chart[item] = (weight, before, letter)
        if item == GOAL:
            return chart, [GOAL]
        i, state = item
        deduce(weight, item, INSERT, COST[INSERT], (i, GIVEN[state][1]))
        if i < n:
            for letter, cost, after in edits(rows[i], state):
                deduce(weight, item, letter, cost, (i + 1, after))
        elif last:
            if state in GOALS:
                deduce(weight, item, "", 0, GOAL)
        else:
            ends.append(item)
    return chart, ends


def _numbered(finals: list[Final]) -> list[tuple[int, Final]]:
    """Items with the number of their stem; equal stems are the same object."""
    stems: list[Stem] = []
    out = []
    for x in finals:
        if not any(x.stem is s for s in stems):
            stems.append(x.stem)
        out.append((next(n for n, s in enumerate(stems) if s is x.stem), x))
    return out


def advance(rows: list[Row], starts: list[Final], last: bool) -> list[Final]:
    """The final items after ``rows``: the goal alone if these are the last."""
    chart, ends = lightest(rows, starts, last)
    by_state = {x.state: x for x in starts}
    found = []
    for item in ends:
        weight, steps, at = chart[item][0], [], item
        while chart[at][1] is not None:
            steps.append((chart[at][2], chart[at][1]))
            at = chart[at][1]
        origin = by_state[at[1]]
        sha = origin.sha.copy()
        for letter, (i, state) in reversed(steps):
            if letter in ("", DELETE):
                continue
            role = rows[i].role if letter == KEEP else GIVEN[state][0]
            text = "" if letter == INSERT else rows[i].text
            sha.update(f"{'' if state == START else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
        found.append((weight[1], weight[2], item[1], weight[0], origin.stem, sha))
    # Audits that go on from one another share a stem; stems stay in order, none a prefix of another.
    out: list[Final] = []
    held = ("", None, None)
    for _, tail, state, cost, before, sha in sorted(found, key=lambda x: x[:2]):
        if held[1] is not before or not tail.startswith(held[0]):
            held = (tail, before, Stem(before, tail))
        out.append(Final(state, cost, held[2], tail[len(held[0]):], sha))
    return out


class Conversation:
    """The rows of one conversation, taken in order."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id = conv_id
        self.rows: list[Row] = []
        self.items = [Final(START, 0, Stem(None, ""), "", hashlib.sha256())]
        self.faults = {BLANK: 0, DUPLICATE: 0, TRUNCATED: 0}
        self.illegal = self.turns = 0
        self.first = self.last = self.initial = None

    def add(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        if len(self.rows) == BLOCK:
            self.items = advance(self.rows, self.items, False)
            self.rows = []
        self.rows.append(Row(role, text, fault))
        if fault:
            self.faults[fault] += 1
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in LEGAL
        self.initial = role[:1]
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.turns += 1

    def result(self) -> tuple:
        (goal,) = advance(self.rows, self.items, True)
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (
            self.conv_id, gaps, *self.faults.values(), self.illegal, goal.cost,
            goal.stem.text() + goal.tail, goal.sha.hexdigest(),
        )


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): rows with the faults that crc32(``conv_id:turn``) % 20 deals; dropped ones are marked.

    0 drops a row, 1 empties its text, 2 removes ``.``, ``!`` and ``?``, 3
    repeats the row, 4 makes it the user's. Nulls read as one space.
    """
    space = F.lit(" ")
    named = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")))
    kind = F.crc32(named.cast("binary")) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind < 2, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind == 0).alias("gone"),
        F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy"),
    ).drop("_copy")


def _filled(rows: DataFrame) -> DataFrame:
    """The columns in use; a null role or text is one space, a null mark is no mark."""
    return rows.select(
        "conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")),
        F.coalesce("gone", F.lit(False)).alias("gone"),
    )


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows with their first fault, each conversation in one task and in order; one shuffle."""
    seen = Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.asc_nulls_first("turn"))
    return (
        rows.repartition("conv_id")
        .withColumn("fault", _fault(F.row_number().over(seen) > 1))
        .sortWithinPartitions("conv_id", "gone", F.asc_nulls_first("turn"), "role", "text")
    )


def _fault(seen: Column) -> Column:
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return (
        F.when(~F.col("text").rlike(WORD), BLANK).when(seen, DUPLICATE).when(~last.isin(".", "!", "?"), TRUNCATED)
    )


REPAIRS = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)
_ARROW = pa.schema([
    ("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
    ("audit", pa.string()), ("repaired_sha256", pa.string()),
])


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation (``REPAIRS``) of ``rows`` (conv_id, turn, role, text, gone): its faults and cheapest repair.

    Rows go by turn (nulls first), then role and text. Rows that are ``gone``
    only say that their conversation exists: one without others has zeros, no
    audit and the hash of nothing. Equal rows are duplicates but for the first.
    Rows without conv_id are one conversation; a null role or text is one space.
    """

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: Conversation | None = None
        for batch in batches:
            done = []
            for conv_id, turn, role, text, gone, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if at is None or at.conv_id != conv_id:
                    if at is not None:
                        done.append(at.result())
                    at = Conversation(conv_id)
                if not gone:
                    at.add(turn, role, text, fault)
            yield _batch(done)
        if at is not None:
            yield _batch([at.result()])

    return _in_order(_filled(rows)).select("conv_id", "turn", "role", "text", "gone", "fault").mapInArrow(solve, REPAIRS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)


def repaired_turns(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, edit): the turns that the audits of ``repairs`` leave of ``rows``, placed from 0."""
    schema = "conv_id long, place long, role string, text string, edit string"

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, letter, state, place = object(), "", 0, START, 0
        for batch in batches:
            out = []
            for conv_id, own, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if conv != conv_id:
                    conv, audit, letter, state, place = conv_id, own, 0, START, 0
                row_done = role is None
                while letter < len(audit) and (not row_done or audit[letter] == INSERT):
                    edit = audit[letter]
                    letter += 1
                    row_done = row_done or edit != INSERT
                    if edit == DELETE:
                        continue
                    given, after = GIVEN[state]
                    state = KEPT[state, role[:1]] if edit == KEEP else after
                    out.append((conv_id, place, role if edit == KEEP else given, "" if edit == INSERT else text, edit))
                    place += 1
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()])],
                ["conv_id", "place", "role", "text", "edit"],
            )

    # A last row without a role lets the insertions after all rows come out.
    ends = repairs.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"),
                          F.lit(None).cast("string").alias("text"), F.lit(True).alias("_end"))
    kept = _filled(rows).where(~F.col("gone")).select("conv_id", "turn", "role", "text", F.lit(False).alias("_end")).unionByName(ends)
    audits = repairs.select(F.col("conv_id").alias("_conv"), "audit")
    return (
        kept.join(audits, F.col("conv_id").eqNullSafe(F.col("_conv")))
        .repartition("conv_id").sortWithinPartitions("conv_id", "_end", F.asc_nulls_first("turn"), "role", "text")
        .select("conv_id", "audit", "role", "text").mapInArrow(replay, schema)
    )
