"""Repair of conversation structure at least cost, by integers as path weights.

The rows of a conversation are walked by an automaton that knows what was put out last: nothing, a
system turn, a user turn or an assistant turn. Keep, Rerole, Delete and Insert are the edges of an
acyclic graph over (row, state); a wanted conversation is a path to an accepted state. A path's
weight is one integer: its high digits are the cost, its low digits, of a fixed number, spell the
edits' letters from the left, with zeros after the last. So the least integer has the least cost
and, among those, the least spelling, and an ordinary shortest-path recursion from the end decides
everything. An edge put before a path moves its letters right by one digit.

Rows are reduced to one byte each before the walk. Histories of more than ``BLOCK_ROWS`` rows are
walked in blocks, once for each state a block may end in; two spellings of one block at one cost
never begin one another, so blocks join exactly. Texts are not collected: the edits are found from
narrow rows, and applied while the full rows of a conversation stream by in order. That stream is
one task's for each conversation, as the hash of the result runs through its texts in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanweave.llm.common import arrow_schema, for_tasks, record_batch

BLOCK_ROWS = 256
# Costs of the edits, and the letters their digits stand for, in ASCII order; 0 is no letter.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
LETTERS = "\0DIKR"
DIGIT = 3  # bits
D, I, K, R = 1, 2, 3, 4  # noqa: E741
# States: nothing yet, after a system, a user, an assistant turn; accepted are the first and last.
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTED = (START, ASSISTANT)
# Where a turn of the initial s, u, a leads from each state.
STEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NAMES = {USER: "user", ASSISTANT: "assistant"}
# One byte per row: its initial (0 other, 1 s, 2 u, 3 a), 4 if truncated, 8 if it must go.
TRUNCATED_BIT, GONE_BIT = 4, 8
INITIALS = ("", "s", "u", "a")
WHITE = " \t\n\x0b\f\r"
LEGAL = ("su", "ua", "au")


def _edges(code: int) -> list[list[tuple[int, int, int]]]:
    """Per state the edits of a row: (next state, cost, letter's digit)."""
    out = []
    for state in range(4):
        edges = [(state, DELETE, D)]
        if not code & GONE_BIT:
            extra = TRUNCATED if code & TRUNCATED_BIT else 0
            kept = STEP.get(INITIALS[code & 3], {}).get(state)
            if kept is not None:
                edges.append((kept, KEEP + extra, K))
            edges += [(STEP[i][state], REROLE + extra, R) for i in "ua" if state in STEP[i]]
        out.append(edges)
    return out


EDGES = [_edges(code) for code in range(16)]


def least(codes: Sequence[int], ends: Sequence[int]) -> list[tuple[int, str] | None]:
    """Per first state the (cost, letters) of the least path through the rows to one of ``ends``."""
    # Deleting every row costs 3 each, so a least path has at most 1.5 insertions a row, and two more
    # bridge any two states.
    width = DIGIT * (len(codes) + 3 * len(codes) // 2 + 6)
    mask = (1 << width) - 1
    never = 1 << width + 40

    def put(cost: int, digit: int, rest: int) -> int:
        return (cost << width) + (digit << width - DIGIT) + (rest & ~mask) + ((rest & mask) >> DIGIT)

    def inserted(value: list[int]) -> list[int]:
        """Insertions before a row; costs are positive, so a least path enters no state twice."""
        user = min(value[USER], put(INSERT, I, value[ASSISTANT]))
        before_user = put(INSERT, I, user)
        return [
            min(value[START], before_user), min(value[SYSTEM], before_user), user,
            min(value[ASSISTANT], put(INSERT, I, value[USER])),
        ]

    value = inserted([0 if state in ends else never for state in range(4)])
    for code in reversed(codes):
        value = inserted([
            min(put(cost, digit, value[to]) for to, cost, digit in edges) for edges in EDGES[code]
        ])
    return [None if v >= never else (v >> width, _spelled(v & mask, width)) for v in value]


def _spelled(letters: int, width: int) -> str:
    out = []
    for at in range(width - DIGIT, -1, -DIGIT):
        digit = letters >> at & (1 << DIGIT) - 1
        if not digit:
            break
        out.append(LETTERS[digit])
    return "".join(out)


class Walk:
    """Least repair of a stream of row codes; holds the letters so far per state and one block."""

    def __init__(self) -> None:
        self.best: dict[int, tuple[int, str]] = {START: (0, "")}
        self.codes = bytearray()

    def add(self, code: int, times: int = 1) -> None:
        while times:
            room = min(BLOCK_ROWS - len(self.codes), times)
            self.codes.extend(bytes([code]) * room)
            times -= room
            if len(self.codes) == BLOCK_ROWS and times:
                self._close()

    def _close(self) -> None:
        following: dict[int, tuple[int, str]] = {}
        for end in range(4):
            paths = least(self.codes, (end,))
            joined = [
                (cost + path[0], letters + path[1])
                for start, (cost, letters) in self.best.items() if (path := paths[start])
            ]
            if joined:
                following[end] = min(joined)
        self.best, self.codes = following, bytearray()

    def result(self) -> tuple[int, str]:
        """(cost, letters) after the last row."""
        if set(self.best) == {START}:
            return least(self.codes, ACCEPTED)[START]
        paths = least(self.codes, ACCEPTED)
        return min(
            (cost + path[0], letters + path[1])
            for start, (cost, letters) in self.best.items() if (path := paths[start])
        )


def applied(letters: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The (role, text) rows of the repaired conversation."""
    state, at = START, 0

    def inserts() -> Iterator[tuple[str, str]]:
        nonlocal state, at
        while letters[at : at + 1] == "I":
            state, at = ASSISTANT if state == USER else USER, at + 1
            yield NAMES[state], ""

    for role, text in rows:
        yield from inserts()
        letter, at = letters[at], at + 1
        if letter == "K":
            state = STEP[role[:1]][state]
            yield role, text
        elif letter == "R":
            state = ASSISTANT if state == USER else USER
            yield NAMES[state], text
    yield from inserts()


# --- damage ------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies of every row that stays; see ``repair``. A repeated row
    is one row with two copies; equal rows are put together by their number."""
    # Nulls are one space in the key, the role and the text; the columns of ids keep theirs.
    def known(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))) % 20
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        known("role").alias("role"), known("text").alias("text"), kind.alias("kind"),
    ).where("kind != 0")
    text = (
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text"))
    )
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )


# --- repair ------------------------------------------------------------------------------

FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_FOUND = "conv_id long, " + ", ".join(f"{c} long" for c in FIGURES) + ", audit string"
_REPAIRED = f"{_FOUND}, repaired_sha256 string"


def _tie() -> Column:
    """What orders rows of one turn and role, without their texts."""
    return F.md5("text")


def narrow(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, tie, code, seen (an equal row came before), blank, copies: one row per
    distinct row, without texts, however often it is repeated."""
    end = F.rtrim(F.col("text"), F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    blank = end == ""
    cut = ~blank & ~F.right(end, F.lit(1)).isin(".", "!", "?")
    facts = rows.select(
        "conv_id", "turn", "role", _tie().alias("tie"), blank.alias("blank"),
        (code + F.when(cut, TRUNCATED_BIT).otherwise(0)).cast("int").alias("code"), initial.alias("initial"),
        "copies",
    )
    keys = ("conv_id", "turn", "role", "tie", "blank", "code", "initial")
    distinct = facts.groupBy(*keys).agg(F.sum("copies").alias("copies"))
    earlier = Window.partitionBy("conv_id", "role", "tie").orderBy(F.col("turn").asc_nulls_first())
    return distinct.withColumn("seen", F.row_number().over(earlier) > 1)


def faults(rows: DataFrame) -> DataFrame:
    """Figures and edits per conversation of damaged ``rows``: conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit."""
    schema = arrow_schema(_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing, out = object(), []
        conv = nothing

        def close() -> None:
            gaps = last - first + 1 - turns if turns else 0
            cost, letters = walk.result()
            out.append([conv, gaps, *counts, cost, letters])

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in
                       ("conv_id", "turn", "initial", "blank", "seen", "code", "copies"))
            for key, turn, initial, blank, seen, code, copies in zip(*columns):
                if conv is nothing or key != conv:
                    if conv is not nothing:
                        close()
                    conv, walk, counts = key, Walk(), [0, 0, 0, 0]
                    first = last = before = None
                    turns = 0
                if turn is not None and turn != last:
                    first, last, turns = turn if first is None else first, turn, turns + 1
                counts[3] += before is not None and before + initial not in LEGAL
                counts[3] += (copies - 1) * (initial + initial not in LEGAL)
                before = initial
                if blank:
                    counts[0] += copies
                    walk.add(GONE_BIT, copies)
                else:
                    repeated = copies if seen else copies - 1
                    counts[1] += repeated
                    if not seen:
                        counts[2] += bool(code & TRUNCATED_BIT)
                        walk.add(code)
                    walk.add(GONE_BIT, repeated)
            if out:
                yield record_batch([list(c) for c in zip(*out)], schema)
                out.clear()
        if conv is not nothing:
            close()
            yield record_batch([list(c) for c in zip(*out)], schema)

    placed = narrow(rows).repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("turn").asc_nulls_first(), "role", "tie"
    )
    return for_tasks(placed).mapInArrow(run, _FOUND)


def _stream(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's findings, then its rows in order."""
    missing = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"),
                                                         ("text", "string"), ("copies", "int"))]
    heads = found.select(*found.columns, *missing)
    figures = [F.lit(None).cast("long").alias(c) for c in FIGURES]
    bodies = rows.select("conv_id", *figures, F.lit(None).cast("string").alias("audit"), "turn", "role",
                         "text", F.col("copies").cast("int").alias("copies"))
    return heads.unionByName(bodies).repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("copies").isNotNull(), F.col("turn").asc_nulls_first(), "role", _tie()
    )


def repaired_rows(rows: DataFrame) -> DataFrame:
    """The repaired conversations themselves: conv_id, position (from 0), role, text, from damaged
    or any other ``rows`` (conv_id, turn, role, text, copies)."""
    ddl = "conv_id long, position long, role string, text string"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, turns in _conversations(batches):
            for position, (role, text) in enumerate(applied(head[-1], turns)):
                yield record_batch([[head[0]], [position], [role], [text]], schema)

    return for_tasks(_stream(rows, faults(rows))).mapInArrow(run, ddl)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, Iterator[tuple[str, str]]]]:
    """(findings, rows) of each conversation; its rows must be taken before the next is."""
    def flat() -> Iterator[list]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    source, waiting = flat(), []

    def turns() -> Iterator[tuple[str, str]]:
        for row in source:
            if row[-1] is None:
                waiting.append(row)
                return
            for _ in range(row[-1]):
                yield row[-3], row[-2]

    head = next(source, None)
    while head is not None:
        yield list(head[: len(FIGURES) + 2]), turns()
        head = waiting.pop() if waiting else None


def repair(conversations: DataFrame) -> DataFrame:
    """One row per conv_id of ``conversations``: after the damage of ``damaged``, its gaps, blank,
    duplicate, truncated, illegal, cost, audit and repaired_sha256 (of the repaired ``role:text``
    lines).

    Rows come by turn, nulls first; rows of one turn by role and a hash of their text, equal ones
    being repeats. Null texts and roles are one space; null ids form one conversation. One of which
    the damage leaves no row has zeros, no letters and the hash of nothing. Roles are judged by
    their first character. Other columns are not read; no rows give none.
    """
    schema = arrow_schema(_REPAIRED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for head, turns in _conversations(batches):
            digest, first = hashlib.sha256(), True
            for role, text in applied(head[-1], turns):
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
            out.append([*head, digest.hexdigest()])
            if len(out) == 1000:
                yield record_batch([list(c) for c in zip(*out)], schema)
                out.clear()
        if out:
            yield record_batch([list(c) for c in zip(*out)], schema)

    rows = damaged(conversations)
    # Conversations without a row get their findings here.
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found = ids.alias("i").join(
        faults(rows).alias("f"), F.col("i.conv_id").eqNullSafe(F.col("f.conv_id")), "left"
    ).select(
        "i.conv_id", *[F.coalesce(f"f.{c}", F.lit(0)).alias(c) for c in FIGURES],
        F.coalesce("f.audit", F.lit("")).alias("audit"),
    )
    return for_tasks(_stream(rows, found)).mapInArrow(run, _REPAIRED)
