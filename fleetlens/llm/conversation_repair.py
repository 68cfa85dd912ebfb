"""Conversation structure repair at least cost, with Four-Russians block tables.

A conversation is a word of row symbols; edits (keep, rerole, delete, insert)
turn its roles into a word of ``(s?(ua)+)?``, whose automaton has four states.
The cost to go from each state is a vector of four numbers, and one row turns
the vector after it into the vector before it. Up to its least entry only a
few dozen vectors exist, so their transitions over every block of BLOCK
symbols are computed once, as tables, and a conversation is read from its end
in blocks: one lookup each. Tracing goes the other way and opens one block at
a time: the vectors inside it are computed backward from the vector behind it,
and from the state in front of it the least letter that keeps the cost is
taken. A letter settles the next state, so equal costs give the ASCII-least
string of edits.

Both readings are streams over rows sorted within their partition, which Spark
spills, so a conversation of any length needs the memory of one block and its
string of edits. One shuffle by conversation serves both. Its rows meet in one
task, since the digest of the repaired text is one pass over it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White space of the contract: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
# Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

#: Symbols of a block.
BLOCK = 4
#: States of the automaton: nothing yet, after s, after u, after a. The last and the first accept.
STATES = 4
_KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
#: The state after a user or assistant row, whichever may stand there, and that role.
_TURN = (2, 2, 3, 2)
_TURN_ROLE = ("user", "user", "assistant", "user")
#: Symbols: an initial (other than s, u, a: the fourth), the same truncated, a row that must go.
_INITIALS = "sua"
GONE = 8
N_SYMBOLS = 9
_END = (0, 4, 2, 0)
#: Traced blocks that a worker remembers.
_REMEMBERED = 200_000


def _letter(state: int, symbol: int, letter: str) -> tuple[int, int] | None:
    """(cost, next state) of an edit of a row, None where it is not allowed."""
    if letter == "D":
        return DELETE, state
    if symbol == GONE:
        return None
    extra = TRUNCATED if symbol >= 4 else 0
    if letter == "R":
        return REROLE + extra, _TURN[state]
    initial = _INITIALS[symbol % 4 : symbol % 4 + 1]
    return (extra, _KEEP[state, initial]) if (state, initial) in _KEEP else None


def before(symbol: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """The cost to go from each state in front of a row, from the costs behind it."""
    moves = [[_letter(q, symbol, x) for x in "DKR"] for q in range(STATES)]
    costs = [min(m[0] + after[m[1]] for m in row if m) for row in moves]
    for _ in range(STATES):  # inserts in front of the row
        costs = [min(c, INSERT + costs[_TURN[q]]) for q, c in enumerate(costs)]
    return tuple(costs)


@cache
def tables() -> tuple[list[tuple[int, ...]], np.ndarray]:
    """All vectors with least entry 0, and the number of the vector in front of each block.

    The second is an array (vector, block); a block's number has its first
    symbol as the highest digit.
    """
    vectors, number = [_END], {_END: 0}
    step: list[list[int]] = []
    for vector in vectors:  # grows as it is read
        row = []
        for symbol in range(N_SYMBOLS):
            costs = before(symbol, vector)
            costs = tuple(c - min(costs) for c in costs)
            if costs not in number:
                number[costs] = len(vectors)
                vectors.append(costs)
            row.append(number[costs])
        step.append(row)
    single = np.array(step, dtype=np.int32)
    block = single
    for _ in range(BLOCK - 1):
        # One symbol more in front: (vector, tail) to (vector, symbol and tail).
        block = single[block].transpose(0, 2, 1).reshape(len(vectors), -1)
    return vectors, block


def block_number(symbols: list[int]) -> int:
    n = 0
    for s in symbols:
        n = n * N_SYMBOLS + s
    return n


def block_symbols(n: int, length: int) -> list[int]:
    out = []
    for _ in range(length):
        n, s = divmod(n, N_SYMBOLS)
        out.append(s)
    return out[::-1]


def trace(vector: int, symbols: list[int], state: int) -> tuple[list[str], int]:
    """The edits of each row of a block (inserts stand in front), and the state behind it."""
    costs = [tables()[0][vector]]
    for symbol in reversed(symbols):
        costs.append(before(symbol, costs[-1]))
    costs.reverse()
    out = []
    for here, after, symbol in zip(costs, costs[1:], symbols):
        edits = ""
        while not edits or edits[-1] == "I":
            for letter in "DIKR":
                move = (INSERT, _TURN[state]) if letter == "I" else _letter(state, symbol, letter)
                if move and move[0] + (here if letter == "I" else after)[move[1]] == here[state]:
                    edits, state = edits + letter, move[1]
                    break
        out.append(edits)
    return out, state


# ---- from the end: a vector and a block for every row

_ROW = "conv {conv}, turn {turn}, role string, text string, nth int, fault int"
_TOLD = _ROW + ", vector int, block int, place int, length int"


def _look_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows from each conversation's end on, each with its block and the vector behind that."""
    table = tables()[1]
    open_rows, symbols, vector, conv = None, [], 0, object()

    def told(rows: pa.RecordBatch, marks: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
        extra = [pa.array([m[i] for m in marks], pa.int32()) for i in range(4)]
        return pa.RecordBatch.from_arrays([*rows.columns, *extra], names=[*rows.schema.names, "vector", "block", "place", "length"])

    def closed(marks: list) -> None:
        # Symbols came last row first; the block is written first row first.
        n = len(symbols)
        code = block_number(symbols[::-1])
        marks.extend((vector, code, n - 1 - i, n) for i in range(n))

    for batch in batches:
        if open_rows is not None and len(open_rows):
            batch = pa.Table.from_batches([open_rows, batch]).combine_chunks().to_batches()[0]
        marks: list[tuple[int, int, int, int]] = []
        faults, roles, convs = (batch.column(c).to_pylist() for c in ("fault", "role", "conv"))
        for i in range(len(symbols), len(batch)):
            if convs[i] != conv:
                closed(marks)
                symbols, vector, conv = [], 0, convs[i]
            if faults[i] == DROPPED:
                marks.append((-1, -1, -1, 0))
                continue
            symbols.append(symbol_of(faults[i], roles[i]))
            if len(symbols) == BLOCK:
                closed(marks)
                vector = int(table[vector, marks[-1][1]])
                symbols = []
        open_rows = batch.slice(len(marks))
        if marks:
            yield told(batch.slice(0, len(marks)), marks)
    if open_rows is not None and len(open_rows):
        marks = []
        closed(marks)
        yield told(open_rows, marks)


# Faults of a row; a dropped row only names its conversation.
NONE, BLANK, DUPLICATE, CUT, DROPPED = range(5)


def symbol_of(fault: int, role: str) -> int:
    if fault in (BLANK, DUPLICATE):
        return GONE
    at = _INITIALS.find(role[:1]) if role else -1
    return (at if at >= 0 else 3) + (4 if fault == CUT else 0)


# ---- from the front: edits, repaired text, counts

_LEGAL = {"su", "ua", "au"}


class _Conversation:
    """What is known of one conversation while its rows stream past."""

    def __init__(self, conv):
        self.conv, self.state, self.audit, self.cost = conv, 0, [], 0
        self.counts = [0, 0, 0, 0, 0]
        self.illegal, self.initial = 0, None
        self.first_turn, self.turn, self.n_turns = None, None, 0
        self.digest, self.begun = hashlib.sha256(), False

    def write(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) if self.begun else ''}{role}:{text}".encode())
        self.begun = True

    def row(self, turn, role: str, text: str, fault: int, edits: str) -> None:
        self.counts[fault] += 1
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in _LEGAL:
            self.illegal += 1
        self.initial = initial
        if turn is not None and (self.turn is None or turn != self.turn):
            self.n_turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.turn = turn
        symbol = symbol_of(fault, role)
        self.audit.append(edits)
        for letter in edits:
            if letter == "I":
                self.inserted()
                continue
            cost, state = _letter(self.state, symbol, letter)
            if letter != "D":
                self.write(role if letter == "K" else _TURN_ROLE[self.state], text)
            self.cost, self.state = self.cost + cost, state

    def inserted(self) -> None:
        self.write(_TURN_ROLE[self.state], "")
        self.cost, self.state = self.cost + INSERT, _TURN[self.state]

    def result(self) -> tuple:
        while _END[self.state]:
            self.audit.append("I")
            self.inserted()
        gaps = 0 if self.turn is None else self.turn - self.first_turn + 1 - self.n_turns
        _, blank, duplicate, cut, _ = self.counts
        return (self.conv, gaps, blank, duplicate, cut, self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest())


_RESULT = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
_RESULT_TYPES = "conv_id {conv}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _tell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation, from its rows in order."""
    traced: dict[tuple[int, int, int, int], tuple[list[str], int]] = {}
    current, edits = None, []
    for batch in batches:
        done = []
        names = ("conv", "turn", "role", "text", "fault", "vector", "block", "place", "length")
        for conv, turn, role, text, fault, vector, block, place, length in zip(*(batch.column(c).to_pylist() for c in names)):
            if current is None or conv != current.conv:
                if current is not None:
                    done.append(current.result())
                current = _Conversation(conv)
            if fault == DROPPED:
                continue
            if place == 0:
                key = (vector, block, length, current.state)
                if key not in traced:
                    if len(traced) >= _REMEMBERED:
                        traced.clear()
                    traced[key] = trace(vector, block_symbols(block, length), current.state)
                edits = traced[key][0]
            current.row(turn, role, text, fault, edits[place])
        if done:
            yield _results(done, batch.schema.field("conv").type)
    if current is not None:
        yield _results([current.result()], batch.schema.field("conv").type)


def _results(rows: list[tuple], conv_type: pa.DataType) -> pa.RecordBatch:
    types = [conv_type, *[pa.int64()] * 6, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=list(_RESULT))


# ---- operators


def _text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(" "))


def damage(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """The rows with planted faults, and ``copies``: how often each stands (0 for a dropped row).

    The fault follows from crc32 of ``conv:turn`` modulo 20: 0 drops the row, 1
    empties its text, 2 takes out its ``.!?``, 3 repeats it, 4 makes its role
    user. Nulls are written as one space.
    """
    key = F.concat(_text(F.col(conv_col)), F.lit(":"), _text(F.col(turn_col)))
    kind = F.crc32(F.encode(key, "UTF-8")) % 20
    text = _text(F.col("text"))
    return conversations.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(_text(F.col("role"))).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def marked(rows: DataFrame, copies_col: str | None = None) -> DataFrame:
    """Every row in the form (conv, turn, role, text, nth, fault), its first fault only.

    Rows that are equal but for the turn are numbered by turn (nulls first);
    those after the first are duplicates.
    """
    copies = F.col(copies_col) if copies_col else F.lit(1)
    role, text = _text(F.col("role")), _text(F.col("text"))
    stands = copies > 0
    spread = rows.select(
        F.col("conv_id").alias("conv"),
        F.col("turn"),
        F.when(stands, role).alias("role"),
        F.when(stands, text).alias("text"),
        F.explode(F.sequence(F.lit(1), F.greatest(copies, F.lit(1)))).alias("_copy"),
    )
    same = Window.partitionBy("conv", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    end = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = (
        F.when(F.col("role").isNull(), DROPPED)
        .when(end == "", BLANK)
        .when(F.col("nth") > 1, DUPLICATE)
        .when(~F.substring(end, -1, 1).isin(".", "!", "?"), CUT)
        .otherwise(NONE)
    )
    return spread.withColumn("nth", F.row_number().over(same)).select("conv", "turn", "role", "text", "nth", fault.alias("fault"))


def repair(rows: DataFrame, *, copies_col: str | None = None) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text): faults, cheapest edits, repaired digest.

    Rows stand by turn (nulls first), equal turns by role and text. Nulls in
    role and text count as one space, which is blank as a text and no known
    role; a null conv_id is a conversation of its own. Turns are whole numbers.
    ``copies_col`` tells how often a row stands; a conversation without a row
    left has zeros, no edits and the digest of the empty string. An empty table
    gives no rows; other columns are not read.
    """
    conv = rows.schema["conv_id"].dataType.simpleString()
    turn = rows.schema["turn"].dataType.simpleString()
    dealt = marked(rows, copies_col).repartition("conv")
    last = F.col("role").isNull()
    names = ("role", "text", "nth")
    backward = dealt.sortWithinPartitions(
        F.col("conv").asc_nulls_first(), last.desc(), F.col("turn").desc_nulls_last(), *[F.col(c).desc() for c in names]
    )
    told = backward.mapInArrow(_look_up, _TOLD.format(conv=conv, turn=turn))
    forward = told.sortWithinPartitions(
        F.col("conv").asc_nulls_first(), last.asc(), F.col("turn").asc_nulls_first(), *[F.col(c).asc() for c in names]
    )
    return forward.mapInArrow(_tell, _RESULT_TYPES.format(conv=conv))
