"""Conversation structure repair by secondary-sorted streaming.

Rows are dealt out by conversation and sorted by turn inside a partition; a
streaming stage walks them once and carries the state of a least-cost edit
search from one Arrow batch to the next.  The roles of a repaired conversation
have the initials ``(s?(ua)+)?``; every row is kept, gets another role or is
deleted, and rows with empty text may be inserted between them:

====== ======================================= ====
letter edit                                    cost
====== ======================================= ====
K      keep                                    0
R      make it a user's or an assistant's row  2
D      delete (must be for blank, duplicate)   3
I      insert an empty user or assistant row   2
====== ======================================= ====

A truncated row that is not deleted adds 1.  Of the cheapest edits the ASCII
least string of letters is taken.  The search has four states (nothing yet,
after s, after u, after a).  All prefixes that end with the edit of the same row
hold equally many of K, R and D and end in one of them, so none continues
another: the order of two of them never changes later, and a rank per state
carries it.  A state that costs more than another could at most save is
dropped, so costs relative to the cheapest state stay small and the step of
(costs, ranks, kind of row) is looked up after its first use.

One byte per row and state points back.  Beyond ``spill`` bytes the pointers and
the rows of a conversation go to an unnamed file of the task, so memory does not
grow with the conversation except by the string of its edits, one byte a row.
Which rows repeat an earlier one is found before, by a map-side combined
minimum per conversation and text, so no set of texts is held either.  The
digest of a repaired conversation is one hash over its text in order: a very
long conversation is one task's stream, never a list in memory.

Defined results: null roles and texts count as one space; null turns come
first; rows of one turn are ordered by role, then text; rows with a null
``conv_id`` are one conversation; a role that is empty, or starts with another
letter, can't be kept; repeated rows are duplicates; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.common import WHITE

SPILL = 16 << 20     # bytes of one conversation kept in memory
OUT_ROWS = 10_000    # rows of a batch that goes out
OUT_BYTES = 8 << 20

_EMPTY, _S, _U, _A = range(4)
_DEAD = 1 << 30
_LETTERS = "KRD"
#: fault of a row
OK, BLANK, DUPLICATE, TRUNCATED = range(4)
FAULTS = ("", "blank", "duplicate", "truncated")

# _SAVES[q][p]: what comes after state q costs at most so much more than what comes after p
_SAVES = ((0, 0, 2, 0), (4, 0, 2, 4), (5, 2, 0, 2), (3, 0, 2, 0))


def _kept(state: int, initial: str) -> int | None:
    if initial == "s":
        return _S if state == _EMPTY else None
    if initial == "u":
        return _U if state != _U else None
    if initial == "a":
        return _A if state == _U else None
    return None


def _filled(state: int) -> int:
    """State after the row that may come next, whatever its first role was."""
    return _A if state == _U else _U


def _moves(initial: str, fault: int) -> list[tuple[int, int, int, int, int]]:
    """(state before, rows inserted, edit, state after, cost) of a row."""
    out, more = [], int(fault == TRUNCATED)
    for before in range(4):
        out.append((before, 0, 2, before, 3))
        if fault in (BLANK, DUPLICATE):
            continue
        state = before
        for inserted in range(3):
            if inserted:
                state = _filled(state)
            after = _kept(state, initial)
            if after is not None:
                out.append((before, inserted, 0, after, 2 * inserted + more))
            out.append((before, inserted, 1, _filled(state), 2 * inserted + 2 + more))
    return out


class Search:
    """Least-cost edits of one conversation, row by row; ``step`` returns the four back pointers."""

    _steps: dict = {}

    def __init__(self):
        self.state, self.base = ((0, _DEAD, _DEAD, _DEAD), (0, 1, 2, 3)), 0

    def step(self, initial: str, fault: int) -> bytes:
        key = (self.state, initial, fault)
        found = self._steps.get(key)
        if found is None:
            found = self._steps[key] = self._compute(*self.state, initial, fault)
        self.state, added, pointers = found
        self.base += added
        return pointers

    @staticmethod
    def _compute(costs, ranks, initial, fault):
        best = [None] * 4
        for before, inserted, edit, after, cost in _moves(initial, fault):
            if costs[before] < _DEAD:
                one = (costs[before] + cost, ranks[before], "I" * inserted + _LETTERS[edit], before, inserted, edit)
                if best[after] is None or one[:3] < best[after][:3]:
                    best[after] = one
        least = min(b[0] for b in best if b)
        new = [b[0] - least if b else _DEAD for b in best]
        for p in range(4):
            if any(q != p and best[q] and best[p] and best[p][0] > best[q][0] + _SAVES[q][p] for q in range(4)):
                new[p] = _DEAD
        order = sorted((p for p in range(4) if best[p]), key=lambda p: best[p][1:3])
        rank = [order.index(p) if best[p] else 3 for p in range(4)]
        rank = [r if c < _DEAD else 3 for r, c in zip(rank, new)]
        pointers = bytes(b[3] | b[4] << 2 | b[5] << 4 if b else 0 for b in best)
        return (tuple(new), tuple(rank)), least, pointers

    def end(self) -> tuple[int, int, int]:
        """(cost, last state, rows inserted at the end)."""
        costs, ranks = self.state
        close = (0, 2, 1, 0)
        cost, _, state = min((costs[p] + 2 * close[p], ranks[p], p) for p in range(4) if costs[p] < _DEAD)
        return self.base + cost, state, close[state]


class Spool:
    """Rows and pointers of a conversation in order: the last ones in memory, older ones in a file of the task."""

    def __init__(self, limit: int):
        self.limit, self.rows, self.pointers, self.held = limit, [], bytearray(), 0
        self.file, self.places, self.n = None, [], 0

    def add(self, row: tuple, pointers: bytes) -> None:
        self.rows.append(row)
        self.pointers += pointers
        self.held += 200 + len(row[1]) + len(row[2])
        self.n += 1
        if self.held > self.limit:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            self.file.seek(0, 2)
            at = self.file.tell()
            self.file.write(self.pointers)
            self.places.append((at, len(self.pointers)))
            pickle.dump(self.rows, self.file, pickle.HIGHEST_PROTOCOL)
            self.rows, self.pointers, self.held = [], bytearray(), 0

    def pointers_back(self):
        """Blocks of pointers from the last to the first."""
        yield bytes(self.pointers)
        for at, size in reversed(self.places):
            self.file.seek(at)
            yield self.file.read(size)

    def rows_again(self):
        for at, size in self.places:
            self.file.seek(at + size)
            yield from pickle.load(self.file)
        yield from self.rows

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Conversation:
    """The rows of one conversation, in order, and what is counted on the way."""

    def __init__(self, conv, spill: int):
        self.conv, self.search, self.spool = conv, Search(), Spool(spill)
        self.faults, self.illegal = [0] * 4, 0
        self.turns, self.first, self.turn, self.last = 0, None, None, None

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if self.last == (turn, role, text) and fault != BLANK:
            fault = DUPLICATE      # equal rows of one turn are neighbours
        if self.last is not None and self.last[1][:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        if turn is not None and turn != self.turn:
            self.turns, self.turn = self.turns + 1, turn
            self.first = turn if self.first is None else self.first
        self.last = (turn, role, text)
        self.faults[fault] += 1
        self.spool.add((turn, role, text, fault), self.search.step(role[:1], fault))

    @property
    def gaps(self) -> int:
        return self.turn - self.first + 1 - self.turns if self.turns else 0

    def edits(self) -> tuple[int, bytes, int]:
        """(cost, one byte a row: inserted rows before it and its edit, rows inserted at the end)."""
        cost, state, closing = self.search.end()
        chosen, at = bytearray(self.spool.n), self.spool.n
        for block in self.spool.pointers_back():
            for place in range(len(block) - 4, -1, -4):
                at -= 1
                pointer = block[place + state]
                chosen[at] = pointer >> 2
                state = pointer & 3
        return cost, bytes(chosen), closing

    def repaired(self, chosen: bytes, closing: int):
        """(edit, turn, role, text, fault) of every row, inserted and deleted ones too."""
        state = _EMPTY

        def inserted():
            nonlocal state
            role, state = ("assistant" if state == _U else "user"), _filled(state)
            return "I", None, role, "", OK

        for what, (turn, role, text, fault) in zip(chosen, self.spool.rows_again()):
            for _ in range(what & 3):
                yield inserted()
            edit = _LETTERS[what >> 2]
            if edit == "R":
                role, state = ("assistant" if state == _U else "user"), _filled(state)
            elif edit == "K":
                state = _kept(state, role[:1])
            yield edit, turn, role, text, fault
        for _ in range(closing):
            yield inserted()


def _conversations(batches, spill: int):
    """Conversations of a stream of sorted batches, one after the other."""
    now = None
    for pdf in batches:
        for conv, absent, turn, role, text, fault in zip(pdf["conv"], pdf["absent"], pdf["turn"], pdf["role"],
                                                         pdf["text"], pdf["fault"]):
            if now is None or now.conv != conv:
                if now is not None:
                    yield now
                    now.spool.close()
                now = Conversation(conv, spill)
            if not absent:
                now.add(None if turn is None else int(turn), role, text, fault)
    if now is not None:
        yield now
        now.spool.close()


_ROWS = "conv string, position long, edit string, turn string, role string, text string, fault string"
_REPORT = ("conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
           "audit string, repaired_sha256 string, n_rows long")


def _out(rows: list, schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


def _emit(rows, schema: str):
    """Data frames of bounded size of (row, bytes) pairs."""
    held, size = [], 0
    for row, n in rows:
        held.append(row)
        size += n
        if len(held) >= OUT_ROWS or size >= OUT_BYTES:
            yield _out(held, schema)
            held, size = [], 0
    if held:
        yield _out(held, schema)


def _rows(spill: int):
    def run(batches):
        def all_rows():
            for c in _conversations(batches, spill):
                _, chosen, closing = c.edits()
                for k, (edit, turn, role, text, fault) in enumerate(c.repaired(chosen, closing)):
                    yield (c.conv, k, edit, None if turn is None else str(turn), role, text, FAULTS[fault]), len(text)
        yield from _emit(all_rows(), _ROWS)
    return run


def _report(spill: int):
    def run(batches):
        def all_rows():
            for c in _conversations(batches, spill):
                cost, chosen, closing = c.edits()
                digest, audit, joint = hashlib.sha256(), bytearray(), ""
                for edit, _, role, text, _ in c.repaired(chosen, closing):
                    audit += edit.encode()
                    if edit != "D":
                        digest.update(f"{joint}{role}:{text}".encode())
                        joint = "\n"
                yield (c.conv, c.gaps, c.faults[BLANK], c.faults[DUPLICATE], c.faults[TRUNCATED], c.illegal, cost,
                       audit.decode(), digest.hexdigest(), c.spool.n), len(audit)
        yield from _emit(all_rows(), _REPORT)
    return run


def _sorted_rows(rows: DataFrame, absent: Column | None) -> DataFrame:
    """Rows with their faults, dealt out by conversation and sorted by turn."""
    base = rows.select(F.col("conv_id").alias("conv"), (F.lit(False) if absent is None else absent).alias("absent"),
                       F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                       F.coalesce("text", F.lit(" ")).alias("text"))
    base = base.withColumn("hash", F.sha2("text", 256))
    when = F.struct(F.col("turn").isNotNull().alias("set"), F.col("turn").alias("turn"))   # null turns first
    again = (base.where(~F.col("absent")).groupBy("conv", "role", "hash")
             .agg(F.min(when).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
             .select(F.col("conv").alias("_conv"), F.col("role").alias("_role"), F.col("hash").alias("_hash"), "first"))
    ending = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = (F.when(ending == "", BLANK).when(F.col("first") < when, DUPLICATE)
             .when(F.substring(ending, -1, 1).isin(".", "!", "?"), OK).otherwise(TRUNCATED))
    return (base.join(again, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role"))
                      & (F.col("hash") == F.col("_hash")), "left")
            .select("conv", "absent", "turn", "role", "text", fault.alias("fault"))
            .repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), "role", "text")
            .select(F.col("conv").cast("string").alias("conv"), "absent", F.col("turn").cast("string").alias("turn"),
                    "role", "text", "fault"))


def repaired(rows: DataFrame, absent: Column | None = None, spill: int = SPILL) -> DataFrame:
    """Every row of every conversation (``conv_id, turn, role, text``) with its edit, and the inserted rows.

    Columns: ``conv_id, position, edit, turn, role, text, fault``; the repaired conversation is what has
    another edit than ``D``, by ``position``.  Rows where ``absent`` holds only name their conversation."""
    return (_sorted_rows(rows, absent).mapInPandas(_rows(spill), _ROWS)
            .withColumn("turn", F.col("turn").cast("long"))
            .select(F.col("conv").cast(rows.schema["conv_id"].dataType).alias("conv_id"), "position", "edit", "turn",
                    "role", "text", "fault"))


def report(rows: DataFrame, absent: Column | None = None, spill: int = SPILL) -> DataFrame:
    """One row per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256`` (of the repaired ``role:text`` lines) and ``n_rows``."""
    return (_sorted_rows(rows, absent).mapInPandas(_report(spill), _REPORT)
            .withColumn("conv_id", F.col("conv").cast(rows.schema["conv_id"].dataType))
            .select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                    "repaired_sha256", "n_rows"))
