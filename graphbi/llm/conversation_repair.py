"""Conversation structure repair: the cheapest edits that make a conversation ``(s?(ua)+)?``, by streaming over sorted rows.

Rows are repartitioned by conversation and sorted by turn within the
partitions; ``mapInPandas`` then runs over each partition once, from the last
turn of a conversation to its first, and carries the costs of the best repair
of all that follows across Arrow batches.  There are four states (nothing yet,
after a system, user or assistant turn), so a row's back pointers are one
byte: the best next edit of each state.  At the conversation's first row they
are followed forwards.  Rows and back pointers beyond ``SPILL`` bytes of a
conversation go to an unnamed temporary file of the task, block by block, and
are read from its end: memory stays bounded for a conversation of any length.
The file belongs to the running task alone, as Spark's own sort runs do; a lost
executor's task starts over.

Edits and costs: Keep 0, Rerole to user or assistant 1, Delete 2 (the only edit
of a blank or duplicate row), Insert a user or assistant turn without text 5;
a truncated row that isn't deleted adds 5.  Of equally cheap repairs the one
whose initials are least in ASCII is taken.

Defined results: a null role or text counts as one space, a null turn sorts
first and counts in no gap, null conversation ids are one conversation.  Rows
of one turn are taken by role and text, so ties have one order; a row is a
duplicate if an equal role and text comes earlier.  A role's initial is its
first character, an empty role's a space, which fits nowhere.  A conversation
of which nothing is left has zeros and empty texts.  An empty table gives an
empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Callable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphbi.llm.common import table

#: White space of the contract, and the characters that end a sentence (fixed values).
SPACE, ENDS = " \t\n\x0b\x0c\r", (".", "!", "?")
#: Costs of the edits, and of keeping a truncated row (fixed values).
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing yet, after a system, a user and an assistant turn; the state after the turn that may be inserted in each.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
#: Edits in the order of their initials.
EDITS = "DIKR"
#: Costs of what is missing at the end, by state: nothing, two turns, one turn, nothing.
AT_END = (0, 2 * INSERT, INSERT, 0)
#: Pairs of adjacent initials that are legal.
LEGAL = {"su", "ua", "au"}
#: Bytes of a conversation's rows in memory.
SPILL = 1 << 24
#: Faults of a row, in the order in which they count.
BLANK, DUPLICATE, CUT, SOUND = range(4)


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): rows damaged by crc32(``conv_id:turn``) mod 20; ``gone`` marks dropped ones.

    0 drops a row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it,
    4 makes its role user.  Nulls count as one space, but a null turn stays.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"),
                                (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20).alias("_what"))
    what = F.col("_what")
    rows = rows.select("conv_id", "turn", F.when(what == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                       F.when(what == 1, F.lit("")).when(what == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                       (what == 0).alias("gone"), F.when(what == 3, 2).otherwise(1).alias("_times"))
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_times", "_copy")


@cache
def _row_step(initial: str, fault: int, after: tuple[int, ...]) -> tuple[int, tuple[int, ...], int]:
    """One row further towards the start: (what the least cost grew by, costs above it by state, back pointers).

    ``after``: the costs by state behind the row, above their least.  Few
    different ones exist, so all results are kept.
    """
    cost, edit = [], []
    for state in range(4):
        ways = [(DELETE + after[state], "D")]
        if fault not in (BLANK, DUPLICATE):
            extra = TRUNCATED if fault == CUT else 0
            fits = {"s": SYSTEM if state == START else None, "u": USER if state != USER else None,
                    "a": ASSISTANT if state == USER else None}.get(initial)
            if fits is not None:
                ways.append((extra + after[fits], "K"))
            ways.append((REROLE + extra + after[NEXT[state]], "R"))
        c, e = min(ways)
        cost.append(c)
        edit.append(e)
    for _ in range(3):  # inserts before the row; a third one never pays
        ways = [min((cost[s], edit[s]), (INSERT + cost[NEXT[s]], "I")) for s in range(4)]
        cost, edit = [c for c, _ in ways], [e for _, e in ways]
    least = min(cost)
    return least, tuple(c - least for c in cost), sum(EDITS.index(e) << 2 * s for s, e in enumerate(edit))


class _Conversation:
    """State of the conversation that is being read, from its last row to its first."""

    def __init__(self, key, spill: int):
        self.key, self.spill = key, spill
        self.cost, self.after = 0, AT_END
        self.faults, self.illegal, self.behind = [0, 0, 0, 0], 0, ""
        self.turns, self.first_turn, self.last_turn = 0, None, None
        self.pointers, self.rows, self.size = bytearray(), [], 0
        self.file, self.blocks = None, []

    def add(self, turn: str | None, role: str, text: str, initial: str, fault: int) -> None:
        self.faults[fault] += 1
        if self.behind and initial + self.behind not in LEGAL:
            self.illegal += 1
        self.behind = initial
        if turn is not None and turn != self.first_turn:
            self.turns += 1
            self.first_turn = turn
            self.last_turn = turn if self.last_turn is None else self.last_turn
        grown, self.after, pointers = _row_step(initial, fault, self.after)
        self.cost += grown
        self.pointers.append(pointers)
        self.rows.append((role, text))
        self.size += len(role) + len(text) + 64
        if self.size > self.spill:
            self.file = self.file or tempfile.TemporaryFile()
            self.blocks.append(self.file.tell())
            pickle.dump((bytes(self.pointers), self.rows), self.file, pickle.HIGHEST_PROTOCOL)
            self.pointers, self.rows, self.size = bytearray(), [], 0

    def _forwards(self) -> Iterator[tuple[int, tuple[str, str]]]:
        yield from zip(reversed(self.pointers), reversed(self.rows), strict=True)
        for at in reversed(self.blocks):
            self.file.seek(at)
            pointers, rows = pickle.load(self.file)
            yield from zip(reversed(pointers), reversed(rows), strict=True)

    def edits(self) -> Iterator[tuple[str, str | None, str | None]]:
        """(initial of the edit, role, text) from the first row on; a deleted row's role and text are None."""
        state = START
        inserted = {USER: "user", ASSISTANT: "assistant"}
        for pointers, (role, text) in self._forwards():
            while (edit := EDITS[pointers >> 2 * state & 3]) == "I":
                state = NEXT[state]
                yield "I", inserted[state], ""
            if edit == "D":
                yield "D", None, None
                continue
            if edit == "K":
                state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
            else:
                state = NEXT[state]
                role = inserted[state]
            yield edit, role, text
        while AT_END[state]:
            state = NEXT[state]
            yield "I", inserted[state], ""
        if self.file is not None:
            self.file.close()

    def numbers(self) -> dict:
        gaps = 0 if self.first_turn is None else int(self.last_turn) - int(self.first_turn) + 1 - self.turns
        return {"conv": self.key, "gaps": gaps, "blank": self.faults[BLANK], "duplicate": self.faults[DUPLICATE],
                "truncated": self.faults[CUT], "illegal": self.illegal, "cost": self.cost + self.after[START]}


def _sorted_rows(rows: DataFrame) -> DataFrame:
    """Rows with their initials and faults, by conversation and from the last turn to the first: one shuffle, two sorts.

    The window that finds duplicates needs the rows of a conversation
    together, which the repartitioning gives.
    """
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    named = rows.select(F.col("conv_id").cast("string").alias("conv"), "turn", part("role").alias("role"), part("text").alias("text"),
                        F.coalesce(gone, F.lit(False)).alias("gone"))
    same = Window.partitionBy("conv", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = (F.when(bare == "", BLANK).when(F.col("_nth") > 1, DUPLICATE)
             .when(~F.right(bare, F.lit(1)).isin(*ENDS), CUT).otherwise(SOUND))
    initial: Column = F.when(F.col("role") == "", F.lit(" ")).otherwise(F.left("role", F.lit(1)))
    return (named.repartition("conv").withColumn("_nth", F.row_number().over(same))
            .sortWithinPartitions("conv", F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("text").desc(), F.col("_nth").desc())
            .select("conv", F.col("turn").cast("string").alias("turn"), "role", "text", "gone", initial.alias("initial"), fault.alias("fault")))


def _stream(rows: DataFrame, ddl: str, emit: Callable[[_Conversation], Iterator[dict]], spill: int) -> DataFrame:
    """``emit`` on every conversation as soon as its first row is read; what it yields are the result's rows."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current: _Conversation | None = None
        out: list[dict] = []
        size = 0

        def ready(least: int) -> Iterator[pd.DataFrame]:
            nonlocal out, size
            if len(out) > least or size > SPILL:
                yield pd.DataFrame(out)
                out, size = [], 0

        def end() -> Iterator[pd.DataFrame]:
            nonlocal size
            for row in emit(current):
                out.append(row)
                size += sum(len(x) for x in row.values() if isinstance(x, str))
                yield from ready(10000)

        for frame in frames:
            columns = [frame[c].tolist() for c in ("conv", "turn", "role", "text", "gone", "initial", "fault")]
            for conv, turn, role, text, gone, initial, fault in zip(*columns, strict=True):
                if current is None or conv != current.key:
                    if current is not None:
                        yield from end()
                    current = _Conversation(conv, spill)
                if not gone:
                    current.add(turn, role, text, initial, fault)
        if current is not None:
            yield from end()
        yield from ready(0)

    return _sorted_rows(rows).mapInPandas(run, ddl)


def report(rows: DataFrame, spill: int = SPILL) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text[, gone]): its faults, the cost and initials of the repair, its digest."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def emit(c: _Conversation) -> Iterator[dict]:
        audit, digest = [], hashlib.sha256()
        line = b""
        for edit, role, text in c.edits():
            audit.append(edit)
            if role is not None:
                digest.update(line)
                digest.update(f"{role}:{text}".encode())
                line = b"\n"
        yield c.numbers() | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    ddl = "conv string, " + ", ".join(f"{c} bigint" for c in counts) + ", audit string, repaired_sha256 string"
    return _stream(rows, ddl, emit, spill).select(F.col("conv").cast(kind).alias("conv_id"), *counts, "audit", "repaired_sha256")


def repaired(rows: DataFrame, spill: int = SPILL) -> DataFrame:
    """(conv_id, position, edit, role, text) of the repaired conversations; conversations without turns have no rows."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def emit(c: _Conversation) -> Iterator[dict]:
        position = 0
        for edit, role, text in c.edits():
            if role is not None:
                yield {"conv": c.key, "position": position, "edit": edit, "role": role, "text": text}
                position += 1

    out = _stream(rows, "conv string, position bigint, edit string, role string, text string", emit, spill)
    return out.select(F.col("conv").cast(kind).alias("conv_id"), "position", "edit", "role", "text")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repairs of all conversations, after the contract's damage."""
    return report(damage(table(spark, sf_dir, "conversations")))
