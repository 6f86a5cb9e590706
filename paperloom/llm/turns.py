"""Repair of conversations: the cheapest edits that make the roles ``(s?(ua)+)?``.

The rows of a conversation pass once, in order, through a Viterbi search with four states: what
the roles kept so far may be followed by. Each state's survivor is a leaf of a tree of back
pointers. A node counts the nodes and survivors that hold on to it and goes when none does; as
long as the root has a single child, every survivor agrees on that edit, and it is emitted: its
initial into the audit, its row into the running hash. Only the rows behind the root are held.
A survivor dearer than another by more than any end can make up for is dropped, or the path that
deletes every row would keep the root open for ever. What stays open is what the rows to come can
still decide: in a conversation of users alone, two ways differ from the second row on by whether
the number of rows is even.

Paths of one cost are told apart by their whole unresolved strings of edits. The survivors are
kept in the order of those strings: two paths to one state compare as the survivors they come
from, and by their last edits if that is the same one. (Each path has one edit other than Insert
per row and ends with it, so no path's string begins another's.)

Everything that does not need the order of rows is computed by columns before: damage, blank and
truncated rows, and which texts a conversation said before. The order of rows and the hash over
them are why one task sees a whole conversation, however long; it streams through it.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that do not make a text, as the contract of all text operators has them.
SPACE = " \t\n\x0b\x0c\r"
#: Tasks that share the rows of a text said in many turns of one conversation.
SPREAD = 16
KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
TRUNCATED_COST = 3

OK, BLANK, DUPLICATE, TRUNCATED = range(4)
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: States from which a role may follow, and the state behind it.
FOLLOWS = {"s": ((NOTHING,), SYSTEM), "u": ((NOTHING, SYSTEM, ASSISTANT), USER), "a": ((USER,), ASSISTANT)}
#: By state before and behind: the inserts that lead there. A third one never pays.
INSERTS = (
    *((s, s, "") for s in range(4)),
    (NOTHING, USER, "I"), (NOTHING, ASSISTANT, "II"), (SYSTEM, USER, "I"), (SYSTEM, ASSISTANT, "II"),
    (USER, ASSISTANT, "I"), (ASSISTANT, USER, "I"),
)

#: By state, then by another: what an end costs more from the other than from this one, at most
#: (by inserts, or by deleting a system row). A survivor dearer than another by more cannot win.
DEARER = {
    NOTHING: (0, 6, 7, 4),
    SYSTEM: (0, 0, 3, 0),
    USER: (3, 3, 0, 3),
    ASSISTANT: (0, 6, 3, 0),
}

REPAIRED = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "cost bigint, audit string, repaired_sha256 string"
)


def _moves() -> dict[tuple[int, str], list[tuple[int, str, int, int]]]:
    """By whether a row must go and its role's initial: ways from a state to a state, as
    (from, edits, to, cost without that of a truncated row). Only D takes the row away."""
    moves = {}
    for must_go in (True, False):
        for initial in ("s", "u", "a", ""):
            ways = []
            for start, at, inserts in INSERTS:
                cost = INSERT * len(inserts)
                ways.append((start, inserts + "D", at, cost + DELETE))
                if must_go:
                    continue
                if initial and at in FOLLOWS[initial][0]:
                    ways.append((start, inserts + "K", FOLLOWS[initial][1], cost + KEEP))
                for role in "ua":
                    if at in FOLLOWS[role][0]:
                        ways.append((start, inserts + "R", FOLLOWS[role][1], cost + REROLE))
            moves[must_go, initial] = ways
    return moves


MOVES = _moves()


@dataclass(slots=True)
class Node:
    """An edited row; ``holders`` counts its children and the survivors that end here."""

    parent: Node | None
    edits: str
    holders: int = 0


class Repair:
    """Cheapest edits of one conversation, fed row by row."""

    def __init__(self) -> None:
        self.root = Node(None, "", 1)
        # per state: cost, place among the survivors' strings, node
        self.survivors: list[tuple[int, int, Node] | None] = [(0, 0, self.root), None, None, None]
        self.pending: deque[tuple[str, str] | None] = deque()
        self.state = NOTHING
        self.audit: list[str] = []
        self.hash, self.first = hashlib.sha256(), True

    def _release(self, node: Node | None) -> None:
        while node is not None:
            node.holders -= 1
            if node.holders:
                return
            node = node.parent

    def _say(self, role: str, text: str) -> None:
        self.hash.update((role + ":" + text if self.first else "\n" + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.first = False

    def _emit(self, edits: str, row: tuple[str, str] | None) -> None:
        """Carry out what all survivors agree on."""
        self.audit.append(edits)
        for edit in edits:
            if edit == "D":
                continue
            if edit == "K" and row[0][0] == "s":
                self.state = SYSTEM
                self._say(*row)
                continue
            self.state = ASSISTANT if self.state == USER else USER
            role = row[0] if edit == "K" else "assistant" if self.state == ASSISTANT else "user"
            self._say(role, "" if edit == "I" else row[1])

    def feed(self, role: str, text: str | None, fault: int) -> None:
        must_go = fault in (BLANK, DUPLICATE)
        initial = role[:1] if role[:1] in FOLLOWS else ""
        extra = TRUNCATED_COST if fault == TRUNCATED else 0
        best: list[tuple[int, int, str, Node] | None] = [None] * 4
        for start, edits, end, cost in MOVES[must_go, initial]:
            old = self.survivors[start]
            if old is None:
                continue
            way = (old[0] + cost + (extra if edits[-1] != "D" else 0), old[1], edits, old[2])
            if best[end] is None or way[:3] < best[end][:3]:
                best[end] = way
        least = [way[0] if way else None for way in best]
        for state, way in enumerate(best):
            if way and any(c is not None and c + more < way[0] for c, more in zip(least, DEARER[state], strict=True)):
                best[state] = None
        ranked = sorted({way[1:3] for way in best if way})
        before, after = self.survivors, []
        for way in best:
            if way is None:
                after.append(None)
                continue
            way[3].holders += 1
            after.append((way[0], ranked.index(way[1:3]), Node(way[3], way[2], 1)))
        self.survivors = after
        for old in before:
            if old is not None:
                self._release(old[2])
        self.pending.append(None if must_go else (role, text))
        self._settle()

    def _settle(self) -> None:
        """Emit edits while the root has a single child and no survivor of its own."""
        if self.root.holders != 1:
            return
        node = next(s[2] for s in self.survivors if s is not None)
        path = []
        while node is not self.root:
            path.append(node)
            node = node.parent
        while path and self.root.holders == 1:
            self.root = path.pop()
            self.root.parent = None
            self._emit(self.root.edits, self.pending.popleft())

    def finish(self) -> tuple[int, str, str]:
        """Cost, audit and hash of the cheapest way to an accepted end."""
        ends = [
            (self.survivors[state][0] + INSERT * len(inserts), self.survivors[state][1], inserts, self.survivors[state][2])
            for state, inserts in ((NOTHING, ""), (ASSISTANT, ""), (USER, "I"), (SYSTEM, "II"))
            if self.survivors[state] is not None
        ]
        cost, _, inserts, node = min(ends, key=lambda end: end[:3])
        path = []
        while node is not self.root:
            path.append(node.edits)
            node = node.parent
        for edits in reversed(path):
            self._emit(edits, self.pending.popleft())
        self._emit(inserts, None)
        return cost, "".join(self.audit), self.hash.hexdigest()


class Tally:
    """The columns of one conversation, from its rows in order."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.repair = conv_id, Repair()
        self.counts, self.illegal = [0] * 4, 0
        self.last_initial: str | None = None
        self.low = self.high = None
        self.turns = 0
        self.last = None

    def add(self, turn: int | None, role: str, text: str, fault: int, copies: int) -> None:
        """``copies`` equal rows of a turn; behind the first one all are duplicates, unless blank."""
        if turn is not None and copies:
            self.low = turn if self.low is None else self.low
            self.turns += self.high != turn
            self.high = turn
        for _ in range(copies):
            if fault in (OK, TRUNCATED) and self.last == (turn, role, text):
                fault = DUPLICATE
            self.last = (turn, role, text)
            self.counts[fault] += 1
            initial = role[:1]
            self.illegal += self.last_initial is not None and self.last_initial + initial not in ("su", "ua", "au")
            self.last_initial = initial
            self.repair.feed(role, text, fault)

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        _, blank, duplicate, truncated = self.counts
        return (self.conv_id, gaps, blank, duplicate, truncated, self.illegal, *self.repair.finish())


def damage_turns(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults, by the crc32 of conversation and turn modulo 20.

    ``copies`` says how often a row comes: 0 if it is dropped, 2 if it is repeated.
    """
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(name) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _fault_of_text(text: Column) -> Column:
    last = F.right(F.rtrim(text, F.lit(SPACE)), F.lit(1))
    return F.when(last == "", BLANK).when(last.isin(".", "!", "?"), OK).otherwise(TRUNCATED)


def mark_faults(turns: DataFrame) -> DataFrame:
    """``fault`` of each row but for equal rows within one turn, which are neighbours in order.

    A row is a duplicate if its conversation has its role and text in an earlier turn. What comes
    in one turn only needs no look-up; the rest is told by the first turn of each text.
    """
    marked = turns.withColumn("fault", _fault_of_text(F.col("text")))
    marked = marked.withColumn("digest", F.unhex(F.md5("text"))).withColumn(
        "at", F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    )
    told = marked.where("copies > 0").where(F.col("fault") != BLANK)
    again = told.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("since"), F.max("at").alias("until"))
    # a text said in many turns is met by its rows in several tasks
    again = again.where("since < until").select(
        F.col("conv_id").alias("of"), F.col("role").alias("by"), F.col("digest").alias("said"), "since",
        F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("part"),
    )
    rows = marked.withColumn("spread", F.pmod(F.xxhash64("turn"), F.lit(SPREAD)).cast("int"))
    joined = rows.join(
        again,
        F.col("conv_id").eqNullSafe(F.col("of"))
        & (F.col("role") == F.col("by"))
        & (F.col("digest") == F.col("said"))
        & (F.col("spread") == F.col("part")),
        "left",
    )
    earlier = (F.col("fault") != BLANK) & F.col("since").isNotNull() & (F.col("since") < F.col("at"))
    return joined.select(
        "conv_id", "turn", "role", "text", "copies", F.when(earlier, DUPLICATE).otherwise(F.col("fault")).alias("fault")
    )


def repair_turns(turns: DataFrame) -> DataFrame:
    """One row per conversation of marked rows (``REPAIRED``)."""

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in REPAIRED.split(", ")]
        types = [pa.int64()] * 7 + [pa.string()] * 2

        def table(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        tally: Tally | None = None
        for batch in batches:
            done = []
            for conv_id, *row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                if tally is None or tally.conv_id != conv_id:
                    if tally is not None:
                        done.append(tally.row())
                    tally = Tally(conv_id)
                tally.add(*row)
            if done:
                yield table(done)
        if tally is not None:
            yield table([tally.row()])

    rows = turns.select("conv_id", "turn", "role", "text", "fault", "copies")
    ordered = rows.repartition("conv_id").sortWithinPartitions(
        F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text"
    )
    return ordered.mapInArrow(repair, REPAIRED)


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """Damage every row as the contract says, mark faults, and repair each conversation.

    A null role or text is one space, so such a text is blank; rows without a turn come first and
    have no part in ``gaps``; rows without a conversation are one conversation. Rows of one turn
    are ordered by role and text. Equal rows each count: the first is kept or repaired, the others
    are duplicates. A conversation whose rows are all dropped has zeros, no audit and the hash of
    nothing. A text of any length is read whole. An empty table gives no rows, and other columns
    are ignored. ``audit`` and the hash of a conversation are single values, so one task walks
    through its rows; it holds only rows whose edits are still open.
    """
    return repair_turns(mark_faults(damage_turns(conversations)))
