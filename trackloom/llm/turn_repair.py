"""Repair of conversation structure: the cheapest edits that make the roles of a conversation ``(s?(ua)+)?``.

The state of a repaired prefix is one of four (nothing, system, user, assistant); rerole and insert always give the role
that the state wants, so an audit (the initials of the edits) says all.  Hirschberg's divide and conquer finds it in linear space: a forward
vector of four costs, which also ranks the four least audits, meets a backward vector of four costs at the middle, the cheapest crossing
with the least audit is taken, and both halves recurse.  Every part of an audit ends with the edit of a row, so no part is a prefix
of another one and the left parts alone decide which of two equally cheap audits is less.

Conversations are range-partitioned in the order of their turns.  Those that lie wholly inside a partition are solved there; the first and the last
of a partition may go on beside it and are solved in pieces: every piece becomes a 4 x 4 table of costs and ranks, the same
divide and conquer over the tables (at most one a partition) fixes the states at the borders, and every piece is solved between its two.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import shuffle_partitions
from trackloom.session import materialize

EMPTY, SYSTEM, USER, ASSISTANT = range(4)
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
#: The role that rerole and insert give in a state, as the state that follows.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
KEEP = {"s": {EMPTY: SYSTEM}, "u": {EMPTY: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: Inserts that a finished conversation still needs in each state.
TAIL = (0, 2, 1, 0)
INF = 1 << 60
SPACES = " \t\n\x0b\x0c\r"
#: Answers for short conversations kept in a worker.
CACHE = 50_000

#: (state before, state after) -> (cost, what orders audits from the same state before: edits of a row, rank of a piece)
Edges = dict[tuple[int, int], tuple[int, object]]


def row_edges(initial: str, must_go: bool, cut: bool) -> Edges:
    """Cheapest edits (inserts, then one edit of the row) between any two states; of equally cheap ones the least."""
    best: Edges = {}
    for before in range(4):
        at, inserts = before, 0
        while inserts < 3:  # a third insert comes back to the state after the first
            ways = [("D", at, DELETE)]
            if not must_go:
                ways.append(("R", NEXT[at], REROLE + CUT * cut))
                if at in KEEP.get(initial, {}):
                    ways.append(("K", KEEP[initial][at], CUT * cut))
            for letter, after, cost in ways:
                way = (INSERT * inserts + cost, "I" * inserts + letter)
                best[before, after] = min(best.get((before, after), way), way)
            at, inserts = NEXT[at], inserts + 1
    return best


#: A row's kind: three bits of fault and role.
KINDS = [row_edges("sua-"[k & 3], bool(k & 4), bool(k & 8)) for k in range(16)]


def kind_of(initial: str, must_go: bool, cut: bool) -> int:
    place = "sua".find(initial) if initial else -1
    return (place if place >= 0 else 3) | (4 if must_go else 8 if cut else 0)


class Crossing:
    """Divide and conquer over steps, given as indices into ``tables`` of edges."""

    def __init__(self, tables: Sequence[Edges]) -> None:
        self.tables = tables
        self.onward: dict = {}
        self.backward: dict = {}

    @staticmethod
    def start(state: int) -> tuple:
        return tuple(0 if q == state else INF for q in range(4)), (0, 0, 0, 0)

    def forward(self, vector: tuple, step: int) -> tuple:
        """Costs (less their minimum) and ranks of the least audits after one more step."""
        got = self.onward.get((vector, step))
        if got is None:
            cost, rank = vector
            best: dict[int, tuple] = {}
            for (before, after), (c, order) in self.tables[step].items():
                if cost[before] < INF:
                    way = (cost[before] + c, rank[before], order)
                    best[after] = min(best.get(after, way), way)
            low = min(w[0] for w in best.values())
            ranks = {q: r for r, q in enumerate(sorted(best, key=lambda q: best[q][1:]))}
            got = (
                tuple(best[q][0] - low if q in best else INF for q in range(4)),
                tuple(ranks.get(q, 0) for q in range(4)),
            )
            self.onward[vector, step] = got
        return got

    def back(self, cost: tuple, step: int) -> tuple:
        """Costs (less their minimum) from before a step to the wanted state."""
        got = self.backward.get((cost, step))
        if got is None:
            new = [INF] * 4
            for (before, after), (c, _) in self.tables[step].items():
                if cost[after] < INF:
                    new[before] = min(new[before], cost[after] + c)
            low = min(new)
            got = self.backward[cost, step] = tuple(c - low if c < INF else INF for c in new)
        return got

    def final(self, steps: Sequence[int]) -> int:
        """The state in which the best audit leaves the last step."""
        vector = self.start(EMPTY)
        for s in steps:
            vector = self.forward(vector, s)
        return min((c + INSERT * TAIL[q], r, q) for q, (c, r) in enumerate(zip(*vector)) if c < INF)[2]

    def states(self, steps: Sequence[int], first: int, last: int) -> list[int]:
        """States before and after every step of the best audit from ``first`` to ``last``."""
        out = [first] * (len(steps) + 1)
        out[-1] = last
        open_ = [(0, len(steps))]
        while open_:
            lo, hi = open_.pop()
            if hi - lo < 2:
                continue
            mid = (lo + hi) // 2
            vector, cost = self.start(out[lo]), self.start(out[hi])[0]
            for i in range(lo, mid):
                vector = self.forward(vector, steps[i])
            for i in range(hi - 1, mid - 1, -1):
                cost = self.back(cost, steps[i])
            out[mid] = min(
                (vector[0][q] + cost[q], vector[1][q], q) for q in range(4) if vector[0][q] < INF and cost[q] < INF
            )[2]
            open_ += [(lo, mid), (mid, hi)]
        return out

    def table(self, steps: Sequence[int]) -> Edges:
        """The edges of all ``steps`` as one: least cost and rank of the least audit for every pair of states."""
        out: Edges = {}
        for before in range(4):
            cost, rank = self.start(before)
            total, live = 0, (cost, rank)
            for s in steps:
                # the minimum that forward() takes off is added again
                raw = min(live[0][a] + c for (a, _), (c, _) in self.tables[s].items() if live[0][a] < INF)
                total += raw
                live = self.forward(live, s)
            for after in range(4):
                if live[0][after] < INF:
                    out[before, after] = (total + live[0][after], live[1][after])
        return out


ROWS = Crossing(KINDS)
_SOLVED: dict[bytes, list[int]] = {}


def best_states(kinds: bytes) -> list[int]:
    """States of the best audit of a whole conversation; equal short ones are solved once."""
    got = _SOLVED.get(kinds)
    if got is None:
        got = ROWS.states(kinds, EMPTY, ROWS.final(kinds))
        if len(kinds) <= 64:
            if len(_SOLVED) >= CACHE:
                _SOLVED.clear()
            _SOLVED[kinds] = got
    return got


def fault_of(text: str, repeated: bool) -> str:
    """``b``lank, ``d``uplicate, ``t``runcated or nothing: the first fault of a row."""
    core = text.rstrip(SPACES)
    if not core:
        return "b"
    return "d" if repeated else "" if core[-1] in ".!?" else "t"


def mended(role: str, text: str, kind: int, before: int, after: int, tail: bool) -> tuple[str, int, list[str]]:
    """Edits of a row between two states, their cost, and the repaired rows; ``tail`` adds what the end needs."""
    cost, edits = KINDS[kind][before, after]
    lines, at = inserted(before, len(edits) - 1)
    if edits[-1] == "K":
        lines.append(f"{role}:{text}")
    elif edits[-1] == "R":
        lines.append(f"{ROLE[NEXT[at]]}:{text}")
    if tail:
        lines += inserted(after, TAIL[after])[0]
        edits, cost = edits + "I" * TAIL[after], cost + INSERT * TAIL[after]
    return edits, cost, lines


def inserted(state: int, count: int) -> tuple[list[str], int]:
    lines = []
    for _ in range(count):
        state = NEXT[state]
        lines.append(f"{ROLE[state]}:")
    return lines, state


@dataclass
class Report:
    """Figures of one conversation, fed with its rows in order; holds no text."""

    turns: tuple | None = None
    last_turn: int | None = None
    distinct: int = 0
    faults: dict = field(default_factory=lambda: {"b": 0, "d": 0, "t": 0, "": 0})
    illegal: int = 0
    cost: int = 0
    previous: str | None = None
    audit: list = field(default_factory=list)
    lines: int = 0
    digest: object = field(default_factory=hashlib.sha256)

    def row(self, turn: int | None, initial: str, fault: str) -> None:
        if turn is not None:
            self.turns = (self.turns[0] if self.turns else turn, turn)
            if turn != self.last_turn:
                self.distinct, self.last_turn = self.distinct + 1, turn
        self.faults[fault] += 1
        if self.previous is not None and self.previous + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.previous = initial

    def repaired(self, edits: str, cost: int, text: str | None) -> None:
        self.audit.append(edits)
        self.cost += cost
        if text is not None:
            self.digest.update((("\n" if self.lines else "") + text).encode())
            self.lines += 1

    def result(self) -> tuple:
        gaps = self.turns[1] - self.turns[0] + 1 - self.distinct if self.turns else 0
        return (
            gaps, self.faults["b"], self.faults["d"], self.faults["t"], self.illegal, self.cost, "".join(self.audit),
            self.digest.hexdigest(),
        )


RESULT = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]
COLUMNS = ["conv_id", *[n for n, _ in RESULT]]
FIRST_PASS = pa.schema(
    [("conv_id", pa.int64()), ("p", pa.int32()), ("i", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("gone", pa.bool_()), *RESULT]
)


def solved(rows: list[tuple]) -> tuple:
    """Figures of a whole conversation, given as (turn, role, text, gone) in order."""
    rows = [r for r in rows if not r[3]]
    seen: set = set()
    kinds, faults = bytearray(), []
    for _, role, text, _ in rows:
        fault = fault_of(text, (role, text) in seen)
        seen.add((role, text))
        faults.append(fault)
        kinds.append(kind_of(role[:1], fault in ("b", "d"), fault == "t"))
    states = best_states(bytes(kinds))
    report = Report()
    for k, (turn, role, text, _) in enumerate(rows):
        report.row(turn, role[:1], faults[k])
        edits, cost, lines = mended(role, text, kinds[k], states[k], states[k + 1], k == len(rows) - 1)
        report.repaired(edits, cost, "\n".join(lines) if lines else None)
    return report.result()


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with their planned damage: ``copies`` is 0 for a dropped row and 2 for a repeated one."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key) % 20
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    role = F.coalesce(F.col("role").cast("string"), F.lit(" "))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def sql_of(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.bool_(): "boolean"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Figures of the conversations inside the partition, and the rows of its first and its last one."""
    nothing = (None,) * len(RESULT)
    held: list[tuple] = []
    current: object = ()
    part, first, out = 0, True, []

    def finish() -> None:
        if first or last:
            out.extend((current, part, i, *row, *nothing) for i, row in enumerate(held))
        else:
            out.append((current, part, None, None, None, None, None, *solved(held)))

    last = False
    for batch in batches:
        for conv, turn, role, text, copies, part in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "p")]):
            if conv != current or current == ():
                if held:
                    finish()
                    first = False
                current, held = conv, []
            held.extend([(turn, role, text, copies == 0)] * max(copies, 1))
        if out:
            yield table_of(out, FIRST_PASS)
            out = []
    if held:
        last = True
        finish()
        yield table_of(out, FIRST_PASS)


def kinds_of(table: pa.Table | pa.RecordBatch) -> tuple[list, bytearray, list[str]]:
    """Of the rows of a piece in order: (i, turn, role, text, gone), kind and fault of each; a gone row has neither."""
    columns = [table.column(c).to_pylist() for c in ("i", "turn", "role", "text", "gone", "repeated")]
    rows = sorted(zip(*columns), key=lambda r: r[0])
    kinds, faults = bytearray(), []
    for _, _, role, text, gone, repeated in rows:
        fault = fault_of(text, repeated)
        faults.append(fault)
        kinds.append(255 if gone else kind_of(role[:1], fault in ("b", "d"), fault == "t"))
    return rows, kinds, faults


TABLE = pa.schema([("conv_id", pa.int64()), ("p", pa.int32()), ("cost", pa.list_(pa.int64())), ("rank", pa.list_(pa.int64()))])
PAIRS = [(a, b) for a in range(4) for b in range(4)]


def piece_table(piece: pa.Table) -> pa.Table:
    """One row: costs and ranks of a piece between any two states (-1: no way)."""
    _, kinds, _ = kinds_of(piece)
    edges = ROWS.table([k for k in kinds if k != 255])
    cost = [edges[p][0] if p in edges else -1 for p in PAIRS]
    rank = [edges[p][1] if p in edges else -1 for p in PAIRS]
    row = (piece.column("conv_id")[0].as_py(), piece.column("p")[0].as_py(), cost, rank)
    return pa.Table.from_batches([table_of([row], TABLE)])


BORDERS = pa.schema([("conv_id", pa.int64()), ("p", pa.int32()), ("before", pa.int32()), ("after", pa.int32()), ("ends", pa.bool_())])


def borders(tables: pa.Table) -> pa.Table:
    """States before and after every piece of a conversation."""
    rows = sorted(zip(*[tables.column(c).to_pylist() for c in ("conv_id", "p", "cost", "rank")]), key=lambda r: r[1])
    edges = [{p: (c, r) for p, c, r in zip(PAIRS, cost, rank) if c >= 0} for _, _, cost, rank in rows]
    pieces, steps = Crossing(edges), range(len(edges))
    states = pieces.states(steps, EMPTY, pieces.final(steps))
    out = [(r[0], r[1], states[k], states[k + 1], k == len(rows) - 1) for k, r in enumerate(rows)]
    return pa.Table.from_batches([table_of(out, BORDERS)])


PIECES = pa.schema([("conv_id", pa.int64()), ("p", pa.int32()), ("i", pa.int64()), ("turn", pa.int64()), ("gone", pa.bool_()), ("initial", pa.string()), ("fault", pa.string()), ("edits", pa.string()), ("cost", pa.int64()), ("lines", pa.string())])


def mend_piece(piece: pa.Table) -> pa.Table:
    """Edits and repaired rows of every row of a piece between its two states."""
    conv, p = piece.column("conv_id")[0].as_py(), piece.column("p")[0].as_py()
    before, after, ends = (piece.column(c)[0].as_py() for c in ("before", "after", "ends"))
    rows, kinds, faults = kinds_of(piece)
    states = ROWS.states(bytes(k for k in kinds if k != 255), before, after)
    out, at = [], 0
    for k, (i, turn, role, text, gone, _) in enumerate(rows):
        if gone:
            got: tuple = ("", 0, [])
        else:
            got = mended(role, text, kinds[k], states[at], states[at + 1], False)
            at += 1
        if ends and k == len(rows) - 1:
            more = TAIL[after]
            got = (got[0] + "I" * more, got[1] + INSERT * more, got[2] + inserted(after, more)[0])
        out.append((conv, p, i, turn, gone, role[:1], faults[k], got[0], got[1], "\n".join(got[2]) if got[2] else None))
    return pa.Table.from_batches([table_of(out, PIECES)])


ANSWER = pa.schema([("conv_id", pa.int64()), *RESULT])


def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Figures of conversations whose mended rows stream past in order."""
    current, report = (), Report()
    for batch in batches:
        out = []
        for conv, turn, gone, initial, fault, edits, cost, lines in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "gone", "initial", "fault", "edits", "cost", "lines")]):
            if conv != current or current == ():
                if current != ():
                    out.append((current, *report.result()))
                current, report = conv, Report()
            if not gone:
                report.row(turn, initial, fault)
            report.repaired(edits, cost, lines)
        yield table_of(out, ANSWER)
    if current != ():
        yield table_of([(current, *report.result())], ANSWER)


def in_pieces(rows: DataFrame) -> DataFrame:
    """Figures of conversations that may lie in several partitions.

    A piece has at most the rows of one range partition; a conversation has at most one piece a partition.  Only the digest, which is
    sequential by nature, sees all rows of a conversation in one task, and those stream.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("h", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    firsts = rows.where(~F.col("gone")).groupBy("conv_id", "h", "p").agg(F.min("i").alias("i0"))
    earlier = F.row_number().over(Window.partitionBy("conv_id", "h").orderBy("p")) > 1
    firsts = firsts.withColumn("earlier", earlier).select(
        F.col("conv_id").alias("c2"), F.col("h").alias("h2"), F.col("p").alias("p2"), "i0", "earlier"
    )
    met = F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("h") == F.col("h2")) & (F.col("p") == F.col("p2"))
    known = materialize(
        rows.join(firsts, met, "left")
        .withColumn("repeated", F.coalesce(F.col("earlier") | (F.col("i") > F.col("i0")), F.lit(False)))
        .select("conv_id", "p", "i", "turn", "role", "text", "gone", "repeated")
    )
    tables = known.groupBy("conv_id", "p").applyInArrow(piece_table, "conv_id long, p int, cost array<long>, rank array<long>")
    states = tables.groupBy("conv_id").applyInArrow(borders, sql_of(BORDERS))
    states = materialize(states).withColumnsRenamed({"conv_id": "c2", "p": "p2"})
    placed = known.join(states, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("p") == F.col("p2"))).drop("c2", "p2")
    pieces = placed.groupBy("conv_id", "p").applyInArrow(mend_piece, sql_of(PIECES))
    return (
        pieces.repartition(shuffle_partitions(spark), "conv_id").sortWithinPartitions("conv_id", "p", "i").mapInArrow(gather, sql_of(ANSWER))
    )


def repaired(conversations: DataFrame, damage: Callable[[DataFrame], DataFrame] = damaged) -> DataFrame:
    """One row per conversation: faults, cost, audit and digest of the repaired rows.

    Null texts and roles are one space, so a null text is blank and a null role can't be kept; a role without characters can't be kept either.
    Null turns come first and count nowhere in ``gaps``; null ids are one conversation.  Rows of one turn are ordered by role and text after the damage, equal
    rows are copies of each other.  Long texts stream; a task holds the rows of one conversation in its range partition.  An empty table
    gives an empty result; other columns are not read.
    """
    spark = conversations.sparkSession
    order = ["conv_id", "turn", "role", "text"]
    rows = damage(conversations)
    # the last key lets a range end between equal rows
    placed = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(
        shuffle_partitions(spark), *[F.col(c).asc_nulls_first() for c in order], "tie"
    )
    placed = placed.withColumn("p", F.spark_partition_id()).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
    found = materialize(placed.drop("tie").mapInArrow(first_pass, sql_of(FIRST_PASS)))
    whole = found.where(F.col("i").isNull()).select(*COLUMNS)
    return whole.unionByName(in_pieces(found.where(F.col("i").isNotNull()).drop(*[n for n, _ in RESULT])))
