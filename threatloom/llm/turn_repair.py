"""Repair of a conversation's structure by the cheapest edits.

Every turn is kept (free), given another role (3), or deleted (4); turns without
text may be inserted (3); a truncated turn that stays costs 3 more.  Blank and
repeated turns must be deleted.  What results reads ``(s?(ua)+)?`` in initials of
roles: a system turn or none, then users and assistants in turn.

A path's weight is one integer.  Its high digits are the cost.  Below them every
turn has a field of two octal digits, the letters of its edits in the order of
the alphabet, filled up with zeros at the end; the last digit is an insertion
after the last turn.  Fields are free of prefixes, so weights compare like
(cost, letters), and the shortest path through the automaton's four states by
plain addition and ``min`` is the answer.  Two insertions side by side are never
cheapest: leaving both out is valid and saves 6, unless they are the only pair,
when deleting the system turn (4) is cheaper.  Long conversations are cut into
blocks of turns, solved from the end; in the block before, the last digit is the
rank of the weight with which the path goes on.

Rows are range-partitioned in order.  A conversation that lies within one
partition is repaired there.  The first and the last of each partition, and any
that outgrow ``buffer_bytes``, go on as rows: repeats are found by a grouped
minimum, plans are made from one byte a turn, and texts stream past their plan.
So a conversation that holds a third of all rows is read, sorted and searched for
faults by many tasks; only its path (a byte a turn, as the result itself has) and
its digest, which is sequential, are made in one.

Null conversation ids are one conversation; null turns come first; null roles and
texts count as one space; rows of one turn are taken by role, then text, both in
order of code points; repeated rows are repeated turns.  A role without a first
letter in ``sua`` must be changed or deleted, an empty one too.  A conversation
without any present row has zeros, an empty audit and the digest of the empty
text; an empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatloom.llm.batches import WHITE_SPACE
from threatloom.session import stored

RENAME, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
_LETTERS = " DIKR"  # the digit of each letter is its place
_D, _I, _K, _R = 1, 2, 3, 4
_NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})  # states: nothing yet, system, user, assistant
_WANTED = ("u", "u", "a", "u")  # the role that an insertion or a changed turn gets in each state
_NAMES = {"u": b"user", "a": b"assistant"}
_CLASSES = "sua"
FINE, CUT, GONE = 0, 4, 8  # a turn's kind is its fault and its place in _CLASSES, 3 for other roles

REPORT = (
    "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint,"
    " cost bigint, audit string, repaired_sha256 string"
)


@dataclass(frozen=True)
class RepairParams:
    """``block`` turns make one weight; ``buffer_bytes`` of a conversation are held by a task."""

    block: int = 256
    buffer_bytes: int = 32 << 20


def _edges(kind: int) -> list[list[tuple[int, int, int]]]:
    """For each state the (next state, cost, field) of a turn, the least for each next state."""
    fault, role = kind & ~3, kind & 3
    extra = TRUNCATED if fault == CUT else 0
    found = []
    for start in range(4):
        best: dict[int, tuple[int, int]] = {}

        def offer(state: int, cost: int, field: int) -> None:
            if state not in best or (cost, field) < best[state]:
                best[state] = (cost, field)

        inserted = _NEXT[start][_WANTED[start]]
        for state, cost, first in ((start, 0, 0), (inserted, INSERT, _I)):

            def field(letter: int) -> int:
                return first << 3 | letter if first else letter << 3

            offer(state, cost + DELETE, field(_D))
            if fault != GONE:
                if role < 3 and _CLASSES[role] in _NEXT[state]:
                    offer(_NEXT[state][_CLASSES[role]], cost + extra, field(_K))
                offer(_NEXT[state][_WANTED[state]], cost + extra + RENAME, field(_R))
        found.append([(t, c, f) for t, (c, f) in best.items()])
    return found


_EDGES = {fault + role: _edges(fault + role) for fault in (FINE, CUT, GONE) for role in range(4)}


def cheapest_edits(kinds: bytes, block: int = 256) -> tuple[int, str]:
    """Cost and letters of the least weight over turns of these kinds."""
    # state: (cost, digit) of what follows; a system turn alone can't end a conversation
    follows: list[tuple[int, int] | None] = [(0, 0), None, (INSERT, _I), (0, 0)]
    solved = []
    starts = range(0, len(kinds), block)
    for at in reversed(starts):
        part = kinds[at : at + block]
        high = 6 * len(part) + 3
        weight = [None if f is None else (f[0] << high) + f[1] for f in follows]
        place = 3
        for kind in reversed(part):
            weight = [
                min(((c << high) + (f << place) + weight[t] for t, c, f in edges if weight[t] is not None), default=None)
                for edges in _EDGES[kind]
            ]
            place += 6
        solved.append((part, weight))
        ranks = {w: r for r, w in enumerate(sorted({w for w in weight if w is not None}), 1)}
        follows = [None if w is None else (w >> high, ranks[w]) for w in weight]
    state, letters = 0, []
    for part, weight in reversed(solved):
        place, path = 6 * len(part) + 3, weight[state]
        for kind in part:
            place -= 6
            field = path >> place & 0o77
            for letter in filter(None, (field >> 3, field & 7)):
                letters.append(_LETTERS[letter])
                state = _after(state, _LETTERS[letter], kind & 3)
    if state == 2:
        letters.append("I")
    return (follows[0][0] if solved else 0), "".join(letters)


def _after(state: int, letter: str, role: int) -> int:
    if letter == "D":
        return state
    return _NEXT[state][_CLASSES[role] if letter == "K" else _WANTED[state]]


def edited(turns: Iterable[tuple[bytes, bytes]], audit: str) -> Iterator[tuple[str, bytes, bytes]]:
    """(letter, role, text) of each turn that the edits leave or insert."""
    letters, state = iter(audit), 0
    for role, text in turns:
        for letter in letters:
            if letter == "I":
                yield "I", _NAMES[_WANTED[state]], b""
            elif letter == "R":
                yield "R", _NAMES[_WANTED[state]], text
            elif letter == "K":
                yield "K", role, text
            state = _after(state, letter, kind_of(role, FINE) & 3)
            if letter != "I":
                break
    for _ in letters:
        yield "I", _NAMES[_WANTED[state]], b""
        state = _after(state, "I", 3)


def fault_of(text: bytes) -> int:
    """GONE for a text without any other character than space, CUT for one that ends in none of ``.!?``."""
    seen = text.rstrip(WHITE_SPACE)
    return GONE if not seen else FINE if seen[-1:] in (b".", b"!", b"?") else CUT


def kind_of(role: bytes, fault: int) -> int:
    place = b"sua".find(role[:1]) if role else -1
    return fault + (place if place >= 0 else 3)


class _Counts:
    """What is counted turn by turn, in order; one byte a turn is kept."""

    def __init__(self) -> None:
        self.kinds = bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.last = None

    def add(self, turn: int | None, role: bytes, fault: int, repeated: bool) -> None:
        if fault == GONE:
            self.blank += 1
        elif repeated:
            self.duplicate, fault = self.duplicate + 1, GONE
        elif fault == CUT:
            self.truncated += 1
        first = role.decode("utf-8", "replace")[:1]
        self.illegal += self.last is not None and self.last + first not in ("su", "ua", "au")
        self.last = first
        self.kinds.append(kind_of(role, fault))
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn

    def row(self, block: int) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        cost, audit = cheapest_edits(bytes(self.kinds), block)
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


class _Digest:
    """SHA-256 of ``role:text`` lines, joined by newlines."""

    def __init__(self) -> None:
        self.state, self.first = hashlib.sha256(), True

    def add(self, role: bytes, text: bytes) -> None:
        if not self.first:
            self.state.update(b"\n")
        self.first = False
        self.state.update(role + b":")
        self.state.update(text)


# ------------------------------------------------------------------ in order, where rows lie

_OPEN = (
    "part int, idx bigint, turn bigint, present boolean, role string, text string, fault int, report struct<" + REPORT.replace(" ", ":").replace(",:", ",") + ">"
)
_ROW = pa.struct([(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in (f.split()[0] for f in REPORT.split(", "))])


def _in_order(turns: DataFrame, present: Column) -> DataFrame:
    """(conv_id, turn, present, role, text), range-partitioned and sorted."""
    rows = turns.select(
        "conv_id",
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        present.alias("present"),
    )
    # bounds are sampled to the driver: only the beginning of a text may go into them
    dealt = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64))
    return dealt.sortWithinPartitions("conv_id", "turn", "role", "text")


def _first_pass(rows: DataFrame, params: RepairParams) -> DataFrame:
    """One row with a report for each closed conversation, the rows of the others as they are."""
    schema = T.StructType([rows.schema["conv_id"], *T.StructType.fromDDL(_OPEN)])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        kind = None
        key, started, is_open, held, size, idx = None, False, True, [], 0, 0
        out: list[tuple] = []
        weight = 0

        def batch() -> pa.RecordBatch:
            nonlocal out, weight
            columns = list(zip(*out, strict=True))
            types = [kind, pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.int32(), _ROW]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            arrays[5:7] = [a.cast(pa.string()) for a in arrays[5:7]]
            out, weight = [], 0
            return pa.RecordBatch.from_arrays(arrays, names=names)

        def keep(row: tuple) -> None:
            nonlocal weight
            i, turn, there, role, text = row
            out.append((key, part, i, turn, there, role, text, fault_of(text), None))
            weight += len(text) + 100

        def report() -> None:
            nonlocal weight
            counts, seen, digest = _Counts(), set(), _Digest()
            turns = [(role, text) for _, _, there, role, text in held if there]
            for _, turn, there, role, text in held:
                if there:
                    counts.add(turn, role, fault_of(text), (role, text) in seen)
                    seen.add((role, text))
            found = counts.row(params.block)
            for _, role, text in edited(turns, found[-1]):
                digest.add(role, text)
            out.append((key, part, 0, None, None, None, None, None, dict(zip(_ROW.names, (*found, digest.state.hexdigest()), strict=True))))
            weight += len(found[-1]) + 200

        for incoming in batches:
            kind = incoming.schema.field(0).type
            keys, turn, role, text, there = (
                c.cast(pa.binary()).to_pylist() if pa.types.is_string(c.type) and n else c.to_pylist()
                for n, c in enumerate(incoming.columns)
            )
            for row in zip(keys, turn, there, role, text, strict=True):
                if not started or row[0] != key:
                    if started and not is_open:
                        report()
                    is_open, held, size = not started, [], 0
                    key, started = row[0], True
                held.append((idx, *row[1:]))
                idx += 1
                size += len(row[4]) + 100
                if is_open or size > params.buffer_bytes:
                    is_open = True
                    for kept in held:
                        keep(kept)
                    held = []
                if weight > 4 << 20:
                    yield batch()
        for kept in held:
            keep(kept)
            if weight > 4 << 20:
                yield batch()
        if out:
            yield batch()

    return rows.mapInArrow(run, schema)


# ------------------------------------------------------------------ conversations over several partitions


def _by_conversation(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "idx")


def _plans(rows: DataFrame, params: RepairParams) -> DataFrame:
    """(conv_id, report without digest) of the open conversations."""
    same = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    keyed = rows.select("conv_id", "part", "idx", "turn", "present", F.substring("role", 1, 1).alias("role"), "fault", same.alias("same"))
    there = keyed.where("present")
    first = there.groupBy(F.col("conv_id").alias("c"), F.col("same").alias("s")).agg(
        F.min(F.struct("part", "idx")).alias("first")
    )
    joined = keyed.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("same") == F.col("s")), "left")
    repeated = F.col("present") & (F.struct("part", "idx") != F.col("first"))
    narrow = joined.select("conv_id", "part", "idx", "turn", "present", "role", "fault", repeated.alias("repeated"))
    schema = T.StructType([rows.schema["conv_id"], rows.schema["report"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, counts = None, None
        kind = None

        def done() -> pa.RecordBatch:
            row = dict(zip(_ROW.names, (*counts.row(params.block), None), strict=True))
            return pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([row], _ROW)], names=schema.names)

        for batch in batches:
            kind = batch.schema.field(0).type
            columns = [c.to_pylist() for c in batch.columns]
            for conv, turn, there, role, fault, again in zip(columns[0], *columns[3:], strict=True):
                if counts is None or conv != key:
                    if counts is not None:
                        yield done()
                    key, counts = conv, _Counts()
                if there:
                    counts.add(turn, role.encode(), fault, again)
        if counts is not None:
            yield done()

    return _by_conversation(narrow).mapInArrow(run, schema)


def _with_plan(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Present rows of each open conversation in order, its plan before them."""
    ahead = plans.select("conv_id", F.lit(-1).alias("part"), F.lit(-1).cast("bigint").alias("idx"), "report")
    texts = rows.where("present").select("conv_id", "part", "idx", "role", "text")
    return _by_conversation(texts.unionByName(ahead, allowMissingColumns=True).select("conv_id", "part", "idx", "role", "text", "report"))


def _edits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conversation, report, None) for each plan, then (conversation, None, edit) for each turn left or inserted."""

    def turns(first: tuple, rows: Iterator[tuple], after: list) -> Iterator[tuple[bytes, bytes]]:
        for row in rows:
            if row[5] is not None:
                after.append(row)
                return
            yield row[3].encode(), row[4].encode()

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    stream = rows()
    head = next(stream, None)
    while head is not None:
        after: list[tuple] = []
        yield head[0], head[5], None
        for edit in edited(turns(head, stream, after), head[5]["audit"]):
            yield head[0], None, edit
        head = after[0] if after else next(stream, None)


def _open_reports(rows: DataFrame, params: RepairParams) -> DataFrame:
    plans = _plans(rows, params)
    schema = plans.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, found = None, None

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                yield batch

        def done() -> pa.RecordBatch:
            key, report, digest = found
            row = {**report, "repaired_sha256": digest.state.hexdigest()}
            return pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([row], _ROW)], names=schema.names)

        for key, report, edit in _edits_of(typed()):
            if report is not None:
                if found:
                    yield done()
                found = (key, report, _Digest())
            else:
                found[2].add(edit[1], edit[2])
        if found:
            yield done()

    return _with_plan(rows, plans).mapInArrow(run, schema)


def repair_report(turns: DataFrame, present: Column | None = None, params: RepairParams = RepairParams()) -> DataFrame:
    """One row per conversation: faults, cost and letters of the cheapest edits, digest of what they leave.

    Rows where ``present`` is false only name their conversation.
    """
    rows = _in_order(turns, F.lit(True) if present is None else present)
    passed = stored(_first_pass(rows, params), "turn-repair")
    closed = passed.where("report IS NOT NULL").select("conv_id", "report")
    reports = closed.unionByName(_open_reports(passed.where("report IS NULL"), params))
    return reports.select("conv_id", "report.*")


def repaired_turns(turns: DataFrame, present: Column | None = None, params: RepairParams = RepairParams()) -> DataFrame:
    """(conv_id, position, edit, role, text) of every conversation after its cheapest edits."""
    rows = _in_order(turns, F.lit(True) if present is None else present)
    passed = stored(_first_pass(rows, replace_buffer(params)), "turn-repair")
    schema = T.StructType([passed.schema["conv_id"], *T.StructType.fromDDL("position bigint, edit string, role string, text string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, out, size, position = None, [], 0, 0

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                yield batch

        def done() -> pa.RecordBatch:
            types = (kind, pa.int64(), pa.string(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=schema.names)

        for key, report, edit in _edits_of(typed()):
            if report is not None:
                position = 0
                continue
            out.append((key, position, edit[0], edit[1].decode(), edit[2].decode()))
            position, size = position + 1, size + len(edit[2])
            if size > 4 << 20 or len(out) > 10_000:
                yield done()
                out, size = [], 0
        if out:
            yield done()

    return _with_plan(passed, _plans(passed, params)).mapInArrow(run, schema)


def replace_buffer(params: RepairParams) -> RepairParams:
    """Parameters under which no conversation is closed in the first pass."""
    return RepairParams(params.block, -1)


def damaged(turns: DataFrame) -> tuple[DataFrame, Column]:
    """Turns damaged by the remainder of crc32(``conv_id:turn``) by 20, and whether each row is still there.

    0 drops the row, 1 empties its text, 2 takes ``.!?`` out, 3 repeats it, 4 makes the user say it.
    """

    def plain(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    harm = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    rows = turns.select(
        "conv_id",
        "turn",
        F.when(harm == 4, "user").otherwise(plain("role")).alias("role"),
        F.when(harm == 1, "").when(harm == 2, F.translate(plain("text"), ".!?", "")).otherwise(plain("text")).alias("text"),
        (harm != 0).alias("there"),
        F.explode(F.array_repeat(F.lit(0), F.when(harm == 3, 2).otherwise(1))).alias("copy"),
    )
    return rows, F.col("there")
