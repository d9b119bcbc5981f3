"""Cheapest repair of the turns of a conversation, decided by one integer minimum.

A repaired conversation is empty, or an optional system turn and then pairs of a user's and an assistant's turn. Rows are kept
(K), given the other role (R) or deleted (D), and empty turns are inserted (I). A path through the rows has one scalar weight: its
cost in the high digits, and below it the letters of its edits as digits of three bits (D < I < K < R in ASCII as in number), the
first letter highest, places after the last letter zero. The weight of an edge depends on its place only, so the plain minimum of
sums over the acyclic graph of (row, insertions so far, last role) is the cheapest repair and, of those, the ASCII-least audit.
No audit is the beginning of another of the same cost, as both take every row and an insertion is not free.

Rows are dealt by ranges of (conversation, turn, role, digest of the text), so a long conversation lies in several partitions;
only digests and flags move here. Rows get ascending numbers, repeated turns are found by an aggregate of their smallest number,
and blocks of at most ``BLOCK`` rows are solved for each role they may start after, wherever they lie. A conversation's blocks,
about 20 bytes a row, are then put together: costs to the end from the last block backwards, and from the first one on the least
scalar of a block and the cost behind it. Texts move once, to the task that streams a conversation's rows through its audit;
nothing of a text is held beyond an Arrow batch. That pass is serial in a conversation because its digest is.

Defined results: rows are ordered by turn, nulls first, and rows of one turn by role, then by the SHA-256 of the text. A null text
or role is one space, so the row is blank, or has a role that must change. Rows without a conversation id are a conversation of
their own. A role counts by its first letter as it stands; an empty role has none. Repeated rows are duplicates of the first. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.session import materialize

#: Rows solved together.
BLOCK = 128
_BITS = 3
_CODE = {"D": 1, "I": 2, "K": 3, "R": 4}
_LETTER = {v: k for k, v in _CODE.items()}
# what stands before: nothing, the system turn, a user's turn, an assistant's turn
_NOTHING, _SYSTEM, _USER, _ASSISTANT = range(4)
_STATES = range(4)
_NEXT = {_NOTHING: _USER, _SYSTEM: _USER, _USER: _ASSISTANT, _ASSISTANT: _USER}
_ROLE = {_USER: "user", _ASSISTANT: "assistant"}
_BEFORE = {"s": (_NOTHING,), "u": (_NOTHING, _SYSTEM, _ASSISTANT), "a": (_USER,)}
_AFTER = {"s": _SYSTEM, "u": _USER, "a": _ASSISTANT}
_LEGAL = ("su", "ua", "au")


class Costs(NamedTuple):
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    unfinished: int = 5


class Row(NamedTuple):
    """What a repair needs to know of a row."""

    initial: str  # s, u, a, or anything else
    must_go: bool
    unfinished: bool


@lru_cache(4096)
def _moves(row: Row, state: int, costs: Costs) -> tuple[tuple[int, int, int, int], ...]:
    """(letters, their digits, cost, state afterwards) of one row: insertions before it, then its own edit.

    More insertions than lead to a state for the first time come back to where they began and are never cheapest.
    """
    out = []
    passed: list[int] = []
    while state not in passed:
        j, spent = len(passed), costs.insert * len(passed)
        inserted = sum(_CODE["I"] << _BITS * (i + 1) for i in range(j))
        out.append((j + 1, inserted + _CODE["D"], spent + costs.delete, state))
        if not row.must_go:
            more = costs.unfinished if row.unfinished else 0
            if state in _BEFORE.get(row.initial, ()):
                out.append((j + 1, inserted + _CODE["K"], spent + more, _AFTER[row.initial]))
            out.append((j + 1, inserted + _CODE["R"], spent + more + costs.rerole, _NEXT[state]))
        passed.append(state)
        state = _NEXT[state]
    return tuple(out)


def width(n_rows: int) -> int:
    """Places for the letters of n rows: each with at most two insertions before it."""
    return 3 * n_rows


@lru_cache(1 << 14)
def solve(rows: tuple[Row, ...], start: int, costs: Costs) -> dict[int, int]:
    """The least weight from the state ``start`` to every state that can be reached.

    Costs to each end come first, without letters; nodes that no cheapest path uses are then left out.
    """
    n, places = len(rows), width(len(rows))
    togo = [{e: {e: 0} for e in _STATES}]
    for row in reversed(rows):
        here: dict[int, dict[int, int]] = {}
        for s in _STATES:
            best: dict[int, int] = {}
            for _, _, c, to in _moves(row, s, costs):
                for end, rest in togo[-1][to].items():
                    if c + rest < best.get(end, c + rest + 1):
                        best[end] = c + rest
            here[s] = best
        togo.append(here)
    togo.reverse()
    goal = togo[0][start]
    nodes = {(start, 0): 0}
    for i, row in enumerate(rows):
        ahead: dict[tuple[int, int], int] = {}
        for (state, inserted), weight in nodes.items():
            cost, free = weight >> _BITS * places, places - i - inserted
            for letters, digits, c, to in _moves(row, state, costs):
                if any(cost + c + rest == goal[end] for end, rest in togo[i + 1][to].items()):
                    node = (to, inserted + letters - 1)
                    total = weight + (c << _BITS * places) + (digits << _BITS * (free - letters))
                    if total < ahead.get(node, total + 1):
                        ahead[node] = total
        nodes = ahead
    out: dict[int, int] = {}
    for (state, _), weight in nodes.items():
        out[state] = min(weight, out.get(state, weight))
    return out


def letters_of(weight: int, places: int) -> str:
    """The audit in a weight, without its padding."""
    digits = ((weight >> _BITS * p) & 7 for p in range(places - 1, -1, -1))
    return "".join(_LETTER[d] for d in digits if d)


def cost_of(weight: int, places: int) -> int:
    return weight >> _BITS * places


#: Insertions after the last row that complete a conversation.
_CLOSING = {_NOTHING: 0, _ASSISTANT: 0, _USER: 1, _SYSTEM: 2}


def join_blocks(blocks: list[tuple[int, dict[int, dict[int, int]]]], costs: Costs) -> tuple[int, str]:
    """Cost and audit of a conversation from its blocks: rows, and weights by state before and after."""
    rest = [{s: n * costs.insert for s, n in _CLOSING.items()}]
    for n, table in reversed(blocks):
        behind = rest[-1]
        rest.append({s: min((cost_of(w, width(n)) + behind[e] for e, w in ends.items() if e in behind), default=None) for s, ends in table.items()})
        rest[-1] = {s: c for s, c in rest[-1].items() if c is not None}
    rest.reverse()
    state, audit = _NOTHING, []
    for i, (n, table) in enumerate(blocks):
        shift = _BITS * width(n)
        weight, state = min((w + (rest[i + 1][e] << shift), e) for e, w in table[state].items() if e in rest[i + 1])
        audit.append(letters_of(weight & ((1 << shift) - 1), width(n)))
    return rest[0][_NOTHING], "".join(audit) + "I" * _CLOSING[state]


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with the faults that crc32 of ``conv_id:turn`` modulo 20 asks for; ``gone`` marks dropped rows."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fate, text = F.crc32(key.cast("binary")) % 20, F.coalesce("text", space)
    return conversations.select(
        "conv_id", "turn",
        F.when(fate == 4, F.lit("user")).otherwise(F.coalesce("role", space)).alias("role"),
        F.when(fate == 1, F.lit("")).when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (fate == 0).alias("gone"),
        F.explode(F.array_repeat(F.lit(0), F.when(fate == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def _clean(rows: DataFrame) -> DataFrame:
    gone = F.coalesce("gone", F.lit(False)) if "gone" in rows.columns else F.lit(False)
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"), gone.alias("gone"))


_ORDER = ("conv_id", "turn", "role", "digest")


def _numbered(rows: DataFrame) -> DataFrame:
    """Narrow rows in their order, with ascending numbers, what ails them, and whether the same role and text came earlier."""
    text = F.col("text")
    faults = {
        "initial": F.substring("role", 1, 1), "blank": ~text.rlike(r"[^\x20\x09-\x0D]"), "unfinished": ~text.rlike(r"[.!?][\x20\x09-\x0D]*\z"),
    }
    narrow = rows.withColumns(faults).select(*_ORDER, "gone", *faults)
    narrow = narrow.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).withColumn("pos", F.monotonically_increasing_id())
    narrow = materialize(narrow, "turns")
    firsts = narrow.where(~F.col("gone")).groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("pos"))
    return narrow.drop("role", "digest").join(firsts.select("pos", F.lit(True).alias("first")), "pos", "left")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000, letters: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``size`` rows that end once their texts have ``letters`` together."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= size or n >= letters:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_COUNTS = ("rows", "blank", "duplicate", "truncated", "illegal", "turns")
_BLOCK_FIELDS = (
    "pos long, " + ", ".join(f"n_{c} long" for c in _COUNTS) + ", first string, last string, low_turn long, high_turn long, "
    "weights array<struct<start: int, end: int, weight: binary>>"
)
_BLOCK_TYPES = [
    ("pos", pa.int64()), *((f"n_{c}", pa.int64()) for c in _COUNTS), ("first", pa.string()), ("last", pa.string()), ("low_turn", pa.int64()), ("high_turn", pa.int64()),
    ("weights", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("weight", pa.binary())]))),
]


def _block(rows: list[tuple], starts: tuple[int, ...], costs: Costs) -> tuple:
    """Facts and weights of consecutive rows (pos, turn, gone, initial, blank, unfinished, first) of a conversation."""
    left = [r for r in rows if not r[2]]
    kinds, n_blank, n_duplicate, n_truncated = [], 0, 0, 0
    for *_, initial, blank, unfinished, first in left:
        duplicate = not blank and not first
        truncated = unfinished and not blank and not duplicate
        n_blank, n_duplicate, n_truncated = n_blank + blank, n_duplicate + duplicate, n_truncated + truncated
        kinds.append(Row(initial if initial in _BEFORE else "", blank or duplicate, truncated))
    initials = [r[3] for r in left]
    illegal = sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:], strict=False))
    turns = [r[1] for r in left if r[1] is not None]
    weights = [
        {"start": s, "end": e, "weight": w.to_bytes((w.bit_length() + 7) // 8, "big")} for s in starts for e, w in solve(tuple(kinds), s, costs).items()
    ]
    counts = (len(left), n_blank, n_duplicate, n_truncated, illegal, len(set(turns)))
    return rows[0][0], *counts, *((initials[0], initials[-1]) if left else (None, None)), min(turns, default=None), max(turns, default=None), weights


def _solve_blocks(schema: pa.Schema, costs: Costs) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[tuple]:
            for _, rows in groupby(_rows(batches), key=lambda r: r[0]):
                for i, (conv, part) in enumerate(groupby(rows, key=lambda r: r[1])):
                    # only the first conversation of a block can have begun before it
                    yield conv, *_block([r[2:] for r in part], tuple(_STATES) if i == 0 else (_NOTHING,), costs)

        yield from _batched(blocks(), schema)

    return run


_PLAN_FIELDS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_PLAN_TYPES = [*((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())]


def _join_all(schema: pa.Schema, costs: Costs) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def plans() -> Iterator[tuple]:
            for conv, parts in groupby(_rows(batches), key=lambda r: r[0]):
                total, blocks = [0] * len(_COUNTS), []
                last, high, low = None, None, None
                for _, _, *rest in parts:
                    counts, (first, end, low_turn, high_turn, weights) = rest[: len(_COUNTS)], rest[len(_COUNTS) :]
                    if not counts[0]:
                        continue
                    total = [a + b for a, b in zip(total, counts, strict=True)]
                    total[4] += last is not None and last + first not in _LEGAL
                    last = end
                    if low_turn is not None:
                        total[5] -= high is not None and high == low_turn  # a turn that goes on in this block
                        low, high = low_turn if low is None else low, high_turn
                    table: dict[int, dict[int, int]] = {}
                    for w in weights:
                        table.setdefault(w["start"], {})[w["end"]] = int.from_bytes(w["weight"], "big")
                    blocks.append((counts[0], table))
                cost, audit = join_blocks(blocks, costs)
                yield conv, 0 if low is None else high - low + 1 - total[5], *total[1:5], cost, audit

        yield from _batched(plans(), schema)

    return run


def _id_field(rows: DataFrame) -> tuple[str, pa.DataType]:
    kind = rows.schema["conv_id"].dataType.simpleString()
    return kind, {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def repair_plans(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    ``rows`` has conv_id, turn, role, text, and may have ``gone``: such rows are no part of their conversation, but a
    conversation of such rows only has a row here.
    """
    if costs.insert <= 0:
        raise ValueError("an insertion must cost something")
    kind, arrow = _id_field(rows)
    numbered = _numbered(_clean(rows)).withColumn("block", F.floor(F.col("pos") / BLOCK))
    numbered = numbered.select("block", "conv_id", "pos", F.col("turn").cast("long"), "gone", "initial", "blank", "unfinished", F.coalesce("first", F.lit(False)).alias("first"))
    blocks = numbered.repartition("block").sortWithinPartitions("block", "pos")
    blocks = blocks.mapInArrow(_solve_blocks(pa.schema([("conv_id", arrow), *_BLOCK_TYPES]), costs), f"conv_id {kind}, {_BLOCK_FIELDS}")
    sorted_blocks = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    return sorted_blocks.mapInArrow(_join_all(pa.schema([("conv_id", arrow), *_PLAN_TYPES]), costs), f"conv_id {kind}, {_PLAN_FIELDS}")


def _repaired(rows: Iterator[tuple[str, str]], audit: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired conversation; rows are taken as the audit asks for them."""
    state = _NOTHING
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        state = _AFTER[role[0]] if letter == "K" else _NEXT[state]
        yield (role if letter == "K" else _ROLE[state]), text


def _with_plans(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Plans and rows of a conversation in one task, the plan first and the rows in their order."""
    order = ("conv_id", "is_row", "turn", "role", "digest")
    fields = [f.split()[0] for f in _PLAN_FIELDS.split(", ")]
    turns = _clean(rows).where(~F.col("gone")).select("*", F.lit(1).alias("is_row")).drop("gone")
    both = turns.unionByName(plans.select("conv_id", *fields, F.lit(0).alias("is_row")), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "is_row", "role", "text", *fields)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(id, plan, repaired turns) of every conversation; the turns are read as they are used."""
    for conv, rows in groupby(_rows(batches), key=lambda r: r[0]):
        plan = next(rows)[4:]
        yield conv, plan, _repaired(((r[2], r[3]) for r in rows), plan[-1])


def repaired_turns(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place from 0, role, text."""
    kind, arrow = _id_field(rows)
    schema = pa.schema([("conv_id", arrow), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(((conv, i, role, text) for conv, _, turns in _each(batches) for i, (role, text) in enumerate(turns)), schema)

    return _with_plans(rows, plans).mapInArrow(run, f"conv_id {kind}, place long, role string, text string")


def repair_report(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """``repair_plans`` with repaired_sha256, the digest of the repaired ``role:text`` lines joined by newlines."""
    kind, arrow = _id_field(rows)
    schema = pa.schema([("conv_id", arrow), *_PLAN_TYPES, ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def reports() -> Iterator[tuple]:
            for conv, plan, turns in _each(batches):
                digest, sep = hashlib.sha256(), ""
                for role, text in turns:
                    digest.update(f"{sep}{role}:{text}".encode())
                    sep = "\n"
                yield conv, *plan, digest.hexdigest()

        yield from _batched(reports(), schema)

    plans = materialize(repair_plans(rows, costs), "repair-plans")
    return _with_plans(rows, plans).mapInArrow(run, f"conv_id {kind}, {_PLAN_FIELDS}, repaired_sha256 string")
