"""Forests of unbounded trees and second-order boosting on binned columns.

Columns are cut into at most 256 bins once. Upper levels of a tree are grown from histograms that Spark adds up over all rows;
once the rows of a node fit a task, they are dealt by node and the subtree is completed there. A split depends on the rows of its node only
(bootstrap counts and the columns tried are hashes of the row and of the node's path), and sums are whole numbers, so a tree
is the same wherever it was cut: ``task_rows`` only chooses the plan.

Several models grow in one pass: a ``Member`` is one tree, or one boosted sequence, with its own settings, and with the fold that it must not
see. Cross-validation therefore bins, reads and deals the rows once for all folds.

Trees are rows of a written table; scoring ships them to the tasks in parts of at most ``SHIP_BYTES`` and adds the parts up.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace  # noqa: F401 - members are changed by it

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.operators.ranks import one_row
from carelake.session import materialize

TASK_ROWS = 1_000_000
BINS = 256
SHIP_BYTES = 64 << 20
#: Steps of gradients: sums of so many rows as 2**53 / 2**GRAIN are exact in any order.
GRAIN = 24
#: Rounds of boosting between two writes of the margins, when the rows do not fit a task.
ROUNDS_PER_WRITE = 10
#: Rows that are packed and summed together, and rows that a part of the table of blocks holds.
BLOCK_ROWS, PART_ROWS = 1 << 16, 1 << 20


@dataclass(frozen=True)
class Member:
    """One tree of a forest, or one boosted sequence (``rounds`` > 0)."""

    model: str
    seed: int = 0
    without: int = -1  # the fold that is left out
    bootstrap: bool = False
    columns: int | None = None  # tried at a node; more only if none of them can be cut
    max_depth: int = 1 << 30
    min_split: int = 2
    min_leaf: int = 1
    rounds: int = 0
    rate: float = 0.1
    l2: float = 0.0
    min_weight: float = 0.0
    curved_gain: bool = True  # gains by second derivatives, otherwise by row counts


def forest_members(model: str, trees: int, seed: int, columns: int, folds: Sequence[int] = (-1,), **settings) -> list[Member]:
    return [Member(model, seed * 1_000_003 + t, f, True, columns, **settings) for f in folds for t in range(trees)]


# ---- bins -----------------------------------------------------------------------------------


def cut_points(df: DataFrame, features: Sequence[str]) -> list[np.ndarray]:
    """Ascending cuts of each column: between all its values if they are few, otherwise at its quantiles."""
    few = one_row(df.agg(*[F.approx_count_distinct(c, 0.02).alias(f"n{i}") for i, c in enumerate(features)]))
    share = [k / BINS for k in range(1, BINS)]
    values = [
        F.sort_array(F.collect_set(c)) if few[f"n{i}"] <= BINS * 7 // 8 else F.percentile_approx(c, F.lit(share), F.lit(100_000))
        for i, c in enumerate(features)
    ]
    row = one_row(df.agg(*[v.alias(f"v{i}") for i, v in enumerate(values)]))
    found = [np.unique(np.array(row[f"v{i}"] or [], float)) for i in range(len(features))]
    return [(v[1:] + v[:-1]) / 2 if few[f"n{i}"] <= BINS * 7 // 8 else v for i, v in enumerate(found)]


def _bins(batch: pa.RecordBatch, features: Sequence[str], cuts: list[np.ndarray]) -> np.ndarray:
    """Bins of the rows of a batch; a missing value is in the first one."""
    out = np.zeros((batch.num_rows, len(features)), np.uint8)
    for j, c in enumerate(features):
        x = np.asarray(batch.column(c).to_numpy(zero_copy_only=False), float)
        out[:, j] = np.searchsorted(cuts[j], np.where(np.isnan(x), -np.inf, x), "left")
    return out


def binned(df: DataFrame, features: Sequence[str], cuts: list[np.ndarray], key: str) -> DataFrame:
    """Written blocks of rows: how many, and packed a hash of each key, the label, the fold or -1, and a byte for each column.

    A block is one row of the table, so that the many passes over it cost a row's sums and not its way to Python. A part of the table has
    at most ``PART_ROWS`` rows or was so small a file from the start.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            get = [np.asarray(batch.column(c).to_numpy(zero_copy_only=False)).astype(kind) for c, kind in (("id", np.int64), ("y", np.int32), ("fold", np.int32))]
            held.append((*get, _bins(batch, features, cuts)))
            n += batch.num_rows
            if n >= BLOCK_ROWS:
                yield _packed_block(held)
                held, n = [], 0
        if n:
            yield _packed_block(held)

    fold = F.col("fold").cast("int") if "fold" in df.columns else F.lit(-1)
    rows = df.select(F.xxhash64(key).alias("id"), F.col("label").cast("int").alias("y"), fold.alias("fold"), *features)
    blocks = materialize(rows.mapInArrow(run, _BLOCK), "binned")
    parts = math.ceil(n_rows(blocks) / PART_ROWS)
    return blocks if parts <= blocks.rdd.getNumPartitions() else materialize(blocks.repartition(parts), "binned-parts")


_BLOCK = "n int, id binary, y binary, fold binary, x binary"


def _packed_block(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    packed = [np.concatenate(v) for v in zip(*held, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([len(packed[0])], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in packed)], names=["n", "id", "y", "fold", "x"])


def n_rows(blocks: DataFrame) -> int:
    return one_row(blocks.agg(F.sum("n").alias("n")))["n"] or 0


@dataclass
class Rows:
    id: np.ndarray
    y: np.ndarray
    x: np.ndarray
    fold: np.ndarray
    margins: np.ndarray | None = None  # of every boosted member, once they are written

    @staticmethod
    def of(batch: pa.RecordBatch) -> Iterator[Rows]:
        """The blocks of a batch, read where they lie."""
        for i, n in enumerate(batch.column("n").to_pylist()):
            def get(c: str, kind: type, i=i) -> np.ndarray:
                return np.frombuffer(batch.column(c)[i].as_buffer(), kind)

            margins = get("margins", np.float64).reshape(n, -1) if "margins" in batch.schema.names else None
            yield Rows(get("id", np.int64), get("y", np.int32), get("x", np.uint8).reshape(n, -1), get("fold", np.int32), margins)


# ---- growth in a task -----------------------------------------------------------------------

_EDGES = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(16)])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bootstrap_counts(ids: np.ndarray, seed: int) -> np.ndarray:
    """How often each row is drawn, Poisson with mean 1, by a hash of row and seed."""
    mixed = _mix(ids.view(np.uint64) ^ _mix(np.array([seed + 1], np.uint64)))
    return np.searchsorted(_EDGES, (mixed >> np.uint64(11)).astype(float) / (1 << 53), "right").astype(np.int64)


def _tried(nodes: np.ndarray, n_columns: int, seed: int) -> np.ndarray:
    """For each node all columns in the order they are tried."""
    at = np.arange(1, n_columns + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return np.argsort(_mix((nodes ^ _mix(np.array([seed + 7], np.uint64)))[:, None] + at[None, :]), axis=1, kind="stable")


def _child(nodes: np.ndarray, right: int) -> np.ndarray:
    return _mix(nodes * np.uint64(2) + np.uint64(right + 1))


def _gain(left: tuple, whole: tuple, member: Member) -> np.ndarray:
    """What a cut is worth, for sums (weight, first, second) on its left and over the node."""
    if member.rounds:
        def worth(w, g, h):
            return g * g / np.maximum(h + member.l2 if member.curved_gain else w + member.l2, 1e-300)
    else:
        def worth(w, s, _):
            return (s * s + (w - s) * (w - s)) / np.maximum(w, 1e-300)
    right = tuple(a - b for a, b in zip(whole, left, strict=True))
    return worth(*left) + worth(*right) - worth(*whole)


#: A weighted label is added to its weight in steps of this size, so that both are summed at once.
_LABEL = float(1 << 26)


def _packed(sums: Sequence[np.ndarray], member: Member) -> list[np.ndarray | None]:
    """The sums that need a pass of their own: a row counts once, a boosted row weighs 1, and weight and label of a forest go together."""
    if member.rounds:
        return [None, None, *sums[2:]]
    return [None, sums[1] + _LABEL * sums[2], None, None] if sums[1].sum() < _LABEL else list(sums)


def _totals(key: np.ndarray, sums: Sequence[np.ndarray | None], size: int) -> list[np.ndarray]:
    """Rows, weight, first and second sum of each key, as float numbers."""
    _, weight, first, second = sums
    n = np.bincount(key, minlength=size).astype(float)
    if first is None:  # whole numbers, so nothing is lost by adding them up together
        both = np.bincount(key, weight, size)
        label = np.floor(both / _LABEL)
        return [n, both - label * _LABEL, label, np.zeros(size)]
    return [n, n if weight is None else np.bincount(key, weight, size), np.bincount(key, first, size), np.bincount(key, second, size)]


def _best_bins(some: np.ndarray, sums: Sequence[np.ndarray], n_nodes: int, member: Member) -> tuple[np.ndarray, np.ndarray]:
    """Best cut of one column for each node: gain (minus infinity if none) and bin.

    ``some`` are the cells (node * ``BINS`` + bin) that hold rows, ascending, ``sums`` what they hold: rows, weight, first, second.
    """
    node = some // BINS
    start = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    size = np.diff(np.append(start, len(node)))
    left, whole = [], []
    for s in sums:
        run = np.cumsum(s)
        last = run[np.append(start[1:], len(node)) - 1]
        before = np.append(0.0, last[:-1])
        left.append(run - np.repeat(before, size))
        whole.append(np.repeat(last - before, size))
    allowed = (left[0] >= member.min_leaf) & (whole[0] - left[0] >= member.min_leaf)
    if member.min_weight:
        allowed &= (left[3] >= member.min_weight) & (whole[3] - left[3] >= member.min_weight)
    gain = np.where(allowed, _gain(tuple(left[1:]), tuple(whole[1:]), member), -np.inf)
    top = np.maximum.reduceat(gain, start)
    first = np.minimum.reduceat(np.where(gain == np.repeat(top, size), np.arange(len(node)), len(node)), start)
    out_gain, out_bin = np.full(n_nodes, -np.inf), np.zeros(n_nodes, np.int64)
    out_gain[node[start]], out_bin[node[start]] = top, some[first] % BINS
    return out_gain, out_bin


def _cuts_of(at: np.ndarray, bins: np.ndarray, sums: Sequence[np.ndarray | None], n_nodes: int, member: Member) -> tuple[np.ndarray, np.ndarray]:
    """Best cut of one column for each node, gain and bin, over rows in nodes ``at`` and ``bins``."""
    key = at * BINS + bins
    if n_nodes * BINS <= 16 * len(key):
        total = _totals(key, sums, n_nodes * BINS)
        some = np.flatnonzero(total[0])
        return _best_bins(some, [t[some] for t in total], n_nodes, member)
    # few rows in many cells: those that hold rows are numbered first
    order = np.argsort(key)
    key = key[order]
    first = np.append(True, key[1:] != key[:-1])
    some = key[first]
    return _best_bins(some, _totals(np.cumsum(first) - 1, [None if s is None else s[order] for s in sums], len(some)), n_nodes, member)


def _value(whole: Sequence[np.ndarray], member: Member) -> np.ndarray:
    w, first, second = whole
    if member.rounds:
        return -member.rate * first / np.maximum(second + member.l2, 1e-12)
    return first / np.maximum(w, 1e-300)


#: Of a tree: column (-1 for a leaf), last bin on the left, place of the left child (the right one follows), value.
NODE = np.dtype([("column", "i1"), ("bin", "u1"), ("left", "<i4"), ("value", "<f4")])


def grow(x: np.ndarray, sums: Sequence[np.ndarray], root: int, depth: int, member: Member) -> tuple[np.ndarray, np.ndarray]:
    """A subtree of the node with the number ``root`` over its rows, and the gains of the columns.

    ``sums`` holds for each row 1, its weight, and the first and second quantity that leaves and gains are made of: the weighted
    label (forests) or the gradient and its derivative (boosting). All nodes of a level are cut together.
    """
    n_columns = x.shape[1]
    columns = min(member.columns or n_columns, n_columns)
    nodes, out, gains = np.array([root], np.uint64), [], np.zeros(n_columns)
    at, sums = np.zeros(len(x), np.int64), _packed(sums, member)
    placed = 1
    while len(nodes):
        k = len(nodes)
        whole = _totals(at, sums, k)
        level = np.zeros(k, NODE)
        level["column"], level["value"] = -1, _value(whole[1:], member)
        open_ = whole[0] >= member.min_split
        if depth >= member.max_depth:
            open_[:] = False
        elif not member.rounds:
            open_ &= (whole[2] > 0) & (whole[2] < whole[1])
        if not open_.any():
            out.append(level)
            break
        best, cut, column = np.full(k, -np.inf), np.zeros(k, np.int64), np.full(k, -1)
        order = _tried(nodes, n_columns, member.seed)
        # rows of the nodes that are tried, their places in x, nodes among the tried ones, and sums
        few, rows, where, mine = _inside(open_, at, np.arange(len(x)), sums)
        flat, start = x.reshape(-1), rows * n_columns
        if columns == n_columns:  # every node tries every column; of equal gains the first in its order counts
            each = [_cuts_of(where, x[:, c] if len(rows) == len(x) else x[rows, c], mine, len(few), member) for c in range(n_columns)]
            gain, b = (np.take_along_axis(np.stack(v, 1), order[few], 1) for v in zip(*each, strict=True))
            top = gain.argmax(1)[:, None]
            best[few], cut[few] = np.take_along_axis(gain, top, 1)[:, 0], np.take_along_axis(b, top, 1)[:, 0]
            column[few] = np.where(best[few] > -np.inf, np.take_along_axis(order[few], top, 1)[:, 0], -1)
        for place in range(0 if columns == n_columns else n_columns):
            if place >= columns:  # only nodes without any cut so far look further
                none = best[few] == -np.inf
                if not none.any():
                    break
                if not none.all():
                    kept, rows, where, mine = _inside(none, where, rows, mine)
                    few, start = few[kept], rows * n_columns
            c = order[few, place]
            gain, b = _cuts_of(where, flat[start + c[where]], mine, len(few), member)
            better = gain > best[few]
            best[few[better]], cut[few[better]], column[few[better]] = gain[better], b[better], c[better]
        split = best > (1e-9 if member.rounds else -np.inf)
        np.add.at(gains, column[split], best[split])
        number = np.cumsum(split) - 1
        level["column"][split], level["bin"][split] = column[split], cut[split]
        level["left"][split] = placed + 2 * number[split]
        placed += 2 * int(split.sum())
        out.append(level)
        if not split.all():
            keep = split[at]
            x, at, sums = x[keep], at[keep], [None if s is None else s[keep] for s in sums]
        right = x.reshape(-1)[np.arange(len(x)) * n_columns + column[at]] > cut[at]
        at = 2 * number[at] + right
        children = np.empty(2 * int(split.sum()), np.uint64)
        children[0::2], children[1::2] = _child(nodes[split], 0), _child(nodes[split], 1)
        nodes, depth = children, depth + 1
    return np.concatenate(out), gains


def _inside(wanted: np.ndarray, at: np.ndarray, rows: np.ndarray, sums: Sequence[np.ndarray | None]) -> tuple:
    """The wanted nodes, and of their rows the places, the nodes numbered among the wanted ones, and the sums."""
    nodes = np.flatnonzero(wanted)
    if len(nodes) == len(wanted):
        return nodes, rows, at, sums
    kept = np.flatnonzero(wanted[at])
    return nodes, rows[kept], (np.cumsum(wanted) - 1)[at[kept]], [None if s is None else s[kept] for s in sums]


def leaves(tree: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The node of the tree that each row ends in."""
    out = np.zeros(len(x), np.int64)
    if len(tree) == 1 or not len(x):
        return out
    leaf = tree["column"] < 0
    # a leaf leads to itself, so rows that have arrived may walk on with the others
    left, column, last = np.where(leaf, np.arange(len(tree)), tree["left"]), np.where(leaf, 0, tree["column"]).astype(np.int64), np.where(leaf, BINS - 1, tree["bin"]).astype(np.uint8)
    flat, rows, at = np.ascontiguousarray(x).reshape(-1), None, out.copy()
    start = np.arange(len(x)) * x.shape[1]
    while True:
        at = left[at] + (flat[start + column[at]] > last[at])
        moving = ~leaf[at]
        n = np.count_nonzero(moving)
        if n > len(at) // 2:
            continue
        if rows is None:
            rows = np.arange(len(x))
        out[rows] = at
        if not n:
            return out
        rows, at, start = rows[moving], at[moving], start[moving]


def _sums(rows: Rows, member: Member) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows that a tree of a forest sees, and their sums."""
    w = bootstrap_counts(rows.id, member.seed) if member.bootstrap else np.ones(len(rows.id), np.int64)
    seen = np.flatnonzero((w > 0) & (rows.fold != member.without if member.without >= 0 else True))
    weight = w[seen].astype(float)
    return seen, [np.ones(len(seen)), weight, weight * rows.y[seen], np.zeros(len(seen))]


def _gradients(margin: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    p = 1.0 / (1.0 + np.exp(-margin))
    return [np.ones(len(y)), np.ones(len(y)), *(np.rint(v * 2.0**GRAIN) / 2.0**GRAIN for v in (p - y, p * (1.0 - p)))]


def boost(x: np.ndarray, y: np.ndarray, member: Member) -> tuple[list[np.ndarray], float, np.ndarray]:
    """All trees of a boosted sequence over rows that fit a task, the first margin, and the gains of the columns."""
    base, trees, gains = _base(float(y.sum()), len(y)), [], np.zeros(x.shape[1])
    margin = np.full(len(y), base)
    for r in range(member.rounds):
        tree, gained = grow(x, _gradients(margin, y), r + 1, 0, member)
        margin += tree["value"][leaves(tree, x)]
        trees.append(tree)
        gains += gained
    return trees, base, gains


def _base(positive: float, n: int) -> float:
    p = min(max(positive / max(n, 1), 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


# ---- growth over all rows -------------------------------------------------------------------


def _histograms(rows: DataFrame, held, read: Callable, members: list[Member], n_columns: int, places: Callable) -> DataFrame:
    """(member, node, v) with the sums of the bins of every tried column, added up inside tasks and then by Spark.

    ``read`` yields (member, nodes, their numbers, node of each row, x, sums) for the open nodes of a member; ``places`` says
    which of the columns of a node, in the order they are tried, are summed for a member.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[list[int], np.ndarray]] = {}
        for block in (b for batch in batches for b in Rows.of(batch)):
            for m, nodes, numbers, at, x, sums in read(block, held.value):
                order, tried = _tried(numbers, n_columns, members[m].seed), places(members[m])
                flat, start, sums = x.reshape(-1), np.arange(len(x)) * n_columns, _packed(sums, members[m])
                if m not in total:
                    total[m] = nodes, np.zeros((len(nodes), len(tried), 4, BINS))
                if len(tried) == n_columns:  # every node tries every column, in an order of its own
                    base, place = at * BINS, np.argsort(order, axis=1)
                    for c in range(n_columns):
                        for j, part in enumerate(_totals(base + x[:, c], sums, len(nodes) * BINS)):
                            total[m][1][np.arange(len(nodes)), place[:, c], j] += part.reshape(len(nodes), BINS)
                    continue
                for i, place in enumerate(tried):
                    c = order[:, place]
                    parts = _totals(at * BINS + flat[start + c[at]], sums, len(nodes) * BINS)
                    for j, part in enumerate(parts):
                        total[m][1][:, i, j] += part.reshape(len(nodes), BINS)
        for m, (nodes, v) in total.items():
            for node, sums in zip(nodes, v, strict=True):
                if sums[0, 0].any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([m], pa.int32()), pa.array([node], pa.int64()), pa.array([sums.ravel()], pa.list_(pa.float64()))], names=["member", "node", "v"]
                    )

    found = rows.mapInArrow(run, "member int, node long, v array<double>")
    added = found.groupBy("member", "node").agg(Summarizer.sum(array_to_vector("v")).alias("v"))
    return added.select("member", "node", vector_to_array("v").alias("v"))


_CUT = "member int, node int, n double, value double, column int, bin int, gain double, n_left double, left double, right double, open boolean"


def _best_cuts(histograms: DataFrame, members: list[Member], n_columns: int, numbers: dict[tuple[int, int], int], places: Callable) -> dict[tuple[int, int], tuple]:
    """For each open node rows, value, column, bin, gain, rows on the left, values of both sides and whether it may be cut; one row for each node comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m, node, v in zip(*(batch.column(c).to_pylist() for c in ("member", "node", "v")), strict=True):
                member = members[m]
                tried = places(member)
                sums = np.array(v).reshape(len(tried), 4, BINS)
                whole = sums[0].sum(1)
                best, column, cut, left = -np.inf, -1, 0, np.zeros(4)
                pure = not member.rounds and not 0 < whole[2] < whole[1]
                may = bool(whole[0] >= member.min_split and not pure)
                if may:
                    order = _tried(np.array([numbers[m, node]], np.uint64), n_columns, member.seed)[0]
                    for i, place in enumerate(tried):
                        if place >= (member.columns or n_columns) and best > -np.inf:
                            break
                        full = np.flatnonzero(sums[i, 0] > 0)
                        gain, b = _best_bins(full, list(sums[i][:, full]), 1, member)
                        if gain[0] > best:
                            best, column, cut, left = gain[0], int(order[place]), int(b[0]), sums[i][:, : b[0] + 1].sum(1)
                values = [float(_value(tuple(np.array([w]) for w in part[1:]), member)[0]) for part in (whole, left, whole - left)]
                yield pa.RecordBatch.from_pylist([{
                    "member": m, "node": node, "n": float(whole[0]), "value": values[0], "column": column, "bin": cut, "gain": float(best),
                    "n_left": float(left[0]), "left": values[1], "right": values[2], "open": may,
                }], schema)

    types = {"int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    schema = pa.schema([(name, types[kind]) for name, kind in (f.split(" ") for f in _CUT.split(", "))])
    return {(r["member"], r["node"]): tuple(r)[2:] for r in histograms.mapInArrow(run, _CUT).collect()}


class _Top:
    """The upper levels of one tree, as the driver grows them. ``number`` is a node's hash, ``todo`` its subtrees left to grow."""

    def __init__(self, root: int, n_columns: int):
        self.nodes = np.zeros(1, NODE)
        self.nodes["column"] = -1
        self.numbers, self.depths, self.rows = [root], [0], [math.inf]
        self.gains = np.zeros(n_columns)

    def split(self, at: int, column: int, cut: int, gain: float, n: float, n_left: float, values: tuple[float, float]) -> tuple[int, int]:
        left = len(self.nodes)
        more = np.zeros(2, NODE)
        more["column"], more["value"] = -1, values
        self.nodes = np.concatenate([self.nodes, more])
        self.nodes[at]["column"], self.nodes[at]["bin"], self.nodes[at]["left"] = column, cut, left
        for right, rows in ((0, n_left), (1, n - n_left)):
            self.numbers.append(int(_child(np.array([self.numbers[at]], np.uint64), right)[0]))
            self.depths.append(self.depths[at] + 1)
            self.rows.append(rows)
        self.gains[column] += gain
        return left, left + 1


def _grow_tops(rows: DataFrame, members: list[Member], tops: list[_Top], open_: list[set[int]], limit: float, read_sums: Callable, n_columns: int, extra=None) -> None:
    """Cut open nodes over all rows until each has at most ``limit`` rows."""
    sc = rows.sparkSession.sparkContext
    while True:
        ask = [sorted(i for i in nodes if tops[m].rows[i] > limit and tops[m].depths[i] < members[m].max_depth) for m, nodes in enumerate(open_)]
        if not any(ask):
            return

        def cut(ask: list[list[int]], places: Callable) -> dict[tuple[int, int], tuple]:
            numbers = {(m, i): tops[m].numbers[i] for m, nodes in enumerate(ask) for i in nodes}
            held = sc.broadcast(([t.nodes for t in tops], [(nodes, np.array([numbers[m, i] for i in nodes], np.uint64)) for m, nodes in enumerate(ask)], extra))

            def read(block: Rows, shared):
                trees, wanted, more = shared
                for m, (nodes, own) in enumerate(wanted):
                    if nodes:
                        seen, sums = read_sums(block, m, more)
                        x = block.x[seen]
                        place = np.full(len(trees[m]), -1)
                        place[nodes] = np.arange(len(nodes))
                        at = place[leaves(trees[m], x)]
                        inside = at >= 0
                        if inside.all():
                            yield m, nodes, own, at, x, sums
                        elif inside.any():
                            yield m, nodes, own, at[inside], x[inside], [s[inside] for s in sums]

            return _best_cuts(_histograms(rows, held, read, members, n_columns, places), members, n_columns, numbers, places)

        found = cut(ask, lambda member: range(min(member.columns or n_columns, n_columns)))
        # nodes that none of their columns can cut look at the others
        none = [[i for i in nodes if (m, i) in found and found[m, i][-1] and found[m, i][2] < 0 and (members[m].columns or n_columns) < n_columns] for m, nodes in enumerate(ask)]
        if any(none):
            found |= cut(none, lambda member: range(member.columns or n_columns, n_columns))
        for m, nodes in enumerate(ask):
            for i in nodes:
                open_[m].discard(i)
                n, value, column, at, gain, n_left, left, right, _ = found.get((m, i), (0.0, 0.0, -1, 0, 0.0, 0.0, 0.0, 0.0, False))
                tops[m].nodes[i]["value"], tops[m].rows[i] = value, n
                if n <= limit and not members[m].rounds:
                    if n:
                        open_[m].add(i)  # it fits a task, which repeats this cut there
                elif column >= 0 and gain > (1e-9 if members[m].rounds else -math.inf):
                    open_[m].update(tops[m].split(i, column, at, gain, n, n_left, (left, right)))


_SUBTREE = "member int, node int, tree binary, gains array<double>, base double, round int"


def _yield_tree(m: int, node: int, tree: np.ndarray, gains: np.ndarray, base: float, r: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([m], pa.int32()), pa.array([node], pa.int32()), pa.array([tree.tobytes()], pa.binary()), pa.array([gains], pa.list_(pa.float64())), pa.array([base]), pa.array([r], pa.int32())],
        names=["member", "node", "tree", "gains", "base", "round"],
    )


def _dealt(rows: DataFrame, held, see: Callable, finish: Callable, tasks: int) -> DataFrame:
    """Packed rows go to one group for each (member, node); ``finish`` completes a group. Their sums are counts and labels, a byte each."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in (b for batch in batches for b in Rows.of(batch)):
            for m, nodes, slots, at, seen, sums in see(block, held.value):
                order = np.argsort(at, kind="stable")
                ends = np.searchsorted(at[order], np.arange(len(nodes) + 1))
                x, packed = block.x[seen[order]], np.stack(sums).astype(np.uint8)[:, order]
                some = [(slot, node, a, b) for node, slot, a, b in zip(nodes, slots, ends[:-1], ends[1:], strict=True) if a < b]
                if some:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([e[0] for e in some], pa.int32()), pa.array([m] * len(some), pa.int32()), pa.array([e[1] for e in some], pa.int32()),
                            pa.array([x[a:b].tobytes() for _, _, a, b in some], pa.binary()), pa.array([packed[:, a:b].tobytes() for _, _, a, b in some], pa.binary()),
                        ],
                        names=["slot", "member", "node", "x", "sums"],
                    )

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []
        for batch in batches:
            for m, node, x, sums in zip(*(batch.column(c).to_pylist() for c in ("member", "node", "x", "sums")), strict=True):
                if key is not None and (m, node) != key:
                    yield from finish(*key, parts, held.value)
                    parts = []
                key = m, node
                parts.append((x, sums))
        if key is not None:
            yield from finish(*key, parts, held.value)

    packed = rows.mapInArrow(deal, "slot int, member int, node int, x binary, sums binary")
    return packed.repartitionById(tasks, F.col("slot")).sortWithinPartitions("member", "node").mapInArrow(complete, _SUBTREE)


def _joined(parts: list[tuple[bytes, bytes]], n_columns: int, n_sums: int) -> tuple[np.ndarray, list[np.ndarray]]:
    x = np.concatenate([np.frombuffer(p, np.uint8) for p, _ in parts]).reshape(-1, n_columns)
    sums = np.concatenate([np.frombuffer(s, np.uint8).reshape(n_sums, -1) for _, s in parts], axis=1).astype(float)
    return x, list(sums)


@dataclass(frozen=True)
class Ensemble:
    """Grown members: their trees as a written table (member, node of the top, tree, gains, base, round), and the tops."""

    features: tuple[str, ...]
    cuts: list[np.ndarray]
    members: list[Member]
    trees: DataFrame
    tops: dict[int, np.ndarray]  # upper levels of the members that have some, by member
    top_gains: dict[int, np.ndarray]

    def importance(self, model: str) -> np.ndarray:
        """Share of each column in the gains of a model: of every tree first, then over its trees."""
        mine = [m for m, x in enumerate(self.members) if x.model == model]
        rows = self.trees.where(F.col("member").isin(mine)).groupBy("member").agg(*[F.sum(F.get("gains", F.lit(j))).alias(f"g{j}") for j in range(len(self.features))])
        total = {r["member"]: np.array(tuple(r)[1:]) for r in rows.collect()}  # one row for each tree
        each = [total.get(m, np.zeros(len(self.features))) + self.top_gains.get(m, 0.0) for m in mine]
        shares = [g / g.sum() for g in each if g.sum() > 0]
        return np.mean(shares, axis=0) if shares else np.zeros(len(self.features))


def _slots(groups: list[tuple[int, int]], rows: DataFrame) -> tuple[dict[tuple[int, int], int], int]:
    """Groups in turn to tasks, a few for each core or all of them one by one."""
    tasks = max(1, min(len(groups), 4 * rows.sparkSession.sparkContext.defaultParallelism))
    return {g: i % tasks for i, g in enumerate(groups)}, tasks


def grow_forests(rows: DataFrame, members: list[Member], n_columns: int, n_rows: int, task_rows: int) -> tuple[DataFrame, dict, dict]:
    tops = [_Top(1, n_columns) for _ in members]
    for t in tops:
        t.rows[0] = n_rows
    open_ = [{0} for _ in members]
    _grow_tops(rows, members, tops, open_, task_rows, lambda block, m, extra: _sums(block, members[m]), n_columns)
    # a node at the largest depth has its value from the cut above it, so its rows are not dealt if the tree has other subtrees
    grown = [{i for i in nodes if tops[m].depths[i] < members[m].max_depth} or nodes for m, nodes in enumerate(open_)]
    groups = [(m, i) for m, nodes in enumerate(grown) for i in sorted(nodes)]
    slots, tasks = _slots(groups, rows)
    numbers = {(m, i): (tops[m].numbers[i], tops[m].depths[i]) for m, i in groups}
    held = rows.sparkSession.sparkContext.broadcast(([t.nodes for t in tops], slots, numbers))

    def see(block: Rows, shared):
        trees, slots, _ = shared
        wanted: dict[int, list[int]] = {}
        for m, i in slots:
            wanted.setdefault(m, []).append(i)
        for m, nodes in wanted.items():
            seen, sums = _sums(block, members[m])
            place = np.full(len(trees[m]), len(nodes))
            place[nodes] = np.arange(len(nodes))
            yield m, nodes, [slots[m, i] for i in nodes], place[leaves(trees[m], block.x[seen])], seen, sums[1:3]

    def finish(m: int, node: int, parts, shared):
        x, (w, s) = _joined(parts, n_columns, 2)
        number, depth = shared[2][m, node]
        tree, gains = grow(x, [np.ones(len(x)), w, s, np.zeros(len(x))], number, depth, members[m])
        yield _yield_tree(m, node, tree, gains, 0.0, 0)

    table = materialize(_dealt(rows, held, see, finish, tasks), "trees")
    return table, {m: t.nodes for m, t in enumerate(tops) if len(t.nodes) > 1}, {m: t.gains for m, t in enumerate(tops)}


def _boost_in_tasks(rows: DataFrame, members: list[Member], n_columns: int) -> DataFrame:
    slots, tasks = _slots([(m, 0) for m in range(len(members))], rows)
    held = rows.sparkSession.sparkContext.broadcast(slots)

    def see(block: Rows, slots):
        for m, member in enumerate(members):
            seen = np.flatnonzero(block.fold != member.without) if member.without >= 0 else np.arange(len(block.y))
            yield m, [0], [slots[m, 0]], np.zeros(len(seen), np.int64), seen, [block.y[seen]]

    def finish(m: int, node: int, parts, _):
        x, (y,) = _joined(parts, n_columns, 1)
        trees, base, gains = boost(x, y, members[m])
        for r, tree in enumerate(trees):
            yield _yield_tree(m, 0, tree, gains if r == 0 else np.zeros(n_columns), base, r)

    return materialize(_dealt(rows, held, see, finish, tasks), "boosted")


def _boost_over_all(rows: DataFrame, members: list[Member], n_columns: int) -> DataFrame:
    """Each level of each round is one pass over the rows for all members; margins are written every few rounds."""
    spark = rows.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in (b for batch in batches for b in Rows.of(batch)):
            folds, at = np.unique(block.fold, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(folds, pa.int32()), pa.array(np.bincount(at), pa.int64()), pa.array(np.bincount(at, block.y).astype(np.int64))], names=["fold", "n", "p"])

    counts = rows.mapInArrow(count, "fold int, n long, p long").groupBy("fold").agg(F.sum("n").alias("n"), F.sum("p").alias("p")).collect()  # one row for each fold
    seen = [[c for c in counts if m.without < 0 or c["fold"] != m.without] for m in members]
    bases = [_base(float(sum(c["p"] for c in own)), sum(c["n"] for c in own)) for own in seen]
    state = rows
    recent: list[list[np.ndarray]] = [[] for _ in members]
    out = []

    def margins(block: Rows, m: int, trees) -> np.ndarray:
        first = np.full(len(block.y), bases[m]) if block.margins is None else block.margins[:, m]
        return first + sum((t["value"][leaves(t, block.x)].astype(float) for t in trees[m]), np.zeros(len(block.y)))

    def read_sums(block: Rows, m: int, trees):
        member = members[m]
        seen = np.flatnonzero(block.fold != member.without) if member.without >= 0 else np.arange(len(block.y))
        return seen, [s[seen] for s in _gradients(margins(block, m, trees), block.y)]

    for r in range(max(m.rounds for m in members)):
        live = [r < m.rounds for m in members]
        tops = [_Top(r + 1, n_columns) for _ in members]
        open_ = [{0} if x else set() for x in live]
        _grow_tops(state, members, tops, open_, 0, read_sums, n_columns, recent)
        for m, t in enumerate(tops):
            if live[m]:
                recent[m].append(t.nodes)
                out.append((m, 0, bytearray(t.nodes.tobytes()), t.gains.tolist(), bases[m], r))
        if (r + 1) % ROUNDS_PER_WRITE == 0:
            held = spark.sparkContext.broadcast(recent)

            def add(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    new = [np.stack([margins(block, m, held.value) for m in range(len(members))], 1).tobytes() for block in Rows.of(batch)]
                    yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(new, pa.binary())], names=["n", "id", "y", "fold", "x", "margins"])

            state = materialize(state.mapInArrow(add, f"{_BLOCK}, margins binary"), "margins")
            recent = [[] for _ in members]
    return materialize(spark.createDataFrame(out, _SUBTREE), "boosted")


def train(df: DataFrame, members: list[Member], features: Sequence[str], key: str, task_rows: int = TASK_ROWS) -> Ensemble:
    """Grow all members on ``df`` (key, label 0/1, features, and ``fold`` if members leave one out)."""
    cuts = cut_points(df, features)
    rows = binned(df, features, cuts, key)
    n, n_columns = n_rows(rows), len(features)
    single = [m for m, x in enumerate(members) if not x.rounds]
    boosted = [m for m, x in enumerate(members) if x.rounds]
    tables, tops, gains = [], {}, {}

    def renamed(table: DataFrame, own: list[int]) -> DataFrame:
        return table.withColumn("member", F.get(F.lit(own), F.col("member")))

    if single:
        table, t, g = grow_forests(rows, [members[m] for m in single], n_columns, n, task_rows)
        tables.append(renamed(table, single))
        tops, gains = {single[m]: x for m, x in t.items()}, {single[m]: x for m, x in g.items()}
    if boosted:
        own = [members[m] for m in boosted]
        tables.append(renamed(_boost_in_tasks(rows, own, n_columns) if n <= task_rows else _boost_over_all(rows, own, n_columns), boosted))
    trees = tables[0]
    for t in tables[1:]:
        trees = trees.unionByName(t)
    return Ensemble(tuple(features), cuts, list(members), trees, tops, gains)


def _parts(ensemble: Ensemble, mine: list[int]) -> Iterator[list]:
    """The trees of some members in parts of at most ``SHIP_BYTES``; only one part at a time is in the driver."""
    own = ensemble.trees.where(F.col("member").isin(mine))
    sizes = own.groupBy("member").agg(F.sum(F.length("tree")).alias("bytes")).orderBy("member").collect()  # one row for each member
    part, held = [], 0
    for r in [*sizes, None]:
        if part and (r is None or held + r["bytes"] > SHIP_BYTES):
            yield own.where(F.col("member").isin(part)).select("member", "node", "tree", "base", "round").collect()
            part, held = [], 0
        if r is not None:
            part.append(r["member"])
            held += r["bytes"]


def score(ensemble: Ensemble, df: DataFrame, model: str) -> DataFrame:
    """``df`` with prediction and ``p_high``; a row with a ``fold`` is scored by the members that did not see it."""
    mine = [m for m, x in enumerate(ensemble.members) if x.model == model]
    boosted = ensemble.members[mine[0]].rounds > 0
    features, cuts = ensemble.features, ensemble.cuts
    out = df.withColumn("_total", F.lit(0.0)).withColumn("_trees", F.lit(0))
    schema = out.schema
    for part in _parts(ensemble, mine):
        shipped: dict[tuple[int, int], list] = {}
        for r in part:
            shipped.setdefault((r["member"], ensemble.members[r["member"]].without), []).append((r["node"], np.frombuffer(bytes(r["tree"]), NODE), r["base"], r["round"]))
        held = df.sparkSession.sparkContext.broadcast((shipped, {m: ensemble.tops.get(m) for m in mine}))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            shipped, tops = held.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _bins(batch, features, cuts)
                total, n = (np.array(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("_total", "_trees"))
                fold = batch.column("fold").to_numpy(zero_copy_only=False) if "fold" in batch.schema.names else None
                for (m, without), trees in shipped.items():
                    rows = np.flatnonzero(fold == without) if without >= 0 and fold is not None else np.arange(len(x))
                    mine, top = x[rows], tops[m]
                    first = leaves(top, mine) if top is not None else np.zeros(len(rows), np.int64)
                    value = np.zeros(len(rows)) if top is None or trees[0][3] or boosted else top["value"][first].astype(float)
                    for node, tree, base, r in trees:
                        at = np.flatnonzero(first == node) if top is not None and not boosted else slice(None)
                        got = tree["value"][leaves(tree, mine[at])]
                        if boosted:
                            value += got + (base if r == 0 else 0.0)
                        else:
                            value[at] = got
                    total[rows] += value
                    n[rows] += 1
                columns = [pa.array(total) if c == "_total" else pa.array(n.astype(np.int32)) if c == "_trees" else batch.column(c) for c in batch.schema.names]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        out = out.mapInArrow(run, schema)
    mean = F.col("_total") / F.greatest("_trees", F.lit(1))
    p = 1 / (1 + F.exp(-mean)) if boosted else mean
    return out.select(*df.columns, (p > 0.5).cast("int").alias("prediction"), p.alias("p_high"))
