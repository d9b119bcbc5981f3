"""Near-duplicate embeddings with an inverted multi-index.

Two codebooks, one for each half of the vectors, are fitted on a bounded sample; pairs of codewords are the cells of the
grid. A query takes cells in the order of its summed distances to both codewords (the multi-sequence order) until the
target recall: the sum may exceed that of its nearest cell by a margin, which is the target quantile of that excess over
neighbours at the threshold around sampled vectors. Every vector of a visited cell is verified by its cosine in double
precision. All vectors are indexed and all are queries.

Of two cells only one visits the other, so a pair is met once at most and counted for both its ends. Vectors of different lengths
link with nothing of each other; a length with more than a block of vectors has an index of its own, the others are compared
whole. Equal vectors count as one with a multiplicity. A cell is cut into blocks of bounded size and its visitors stream past
each block, so a cell that holds a third of all vectors is many tasks. Links are counted and reduced to a spanning set
inside a block; pairs are never listed.

Defined results: vectors that are null, empty, zero or have null or non-finite components link with nothing; rows without an id
too, and they are kept; ties go to the smallest id; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.llm.components import connected_components
from carelake.session import materialize

SAMPLE, CELL, RECALL, BLOCK, CHUNK = 20_000, 400, 0.995, 2048, 4096
_OUT = "id long, n long, other long"


def unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _distances(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (x * x).sum(1)[:, None] + (words * words).sum(1)[None, :] - 2 * x @ words.T)


def codebook(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k-means on one half of the sample."""
    words = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _distances(x, words).argmin(1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(words)
        np.add.at(sums, near, x)
        words = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], words)
    return words


class MultiIndex:
    """The two codebooks and the margin of the traversal."""

    def __init__(self, sample: np.ndarray, n: int, threshold: float, recall: float = RECALL, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.half, self.threshold = sample.shape[1] // 2, threshold
        k = max(1, min(math.ceil(math.sqrt(n / CELL)), max(1, len(sample) // 8)))
        parts = sample[:, : self.half], sample[:, self.half :]
        self.words = [codebook(p, k, rng) for p in parts]
        # neighbours at the threshold, in random directions
        x = sample[rng.choice(len(sample), min(len(sample), 4000), replace=False)]
        aside = rng.normal(size=x.shape)
        aside = unit(aside - (aside * x).sum(1, keepdims=True) * x + 1e-12)
        y = threshold * x + math.sqrt(1 - threshold * threshold) * aside
        excess = self.excess(x)
        at = self.cells(y)
        need = excess[0][np.arange(len(x)), at // k] + excess[1][np.arange(len(x)), at % k]
        self.margin = float(np.quantile(need, recall)) + 1e-9

    def excess(self, x: np.ndarray) -> list[np.ndarray]:
        """By half, how much farther each codeword is than the nearest one."""
        d = [_distances(p, w) for p, w in zip((x[:, : self.half], x[:, self.half :]), self.words, strict=True)]
        return [e - e.min(1, keepdims=True) for e in d]

    def cells(self, x: np.ndarray) -> np.ndarray:
        d = [_distances(p, w).argmin(1) for p, w in zip((x[:, : self.half], x[:, self.half :]), self.words, strict=True)]
        return d[0] * len(self.words[1]) + d[1]

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, cell): of each query's multi-sequence order the cells up to the margin, nearest first."""
        a, b = self.excess(x)
        k = a.shape[1]
        query, cell, cost = [], [], []
        for i in range(len(x)):  # both lists are short: only codewords within the margin can take part
            p, q = np.flatnonzero(a[i] <= self.margin), np.flatnonzero(b[i] <= self.margin)
            total = a[i][p][:, None] + b[i][q][None, :]
            u, v = np.nonzero(total <= self.margin)
            order = np.argsort(total[u, v], kind="stable")
            query.append(np.full(len(u), i))
            cell.append((p[u] * k + q[v])[order])
            cost.append(total[u, v][order])
        return np.concatenate(query), np.concatenate(cell)


def _vectors(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _visited(own: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Whether vectors of the cell ``own`` are the ones that visit ``cell``; for two cells it is true one way round."""
    return (cell != own) & ((cell > own) == ((cell + own) % 2 == 0))


def _place(index, first: int, visiting: bool) -> Callable:
    """Members with their own cell, or visitors with the other cells of their traversal; cells are numbered from ``first``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = unit(_vectors(part.column("embedding")))
                own = index.value.cells(x)
                if visiting:
                    row, cell = index.value.visits(x)
                    goes = _visited(own[row], cell)
                    row, cell = row[goes], cell[goes]
                    part = part.take(pa.array(row))
                else:
                    cell = own
                yield pa.RecordBatch.from_arrays([pa.array(cell + first, pa.int64()), *part.columns], names=["cell", *part.schema.names])

    return run


def _roots(near: np.ndarray) -> np.ndarray:
    """The first node of each node's component in a matrix of links."""
    root = np.full(len(near), -1)
    for start in range(len(near)):
        if root[start] >= 0:
            continue
        front = np.zeros(len(near), bool)
        front[start] = True
        while front.any():
            root[front] = start
            front = near[front].any(axis=0) & (root < 0)
    return root


def _compare(threshold: float) -> Callable:
    """Sorted by cell, block and guest: a block's members come first, then its visitors in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting, members, gained = None, [], None, None

        def rows(ids, counts, others) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(others, pa.int64())], names=["id", "n", "other"])

        def settle() -> Iterator[pa.RecordBatch]:
            nonlocal members, waiting, gained
            if members is None and waiting:
                ids = np.concatenate([w[0] for w in waiting])
                x, m = np.concatenate([w[1] for w in waiting]), np.concatenate([w[2] for w in waiting])
                near = x @ x.T >= threshold
                np.fill_diagonal(near, False)
                turn = np.argsort(ids, kind="stable")
                root = ids[turn][_roots(near[np.ix_(turn, turn)])]
                back = np.empty_like(turn)
                back[turn] = np.arange(len(turn))
                members, gained = (ids, x, m, root[back]), np.zeros(len(ids), np.int64)
                yield rows(ids, near @ m, members[3])
            waiting = []

        def left() -> Iterator[pa.RecordBatch]:
            """What the visitors gave to the members."""
            if members is not None and gained.any():
                yield rows(members[0], gained, members[0])

        for batch in batches:
            if not batch.num_rows:
                continue
            cell, block = batch.column("cell").to_numpy(), batch.column("block").to_numpy()
            guest = batch.column("guest").to_numpy(zero_copy_only=False)
            ids, m, embedding = batch.column("id").to_numpy(), batch.column("m").to_numpy(), batch.column("embedding")
            change = np.flatnonzero((cell[1:] != cell[:-1]) | (block[1:] != block[:-1]) | (guest[1:] != guest[:-1])) + 1
            edges = [0, *change.tolist(), len(cell)]
            for a, b in zip(edges, edges[1:], strict=False):
                if (now := (cell[a], block[a])) != key:
                    yield from settle()
                    yield from left()
                    key, members = now, None
                x = unit(_vectors(embedding.slice(a, b - a)))
                if not guest[a]:
                    waiting.append((ids[a:b], x, m[a:b]))
                    continue
                yield from settle()
                if members is None:
                    continue  # a cell that nobody lives in
                for at in range(a, b, CHUNK):
                    to = min(b, at + CHUNK)
                    near = x[at - a : to - a] @ members[1].T >= threshold
                    gained += m[at:to] @ near
                    hit = np.flatnonzero(near.any(axis=1))
                    who, other = [], []
                    for i in hit:
                        r = np.unique(members[3][near[i]])
                        who.append(np.full(len(r), at + i))
                        other.append(r)
                    if len(hit):
                        who, other = np.concatenate(who), np.concatenate(other)
                        first = np.diff(who, prepend=-1) != 0
                        yield rows(ids[who], np.where(first, (near @ members[2])[who - at], 0), other)
        yield from settle()
        yield from left()

    return run


def fit_index(vectors: DataFrame, threshold: float, recall: float = RECALL, sample: int = SAMPLE) -> MultiIndex | None:
    """Fitted by the driver on at most ``sample`` rows (id, embedding), those with the smallest hashes."""
    n = vectors.count()
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).select("embedding").collect()
    return MultiIndex(unit(np.array([r[0] for r in rows])), n, threshold, recall) if rows else None


def embedding_links(embeddings: DataFrame, threshold: float = 0.9, recall: float = RECALL) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    kind = embeddings.schema["embedding"].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"  # single precision is shuffled as such
    every = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    whole = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v).cast("double") != float("inf")))
    usable = every.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & whole & F.exists("embedding", lambda v: v != 0.0))
    vectors = usable.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("m"))
    vectors = materialize(vectors.select("id", "m", "embedding"), "vectors")
    schema = f"cell long, id long, m long, embedding {kind}"
    size = F.size("embedding")
    lengths = {r["d"]: r["count"] for r in vectors.groupBy(size.alias("d")).count().collect()}  # one row for each length
    large = sorted(d for d, n in lengths.items() if n > BLOCK)
    # a short length is a cell without visitors, numbered below zero
    own, come, first = [vectors.where(~size.isin(large)).select((-size).cast("long").alias("cell"), "id", "m", "embedding")], [], 0
    for d in large:
        mine = vectors.where(size == d)
        index = fit_index(mine, threshold, recall)
        shared = embeddings.sparkSession.sparkContext.broadcast(index)  # two codebooks of bounded size
        own.append(mine.mapInArrow(_place(shared, first, False), schema))
        come.append(mine.mapInArrow(_place(shared, first, True), schema))
        first += len(index.words[0]) * len(index.words[1])
    members = materialize(reduce(DataFrame.unionByName, own), "members")
    visitors = reduce(DataFrame.unionByName, come) if come else members.limit(0)
    cells = members.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    home = F.pmod(F.xxhash64("id"), "blocks")
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    live = members.join(cells, "cell").withColumn("home", home).select("cell", blocks, "home", "id", "m", "embedding").withColumn("guest", F.col("block") != F.col("home"))
    live = live.where(~F.col("guest") | ((F.col("block") > F.col("home")) == ((F.col("block") + F.col("home")) % 2 == 0))).drop("home")  # as cells, blocks visit one way
    guests = visitors.join(cells, "cell").select("cell", blocks, "id", "m", "embedding", F.lit(True).alias("guest"))
    rows = live.unionByName(guests).repartition("cell", "block").sortWithinPartitions("cell", "block", "guest")
    found = materialize(rows.mapInArrow(_compare(threshold), _OUT), "links")
    labels = connected_components(found.where("id <> other").select(F.col("id").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    named = vectors.join(counts, "id", "left").join(labels.withColumnRenamed("node", "id"), "id", "left")
    named = named.select("embedding", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n"), F.coalesce("label", "id").alias("component"))
    keyed = every.withColumn("key", F.when(F.col("vec_id").isNotNull(), F.col("embedding")))
    out = keyed.join(named, keyed["key"] == named["embedding"], "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
