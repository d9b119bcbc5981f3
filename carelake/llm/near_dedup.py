"""MinHash near-duplicate groups: circulant signatures, banding, exact Jaccard verification.

Signatures use two permutations of the 32-bit numbers: the first scatters the shingle hashes, the second is circularly
shifted by k for coordinate k, so that all coordinates come from the two (bijective mixing functions stand for the
tables). Texts with the same shingle set count as one from then on.

1. Texts that share a band are candidates if four-bit sketches of their signatures agree in enough coordinates; a bucket
   is compared in blocks of pairs, so no task holds a large one. Candidates form clusters.
2. The texts of a cluster meet in blocks, and links are confirmed on the full shingle sets: a search walks from text to
   linked text and drops what it has reached, so a group of copies costs about its size and no pairs are listed.
3. A cluster of several blocks: a text of which over a quarter of the shingles are in no other text of the cluster can have no
   link, and goes (so do texts made from one template). The best-linked texts of each block are compared with each other in a tree.
   Then every text outside the largest component found visits all blocks of its cluster, which makes the result complete.

With 30 bands of 4 coordinates a pair at a similarity of 0.75 shares no band with a probability of 1.1e-5.

Defined results: no text or no words is an empty set, linked with nothing; fewer than five words are one shingle; a row
without an id is linked with nothing and kept; rows that repeat an id are one vertex; ties go to the smallest id.
Shingles are compared by 64-bit hashes, whole sets that are equal by 128-bit sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.llm.components import connected_components
from carelake.llm.textbytes import SPACED, mix64, shards, words_of
from carelake.session import materialize

SHINGLE, BANDS, ROWS = 5, 30, 4
K = BANDS * ROWS
#: Coordinates in which sketches must agree: 0.75 + 0.25/16 of 120 is 92 with a standard deviation of 4.6.
AGREE = 66
#: Members of a block of a bucket, texts and shingles of a block of a cluster, and its texts that go up the tree.
BUCKET_BLOCK, TEXT_BLOCK, SHINGLE_BLOCK, FAN, PICKED = 2048, 1024, 400_000, 32, 32
_PLACE = mix64(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)
_SIG = "doc_id long, n_shingles long, f1 long, f2 long, sketch binary, bands array<long>"


def _permute(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place."""
    t = x >> np.uint32(16)
    x ^= t
    x *= np.uint32(a)
    np.right_shift(x, np.uint32(13), out=t)
    x ^= t
    x *= np.uint32(b)
    np.right_shift(x, np.uint32(16), out=t)
    x ^= t
    return x


def signature(shingles: np.ndarray, k: int = K) -> np.ndarray:
    """Circulant MinHash of one non-empty set of 64-bit hashes."""
    first = _permute((shingles ^ (shingles >> np.uint64(32))).astype(np.uint32), 0x85EBCA6B, 0xC2B2AE35)
    best, shift = np.full(k, 0xFFFFFFFF, np.uint32), np.arange(k, dtype=np.uint32)[:, None]
    for at in range(0, len(first), 512):
        moved = _permute(first[None, at : at + 512] - shift, 0x7FEB352D | 1, 0x846CA68B)
        np.minimum(best, moved.min(axis=1), out=best)
    return best


def sketch(sig: np.ndarray) -> np.ndarray:
    """Four bits of each coordinate as four planes of 128 bits."""
    bits = np.zeros((4, 128), np.uint8)
    for j in range(4):
        bits[j, : len(sig)] = (sig >> np.uint32(j)) & np.uint32(1)
    return np.packbits(bits, axis=1).reshape(-1)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = words_of(texts, SPACED)
    h = words.hashes()
    cut = np.concatenate(([0], np.cumsum(words.counts)))
    every = np.zeros(len(h), np.uint64)
    n = len(h) - SHINGLE + 1
    if n > 0:
        for j in range(SHINGLE):
            every[:n] += h[j : j + n] * _PLACE[j]
        every = mix64(every)
    out = []
    for a, b in zip(cut, cut[1:], strict=False):
        if b - a >= SHINGLE:
            out.append(np.unique(every[a : b - SHINGLE + 1]))
        else:  # the whole sequence, if there is one
            out.append(mix64(np.array([(h[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64)], np.uint64)) if b > a else h[:0])
    return out


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    band_no = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))
    for batch in batches:
        for part in shards(batch, "text", 1 << 20):
            known = part.column("doc_id").is_valid().to_pylist()
            rows: list[tuple] = []
            for has_id, s in zip(known, shingle_sets(part.column("text")), strict=True):
                if not len(s) or not has_id:
                    rows.append((len(s), None, None, None, None))
                    continue
                sig = signature(s)
                grid = sig.reshape(BANDS, ROWS).astype(np.uint64)
                keys = band_no.copy()
                for j in range(ROWS):
                    keys = mix64(keys + grid[:, j] * _PLACE[j])
                sums = [int(mix64(s ^ np.uint64(c)).sum(dtype=np.uint64).astype(np.int64)) for c in (0x51ED270B, 0xA5A5A5A5A5A5)]
                rows.append((len(s), *sums, sketch(sig).tobytes(), keys.astype(np.int64)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *cols], names=["doc_id", "n_shingles", "f1", "f2", "sketch", "bands"])


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The runs of equal keys of a sorted partition, whole."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            now = tuple(c[a] for c in cols)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether each pair of sketches agrees in at least AGREE coordinates."""
    out = np.empty((len(x), len(y)), bool)
    for at in range(0, len(x), 64):
        differ = np.zeros((len(x[at : at + 64]), len(y)), np.uint8)
        for half in range(2):
            d = np.zeros((len(x[at : at + 64]), len(y)), np.uint64)
            for plane in range(4):
                d |= x[at : at + 64, None, 2 * plane + half] ^ y[None, :, 2 * plane + half]
            differ += np.bitwise_count(d)
        out[at : at + 64] = K - differ.astype(np.int16) >= AGREE
    return out


def _spanning(near: np.ndarray, rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
    """A root for each of n nodes, from a matrix of links between two lists of nodes."""
    at = np.flatnonzero(near.any(axis=1))
    root = np.arange(n)
    for i in at:
        linked = np.append(cols[np.flatnonzero(near[i])], rows[i])
        roots = np.unique(root[linked])
        if len(roots) > 1:
            root[np.isin(root, roots[1:])] = roots[0]
    return root


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links between the agreeing members of each pair of blocks of a bucket."""
    a, b, held = [], [], 0
    for group in _groups(batches, ("key", "lo", "hi")):
        ids = group["id"].to_numpy()
        planes = np.frombuffer(b"".join(group["sketch"].to_pylist()), np.uint64).reshape(len(ids), 8)
        if group["lo"][0].as_py() == group["hi"][0].as_py():
            rows = cols = np.arange(len(ids))
        else:
            own = group["block"].to_numpy() == group["lo"][0].as_py()
            rows, cols = np.flatnonzero(own), np.flatnonzero(~own)
        if len(rows) and len(cols):
            root = _spanning(_agreeing(planes[rows], planes[cols]), rows, cols, len(ids))
            at = np.flatnonzero(root != np.arange(len(ids)))
            a.append(ids[at])
            b.append(ids[root[at]])
            held += len(at)
        if held > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
            a, b, held = [], [], 0
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


class _Postings:
    """Which of the remaining texts hold each shingle."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        _, self.ids = np.unique(every, return_inverse=True)
        self.cut = np.concatenate(([0], np.cumsum(self.size)))
        self.n_ids = int(self.ids.max()) + 1 if len(self.ids) else 0
        self.keep(np.ones(len(sets), bool))

    def keep(self, open_: np.ndarray) -> None:
        owner = np.repeat(np.arange(len(self.size)), self.size)
        held = open_[owner]
        ids = self.ids[held]
        turn = np.argsort(ids, kind="stable")
        self.owner = owner[held][turn]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(ids, minlength=self.n_ids))))

    def linked(self, x: int) -> np.ndarray:
        """Remaining texts whose set has 75 % or more in common with that of x, confirmed on the full sets."""
        ids = self.ids[self.cut[x] : self.cut[x + 1]]
        a, n = self.first[ids], self.first[ids + 1] - self.first[ids]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
        both = np.bincount(self.owner[at], minlength=len(self.size))
        return np.flatnonzero((both > 0) & (100 * both >= 75 * (self.size[x] + self.size - both)))


def linked_components(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The first text of each text's component, and how many texts a step of the search reached from it."""
    n = len(sets)
    root, reach = np.full(n, -1), np.zeros(n, np.int64)
    posts, left, packed = _Postings(sets), n, n
    for start in range(n):
        if root[start] >= 0:
            continue
        root[start], queue = start, [start]
        left -= 1
        while queue and left:
            x = queue.pop()
            new = posts.linked(x)
            new = new[root[new] < 0]
            root[new] = start
            reach[x] = len(new)
            queue.extend(new.tolist())
            left -= len(new)
            if left < packed // 2:
                posts.keep(root < 0)
                packed = left
    return root, reach


_FOUND = "cluster long, block long, blocks long, id long, root long, pick int"


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every text of a block its component's smallest id; ``pick`` ranks the texts that stand for the block."""
    for group in _groups(batches, ("cluster", "part")):
        ids = group["id"].to_numpy()
        sets = shingle_sets(group["text"])
        turn = np.lexsort((np.array([-len(s) for s in sets]), ids))
        ids, sets = ids[turn], [sets[i] for i in turn]
        root, reach = linked_components(sets)
        same = np.concatenate(([False], ids[1:] == ids[:-1]))
        for i in np.flatnonzero(same):  # a repeated id is one vertex
            a, b = sorted((root[i - 1], root[i]))
            root[root == b] = a
        sizes = np.bincount(root, minlength=len(ids))
        largest = np.flatnonzero(root == int(sizes.argmax()))
        pick = np.zeros(len(ids), np.int32)
        best = largest[np.argsort(-reach[largest], kind="stable")][:PICKED]
        pick[best] = np.arange(1, len(best) + 1)
        table = group.select(["cluster", "block", "blocks"]).take(pa.array(turn)).combine_chunks()
        yield from pa.Table.from_arrays(
            [*table.columns, pa.array(ids), pa.array(ids[root]), pa.array(pick)], names=["cluster", "block", "blocks", "id", "root", "pick"]
        ).to_batches()


def _visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of visiting texts to the components of a block's own texts."""
    for group in _groups(batches, ("cluster", "block")):
        guest = group["guest"].to_numpy(zero_copy_only=False)
        ids, labels, sets = group["id"].to_numpy(), group["label"].to_numpy(), shingle_sets(group["text"])
        posts = _Postings(sets)
        posts.keep(~guest)
        a, b = [], []
        for x in np.flatnonzero(guest):
            for label in np.unique(labels[posts.linked(x)]):
                if label != labels[x]:
                    a.append(ids[x])
                    b.append(label)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _shingle_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of a block hold each shingle."""
    for group in _groups(batches, ("cluster", "block")):
        values, n = np.unique(np.concatenate(shingle_sets(group["text"].combine_chunks())), return_counts=True)
        where = [np.full(len(values), group[c][0].as_py()) for c in ("cluster", "block")]
        yield pa.RecordBatch.from_arrays([*map(pa.array, where), pa.array(values.view(np.int64)), pa.array(n)], names=["cluster", "block", "shingle", "n"])


def _may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of a block that share three quarters of their shingles with other texts; the shingles of one text come before them."""
    for group in _groups(batches, ("cluster", "block")):
        own = group["id"].is_null().to_numpy()
        lone = group["shingle"].drop_null().to_numpy().view(np.uint64)
        texts = group.filter(pa.array(~own))
        sets = shingle_sets(texts["text"].combine_chunks())
        keep = [100 * int(np.isin(s, lone, assume_unique=True, invert=True).sum()) >= 75 * len(s) for s in sets]
        yield from texts.drop_columns(["shingle"]).filter(pa.array(keep, pa.bool_())).combine_chunks().to_batches()


def _linkable(many: DataFrame) -> DataFrame:
    """The texts of large clusters without those that cannot be linked. Shingles are counted in blocks before they are shuffled."""
    counts = _sorted_map(many.select("cluster", "block", "text"), ["cluster", "block"], _shingle_counts, "cluster long, block long, shingle long, n long")
    lone = counts.groupBy("cluster", "shingle").agg(F.sum("n").alias("n"), F.min("block").alias("block")).where("n = 1")
    rows = many.unionByName(lone.select("cluster", "block", "shingle"), allowMissingColumns=True)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in many.schema)
    return rows.repartition("cluster", "block").sortWithinPartitions("cluster", "block", "id").mapInArrow(_may_link, schema)


def _sorted_map(df: DataFrame, keys: list[str], run: Callable, schema: str) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _candidate_clusters(sets: DataFrame) -> DataFrame:
    """(id, cluster): sets that a chain of agreeing sketches in shared buckets connects."""
    bands = sets.select("id", F.explode("bands").alias("key"))
    full = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = bands.join(full, "key").withColumn("blocks", F.ceil(F.col("n") / BUCKET_BLOCK).cast("long"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), "blocks")).join(sets.select("id", "sketch"), "id")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "id", "sketch")
    return connected_components(_sorted_map(rows, ["key", "lo", "hi"], _bucket_links, "a long, b long")).select(F.col("node").alias("id"), F.col("label").alias("cluster"))


def _verified(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, label) for the sets that a confirmed link connects with another."""
    clusters = materialize(_candidate_clusters(sets), "clusters")
    sizes = clusters.join(sets.select("id", "n_shingles"), "id").groupBy("cluster").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    blocks = F.greatest(F.ceil(F.col("n") / TEXT_BLOCK), F.ceil(F.col("s") / SHINGLE_BLOCK)).cast("long")
    placed = clusters.join(sizes.select("cluster", blocks.alias("blocks")), "cluster").withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(placed, "id").dropDuplicates(["id", "text"])
    texts = materialize(texts.select("cluster", "block", "blocks", "id", "text"), "cluster-texts")
    if (texts.agg(F.max("blocks")).first()[0] or 1) > 1:
        texts = materialize(texts.where("blocks = 1").unionByName(_linkable(texts.where("blocks > 1"))), "linkable-texts")
    found = materialize(_sorted_map(texts.withColumn("part", F.col("block")), ["cluster", "part"], _confirm, _FOUND), "confirmed")
    single = found.where("blocks = 1").select("id", F.col("root").alias("label"))
    most = found.agg(F.max("blocks")).first()[0] or 1
    if most == 1:
        return single
    many = texts.where("blocks > 1")
    level, edges = found.where("blocks > 1"), found.where("blocks > 1").select(F.col("id").alias("a"), F.col("root").alias("b"))
    width = 1
    while width < most:  # the texts that stand for blocks meet, FAN blocks at a time
        width *= FAN
        chosen = many.join(level.where("pick > 0").select("id").distinct(), "id").withColumn("part", F.floor(F.col("block") / width).cast("long"))
        level = materialize(_sorted_map(chosen, ["cluster", "part"], _confirm, _FOUND), "tree")
        edges = edges.unionAll(level.select(F.col("id").alias("a"), F.col("root").alias("b")))
    labels = connected_components(edges).select(F.col("node").alias("id"), "label")
    known = many.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    known = materialize(known, "labelled")
    parts = known.groupBy("cluster", "label").count()
    main = parts.groupBy("cluster").agg(F.max(F.struct("count", "label")).getField("label").alias("main"), F.count("*").alias("parts")).where("parts > 1")
    rest = known.join(main, "cluster").select(*known.columns, "main")
    own = rest.select("cluster", "block", "id", "label", "text", F.lit(False).alias("guest"))
    guests = rest.where("label <> main").select("cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "id", "label", "text", F.lit(True).alias("guest"))
    more = _sorted_map(own.unionAll(guests), ["cluster", "block"], _visit, "a long, b long")
    whole = connected_components(edges.unionAll(more.unionAll(known.select(F.col("id").alias("a"), F.col("label").alias("b")))))
    return single.unionAll(whole.select(F.col("node").alias("id"), "label"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = materialize(docs.mapInArrow(_signatures, _SIG), "signatures")
    pick = F.min(F.struct("doc_id", "n_shingles", "sketch", "bands")).alias("r")
    sets = sig.where("f1 is not null").groupBy("f1", "f2").agg(pick).select("f1", "f2", F.col("r.doc_id").alias("id"), "r.n_shingles", "r.sketch", "r.bands")
    sets = materialize(sets, "sets")
    labels = materialize(_verified(docs, sets), "labels").groupBy("id").agg(F.min("label").alias("label"))
    named = sets.select("f1", "f2", "id").join(labels, "id", "left").select("f1", "f2", F.coalesce("label", "id").alias("component"))
    out = sig.select("doc_id", "n_shingles", "f1", "f2").join(named, ["f1", "f2"], "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates, with its own columns; rows without words or without an id all stay.

    Rows are compared, not ids: where an id repeats, its different texts are rows of their own. Of a group the row with the
    smallest id stays, and of several with that id the first as they were read.
    """
    rows = materialize(docs.withColumn("_near_row", F.monotonically_increasing_id()), "dedup-rows")
    known = rows.where("doc_id is not null")
    found = near_duplicates(known.select(F.col("_near_row").alias("doc_id"), "text"))
    found = found.select(F.col("doc_id").alias("_near_row"), F.col("component_id").alias("_near_group"))
    first = found.join(known.select("_near_row", F.col("doc_id").alias("_near_id")), "_near_row").groupBy("_near_group").agg(F.min(F.struct("_near_id", "_near_row")).getField("_near_row").alias("_near_row"))
    kept = known.join(first.select("_near_row"), "_near_row", "left_semi")
    return kept.unionByName(rows.where("doc_id is null")).select(*docs.columns)
