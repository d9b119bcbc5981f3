"""Benchmark decontamination with suffix arrays over the training text.

Every shard of training documents gets a suffix array over its words. Every suffix of every benchmark item is looked up
in it by binary search, which gives the longest verbatim matches and where they are, and the affected documents go.

Words are compared by 21-bit codes inside the array (three codes are one sort key) and by their 64-bit hashes before a
match counts. The array is ordered to 12 words, more than the 10 of a window; a longer match is a run of matching
windows along one diagonal. Documents never share a suffix: a zero code stands between them.

Defined results: a null or wordless text has no words and no hits; a benchmark row without an id marks words but is not
listed; rows with the same id are one item; repeated documents each get their own row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.llm.textbytes import ALNUM, SHARD_BYTES, Words, shards, words_of
from carelake.session import materialize

WINDOW = 10
#: A block of the benchmark that is broadcast holds at most so many bytes of text, or a single longer item.
BLOCK_BYTES = 16 << 20
_BITS, _DEPTH = 21, 12
_LOW = np.uint64((1 << _BITS) - 1)


class Queries:
    """The distinct windows of a benchmark block, with the items that hold them.

    Windows are places in the words of the block, so a word costs 8 bytes and a window about 40. The search keys, 64 bytes a window,
    are made where they are used.
    """

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.window = window
        words = words_of(pa.array([t for _, t in items], pa.string()), ALNUM)
        self.words, counts = words.hashes(), words.counts
        first = np.concatenate(([0], np.cumsum(counts)))
        n = np.where(counts > 0, np.maximum(counts - window + 1, 1), 0)
        item = np.repeat(np.arange(len(items)), n)
        at = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
        length = np.minimum(counts[item], window)
        start = first[item] + at
        order = np.lexsort((*((self._word(start, length, j)) for j in range(window)), length))
        new = np.ones(len(order), bool)
        new[1:] = length[order[1:]] != length[order[:-1]]
        for j in range(window):
            h = self._word(start[order], length[order], j)
            new[1:] |= h[1:] != h[:-1]
        head = order[new]
        self.names = [None if i is None else str(i) for i, _ in items]
        self.start, self.length = start[head], length[head]
        self.first = np.concatenate((np.flatnonzero(new), [len(order)])).astype(np.int64)
        self.places = np.stack((item[order], at[order]), 1)

    def _word(self, start: np.ndarray, length: np.ndarray, j: int) -> np.ndarray:
        """The hash of the j-th word of each window, 0 behind its end."""
        if not len(self.words):
            return np.zeros(len(start), np.uint64)
        return np.where(j < length, self.words[np.minimum(start + j, len(self.words) - 1)], np.uint64(0))

    def word(self, which: np.ndarray, j: int) -> np.ndarray:
        return self._word(self.start[which], self.length[which], j)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """The lowest and the highest sort key of a suffix that begins with each window."""
        if not hasattr(self, "_keys"):
            codes = np.zeros((len(self.length), _DEPTH), np.uint64)
            for j in range(self.window):
                h = self._word(self.start, self.length, j)
                codes[:, j] = code(h) * (h != 0)
            low = packed(codes)
            codes[np.arange(_DEPTH)[None, :] >= self.length[:, None]] = _LOW
            self._keys = low, packed(codes)
        return self._keys


def code(hashes: np.ndarray) -> np.ndarray:
    return np.maximum(hashes & _LOW, np.uint64(1))


def packed(codes: np.ndarray) -> np.ndarray:
    """Keys of three codes each."""
    c = codes.reshape(len(codes), _DEPTH // 3, 3)
    b = np.uint64(_BITS)
    return (c[:, :, 0] << (b + b)) | (c[:, :, 1] << b) | c[:, :, 2]


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of their next 12 codes, and the key of three codes at each position."""
    n = len(codes)
    c = np.concatenate((codes, np.zeros(_DEPTH + 2, np.uint64)))
    b = np.uint64(_BITS)
    key = (c[:-2] << (b + b)) | (c[1:-1] << b) | c[2:]
    order = np.argsort(key[:n], kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    for step in range(3, _DEPTH, 3):
        tied = np.zeros(n, bool)  # only suffixes that are still equal are ordered further
        tied[1:] = ~new[1:]
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group, rest = np.cumsum(new)[at], key[order[at] + step]
        turn = np.lexsort((rest, group))
        order[at], rest = order[at][turn], rest[turn]
        new[at[1:]] |= (group[1:] == group[:-1]) & (rest[1:] != rest[:-1])
    return order, key


def bound(order: np.ndarray, key: np.ndarray, sought: np.ndarray, after: bool) -> np.ndarray:
    """Binary search of many keys at once: the first suffix not below (or, with ``after``, above) each."""
    low, high = np.zeros(len(sought), np.int64), np.full(len(sought), len(order), np.int64)
    for _ in range(int(len(order)).bit_length()):
        open_ = low < high
        mid = np.minimum((low + high) >> 1, len(order) - 1)
        at = order[mid]
        less, equal = np.zeros(len(sought), bool), np.ones(len(sought), bool)
        for j in range(sought.shape[1]):
            k = key[at + 3 * j]
            less |= equal & (k < sought[:, j])
            equal &= k == sought[:, j]
        go = open_ & (less | equal if after else less)
        low, high = np.where(go, mid + 1, low), np.where(open_ & ~go, mid, high)
    return low


def matches(words: Words, q: Queries) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, window) of every occurrence of a window in the shard."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(words.starts) or not len(q.length):
        return none
    hashes = words.hashes()
    place = np.arange(len(hashes)) + words.doc  # room for a zero after each document
    spaced = np.zeros(int(place[-1]) + 1 + q.window, np.uint64)
    spaced[place] = hashes
    codes = code(spaced) * (spaced != 0)
    order, key = suffix_array(codes)
    least, most = q.keys()
    low, high = bound(order, key, least, False), bound(order, key, most, True)
    found = high - low
    which = np.repeat(np.arange(len(found)), found)
    if not len(which):
        return none
    at = order[np.arange(len(which)) - np.repeat(np.cumsum(found) - found, found) + np.repeat(low, found)]
    ok = np.ones(len(which), bool)
    for j in range(q.window):
        ok &= (j >= q.length[which]) | (spaced[at + j] == q.word(which, j))
    back = np.zeros(len(spaced), np.int64)
    back[place] = np.arange(len(hashes))
    return back[at[ok]], which[ok]


def _grouped(rows: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n))))


def _hit_items(words: Words, first: np.ndarray, which: np.ndarray, q: Queries) -> list[list[str]]:
    """For each document the ids of the items with a window in it."""
    pairs = np.unique(words.doc[first] * max(1, len(q.length)) + which) if len(which) else np.zeros(0, np.int64)
    doc, win = pairs // max(1, len(q.length)), pairs % max(1, len(q.length))
    n = q.first[win + 1] - q.first[win]
    each = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(q.first[win], n)
    item = np.unique(np.stack((np.repeat(doc, n), q.places[each, 0]), 1), axis=0) if len(each) else np.zeros((0, 2), np.int64)
    cut = _grouped(item[:, 0], words.n_docs)
    return [sorted({x for i in item[a:b, 1] if (x := q.names[i]) is not None}) for a, b in zip(cut, cut[1:], strict=False)]


def _blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[str | None, str | None]]]:
    """The benchmark in blocks of bounded size; it streams through the driver a block at a time."""
    block: list[tuple[str | None, str | None]] = []
    size = 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).toLocalIterator():
        n = len(r["t"] or "")
        if block and size + n > limit:
            yield block
            block, size = [], 0
        block.append((r["i"], r["t"]))
        size += n
    yield block


def _scan(q, limit: int) -> Callable:
    """Marks hit words: adds to each row the hit ranges and the item ids found with this block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = q.value
        for batch in batches:
            for part in shards(batch, "text", limit):
                words = words_of(part.column(part.schema.get_field_index("text")), ALNUM)
                first, which = matches(words, queries)
                mark = np.zeros(len(words.starts) + 1, np.int64)
                np.add.at(mark, first, 1)
                np.add.at(mark, first + queries.length[which], -1)
                hit = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
                cut, base = _grouped(words.doc[hit], words.n_docs), _grouped(words.doc, words.n_docs)
                items = _hit_items(words, first, which, queries)
                old_hits, old_items = part.column("hits").to_pylist(), part.column("items").to_pylist()
                hits = []
                for i in range(words.n_docs):
                    own = (hit[cut[i] : cut[i + 1]] - base[i]).astype("<i8")
                    if old_hits[i]:
                        own = np.union1d(own, np.frombuffer(old_hits[i], "<i8"))
                    hits.append(own.tobytes())
                    if old_items[i]:
                        items[i] = sorted({*items[i], *old_items[i]})
                cols = {n: part.column(n) for n in part.schema.names}
                cols |= {"n_words": pa.array(words.counts, pa.int64()), "hits": pa.array(hits, pa.binary()), "items": pa.array(items, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays([cols[n] for n in part.schema.names], names=part.schema.names)

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents with n_words, hits (positions of hit words, 64-bit little-endian) and items (sorted ids).

    No row is shuffled. A benchmark over ``block_bytes`` is taken in blocks, one pass over the documents each.
    """
    sc = docs.sparkSession.sparkContext
    out = docs.withColumns({"n_words": F.lit(0).cast("long"), "hits": F.lit(None).cast("binary"), "items": F.lit(None).cast("array<string>")})
    for k, block in enumerate(_blocks(benchmark, block_bytes)):
        if k:
            out = materialize(out, "decontaminate")
        out = out.mapInArrow(_scan(sc.broadcast(Queries(block, window)), shard_bytes), out.schema)
    return out


def contamination_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated, and the item ids."""
    found = find_contamination(docs.select("doc_id", "text"), benchmark, **options)
    return found.select(
        "doc_id", "n_words", (F.octet_length("hits") / 8).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.octet_length("hits") > 0).alias("contaminated"), "items",
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no window of any item, with their own columns.

    Clashing columns of the input are set aside under other names while it is scanned.
    """
    names = docs.columns
    kept = docs.select(*(F.col(f"`{c}`").alias("text" if c == "text" else f"own_{i}") for i, c in enumerate(names)))
    found = find_contamination(kept, benchmark, **options).where(F.octet_length("hits") == 0)
    return found.select(*(F.col("text" if c == "text" else f"own_{i}").alias(c) for i, c in enumerate(names)))


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, doc_word, item_word, n_words): each maximal verbatim match of at least a window.

    ``doc_word`` and ``item_word`` count words from 0. The benchmark block is bounded as above.
    """
    sc = docs.sparkSession.sparkContext
    out = None
    for block in _blocks(benchmark):
        q = sc.broadcast(Queries(block, window))

        def run(batches: Iterator[pa.RecordBatch], q=q) -> Iterator[pa.RecordBatch]:
            queries = q.value
            for batch in batches:
                for part in shards(batch, "text"):
                    words = words_of(part.column("text"), ALNUM)
                    first, which = matches(words, queries)
                    n = queries.first[which + 1] - queries.first[which]
                    each = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(queries.first[which], n)
                    at, size = np.repeat(first, n), np.repeat(queries.length[which], n)
                    item, pos = queries.places[each, 0], queries.places[each, 1]
                    turn = np.lexsort((at, at - pos, item, words.doc[at]))
                    at, size, item, pos = at[turn], size[turn], item[turn], pos[turn]
                    new = np.ones(len(at), bool)  # a run goes on while document and item step together
                    new[1:] = (item[1:] != item[:-1]) | (at[1:] - pos[1:] != at[:-1] - pos[:-1]) | (at[1:] != at[:-1] + 1) | (words.doc[at[1:]] != words.doc[at[:-1]])
                    head = np.flatnonzero(new)
                    tail = np.concatenate((head[1:], [len(at)])) - 1 if len(head) else head
                    base = _grouped(words.doc, words.n_docs)
                    ids = part.column("doc_id").take(pa.array(words.doc[at[head]]))
                    yield pa.RecordBatch.from_arrays([
                        ids, pa.array([queries.names[i] for i in item[head]], pa.string()), pa.array(at[head] - base[words.doc[at[head]]], pa.int64()),
                        pa.array(pos[head], pa.int64()), pa.array(at[tail] + size[tail] - at[head], pa.int64()),
                    ], names=["doc_id", "item_id", "doc_word", "item_word", "n_words"])

        kind = docs.schema["doc_id"].dataType.simpleString()
        part = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, item_id string, doc_word long, item_word long, n_words long")
        out = part if out is None else out.unionByName(part)
    return out


