"""Exact and cell-probing top-k similarity search, result fusion and advice.

Similarities are block matrix products inside tasks; only the best k per query leave a block. A small
query set (its byte size is checked) is shipped to every task and the corpus is not shuffled. For a larger one
the corpus is shipped in parts of bounded size, if they are few, and the queries are not shuffled. Otherwise both are tiled:
corpus and queries are cut into blocks of bounded size and each pair of blocks is one task, so neither side is ever whole in one place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carelake.functions import text as tx
from carelake.functions.columns import render
from carelake.operators import risk
from carelake.plans import clinical as cfg
from carelake.session import materialize, spread

BROADCAST_BYTES = 64 * 1024 * 1024
BLOCK_ROWS = 20_000
# parts of a corpus, each of at most the bytes above, that are shipped to the tasks of the queries
SHIPPED_PARTS = 16
# queries and corpus rows that are multiplied at a time, and queries that a task holds at once
QUERY_STEP, CORPUS_STEP, HELD_QUERIES = 512, 2_048, 8_192
# corpus rows whose largest product is looked at first
LOOK = 32
# rows that fit the cells of an approximate search, and of them rows that set its number of visits
FIT_ROWS, PROBE_ROWS = 50_000, 5_000
# copies of queries, and distances to cells, that a task makes at once
PROBED_ROWS, PROBED_CELLS = 10_000, 4_000_000
ROUND_TO = {"cosine": 12, "euclidean": 9}
# below a floor, so that no hit at the floor is lost to rounding
LEAST_ROOM = 1e-9


def _given(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    chunked = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return chunked.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    return _given(column, rows).astype("float64")


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1.0, norm)


def _scores(q: np.ndarray, m: np.ndarray, metric: str) -> np.ndarray:
    """Similarity (cosine) or negative squared distance, rounded so that equal pairs tie exactly."""
    if metric == "cosine":
        s = _unit(q) @ _unit(m).T
    else:
        s = 2.0 * q @ m.T - (q * q).sum(1)[:, None] - (m * m).sum(1)[None, :]
        s = np.minimum(s, 0.0)
    return np.round(s, ROUND_TO[metric]) + 0.0


def _best(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int):
    """The k best per row index; ties go to the smaller id."""
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    first = np.r_[True, rows[1:] != rows[:-1]] if len(rows) else np.zeros(0, bool)
    place = np.arange(len(rows)) - np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))
    keep = place < k
    return rows[keep], ids[keep], scores[keep]


class _Corpus:
    """Corpus rows ready to be multiplied: as they are, and in single precision around their mean (unit length for cosines).

    Products in single precision only tell which rows cannot be among the best; ``room`` is more than their error. What is left is
    scored in double precision.
    """

    def __init__(self, m: np.ndarray, ids: np.ndarray, metric: str):
        self.m, self.ids, self.metric = m, ids, metric
        n, d = m.shape
        self.centre = m.mean(0, dtype=float) if metric != "cosine" and n else np.zeros(d)
        self.fast = np.zeros((-(-n // LOOK) * LOOK, d if metric == "cosine" else d + 1), np.float32)
        self.norm, self.longest = np.zeros(n), 0.0
        for at in range(0, n, CORPUS_STEP):
            part = m[at : at + CORPUS_STEP].astype(float)
            if metric == "cosine":
                norm = np.linalg.norm(part, axis=1)
                self.norm[at : at + CORPUS_STEP] = norm = np.where(norm == 0, 1.0, norm)
                self.fast[at : at + len(part)] = part / norm[:, None]
            else:
                self.norm[at : at + CORPUS_STEP] = (part * part).sum(1)
                part -= self.centre
                square = (part * part).sum(1)
                self.longest = max(self.longest, float(square.max(initial=0.0)))
                self.fast[at : at + len(part), :d], self.fast[at : at + len(part), d] = part, square

    def queries(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Queries for exact scores and for fast ones, what a fast score lacks of an exact one, and the room."""
        bits = (q.shape[1] + 8) * 2.0**-23
        if self.metric == "cosine":
            unit = _unit(q)
            return unit, unit.astype(np.float32), np.zeros(len(q)), np.full(len(q), bits + 1e-11)
        moved = q - self.centre
        square = (moved * moved).sum(1)
        fast = np.column_stack([2.0 * moved, np.full(len(q), -1.0)]).astype(np.float32)
        far = square + self.longest + (q * q).sum(1) * 2.0**-24 + self.norm.max(initial=0.0) * 2.0**-24
        return q, fast, square, 4.0 * bits * far + 1e-8

    def exact(self, q: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Scores of pairs of queries, as ``queries`` gave them, and rows, rounded like those of all pairs."""
        out = np.empty(len(rows))
        for at in range(0, len(rows), 1 << 16):
            r, c = rows[at : at + (1 << 16)], cols[at : at + (1 << 16)]
            a, b = q[r], self.m[c].astype(float)
            if self.metric == "cosine":
                out[at : at + len(r)] = np.einsum("nd,nd->n", a, b / self.norm[c, None])
            else:
                out[at : at + len(r)] = np.minimum(2.0 * np.einsum("nd,nd->n", a, b) - (a * a).sum(1) - self.norm[c], 0.0)
        return np.round(out, ROUND_TO[self.metric]) + 0.0


def _search(q: np.ndarray, corpus: _Corpus, k: int, least: float | None = None):
    """The k best rows of every query: query numbers, ids and scores; with ``least`` only those of at least this score."""
    parts = []
    for start in range(0, len(q), QUERY_STEP):
        own = q[start : start + QUERY_STEP].astype(float)
        exact, fast, lacks, room = corpus.queries(own)
        bar = np.full(len(own), -np.inf if least is None else least)  # what a row must reach
        best = (np.zeros(0, np.int64), corpus.ids[:0], np.zeros(0))
        for at in range(0, len(corpus.ids), CORPUS_STEP):
            s = fast @ corpus.fast[at : at + CORPUS_STEP].T
            s[:, len(corpus.ids) - at :] = -np.inf
            looks = s.reshape(len(own), LOOK, -1)
            top = looks.max(1)
            if top.shape[1] >= k and not np.isfinite(bar).all():  # so many rows are at least as good as the k-th largest
                bar = np.maximum(bar, np.partition(top, top.shape[1] - k, axis=1)[:, top.shape[1] - k] - lacks - room)
            need = bar + lacks - room
            r, look = np.nonzero(top >= need[:, None])
            which, c = np.nonzero(looks[r, :, look] >= need[r, None])
            r, c = r[which], c * top.shape[1] + look[which]
            if not len(r):
                continue
            if len(r) > s.size // 16:  # many ties, or numbers too large for single precision
                scores = _scores(own, corpus.m[at : at + CORPUS_STEP].astype(float), corpus.metric)
                cut = -np.partition(-scores, k - 1, axis=1)[:, k - 1] if scores.shape[1] > k else np.full(len(own), -np.inf)
                r, c = np.nonzero(scores >= np.maximum(cut, bar)[:, None])
                scores = scores[r, c]
            else:
                scores = corpus.exact(exact, r, c + at)
            new = (r, corpus.ids[c + at], scores)
            if least is not None:
                new = tuple(x[scores >= least] for x in new)
            best = _best(*(np.concatenate(p) for p in zip(best, new)), k)
            n = np.bincount(best[0], minlength=len(own))
            full = np.flatnonzero(n >= k)
            bar[full] = np.maximum(bar[full], best[2][np.cumsum(n)[full] - 1])
        parts.append((best[0] + start, best[1], best[2]))
    return tuple(np.concatenate(p) for p in zip(*parts)) if parts else (np.zeros(0, np.int64), corpus.ids[:0], np.zeros(0))


def _block_best(q: np.ndarray, m: np.ndarray, ids: np.ndarray, k: int, metric: str, least: float | None = None):
    return _search(q, _Corpus(m, ids, metric), k, least)


def _sides(corpus: DataFrame, queries: DataFrame, corpus_id: str, query_id: str, vector: str):
    # single-precision vectors travel as they are; tasks read them as doubles, which is exact
    exact = all(dict(df.dtypes)[vector] == "array<float>" for df in (corpus, queries))
    v = F.col(vector).cast("array<float>" if exact else "array<double>").alias("_v")
    c = corpus.select(F.col(corpus_id).alias("_id"), v).where(F.size("_v") > 0)
    q = queries.select(F.col(query_id).alias("_qid"), v).where(F.size("_v") > 0)
    return c, q


def _hits_schema(c: DataFrame, q: DataFrame) -> str:
    return f"_qid {dict(q.dtypes)['_qid']}, _id {dict(c.dtypes)['_id']}, _score double"


def _hits_batch(schema_like, qids, ids, scores) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(qids, schema_like[0]), pa.array(ids, schema_like[1]), pa.array(scores, pa.float64())], ["_qid", "_id", "_score"]
    )


def _in_batches(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches put together to at least so many rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def _shipped(c: DataFrame, q: DataFrame, k: int, metric: str, least: float | None = None) -> DataFrame:
    """Query set to every task; each task keeps a running best k over its batches."""
    collected = q.toArrow().combine_chunks()
    qids = collected.column("_qid").combine_chunks()
    shared = c.sparkSession.sparkContext.broadcast((qids, _given(collected.column("_v"), collected.num_rows)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, qm = shared.value
        best, id_type = None, None
        for batch in _in_batches(batches, CORPUS_STEP):
            id_type = batch.column(0).type
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            found = _block_best(qm, _given(batch.column(1), batch.num_rows), ids, k, metric, least)
            best = found if best is None else _best(*(np.concatenate(p) for p in zip(best, found)), k)
        if best is not None:
            rows, ids, scores = best
            yield _hits_batch((query_ids.type, id_type), query_ids.take(pa.array(rows)), ids, scores)

    return c.mapInArrow(search, _hits_schema(c, q))


def _shipped_corpus(c: DataFrame, q: DataFrame, k: int, metric: str, parts: int, least: float | None = None) -> DataFrame:
    """The corpus in parts to every task of the queries, which stay where they are; k hits of a query leave each part."""
    found = []
    for part in range(parts):
        collected = c.where(F.pmod(F.xxhash64("_id"), F.lit(parts)) == part).toArrow().combine_chunks().sort_by("_id") if parts > 1 else c.toArrow().combine_chunks().sort_by("_id")
        ids = collected.column("_id").combine_chunks()
        matrix = _given(collected.column("_v"), collected.num_rows) if collected.num_rows else np.zeros((0, 1), np.float32)
        shared = c.sparkSession.sparkContext.broadcast((ids, matrix))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, m = shared.value
            if not len(ids):
                return
            corpus = _Corpus(m, np.arange(len(ids)), metric)  # in the order of the ids, so their places break ties as well
            for batch in _in_batches(batches, HELD_QUERIES):
                rows, places, scores = _search(_given(batch.column("_v"), batch.num_rows), corpus, k, least)
                yield _hits_batch((batch.column("_qid").type, ids.type), batch.column("_qid").take(pa.array(rows)), ids.take(pa.array(places)), scores)

        found.append(q.mapInArrow(search, _hits_schema(c, q)))
    return reduce(DataFrame.unionAll, found)


def _numbers(n: Column) -> Column:
    return F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)


def _tiled(c: DataFrame, q: DataFrame, k: int, metric: str, cell: str | None = None) -> DataFrame:
    """One task per pair of bounded blocks; with ``cell`` only blocks of the same cell are paired."""
    c = c.withColumn("_cell", F.col(cell) if cell else F.lit(0))
    q = q.withColumn("_cell", F.col(cell) if cell else F.lit(0))

    def blocks(df: DataFrame) -> Column:
        # one entry per cell
        sizes = {r["_cell"]: r["count"] for r in df.groupBy("_cell").count().collect()}
        counts = [math.ceil(sizes.get(i, 1) / BLOCK_ROWS) for i in range(max(sizes, default=0) + 1)]
        return F.coalesce(F.get(F.lit(counts), F.col("_cell")), F.lit(1))

    c_blocks, q_blocks = blocks(c), blocks(q)
    left = c.select(
        "_id", "_v", "_cell", F.pmod(F.xxhash64("_id"), c_blocks).alias("_cb"),
        F.explode(_numbers(q_blocks)).alias("_qb"),
    )
    right = q.select(
        "_qid", "_v", "_cell", F.explode(_numbers(c_blocks)).alias("_cb"),
        F.pmod(F.xxhash64("_qid"), q_blocks).alias("_qb"),
    )

    def pair(a: pa.Table, b: pa.Table) -> pa.Table:
        types = (b.schema.field("_qid").type, a.schema.field("_id").type)
        if a.num_rows == 0 or b.num_rows == 0:
            return pa.Table.from_batches([_hits_batch(types, [], [], [])])
        ids = a.column("_id").combine_chunks().to_numpy(zero_copy_only=False)
        rows, found, scores = _block_best(_given(b.column("_v"), b.num_rows), _given(a.column("_v"), a.num_rows), ids, k, metric)
        qids = b.column("_qid").combine_chunks().take(pa.array(rows))
        return pa.Table.from_batches([_hits_batch(types, qids, found, scores)])

    keys = ["_cell", "_cb", "_qb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(pair, _hits_schema(c, q))


def _finish(partial: DataFrame, corpus_id: str, query_id: str, k: int, metric: str) -> DataFrame:
    best = Window.partitionBy("_qid").orderBy(F.desc("_score"), F.asc("_id"))
    ranked = partial.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    measures = (
        [(1 - F.col("_score")).alias("distance"), F.col("_score").alias("relevance")]
        if metric == "cosine"
        else [F.sqrt(-F.col("_score")).alias("distance")]
    )
    return ranked.select(F.col("_qid").alias(query_id), "rank", F.col("_id").alias(corpus_id), *measures)


def top_k(
    corpus: DataFrame, queries: DataFrame, k: int, corpus_id: str, query_id: str, vector: str = "embedding",
    metric: str = "cosine", broadcast_bytes: int = BROADCAST_BYTES, least: float | None = None, query_bytes: int | None = None,
) -> DataFrame:
    """The k nearest corpus rows of every query, ranked; ties go to the smaller id.

    With ``least`` only rows of at least this similarity (negative squared distance) are hits. ``query_bytes`` is for callers that know the
    size of queries that are not written, so that they are made once.
    """
    c, q = _sides(corpus, queries, corpus_id, query_id, vector)
    if query_bytes is None:
        query_bytes = q.agg(F.sum(F.size("_v").cast("bigint") * 8 + 64).alias("b")).first()["b"] or 0
    if 0 < query_bytes <= broadcast_bytes:
        partial = _shipped(c, q, k, metric, least)
    else:
        width = 4 if dict(c.dtypes)["_v"] == "array<float>" else 8
        size = c.agg(F.sum(F.size("_v").cast("bigint") * width + 32).alias("b")).first()["b"] or 0
        parts = max(1, math.ceil(size / broadcast_bytes)) if broadcast_bytes else SHIPPED_PARTS + 1
        if parts <= SHIPPED_PARTS:
            partial = _shipped_corpus(c, q, k, metric, parts, least)
        else:
            partial = _tiled(c, q, k, metric)
            partial = partial if least is None else partial.where(F.col("_score") >= least)
    return _finish(partial, corpus_id, query_id, k, metric)


def _probes_for(rows: np.ndarray, centers: np.ndarray, k: int, recall: float, queries: int = 200) -> int:
    """How many of its nearest cells a query must visit to find ``recall`` of its k nearest rows in a sample."""
    if not len(rows):
        return 1
    m = _unit(rows)
    d = (centers * centers).sum(1)[None, :] - 2.0 * m @ centers.T
    home, order = d.argmin(1), np.argsort(d[:queries], axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
    near = np.argsort(-(m[:queries] @ m.T), axis=1, kind="stable")[:, :k]
    return int(np.quantile(np.take_along_axis(place, home[near], axis=1), recall, method="higher")) + 1


def top_k_probed(
    corpus: DataFrame, queries: DataFrame, k: int, corpus_id: str, query_id: str, vector: str = "embedding",
    cells: int | None = None, probes: int | None = None, recall: float = 0.95, fit_rows: int = FIT_ROWS, seed: int = 42,
) -> DataFrame:
    """Approximate search: the corpus is clustered into cells and a query visits its nearest ones.

    By default the cells grow as the square root of the corpus, and as many are visited as find ``recall`` of the exact
    hits of sampled queries. Cells and visits are fitted on at most ``fit_rows`` rows, those with the smallest hashes of
    their ids; every row is indexed. Visiting every cell gives the exact result. Crowded cells are split into blocks
    like the exact search.
    """
    c, q = _sides(corpus, queries, corpus_id, query_id, vector)
    cells = cells or max(1, math.ceil(math.sqrt(c.count())))

    def unit(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        return array_to_vector(F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0))))

    clustered = c.withColumn("features", unit(F.col("_v").cast("array<double>")))
    sample = materialize(clustered.orderBy(F.xxhash64("_id"), "_id").limit(fit_rows), "search-sample")
    model = KMeans(k=cells, seed=seed, maxIter=10).fit(sample)
    centers = np.array(model.clusterCenters())
    if probes is None:
        rows = sample.select("_v").limit(PROBE_ROWS).toArrow()
        probes = _probes_for(_matrix(rows.column("_v"), rows.num_rows), centers, k, recall)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, min(PROBED_ROWS // max(1, min(probes, cells)), PROBED_CELLS // len(centers)))
        norms = (centers * centers).sum(1)[None, :]
        for batch in batches:
            for part in (batch.slice(at, step) for at in range(0, batch.num_rows, step)):
                d = norms - 2.0 * _unit(_matrix(part.column("_v"), part.num_rows)) @ centers.T
                chosen = np.argsort(d, axis=1, kind="stable")[:, :probes]
                at = np.repeat(np.arange(part.num_rows), chosen.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [part.column("_qid").take(pa.array(at)), part.column("_v").take(pa.array(at)),
                     pa.array(chosen.ravel().astype("int32"))],
                    ["_qid", "_v", "cell"],
                )

    placed = model.transform(clustered).select("_id", "_v", F.col("prediction").alias("cell"))
    probed = q.mapInArrow(nearest, f"_qid {dict(q.dtypes)['_qid']}, _v {dict(q.dtypes)['_v']}, cell int")
    return _finish(_tiled(placed, probed, k, "cosine", "cell"), corpus_id, query_id, k, "cosine")


def recall(found: DataFrame, exact: DataFrame, keys: list[str]) -> DataFrame:
    """Share of the exact hits that an approximate search found."""
    hit = exact.join(found.select(*keys).withColumn("_hit", F.lit(1)), keys, "left")
    return hit.agg(F.count("_hit").alias("found"), F.count(F.lit(1)).alias("expected")).withColumn(
        "recall", F.try_divide(F.col("found"), F.col("expected"))
    )


def relevant(hits: DataFrame, floor: float = cfg.RELEVANCE_FLOOR) -> DataFrame:
    """Applied after top-k, so fewer than k hits may remain."""
    return hits.where(F.col("relevance") >= floor)


def valid_texts(chunks: DataFrame, corpus_id: str, text: str = "text", terms: Sequence[str] = tuple(cfg.TABLE_TERMS)) -> DataFrame:
    """The repaired text of every chunk that has a usable one.

    A text is checked once; exploding the usable ones, unlike a filter, does not check it again.
    """
    usable = F.filter(F.array(tx.validate(F.col(text), terms)), lambda t: t != "")
    return chunks.select(corpus_id, text).select(corpus_id, F.explode(usable).alias("text"))


def with_valid_text(hits: DataFrame, chunks: DataFrame, corpus_id: str, text: str = "text", terms: Sequence[str] = tuple(cfg.TABLE_TERMS)) -> DataFrame:
    """Attach the repaired chunk text and drop hits without a usable one."""
    return hits.join(valid_texts(chunks, corpus_id, text, terms), corpus_id)


def _with_head(rows: DataFrame, prefix: int) -> DataFrame:
    return rows.withColumns({"head": F.unhex(F.md5(F.substring("text", 1, prefix))), "chars": F.length("text")})


def without_text(rows: DataFrame, prefix: int = cfg.DEDUP_PREFIX) -> DataFrame:
    """What fusion and advice need of a text until it is shown: the hash of its prefix as ``head``, and its length as ``chars``."""
    return _with_head(rows, prefix).drop("text")


def with_text(rows: DataFrame, texts: DataFrame, corpus_id: str, prefix: int = cfg.DEDUP_PREFIX) -> DataFrame:
    """Rows ``without_text`` with it again, also where an id has several texts."""
    keys = [corpus_id, "head", "chars"]
    return rows.join(_with_head(texts.select(corpus_id, "text"), prefix).dropDuplicates(keys), keys)


def fuse(hits: DataFrame, request: str, prefix: int = cfg.DEDUP_PREFIX, step: float = cfg.WEIGHT_STEP) -> DataFrame:
    """Merge the hits of a request's queries.

    Of hits with the same text prefix the first by (query_ord, rank) stays; the rest is ordered by weighted
    score, earlier hits first on a tie. A request has at most queries × k hits. Hits ``without_text`` are told apart by ``head``.
    """
    head = F.col("head") if "head" in hits.columns else F.substring("text", 1, prefix)
    first = Window.partitionBy(request, head).orderBy("query_ord", "rank")
    by_score = Window.partitionBy(request).orderBy(F.desc(F.round("weighted_score", 12)), "query_ord", "rank")
    return (
        # one exchange serves both windows
        hits.repartition(request).withColumn("_seen", F.row_number().over(first))
        .where("_seen = 1")
        .drop("_seen")
        .withColumn("weighted_score", F.col("relevance") * (1 + F.col("weight") * F.lit(step)))
        .withColumn("fused_rank", F.row_number().over(by_score))
    )


def advice(
    people: DataFrame, fused: DataFrame, request: str, level: Column, summary: Column, n: int = cfg.ADVICE_ITEMS,
    key: str | None = None, texts: DataFrame | None = None, corpus_id: str | None = None, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Advice text per person: banner, summary and the first n usable hits, or a fallback.

    Several people may share a ``request``; ``key`` then names the person. Hits ``without_text`` get theirs from ``texts`` by
    ``corpus_id``, and only those that are shown; such texts within ``broadcast_bytes`` go to the hits, which then stay where they are.
    """
    shown = (F.col("chars") if "chars" in fused.columns else F.length("text")) >= cfg.CHUNK_MIN_CHARS
    number = F.count_if(shown).over(Window.partitionBy(request).orderBy("fused_rank"))
    percent = F.rint(F.col("relevance") * 100).cast("int").cast("string")
    item = F.concat(
        render(cfg.ADVICE_ITEM, {"n": F.col("_no").cast("string"), "p": percent}), F.lit("\n"), F.col("text"), F.lit("\n")
    )
    # at most 2n hits per request; a request without a usable one keeps an empty list
    first = fused.where(F.col("fused_rank") <= 2 * n).withColumn("_no", number).withColumn("_shown", shown & (F.col("_no") <= n))
    if texts is not None:
        first = first.where(F.col("_shown") | (F.col("fused_rank") == 1))
        wanted = materialize(first.select(corpus_id).distinct(), "shown-ids")
        known = materialize(texts.join(wanted, corpus_id, "left_semi"), "shown-texts")
        size = known.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
        first = with_text(first, F.broadcast(known) if size <= broadcast_bytes else known, corpus_id)
    items = first.groupBy(request).agg(F.sort_array(F.collect_list(F.when(F.col("_shown"), F.struct("_no", item.alias("_item"))))).alias("_items"))
    listed = F.array_join(F.transform("_items", lambda x: x["_item"]), "\n")
    body = F.when(F.size("_items") > 0, listed).otherwise(F.lit(cfg.ADVICE_EMPTY))
    text = F.when(
        F.col("_items").isNotNull(), F.concat_ws("\n", risk.banner_column(level), summary, body)
    ).otherwise(F.lit(cfg.ADVICE_NONE))
    joined = people.join(items, request, "left")
    return joined.select(key or request, F.coalesce(F.size("_items"), F.lit(0)).alias("n_items"), text.alias("advice"))


def search_requests(
    plan: DataFrame, index: DataFrame, encoder, request: str, corpus_id: str, k: int = cfg.HITS_PER_QUERY,
    floor: float = cfg.RELEVANCE_FLOOR, terms: Sequence[str] = tuple(cfg.TABLE_TERMS), usable: DataFrame | None = None,
) -> DataFrame:
    """Run the queries of all requests against the index and fuse the hits per request.

    Equal query texts are searched once, and their vectors are made where they are searched, unless the encoder does not tell its
    ``dimensions``. Hits are fused ``without_text`` and get it afterwards, unless the caller gives the ``usable`` texts of the index, or these
    ``without_text``, and joins them itself.
    """
    keyed = plan.withColumn("_query", F.unhex(F.md5("query_text")))
    asked = spread(materialize(keyed.groupBy("_query").agg(F.min("query_text").alias("query_text")), "query-texts"))
    vectors = encoder.encode(asked, "query_text").drop("query_text")
    dimensions = getattr(encoder, "dimensions", None)
    if dimensions:
        hits = top_k(index, vectors, k, corpus_id, "_query", least=floor - LEAST_ROOM, query_bytes=asked.count() * (8 * dimensions + 64))
    else:
        hits = top_k(index, materialize(vectors, "query-vectors"), k, corpus_id, "_query")
    texts = valid_texts(index, corpus_id, terms=terms) if usable is None else usable
    heads = texts if "head" in texts.columns else materialize(without_text(texts), "usable-heads")
    heads = F.broadcast(heads) if heads.count() * 100 <= BROADCAST_BYTES else heads
    found = materialize(relevant(hits, floor).drop("distance"), "query-hits")
    fused = fuse(found.join(keyed.select("_query", request, "query_ord", "weight"), "_query").drop("_query").join(heads, corpus_id), request)
    return with_text(fused, texts, corpus_id) if usable is None else fused
