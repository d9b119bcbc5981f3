"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained together in numpy.

A word is the average of the vectors of its character n-grams (with word marks) and of the whole word; a text is the
average of its words; two linear outputs and a softmax follow. A misspelling shares most n-grams with the word it hides.

Averages are linear, so after training each n-gram bucket holds one number, and a text's score needs no vectors.
The training sample is bounded by ``PER_CLASS`` rows of each class; all texts are scored whole.

Defined results: a null or wordless text is scored by the bias alone; without labels of both classes every score is the
share of class 1 (0.5 without labels); repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.llm.labelled import Adam, held_out, sigmoid, training_sample
from carelake.llm.textbytes import mix64, shards

PER_CLASS, BUCKETS, SIZE, SPAN, MIN_Z = 2000, 1 << 18, 8, (3, 5), 4.0
STEPS, RATE, DECAY = 150, 0.1, 0.002
#: Averages are small numbers; this scale keeps the steps of training of order one.
SCALE = 100.0
_INSIDE = np.array([48 <= c <= 57 or 97 <= c <= 122 for c in range(128)])
_ODD = np.uint32(0x9E3779B1)


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, word of each n-gram, document of each word, n-grams of each word)."""
    low = [t.lower() for t in texts]
    sizes = np.array([len(t) for t in low], np.int64)
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4")
    word = np.where(points < 128, _INSIDE[np.minimum(points, 127)], True)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    cut = np.zeros(len(points) + 1, bool)
    cut[offsets] = True
    n = len(points)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    starts = np.flatnonzero(word & (~before | cut[:n]))
    ends = np.flatnonzero(word & (~after | cut[1:])) + 1
    doc = np.searchsorted(offsets, starts, "right") - 1
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z, z, doc, z
    # words between marks: each word with a 1 before and a 2 after it
    length = ends - starts + 2
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    of = np.repeat(np.arange(len(starts)), length)
    at = np.arange(length.sum()) - first[of]
    marked = np.where(at == 0, 1, np.where(at == length[of] - 1, 2, points[np.clip(starts[of] + at - 1, 0, n - 1)])).astype(np.uint32)
    left = (length[of] - at).astype(np.int64)
    buckets, owner = [], []
    rolled = np.zeros(len(marked), np.uint32)
    for k in range(1, SPAN[1] + 1):
        take = len(marked) - k + 1
        rolled[:take] = rolled[:take] * _ODD + marked[k - 1 :]
        if k >= SPAN[0]:
            ok = np.flatnonzero(left[:take] >= k)
            buckets.append(_bucket(rolled[ok], k))
            owner.append(of[ok])
    # the whole word: a sum over its letters by place
    total = np.concatenate(([np.uint64(0)], np.cumsum(mix64(marked.astype(np.uint64) + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))))
    buckets.append(((total[first + length] - total[first]) % np.uint64(BUCKETS)).astype(np.int64))
    owner.append(np.arange(len(starts)))
    bucket, own = np.concatenate(buckets), np.concatenate(owner)
    return bucket, own, doc, np.bincount(own, minlength=len(starts))


def _bucket(h: np.ndarray, k: int) -> np.ndarray:
    h = h + np.uint32(k)
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x7FEB352D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x846CA68B)
    h ^= h >> np.uint32(16)
    return (h % np.uint32(BUCKETS)).astype(np.int64)


def bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its buckets and their shares in its average."""
    bucket, own, doc, n = subwords(texts)
    words = np.bincount(doc, minlength=len(texts))
    share = 1.0 / (n[own] * words[doc[own]]) if len(own) else np.zeros(0)
    keys, back = np.unique(doc[own] * BUCKETS + bucket, return_inverse=True) if len(own) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    sums = np.bincount(back, weights=share, minlength=len(keys))
    cut = np.searchsorted(keys, np.arange(len(texts) + 1) * BUCKETS)
    return [((keys[a:b] % BUCKETS).astype(np.uint32), sums[a:b].astype(np.float32)) for a, b in zip(cut, cut[1:], strict=False)]


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """(logit of class 1 against 0 by bucket, bias), from vectors and outputs that are trained together.

    Vectors are for the buckets whose share of rows differs between the classes by ``MIN_Z`` standard errors; all others
    stay zero. A fifth of the rows is only watched; the step at which their loss is least is kept.
    """
    rng = np.random.default_rng(seed)
    index, share = np.concatenate([r[0] for r in rows]).astype(np.int64), np.concatenate([r[1] for r in rows]) * np.float32(SCALE)
    doc = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    seen = np.stack([np.bincount(index[y[doc] == k], minlength=BUCKETS) for k in (0, 1)])
    pooled = (seen.sum(0) + 1) / (n.sum() + 2)
    common = np.abs(seen[1] / n[1] - seen[0] / n[0]) >= MIN_Z * np.sqrt(pooled * (1 - pooled) * (1 / n[0] + 1 / n[1]))
    number = np.cumsum(common) - 1
    index, share, doc = number[index[common[index]]], share[common[index]][:, None], doc[common[index]]
    vectors = rng.normal(0, 0.1, (int(common.sum()), SIZE)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (SIZE, 2)).astype(np.float32), np.log(np.array([[weight[y == 0].sum(), weight[y == 1].sum()]]) / weight.sum()).astype(np.float32)
    watched = rng.permutation(len(rows)) % 5 == 0
    has = np.bincount(doc, minlength=len(rows)) > 0
    heads = np.flatnonzero(np.diff(doc, prepend=-1))
    turn = np.flatnonzero(~watched[doc])
    turn = turn[np.argsort(index[turn], kind="stable")]
    used = index[turn]
    columns = np.flatnonzero(np.diff(used, prepend=-1))
    by_column, doc_turn, share_turn = used[columns], doc[turn], share[turn]
    goal = np.stack((1 - y, y), 1).astype(np.float32)
    w = (weight * ~watched / (weight * ~watched).sum()).astype(np.float32)[:, None]
    watch = weight * watched / max((weight * watched).sum(), 1e-12)
    adam, least, best = Adam([vectors, out, bias], RATE, DECAY), np.inf, None
    for _ in range(STEPS):
        mean = np.zeros((len(rows), SIZE), np.float32)
        if len(heads):
            mean[has] = np.add.reduceat(vectors[index] * share, heads)
        z = mean @ out + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        loss = -float((watch * np.log(np.maximum(p[np.arange(len(y)), y], 1e-9))).sum())
        if loss < least:
            least, best = loss, (vectors @ (out[:, 1] - out[:, 0]), float(bias[0, 1] - bias[0, 0]))
        d = (p - goal) * w
        grad = np.zeros_like(vectors)
        if len(columns):
            grad[by_column] = np.add.reduceat((d @ out.T)[doc_turn] * share_turn, columns)
        adam.step([grad, mean.T @ d, d.sum(0, keepdims=True)])
    table = np.zeros(BUCKETS)
    table[common] = best[0].astype(np.float64) * SCALE
    return table, best[1]


def score(texts: list[str], table: np.ndarray, bias: float) -> np.ndarray:
    bucket, own, doc, n = subwords(texts)
    words = np.bincount(own, weights=table[bucket], minlength=len(n)) / np.maximum(n, 1) if len(n) else np.zeros(0)
    logit = np.bincount(doc, weights=words, minlength=len(texts)) / np.maximum(1, np.bincount(doc, minlength=len(texts)))
    return sigmoid(logit + bias)


def _bag_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in shards(batch, "text", 1 << 20):
            rows = bags([t or "" for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [pa.array([a.tobytes() for a, _ in rows], pa.binary()), pa.array([b.tobytes() for _, b in rows], pa.binary()), part.column("y")], names=["index", "share", "y"]
            )


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> tuple[np.ndarray, float]:
    """The model from a bounded sample; its bags of n-grams are made in tasks and trained on by the driver."""
    texts, weights = training_sample(docs, labels, label, per_class)
    rows = texts.mapInArrow(_bag_rows, "index binary, share binary, y int").collect() if len(weights) == 2 else []
    y = np.array([r["y"] for r in rows])
    if len(set(y.tolist())) < 2:
        share = {0: 0.0, 1: 1.0}[next(iter(weights))] if len(weights) == 1 else 0.5
        return np.zeros(BUCKETS), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    own = [(np.frombuffer(r["index"], np.uint32), np.frombuffer(r["share"], np.float32)) for r in rows]
    return train(own, y, np.array([weights[k] for k in y.tolist()]))


def _score_rows(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = model.value
        for batch in batches:
            for part in shards(batch, "text", 1 << 20):
                s = score([t or "" for t in part.column("text").to_pylist()], table, bias)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s, pa.float64())], names=["doc_id", "held_out", "score"])

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels, **options))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").withColumn("held_out", held_out()).mapInArrow(_score_rows(model), f"doc_id {kind}, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
