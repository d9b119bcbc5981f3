"""Labelled rows: the held-out fold and a bounded training sample."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5
#: Bytes of text in a training sample, in equal parts for its classes.
SAMPLE_BYTES = 32 << 20


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5; a row without an id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_bytes: int = SAMPLE_BYTES) -> tuple[DataFrame, dict[int, float]]:
    """(text, y) of at most ``per_class`` labelled rows of each class, and the weight of a row of each class.

    Rows of the held-out fold never take part. The sample is the rows with the smallest hashes of their ids; of these, in that
    order, a row whose text no longer fits into its class's part of ``max_bytes`` is passed over. It is bounded in rows and bytes,
    so it is sent to the scan of the documents. Weights restore the classes' shares among all labelled rows.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(~held_out()).where("doc_id is not null and y in (0, 1)")
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("y")]
    some = rows.where("y = 0").orderBy(*order).limit(per_class).unionAll(rows.where("y = 1").orderBy(*order).limit(per_class))
    sizes = docs.select("doc_id", F.octet_length("text").alias("size")).join(F.broadcast(some), "doc_id").groupBy("doc_id", "y").agg(F.sum("size").alias("size"))
    left = {y: max_bytes // max(1, len(counts)) for y in counts}
    used, kept = dict.fromkeys(counts, 0), []
    for r in sizes.orderBy(*order).collect():
        if (r["size"] or 0) <= left[r["y"]]:
            left[r["y"]] -= r["size"] or 0
            used[r["y"]] += 1
            kept.append((r["doc_id"], r["y"]))
    known = docs.sparkSession.createDataFrame(kept, sizes.select("doc_id", "y").schema)
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "y")
    total = sum(counts.values())
    return texts, {y: n / total / max(1, used[y]) for y, n in counts.items()}


class Adam:
    """Steps for a list of arrays that are changed in place."""

    def __init__(self, values: list[np.ndarray], rate: float, decay: float = 0.0):
        self.values, self.rate, self.decay, self.t = values, rate, decay, 0
        self.m, self.v = [np.zeros_like(x) for x in values], [np.zeros_like(x) for x in values]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for x, g, m, v in zip(self.values, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= self.rate * (m / (1 - 0.9**self.t) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8) + self.decay * x)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def auc(score: np.ndarray, y: np.ndarray) -> float:
    """Chance that a row of class 1 scores above one of class 0, ties counted half."""
    order = np.argsort(score, kind="stable")
    _, back, n = np.unique(score[order], return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[back]
    pos = y[order] == 1
    return float((rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / max(1, pos.sum() * (~pos).sum()))
