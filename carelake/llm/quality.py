"""Quality: attention-based multiple-instance learning over the passages of a document.

Every passage of 64 words is encoded by a learned layer from counts of its bytes and words. Gated attention weights, learned
from document labels alone, say which passages decide; the document's score comes from the weighted passage vector. All
parts are trained together in numpy on at most ``PER_CLASS`` rows of each class; all texts are scored whole.

Defined results: a null or wordless text is one empty passage; without labels of both classes every score is the share of
class 1 (0.5 without labels); repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.llm.labelled import Adam, held_out, sigmoid, training_sample
from carelake.llm.textbytes import SPACED, shards, text_bytes, words_of

PASSAGE, PER_CLASS = 64, 1200
HIDDEN, GATE, STEPS, RATE, DECAY = 16, 8, 150, 0.02, 0.001
ACCEPT = 0.3

# byte classes: upper, lower, digits, white space, each ASCII sign by itself, control, beyond ASCII
_SIGNS = [c for c in range(33, 127) if not chr(c).isalnum()]
_CLASS = np.full(256, 5 + len(_SIGNS), np.int64)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[0:33] = 0, 1, 2, 4 + len(_SIGNS)
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[_SIGNS] = np.arange(4, 4 + len(_SIGNS))
N_CLASSES = 6 + len(_SIGNS)
N_FEATURES = N_CLASSES + 9


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, number of passages of each text)."""
    raw, offsets = text_bytes(texts)
    words = words_of(texts, SPACED, lower=False)
    counts = words.counts
    n = np.maximum(1, -(-counts // PASSAGE))
    first = np.concatenate(([0], np.cumsum(n)))
    base = np.concatenate(([0], np.cumsum(counts)))[:-1]
    place = np.arange(len(words.doc)) - base[words.doc]
    of = first[words.doc] + place // PASSAGE
    total = int(first[-1])
    x = np.zeros((total, N_FEATURES))
    if len(raw):
        # a passage runs from its first word to the next passage's first word or the end of the text
        starts = np.repeat(offsets[:-1], n)
        heads = np.flatnonzero(place % PASSAGE == 0)
        heads = heads[place[heads] > 0]
        starts[of[heads]] = words.starts[heads]
        owner = np.repeat(np.arange(total), np.diff(np.append(starts, len(raw))))
        x[:, :N_CLASSES] = np.bincount(owner * N_CLASSES + _CLASS[raw], minlength=total * N_CLASSES).reshape(total, N_CLASSES)
        size = np.maximum(1, x[:, :N_CLASSES].sum(1))
        lines = np.bincount(owner[raw == 10], minlength=total)
        x[:, :N_CLASSES] /= size[:, None]
        x[:, N_CLASSES] = lines / size
    if len(words.doc):
        h, length = words.hashes(), words.ends - words.starts
        m = np.maximum(1, np.bincount(of, minlength=total))
        mean = np.bincount(of, weights=length, minlength=total) / m
        turn = np.lexsort((h, of))
        new = np.ones(len(h), bool)
        new[1:] = (h[turn][1:] != h[turn][:-1]) | (of[turn][1:] != of[turn][:-1])
        again, second = np.zeros(len(h), bool), np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
        second[2:] = (h[2:] == h[:-2]) & (of[2:] == of[:-2])
        head, tail = words.buf[words.starts], words.buf[words.ends - 1]
        letter = ((tail >= 97) & (tail <= 122)) | ((tail >= 65) & (tail <= 90)) | (tail >= 128)
        k = N_CLASSES + 1
        x[:, k] = np.bincount(of[turn], weights=new, minlength=total) / m
        x[:, k + 1] = np.bincount(of, weights=again, minlength=total) / m
        x[:, k + 2] = np.bincount(of, weights=second, minlength=total) / m
        x[:, k + 3] = np.bincount(of, weights=(head >= 65) & (head <= 90), minlength=total) / m
        x[:, k + 4] = np.bincount(of, weights=~letter, minlength=total) / m
        x[:, k + 5] = mean / 10
        x[:, k + 6] = np.sqrt(np.maximum(0, np.bincount(of, weights=length * length.astype(float), minlength=total) / m - mean * mean)) / 10
        x[:, k + 7] = np.log1p(np.bincount(of, minlength=total)) / 4
    x[:, :N_CLASSES] = np.sqrt(x[:, :N_CLASSES])
    return x, n


class Model:
    """Encoder, gated attention and output; ``values`` in one list."""

    def __init__(self, values: list[np.ndarray], mean: np.ndarray, scale: np.ndarray):
        self.values, self.mean, self.scale = values, mean, scale

    @classmethod
    def constant(cls, share: float) -> Model:
        rest = [np.zeros(s) for s in ((N_FEATURES, HIDDEN), (HIDDEN,), (HIDDEN, GATE), (HIDDEN, GATE), (GATE,), (HIDDEN,))]
        return cls([*rest, np.array([np.log(max(share, 1e-6) / max(1 - share, 1e-6))])], np.zeros(N_FEATURES), np.ones(N_FEATURES))

    def forward(self, x: np.ndarray, n: np.ndarray) -> dict:
        enc, enc_b, v, u, w, out, bias = self.values
        heads = np.concatenate(([0], np.cumsum(n)))[:-1]
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ enc + enc_b)
        a, b = np.tanh(h @ v), sigmoid(h @ u)
        e = (a * b) @ w
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, heads), n))
        att = e / np.repeat(np.add.reduceat(e, heads), n)
        z = np.add.reduceat(att[:, None] * h, heads)
        return {"x": x, "h": h, "a": a, "b": b, "att": att, "z": z, "p": sigmoid(z @ out + bias[0]), "heads": heads, "n": n}

    def gradients(self, f: dict, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        _, _, v, u, w, out, _ = self.values
        d = (f["p"] - y) * weight
        dz = np.repeat(d, f["n"])[:, None] * out
        datt = (dz * f["h"]).sum(1)
        de = f["att"] * (datt - np.repeat(np.add.reduceat(f["att"] * datt, f["heads"]), f["n"]))
        dg = de[:, None] * w
        da, db = dg * f["b"] * (1 - f["a"] ** 2), dg * f["a"] * f["b"] * (1 - f["b"])
        dh = (f["att"][:, None] * dz + da @ v.T + db @ u.T) * (1 - f["h"] ** 2)
        return [f["x"].T @ dh, dh.sum(0), f["h"].T @ da, f["h"].T @ db, (f["a"] * f["b"]).T @ de, f["z"].T @ d, np.array([d.sum()])]


def train(x: np.ndarray, n: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 7) -> Model:
    """Adam on all rows; a fifth is only watched, and the step with its least loss is kept."""
    rng = np.random.default_rng(seed)
    scale = x.std(0)
    shapes = ((N_FEATURES, HIDDEN), (HIDDEN,), (HIDDEN, GATE), (HIDDEN, GATE), (GATE,), (HIDDEN,), (1,))
    values = [rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 or s[0] == GATE else np.zeros(s) for s in shapes]
    values[5] = rng.normal(0, 0.3, (HIDDEN,))
    model = Model(values, x.mean(0), np.where(scale > 1e-9, scale, 1.0))
    watched = rng.permutation(len(y)) % 5 == 0
    w, watch = weight * ~watched, weight * watched
    w, watch = w / w.sum(), watch / max(watch.sum(), 1e-12)
    adam, least, best = Adam(values, RATE, DECAY), np.inf, None
    for _ in range(STEPS):
        f = model.forward(x, n)
        p = np.clip(f["p"], 1e-9, 1 - 1e-9)
        loss = -float((watch * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum())
        if loss < least:
            least, best = loss, [v.copy() for v in values]
        adam.step(model.gradients(f, y, w))
    model.values = best
    return model


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in shards(batch, "text", 1 << 20):
            x, n = passages(part.column("text"))
            cut = np.concatenate(([0], np.cumsum(n)))
            x = x.astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([x[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary()), part.column("y")], names=["x", "y"])


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Model:
    """The model from a bounded sample; its passages are made in tasks and trained on by the driver."""
    texts, weights = training_sample(docs, labels, label, per_class)
    rows = texts.mapInArrow(_feature_rows, "x binary, y int").collect() if len(weights) == 2 else []
    y = np.array([r["y"] for r in rows], float)
    if len(set(y.tolist())) < 2:
        return Model.constant({0: 0.0, 1: 1.0}[next(iter(weights))] if len(weights) == 1 else 0.5)
    parts = [np.frombuffer(r["x"], np.float32).reshape(-1, N_FEATURES) for r in rows]
    return train(np.concatenate(parts).astype(float), np.array([len(p) for p in parts]), y, np.array([weights[int(k)] for k in y]))


def _score_rows(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for part in shards(batch, "text", 1 << 20):
                if part.num_rows:
                    s = m.forward(*passages(part.column("text")))["p"]
                    cols = {c: part.column(c) for c in part.schema.names} | {"score": pa.array(s, pa.float64())}
                    yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT, **options) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, **options))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").withColumn("held_out", held_out())
    scored = rows.mapInArrow(_score_rows(model), f"doc_id {kind}, text string, held_out boolean, score double")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT, **options) -> DataFrame:
    """The documents that score ``accept`` or more, with their own columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, **options))
    names = docs.columns
    own = docs.select(*(F.col(f"`{c}`").alias("text" if c == "text" else f"own_{i}") for i, c in enumerate(names)))
    schema = own.withColumn("score", F.lit(0.0)).schema
    kept = own.mapInArrow(_score_rows(model), schema).where(F.col("score") >= accept)
    return kept.select(*(F.col("text" if c == "text" else f"own_{i}").alias(c) for i, c in enumerate(names)))
