"""Searches that ship the corpus, candidates by single precision, and a fit on every text."""

import numpy as np
import pytest

from carelake.operators import retrieve
from carelake.operators.semantic import SemanticEncoder


def _points(kind, rng):
    if kind == "ties":
        return rng.integers(0, 4, (300, 3)).astype(float), rng.integers(0, 4, (5000, 3)).astype(float)
    if kind == "hot":  # a third of the rows are equal
        return np.r_[np.full((80, 4), 0.5), rng.normal(size=(200, 4))], np.r_[np.full((1700, 4), 0.5), rng.normal(size=(3300, 4))]
    if kind == "far":  # single precision tells nothing here
        return rng.normal(size=(200, 5)) * [1e6, 1, 1, 1, 1], rng.normal(size=(5000, 5)) * [1e6, 1, 1, 1, 1] + 1e4
    if kind == "few":
        return rng.normal(size=(5, 4)), rng.normal(size=(3, 4))
    return rng.normal(size=(700, 24)), rng.normal(size=(5000, 24))


@pytest.mark.parametrize("kind", ["ties", "hot", "far", "few", "normal"])
@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_candidates_hold_the_best_of_all_pairs(kind, metric):
    rng = np.random.default_rng(2)
    q, m = _points(kind, rng)
    ids = rng.permutation(len(m))
    all_scores = retrieve._scores(q, m, metric)
    want = [np.lexsort((ids, -s))[:5] for s in all_scores]
    rows, found, scores = retrieve._block_best(q, m, ids, 5, metric)
    for i, w in enumerate(want):
        assert found[rows == i].tolist() == ids[w].tolist()
        assert np.allclose(scores[rows == i], all_scores[i, w], rtol=1e-9, atol=1e-9)
    least = float(np.median([s[w[-1]] for s, w in zip(all_scores, want)]))
    rows, found, scores = retrieve._block_best(q, m, ids, 5, metric, least)
    for i, w in enumerate(want):
        near = np.abs(all_scores[i, w] - least) < 1e-6
        assert found[rows == i].tolist() == ids[w[all_scores[i, w] >= least]].tolist() or near.any()


def test_a_larger_query_set_is_not_shuffled(spark):
    rng = np.random.default_rng(4)
    corpus = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(rng.normal(size=(400, 8)))], "vec_id long, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(rng.normal(size=(900, 8)))], "query_id string, embedding array<float>").repartition(4)
    c, q = retrieve._sides(corpus, queries, "vec_id", "query_id", "embedding")
    plans, got = [], []
    for parts in (1, 3):
        hits = retrieve._shipped_corpus(c, q, 4, "cosine", parts)
        plans.append(hits._jdf.queryExecution().executedPlan().toString())
        got.append(sorted(map(tuple, retrieve._finish(hits, "vec_id", "query_id", 4, "cosine").collect())))
    tiled = sorted(map(tuple, retrieve._finish(retrieve._tiled(c, q, 4, "cosine"), "vec_id", "query_id", 4, "cosine").collect()))
    assert got[0] == got[1] == tiled and len(tiled) == 3600
    assert all("FlatMapCoGroups" not in p and "hashpartitioning" not in p for p in plans)
    # 900 queries are more than these bytes, 400 rows are two parts
    by_size = retrieve.top_k(corpus, queries, 4, "vec_id", "query_id", broadcast_bytes=15_000)
    assert "FlatMapCoGroups" not in by_size._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, by_size.collect())) == tiled


def test_the_encoder_is_fitted_on_every_text(spark):
    n = 200_800
    df = spark.range(0, n, 1, 4).selectExpr("concat(IF(id % 2 = 0, 'even', 'odd'), ' number', id % 5) AS text")
    encoder = SemanticEncoder(dimensions=4, terms=1 << 10, passes=1).fit(df)
    found = sorted(set(np.round(encoder.idf[encoder.idf > 0], 12)))
    assert found == sorted({round(float(np.log((n + 1) / (n // d + 1)) + 1), 12) for d in (2, 5)})
