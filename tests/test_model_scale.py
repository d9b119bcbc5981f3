"""Growth over many rows: the same trees, and no work twice."""

import numpy as np

from carelake.operators import trees as T

FEATURES = ["a", "b", "c", "d"]


def _table(spark, n=400):
    r = np.random.default_rng(5)
    b = r.integers(0, 50, n)
    y = (b > 20) ^ (r.random(n) < 0.1)
    data = [(i, 1.0, float(v), 2.0, 3.0, float(t)) for i, (v, t) in enumerate(zip(b, y, strict=True))]
    return spark.createDataFrame(data, "patient_id long, a double, b double, c double, d double, label double").repartition(3)


def test_histograms_hold_the_tried_columns_only(spark, monkeypatch):
    sizes = []
    was = T._best_cuts

    def seen(histograms, members, n_columns, numbers, places):
        sizes.extend(r["n"] for r in histograms.selectExpr("size(v) AS n").collect())
        return was(histograms, members, n_columns, numbers, places)

    monkeypatch.setattr(T, "_best_cuts", seen)
    table = _table(spark)
    members = T.forest_members("f", 3, 7, 1, max_depth=4)
    cut = T.train(table, members, FEATURES, "patient_id", task_rows=60)
    whole = T.train(table, members, FEATURES, "patient_id")
    assert sizes and max(sizes) <= 3 * 4 * T.BINS  # one tried column, or the three others where it cannot be cut
    assert min(sizes) == 4 * T.BINS
    got, want = ({r["patient_id"]: r["p_high"] for r in T.score(e, table, "f").collect()} for e in (cut, whole))
    assert got == want


def test_rows_end_where_single_steps_lead():
    r = np.random.default_rng(3)
    x = r.integers(0, 40, (2000, 5)).astype(np.uint8)
    y = ((x[:, 0] > 20) ^ (r.random(2000) < 0.2)).astype(float)
    tree, _ = T.grow(x, [np.ones(2000), np.ones(2000), y, np.zeros(2000)], 1, 0, T.Member("t", columns=2))
    for row, end in zip(x, T.leaves(tree, x), strict=True):
        at = 0
        while tree["column"][at] >= 0:
            at = tree["left"][at] + int(row[tree["column"][at]] > tree["bin"][at])
        assert at == end


def test_growth_time_of_a_level_with_closed_nodes():
    import time

    r = np.random.default_rng(1)
    n = 200_000
    x = r.integers(0, 200, (n, 6)).astype(np.uint8)
    y = ((x[:, 0] > 100) ^ (r.random(n) < 0.02)).astype(float)
    sums = [np.ones(n), np.ones(n), y, np.zeros(n)]
    start = time.process_time()
    T.grow(x, sums, 1, 0, T.Member("t"))
    assert time.process_time() - start < 4
