"""Rows of trees travel in packed blocks."""

import numpy as np
from pyspark.sql import functions as F

from carelake.operators import trees as T

FEATURES = ["a", "b", "c"]


def _table(spark, n=900):
    r = np.random.default_rng(6)
    rows = [(i, float(a), float(b), 1.0, float((a > 20) ^ (i % 9 == 0)), i % 3) for i, (a, b) in enumerate(r.integers(0, 40, (n, 2)))]
    return spark.createDataFrame(rows, "patient_id long, a double, b double, c double, label double, fold int").repartition(3)


def test_blocks_hold_every_row_once_and_parts_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(T, "PART_ROWS", 100)
    table = _table(spark)
    cuts = T.cut_points(table, FEATURES)
    blocks = T.binned(table, FEATURES, cuts, "patient_id")
    assert T.n_rows(blocks) == 900 and blocks.count() <= 3  # few rows of the table, whatever the rows they hold
    found = [r for batch in blocks.toArrow().to_batches() for r in T.Rows.of(batch)]
    ids = np.concatenate([r.id for r in found])
    want = {x["h"]: (int(x["label"]), x["fold"], x["a"], x["b"]) for x in table.withColumn("h", F.xxhash64("patient_id")).collect()}
    assert len(ids) == 900 and set(ids.tolist()) == set(want)
    for r in found:
        for i, y, fold, x in zip(r.id, r.y, r.fold, r.x, strict=True):
            assert (y, fold) == want[i][:2] and [np.searchsorted(cuts[j], want[i][2 + j], "left") for j in (0, 1)] == x[:2].tolist()


def test_boosting_over_all_rows_equals_boosting_in_a_task(spark, monkeypatch):
    monkeypatch.setattr(T, "ROUNDS_PER_WRITE", 2)
    table = _table(spark)
    members = [T.Member("b", seed=s, without=f, rounds=5, max_depth=3, curved_gain=False) for s, f in ((1, 0), (2, 2))]
    one, many = (T.score(T.train(table, members, FEATURES, "patient_id", task_rows=n), table, "b").select("patient_id", F.round("p_high", 6)).collect() for n in (1000, 100))
    assert sorted(one) == sorted(many)
