"""The stored forest: the same trees however the rows are dealt, before and after storing."""

import numpy as np
from pyspark.sql import functions as F

from carelake.operators import models
from carelake.plans import clinical as cfg


def _given(spark, n=300):
    r = np.random.default_rng(8)
    x = r.integers(0, 60, (n, len(cfg.FEATURES))).astype(float)
    y = ((x[:, 3] > 30) ^ (r.random(n) < 0.1)).astype(float)
    schema = "patient_id long, " + ", ".join(f"{c} double" for c in cfg.FEATURES) + ", label double"
    return spark.createDataFrame([(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], schema)


def _scores(model, df):
    return {r["patient_id"]: r["p_high"] for r in models.apply_model(model, df).collect()}


def test_trees_do_not_depend_on_partitions_or_storing(spark, tmp_path):
    given = _given(spark)
    one = models.train_forest(given.repartition(1), numTrees=4)
    many = models.train_forest(given.repartition(5, F.rand(3)), numTrees=4)
    models.save_model(one, str(tmp_path / "m"))
    stored = models.load_model(str(tmp_path / "m"))
    want = _scores(one, given)
    assert len(want) == 300 and len(set(want.values())) > 5
    assert _scores(many, given) == want and _scores(stored, given) == want


def test_small_nodes_are_not_cut(spark):
    given = _given(spark, 4).withColumn("label", (F.col("patient_id") % 2).cast("double"))
    model = models.train_forest(given, numTrees=20)
    # a node of fewer rows than FOREST_MIN_SPLIT is a leaf, so every row gets the same score
    assert cfg.FOREST_MIN_SPLIT == 5 and len(set(_scores(model, given).values())) == 1
