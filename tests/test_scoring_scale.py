"""Scoring many requests."""

from carelake.operators import models
from carelake.plans import clinical as cfg


def test_requests_are_read_once(spark):
    rows = [(i, *[float(20 + i % 30)] * len(cfg.FEATURES), float(i % 2)) for i in range(40)]
    schema = "patient_id long, " + ", ".join(f"{c} double" for c in cfg.FEATURES) + ", label double"
    given = spark.createDataFrame(rows, schema)
    model = models.train_forest(given, numTrees=2)
    requests = given.drop("label").selectExpr("patient_id", *[f"CASE WHEN patient_id = 3 THEN NULL ELSE {c} END AS {c}" for c in cfg.FEATURES])
    out = models.score_batch(model, requests)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    found = {r["patient_id"]: r for r in out.collect()}
    assert len(found) == 40 and found[3]["error"] == "missing: " + ", ".join(cfg.FEATURES) and found[3]["p_low"] is None
    assert found[3]["risk_level"] is None and found[4]["error"] is None and found[4]["risk_level"] in ("High", "Low")
