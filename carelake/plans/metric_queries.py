"""Queries on evaluation metrics, rankings and splits; no model is needed."""

from __future__ import annotations

from pyspark.sql import functions as F

from carelake.operators import metrics, ranking, split
from carelake.plans import clinical as cfg
from carelake.plans.fixtures import classified, patients, with_views
from carelake.plans.registry import query
from carelake.sources.tables import table


def _rounded(df, *names, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in names})


_CELLS = """count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
  count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 1 AND prediction = 1) AS tp"""


@query("confusion_matrix", with_views("classified", f"SELECT {_CELLS} FROM classified"))
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(classified(spark, sf_dir))


@query("binary_metrics", with_views("classified", f""", m AS (SELECT {_CELLS} FROM classified)
SELECT round((tp + tn) / (tn + fp + fn + tp), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
  round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM m"""))
def binary_metrics(spark, sf_dir):
    return _rounded(metrics.binary_metrics(classified(spark, sf_dir)), "accuracy", "precision", "recall", "f1")


@query("classification_report", with_views("classified", f""", m AS (SELECT {_CELLS} FROM classified),
c AS (SELECT 'Low' AS class, tn / (tn + fn) AS precision, tn / (tn + fp) AS recall, tn + fp AS support FROM m
  UNION ALL SELECT 'High', tp / (tp + fp), tp / (tp + fn), tp + fn FROM m),
f AS (SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM c),
r AS (SELECT class, precision, recall, f1, support FROM f
  UNION ALL SELECT 'accuracy', (tp + tn) / (tn + fp + fn + tp), (tp + tn) / (tn + fp + fn + tp), (tp + tn) / (tn + fp + fn + tp), tn + fp + fn + tp FROM m
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM f
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM f)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM r"""))
def classification_report(spark, sf_dir):
    report = metrics.classification_report(classified(spark, sf_dir), ["Low", "High"])
    return _rounded(report, "precision", "recall", "f1")


@query("roc_auc", with_views("classified", """, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rk FROM classified)
SELECT round((sum(rk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2)
  / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 6) AS roc_auc FROM r"""))
def roc_auc(spark, sf_dir):
    return _rounded(metrics.roc_auc(classified(spark, sf_dir)), "roc_auc")


@query("regression_metrics", """WITH p AS (SELECT l_extendedprice AS y, l_quantity * 2500.0::DOUBLE AS f FROM lineitem)
SELECT round(avg(power(y - f, 2)), 2) AS mse, round(avg(abs(y - f)), 4) AS mae,
  round(1 - sum(power(y - f, 2)) / sum(power(y - (SELECT avg(y) FROM p), 2)), 6) AS r2 FROM p""")
def regression_metrics(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("f", F.col("l_quantity") * 2500.0)
    found = metrics.regression_metrics(df, "l_extendedprice", "f")
    return found.select(F.round("mse", 2).alias("mse"), F.round("mae", 4).alias("mae"), F.round("r2", 6).alias("r2"))


# ---- rankings -----------------------------------------------------------------------------


@query("topn", with_views("classified", "SELECT patient_id, total FROM classified ORDER BY total DESC, patient_id LIMIT 5"))
def topn(spark, sf_dir):
    return ranking.topn(classified(spark, sf_dir).select("patient_id", "total"), "total", "patient_id", 5)


_CUTS = [6, 8, 10, 12, 14]


@query("best_model", with_views("classified", """, m AS (SELECT printf('total >= %d', cut) AS model,
  count(*) FILTER (label = 0 AND total >= cut) AS fp, count(*) FILTER (label = 1 AND total < cut) AS fn, count(*) FILTER (label = 1 AND total >= cut) AS tp
  FROM classified, (SELECT unnest([6, 8, 10, 12, 14]) AS cut) c GROUP BY cut)
SELECT model, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM m ORDER BY 2 DESC, 1 LIMIT 1"""))
def best_model(spark, sf_dir):
    rules = F.array(*[F.struct(F.lit(f"total >= {c}").alias("model"), (F.col("total") >= c).cast("int").alias("prediction")) for c in _CUTS])
    voted = classified(spark, sf_dir).select("label", F.inline(rules))
    scored = metrics.binary_metrics(voted, by=["model"])
    return _rounded(ranking.best_row(scored, "model", "f1"), "f1")


@query("topk_others", """WITH s AS (SELECT p_brand AS name, sum(p_retailprice) AS value FROM part GROUP BY p_brand),
r AS (SELECT *, row_number() OVER (ORDER BY value DESC, name) AS rn FROM s),
g AS (SELECT CASE WHEN rn <= 5 THEN name ELSE 'Others' END AS name, sum(value) AS value FROM r GROUP BY 1)
SELECT name, round(value, 2) AS value, round(value / sum(value) OVER (), 6) AS share FROM g""")
def topk_others(spark, sf_dir):
    found = ranking.topk_others(table(spark, sf_dir, "part"), "p_brand", F.col("p_retailprice"), 5)
    return found.select("name", F.round("value", 2).alias("value"), F.round("share", 6).alias("share"))


def _two_lists(spark, sf_dir):
    part = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name"))
    return part.agg(F.count(F.lit(1)).cast("double").alias("score")), part.agg(F.round(F.sum("p_retailprice"), 2).alias("score"))


_LISTS = """WITH a AS (SELECT p_brand AS name, CAST(count(*) AS DOUBLE) AS score FROM part GROUP BY 1),
b AS (SELECT p_brand AS name, round(sum(p_retailprice), 2) AS score FROM part GROUP BY 1),
ra AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, name) AS INTEGER) AS rank FROM a),
rb AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, name) AS INTEGER) AS rank FROM b)"""


@query("rank_align", _LISTS + """ SELECT rank, x.name AS left_name, x.score AS left_score, y.name AS right_name, y.score AS right_score
FROM (SELECT * FROM ra WHERE rank <= 5) x FULL JOIN (SELECT * FROM rb WHERE rank <= 5) y USING (rank)""")
def rank_align(spark, sf_dir):
    return ranking.rank_align(*_two_lists(spark, sf_dir), "name", "score", 5)


@query("topk_intersect", _LISTS + """ SELECT x.name, x.rank = 1 AND y.rank = 1 AS is_shared_winner
FROM ra x JOIN rb y USING (name) WHERE x.rank <= 3 AND y.rank <= 3""")
def topk_intersect(spark, sf_dir):
    return ranking.topk_intersect(*_two_lists(spark, sf_dir), "name", "score", 3)


# ---- splits and scaling -------------------------------------------------------------------

_HASHED = """, h AS (SELECT *, row_number() OVER (PARTITION BY nivo_rizika ORDER BY substr(md5(concat(patient_id, '-{seed}')), 1, 15), CAST(patient_id AS VARCHAR)) AS rk,
  count(*) OVER (PARTITION BY nivo_rizika) AS size FROM patients)"""
_SPLIT = _HASHED.format(seed=0) + ", s AS (SELECT *, rk <= floor(0.2::DOUBLE * size + 0.5) AS is_test FROM h)"


@query("stratified_split", with_views("patients", _SPLIT + " SELECT patient_id, nivo_rizika, is_test FROM s"))
def stratified_split(spark, sf_dir):
    return split.stratified_split(patients(spark, sf_dir), cfg.TARGET, "patient_id").select("patient_id", cfg.TARGET, "is_test")


@query("cv_folds", with_views("patients", _HASHED.format(seed=42) + """
SELECT nivo_rizika, CAST(4 - """ + " - ".join(
    f"CASE WHEN rk <= floor({i / 5}::DOUBLE * size + 0.5) THEN 1 ELSE 0 END" for i in range(1, 5)) + """ AS INTEGER) AS fold, count(*) AS n FROM h GROUP BY ALL"""))
def cv_folds(spark, sf_dir):
    folds = split.stratified_folds(patients(spark, sf_dir), cfg.TARGET, "patient_id", 5, 42)
    return folds.groupBy(cfg.TARGET, "fold").agg(F.count(F.lit(1)).alias("n"))


SCALED_VIEW = _SPLIT + ", p AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in cfg.FEATURES) + " FROM s WHERE NOT is_test), z AS (SELECT patient_id, nivo_rizika, is_test, " + ", ".join(
    f"({c} - m_{c}) / s_{c} AS {c}" for c in cfg.FEATURES) + " FROM s, p)"


@query("standard_scale", with_views("patients", SCALED_VIEW + " SELECT patient_id, is_test, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in cfg.FEATURES) + " FROM z"))
def standard_scale(spark, sf_dir):
    df = split.stratified_split(patients(spark, sf_dir), cfg.TARGET, "patient_id")
    scaled = metrics.standard_scale(df, metrics.scale_parameters(df.where("NOT is_test"), cfg.FEATURES))
    return _rounded(scaled.select("patient_id", "is_test", *cfg.FEATURES), *cfg.FEATURES)
