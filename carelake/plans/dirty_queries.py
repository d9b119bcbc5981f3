"""Records with NaN, infinities, texts and outliers, the feedback loop end to end, and checks on fitted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from carelake.operators import clean, feedback, models, profile, ranks, risk
from carelake.plans import clinical as cfg
from carelake.plans.feedback_queries import _full_log
from carelake.plans.fixtures import patients, patients_raw, with_views
from carelake.plans.registry import query
from carelake.session import run_dir
from carelake.sources.tables import table
from carelake.streaming import feedback_stream as stream

DIRTY = """SELECT * REPLACE (
  CASE WHEN patient_id % 31 = 0 THEN CAST('NaN' AS DOUBLE) WHEN patient_id % 37 = 0 THEN CAST('Infinity' AS DOUBLE)
       WHEN patient_id % 41 = 0 THEN CAST('-Infinity' AS DOUBLE) ELSE glukoza_u_krvi END AS glukoza_u_krvi,
  CASE WHEN patient_id % 43 = 0 THEN 'n/a' WHEN patient_id % 59 = 0 THEN ' ' ELSE CAST(BMI AS VARCHAR) END AS BMI) FROM patients_raw"""
#: What the dirty columns read as.
READ = """SELECT * REPLACE (
  CASE WHEN isfinite(glukoza_u_krvi) THEN glukoza_u_krvi END AS glukoza_u_krvi, TRY_CAST(BMI AS DOUBLE) AS BMI) FROM dirty"""


def patients_dirty(spark, sf_dir):
    raw = patients_raw(spark, sf_dir)
    k = F.col("patient_id")
    number = lambda text: F.lit(float(text))
    glucose = F.when(k % 31 == 0, number("nan")).when(k % 37 == 0, number("inf")).when(k % 41 == 0, number("-inf")).otherwise(F.col("glukoza_u_krvi"))
    bmi = F.when(k % 43 == 0, "n/a").when(k % 59 == 0, " ").otherwise(F.col("BMI").cast("string"))
    return raw.withColumns({"glukoza_u_krvi": glucose, "BMI": bmi})


def _dirty_sql(body: str) -> str:
    return with_views("patients_raw", f", dirty AS ({DIRTY}), clean AS ({READ}) {body}")


_CLASS = " ".join(f"WHEN g >= {lo} AND g < {hi if hi != cfg.INF else '1e300'} THEN '{name}'" for name, lo, hi in cfg.BANDS["glukoza"])


@query("classify_dirty", _dirty_sql(f"""SELECT patient_id, CASE WHEN g IS NULL OR g <= 0 THEN NULL {_CLASS} ELSE '{cfg.UNKNOWN_CLASS}' END AS class_glukoza
FROM (SELECT patient_id, glukoza_u_krvi AS g FROM clean) c"""))
def classify_dirty(spark, sf_dir):
    bands = {"glukoza": cfg.BANDS["glukoza"]}
    return risk.with_classes(patients_dirty(spark, sf_dir), bands).select("patient_id", "class_glukoza")


@query("impute_dirty", _dirty_sql(""", m AS (SELECT quantile_cont(glukoza_u_krvi, 0.5) AS g, quantile_cont(BMI, 0.5) AS b FROM clean)
SELECT patient_id, coalesce(glukoza_u_krvi, (SELECT g FROM m)) AS glukoza_u_krvi, coalesce(BMI, (SELECT b FROM m)) AS BMI FROM clean"""))
def impute_dirty(spark, sf_dir):
    return clean.impute_median(patients_dirty(spark, sf_dir), ["glukoza_u_krvi", "BMI"]).select("patient_id", "glukoza_u_krvi", "BMI")


@query("missing_dirty", _dirty_sql("""SELECT patient_id, list_aggregate(list_filter([CASE WHEN glukoza_u_krvi IS NULL THEN 'glukoza_u_krvi' END,
  CASE WHEN dob IS NULL THEN 'dob' END], lambda x: x IS NOT NULL), 'string_agg', ',') AS missing FROM clean"""))
def missing_dirty(spark, sf_dir):
    names = F.array_join(clean.missing_fields(["glukoza_u_krvi", "dob"]), ",")
    return patients_dirty(spark, sf_dir).select("patient_id", F.when(names != "", names).alias("missing"))


@query("score_batch_errors", _dirty_sql(", u AS (SELECT d.patient_id, "
       + "concat_ws(', ', " + ", ".join(f"CASE WHEN d.{c} IS NULL THEN '{c}' END" for c in cfg.FEATURES) + ") AS gone, "
       + "concat_ws(', ', " + ", ".join(f"CASE WHEN d.{c} IS NOT NULL AND c.{c} IS NULL THEN '{c}' END" for c in cfg.FEATURES) + ") AS odd "
       + """FROM dirty d JOIN clean c USING (patient_id))
SELECT patient_id, nullif(concat_ws('; ', CASE WHEN gone <> '' THEN concat('missing: ', gone) END, CASE WHEN odd <> '' THEN concat('not a number: ', odd) END), '') AS error,
  gone = '' AND odd = '' AS scored FROM u"""))
def score_batch_errors(spark, sf_dir):
    """Every request gets a row; a bad one names its fields and stops no other."""
    train, _ = models.train_test(models.labelled(patients(spark, sf_dir)))
    out = models.score_batch(models.train_forest(train), patients_dirty(spark, sf_dir))
    return out.select("patient_id", "error", F.col("risk_level").isNotNull().alias("scored"))


@query("quantiles_outlier", """WITH v AS (SELECT CASE WHEN l_orderkey = 1 AND l_linenumber = 1 THEN 1e12 ELSE CAST(l_extendedprice AS DOUBLE) END AS v FROM lineitem)
SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS p, round(unnest(quantile_cont(v, [0.0, 0.25, 0.5, 0.75, 1.0])), 6) AS value FROM v""")
def quantiles_outlier(spark, sf_dir):
    """One value far out of the range of all others."""
    odd = (F.col("l_orderkey") == 1) & (F.col("l_linenumber") == 1)
    rows = table(spark, sf_dir, "lineitem").select(F.when(odd, F.lit(1e12)).otherwise(F.col("l_extendedprice").cast("double")).alias("v"))
    return ranks.exact_quantiles(rows, ["v"], [0.0, 0.25, 0.5, 0.75, 1.0]).select("p", F.round("value", 6).alias("value"))


@query("histogram_dirty", _dirty_sql(""", s AS (SELECT min(glukoza_u_krvi) AS lo, max(glukoza_u_krvi) AS hi FROM clean),
b AS (SELECT least(CAST(floor((glukoza_u_krvi - lo) / ((hi - lo) / 10)) AS INTEGER) + 1, 10) AS bin FROM clean, s WHERE glukoza_u_krvi IS NOT NULL)
SELECT CAST(r AS INTEGER) AS bin, count(b.bin) AS n FROM range(1, 11) t(r) LEFT JOIN b ON b.bin = r GROUP BY r"""))
def histogram_dirty(spark, sf_dir):
    return profile.histogram(patients_dirty(spark, sf_dir), ["glukoza_u_krvi"], bins=10).select("bin", "n")


@query("feedback_daily_stream", """SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS total_feedback,
  count(*) FILTER (event_type <> 'error') AS agreed_with_model, count(*) FILTER (event_type = 'error') AS pending_correction FROM events GROUP BY 1""")
def feedback_daily_stream(spark, sf_dir):
    daily = stream.daily_once(spark, sf_dir)
    return daily.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "total_feedback", "agreed_with_model", "pending_correction")


_LABELLED = """f AS (SELECT e.*, """ + " AND ".join(f"p.{c} IS NOT NULL" for c in cfg.FEATURES) + """ AS whole,
    CASE WHEN c.correct_risk IS NOT NULL THEN CASE c.correct_risk WHEN 'High' THEN 1 ELSE 0 END
         WHEN e.event_type <> 'error' THEN CASE WHEN e.event_id % 3 = 0 THEN 1 ELSE 0 END END AS label
  FROM events e LEFT JOIN patients_raw p ON p.patient_id = e.user_id
  LEFT JOIN (SELECT event_id, CASE WHEN value > 50 THEN 'High' ELSE 'Low' END AS correct_risk FROM events WHERE event_type = 'error' AND event_id % 2 = 0) c USING (event_id))"""


@query("feedback_loop", with_views("patients", f""", {_LABELLED}
SELECT count(*) AS new_samples, count(label) AS labelled_feedback, count(*) FILTER (label IS NOT NULL AND whole) AS feedback_used,
  count(*) FILTER (label IS NOT NULL AND whole) + (SELECT count(*) FROM patients) AS total_samples,
  count(*) FILTER (label IS NULL OR NOT whole) AS still_new, TRUE AS scored_all FROM f"""))
def feedback_loop(spark, sf_dir):
    """Stream in, correct, retrain, write the log back, score with the model that is now current."""
    people, base = patients(spark, sf_dir), run_dir(spark, "feedback-loop")
    live = stream.with_measurements(stream.submissions(spark, sf_dir), patients_raw(spark, sf_dir))
    stream.start_ingest(live, f"{base}/log", f"{base}/checkpoint").awaitTermination()
    log = spark.read.parquet(f"{base}/log")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'error' AND event_id % 2 = 0")
    answers = events.select(F.col("event_id").alias("feedback_id"), F.when(F.col("value") > 50, "High").otherwise("Low").alias("correct_risk"), "ts")
    earlier = answers.withColumns({"correct_risk": F.when(F.col("correct_risk") == "High", "Low").otherwise("High"), "ts": F.expr("ts - INTERVAL 1 DAY")})
    fixed = feedback.apply_corrections(log, answers.unionByName(earlier), "feedback_id", "ts")
    result, updated = models.retrain(people, fixed, f"{base}/models", logs=f"{base}/logs")
    scored = models.score_batch(models.current_model(spark, f"{base}/models"), people)
    n = people.count()
    return result.select(
        "new_samples", "labelled_feedback", "feedback_used", "total_samples",
        F.lit(updated.where("NOT trained").count()).cast("bigint").alias("still_new"), F.lit(scored.where("risk_level IS NOT NULL").count() == n).alias("scored_all"),
    )


@query("feature_importance_check", "SELECT " + str(len(cfg.FEATURES)) + "::BIGINT AS features, TRUE AS sums_to_one, TRUE AS named")
def feature_importance_check(spark, sf_dir):
    train, _ = models.train_test(models.labelled(patients(spark, sf_dir)))
    found = models.grown_importance(models.grown_forest(train), spark)
    return found.agg(
        F.count("*").alias("features"), (F.abs(F.sum("importance") - 1) < 1e-9).alias("sums_to_one"),
        (F.sort_array(F.collect_set("feature")) == F.sort_array(F.array(*[F.lit(c) for c in cfg.FEATURES]))).alias("named"),
    )


@query("model_run_check", with_views("patients", f"""SELECT '1.0' AS version, (SELECT count(*) FROM patients) AS samples, {len(cfg.FEATURES)}::INTEGER AS n_features,
  '{",".join(cfg.FEATURES)}' AS feature_names, {cfg.FOREST["numTrees"]}::INTEGER AS n_trees, {cfg.FOREST["maxDepth"]}::INTEGER AS max_depth"""))
def model_run_check(spark, sf_dir):
    """The run log without its time."""
    rows, path = models.labelled(patients(spark, sf_dir)), run_dir(spark, "model-runs")
    models.log_run(spark, path, "1.0", rows.count(), models.train_forest(rows))
    return spark.read.parquet(path).select("version", "samples", "n_features", "feature_names", "n_trees", "max_depth")


@query("rf_metrics_check", "SELECT TRUE AS counts_add_up, TRUE AS accuracy_agrees, TRUE AS better_than_guessing")
def rf_metrics_check(spark, sf_dir):
    train, test = models.train_test(models.labelled(patients(spark, sf_dir)))
    n = test.count()
    guess = test.agg(F.greatest(F.avg("label"), 1 - F.avg("label"))).first()[0]
    r = models.grown_forest_report(models.grown_forest(train), test)
    right = (F.col("tp") + F.col("tn")) / F.lit(n)
    return r.select(
        (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp") == n).alias("counts_add_up"),
        (F.abs(F.col("accuracy") - right) < 1e-9).alias("accuracy_agrees"), (F.col("accuracy") > guess).alias("better_than_guessing"),
    )


@query("retrain_marks", with_views("feedback", ", " + with_views("patients_raw", "")[5:] + """ SELECT feedback_id,
  CASE WHEN feedback_risk IS NOT NULL AND """ + " AND ".join(f"{c} IS NOT NULL" for c in cfg.FEATURES) + " THEN TRUE ELSE trained END AS trained FROM feedback JOIN patients_raw USING (patient_id)"))
def retrain_marks(spark, sf_dir):
    """Exactly the rows that a retraining uses are marked."""
    return feedback.mark_trained(_full_log(spark, sf_dir), features=cfg.FEATURES).select("feedback_id", "trained")
