"""Queries on sources, the feedback log and its streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from carelake.functions.columns import to_number
from carelake.operators import feedback as fb
from carelake.plans import clinical as cfg
from carelake.plans.fixtures import feedback, patients, patients_raw, with_views
from carelake.plans.registry import query
from carelake.session import run_dir
from carelake.sources import tables as src
from carelake.streaming import correction_stream
from carelake.streaming import feedback_stream as stream

# ---- sources ------------------------------------------------------------------------------


@query("scan_coerce", """SELECT o_orderkey, CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_totalprice END AS price,
  CAST(o_custkey AS DOUBLE) AS customer, o_orderpriority AS priority FROM orders""")
def scan_coerce(spark, sf_dir):
    path = run_dir(spark, "orders-csv")
    orders = src.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 19 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("price"),
        F.concat(F.lit(" "), F.col("o_custkey").cast("string")).alias("customer"),
        F.col("o_orderpriority").alias("prioritet"),
    )
    orders.write.option("header", True).csv(path)
    df = src.read_csv_table(
        spark, path, ["o_orderkey", "price", "customer", "prioritet"], ["price", "customer"], {"prioritet": "priority"}
    )
    return df.withColumn("o_orderkey", F.col("o_orderkey").cast("bigint"))


@query("props_number", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def props_number(spark, sf_dir):
    return src.table(spark, sf_dir, "events").select(
        "event_id", to_number(F.get_json_object("props", "$.k")).alias("k")
    )


@query("doc_assemble", """SELECT conv_id, count(*) AS n_pages, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS text
FROM conversations WHERE length(text) > 0 GROUP BY conv_id""")
def doc_assemble(spark, sf_dir):
    return src.assemble_documents(src.table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


# ---- log ----------------------------------------------------------------------------------


def _full_log(spark, sf_dir):
    """Feedback rows with the measurements of their patient (raw, so in Fahrenheit)."""
    features = patients_raw(spark, sf_dir).select("patient_id", *cfg.FEATURES)
    return feedback(spark, sf_dir).join(features, "patient_id").withColumn(
        "timestamp", F.col("submitted_at").cast("timestamp")
    )


@query("feedback_load", with_views("feedback", ", " + with_views("patients_raw", "")[5:] + "\nSELECT "
       + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cfg.FEATURES)
       + """, feedback_risk, original_prediction, user_confirmation, strftime(submitted_at, '%Y-%m-%dT%H:%M:%S.%f') AS submitted, trained
FROM feedback JOIN patients_raw USING (patient_id)"""))
def feedback_load(spark, sf_dir):
    path = run_dir(spark, "feedback-csv")
    src.append_feedback(_full_log(spark, sf_dir), path)
    log = src.read_feedback(spark, path)
    return log.select(
        *cfg.FEATURES, "feedback_risk", "original_prediction", "user_confirmation",
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("submitted"), "trained",
    )


_STATS = """count(*) AS total_feedback, count(*) FILTER (user_confirmation) AS agreed_with_model,
  count(*) FILTER (NOT user_confirmation) AS disagreed_with_model, count(*) FILTER (feedback_risk IS NULL) AS pending_correction,
  count(*) FILTER (trained) AS trained_samples, count(*) FILTER (NOT COALESCE(trained, FALSE)) AS new_samples_pending,
  10 AS retrain_threshold, count(*) FILTER (NOT COALESCE(trained, FALSE)) >= 10 AS needs_retraining"""


@query("feedback_stats", with_views("feedback", f"SELECT {_STATS} FROM feedback"))
def feedback_stats(spark, sf_dir):
    return fb.feedback_stats(feedback(spark, sf_dir))


@query("feedback_breakdown", with_views("feedback", """SELECT original_prediction, user_confirmation, feedback_risk, count(*) AS n
FROM feedback GROUP BY ALL"""))
def feedback_breakdown(spark, sf_dir):
    return fb.feedback_breakdown(feedback(spark, sf_dir))


@query("retrain_gate", with_views("feedback", """SELECT count(*) FILTER (NOT COALESCE(trained, FALSE)) AS new_samples,
  count(feedback_risk) AS labelled_samples, count(*) FILTER (NOT COALESCE(trained, FALSE)) >= 10 AS retrain FROM feedback"""))
def retrain_gate(spark, sf_dir):
    return fb.retrain_gate(feedback(spark, sf_dir))


@query("apply_correction", with_views("feedback", """, last AS (SELECT feedback_id FROM feedback WHERE NOT user_confirmation AND feedback_risk IS NULL
  ORDER BY submitted_at DESC, feedback_id DESC LIMIT 1)
SELECT feedback_id, CASE WHEN feedback_id = (SELECT feedback_id FROM last) THEN 1 ELSE feedback_risk END AS feedback_risk FROM feedback"""))
def apply_correction(spark, sf_dir):
    return fb.correct_last_pending(feedback(spark, sf_dir), "High", "feedback_id", "submitted_at").select(
        "feedback_id", "feedback_risk"
    )


@query("apply_corrections", with_views("feedback", """, c AS (SELECT event_id AS feedback_id, CASE WHEN value > 50 THEN 'High' ELSE 'Low' END AS correct_risk
  FROM events WHERE event_type = 'error')
SELECT f.feedback_id, CASE WHEN NOT user_confirmation AND feedback_risk IS NULL AND correct_risk IS NOT NULL
  THEN CASE correct_risk WHEN 'High' THEN 1 ELSE 0 END ELSE feedback_risk END AS feedback_risk FROM feedback f LEFT JOIN c USING (feedback_id)"""))
def apply_corrections(spark, sf_dir):
    corrections = src.table(spark, sf_dir, "events").where("event_type = 'error'").select(
        F.col("event_id").alias("feedback_id"), F.when(F.col("value") > 50, "High").otherwise("Low").alias("correct_risk")
    )
    fixed = fb.apply_corrections(feedback(spark, sf_dir), corrections, "feedback_id")
    return fixed.select("feedback_id", "feedback_risk")


@query("training_union", with_views("patients", ", " + with_views("feedback", "")[5:] + "\n, rows AS (SELECT "
       + ", ".join(cfg.FEATURES) + """, CASE WHEN nivo_rizika = 'High' THEN 1 ELSE 0 END AS label, 'original' AS origin FROM patients
UNION ALL SELECT """ + ", ".join(
           "CASE WHEN tjelesna_temp > 50 THEN round_even((tjelesna_temp - 32) * 5 / 9 * 100, 0) / 100 ELSE tjelesna_temp END"
           if c == "tjelesna_temp" else c for c in cfg.FEATURES)
       + ", feedback_risk, 'feedback' FROM feedback JOIN patients_raw USING (patient_id) WHERE feedback_risk IS NOT NULL AND "
       + " AND ".join(f"{c} IS NOT NULL" for c in cfg.FEATURES) + ") SELECT "
       + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cfg.FEATURES) + ", label, origin FROM rows"))
def training_union(spark, sf_dir):
    return fb.training_union(patients(spark, sf_dir), _full_log(spark, sf_dir))


@query("mark_trained", with_views("feedback", """SELECT feedback_id, CASE WHEN feedback_risk IS NOT NULL THEN TRUE ELSE trained END AS trained FROM feedback"""))
def mark_trained(spark, sf_dir):
    return fb.mark_trained(feedback(spark, sf_dir)).select("feedback_id", "trained")


# ---- streams ------------------------------------------------------------------------------

_INGESTED = """SELECT event_id AS feedback_id, user_id AS patient_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS submitted,
  CASE WHEN event_id % 3 = 0 THEN 'High' ELSE 'Low' END AS original_prediction, event_type <> 'error' AS user_confirmation,
  CASE WHEN event_type <> 'error' THEN CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END END AS feedback_risk, FALSE AS trained FROM events"""


@query("feedback_ingest", _INGESTED)
def feedback_ingest(spark, sf_dir):
    log = stream.ingest_once(spark, sf_dir)
    text = F.date_format("submitted_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("submitted")
    return log.select("feedback_id", "patient_id", text, "original_prediction", "user_confirmation", "feedback_risk", "trained")


@query("feedback_stats_stream", f"SELECT {_STATS} FROM ({_INGESTED}) i")
def feedback_stats_stream(spark, sf_dir):
    return stream.stats_once(spark, sf_dir)


_DAY = 86_400_000


@query("corrections_stream", f"""WITH e AS (SELECT event_id AS feedback_id, epoch_ms(ts) AS t, CASE WHEN value > 50 THEN 1 ELSE 0 END AS risk,
  CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 1 WHEN ts < TIMESTAMP '2024-01-25' THEN 2 ELSE 3 END AS wave FROM events WHERE event_type = 'error'),
mark AS (SELECT max(CASE WHEN wave = 1 THEN CASE WHEN feedback_id % 3 = 0 THEN t + 3600000 ELSE t END END) - {2 * _DAY} AS first,
  max(CASE WHEN feedback_id % 3 = 0 THEN t + 3600000 WHEN wave = 1 AND feedback_id % 3 = 1 THEN t + 3600000 ELSE t END) - {2 * _DAY} AS last FROM e),
r AS (SELECT feedback_id, risk, t + {3 * _DAY} < last AS over, feedback_id % 3 = 0 OR wave = 1 AND feedback_id % 3 = 1 AND t + 3600000 > first AS in_time FROM e, mark)
SELECT feedback_id, CASE WHEN in_time THEN risk END AS feedback_risk, CASE WHEN in_time THEN 'corrected' ELSE 'expired' END AS status FROM r WHERE in_time OR over""")
def corrections_stream(spark, sf_dir):
    """Corrections that meet their pending rows in a stream, among repeated and late ones."""
    return correction_stream.resolve_waves(spark, correction_stream.waves(spark, sf_dir))
