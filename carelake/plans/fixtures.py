"""Derived views over the given tables, as Spark frames and as the same views in SQL.

The row-wise views share one SQL text between both engines; everything computed by an operator
(unit conversion, medians, weights) is written twice, once per engine, so that the SQL checks it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelake.operators import clean, risk
from carelake.plans import clinical as cfg
from carelake.session import spread
from carelake.sources.tables import table

PATIENTS_RAW = """
SELECT t.*,
  CASE WHEN patient_id % 97 = 0 THEN NULL
       WHEN (COALESCE(glukoza_u_krvi, 0) >= 9.5 OR COALESCE(sistolicki_krvni_tlak, 0) >= 170
             OR COALESCE(BMI, 0) >= 38 OR gestacijski_dijabetes = 1) <> (patient_id % 23 = 0)
       THEN 'High' ELSE 'Low' END AS nivo_rizika
FROM (
  SELECT k AS patient_id,
    CASE WHEN k % 1009 = 0 THEN 325 WHEN k % 67 = 0 THEN NULL ELSE 12 + (k*37) % 43 END AS dob,
    CASE WHEN k % 53 = 0 THEN NULL ELSE 90 + (k*7919) % 101 END AS sistolicki_krvni_tlak,
    55 + (k*104729) % 61 AS dijastolicki_krvni_tlak,
    CASE WHEN k % 47 = 0 THEN NULL
         ELSE CAST(35 + (k*1299709) % 89 AS DOUBLE) / CAST(10 AS DOUBLE) END AS glukoza_u_krvi,
    CAST(965 + (k*611953) % 59 AS DOUBLE) / CAST(10 AS DOUBLE) AS tjelesna_temp,
    CASE WHEN k % 71 = 0 THEN NULL
         ELSE CAST(165 + (k*15485863) % 257 AS DOUBLE) / CAST(10 AS DOUBLE) END AS BMI,
    CASE WHEN k % 73 = 0 THEN NULL ELSE CASE WHEN (k*31) % 7 = 0 THEN 1 ELSE 0 END END AS komplikacije_u_proslosti,
    CASE WHEN k % 79 = 0 THEN NULL ELSE CASE WHEN (k*29) % 5 = 0 THEN 1 ELSE 0 END END AS dijabetes,
    CASE WHEN (k*17) % 11 = 0 THEN 1 ELSE 0 END AS gestacijski_dijabetes,
    CASE WHEN (k*19) % 13 = 0 THEN 1 ELSE 0 END AS mentalno_zdravlje,
    50 + (k*86028121) % 83 AS otkucaji_srca
  FROM (SELECT o_orderkey AS k FROM {orders}) o
) t
"""

FEEDBACK = """
SELECT event_id AS feedback_id, user_id AS patient_id, ts AS submitted_at,
  CASE WHEN event_id % 3 = 0 THEN 'High' ELSE 'Low' END AS original_prediction,
  event_type <> 'error' AS user_confirmation,
  CASE WHEN event_type <> 'error' THEN CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END
       WHEN event_id % 2 = 0 THEN NULL
       ELSE CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END END AS feedback_risk,
  CASE WHEN event_id % 29 = 0 THEN NULL ELSE ts < TIMESTAMP '2024-01-20 00:00:00' END AS trained
FROM {events}
"""


def patients_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PATIENTS_RAW, orders=spread(table(spark, sf_dir, "orders").select("o_orderkey")))


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.prepare_training(patients_raw(spark, sf_dir))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patients with a rule-based score, prediction and 0/1 label."""
    scored = risk.with_classes(patients(spark, sf_dir))
    total = risk.weight_column(risk.factor_slots())
    return scored.select(
        "patient_id",
        total.alias("total"),
        (total.cast("double") / F.lit(float(cfg.MAX_WEIGHT))).alias("score"),
        (total >= 10).cast("int").alias("prediction"),
        (F.col(cfg.TARGET) == "High").cast("int").alias("label"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FEEDBACK, events=table(spark, sf_dir, "events"))


# ---- the same views in SQL ---------------------------------------------------------------

_VIEWS: list[tuple[str, str]] = [
    ("patients_raw", PATIENTS_RAW.format(orders="orders")),
    (
        "celsius",
        "SELECT * REPLACE (round_even((tjelesna_temp - 32) * 5 / 9 * 100, 0) / 100 AS tjelesna_temp) FROM patients_raw",
    ),
    ("kept", "SELECT * FROM celsius WHERE nivo_rizika IS NOT NULL AND dob <> 325 AND dob BETWEEN 15 AND 50"),
    (
        "med",
        "SELECT " + ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS m{i}" for i, c in enumerate(cfg.VITALS)) + " FROM kept",
    ),
    (
        "patients",
        "SELECT patient_id, "
        + ", ".join(f"COALESCE(CAST({c} AS DOUBLE), (SELECT m{i} FROM med)) AS {c}" for i, c in enumerate(cfg.VITALS))
        + ", "
        + ", ".join(f"COALESCE({c}, 0) AS {c}" for c in cfg.FLAGS)
        + ", nivo_rizika FROM kept",
    ),
    (
        "totals",
        """SELECT *,
  CASE WHEN glukoza_u_krvi >= 11 THEN 4 WHEN glukoza_u_krvi >= 7.8 THEN 3 ELSE 0 END AS w_glucose,
  CASE WHEN sistolicki_krvni_tlak >= 180 OR dijastolicki_krvni_tlak >= 110 THEN 5
       WHEN sistolicki_krvni_tlak >= 160 OR dijastolicki_krvni_tlak >= 100 THEN 4
       WHEN sistolicki_krvni_tlak >= 140 OR dijastolicki_krvni_tlak >= 90 THEN 3
       WHEN sistolicki_krvni_tlak >= 130 OR dijastolicki_krvni_tlak >= 85 THEN 1 ELSE 0 END AS w_pressure,
  CASE WHEN BMI >= 35 THEN 3 WHEN BMI >= 30 THEN 2 WHEN BMI >= 25 THEN 1 ELSE 0 END AS w_bmi,
  CASE WHEN tjelesna_temp >= 38 THEN 3 WHEN tjelesna_temp >= 37.5 THEN 1 ELSE 0 END AS w_temp,
  CASE WHEN otkucaji_srca >= 100 THEN 2 WHEN otkucaji_srca < 60 THEN 1 ELSE 0 END AS w_heart
FROM patients""",
    ),
    (
        "weighted",
        """SELECT *, w_glucose + 3 * dijabetes + 3 * gestacijski_dijabetes + w_pressure + w_bmi + w_temp + w_heart
  + 2 * mentalno_zdravlje + 2 * komplikacije_u_proslosti AS total FROM totals""",
    ),
    (
        "classified",
        """SELECT patient_id, total, CAST(total AS DOUBLE) / CAST(27 AS DOUBLE) AS score,
  CASE WHEN total >= 10 THEN 1 ELSE 0 END AS prediction,
  CASE WHEN nivo_rizika = 'High' THEN 1 ELSE 0 END AS label FROM weighted""",
    ),
    ("feedback", FEEDBACK.format(events="events")),
]
_NEEDS = {
    "patients_raw": ["patients_raw"],
    "celsius": ["patients_raw", "celsius"],
    "kept": ["patients_raw", "celsius", "kept"],
    "patients": ["patients_raw", "celsius", "kept", "med", "patients"],
    "weighted": ["patients_raw", "celsius", "kept", "med", "patients", "totals", "weighted"],
    "classified": ["patients_raw", "celsius", "kept", "med", "patients", "totals", "weighted", "classified"],
    "feedback": ["feedback"],
}


def with_views(base: str, body: str) -> str:
    """``body`` with the CTE chain of a derived view in front; ``body`` may open further CTEs with a comma."""
    views = dict(_VIEWS)
    chain = ",\n".join(f"{n} AS ({views[n].strip()})" for n in _NEEDS[base])
    body = body.strip()
    return f"WITH {chain}\n{body}" if not body.startswith(",") else f"WITH {chain}{body}"
