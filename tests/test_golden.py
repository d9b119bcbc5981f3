"""Known records with hand-checked results, and a replay of a feedback log by its published counts."""

import pytest
from pyspark.sql import functions as F

from carelake.functions.columns import fahrenheit_to_celsius
from carelake.operators import clean, feedback, risk
from carelake.plans import clinical as cfg

RECORDS = [
    # name, age, systolic, diastolic, glucose, temp, BMI, past, diabetes, gestational, mental, pulse
    ("sugar", 32, 145, 95, 9.2, 36.8, 28.5, 0, 0, 1, 0, 88),
    ("weight", 28, 118, 76, 5.1, 36.6, 36.2, 0, 0, 0, 1, 78),
    ("healthy", 25, 112, 72, 4.8, 36.6, 22.4, 0, 0, 0, 0, 74),
    ("border", 30, 120, 80, 4.5, 36.6, 24.0, 0, 0, 0, 0, 80),
    ("older", 41, 112, 72, 4.8, 36.6, 22.4, 0, 0, 0, 0, 74),
    ("worst", 50, 190, 80, 11.0, 38.0, 35.0, 1, 1, 1, 1, 100),
    ("mild", 30, 112, 72, 6.0, 36.6, 22.4, 0, 0, 0, 0, 74),
]
SCHEMA = (
    "patient_id string, dob int, sistolicki_krvni_tlak int, dijastolicki_krvni_tlak int, glukoza_u_krvi double, "
    "tjelesna_temp double, BMI double, komplikacije_u_proslosti int, dijabetes int, gestacijski_dijabetes int, "
    "mentalno_zdravlje int, otkucaji_srca int"
)


@pytest.fixture(scope="module")
def people(spark):
    return risk.with_classes(spark.createDataFrame(RECORDS, SCHEMA))


def _by_id(df, value):
    return {r["patient_id"]: r[value] for r in df.collect()}


def test_factors_and_totals(people):
    slots = risk.factor_slots()
    rows = _by_id(
        people.select("patient_id", F.transform(risk.factors_column(slots), lambda f: F.concat_ws(" ", f["factor"], f["weight"])).alias("f")), "f"
    )
    assert rows["sugar"] == ["glukoza_visoka 3", "gestacijski_dijabetes 3", "hipertenzija_1 3", "prekomjerna_tezina 1"]
    assert rows["weight"] == ["gojaznost_teska 3", "mentalno_zdravlje 2"]
    assert rows["healthy"] == rows["border"] == rows["mild"] == []
    totals = _by_id(people.select("patient_id", risk.weight_column(slots).alias("t")), "t")
    assert totals == {"sugar": 10, "weight": 5, "healthy": 0, "border": 0, "older": 0, "worst": 27, "mild": 0}
    assert totals["worst"] == cfg.MAX_WEIGHT


def test_corrected_glucose_rule(people):
    totals = _by_id(people.select("patient_id", risk.weight_column(risk.factor_slots(strict=False)).alias("t")), "t")
    assert totals["mild"] == 2
    normal = _by_id(people.select("patient_id", risk.normal_params_column(strict=False).alias("n")), "n")
    assert "glukoza" not in normal["mild"] and "glukoza" in normal["healthy"]


def test_query_texts(people):
    texts = _by_id(people.select("patient_id", risk.query_text_column(risk.factor_slots(), F.col("dob")).alias("q")), "q")
    assert texts["healthy"] == "zdrava trudnoća prenatalna njega preporuke antenatalna zaštita redovni pregledi"
    assert texts["older"].startswith("trudnoća starosna dob 41 preporuke praćenje zdrava")
    assert texts["sugar"].startswith("povišena glukoza 9.2 mmol/L gestacijski dijabetes kontrola")
    assert "blaga hipertenzija trudnoća 145/95 mmHg praćenje" in texts["sugar"]


def test_search_plan_order(people):
    slots = risk.factor_slots()
    plan = risk.multi_query_plan(people, "patient_id", risk.factors_column(slots), risk.query_text_column(slots, F.col("dob")))
    rows = plan.where("patient_id = 'sugar'").orderBy("query_ord").collect()
    assert [r["weight"] for r in rows] == [3, 3, 3, 1, 1]
    assert [r["query_text"].split(" povišena")[0] for r in rows[:4]] == [
        "glukoza visoka", "gestacijski dijabetes", "hipertenzija 1", "prekomjerna tezina"
    ]
    assert rows[4]["query_text"].startswith("povišena glukoza")


def test_missing_measurements_are_no_factors(spark):
    empty = spark.createDataFrame([("x",) + (None,) * 11], SCHEMA)
    row = risk.with_classes(empty).select(
        risk.weight_column(risk.factor_slots()).alias("t"), risk.summary_column(risk.factor_slots()).alias("s"),
        F.size(clean.missing_fields(cfg.FEATURES)).alias("m"),
    ).first()
    assert (row["t"], row["m"]) == (0, 11) and row["s"] == cfg.SUMMARY_NONE


def test_feedback_log_counts(spark):
    # prediction, agreed, risk, rows; the first 33 rows are trained
    log = [("Low", True, 0, 24), ("High", True, 1, 11), ("Low", False, 1, 6), ("Low", False, 0, 2), ("High", False, 0, 3), ("High", False, 1, 1)]
    rows = [(p, a, r) for p, a, r, n in log for _ in range(n)]
    df = spark.createDataFrame(
        [(p, a, r, i < 33) for i, (p, a, r) in enumerate(rows)],
        "original_prediction string, user_confirmation boolean, feedback_risk int, trained boolean",
    )
    stats = feedback.feedback_stats(df).first().asDict()
    assert stats == {
        "total_feedback": 47, "agreed_with_model": 35, "disagreed_with_model": 12, "pending_correction": 0,
        "trained_samples": 33, "new_samples_pending": 14, "retrain_threshold": 10, "needs_retraining": True,
    }
    assert feedback.feedback_breakdown(df).count() == 6
    assert feedback.retrain_gate(df, threshold=15).first()["retrain"] is False
    assert feedback.retrain_gate(df, threshold=15, force=True).first()["retrain"] is True


def test_unknown_target_stops(spark):
    df = spark.createDataFrame([("Low",), ("Medium",)], "nivo_rizika string")
    assert clean.unknown_targets(df, "nivo_rizika", cfg.TARGET_CODES).first()["nivo_rizika"] == "Medium"
    with pytest.raises(Exception, match="unknown target value: Medium"):
        df.select(clean.encode_target(F.col("nivo_rizika"), cfg.TARGET_CODES)).collect()


def test_celsius(spark):
    row = spark.range(1).select(fahrenheit_to_celsius(F.lit(98.6)).alias("a"), fahrenheit_to_celsius(F.lit(100.4)).alias("b")).first()
    assert (row["a"], row["b"]) == (37.0, 38.0)
