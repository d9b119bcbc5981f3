"""The feedback log: labels, corrections, statistics and the retraining gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.functions.columns import absent, celsius
from carelake.operators.clean import complete_cases
from carelake.operators.ranks import one_row
from carelake.plans import clinical as cfg


def agreed_label(prediction: Column, agrees: Column) -> Column:
    """Code of the prediction when the user agrees; unknown until corrected otherwise."""
    return F.when(agrees, (prediction == "High").cast("int"))


def feedback_stats(df: DataFrame, threshold: int = cfg.RETRAIN_THRESHOLD) -> DataFrame:
    """Counts by state and the retraining signal; a row with an unknown ``trained`` mark is new."""
    is_new = ~F.coalesce(F.col("trained"), F.lit(False))
    return df.agg(
        F.count(F.lit(1)).alias("total_feedback"),
        F.count_if(F.col("user_confirmation")).alias("agreed_with_model"),
        F.count_if(~F.col("user_confirmation")).alias("disagreed_with_model"),
        F.count_if(F.col("feedback_risk").isNull()).alias("pending_correction"),
        F.count_if(F.col("trained")).alias("trained_samples"),
        F.count_if(is_new).alias("new_samples_pending"),
    ).select(
        "*",
        F.lit(threshold).alias("retrain_threshold"),
        (F.col("new_samples_pending") >= threshold).alias("needs_retraining"),
    )


def feedback_breakdown(df: DataFrame) -> DataFrame:
    return df.groupBy("original_prediction", "user_confirmation", "feedback_risk").agg(F.count(F.lit(1)).alias("n"))


def retrain_gate(df: DataFrame, threshold: int = cfg.RETRAIN_THRESHOLD, force: bool = False) -> DataFrame:
    """Whether to retrain, how many rows are new, and how many carry a label."""
    new = F.count_if(~F.coalesce(F.col("trained"), F.lit(False)))
    return df.agg(
        new.alias("new_samples"), F.count_if(F.col("feedback_risk").isNotNull()).alias("labelled_samples")
    ).withColumn("retrain", F.lit(force) | (F.col("new_samples") >= threshold))


def pending() -> Column:
    return ~F.col("user_confirmation") & F.col("feedback_risk").isNull()


def correct_last_pending(df: DataFrame, correct_risk: str, key: str, arrived: str) -> DataFrame:
    """Set the latest pending row, whichever patient it belongs to."""
    last = one_row(df.where(pending()).agg(F.max_by(key, F.struct(arrived, key)).alias("k")))["k"]
    code = 1 if correct_risk == "High" else 0
    return df.withColumn(
        "feedback_risk", F.when(F.col(key) == F.lit(last), F.lit(code)).otherwise(F.col("feedback_risk"))
    )


def apply_corrections(df: DataFrame, corrections: DataFrame, key: str, at: str | None = None) -> DataFrame:
    """Set pending rows from ``(key, correct_risk)``; rows that are not pending keep their label.

    Of several corrections of a key the latest by ``at`` counts, on a tie or without times the greatest text.
    """
    code = (F.col("correct_risk") == "High").cast("int")
    order = F.struct(*([at] if at else []), "correct_risk")
    last = corrections.where("correct_risk IS NOT NULL").groupBy(key).agg(F.max_by("correct_risk", order).alias("correct_risk"))
    joined = df.join(last, key, "left")
    fixed = F.when(pending() & F.col("correct_risk").isNotNull(), code).otherwise(F.col("feedback_risk"))
    return joined.withColumn("feedback_risk", fixed).select(df.columns)


def mark_trained(df: DataFrame, include_pending: bool = False, features: Sequence[str] = ()) -> DataFrame:
    """Mark the rows a retraining used; with ``include_pending`` also rows that had no label yet.

    A row with a missing one of ``features`` was not used and stays new.
    """
    used = F.lit(True) if include_pending else F.col("feedback_risk").isNotNull()
    if not include_pending:
        for c in features:
            used = used & ~absent(F.col(c))
    return df.withColumn("trained", F.when(used, F.lit(True)).otherwise(F.col("trained")))


def training_union(
    original: DataFrame, feedback: DataFrame, features: Sequence[str] = tuple(cfg.FEATURES), target: str = cfg.TARGET
) -> DataFrame:
    """Original rows and labelled, complete feedback rows with one 0/1 label and one temperature unit."""
    base = complete_cases(original, features).select(
        *features, (F.col(target) == "High").cast("int").alias("label"), F.lit("original").alias("origin")
    )
    temp = celsius(F.col("tjelesna_temp"), cfg.FAHRENHEIT_ABOVE)
    extra = complete_cases(feedback.where("feedback_risk IS NOT NULL").withColumn("tjelesna_temp", temp), features).select(
        *features, F.col("feedback_risk").cast("int").alias("label"), F.lit("feedback").alias("origin")
    )
    return base.unionByName(extra, allowMissingColumns=True)
