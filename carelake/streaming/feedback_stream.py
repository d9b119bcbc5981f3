"""Feedback as a stream: continuous ingest and running statistics.

Ingest is stateless. The file source and the file sink with a checkpoint are exactly-once together, so
a restarted query neither loses nor repeats a row, and no watermark can drop a late one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from carelake.operators.feedback import agreed_label, feedback_stats
from carelake.plans import clinical as cfg
from carelake.session import run_dir
from carelake.sources.tables import table


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream of submissions read from the event files as they arrive."""
    stream = (
        spark.readStream.schema(table(spark, sf_dir, "events").schema)
        .option("pathGlobFilter", "events*.parquet")
        .parquet(sf_dir)
    )
    return stream.select(
        F.col("event_id").alias("feedback_id"),
        F.col("user_id").alias("patient_id"),
        F.col("ts").cast("timestamp").alias("submitted_at"),
        F.when(F.col("event_id") % 3 == 0, "High").otherwise("Low").alias("original_prediction"),
        (F.col("event_type") != "error").alias("user_confirmation"),
    )


def label_submissions(stream: DataFrame) -> DataFrame:
    return stream.withColumns(
        {
            "feedback_risk": agreed_label(F.col("original_prediction"), F.col("user_confirmation")),
            "trained": F.lit(False),
        }
    )


def with_measurements(stream: DataFrame, people: DataFrame, key: str = "patient_id") -> DataFrame:
    """Submissions with the measurements they were made on, so that the log can be trained on."""
    return stream.join(people.select(key, *cfg.FEATURES), key, "left")


def start_ingest(stream: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append to the log; ``every`` is a processing interval, without one all that is there is taken once."""
    return (
        label_submissions(stream)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(every))
        .start()
    )


def _trigger(every: str | None) -> dict:
    return {"processingTime": every} if every else {"availableNow": True}


def start_daily_stats(stream: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Submissions, agreements and corrections in tumbling days. The state is one row for each day, and no row is late."""
    day = F.window("submitted_at", "1 day")
    daily = label_submissions(stream).groupBy(day).agg(
        F.count(F.lit(1)).alias("total_feedback"), F.count_if("user_confirmation").alias("agreed_with_model"),
        F.count_if(F.col("feedback_risk").isNull()).alias("pending_correction"),
    )

    def publish(batch: DataFrame, _: int) -> None:
        batch.select(F.col("window.start").alias("day"), "total_feedback", "agreed_with_model", "pending_correction").write.mode("overwrite").parquet(out)

    return (
        daily.writeStream.outputMode("complete").foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(**_trigger(every)).start()
    )


def start_running_stats(stream: DataFrame, out: str, checkpoint: str, threshold: int = cfg.RETRAIN_THRESHOLD, every: str | None = None) -> StreamingQuery:
    """Keep one row of statistics current; the state is that one row."""

    def publish(batch: DataFrame, _: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(out)

    return (
        feedback_stats(label_submissions(stream), threshold)
        .writeStream.outputMode("complete")
        .foreachBatch(publish)
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(every))
        .start()
    )


def ingest_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = run_dir(spark, "feedback-ingest")
    start_ingest(submissions(spark, sf_dir), f"{base}/log", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/log")


def stats_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = run_dir(spark, "feedback-stats")
    start_running_stats(submissions(spark, sf_dir), f"{base}/stats", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/stats")


def daily_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = run_dir(spark, "feedback-daily")
    start_daily_stats(submissions(spark, sf_dir), f"{base}/stats", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/stats")
