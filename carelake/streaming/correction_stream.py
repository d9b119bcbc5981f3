"""Corrections joined to pending feedback as both arrive, with state and a timer for each feedback id.

A pending row (the user disagreed and gave no label) waits for a correction for ``wait`` after it was submitted. With one in time it
leaves as ``corrected``, otherwise its timer lets it leave as ``expired`` without a label. A correction that comes first waits as
long for its pending row. Of the corrections that are there when a row is resolved the latest counts, on a tie the greatest text.
The state outlives the answer until the timer, so repeated pending rows and corrections do nothing. Rows behind the watermark
(``delay`` behind the newest row) are late and dropped by the engine. State is a few values for each id that is open.

The ids are dealt over ``BUCKETS`` groups, so that a call of the state function serves many ids; a group's timer is the earliest of its ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from carelake.session import run_dir
from carelake.sources.tables import table

RECORD = "feedback_id long, at timestamp, pending boolean, correct_risk string"
OUT = "feedback_id long, feedback_risk int, status string"
STATE = "ids array<long>, pending_ms array<long>, correct_ms array<long>, correct_risk array<string>, done array<boolean>, timer_ms array<long>"
BUCKETS = 1024


def records(pending: DataFrame, corrections: DataFrame) -> DataFrame:
    """One stream of (feedback_id, submitted_at) and (feedback_id, corrected_at, correct_risk)."""
    none = F.lit(None).cast("string")
    first = pending.select("feedback_id", F.col("submitted_at").alias("at"), F.lit(True).alias("pending"), none.alias("correct_risk"))
    return first.unionByName(corrections.where("correct_risk IS NOT NULL").select("feedback_id", F.col("corrected_at").alias("at"), F.lit(False).alias("pending"), "correct_risk"))


def _resolve(wait_ms: int):
    def run(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # by id: pending, corrected, risk, done, timer
        open_ = {i: v for i, *v in zip(*state.get, strict=True)} if state.exists else {}
        now, seen, answers = state.getCurrentWatermarkMs(), {}, []
        for part in () if state.hasTimedOut else parts:
            ms = part["at"].astype("datetime64[ms]").astype("int64")
            ids = (None if pd.isna(i) else int(i) for i in part["feedback_id"].array)
            for i, t, is_pending, risk in zip(ids, ms.tolist(), part["pending"].tolist(), part["correct_risk"].tolist(), strict=True):
                if i not in seen:
                    seen[i] = open_.pop(i, [-1, -1, "", False, 0])
                v = seen[i]
                if is_pending:
                    v[0] = min(t, v[0]) if v[0] >= 0 else t
                elif not v[3]:
                    v[1], v[2] = max((v[1], v[2]), (t, risk))
        for i, (pending, _, _, done, timer) in list(open_.items()):
            if timer < now:
                if pending >= 0 and not done:
                    answers.append((i, None, "expired"))
                del open_[i]
        for i, v in seen.items():
            if v[0] >= 0 and v[1] >= 0 and not v[3]:
                answers.append((i, int(v[2] == "High"), "corrected"))
                v[3] = True
            v[4] = max((v[0] if v[0] >= 0 else v[1]) + wait_ms, now + 1)
        open_.update(seen)
        if open_:
            state.update(tuple(map(list, zip(*((i, *v) for i, v in open_.items()), strict=True))))
            state.setTimeoutTimestamp(max(min(v[4] for v in open_.values()), now + 1))
        elif state.exists:
            state.remove()
        if answers:
            yield pd.DataFrame(answers, columns=["feedback_id", "feedback_risk", "status"]).astype({"feedback_id": "Int64", "feedback_risk": "Int32"})

    return run


def resolved(stream: DataFrame, delay: str = "2 days", wait_ms: int = 3 * 86_400_000, buckets: int = BUCKETS) -> DataFrame:
    """Each pending row once, when it is corrected or its time is over: feedback_id, feedback_risk, status."""
    # unknown ids have a group of their own, as a column with nulls would be read as numbers that are not whole
    bucket = F.coalesce(F.when(F.col("feedback_id").isNotNull(), F.pmod(F.xxhash64("feedback_id"), F.lit(buckets))), F.lit(-1))
    grouped = stream.withWatermark("at", delay).withColumn("bucket", bucket).groupBy("bucket")
    return grouped.applyInPandasWithState(_resolve(wait_ms), OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def start_resolving(stream: DataFrame, out: str, checkpoint: str, every: str | None = None, **settings) -> StreamingQuery:
    """Append resolved rows to a folder; without an interval all that is there is taken once, and a later start goes on from there."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return resolved(stream, **settings).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(**trigger).start()


def waves(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Feedback on the events in three deliveries: with repeated rows, with corrections that are late, and old rows once more."""
    events = table(spark, sf_dir, "events").where("event_type = 'error'").selectExpr(
        "event_id AS feedback_id", "CAST(ts AS TIMESTAMP) AS submitted_at", "CAST(ts AS TIMESTAMP) + INTERVAL 1 HOUR AS corrected_at",
        "CASE WHEN value > 50 THEN 'High' ELSE 'Low' END AS correct_risk",
    )

    def part(where: str, corrected: str) -> DataFrame:
        return records(events.where(where), events.where(corrected))

    first = part("submitted_at < '2024-01-16'", "submitted_at < '2024-01-16' AND feedback_id % 3 = 0")
    second = part("submitted_at >= '2024-01-16' AND submitted_at < '2024-01-25'",
                  "(submitted_at >= '2024-01-16' AND submitted_at < '2024-01-25' AND feedback_id % 3 = 0) OR (submitted_at < '2024-01-16' AND feedback_id % 3 = 1)")
    third = part("submitted_at >= '2024-01-25'", "submitted_at >= '2024-01-25' AND feedback_id % 3 = 0")
    again = first.where("feedback_id % 5 = 0")
    return [first.unionByName(again), second, third.unionByName(again)]


def resolve_waves(spark: SparkSession, deliveries: list[DataFrame], **settings) -> DataFrame:
    """Take each delivery as it arrives, with a restart in between, and read what has been resolved."""
    base = run_dir(spark, "corrections")
    for i, rows in enumerate(deliveries):
        rows.write.parquet(f"{base}/in/wave={i}")
        stream = spark.readStream.schema(f"{RECORD}, wave int").parquet(f"{base}/in").drop("wave")
        start_resolving(stream, f"{base}/out", f"{base}/checkpoint", **settings).awaitTermination()
    return spark.read.schema(OUT).parquet(f"{base}/out")
