from datetime import datetime, timedelta

from carelake.streaming import correction_stream as S

START = datetime(2024, 1, 1)


def delivery(spark, rows):
    """Rows (id, hours, risk); without a risk a pending row."""
    data = [(i, START + timedelta(hours=h), r is None, r) for i, h, r in rows]
    return spark.createDataFrame(data, S.RECORD)


def test_corrections_meet_pending_rows(spark):
    one = delivery(spark, [
        (1, 0, None), (1, 1, "High"), (1, 0, None),  # repeated pending row
        (2, 0, None), (2, 2, "High"), (2, 3, "Low"),  # the latest correction counts
        (3, 5, "Low"),  # a correction before its pending row
        (4, 0, None),  # never corrected
        (5, 4, None), (5, 4, "High"), (5, 4, "Low"),  # a tie goes to the greatest text
        (6, 40, None),  # corrected too late for the stream, see below
        (7, 90, None),
    ])
    two = delivery(spark, [
        (3, 44, None), (1, 60, "Low"), (1, 61, None),  # 1 is resolved already
        (6, 42, "High"),  # at the watermark of the first delivery (90 - 48 hours): late
        (7, 91, "Low"), (8, 200, None),
    ])
    three = delivery(spark, [(4, 10, "High"), (9, 400, None), (2, 3, "Low")])
    out = S.resolve_waves(spark, [one, two, three])
    got = sorted((r["feedback_id"], r["feedback_risk"], r["status"]) for r in out.collect())
    assert got == [
        (1, 1, "corrected"), (2, 0, "corrected"), (3, 0, "corrected"), (4, None, "expired"), (5, 0, "corrected"), (6, None, "expired"),
        (7, 0, "corrected"), (8, None, "expired"),
    ]


def test_no_rows(spark):
    assert S.resolve_waves(spark, [delivery(spark, [])]).count() == 0
