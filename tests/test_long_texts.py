import random

import pytest

from carelake.operators import long_texts as L
from carelake.operators.corpus import window_bounds
from carelake.plans import clinical as cfg


def text(seed, n, kinds="ab. ?!;\né🙂"):
    r = random.Random(seed)
    return "".join(r.choice(kinds) for _ in range(n))


TEXTS = [
    text(1, 5000), text(2, 700, "abc"), text(3, 20_000, "abcdefgh. \n"), "x" * 9000, ". " * 4000, "", None, "short.", "y" * 600, text(4, 1201), text(5, 3000, "ab\n"),
    text(6, 2400), text(7, 1800) + ". ", "🙂. " * 1500,
]


@pytest.mark.parametrize("tail", [False, True])
@pytest.mark.parametrize("segment", [600, 601, 1700])
def test_segments_equal_the_serial_walk(spark, tail, segment):
    docs = spark.createDataFrame([(i % 9, f"k{i}", t) for i, t in enumerate(TEXTS)], "id int, name string, text string").repartition(3)
    got = sorted(tuple(r) for r in L.long_windows(docs, ["id", "name"], tail=tail, segment_chars=segment).collect())
    want = []
    for i, t in enumerate(TEXTS):
        if t and len(t) >= cfg.CHUNK_SIZE:
            spans = window_bounds(t, cfg.CHUNK_SIZE, cfg.CHUNK_OVERLAP, list(cfg.CHUNK_SEPARATORS), tail)
            want += [(i % 9, f"k{i}", w, a, b, t[a:b]) for w, (a, b) in enumerate(spans)]
    assert got == sorted(want)


def test_other_sizes_and_short_texts(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")
    for size, overlap in ((50, 0), (40, 39)):
        got = sorted(tuple(r) for r in L.all_windows(docs, ["id"], size=size, overlap=overlap, long_chars=1000, segment_chars=64).select("id", "window_id", "start", "end").collect())
        want = []
        for i, t in enumerate(TEXTS):
            spans = window_bounds(t, size, overlap, list(cfg.CHUNK_SEPARATORS), False) if t and len(t) >= size else [(0, len(t))] if t else []
            want += [(i, w, a, b) for w, (a, b) in enumerate(spans)]
        assert got == sorted(want)
    with pytest.raises(ValueError):
        L.long_windows(docs, ["id"], segment_chars=100)
    assert L.all_windows(docs.limit(0), ["id"]).count() == 0


def test_a_long_text_is_cut_by_many_tasks(spark):
    from pyspark.sql import functions as F

    unit = text(8, 50_000, "abcdefgh. \n")
    docs = spark.range(1).select("id", F.repeat(F.lit(unit), 2000).alias("text"))  # 100 million characters
    windows = L.all_windows(docs, ["id"])
    spread = windows.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count("*").alias("n"), F.max("end").alias("end")).collect()
    assert max(r["end"] for r in spread) == 100_000_000
    total = sum(r["n"] for r in spread)
    assert len(spread) >= 4 and max(r["n"] for r in spread) < 0.5 * total
    last = windows.agg(F.max("window_id"), F.count_distinct("window_id")).first()
    assert tuple(last) == (total - 1, total)
