import pickle
import tracemalloc

import numpy as np

from carelake.llm import decontaminate as D
from carelake.llm.labelled import training_sample


def test_benchmark_blocks_stay_small():
    """16 MB of benchmark text: what is broadcast, and what its making takes."""
    r = np.random.default_rng(1)
    words = [f"word{i}" for i in range(50_000)]
    items = [(str(i), " ".join(words[j] for j in r.integers(0, 50_000, 400))) for i in range(4_400)]
    assert sum(len(t) for _, t in items) > 0.9 * D.BLOCK_BYTES
    tracemalloc.start()
    q = D.Queries(items)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 800 << 20 and len(pickle.dumps(q, 5)) < 160 << 20
    assert len(q.length) == len(np.unique(q.start)) and q.first[-1] == len(q.places) == sum(len(t.split()) - 9 for _, t in items)


def test_equal_windows_are_one():
    q = D.Queries([("a", "x y z"), ("b", "X, y z!"), ("c", " ".join("abcdefghijkl")), ("d", " ".join("bcdefghijk")), (None, ""), ("e", None), ("f", "x y")])
    groups = [sorted(map(tuple, q.places[a:b].tolist())) for a, b in zip(q.first, q.first[1:], strict=False)]
    assert sorted(groups) == sorted([[(0, 0), (1, 0)], [(2, 0)], [(2, 1), (3, 0)], [(2, 2)], [(6, 0)]])
    assert D.Queries([]).keys()[0].shape == (0, 4)


def test_training_samples_are_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(i, ("long " * 2000 if i % 7 == 0 else "short ") + str(i)) for i in range(200)] + [(3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(220)], "doc_id long, y int")
    texts, weights = training_sample(docs, labels.withColumnRenamed("y", "toxic"), "toxic", 1000, max_bytes=60_000)
    rows = texts.collect()
    for y in (0, 1):
        mine = [r["text"] or "" for r in rows if r["y"] == y]
        assert sum(map(len, mine)) <= 30_000 and sum(t.startswith("short") for t in mine) > 60
    whole, _ = training_sample(docs, labels.withColumnRenamed("y", "toxic"), "toxic", 1000)
    assert whole.count() > len(rows)
    none, w = training_sample(docs, labels.limit(0).withColumnRenamed("y", "toxic"), "toxic", 10)
    assert none.count() == 0 and w == {}
