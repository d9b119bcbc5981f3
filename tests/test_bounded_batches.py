"""Tasks hand on windows and probed queries in parts, whatever the size of a batch."""

import numpy as np
import pyarrow as pa

from carelake.operators import corpus, retrieve
from carelake.plans import clinical as cfg


def test_windows_are_handed_on_in_parts(spark, monkeypatch):
    texts = ["Word one two. " * n for n in (0, 1, 50, 400, 3, 900)] * 20 + [None]
    monkeypatch.setattr(corpus, "PART_CHARS", 20_000)
    given = (cfg.CHUNK_SIZE, cfg.CHUNK_OVERLAP, list(cfg.CHUNK_SEPARATORS), True)
    parts = list(corpus._cut_in_parts(pa.array(texts), *given))
    assert len(parts) > 10 and [len(w) for p in parts for w in p.to_pylist()].count(0) == 21
    most = max(sum(len(w["text"]) for w in ws) for p in parts for ws in p.to_pylist())
    assert all(sum(len(w["text"]) for ws in p.to_pylist() for w in ws) < 20_000 + most for p in parts)
    assert len(list(corpus._cut_in_parts(pa.array([], pa.string()), *given))) == 1
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    got = sorted((r["doc_id"], r["window_id"], r["start"], r["end"]) for r in corpus.chunk_windows(docs, ["doc_id"], tail=True).collect())
    expected = []
    for i, t in enumerate(texts):
        bounds = corpus.window_bounds(t, *given) if len(t or "") >= cfg.CHUNK_SIZE else [(0, len(t))] if t else []
        expected += [(i, w, s, e) for w, (s, e) in enumerate(bounds)]
    assert got == sorted(expected)


def test_probed_queries_are_copied_in_parts(spark, monkeypatch):
    rows = np.random.default_rng(1).normal(size=(300, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>").coalesce(1)
    queries, sizes = df.withColumnRenamed("vec_id", "query_id"), []
    whole = sorted(map(tuple, retrieve.top_k_probed(df, queries, 5, "vec_id", "query_id", cells=6, probes=4).select("query_id", "vec_id", "rank").collect()))
    monkeypatch.setattr(retrieve, "PROBED_ROWS", 40)
    seen = retrieve._tiled

    def counted(c, q, *more):
        sizes.extend(b for b in q.mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int32())}) for b in bs), "n int").toPandas()["n"])
        return seen(c, q, *more)

    monkeypatch.setattr(retrieve, "_tiled", counted)
    parts = sorted(map(tuple, retrieve.top_k_probed(df, queries, 5, "vec_id", "query_id", cells=6, probes=4).select("query_id", "vec_id", "rank").collect()))
    assert parts == whole and sum(sizes) == 1200
