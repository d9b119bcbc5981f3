import numpy as np
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from carelake.operators import graph_index as G
from carelake.operators import retrieve
from carelake.sources.versions import VersionedIndex


def vectors(spark, m, name="id"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], f"{name} long, embedding array<double>").repartition(4)


@pytest.fixture(scope="module")
def clusters():
    r = np.random.default_rng(3)
    return r.normal(0, 1, (40, 16))[r.integers(0, 40, 3000)] + r.normal(0, 0.35, (3000, 16))


def reached(offsets, ends):
    seen, todo = {0}, [0]
    while todo:
        i = todo.pop()
        for j in ends[offsets[i] : offsets[i + 1]]:
            if j not in seen:
                seen.add(j)
                todo.append(j)
    return len(seen)


@pytest.mark.parametrize("kind", ["clusters", "equal", "islands", "one", "two"])
def test_every_row_can_be_reached(kind, clusters):
    r = np.random.default_rng(1)
    m = {"clusters": clusters[:800], "equal": np.ones((300, 4)), "one": np.ones((1, 4)), "two": np.eye(2),
         "islands": np.repeat(np.eye(6), 100, axis=0) + r.normal(0, 0.001, (600, 6))}[kind]
    offsets, ends = G.build_graph(m, degree=6, candidates=12)
    assert reached(offsets, ends.tolist()) == len(m)


def test_edges_stay_few(clusters):
    offsets, _ = G.build_graph(clusters[:1000])
    assert np.diff(offsets).mean() < 2 * G.DEGREE


@pytest.mark.parametrize("shard_rows", [G.SHARD_ROWS, 700])
def test_search_finds_nearly_all_with_few_distances(spark, clusters, tmp_path, shard_rows, monkeypatch):
    monkeypatch.setattr(G, "QUERY_BLOCK", 300)
    corpus = vectors(spark, clusters).unionByName(spark.createDataFrame([(9001, None), (9002, [])], "id long, embedding array<double>"))
    queries = vectors(spark, clusters[:500] + 0.01, "q")
    G.write_graph_index(corpus, str(tmp_path / "graph"), "id", shard_rows=shard_rows)
    found = G.graph_search(spark, str(tmp_path / "graph"), queries, 10, "id", "q")
    exact = retrieve.top_k(corpus, queries, 10, "id", "q")
    assert retrieve.recall(found.hits, exact, ["q", "id"]).first()["recall"] >= 0.95
    assert found.possible == 1_500_000 and found.computed < (0.4 if shard_rows > 3000 else 0.7) * found.possible
    both = found.hits.join(exact.select("q", "id", F.col("relevance").alias("r")), ["q", "id"])
    assert both.where("abs(relevance - r) > 1e-9").count() == 0
    assert found.hits.groupBy("q").count().where("count <> 10").count() == 0


def test_small_and_empty_indexes(spark, tmp_path):
    G.write_graph_index(vectors(spark, np.eye(3)), str(tmp_path / "three"), "id")
    hits = G.graph_search(spark, str(tmp_path / "three"), vectors(spark, np.eye(3), "q"), 5, "id", "q").hits
    assert hits.count() == 9 and {(r["q"], r["id"]) for r in hits.where("rank = 1").collect()} == {(0, 0), (1, 1), (2, 2)}
    G.write_graph_index(vectors(spark, np.eye(3)).limit(0), str(tmp_path / "none"), "id")
    assert G.graph_search(spark, str(tmp_path / "none"), vectors(spark, np.eye(3), "q"), 5, "id", "q").hits.count() == 0


# versions


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "id string, text string")


def content(df):
    return sorted((r["id"], r["text"]) for r in df.collect())


def test_versions_add_replace_remove_and_compact(spark, tmp_path):
    index = VersionedIndex(spark, str(tmp_path / "index"), "id")
    with pytest.raises(FileNotFoundError):
        index.read()
    with pytest.raises(RuntimeError):
        index.upsert(rows(spark, [("a", "1")]))
    assert index.rebuild(rows(spark, [("a", "1"), ("b", "1"), ("c", "1"), ("c", "0")])) == 1
    index.upsert(rows(spark, [("b", "2"), ("d", "2"), ("d", "2")]))
    index.remove(rows(spark, [("a", ""), ("zz", "")]))
    index.upsert(rows(spark, [("a", "4")]))
    assert content(index.read()) == [("a", "4"), ("b", "2"), ("c", "0"), ("d", "2")]
    assert content(index.read(3)) == [("b", "2"), ("c", "0"), ("d", "2")]
    assert content(index.read(1)) == [("a", "1"), ("b", "1"), ("c", "0")]
    assert index.compact() == 5
    assert content(index.read()) == content(index.read(4)) and index._manifest(5)["changes"] == []
    assert index.versions() == [1, 2, 3, 4, 5] and index.read().columns == ["id", "text"]


def test_a_second_writer_of_a_version_fails_and_readers_keep_theirs(spark, tmp_path):
    index = VersionedIndex(spark, str(tmp_path / "index"), "id")
    index.rebuild(rows(spark, [("a", "1")]))
    held = index.read()
    index.upsert(rows(spark, [("a", "2")]), expected=1)
    with pytest.raises(RuntimeError):
        index.upsert(rows(spark, [("a", "3")]), expected=1)
    with pytest.raises(Py4JJavaError):
        index._commit(2, {"base": "other", "changes": []})  # as a writer that read version 1 would
    assert content(held) == [("a", "1")] and content(index.read()) == [("a", "2")]
    # a write that was never committed is not seen
    index._write(rows(spark, [("b", "9")]).withColumn("_gone", F.lit(False)), "change")
    assert content(index.read()) == [("a", "2")]
