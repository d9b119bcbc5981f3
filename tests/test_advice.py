"""Advice from hits that travel without their texts."""

from pyspark.sql import functions as F

from carelake.operators import retrieve
from carelake.plans import corpus_queries as cq

HITS = "request string, query_ord int, weight int, rank int, relevance double, id int, text string"


def test_hits_without_text_give_the_same_advice(spark):
    long = "Long enough advice text to be listed as an item."
    rows = [("a", i % 3, 3, i // 3 + 1, 0.5 + i / 100, i % 7, f"{i % 7} {long}") for i in range(18)] + [("b", 0, 1, 1, 0.5, 8, "too short")]
    rows += [("d", 0, 1, 1, 0.5, 9, f"one {long}"), ("d", 0, 1, 1, 0.5, 9, f"two {long}")]  # an id with two texts
    hits = spark.createDataFrame(rows, HITS)
    people = spark.createDataFrame([(c + str(i), c, "High", "S") for c in "abcd" for i in range(2)], "person string, request string, level string, summary string")
    given = ("request", F.col("level"), F.col("summary"))
    whole = retrieve.advice(people, retrieve.fuse(hits, "request"), *given, key="person")
    fused = retrieve.fuse(retrieve.without_text(hits), "request")
    assert "text" not in fused.columns
    late = retrieve.advice(people, fused, *given, key="person", texts=hits.select("id", "text"), corpus_id="id")
    got, expected = ({r["person"]: (r["n_items"], r["advice"].split("S\n")[0]) for r in d.collect()} for d in (late, whole))
    assert got == expected and len(got) == 8 and got["a0"][0] == 4 and got["d0"][0] == 2
    lines = [{r["person"]: sorted(r["advice"].split("\n")) for r in d.where("request <> 'd'").collect() if r["person"][0] != "d"} for d in (late.withColumn("request", F.substring("person", 1, 1)), whole.withColumn("request", F.substring("person", 1, 1)))]
    assert lines[0] == lines[1]


def test_requests_are_fused_once_and_without_texts(spark):
    """The rows that fusion sorts grow with the different requests, not with the patients."""
    sf = "/root/testdata/sf0.001"
    people = cq._with_request(cq.risk.with_classes(cq.patients(spark, sf)))
    requests = people.select("request").distinct().count()
    fused, _ = cq._asked(spark, sf, people)
    assert "text" not in fused.columns
    assert fused.select("request").distinct().count() <= requests < people.count()
    plan = cq._plan(people)
    assert plan.count() == people.select("request", F.size("factors").alias("n")).distinct().agg(F.sum(F.col("n") + 1)).first()[0]


def test_single_precision_vectors_travel_as_they_are(spark):
    import numpy as np

    m = np.random.default_rng(2).normal(size=(60, 5)).astype("float32")
    rows = [(i, v.tolist()) for i, v in enumerate(m)]
    found = []
    for kind in ("float", "double"):
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
        queries = df.withColumnRenamed("vec_id", "query_id")
        c, q = retrieve._sides(df, queries, "vec_id", "query_id", "embedding")
        assert dict(c.dtypes)["_v"] == dict(q.dtypes)["_v"] == f"array<{kind}>"
        for search in (lambda: retrieve.top_k(df, queries, 4, "vec_id", "query_id", broadcast_bytes=0), lambda: retrieve.top_k_probed(df, queries, 4, "vec_id", "query_id", cells=3, probes=3)):
            found.append(sorted(map(tuple, search().select("query_id", "rank", "vec_id", "relevance").collect())))
    assert all(f == found[0] for f in found)


def test_requests_get_texts_at_once_or_later(spark):
    long = "Long enough advice text to be listed as an item, number"
    index = spark.createDataFrame([(str(i), f"{long} {i}.", [1.0, i / 10]) for i in range(8)], "key string, text string, embedding array<double>")
    plan = spark.createDataFrame([("a", 0, 2, "x"), ("a", 1, 1, "y"), ("b", 0, 1, "x")], "request string, query_ord int, weight int, query_text string")

    class Encoder:
        def encode(self, df, text):
            return df.withColumn("embedding", F.array(F.lit(1.0), F.when(F.col(text) == "x", 0.1).otherwise(0.6)))

    whole = retrieve.search_requests(plan, index, Encoder(), "request", "key", k=3)
    usable = retrieve.valid_texts(index, "key")
    slim = retrieve.search_requests(plan, index, Encoder(), "request", "key", k=3, usable=usable)
    cols = ["request", "fused_rank", "key", "weighted_score", "text"]
    got, expected = (sorted(map(tuple, d.select(cols).collect())) for d in (retrieve.with_text(slim, usable, "key"), whole))
    assert "text" not in slim.columns and got == expected and len(got) >= 6
