"""Properties and edge cases against plain Python."""

import math
import random
import re
import statistics

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from carelake.functions import columns as fx
from carelake.functions import tails
from carelake.functions import text as tx
from carelake.operators import corpus, feedback, metrics, models, profile, ranks, retrieve, risk, split
from carelake.plans import clinical as cfg
from carelake.session import checkpoint_root, run_dir
from carelake.sources import tables


def test_formatting_is_exact(spark):
    rng = random.Random(1)
    values = [rng.randrange(0, 100_000) / 1000 for _ in range(4000)] + [0.05, 0.25, 0.35, 36.25, 38.05, 120.5, 121.5, 0.5, 2.5]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for r in df.select("x", fx.format_fixed(F.col("x"), 1).alias("a"), fx.format_fixed(F.col("x"), 0).alias("b")).collect():
        assert (r["a"], r["b"]) == (f"{r['x']:.1f}", f"{r['x']:.0f}")


def test_number_parsing(spark):
    cases = {"12,5": 12.5, " 7.25 kg": 7.25, "1,2,3": 1.2, "-,5": -0.5, "abc": 0.0, "": 0.0, "3e2x": 300.0, "5.": 5.0, "+4": 4.0}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r["s"]: r["v"] for r in df.select("s", fx.parse_locale_number(F.col("s")).alias("v")).collect()} == cases
    strict = {"12": 12.0, "12d": None, "1e3": 1000.0, " 4 ": 4.0, "n/a": None, "0x10": None}
    df = spark.createDataFrame([(k,) for k in strict], "s string")
    assert {r["s"]: r["v"] for r in df.select("s", fx.to_number(F.col("s")).alias("v")).collect()} == strict


def test_second_table_text(spark):
    df = spark.createDataFrame([("5.4''", "120/80", "24 weeks", "1st")], "h string, p string, w string, o string")
    s, d = fx.split_pair(F.col("p"))
    row = df.select(
        fx.feet_to_cm(F.col("h"), cfg.CM_PER_FOOT).alias("h"), s.alias("s"), d.alias("d"), fx.first_integer(F.col("w")).alias("w"),
        fx.code_map(F.col("o"), cfg.ORDINAL_CODES).alias("o"),
    ).first()
    assert tuple(row) == (165, 120, 80, 24, 1)


# ---- chunks -------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .?!;\n", min_size=0, max_size=400))
def test_windows_cover_the_text(text):
    bounds = list(corpus.window_bounds(text, 60, 10, cfg.CHUNK_SEPARATORS, False))
    if not text:
        assert bounds == []
        return
    assert bounds[0][0] == 0 and bounds[-1][1] == len(text)
    for (s, e), (s2, _) in zip(bounds, bounds[1:]):
        assert s < s2 <= e and e - s <= 60
    tail = list(corpus.window_bounds(text, 60, 10, cfg.CHUNK_SEPARATORS, True))
    assert tail[: len(bounds)] == bounds and all(e == len(text) for _, e in tail[len(bounds):])


def test_repair_cases(spark):
    long = "This sentence is long enough to be kept as one usable chunk of text."
    cases = {
        "short.": "",
        long: long,
        "  " + long + " \n": long,
        "the rest of a sentence. " + long: long,
        "lower case without any sentence start after it and quite long": "",
        long + " See Tabela 3 for the values. " + long: long + " " + long,
        "As slika 2 shows, this whole chunk is about one figure only.": "",
        long + " An unfinished": long,
        "Too short. " + "an unfinished remainder that is much longer than the part before it": "",
        "• " + long: "• " + long,
        "Šta kaže vodič o kontroli šećera u krvi kod trudnica:": "Šta kaže vodič o kontroli šećera u krvi kod trudnica:",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["v"] for r in df.select("t", tx.validate(F.col("t")).alias("v")).collect()} == cases


def test_short_document_is_not_validated(spark):
    docs = spark.createDataFrame([(1, "tiny"), (2, ""), (3, None), (4, "x" * 599)], "doc_id int, text string")
    rows = corpus.chunk_documents(docs, ["doc_id"]).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["chunk_id"], r["text"]) for r in rows] == [(1, 0, "tiny"), (4, 0, "x" * 599)]


def test_chunk_numbers_follow_kept_chunks(spark):
    sentence = "A plain sentence that stands here for length. "
    text = sentence * 14 + "no stop " * 200 + sentence * 20
    rows = corpus.chunk_documents(spark.createDataFrame([(1, text)], "doc_id int, text string"), ["doc_id"]).collect()
    assert [r["chunk_id"] for r in rows] == list(range(len(rows))) and len(rows) >= 2
    assert all(re.fullmatch("[0-9a-f]{16}", r["chunk_uid"]) for r in rows)


def test_function_encoder_and_index(spark):
    encoder = corpus.FunctionEncoder(lambda texts: np.array([[len(t), 1.0] for t in texts]), batch=2)
    df = spark.createDataFrame([(i, "a" * i) for i in range(5)], "id int, text string")
    coded = encoder.fit(df).encode(df).orderBy("id").collect()
    assert [r["embedding"] for r in coded] == [[float(i), 1.0] for i in range(5)]
    path = run_dir(spark, "test-index")
    tables.write_index(df, path)
    tables.write_index(df.limit(1), path)
    assert spark.read.parquet(path).count() == 5
    tables.write_index(df.limit(1), path, force_rebuild=True)
    assert spark.read.parquet(path).count() == 1


# ---- search -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(300, 8))
    m[100:200] = m[0]  # a third of the corpus is one vector
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), m


def _brute(m, k, metric):
    out = {}
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for i in range(len(m)):
        score = np.round(unit @ unit[i], 10) if metric == "cosine" else -np.round(((m - m[i]) ** 2).sum(1), 8)
        out[i] = sorted(range(len(m)), key=lambda j: (-score[j], j))[:k]
    return out


def _ids(df):
    found = {}
    for r in df.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    return found


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("broadcast_bytes", [retrieve.BROADCAST_BYTES, 0])
def test_top_k_is_exact(vectors, metric, broadcast_bytes, monkeypatch):
    df, m = vectors
    monkeypatch.setattr(retrieve, "BLOCK_ROWS", 70)
    found = retrieve.top_k(df, df.withColumnRenamed("vec_id", "query_id"), 7, "vec_id", "query_id", metric=metric, broadcast_bytes=broadcast_bytes)
    assert _ids(found) == _brute(m, 7, metric)


def test_every_cell_is_exact_and_few_cells_recall_most(vectors, monkeypatch):
    df, m = vectors
    monkeypatch.setattr(retrieve, "BLOCK_ROWS", 70)
    queries = df.withColumnRenamed("vec_id", "query_id")
    exact = retrieve.top_k_probed(df, queries, 5, "vec_id", "query_id", cells=6, probes=6)
    assert _ids(exact) == _brute(m, 5, "cosine")
    some = retrieve.top_k_probed(df, queries, 5, "vec_id", "query_id", cells=6, probes=3)
    assert retrieve.recall(some, exact, ["query_id", "vec_id"]).first()["recall"] > 0.6


def test_fusion_keeps_first_not_best(spark):
    same = "x" * 80
    rows = [("r", 0, 3, 1, 0.5, same + "a"), ("r", 1, 1, 1, 0.9, same + "b"), ("r", 1, 1, 2, 0.6, "other")]
    hits = spark.createDataFrame(rows, "request string, query_ord int, weight int, rank int, relevance double, text string")
    fused = retrieve.fuse(hits, "request").orderBy("fused_rank").collect()
    assert [r["text"] for r in fused] == ["other", same + "a"]
    assert fused[0]["weighted_score"] == pytest.approx(0.66)


def test_advice_fallbacks(spark):
    people = spark.createDataFrame([("a", "High", "S"), ("b", "Low", "S"), ("c", "Low", "S")], "request string, level string, summary string")
    long = "Long enough advice text to be listed as an item."
    rows = [("a", 0, 3, i + 1, 0.5, f"{i} {long}") for i in range(9)] + [("b", 0, 1, 1, 0.5, "too short")]
    hits = spark.createDataFrame(rows, "request string, query_ord int, weight int, rank int, relevance double, text string")
    out = {r["request"]: r for r in retrieve.advice(people, retrieve.fuse(hits, "request"), "request", F.col("level"), F.col("summary")).collect()}
    assert out["a"]["n_items"] == 4 and "**Preporuka 4** (relevantnost: 50%):" in out["a"]["advice"]
    assert out["a"]["advice"].startswith(cfg.BANNER_HIGH) and out["b"]["advice"].endswith(cfg.ADVICE_EMPTY)
    assert out["c"]["advice"] == cfg.ADVICE_NONE


# ---- statistics ---------------------------------------------------------------------------


def test_quantiles(spark):
    rng = random.Random(5)
    data = {"a": [rng.choice([1.0, 1.0, 2.0, 9.5]) for _ in range(501)], "b": [rng.gauss(0, 10) for _ in range(500)] + [1e6], "c": [4.0] * 501}
    rows = list(zip(data["a"], data["b"], data["c"])) + [(None, None, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    found = {(r["column"], r["p"]): r["value"] for r in ranks.exact_quantiles(df, list(data), probs).collect()}
    for c, values in data.items():
        for p in probs:
            assert found[(c, p)] == pytest.approx(float(np.quantile(values, p)), abs=1e-9)


def test_counts_below(spark):
    rows = [("g", 1.0, 3), ("g", 2.0, 4), ("g", 1e9, 1), ("h", -5.0, 2)]
    df = spark.createDataFrame(rows, "g string, v double, n bigint")
    found = {(r["g"], r["v"]): (r["below_n"], r["total_n"]) for r in ranks.counts_below(df, ["g"], "v", ["n"]).collect()}
    assert found == {("g", 1.0): (0, 8), ("g", 2.0): (3, 8), ("g", 1e9): (7, 8), ("h", -5.0): (0, 2)}


def test_tail_probabilities():
    # fixed values: published critical values of the t and chi-square distributions
    for t, df, p in [(2.228, 10, 0.05), (2.086, 20, 0.05), (1.96, 1e6, 0.05), (3.169, 10, 0.01)]:
        assert tails.beta_tail(df / 2, 0.5, df / (df + t * t)) == pytest.approx(p, rel=2e-3)
    for x, dof, p in [(3.841, 1, 0.05), (5.991, 2, 0.05), (18.307, 10, 0.05), (6.635, 1, 0.01)]:
        assert tails.gamma_upper(dof / 2, x / 2) == pytest.approx(p, rel=2e-3)
    assert tails.gamma_upper(0.5, 50.0) == pytest.approx(math.erfc(math.sqrt(50.0)), rel=1e-9)


def test_chi_square_with_an_empty_cell(spark):
    rows = [("a", "x")] * 10 + [("a", "y")] * 5 + [("b", "x")] * 8
    df = spark.createDataFrame(rows, "r string, c string")
    n, table = 23, {("a", "x"): 10, ("a", "y"): 5, ("b", "x"): 8, ("b", "y"): 0}
    total = lambda i, v: sum(o for k, o in table.items() if k[i] == v)
    expect = {k: total(0, k[0]) * total(1, k[1]) / n for k in table}
    chi2 = sum(max(abs(o - expect[k]) - 0.5, 0) ** 2 / expect[k] for k, o in table.items())
    assert profile.chi_square(df, "r", "c").first()["chi2"] == pytest.approx(chi2)
    cells = {(r["row"], r["col"]): (r["observed"], r["expected"]) for r in profile.expected_counts(df, "r", "c", ["x", "y"]).collect()}
    assert cells[("b", "y")] == (0, pytest.approx(expect[("b", "y")]))


def test_auc_with_ties_and_one_class(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(2), rng.randrange(6) / 5) for _ in range(200)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    brute = statistics.fmean((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    df = spark.createDataFrame(rows, "label int, score double")
    assert metrics.roc_auc(df).first()["roc_auc"] == pytest.approx(brute)
    assert metrics.roc_auc(df.where("label = 1")).first()["roc_auc"] is None
    zero = metrics.binary_metrics(df.where("label = 0").withColumn("prediction", F.lit(0))).first()
    assert (zero["accuracy"], zero["precision"], zero["recall"], zero["f1"]) == (1.0, 0.0, 0.0, 0.0)


def test_constant_column_statistics(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(10)], "a double, b double")
    row = profile.corr_pvalues(df, ["a", "b"]).first()
    assert row["r"] is None and row["p"] is None
    bins = profile.histogram(df, ["a"], 4).agg(F.sum("n")).first()[0]
    assert bins == 10


def test_split_and_folds_are_exact(spark):
    df = spark.range(1003).withColumn("label", F.when(F.col("id") % 3 == 0, "High").otherwise("Low"))
    parts = {r["label"]: (r["t"], r["n"]) for r in split.stratified_split(df, "label", "id").groupBy("label").agg(
        F.count_if("is_test").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    assert all(t == math.floor(0.2 * n + 0.5) for t, n in parts.values())
    sizes = split.stratified_folds(df, "label", "id", 5).groupBy("label", "fold").count().collect()
    for label in ("High", "Low"):
        found = [r["count"] for r in sizes if r["label"] == label]
        assert len(found) == 5 and max(found) - min(found) <= 1


# ---- sources, feedback and models ---------------------------------------------------------


def test_feedback_file(spark, tmp_path):
    missing = tables.read_feedback(spark, str(tmp_path / "none"))
    assert missing.schema == tables.FEEDBACK_SCHEMA and missing.count() == 0
    stats = feedback.feedback_stats(missing).first()
    assert stats["total_feedback"] == 0 and stats["needs_retraining"] is False
    path = tmp_path / "log"
    path.mkdir()
    header = ",".join(tables.FEEDBACK_SCHEMA.names)
    values = "30,120,80,oops,36.6,22.0,0,0,0,0,70"
    (path / "a.csv").write_text(f"{header}\n{values},1.0,High,True,2026-01-02T03:04:05.678901,False\n{values},,Low,False,2026-01-02T03:04:06,\n")
    rows = tables.read_feedback(spark, str(path)).orderBy("timestamp").collect()
    assert rows[0]["glukoza_u_krvi"] is None and rows[0]["feedback_risk"] == 1 and rows[0]["timestamp"].microsecond == 678901
    assert rows[1]["feedback_risk"] is None and rows[1]["user_confirmation"] is False and rows[1]["trained"] is None


def test_json_requests_and_csv_table(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"dob": 30, "BMI": 22.5}\n{"dob": "bad"}\n')
    rows = tables.read_json_requests(spark, str(tmp_path / "r.json")).collect()
    assert rows[0]["BMI"] == 22.5 and rows[1]["dob"] is None
    (tmp_path / "t.csv").write_text("dob,nivo_rizika\n30,High\nabc,\n")
    df = tables.read_csv_table(spark, str(tmp_path / "t.csv"), ["dob", "nivo_rizika"], ["dob"])
    assert [tuple(r) for r in df.collect()] == [(30.0, "High"), (None, None)]


def test_model_round_trip(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for i in range(200):
        sick = i % 2 == 0
        rows.append((i, 30.0, 170.0 if sick else 110.0, 80.0, 9.0 if sick else 4.5, 36.6, 22.0 + rng.random(), 0.0, 0.0, 0.0, 0.0, 70.0, "High" if sick else "Low"))
    schema = "patient_id bigint, " + ", ".join(f"{c} double" for c in cfg.FEATURES) + ", nivo_rizika string"
    df = spark.createDataFrame(rows, schema)
    model = models.train_forest(models.labelled(df), numTrees=5)
    path = str(tmp_path / "model")
    models.save_model(model, path)
    requests = df.withColumn("BMI", F.when(F.col("patient_id") != 7, F.col("BMI"))).withColumn("tjelesna_temp", F.lit(98.6))
    scored = {r["patient_id"]: r for r in models.score_batch(models.load_model(path), requests).collect()}
    assert len(scored) == 200 and scored[7]["error"] == "missing: BMI" and scored[7]["risk_level"] is None
    assert scored[0]["risk_level"] == "High" and scored[1]["risk_code"] == 0
    assert scored[0]["confidence"] == max(scored[0]["p_low"], scored[0]["p_high"])
    importance = models.feature_importance(model, spark).collect()
    assert len(importance) == 11 and sum(r["importance"] for r in importance) == pytest.approx(1.0)

    model.stages[-1].setLabels(["High", "Low"])
    models.save_model(model, path)
    with pytest.raises(ValueError, match="class order"):
        models.load_model(path)


def test_retrain_gate_and_marks(spark, tmp_path):
    features = {c: 0.0 for c in cfg.FEATURES}
    base = [dict(features, dob=float(20 + i % 20), glukoza_u_krvi=9.0 if i % 2 else 4.0, tjelesna_temp=36.6, nivo_rizika="High" if i % 2 else "Low") for i in range(60)]
    log = [dict(features, dob=30.0, tjelesna_temp=98.6, glukoza_u_krvi=9.0, feedback_risk=1 if i < 10 else None, original_prediction="High",
                user_confirmation=i < 10, trained=False) for i in range(12)]
    cols = ", ".join(f"{c} double" for c in cfg.FEATURES)
    original = spark.createDataFrame(base, f"{cols}, nivo_rizika string")
    feedback_log = spark.createDataFrame(log, f"{cols}, feedback_risk int, original_prediction string, user_confirmation boolean, trained boolean")
    refused, same = models.retrain(original, feedback_log, str(tmp_path), threshold=13)
    assert refused.first()["success"] is False and same is feedback_log
    result, marked = models.retrain(original, feedback_log, str(tmp_path), threshold=12)
    row = result.first()
    assert row["success"] and row["feedback_used"] == 10 and row["total_samples"] == 70 and row["accuracy"] > 0.9
    assert marked.where("trained").count() == 10
    runs = spark.read.parquet(f"{tmp_path}/model_runs").collect()
    assert [(r["samples"], r["encoding"]) for r in runs] == [(70, "Low=0, High=1")]


def test_small_model_comparison(spark):
    rows = [(i, float(i % 20), float((i * 7) % 13), "High" if i % 20 > 9 else "Low") for i in range(240)]
    df = models.labelled(spark.createDataFrame(rows, "patient_id bigint, a double, b double, nivo_rizika string"), ["a", "b"])
    chosen = {n: models.CV_CLASSIFIERS[n] for n in ("Logistic Regression", "Decision Tree", "SVM (RBF)", "k-NN (k=5)", "Naive Bayes")}
    train, test = models.train_test(df)
    compared = models.compare_models(train, test, ["a", "b"], chosen).collect()
    assert len(compared) == 5 and min(r["accuracy"] for r in compared) > 0.85
    cv = models.cross_validate(df, features=["a", "b"], k=3, classifiers={n: chosen[n] for n in ("Decision Tree", "k-NN (k=5)")}).collect()
    assert [r["model"] for r in cv][0] == "Decision Tree" and cv[0]["mean_f1"] > 0.95


def test_shared_folder(spark):
    assert run_dir(spark, "x").startswith(checkpoint_root(spark) + "/x-")


def test_probed_search_recall_on_clusters(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + 0.15 * rng.normal(size=16)).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = df.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    found = retrieve.top_k_probed(df, queries, 5, "vec_id", "query_id")
    exact = retrieve.top_k(df, queries, 5, "vec_id", "query_id")
    assert retrieve.recall(found, exact, ["query_id", "vec_id"]).first()["recall"] >= 0.9


def test_quantiles_with_an_outlier_and_even_ranges(spark):
    rows = [(float(i % 5000),) for i in range(20000)] + [(1e12,), (float("nan"),), (float("inf"),), (None,)]
    df = spark.createDataFrame(rows, "v double").repartition(8)
    found = {r["p"]: r["value"] for r in ranks.exact_quantiles(df, ["v"], [0.0, 0.5, 1.0]).collect()}
    values = [v for (v,) in rows if v is not None and np.isfinite(v)]
    assert found == {p: float(np.quantile(values, p)) for p in (0.0, 0.5, 1.0)}
    counts = df.where("v < 1e13").groupBy("v").count()
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(conf, "false")
    try:
        sizes = [r["count"] for r in ranks.in_ranges(counts, ["v"]).groupBy("_part").count().collect()]
    finally:
        spark.conf.set(conf, "true")
    assert max(sizes) <= 0.3 * sum(sizes) and len(sizes) >= 6


def test_repeated_corrections_and_crosstab_values(spark):
    log = spark.createDataFrame([(1, False, None), (2, True, 1)], "id int, user_confirmation boolean, feedback_risk int")
    fixes = spark.createDataFrame([(1, "Low", 1), (1, "High", 3), (1, "Low", 2)], "id int, correct_risk string, at int")
    assert sorted((r["id"], r["feedback_risk"]) for r in feedback.apply_corrections(log, fixes, "id", "at").collect()) == [(1, 1), (2, 1)]
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "r string, c string")
    assert profile.crosstab(df, "r", "c").columns == ["r", "x", "y", "z"]
    with pytest.raises(Exception, match="unlisted value: z"):
        profile.crosstab(df, "r", "c", ["x", "y"]).collect()


def test_quantiles_by_digits(spark):
    r = np.random.default_rng(9)
    columns = {
        "wide": np.concatenate([r.normal(0, 1, 500) * 10.0 ** r.integers(-300, 300, 500), [0.0, -0.0, 5e-324, -1.7e308, 1.7e308]]),
        "close": 1.0 + r.integers(0, 9, 505) * 2.0**-52, "same": np.full(505, -3.5), "ints": r.integers(-5, 5, 505).astype(float),
    }
    names = [*columns, "none"]
    rows = [(*map(float, v), None) for v in zip(*columns.values(), strict=True)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(7)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    found = {(q["column"], q["p"]): q["value"] for q in ranks.exact_quantiles(df, names, probs).collect()}
    assert len(found) == 4 * len(probs)
    for c, x in columns.items():
        x = np.sort(x)
        for p in probs:
            pos = p * 504
            low, high = x[int(np.floor(pos))], x[int(np.ceil(pos))]
            assert found[c, p] == low + (high - low) * (pos - np.floor(pos))
    assert ranks.exact_quantiles(df.limit(0), names, probs).count() == 0


def test_many_bands_are_joined_by_salt(spark):
    bands = spark.createDataFrame([(p, i, f"{p}{i}", 10.0 * i, 10.0 * (i + 1)) for p in "ab" for i in range(5)], "param string, ord int, label string, lo double, hi double")
    rows = spark.createDataFrame([(i, "abc"[i % 3], float(i % 60)) for i in range(600)] + [(900, "a", None), (901, None, 5.0)], "id int, param string, value double")
    both = [sorted((tuple(r) for r in risk.classify_by_table(rows, bands, shipped).collect()), key=repr) for shipped in (10_000, 3)]
    assert both[0] == both[1] and len(both[0]) == 602
    assert {r[3] for r in both[0] if r[1] == "a" and r[2] == 15.0} == {"a1"} and {r[3] for r in both[0] if r[1] in ("c", None)} == {cfg.UNKNOWN_CLASS}
