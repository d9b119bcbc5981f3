"""Training, comparing, storing and applying classifiers.

Training input is written once to the shared folder and read back, so the many passes of a fit neither
recompute the cleaning nor depend on one executor's cache.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import partial, reduce
from multiprocessing.pool import ThreadPool
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IndexToString
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake.functions.columns import celsius, format_fixed
from carelake.operators import clean, feedback, folds, kernel_machine, metrics, neighbours, trees
from carelake.operators.forest import NAME, GrownForestModel
from carelake.operators.ranks import one_row
from carelake.operators.split import stratified_folds, stratified_split
from carelake.plans import clinical as cfg
from carelake.session import materialize, run_dir
from carelake.sources.tables import coerce_numbers

CLASSES = list(cfg.TARGET_CODES)


def labelled(df: DataFrame, features: Sequence[str] = tuple(cfg.FEATURES), key: str = "patient_id") -> DataFrame:
    """Key, features as doubles and the coded label."""
    return df.select(
        key, *[F.col(c).cast("double").alias(c) for c in features],
        clean.encode_target(F.col(cfg.TARGET), cfg.TARGET_CODES).cast("double").alias("label"),
    )


def train_test(df: DataFrame, key: str = "patient_id", seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Written 80/20 stratified parts of a labelled frame."""
    parts = materialize(stratified_split(df, "label", key, 0.2, seed), "split")
    return parts.where("NOT is_test").drop("is_test"), parts.where("is_test").drop("is_test")


def train_forest(train: DataFrame, features: Sequence[str] = tuple(cfg.FEATURES), key: str = "patient_id", **parameters) -> PipelineModel:
    """The risk forest as a pipeline that can be stored; ``key`` tells rows apart, for their bootstraps."""
    given = {**cfg.FOREST, **parameters}
    tried = {"sqrt": math.isqrt(len(features)), "all": len(features)}[given["featureSubsetStrategy"]]
    members = trees.forest_members(
        NAME, given["numTrees"], given["seed"], tried,
        max_depth=given["maxDepth"], min_leaf=given["minInstancesPerNode"], min_split=cfg.FOREST_MIN_SPLIT,
    )
    forest = GrownForestModel(trees.train(train, members, features, key))
    return PipelineModel([forest, IndexToString(inputCol="prediction", outputCol="risk_level", labels=CLASSES)])


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """Load a stored model; one whose class order is not Low, High is refused."""
    model = PipelineModel.load(path)
    found = list(model.stages[-1].getLabels())
    if found != CLASSES:
        raise ValueError(f"class order is {found}, expected {CLASSES}; train the model again")
    return model


def log_run(spark: SparkSession, path: str, version: str, samples: int, model: PipelineModel) -> None:
    """Append one row on a training run to the ``model_runs`` table."""
    forest = model.stages[0]
    row = [(
        version, datetime.now(timezone.utc).isoformat(), samples, ", ".join(f"{c}={i}" for i, c in enumerate(CLASSES)),
        forest.kind, forest.n_trees, forest.max_depth, len(forest.getInputCols()), ",".join(forest.getInputCols()),
    )]
    schema = ("version string, trained_at string, samples bigint, encoding string, model_type string, "
              "n_trees int, max_depth int, n_features int, feature_names string")
    spark.createDataFrame(row, schema).write.mode("append").parquet(path)


def apply_model(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add prediction, ``p_low`` and ``p_high``."""
    out = model.transform(df)
    p = vector_to_array("probability")
    return out.select(
        *df.columns, F.col("prediction").cast("int").alias("prediction"), p[0].alias("p_low"), p[1].alias("p_high")
    )


def score_batch(model: PipelineModel, requests: DataFrame, features: Sequence[str] = tuple(cfg.FEATURES), key: str = "patient_id") -> DataFrame:
    """One result per request: level, code, confidence and both probabilities, or an error.

    A request with a missing field, or with one that is no finite number, becomes an error row that names it and does
    not stop the others.
    """
    given = requests.withColumn("_given", F.array(*[F.col(c).isNotNull() for c in features]))
    read = coerce_numbers(given, features)
    was = [F.get("_given", F.lit(i)) for i in range(len(features))]
    unread = [F.when(F.col(c).isNull() & w, F.lit(c)) for c, w in zip(features, was, strict=True)]
    absent = [F.when(~w, F.lit(c)) for c, w in zip(features, was, strict=True)]
    temp = celsius(F.col("tjelesna_temp"), cfg.FAHRENHEIT_ABOVE)
    complete = reduce(and_, [F.col(c).isNotNull() for c in features])
    error = F.concat_ws("; ", _named("missing: ", absent), _named("not a number: ", unread))
    # incomplete rows pass the model with zeros, so that the requests are read once and no condition is evaluated below their reading
    ready = read.select(
        key, *[F.coalesce(temp if c == "tjelesna_temp" else F.col(c), F.lit(0.0)).alias(c) for c in features],
        complete.alias("_complete"), F.when(~complete, error).alias("error"),
    )
    level = F.when(F.col("prediction") == 1, "High").otherwise("Low")
    best = F.greatest("p_low", "p_high")
    found = {
        "risk_level": level, "risk_code": F.col("prediction"), "confidence": best, "p_low": F.col("p_low"), "p_high": F.col("p_high"),
        "confidence_text": F.concat(format_fixed(best * 100, 1), F.lit("%")),
    }
    return apply_model(model, ready).select(key, *[F.when(F.col("_complete"), v).alias(name) for name, v in found.items()], "error")


def _named(what: str, names: Sequence[Column]) -> Column:
    """The names that are not null after what they are, or null if there are none."""
    listed = F.array_compact(F.array(*names))
    return F.when(F.size(listed) > 0, F.concat(F.lit(what), F.array_join(listed, ", ")))


def evaluate(predicted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall, F1 and ROC AUC of (label, prediction, p_high), optionally per group."""
    basic = metrics.binary_metrics(predicted, by=by)
    auc = metrics.roc_auc(predicted, score="p_high", by=by)
    if by:
        return basic.join(auc, list(by))
    return basic.withColumn("roc_auc", F.lit(one_row(auc)["roc_auc"]).cast("double"))


def forest_report(model: PipelineModel, test: DataFrame) -> DataFrame:
    """One row: the five metrics and the confusion matrix on the test part."""
    predicted = materialize(apply_model(model, test).select("label", "prediction", "p_high"), "predicted")
    cells = one_row(metrics.confusion_matrix(predicted))
    return evaluate(predicted).withColumns({c: F.lit(n).cast("bigint") for c, n in cells.items()})


def feature_importance(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """Importance and percent per feature, largest first; one row per feature."""
    forest = model.stages[0]
    rows = [(c, float(v)) for c, v in zip(forest.getInputCols(), forest.importances(), strict=True)]
    table = spark.createDataFrame(rows, "feature string, importance double")
    return table.withColumn("importance_pct", F.col("importance") * 100).orderBy(F.desc("importance"), "feature")


# ---- forests and boosting on binned columns ---------------------------------------------------


def grown_forest(train: DataFrame, features: Sequence[str] = tuple(cfg.FEATURES), key: str = "patient_id", **settings) -> trees.Ensemble:
    """The risk forest, not stored."""
    given = {"max_depth": cfg.FOREST["maxDepth"], "min_leaf": cfg.FOREST["minInstancesPerNode"], "min_split": cfg.FOREST_MIN_SPLIT, **settings}
    members = trees.forest_members("forest", cfg.FOREST["numTrees"], cfg.FOREST["seed"], math.isqrt(len(features)), **given)
    return trees.train(train, members, features, key)


def grown_forest_report(ensemble: trees.Ensemble, test: DataFrame) -> DataFrame:
    """One row: the five metrics and the confusion matrix on the test part."""
    predicted = materialize(trees.score(ensemble, test, "forest").select("label", "prediction", "p_high"), "predicted")
    cells = one_row(metrics.confusion_matrix(predicted))
    return evaluate(predicted).withColumns({c: F.lit(n).cast("bigint") for c, n in cells.items()})


def grown_importance(ensemble: trees.Ensemble, spark: SparkSession) -> DataFrame:
    """Importance and percent per feature, largest first; one row per feature."""
    rows = [(c, float(v)) for c, v in zip(ensemble.features, ensemble.importance("forest"), strict=True)]
    table = spark.createDataFrame(rows, "feature string, importance double")
    return table.withColumn("importance_pct", F.col("importance") * 100).orderBy(F.desc("importance"), "feature")


# ---- comparison of classifiers --------------------------------------------------------------

Fit = Callable[[DataFrame, DataFrame, Sequence[str]], DataFrame]


@dataclass(frozen=True)
class Classifier:
    """A compared model: ``members`` grow together with those of other models, or ``fit`` takes training and test rows.

    A fit that is ``shared`` also takes one frame with folds as both, and scores every row by a model of the other folds.
    """

    members: Callable[[int, Sequence[int]], list[trees.Member]] | None = None
    fit: Fit | None = None
    shared: bool = False


def _scale(train: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    return folds.scale_parameters(folds.fold_moments(train.drop("fold"), features)[-1], features)


def _fit_knn(train: DataFrame, test: DataFrame, features: Sequence[str]) -> DataFrame:
    """Five nearest neighbours on scaled features."""
    parameters = _scale(train, features)

    def ready(df: DataFrame) -> DataFrame:
        return metrics.standard_scale(df, parameters).select("patient_id", "label", F.array(*features).alias("embedding"))

    asked = ready(test)
    voted = neighbours.knn_classify(ready(train), asked, "patient_id", "label", k=5)
    return voted.join(asked.select("patient_id", "label"), "patient_id")


def nystroem_features(df: DataFrame, columns: Sequence[str], landmarks: np.ndarray, gamma: float) -> DataFrame:
    """Coordinates in which inner products are the RBF kernel's projection on the span of the landmarks.

    Between landmarks they are the kernel itself, so with every training row a landmark a linear machine on them is the kernel
    machine.
    """
    basis = kernel_machine.nystroem(landmarks, gamma)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def project(rows: pa.Array) -> pa.Array:
        z = basis.values(rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), len(columns))) @ basis.root
        return pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel()))

    return df.withColumn("features", array_to_vector(project(F.array(*columns))))


def _fit_svm(train: DataFrame, test: DataFrame, features: Sequence[str], landmarks: int = 256, c: float = 1.0, fourier: int = 0) -> DataFrame:
    """RBF support vector machine on Nyström coordinates, with logistic calibration of the margin.

    Landmarks are the ``landmarks`` training rows with the smallest hashes of their values: a bounded sample of the fit. With
    ``fourier`` dimensions random Fourier features stand for the kernel instead.
    """
    parameters = _scale(train, features)
    # as the kernel machine scales: one over columns times variance, which is 1 after scaling
    gamma = 1.0 / len(features)

    def ready(df: DataFrame) -> DataFrame:
        return metrics.standard_scale(df, parameters).select("label", F.array(*features).alias("x"))

    seen = materialize(ready(train), "svm-rows")
    if fourier:
        basis = kernel_machine.fourier(len(features), fourier, gamma, 42)
    else:
        near = seen.select("x").distinct().orderBy(F.xxhash64("x"), "x").limit(landmarks).collect()
        basis = kernel_machine.nystroem(np.array([r["x"] for r in near], float), gamma)
    machine = kernel_machine.fit(seen, basis, 1.0 / (c * seen.count()))

    def margins(df: DataFrame) -> DataFrame:
        return df.select("label", machine.margin(F.col("x")).alias("margin"))

    def as_features(df: DataFrame) -> DataFrame:
        return df.withColumn("features", array_to_vector(F.array("margin")))

    calibration = LogisticRegression().fit(as_features(materialize(margins(seen), "svm-margins")))
    return calibration.transform(as_features(margins(ready(test))).withColumn("_vote", (F.col("margin") > 0).cast("int"))).select(
        "label", F.col("_vote").alias("prediction"), vector_to_array("probability")[1].alias("p_high")
    )


def _one(model: str, **settings) -> Callable[[int, Sequence[int]], list[trees.Member]]:
    return lambda n, without: [trees.Member(model, seed=42, without=f, **settings) for f in without]


# The compared classifiers and their settings.
CLASSIFIERS: dict[str, Classifier] = {
    "Logistic Regression": Classifier(fit=folds.logistic, shared=True),
    "Decision Tree": Classifier(_one("Decision Tree")),
    "Random Forest": Classifier(lambda n, without: trees.forest_members("Random Forest", 100, 42, math.isqrt(n), without)),
    "SVM (RBF)": Classifier(fit=_fit_svm),
    "k-NN (k=5)": Classifier(fit=_fit_knn),
    "Gradient Boosting": Classifier(_one("Gradient Boosting", rounds=100, rate=0.1, max_depth=3, curved_gain=False)),
    "Naive Bayes": Classifier(fit=folds.naive_bayes, shared=True),
}
FOURIER = {"SVM (RBF)": Classifier(fit=partial(_fit_svm, fourier=256))}
# The cross-validation adds an eighth model: second-order boosting with its usual depth, step and penalties.
CV_CLASSIFIERS = {
    **CLASSIFIERS,
    "Second-order Boosting": Classifier(_one("Second-order Boosting", rounds=100, rate=0.3, max_depth=6, l2=1.0, min_weight=1.0)),
}


def _in_threads(spark: SparkSession, work: Callable, items: Sequence, parallelism: int) -> list:
    pool = ThreadPool(parallelism)
    try:
        return pool.map(inheritable_thread_target(spark)(work), items, chunksize=1)
    finally:
        pool.close()


def _predictions(train: DataFrame, test: DataFrame, features: Sequence[str], classifiers: dict[str, Classifier], without: Sequence[int], parallelism: int, key: str = "patient_id") -> DataFrame:
    """(label, prediction, p_high, model, fold) of every classifier, written and read back.

    Trees and boosting of all models and folds grow together; shared fits take all folds at once, the others one after another.
    """
    spark = train.sparkSession
    grown = [n for n, c in classifiers.items() if c.members]
    ensemble = trees.train(train, [m for n in grown for m in classifiers[n].members(len(features), without)], features, key) if grown else None

    def run(job: tuple[str, int | None]) -> str:
        name, fold = job
        classifier = classifiers[name]
        if classifier.members:
            out = trees.score(ensemble, test, name)
        elif fold is None:
            out = classifier.fit(train, test, features)
        else:
            out = classifier.fit(train.where(F.col("fold") != fold), test.where(F.col("fold") == fold), features)
        placed = F.lit(fold) if fold is not None else F.col("fold") if "fold" in out.columns else F.lit(-1)
        path = run_dir(spark, "predictions")
        out.select("label", F.col("prediction").cast("int").alias("prediction"), "p_high", F.lit(name).alias("model"), placed.cast("int").alias("fold")).write.parquet(path)
        return path

    alone = list(without) == [-1]
    jobs = [(n, f) for n, c in classifiers.items() for f in ([None] if alone or c.members or c.shared else without)]
    return spark.read.parquet(*_in_threads(spark, run, jobs, parallelism))


def compare_models(
    train: DataFrame, test: DataFrame, features: Sequence[str] = tuple(cfg.FEATURES),
    classifiers=CLASSIFIERS, parallelism: int = 4,
) -> DataFrame:
    """The five metrics and the confusion matrix of every classifier on the test part, from one pass over all predictions."""
    together = _predictions(train, test, features, classifiers, [-1], parallelism)
    return evaluate(together, by=["model"]).join(metrics.confusion_matrix(together, by=["model"]), "model")


def cross_validate(
    df: DataFrame, key: str = "patient_id", features: Sequence[str] = tuple(cfg.FEATURES), k: int = 5,
    classifiers=CV_CLASSIFIERS, seed: int = 42, parallelism: int = 4,
) -> DataFrame:
    """Mean and population deviation of the five metrics over stratified folds, best F1 first."""
    dealt = materialize(stratified_folds(df, "label", key, k, seed), "folds")
    together = _predictions(dealt, dealt, features, classifiers, list(range(k)), parallelism, key)
    scores = evaluate(together, by=["model", "fold"])
    names = ["accuracy", "precision", "recall", "f1", "roc_auc"]
    summary = scores.groupBy("model").agg(
        *[F.round(F.avg(m), 4).alias(f"mean_{m}") for m in names],
        *[F.round(F.stddev_pop(m), 4).alias(f"std_{m}") for m in names],
    )
    return summary.orderBy(F.desc("mean_f1"), "model")


# ---- retraining -----------------------------------------------------------------------------


def retrain(
    original: DataFrame, log: DataFrame, models: str, threshold: int = cfg.RETRAIN_THRESHOLD, force: bool = False,
    features: Sequence[str] = tuple(cfg.FEATURES), logs: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Gate, train on original plus labelled feedback, store a new model version, mark the used rows.

    Returns one result row and the updated log, which is also written to ``logs`` by version. The new version becomes
    the current model. Accuracy is on the training rows.
    """
    spark = original.sparkSession
    gate = one_row(feedback.retrain_gate(log, threshold, force))
    schema = ("success boolean, version string, new_samples bigint, labelled_feedback bigint, feedback_used bigint, "
              "total_samples bigint, accuracy double")
    if not gate["retrain"]:
        row = [(False, None, gate["new_samples"], gate["labelled_samples"], 0, 0, None)]
        return spark.createDataFrame(row, schema), log
    # written first, so that the condition on all columns is evaluated on them and not on the expressions they are made of
    people = materialize(original.select(*features, cfg.TARGET), "original")
    union = feedback.training_union(people, log, features)
    # numbered before they are written, so that each row keeps its number in all later passes
    rows = materialize(union.withColumns({"label": F.col("label").cast("double"), "row_number": F.monotonically_increasing_id()}), "retrain")
    model = train_forest(rows, features, "row_number")
    n = one_row(rows.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("origin") == "feedback").alias("feedback")))
    accuracy = one_row(metrics.binary_metrics(apply_model(model, rows)))["accuracy"]
    version = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%f")
    save_model(model, f"{models}/version={version}")
    log_run(spark, f"{models}/model_runs", version, n["all"], model)
    updated = feedback.mark_trained(log, features=features)
    if logs:
        updated.write.parquet(f"{logs}/version={version}")
        updated = spark.read.parquet(f"{logs}/version={version}")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").parquet(f"{models}/current")
    row = [(True, version, gate["new_samples"], gate["labelled_samples"], n["feedback"], n["all"], accuracy)]
    return spark.createDataFrame(row, schema), updated


def current_model(spark: SparkSession, models: str) -> PipelineModel:
    """The model that the last retraining stored."""
    version = spark.read.parquet(f"{models}/current").first()["version"]
    return load_model(f"{models}/version={version}")
