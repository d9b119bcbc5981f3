"""Exact evaluation metrics of 0/1 predictions and of numeric ones, overall or per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.operators.ranks import counts_below, one_row


def _safe(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    def cell(actual: int, predicted: int) -> Column:
        return F.count_if((F.col(label) == actual) & (F.col(prediction) == predicted))

    return df.groupBy(*by).agg(
        cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp")
    )


def binary_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall and F1; a zero denominator gives 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return confusion_matrix(df, label, prediction, by).select(
        *by,
        _safe(tp + tn, tn + fp + fn + tp).alias("accuracy"),
        _safe(tp, tp + fp).alias("precision"),
        _safe(tp, tp + fn).alias("recall"),
        _safe(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def classification_report(df: DataFrame, names: Sequence[str], label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted averages."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    zero = (_safe(tn, tn + fn), _safe(tn, tn + fp), _safe(2 * tn, 2 * tn + fp + fn), tn + fp)
    one = (_safe(tp, tp + fp), _safe(tp, tp + fn), _safe(2 * tp, 2 * tp + fp + fn), tp + fn)
    total = tn + fp + fn + tp
    accuracy = _safe(tp + tn, total)
    macro = [(a + b) / 2 for a, b in zip(zero[:3], one[:3])]
    weighted = [_safe(a * zero[3] + b * one[3], total) for a, b in zip(zero[:3], one[:3])]

    def row(name, values, support):
        return F.struct(
            F.lit(name).alias("class"), values[0].alias("precision"), values[1].alias("recall"),
            values[2].alias("f1"), support.alias("support"),
        )

    return confusion_matrix(df, label, prediction).select(
        F.inline(
            F.array(
                row(names[0], zero[:3], zero[3]), row(names[1], one[:3], one[3]),
                row("accuracy", [accuracy] * 3, total), row("macro avg", macro, total), row("weighted avg", weighted, total),
            )
        )
    )


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve: the share of (positive, negative) pairs ranked right, ties half.

    Scores are counted first, so equal scores share one row and the running count covers
    distinct scores only. A group with one class gives null.
    """
    counts = df.groupBy(*by, F.col(score).alias("_score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    ranked = counts_below(counts, list(by), "_score", ["neg"])
    pos, neg = F.sum(F.col("pos").cast("double")), F.max(F.col("total_neg").cast("double"))
    won = F.sum(F.col("pos") * (F.col("below_neg") + F.col("neg") / 2))
    return ranked.groupBy(*by).agg(F.try_divide(won, pos * neg).alias("roc_auc"))


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Mean squared and absolute error, and R² against the mean."""
    y = F.col(actual).cast("double")
    error = y - F.col(predicted)
    sums = df.agg(
        F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"), F.var_pop(y).alias("variance")
    )
    return sums.select("mse", "mae", (1 - F.try_divide(F.col("mse"), F.col("variance"))).alias("r2"))


def scale_parameters(train: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column; a constant column is not divided."""
    row = one_row(
        train.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
                  *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)])
    )
    return {c: (row[f"m{i}"], row[f"s{i}"] or 1.0) for i, c in enumerate(columns)}


def standard_scale(df: DataFrame, parameters: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in parameters.items()})
