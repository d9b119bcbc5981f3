"""Descriptive statistics, distributions, correlations and contingency tests.

Every profile is one aggregate over the table; results with one row per column or pair are unpivoted
from that single row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carelake.functions.columns import finite
from carelake.functions.tails import chi2_p, correlation_p
from carelake.operators.clean import value_frequencies
from carelake.operators.ranks import counts_below, exact_quantiles, medians, one_row
from carelake.session import materialize


def _per_column(df: DataFrame, columns: Sequence[str], **stats) -> DataFrame:
    """One row per column from a single aggregate; ``stats`` maps a name to a function of the column name."""
    wide = df.agg(*[f(c).alias(f"{name}_{i}") for i, c in enumerate(columns) for name, f in stats.items()])
    rows = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"{name}_{i}").alias(name) for name in stats])
        for i, c in enumerate(columns)
    ]
    return wide.select(F.inline(F.array(*rows)))


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return _per_column(df, columns or df.columns, nulls=lambda c: F.count_if(F.col(c).isNull()))


def table_info(df: DataFrame) -> DataFrame:
    """Column order, type and non-null count."""
    types = dict(df.dtypes)
    order = {c: i for i, c in enumerate(df.columns)}
    counted = _per_column(df, df.columns, non_null=lambda c: F.count(c))
    chain = F.create_map(*[x for c in df.columns for x in (F.lit(c), F.struct(F.lit(order[c]).alias("o"), F.lit(types[c]).alias("t")))])
    return counted.select(
        chain[F.col("column")]["o"].alias("position"), "column", chain[F.col("column")]["t"].alias("type"), "non_null"
    )


def head(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    return df.orderBy(key).limit(n)


def describe_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    moments = _per_column(
        df, columns, n=F.count, mean=lambda c: F.avg(c), std=lambda c: F.stddev_samp(c),
        min=lambda c: F.min(F.col(c).cast("double")), max=lambda c: F.max(F.col(c).cast("double")),
    )
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75]).groupBy("column").agg(
        *[F.max(F.when(F.col("p") == p, F.col("value"))).alias(name) for p, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))]
    )
    return moments.join(quartiles, "column", "left").select(
        "column", "n", "mean", "std", "min", "q25", "q50", "q75", "max"
    )


def describe_categorical(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, number of distinct values, most frequent value (ties: smallest) and its count."""
    return value_frequencies(df, columns).groupBy("column").agg(
        F.sum("n").alias("count"),
        F.count(F.lit(1)).alias("unique"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top"),
        F.max("n").alias("freq"),
    )


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    return df.select(F.inline(F.array(*cells))).distinct()


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Number of distinct non-null values, exact by two aggregations or by a sketch in one pass."""
    if approximate:
        return _per_column(df, columns, n_distinct=lambda c: F.approx_count_distinct(c))
    return value_frequencies(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))


def value_counts(df: DataFrame, column: str, dropna: bool = True) -> DataFrame:
    """Count and percent of each value."""
    data = df.where(F.col(column).isNotNull()) if dropna else df
    total = data.count()
    counts = data.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", F.col("n") * 100.0 / F.lit(total))


def skewness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Biased skewness m3 / m2^1.5."""
    return _per_column(df, columns, skewness=lambda c: F.skewness(c))


def kurtosis(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Biased excess kurtosis."""
    return _per_column(df, columns, kurtosis=lambda c: F.kurtosis(c))


# ---- contingency --------------------------------------------------------------------------


def crosstab(df: DataFrame, row: str, col: str, values: Sequence | None = None) -> DataFrame:
    """Counts with one output column per value; without a list the values are those of the data, in order.

    A value that is not on a given list stops the job and is named.
    """
    data = df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
    if values is None:
        values = sorted(r[0] for r in data.select(col).distinct().collect())  # one output column for each
    else:
        unlisted = F.raise_error(F.concat(F.lit("unlisted value: "), F.col(col).cast("string"))).cast(dict(df.dtypes)[col])
        data = data.withColumn(col, F.when(F.col(col).isin(*values), F.col(col)).otherwise(unlisted))
    return data.groupBy(row).pivot(col, list(values)).agg(F.count(F.lit(1))).fillna(0)


def crosstab_margins(df: DataFrame, row: str, col: str) -> DataFrame:
    """Cell counts and ``All`` totals; cells are counted first, so only the small table is cubed."""
    cells = (
        df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
        .groupBy(F.col(row).cast("string").alias("row"), F.col(col).cast("string").alias("col"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return cells.cube("row", "col").agg(
        F.sum("n").alias("n"), F.grouping("row").alias("gr"), F.grouping("col").alias("gc")
    ).select(
        F.when(F.col("gr") == 1, "All").otherwise(F.col("row")).alias("row"),
        F.when(F.col("gc") == 1, "All").otherwise(F.col("col")).alias("col"),
        "n",
    )


def crosstab_percent(df: DataFrame, row: str, columns: Sequence[str]) -> DataFrame:
    """Percent within each row class, for several category columns in one pass."""
    cells = [F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("value")) for c in columns]
    counts = (
        df.where(F.col(row).isNotNull())
        .select(F.col(row).alias("row"), F.inline(F.array(*cells)))
        .where("value IS NOT NULL")
        .groupBy("variable", "row", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    in_row = F.sum("n").over(Window.partitionBy("variable", "row"))
    return counts.withColumn("percent", F.col("n") * 100.0 / in_row)


def chi_square(df: DataFrame, row: str, col: str) -> DataFrame:
    """χ² test of independence; one degree of freedom gets the continuity correction.

    Row and column totals give the statistic without listing empty cells: uncorrected it is
    N(Σ o²/(r·c) − 1), and in a 2×2 table all cells deviate by the same amount.
    """
    cells = (
        df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
        .groupBy(F.col(row).alias("r"), F.col(col).alias("c"))
        .agg(F.count(F.lit(1)).alias("o"))
        .withColumns(
            {
                "rt": F.sum("o").over(Window.partitionBy("r")).cast("double"),
                "ct": F.sum("o").over(Window.partitionBy("c")).cast("double"),
            }
        )
    )
    sums = cells.agg(
        F.sum("o").cast("double").alias("n"),
        F.count_distinct("r").alias("nr"),
        F.count_distinct("c").alias("nc"),
        F.sum(F.col("o") * F.col("o") / (F.col("rt") * F.col("ct"))).alias("q"),
        F.max(F.struct("r", "c", "o", "rt", "ct")).alias("any"),
        # Σ 1/r over rows and Σ 1/c over columns, each total counted once per cell of its own line
        F.sum(F.col("o") / (F.col("rt") * F.col("rt"))).alias("inv_r"),
        F.sum(F.col("o") / (F.col("ct") * F.col("ct"))).alias("inv_c"),
    )
    deviation = F.abs(F.col("any.o") - F.col("any.rt") * F.col("any.ct") / F.col("n"))
    corrected = F.pow(F.greatest(deviation - 0.5, F.lit(0.0)), 2) * F.col("n") * F.col("inv_r") * F.col("inv_c")
    dof = (F.col("nr") - 1) * (F.col("nc") - 1)
    stat = F.when(dof == 1, corrected).when(dof > 1, F.col("n") * (F.col("q") - 1)).otherwise(F.lit(0.0))
    return sums.select(stat.alias("chi2"), dof.alias("dof")).select(
        "chi2", "dof", F.when(F.col("dof") == 0, 1.0).otherwise(chi2_p("chi2", "dof")).alias("p")
    )


def expected_counts(df: DataFrame, row: str, col: str, values: Sequence | None = None) -> DataFrame:
    """Observed and expected count of every cell, empty ones included."""
    table = crosstab(df, row, col, values)
    names = [c for c in table.columns if c != row]
    totals = one_row(table.agg(*[F.sum(v).alias(v) for v in names]))
    n = float(sum(totals.values()))
    in_row = sum((F.col(v) for v in names[1:]), F.col(names[0]))
    cells = [
        F.struct(
            F.lit(v).alias("col"), F.col(v).alias("observed"),
            (in_row * F.lit(float(totals[v])) / F.lit(n)).alias("expected"),
        )
        for v in names
    ]
    return table.select(F.col(row).cast("string").alias("row"), F.inline(F.array(*cells)))


def separation_check(df: DataFrame, flag: str, label: str, positive: str) -> DataFrame:
    """Label counts per flag value, and whether a flag value determines the label."""
    is_pos = F.col(label) == positive
    return df.groupBy(F.col(flag).alias("flag")).agg(
        F.count_if(is_pos).alias("n_positive"),
        F.count_if(~is_pos).alias("n_negative"),
        (F.bool_and(is_pos) | F.bool_and(~is_pos)).alias("separated"),
    )


def flag_overlap(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(
        F.count_if(F.col(a) == 1).alias("n_first"),
        F.count_if(F.col(b) == 1).alias("n_second"),
        F.count_if((F.col(a) == 1) & (F.col(b) == 1)).alias("n_both"),
    )


# ---- distributions ------------------------------------------------------------------------


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 15) -> DataFrame:
    """Equal-width bins over each column's range, last bin closed; empty bins are listed.

    NaN and infinite values are left out.
    """
    df = df.select(*[finite(F.col(c)).alias(c) for c in columns])
    span = one_row(
        df.agg(*[F.min(c).cast("double").alias(f"lo{i}") for i, c in enumerate(columns)],
               *[F.max(c).cast("double").alias(f"hi{i}") for i, c in enumerate(columns)])
    )
    cells, frames = [], []
    for i, c in enumerate(columns):
        lo, hi = span[f"lo{i}"], span[f"hi{i}"]
        if lo is None:
            continue
        if lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
        cells.append(
            F.struct(
                F.lit(c).alias("column"),
                F.when(
                    F.col(c).isNotNull(),  # the least of a null and a number is the number
                    F.least(F.width_bucket(F.col(c).cast("double"), F.lit(lo), F.lit(hi), F.lit(bins)), F.lit(bins)),
                ).cast("int").alias("bin"),
            )
        )
        frames += [(c, b + 1, lo + (hi - lo) * b / bins, lo + (hi - lo) * (b + 1) / bins) for b in range(bins)]
    counts = (
        df.select(F.inline(F.array(*cells))).where("bin IS NOT NULL").groupBy("column", "bin").agg(F.count(F.lit(1)).alias("n"))
    )
    edges = df.sparkSession.createDataFrame(frames, "column string, bin int, lo double, hi double")
    filled = edges.join(counts, ["column", "bin"], "left").fillna(0, ["n"])
    total = F.sum("n").over(Window.partitionBy("column"))
    return filled.withColumn("density", F.col("n") / (total * (F.col("hi") - F.col("lo"))))


def kde_grid(df: DataFrame, column: str, points: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density (Scott bandwidth) on an even grid, with mean and median.

    Each task sums its rows onto the grid and emits one partial vector, so only
    ``points`` rows per task are shuffled. Equal values are counted first.
    """
    data = df.select(finite(F.col(column).cast("double")).alias("x")).where("x IS NOT NULL")
    s = one_row(
        data.agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
                 F.min("x").alias("lo"), F.max("x").alias("hi"))
    )
    middle = medians(data, ["x"])["x"]
    width = s["std"] * s["n"] ** -0.2
    grid = np.linspace(s["lo"] - cut * width, s["hi"] + cut * width, points)
    weighted = data.groupBy("x").agg(F.count(F.lit(1)).alias("n"))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(points)
        for batch in batches:
            x, n = batch["x"].to_numpy(), batch["n"].to_numpy(dtype="float64")
            for start in range(0, len(x), 4096):
                z = (grid[:, None] - x[None, start : start + 4096]) / width
                total += np.exp(-0.5 * z * z) @ n[start : start + 4096]
        yield pd.DataFrame({"point": np.arange(points), "x": grid, "mass": total})

    scale = 1.0 / (s["n"] * width * np.sqrt(2 * np.pi))
    return (
        weighted.mapInPandas(partial, "point int, x double, mass double")
        .groupBy("point", "x")
        .agg((F.sum("mass") * F.lit(float(scale))).alias("density"))
        .select("point", "x", "density", F.lit(s["mean"]).alias("mean"), F.lit(middle).alias("median"))
    )


# ---- correlation --------------------------------------------------------------------------


def corr_pairs(df: DataFrame, columns: Sequence[str], complete_rows: bool = True) -> DataFrame:
    """``(a, b, r, n)`` of every column pair a < b, over complete rows or pairwise complete ones.

    Complete rows share one covariance matrix of the columns; pairwise complete rows differ per pair.
    """
    data = df.select([F.col(c).cast("double").alias(c) for c in columns])
    pairs = list(combinations(range(len(columns)), 2))
    if complete_rows:
        vectors = VectorAssembler(inputCols=list(columns), outputCol="v").transform(data.dropna())
        n = vectors.count()
        r = Correlation.corr(vectors, "v").first()[0].toArray()
        rows = [(columns[i], columns[j], float(r[i, j]) if np.isfinite(r[i, j]) else None, n) for i, j in pairs]
        return df.sparkSession.createDataFrame(rows, "a string, b string, r double, n bigint")
    wide = data.agg(
        *[F.corr(columns[i], columns[j]).alias(f"r_{i}_{j}") for i, j in pairs],
        *[F.count_if(F.col(columns[i]).isNotNull() & F.col(columns[j]).isNotNull()).alias(f"n_{i}_{j}") for i, j in pairs],
    )
    rows = [
        F.struct(
            F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"),
            F.col(f"r_{i}_{j}").alias("r"), F.col(f"n_{i}_{j}").alias("n"),
        )
        for i, j in pairs
    ]
    return wide.select(F.inline(F.array(*rows)))


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Full symmetric matrix as rows, pairwise complete."""
    half = corr_pairs(df, columns, complete_rows=False)
    own = _per_column(df, columns, r=lambda c: F.when(F.min(c) < F.max(c), 1.0))  # null for a constant column, as off the diagonal
    unit = own.select(F.col("column").alias("a"), F.col("column").alias("b"), "r")
    return half.select("a", "b", "r").union(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "r")).union(unit)


def corr_pvalues(df: DataFrame, columns: Sequence[str], complete_rows: bool = True) -> DataFrame:
    t = F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r")))
    return corr_pairs(df, columns, complete_rows).select("a", "b", "r", "n", t.alias("t"), correlation_p("r", "n").alias("p"))


def significance_stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*")


def corr_significant(df: DataFrame, columns: Sequence[str], target: str | None = None, complete_rows: bool = True) -> DataFrame:
    """Pairs with p < 0.05, or every pair with the target and whether it is significant."""
    tested = corr_pvalues(df, columns, complete_rows).withColumn("stars", significance_stars(F.col("p")))
    if target is None:
        return tested.where("p < 0.05").select("a", "b", "r", "p", "stars")
    other = F.when(F.col("a") == target, F.col("b")).otherwise(F.col("a"))
    return tested.where((F.col("a") == target) | (F.col("b") == target)).select(
        other.alias("variable"), "r", "p", (F.col("p") < 0.05).alias("significant")
    )


def corr_by_group(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Pearson r within each group; with a 0/1 column this is the point-biserial correlation."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    found = df.where(both).groupBy(group).agg(F.corr(x, y).alias("r"), F.count(F.lit(1)).alias("n"))
    return found.select(group, "r", "n", correlation_p("r", "n").alias("p"))


def spearman_by_group(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Spearman correlation within each group with average ranks for ties.

    Rows are first counted by (group, x, y); ranks come from the value counts of each side, and the
    correlation is a weighted sum over the counted cells, so no group of rows meets in one task.
    """
    cells = (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(F.col(group).alias("g"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    cells = materialize(cells, "cells")

    def ranks(side: str) -> DataFrame:
        counts = cells.groupBy("g", side).agg(F.sum("n").alias("k"))
        # distance of the mid-rank from the mean rank
        centred = F.col("below_k") + (F.col("k") + 1) / 2 - (F.col("total_k") + 1) / 2
        return counts_below(counts, ["g"], side, ["k"]).select("g", side, centred.alias(f"r{side}"))

    ranked = cells.join(ranks("x"), ["g", "x"]).join(ranks("y"), ["g", "y"])
    n, rx, ry = F.col("n"), F.col("rx"), F.col("ry")
    sums = ranked.groupBy("g").agg(
        F.sum(n * rx * ry).alias("xy"), F.sum(n * rx * rx).alias("xx"), F.sum(n * ry * ry).alias("yy"), F.sum("n").alias("n")
    )
    r = F.try_divide(F.col("xy"), F.sqrt("xx") * F.sqrt("yy"))
    return sums.select(F.col("g").alias(group), r.alias("rho"), "n").select(
        group, "rho", "n", correlation_p("rho", "n").alias("p")
    )


def group_compare(df: DataFrame, group: str, flag: str, value: str) -> DataFrame:
    """Count, mean and deviation of a value with and without a flag, and the difference of means."""
    yes, no = (F.when(F.col(flag) == v, F.col(value)) for v in (1, 0))
    return df.groupBy(group).agg(
        F.count(yes).alias("n_yes"), F.avg(yes).alias("mean_yes"), F.stddev_samp(yes).alias("std_yes"),
        F.count(no).alias("n_no"), F.avg(no).alias("mean_no"), F.stddev_samp(no).alias("std_no"),
    ).withColumn("difference", F.col("mean_yes") - F.col("mean_no"))
