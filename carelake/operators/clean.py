"""Cleaning, validation and imputation of a record table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.functions.columns import absent, fahrenheit_to_celsius, finite
from carelake.operators.ranks import medians, one_row
from carelake.plans import clinical as cfg
from carelake.sources.tables import coerce_numbers


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    return df.dropna(subset=[target])


def keep_age_range(df: DataFrame, age: str, sentinel: float, lo: float, hi: float) -> DataFrame:
    """Drop the sentinel, then keep the closed range; null ages go as well."""
    return df.where((F.col(age) != sentinel) & F.col(age).between(lo, hi))


def clean_report(df: DataFrame, target: str, age: str, sentinel: float, lo: float, hi: float) -> DataFrame:
    """Rows removed at each cleaning step, in one pass."""
    no_target = F.col(target).isNull()
    is_sentinel = ~no_target & F.coalesce(F.col(age) == sentinel, F.lit(False))
    in_range = F.coalesce(F.col(age).between(lo, hi), F.lit(False))
    return df.agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if(no_target).alias("removed_null_target"),
        F.count_if(is_sentinel).alias("removed_sentinel"),
        F.count_if(~no_target & ~is_sentinel & ~in_range).alias("removed_age_range"),
        F.count_if(~no_target & ~is_sentinel & in_range).alias("rows_out"),
    )


def missing_fields(fields: Sequence[str]) -> Column:
    """Names of required fields that are null or no finite number, in the order given."""
    return F.array_compact(F.array(*[F.when(absent(F.col(c)), F.lit(c)) for c in fields]))


def violations(limits: Mapping[str, tuple[Column, float, float]], flags: Mapping[str, Column]) -> Column:
    """``array<struct<field, reason>>`` of failed checks: empty, min or max, and option for 0/1 fields."""
    checks = []
    for field, (value, lo, hi) in limits.items():
        value = finite(value)
        reason = F.when(value.isNull(), "empty").when(value < lo, "min").when(value > hi, "max")
        checks.append((field, reason))
    for field, value in flags.items():
        checks.append((field, F.when(~F.coalesce(value.isin(0, 1), F.lit(False)), "option")))
    return F.array_compact(
        F.array(
            *[F.when(r.isNotNull(), F.struct(F.lit(f).alias("field"), r.alias("reason"))) for f, r in checks]
        )
    )


def split_valid(df: DataFrame, checks: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and the quarantine with its reasons."""
    checked = df.withColumn("violations", checks)
    empty = F.size("violations") == 0
    return checked.where(empty).drop("violations"), checked.where(~empty)


def encode_target(c: Column, codes: Mapping[str, int]) -> Column:
    """Fixed class codes; a value outside the map stops the job and is named."""
    known = F.when(F.lit(False), F.lit(0))
    for text, code in codes.items():
        known = known.when(c == text, F.lit(code))
    return known.otherwise(
        F.raise_error(F.concat(F.lit("unknown target value: "), F.coalesce(c, F.lit("null")))).cast("int")
    )


def unknown_targets(df: DataFrame, target: str, codes: Mapping[str, int]) -> DataFrame:
    known = F.coalesce(F.col(target).isin(*codes), F.lit(False))
    return df.where(~known).groupBy(target).agg(F.count(F.lit(1)).alias("n"))


def target_last(df: DataFrame, last: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in last], *last)


def fill_constant(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.fillna(dict(values))


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    df = coerce_numbers(df, columns)
    found = medians(df, columns)
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(found[c])) for c in columns})


def imputation_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column the number of filled values and the median that fills them."""
    df = coerce_numbers(df, columns)
    found = medians(df, columns)
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    rows = [F.struct(F.lit(c).alias("column"), F.col(c).alias("filled"), F.lit(found[c]).cast("double").alias("median")) for c in columns]
    return nulls.select(F.inline(F.array(*rows)))


def skew_fill_values(df: DataFrame, columns: Sequence[str], limit: float = 1.0) -> DataFrame:
    """Per column skewness, the method it selects and the fill value."""
    df = coerce_numbers(df, columns)
    found = medians(df, columns)
    moments = df.agg(
        *[F.skewness(c).alias(f"skew_{c}") for c in columns], *[F.avg(c).alias(f"mean_{c}") for c in columns]
    )
    rows = []
    for c in columns:
        skewed = F.abs(F.col(f"skew_{c}")) > limit
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"skew_{c}").alias("skewness"),
                F.when(skewed, "median").otherwise("mean").alias("method"),
                F.when(skewed, F.lit(found[c])).otherwise(F.col(f"mean_{c}")).alias("fill_value"),
            )
        )
    return moments.select(F.inline(F.array(*rows)))


def impute_by_skew(df: DataFrame, columns: Sequence[str], limit: float = 1.0) -> DataFrame:
    df = coerce_numbers(df, columns)
    chosen = one_row(
        skew_fill_values(df, columns, limit).agg(
            *[F.max(F.when(F.col("column") == c, F.col("fill_value"))).alias(c) for c in columns]
        )
    )
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(chosen[c])) for c in columns})


def value_frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, n)`` for several columns in one pass, nulls left out."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    return (
        df.select(F.inline(F.array(*cells)))
        .where("value IS NOT NULL")
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent value per column; a tie goes to the smallest value."""
    return value_frequencies(df, columns).groupBy("column").agg(
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"), F.max("n").alias("n")
    )


def impute_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    found = one_row(
        modes(df, columns).agg(*[F.max(F.when(F.col("column") == c, F.col("mode"))).alias(c) for c in columns])
    )
    types = dict(df.dtypes)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(found[c]).cast(types[c])) for c in columns})


def complete_cases(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return coerce_numbers(df, features).dropna(subset=list(features))


def column_drop_plan(
    df: DataFrame, identifiers: Sequence[str], null_share: float = cfg.MOSTLY_NULL
) -> DataFrame:
    """Columns to drop with the reason: declared identifier, mostly null, or one value only.

    A column is constant when its minimum equals its maximum, so no distinct count is shuffled.
    """
    profile = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(c).alias(f"n_{c}") for c in df.columns],
        *[(F.min(c) == F.max(c)).alias(f"same_{c}") for c in df.columns],
    )
    rows = []
    for c in df.columns:
        share = 1 - F.col(f"n_{c}") / F.col("_rows")
        reason = (
            F.when(F.lit(c in identifiers), "identifier")
            .when(share > null_share, "mostly_null")
            .when(F.col(f"same_{c}"), "constant")
        )
        rows.append(F.struct(F.lit(c).alias("column"), share.alias("null_share"), reason.alias("reason")))
    return profile.select(F.inline(F.array(*rows))).where("reason IS NOT NULL")


def prepare_training(
    raw: DataFrame,
    vitals: Sequence[str] = tuple(cfg.VITALS),
    flags: Sequence[str] = tuple(cfg.FLAGS),
    target: str = cfg.TARGET,
) -> DataFrame:
    """Raw records to training records: numbers, Celsius, label present, age range, medians, zero flags."""
    types = dict(raw.dtypes)
    raw = coerce_numbers(raw, [*vitals, *(c for c in flags if types[c] in ("string", "float", "double"))])
    converted = raw.withColumn("tjelesna_temp", fahrenheit_to_celsius(F.col("tjelesna_temp")))
    kept = keep_age_range(
        drop_null_target(converted, target), "dob", cfg.AGE_SENTINEL, cfg.AGE_MIN, cfg.AGE_MAX
    )
    return fill_constant(impute_median(kept, vitals), {c: 0 for c in flags})
