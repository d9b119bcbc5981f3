"""Measurement classes, weighted risk factors and the texts built from them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.functions.columns import classify, finite, gauge_percent, render
from carelake.plans import clinical as cfg


def with_classes(df: DataFrame, bands=cfg.BANDS, columns=cfg.BAND_COLUMNS) -> DataFrame:
    """Add ``class_<param>`` for each banded measurement; null when absent, not finite or not positive."""
    return df.withColumns(
        {
            f"class_{p}": F.when(finite(F.col(columns[p])) > 0, classify(F.col(columns[p]), b, cfg.UNKNOWN_CLASS))
            for p, b in bands.items()
        }
    )


def band_table(spark, bands=cfg.BANDS) -> DataFrame:
    """The band configuration as a table, for bands that come as data."""
    rows = [(p, i, n, float(lo), float(hi)) for p, b in bands.items() for i, (n, lo, hi) in enumerate(b)]
    return spark.createDataFrame(rows, "param string, ord int, label string, lo double, hi double")


SALTS = 32
#: Bands that are sent to the rows; more are joined by parameter and salt.
SHIPPED_BANDS = 10_000


def classify_by_table(long: DataFrame, bands: DataFrame, shipped: int = SHIPPED_BANDS) -> DataFrame:
    """Range join of ``(.., param, value)`` rows with a band table on parameter and interval.

    Bands are counted: up to ``shipped`` of them go to the rows, which stay where they are. A longer table is joined; as a
    few parameters hold all rows, rows are then dealt over salts and each band is given to every salt. Bands of a parameter do not
    overlap, so at most one matches.
    """
    b = bands.select(F.col("param").alias("_p"), "label", "lo", "hi")
    inside = (F.col("param") == F.col("_p")) & (F.col("value") >= F.col("lo")) & (F.col("value") < F.col("hi"))
    if b.limit(shipped + 1).count() <= shipped:
        joined = long.join(F.broadcast(b), inside, "left")
    else:
        salted = long.withColumn("_salt", F.pmod(F.xxhash64(*long.columns), F.lit(SALTS)).cast("int"))
        spread = b.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
        joined = salted.join(spread, inside & (F.col("_salt") == F.col("_s")), "left")
    return joined.select(*long.columns, F.coalesce("label", F.lit(cfg.UNKNOWN_CLASS)).alias("label"))


def worse_class(a: Column, b: Column, order: Sequence[tuple[str, str]] = cfg.PRESSURE_ORDER) -> tuple[Column, Column]:
    """Rank and display text of the worse of two ordinal classes; an unknown class ranks lowest."""

    def rank(c: Column) -> Column:
        chain = F.when(F.lit(False), F.lit(0))
        for i, (name, _) in enumerate(order):
            chain = chain.when(c == name, F.lit(i))
        return chain.otherwise(F.lit(0))

    worst = F.greatest(rank(a), rank(b))
    return worst, F.element_at(F.array(*[F.lit(text) for _, text in order]), worst + 1)


@dataclass(frozen=True)
class Factor:
    """One possible factor: when it applies, and what it carries."""

    ord: int
    name: str
    weight: int
    applies: Column
    v: Column
    w: Column


def _number(name: str | None) -> Column:
    return F.col(name).cast("double") if name else F.lit(None).cast("double")


def _rule_classes(kind, source, classes, strict):
    """Class names of a rule, with the mild glucose class folded in for the corrected form."""
    if kind == "band" and source == "glukoza" and not strict:
        return {**classes, cfg.MILD_GLUCOSE_CLASS: classes["povisena"]}
    return classes


def factor_slots(rules=cfg.FACTOR_RULES, columns=cfg.BAND_COLUMNS, strict: bool = True) -> list[Factor]:
    """Every possible factor in report order, over a frame that has the class columns.

    ``strict`` keeps the published glucose rule, in which the mild class is no factor.
    """
    slots: list[Factor] = []
    for kind, source, outcome, _ in rules:
        if kind == "flag":
            name, weight = outcome
            slots.append(Factor(len(slots), name, weight, F.col(source) == 1, _number(None), _number(None)))
            continue
        classes = _rule_classes(kind, source, outcome, strict)
        params = source if kind == "worst" else (source,)
        present = F.lit(True)
        for p in params:
            present = present & F.col(f"class_{p}").isNotNull()
        taken = F.lit(False)
        merged: dict[tuple[str, int], list[str]] = {}
        for label, factor in classes.items():
            merged.setdefault(factor, []).append(label)
        for (name, weight), labels in merged.items():
            hit = F.lit(False)
            for p in params:
                hit = hit | F.col(f"class_{p}").isin(*labels)
            values = [columns[p] for p in params] + [None]
            slots.append(
                Factor(len(slots), name, weight, present & hit & ~taken, _number(values[0]), _number(values[1]))
            )
            taken = taken | hit
    return slots


def factors_column(slots: Sequence[Factor]) -> Column:
    return F.array_compact(
        F.array(
            *[
                F.when(
                    s.applies,
                    F.struct(
                        F.lit(s.ord).alias("ord"), F.lit(s.name).alias("factor"),
                        s.v.alias("v1"), s.w.alias("v2"), F.lit(s.weight).alias("weight"),
                    ),
                )
                for s in slots
            ]
        )
    )


def weight_column(slots: Sequence[Factor]) -> Column:
    total = F.lit(0)
    for s in slots:
        total = total + F.when(s.applies, F.lit(s.weight)).otherwise(0)
    return total


def normal_params_column(rules=cfg.FACTOR_RULES, strict: bool = True) -> Column:
    """Parameters that are present and in no risk class, for the rules that report them."""
    names = []
    for kind, source, outcome, normal in rules:
        if not normal:
            continue
        classes = list(_rule_classes(kind, source, outcome, strict))
        ok = F.lit(True)
        for p in source if kind == "worst" else (source,):
            ok = ok & F.col(f"class_{p}").isNotNull() & ~F.col(f"class_{p}").isin(*classes)
        names.append(F.when(ok, F.lit(normal)))
    return F.array_compact(F.array(*names))


def query_text_column(slots: Sequence[Factor], age: Column, phrases=cfg.QUERY_PHRASES) -> Column:
    """Search text of a record: the phrases of each factor in order, or the general ones."""
    parts = [F.when(s.applies, render(" ".join(phrases[s.name]), {"v": s.v, "w": s.w})) for s in slots]
    general = F.lit(" ".join(cfg.NO_FACTOR_PHRASES))
    limit, clause = cfg.NO_FACTOR_AGE
    aged = F.when(age > limit, F.concat(render(clause, {"v": age}), F.lit(" "), general)).otherwise(general)
    any_factor = F.lit(False)
    for s in slots:
        any_factor = any_factor | F.coalesce(s.applies, F.lit(False))
    return F.when(any_factor, F.array_join(F.array_compact(F.array(*parts)), " ")).otherwise(aged)


def summary_column(slots: Sequence[Factor], columns=cfg.BAND_COLUMNS) -> Column:
    """Personal summary: a line per measurement outside its normal class, then the active flags."""
    lines = []
    for param, quiet, template in cfg.SUMMARY_LINES:
        if param == "krvni_tlak":
            s, d = F.col("class_sistolicki"), F.col("class_dijastolicki")
            shown = s.isNotNull() & d.isNotNull() & ~(s.isin(*quiet) & d.isin(*quiet))
            values = {"v": F.col(columns["sistolicki"]), "w": F.col(columns["dijastolicki"]), "c": worse_class(s, d)[1]}
        else:
            c = F.col(f"class_{param}")
            shown = c.isNotNull() & ~c.isin(*quiet)
            values = {"v": F.col(columns[param]), "c": F.replace(c, F.lit("_"), F.lit(" "))}
        lines.append(F.when(shown, render(template, values)))
    lines += [F.when(F.col(flag) == 1, F.lit(text)) for flag, text in cfg.SUMMARY_FLAG_LINES]
    any_factor = F.lit(False)
    for s in slots:
        any_factor = any_factor | F.coalesce(s.applies, F.lit(False))
    body = F.array_join(F.array_compact(F.array(F.lit(cfg.SUMMARY_HEAD), *lines)), "\n")
    return F.when(any_factor, F.concat(body, F.lit(cfg.SUMMARY_TAIL))).otherwise(F.lit(cfg.SUMMARY_NONE))


def banner_column(level: Column) -> Column:
    high = F.contains(level, F.lit("High")) | F.contains(F.upper(level), F.lit("VISOK"))
    return F.when(high, cfg.BANNER_HIGH).otherwise(cfg.BANNER_STANDARD)


def zones_column(zones=cfg.ZONES) -> Column:
    """``array<struct<param, value, zone, percent>>`` of the display gauges; null values are left out."""
    cells = []
    for name, (lo, hi, bands) in zones.items():
        value = finite(F.col(name).cast("double"))
        cells.append(
            F.when(
                value.isNotNull(),
                F.struct(
                    F.lit(name).alias("param"),
                    value.alias("value"),
                    classify(value, bands, bands[-1][0]).alias("zone"),
                    gauge_percent(value, lo, hi).alias("percent"),
                ),
            )
        )
    return F.array_compact(F.array(*cells))


def flags_column(flags: Sequence[str], value: int) -> Column:
    return F.array_compact(F.array(*[F.when(F.col(c) == value, F.lit(c)) for c in flags]))


def multi_query_plan(df: DataFrame, request: str, factors: Column, text: Column) -> DataFrame:
    """One search per factor, heaviest first (ties in report order), then a general one of weight 1.

    Each search text is the factor name followed by the whole query text of the record.
    """
    by_weight = F.transform(
        F.sort_array(F.transform(factors, lambda f: F.struct(-f["weight"], f["ord"], f["factor"], f["weight"]))),
        lambda s: F.struct(F.replace(s["factor"], F.lit("_"), F.lit(" ")).alias("context"), s["weight"].alias("weight")),
    )
    general = F.array(F.struct(F.lit(None).cast("string").alias("context"), F.lit(1).alias("weight")))
    return (
        df.select(request, text.alias("_text"), by_weight.alias("_specific"))
        .select(request, "_text", F.posexplode(F.concat("_specific", general)).alias("query_ord", "q"))
        .select(
            request, "query_ord", F.col("q.weight").alias("weight"),
            F.concat_ws(" ", F.col("q.context"), F.col("_text")).alias("query_text"),
        )
    )
