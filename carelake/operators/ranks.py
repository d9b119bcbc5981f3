"""Exact order statistics without a global sort or an unbounded group.

Quantiles are refined by radix: passes count the next bits of the numbers that can hold a wanted rank. Where every value needs its
rank, rows are counted by distinct value first, in parallel. The counts are then dealt into ranges of about equal numbers of
rows, cut by a sample of the values themselves, so neither an outlier nor a narrow group fills one range. Only range
totals (one row for each range) are accumulated over a whole column; inside a range a running sum is enough.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carelake.session import materialize
from carelake.sources.tables import coerce_numbers

#: Bits that a pass over the numbers tells apart.
DIGIT = 13


def one_row(aggregate: DataFrame) -> dict:
    """The single row of a global aggregate; its values go into later plans as literals.

    A scalar subquery would be planned anew at every place that uses it.
    """
    return aggregate.first().asDict()


def in_ranges(counts: DataFrame, order: Sequence[str]) -> DataFrame:
    """Written in ranges of ``order``, which ``_part`` numbers in that order."""
    return materialize(counts.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")


def _ordered(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the finite doubles; both zeros are one."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def _bin_counts(rows: DataFrame, n_columns: int, wanted: dict[int, list[int]], depth: int) -> list:
    """Rows, smallest and largest value in the bins of the wanted prefixes, from one pass; counts are added up inside tasks first.

    A prefix is the first ``depth`` bits of an ordered number, a bin the next ``DIGIT`` ones.
    """
    width = min(DIGIT, 64 - depth)
    sizes = 1 << width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {j: (np.zeros(len(p) * sizes, np.int64), np.full(len(p) * sizes, np.inf), np.full(len(p) * sizes, -np.inf)) for j, p in wanted.items()}
        for batch in batches:
            for j, prefixes in wanted.items():
                x = batch.column(j).drop_null().to_numpy(zero_copy_only=False)
                key = _ordered(x)
                if depth:
                    have = key >> np.uint64(64 - depth)
                    at = np.minimum(np.searchsorted(np.array(prefixes, np.uint64), have), len(prefixes) - 1)
                    mine = np.array(prefixes, np.uint64)[at] == have
                    x, key, at = x[mine], key[mine], at[mine]
                else:
                    at = np.zeros(len(x), np.int64)
                place = at * sizes + ((key >> np.uint64(64 - depth - width)) & np.uint64(sizes - 1)).astype(np.int64)
                n, low, high = found[j]
                n += np.bincount(place, minlength=len(n))
                np.minimum.at(low, place, x)
                np.maximum.at(high, place, x)
        for j, (n, low, high) in found.items():
            some = np.flatnonzero(n)
            columns = [np.full(len(some), j), some // sizes, some % sizes, n[some], low[some], high[some]]
            types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["column", "prefix", "bin", "n", "low", "high"])

    counts = rows.mapInArrow(run, "column int, prefix int, bin int, n long, low double, high double")
    total = counts.groupBy("column", "prefix", "bin").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    return sorted(tuple(r) for r in total.collect())  # at most 2**DIGIT rows for each wanted prefix


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """``(column, p, value)`` with linear interpolation between order statistics; what is no finite number is ignored.

    The numbers are refined digit by digit: a pass counts the next bits of those rows whose bits so far lead to a wanted rank,
    until the bin that holds it has one value. Counts of bins are shuffled, never values, and there are at most five passes.
    """
    spark = df.sparkSession
    names = list(dict.fromkeys(columns))
    data = coerce_numbers(df.select(*names), names)
    rows = materialize(data.select(*[F.col(c).cast("double").alias(f"c{j}") for j, c in enumerate(names)]), "numbers")
    values: dict[tuple[int, int], float] = {}
    totals: dict[int, int] = {}
    # by column and prefix: (rank among the rows of the prefix, rank among all)
    open_: dict[int, dict[int, list[tuple[int, int]]]] = {j: {0: []} for j in range(len(names))}
    depth = 0
    while open_:
        wanted = {j: sorted(p) for j, p in open_.items()}
        bins = _bin_counts(rows, len(names), wanted, depth)
        if depth == 0:
            for j, _, _, n, _, _ in bins:
                totals[j] = totals.get(j, 0) + n
            for j, n in totals.items():
                ranks = {f(p * (n - 1)) for p in probs for f in (math.floor, math.ceil)}
                open_[j][0] = [(r, r) for r in sorted(ranks)]
        ahead: dict[int, dict[int, list[tuple[int, int]]]] = {}
        before: dict[tuple[int, int], int] = {}
        width = min(DIGIT, 64 - depth)
        for j, place, b, n, low, high in bins:
            prefix = wanted[j][place]
            start = before.get((j, prefix), 0)
            before[j, prefix] = start + n
            here = [(r - start, whole) for r, whole in open_[j][prefix] if start <= r < start + n]
            if here and low == high:
                values.update({(j, whole): low for _, whole in here})
            elif here:
                ahead.setdefault(j, {})[prefix << width | b] = here
        open_, depth = ahead, depth + width
    out = []
    for j, c in enumerate(names):
        for p in probs if j in totals else ():
            pos = float(p) * (totals[j] - 1)
            low, high = values[j, math.floor(pos)], values[j, math.ceil(pos)]
            out.append((c, float(p), low + (high - low) * (pos - math.floor(pos))))
    return spark.createDataFrame(out, "column string, p double, value double")


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Exact medians of several columns: one row of them."""
    found = exact_quantiles(df, columns, [0.5])
    return one_row(found.agg(*[F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in columns]))


def counts_below(
    counts: DataFrame, keys: Sequence[str], value: str, measures: Sequence[str]
) -> DataFrame:
    """Add ``below_<m>`` (sum of m over smaller values) and ``total_<m>`` per key, exactly.

    ``counts`` has one row per key and distinct value.
    """
    parts = in_ranges(counts, [*keys, value])
    over_keys = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    offsets = parts.groupBy(*keys, "_part").agg(*[F.sum(m).alias(f"_in_{m}") for m in measures])
    offsets = offsets.select(
        *keys,
        "_part",
        *[(F.sum(f"_in_{m}").over(over_keys.orderBy("_part")) - F.col(f"_in_{m}")).alias(f"_off_{m}") for m in measures],
        *[F.sum(f"_in_{m}").over(over_keys).alias(f"total_{m}") for m in measures],
    )
    inside = Window.partitionBy(*keys, "_part").orderBy(value)
    ranked = parts.withColumns({f"_run_{m}": F.sum(m).over(inside) - F.col(m) for m in measures})
    return ranked.join(offsets, [*keys, "_part"]).select(
        *counts.columns,
        *[(F.col(f"_off_{m}") + F.col(f"_run_{m}")).alias(f"below_{m}") for m in measures],
        *[f"total_{m}" for m in measures],
    )
