"""Exact stratified splits and folds by a hash of the row id.

A row's place in its class is the order of its hash. The hash value at each cut is found from
prefix counts and from the rows of the one prefix that holds the cut, so assigning rows is a projection:
no class is sorted and no row is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFIX_DIGITS = 4
HASH_DIGITS = 15


def row_hash(key: str, seed: int) -> Column:
    """First 15 hex digits of the md5 of id and seed; fixed width, so text order is number order."""
    return F.substring(F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed)))), 1, HASH_DIGITS)


def hash_cuts(df: DataFrame, label: str, key: str, fractions: Sequence[float], seed: int) -> dict[str, list[tuple[int, str, str] | None]]:
    """Per class and fraction the largest (hash, id) that lies below the cut; None when the cut is 0 rows."""
    hashed = df.select(
        F.col(label).cast("string").alias("label"), F.col(key).cast("string").alias("key"), row_hash(key, seed).alias("hash")
    ).withColumn("prefix", F.substring("hash", 1, PREFIX_DIGITS))
    by_prefix = Window.partitionBy("label").orderBy("prefix")
    wanted = F.array(*[F.struct(F.lit(i).alias("cut"), F.lit(float(f)).alias("fraction")) for i, f in enumerate(fractions)])
    targets = (
        hashed.groupBy("label", "prefix")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("through", F.sum("n").over(by_prefix))
        .withColumn("total", F.sum("n").over(Window.partitionBy("label")))
        .select("label", "prefix", "n", "through", "total", F.inline(wanted))
        .withColumn("rank", F.floor(F.col("fraction") * F.col("total") + 0.5))
        .where("rank > through - n AND rank <= through")
        .select("label", "prefix", "cut", (F.col("rank") - F.col("through") + F.col("n")).alias("offset"))
    )
    # one row per class and cut
    inside = Window.partitionBy("label", "cut").orderBy("hash", "key")
    found = (
        hashed.join(F.broadcast(targets), ["label", "prefix"])
        .withColumn("rn", F.row_number().over(inside))
        .where("rn = offset")
        .select("label", "cut", "hash", "key")
    )
    cuts: dict[str, list] = {}
    for row in found.collect():
        cuts.setdefault(row["label"], [None] * len(fractions))[row["cut"]] = (row["hash"], row["key"])
    return cuts


def _below(label: str, key: str, seed: int, cuts: dict[str, list], i: int) -> Column:
    h, k = row_hash(key, seed), F.col(key).cast("string")
    chain = F.lit(False)
    for name, values in cuts.items():
        if values[i] is not None:
            hash_cut, key_cut = values[i]
            under = (h < hash_cut) | ((h == hash_cut) & (k <= key_cut))
            chain = F.when(F.col(label).cast("string") == name, under).otherwise(chain)
    return chain


def stratified_split(df: DataFrame, label: str, key: str, test_fraction: float = 0.2, seed: int = 0) -> DataFrame:
    """Add ``is_test``: in each class the given share of rows, to the nearest row."""
    cuts = hash_cuts(df, label, key, [test_fraction], seed)
    return df.withColumn("is_test", _below(label, key, seed, cuts, 0))


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold`` 0..k-1; fold sizes within a class differ by at most one row."""
    cuts = hash_cuts(df, label, key, [i / k for i in range(1, k)], seed)
    fold = F.lit(k - 1)
    for i in range(k - 1):
        fold = fold - _below(label, key, seed, cuts, i).cast("int")
    return df.withColumn("fold", fold)
