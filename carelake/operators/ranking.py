"""Top-k reports. A limit of k rows is taken first, so windows only ever see those k rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def topn(df: DataFrame, score: str, key: str, n: int) -> DataFrame:
    """The n highest scores; ties go to the smaller key."""
    return df.orderBy(F.desc(score), F.asc(key)).limit(n)


def best_row(df: DataFrame, name: str, metric: str) -> DataFrame:
    """Name with the highest metric; a tie goes to the smaller name."""
    found = df.agg(F.min_by(F.struct(name, metric), F.struct(-F.col(metric), F.col(name))).alias("b"))
    return found.select(f"b.{name}", f"b.{metric}")


def topk_others(df: DataFrame, name: str, value: Column, k: int) -> DataFrame:
    """Sum of the k largest names and of all the rest as ``Others``, with shares."""
    sums = df.groupBy(F.col(name).alias("name")).agg(F.sum(value).alias("value"))
    top = topn(sums, "value", "name", k).select("name", F.lit(True).alias("_top"))
    # k rows
    labelled = sums.join(F.broadcast(top), "name", "left")
    grouped = labelled.groupBy(F.when(F.col("_top"), F.col("name")).otherwise("Others").alias("name")).agg(F.sum("value").alias("value"))
    total = F.sum("value").over(Window.partitionBy(F.lit(0)))
    return grouped.withColumn("share", F.col("value") / total)


def ranked(df: DataFrame, score: str, key: str, n: int) -> DataFrame:
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc(score), F.asc(key))
    return topn(df, score, key, n).withColumn("rank", F.row_number().over(order))


def rank_align(left: DataFrame, right: DataFrame, name: str, score: str, n: int) -> DataFrame:
    """Two top-n lists side by side by rank."""
    a = ranked(left, score, name, n).select("rank", F.col(name).alias("left_name"), F.col(score).alias("left_score"))
    b = ranked(right, score, name, n).select("rank", F.col(name).alias("right_name"), F.col(score).alias("right_score"))
    return a.join(b, "rank", "full")


def topk_intersect(left: DataFrame, right: DataFrame, name: str, score: str, k: int) -> DataFrame:
    """Names in both top-k lists, and whether both lists have the same winner."""
    a, b = ranked(left, score, name, k), ranked(right, score, name, k)
    winner = a.where("rank = 1").select(F.col(name).alias("_w")).intersect(b.where("rank = 1").select(F.col(name).alias("_w")))
    common = a.select(name).intersect(b.select(name))
    return common.join(winner, F.col(name) == F.col("_w"), "left").select(name, F.col("_w").isNotNull().alias("is_shared_winner"))
