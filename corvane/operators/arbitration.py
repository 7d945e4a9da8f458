"""Operators that decide between scored tags (file, ordinal, code, dim, confidence)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

THRESHOLD = 0.60


def above_threshold(tags: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """NaN is below any threshold, although Spark orders it above all numbers."""
    return tags.where(~F.isnan("confidence") & (F.col("confidence") >= threshold))


def single_select(tags: DataFrame, dims: list[str]) -> DataFrame:
    """The most confident tag, first of equals, in each dimension that takes one."""
    order = Window.partitionBy("file", "dim").orderBy(F.desc("confidence"), "ordinal")
    return tags.withColumn("__k", F.row_number().over(order)).where(~F.col("dim").isin(dims) | (F.col("__k") == 1)).drop("__k")


def opposition_losers(tags: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(file, code) of the opposed concepts that lose in their file.

    Each concept counts with its best confidence (a number before NaN, the
    first of equals). Verdicts of pairs are independent, so a loser still defeats
    its other opponents.
    """
    value = F.when(F.isnan("confidence"), F.lit(float("-inf"))).otherwise(F.col("confidence"))
    best = tags.groupBy("file", "code").agg(F.min(F.struct((-value).alias("c"), F.col("ordinal").alias("o"))).alias("best"))
    table = tags.sparkSession.createDataFrame(sorted({(min(p), max(p)) for p in pairs if p[0] != p[1]}), "x string, y string")
    left = best.select("file", F.col("code").alias("x"), F.col("best").alias("bx"))
    right = best.select("file", F.col("code").alias("y"), F.col("best").alias("by"))
    met = left.join(F.broadcast(table), "x").join(right, ["file", "y"])  # the pair table is the caller's list
    return met.select("file", F.when(F.col("bx") < F.col("by"), F.col("y")).otherwise(F.col("x")).alias("code")).distinct()


def winner_by_margin(scores: DataFrame, group: list[str], least: float, margin: float) -> DataFrame:
    """Rows (group, code, c) whose score is the group's best, at least ``least``, and ahead of the second by ``margin``."""
    top = scores.groupBy(*group).agg(F.min(F.struct((-F.col("c")).alias("c"), "code")).alias("t"))
    others = scores.join(top.select(*group, F.col("t.code").alias("__best")), group).where(F.col("code") != F.col("__best"))
    top = top.join(others.groupBy(*group).agg(F.max("c").alias("__second")), group, "left")
    second = F.col("__second")
    ok = (-F.col("t.c") >= least) & (second.isNull() | F.isnan(second) | (F.round(-F.col("t.c") - second, 6) >= margin))
    return top.where(ok).select(*group, "t.code")
