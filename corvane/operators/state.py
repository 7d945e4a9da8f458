"""Stateful folds in closed form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def crash_breaker(events: DataFrame, limit: int = 2) -> DataFrame:
    """Per boot (boot, at, kind): the crash count and whether the breaker is open.

    A crash (``error``) counts one. An explicit preheat (``signup``) clears the
    count, and any crash after one sets it to the limit at once. Only crashes
    since the last preheat matter, so two aggregations replace the fold.
    """
    heat = events.groupBy("boot").agg(F.max(F.when(F.col("kind") == "signup", F.col("at"))).alias("heated"))
    errors = events.where("kind = 'error'").join(heat, "boot").where(F.col("heated").isNull() | (F.col("at") > F.col("heated"))).groupBy("boot").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    count = F.when(F.col("heated").isNull(), n).when(n > 0, limit).otherwise(0).cast("long")
    return heat.join(errors, "boot", "left").select("boot", count.alias("crashes"), (count >= limit).alias("is_open"))
