"""Limits of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def request_limits(rows: DataFrame, most_texts: int = 100, most_bytes: int = 64 << 10, most_chars: int = 2_000_000, embedded: int = 1000) -> DataFrame:
    """(conv_id, turn, outcome) of the texts of each request: ``refused`` with all others of a request that has too
    many or too large ones, ``too long`` by itself, ``cut off`` after the first ``embedded``, or ``taken``."""
    c = rows.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    sums = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.octet_length("text")).alias("bytes"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    outcome = F.when((F.col("texts") > most_texts) | (F.col("bytes") > most_bytes), "refused").when(F.char_length("text") > most_chars, "too long").when(F.col("place") > embedded, "cut off").otherwise("taken")
    return c.withColumn("place", place).join(sums, "conv_id").select("conv_id", "turn", outcome.alias("outcome"))
