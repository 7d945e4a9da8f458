"""Closures and components over edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written


def ancestors(edges: DataFrame, max_depth: int) -> DataFrame:
    """(code, ancestor, distance) up to ``max_depth`` steps over edges (code, parent); of several
    ways the shortest counts. Each level is written once; the walk ends with the first level
    that reaches nothing new, so cycles and generous bounds cost nothing."""
    step = written(edges.where("parent IS NOT NULL").select("code", "parent").distinct(), "edges")
    up = step.select(F.col("code").alias("ancestor"), F.col("parent").alias("next"))
    levels = [step.select("code", F.col("parent").alias("ancestor"), F.lit(1).alias("distance"))]
    for distance in range(2, max_depth + 1):
        further = levels[-1].join(up, "ancestor").select("code", F.col("next").alias("ancestor"), F.lit(distance).alias("distance")).distinct()
        for level in levels:
            further = further.join(level.select("code", "ancestor"), ["code", "ancestor"], "left_anti")
        further = written(further, "level")
        if further.isEmpty():
            break
        levels.append(further)
    return reduce(DataFrame.unionByName, levels)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the component's smallest node.

    Each round every node takes the smallest root among its neighbours, twice
    along pointers, and the graph is contracted; rounds are joins and aggregations
    with map-side combining and end when no edge is left.
    """
    links = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    roots = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = written(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("up")), "parents")
        for _ in range(2):
            above = parent.select(F.col("node").alias("up"), F.col("up").alias("higher"))
            parent = parent.join(above, "up", "left").select("node", F.coalesce("higher", "up").alias("up"))
        parent = written(parent, "parents")
        if roots is None:
            roots = parent.select("node", F.col("up").alias("root"))
        else:
            roots = roots.join(parent.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        roots = written(roots, "roots")
        for end in "ab":
            links = links.join(parent.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("up", end)).drop("up")
        links = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
