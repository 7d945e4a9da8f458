"""Connected components of an edge table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize


def connected_components(edges: DataFrame, jumps: int = 2) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the component's smallest node.

    Each round hooks every node to its smallest neighbour, follows those
    pointers ``jumps`` times and contracts the graph, until no edge is left. All
    steps are joins and aggregations with map-side combining, and each round's
    tables are written, so that no lineage grows. Nothing is collected.
    """
    links = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    labels = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("p"))
        parent = materialize(parent, "parents")
        for _ in range(jumps):
            above = parent.select(F.col("node").alias("p"), F.col("p").alias("pp"))
            parent = parent.join(above, "p", "left").select("node", F.coalesce("pp", "p").alias("p"))
        parent = materialize(parent, "parents")
        if labels is None:
            labels = parent.select("node", F.col("p").alias("root"))
        else:
            labels = labels.join(parent.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("p", "root").alias("root"))
        labels = materialize(labels, "labels")
        of_a, of_b = parent.select(F.col("node").alias("a"), F.col("p").alias("ra")), parent.select(F.col("node").alias("b"), F.col("p").alias("rb"))
        links = links.join(of_a, "a").join(of_b, "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        links = materialize(links.where("a < b").distinct(), "links")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    return labels
