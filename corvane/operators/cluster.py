"""Hierarchical clustering of vectors.

The average cosine distance of two groups is one minus the product of their
mean unit vectors, so average linkage needs of a group only its mean and size.
Groups too large for one task are therefore clustered in rounds: vectors are
dealt by similarity into blocks of bounded size, the clusters of all blocks go
on as means with sizes, and so forth until one block holds a whole group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.scratch import written

#: Distance at which groups stop merging by mode, most nodes clustered at once, most members of a leaf.
DISTANCES = {"precise": 0.30, "balanced": 0.40, "complete": 0.50}
DISTANCE, BLOCK, LEAF = DISTANCES["balanced"], 512, 50
#: Rounds after which a group with more than ``BLOCK`` clusters stays as it is.
ROUNDS = 12


def average_linkage(means: np.ndarray, distance: float, sizes: np.ndarray | None = None) -> np.ndarray:
    """Cluster numbers from merging the two closest groups until they are farther apart than ``distance``.
    Rows are mean unit vectors of groups of ``sizes``; single vectors are brought to unit length."""
    n = len(means)
    if sizes is None:
        means = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
    gaps = 1 - means @ means.T
    np.fill_diagonal(gaps, np.inf)
    weight, label = np.ones(n) if sizes is None else sizes.astype(float), np.arange(n)
    while n > 1:
        i, j = divmod(int(gaps.argmin()), len(gaps))
        if gaps[i, j] > distance:
            break
        i, j = min(i, j), max(i, j)
        merged = (gaps[i] * weight[i] + gaps[j] * weight[j]) / (weight[i] + weight[j])
        gaps[i], gaps[:, i] = merged, merged
        gaps[i, i] = np.inf
        gaps[j], gaps[:, j] = np.inf, np.inf
        weight[i] += weight[j]
        label[label == j] = i
        n -= 1
    return label


def _direction(k: int, dim: int) -> list[float]:
    x = np.random.default_rng(k).normal(size=dim)
    return (x / np.linalg.norm(x)).tolist()


def clusters(rows: DataFrame, group: str, distance: float = DISTANCE, block: int = BLOCK) -> DataFrame:
    """(fp, group, cluster) of rows (fp, group, embedding); a cluster is named by its smallest fp. Equal
    vectors share a block in every round, so they never part. Rows without a direction are left out."""
    unit = rows.select("fp", F.col(group).alias("grp"), F.col("embedding").alias("x"))
    unit = unit.select("fp", "grp", F.when(V.norm(F.col("x")) > 1e-6, F.transform("x", lambda y: y.cast("double") / V.norm(F.col("x")))).alias("mean")).where("mean IS NOT NULL")
    nodes = written(unit.select("grp", F.col("fp").alias("node"), "mean", F.lit(1).cast("long").alias("n")), "cluster-nodes")
    members = nodes.select(F.col("node").alias("fp"), "grp", "node")
    head = nodes.head()
    if head is None:
        return members.select("fp", F.col("grp").alias(group), F.col("node").alias("cluster"))
    dim, kind = len(head["mean"]), nodes.schema["grp"].dataType.simpleString()

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node").reset_index(drop=True)
        label = average_linkage(np.stack(part["mean"].to_numpy()), distance, part["n"].to_numpy())
        part["into"] = part["node"].iloc[label].to_numpy()
        total = part.groupby("into")["n"].transform("sum")
        weighted = np.stack(part["mean"].to_numpy()) * (part["n"] / total).to_numpy()[:, None]
        mean = {k: weighted[at].sum(axis=0) for k, at in part.groupby("into").indices.items()}
        return pd.DataFrame({"grp": part["grp"], "node": part["node"], "into": part["into"], "mean": [mean[k] for k in part["into"]], "n": total})

    for k in range(ROUNDS):
        along = V.dot(F.col("mean"), F.array(*map(F.lit, _direction(k, dim))))
        nodes = nodes.withColumn("along", along)
        # cut points so that a block holds about ``block`` nodes; their number grows with the group, not their task
        parts = nodes.groupBy("grp").agg(F.count(F.lit(1)).alias("size")).withColumn("parts", F.ceil(F.col("size") / block).cast("int"))
        most = parts.agg(F.max("parts")).first()[0]
        if most > 1:
            share = [i / most for i in range(1, most)]
            cuts = nodes.groupBy("grp").agg(F.percentile_approx("along", share, 10_000).alias("cuts"))
            dealt = nodes.join(cuts, "grp").join(parts, "grp").withColumn("block", F.when(F.col("parts") > 1, F.size(F.filter("cuts", lambda c: c < F.col("along")))).otherwise(0))
        else:
            dealt = nodes.withColumn("block", F.lit(0))
        merged = written(dealt.select("grp", "block", "node", "mean", "n").groupBy("grp", "block").applyInPandas(run, f"grp {kind}, node string, into string, mean array<double>, n long"), "cluster-round")
        members = written(members.join(merged.select("grp", "node", "into"), ["grp", "node"]).select("fp", "grp", F.col("into").alias("node")), "cluster-members")
        nodes = merged.where("node = into").select("grp", "node", "mean", "n")
        if most == 1:
            break
    return members.select("fp", F.col("grp").alias(group), F.col("node").alias("cluster"))


def cluster_vectors(rows: DataFrame, group: str, mode: str = "balanced", block: int = BLOCK) -> DataFrame:
    """(fp, folder, leaf) of rows (fp, group, embedding): a folder for each cluster of a group, in leaves of
    ``LEAF`` members. Single rows are unclassified, but in mode ``complete``."""
    found = clusters(rows, group, DISTANCES[mode], block)
    sizes = found.groupBy(group, "cluster").agg(F.count(F.lit(1)).alias("members"))
    found = found.join(sizes, [group, "cluster"])
    name = F.when((F.col("members") == 1) & F.lit(mode != "complete"), "unclassified").otherwise(F.col("cluster"))
    folder = F.concat(F.col(group).cast("string"), F.lit("/"), name)
    place = F.row_number().over(Window.partitionBy(group, "cluster").orderBy("fp")) - 1
    return found.select("fp", folder.alias("folder"), F.floor(place / LEAF).cast("long").alias("leaf"))
