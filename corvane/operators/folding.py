"""Folding of taxonomy paths: nodes are kept, hoisted away, flattened or rejected."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FoldRules:
    """Codes and classes that decide a node's policy."""

    reject: tuple[str, ...] = ()
    hoist: tuple[str, ...] = ()
    action: tuple[str, ...] = ()
    reject_pos: tuple[str, ...] = ("m", "q", "p", "c", "u", "y", "o", "h", "w", "b", "x")


def is_action(code: Column, pos: Column, rules: FoldRules) -> Column:
    """Verbs and modifiers, told by part of speech or by the code's suffix."""
    by_pos = F.coalesce(F.lower(F.trim(pos)).isin("v", "a", "s", "r"), F.lit(False))
    return code.isin(*rules.action, "") | by_pos | (code.startswith("omw.") & code.rlike("\\.[vasr]$"))


def fold_policy(code: Column, pos: Column, root: Column, rules: FoldRules) -> Column:
    """keep, hoist, flatten or reject; roots are flattened or kept unless their code is rejected."""
    rejected = code.isin(*rules.reject, "")
    action = is_action(code, pos, rules)
    return (
        F.when(rejected, "reject")
        .when(root & action, "flatten")
        .when(root, "keep")
        .when(F.coalesce(F.trim(pos).isin(*rules.reject_pos), F.lit(False)), "reject")
        .when(action, "flatten")
        .when(code.isin(*rules.hoist, ""), "hoist")
        .otherwise("keep")
    )


def folded_rollup(facts: DataFrame, segments: Column, rules: FoldRules) -> DataFrame:
    """Distinct files of every displayed node from (id, path).

    A path with a rejected node loses its files; hoisted nodes vanish and their
    children take their place; below a flattened node every deeper node hangs
    directly under it, merged by code.
    """
    s = F.col("__s")
    policy = lambda x, i: fold_policy(x, F.lit(None).cast("string"), i == 0, rules)
    rows = facts.select("id", segments.alias("__s")).where(~F.exists(s, lambda x: x.isin(*rules.reject, "")))
    rows = rows.withColumn("__s", F.filter(s, lambda x, i: policy(x, i) != "hoist"))
    first = F.array_min(F.filter(F.transform(s, lambda x, i: F.when(policy(x, i) == "flatten", i)), lambda x: x.isNotNull()))
    rows = rows.withColumn("__f", F.coalesce(first, F.size(s)))
    path = lambda n: F.concat(F.lit("/"), F.array_join(F.slice(s, F.lit(1), n), "/"))
    node = lambda i: F.when(i <= F.col("__f"), path(i + 1)).otherwise(F.concat(path(F.col("__f") + 1), F.lit("/"), F.get(s, i)))
    nodes = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(s) - 1), node))
    pairs = rows.where(F.size(s) > 0).select("id", F.explode(nodes).alias("node")).distinct()
    return pairs.groupBy("node").agg(F.count("id").alias("files"))
