"""Folded trees and the merging of their nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.folding import FoldRules, fold_policy, folded_rollup
from ..operators.ordering import positions
from ..operators.tree import segments
from ..sources import views
from .base import query
from .taxonomy import tagged_files

RULES = FoldRules(reject=("builtin.promo",), hoist=("builtin.small",), action=("builtin.economy",))


@query("""
    WITH f AS (SELECT w.id, string_split(substr(r.code_path, 2), '/') AS s FROM file_tag_relations r JOIN workspace_files w USING (file_fingerprint) WHERE w.status = 1),
    k AS (SELECT id, list_filter(s, lambda x: x <> 'builtin.small') AS s FROM f WHERE NOT list_contains(s, 'builtin.promo')),
    n AS (SELECT id, s, unnest(range(1, len(s) + 1)) AS i, coalesce(nullif(list_position(s, 'builtin.economy'), 0), len(s) + 1) AS a FROM k),
    d AS (SELECT DISTINCT id, CASE WHEN i <= a THEN '/' || array_to_string(s[1:i], '/') ELSE '/' || array_to_string(s[1:a], '/') || '/' || s[i] END AS node FROM n)
    SELECT node, count(*) AS files FROM d GROUP BY 1
""")
def tre13_folded_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folded_rollup(tagged_files(spark, sf_dir), segments(F.col("code_path")), RULES)


POLICY_CODES = ["builtin.promo", "builtin.small", "builtin.economy", "omw.run.v", "builtin.x", "hownet.1.n", "omw.red.a", "omw.big.s", "omw.fast.r", "_ext.v"]
POLICY_POS = [None, "v", "m", "n", " A ", "x", "r", " q "]


@query(f"""
    WITH n AS (SELECT p_partkey, ([{", ".join(repr(c) for c in POLICY_CODES)}])[1 + p_partkey % 10] AS code, ([NULL, 'v', 'm', 'n', ' A ', 'x', 'r', ' q '])[1 + p_size % 8] AS pos, p_partkey % 7 = 0 AS is_root FROM part),
    a AS (SELECT *, code = 'builtin.economy' OR coalesce(lower(trim(pos)) IN ('v', 'a', 's', 'r'), FALSE) OR (starts_with(code, 'omw.') AND regexp_matches(code, '[.][vasr]$')) AS action FROM n)
    SELECT p_partkey, CASE WHEN code = 'builtin.promo' THEN 'reject' WHEN is_root AND action THEN 'flatten' WHEN is_root THEN 'keep' WHEN trim(pos) IN ('m', 'q', 'p', 'c', 'u', 'y', 'o', 'h', 'w', 'b', 'x') THEN 'reject'
                  WHEN action THEN 'flatten' WHEN code = 'builtin.small' THEN 'hoist' ELSE 'keep' END AS policy FROM a
""")
def tre13_fold_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda values, k: F.get(F.array(*[F.lit(v) for v in values]), k.cast("int"))
    nodes = views.table(spark, sf_dir, "part").select("p_partkey", at(POLICY_CODES, F.col("p_partkey") % 10).alias("code"), at(POLICY_POS, F.col("p_size") % 8).alias("pos"), (F.col("p_partkey") % 7 == 0).alias("is_root"))
    return nodes.select("p_partkey", fold_policy(F.col("code"), F.col("pos"), F.col("is_root"), RULES).alias("policy"))


@query("""
    WITH f AS (SELECT w.id, 'k' || right(r.tag_code, 1) AS name, split_part(r.code_path, '/', 3) AS parent FROM file_tag_relations r JOIN workspace_files w USING (file_fingerprint) WHERE w.status = 1)
    SELECT parent, name, count(DISTINCT id) AS files FROM f GROUP BY 1, 2
""")
def agg5_same_name_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Siblings of one display name become one node, their files united."""
    leaf = F.split_part("code_path", F.lit("/"), F.lit(-1))
    rows = tagged_files(spark, sf_dir).select("id", F.concat(F.lit("k"), F.right(leaf, F.lit(1))).alias("name"), F.split_part("code_path", F.lit("/"), F.lit(3)).alias("parent"))
    return rows.groupBy("parent", "name").agg(F.count_distinct("id").alias("files"))


@query("""
    WITH r AS (SELECT leaf_code, path_id, path_id % 3 AS sort_order, CASE WHEN path_id % 2 = 0 THEN 'builtin' ELSE 'omw' END AS source FROM tag_paths),
    u AS (SELECT *, row_number() OVER (PARTITION BY leaf_code ORDER BY source, sort_order, path_id) AS k FROM r)
    SELECT leaf_code, path_id, row_number() OVER (ORDER BY source, CASE WHEN sort_order > 0 THEN sort_order ELSE 2147483647 END, leaf_code) AS position FROM u WHERE k = 1
""")
def srt3_root_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Controlled roots first, one of each name, then by sort order and code."""
    r = views.tag_paths(spark, sf_dir).select("leaf_code", "path_id", (F.col("path_id") % 3).alias("sort_order"), F.when(F.col("path_id") % 2 == 0, "builtin").otherwise("omw").alias("source"))
    one = r.groupBy("leaf_code").agg(F.min(F.struct("source", "sort_order", "path_id")).alias("t")).select("leaf_code", "t.*")
    last = F.when(F.col("sort_order") > 0, F.col("sort_order")).otherwise(2147483647)
    return one.select("leaf_code", "path_id", F.row_number().over(Window.orderBy("source", last, "leaf_code")).alias("position"))


@query("SELECT tag_code, locale, lemma, row_number() OVER (ORDER BY tag_code, is_canonical DESC, n DESC, lemma, locale) AS position FROM tag_aliases")
def srt4_alias_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(views.tag_aliases(spark, sf_dir), "tag_code", F.desc("is_canonical"), F.desc("n"), "lemma", "locale").select("tag_code", "locale", "lemma", "position")


@query("SELECT file, code, min(ordinal) AS ordinal FROM scored_tags GROUP BY 1, 2")
def agg10_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each code once, where it was seen first."""
    return views.scored_tags(spark, sf_dir).groupBy("file", "code").agg(F.min("ordinal").alias("ordinal"))


@query("SELECT file, arg_min(code, (-confidence, ordinal)) AS code FROM scored_tags WHERE dim = 'O' GROUP BY 1")
def agg9_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.struct((-F.col("confidence")).alias("c"), "ordinal")
    return views.scored_tags(spark, sf_dir).where("dim = 'O'").groupBy("file").agg(F.min_by("code", best).alias("code"))


@query("""
    WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)
    SELECT label, n, 2 * max(n) OVER () > sum(n) OVER () AS lopsided FROM c
""")
def agg19_cluster_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the largest cluster holds more than half of all."""
    c = views.table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.max("n").alias("top"), F.sum("n").alias("total"))
    return c.join(F.broadcast(total)).select("label", "n", (2 * F.col("top") > F.col("total")).alias("lopsided"))  # one row


@query("""
    SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN lower(p_type) || '|' || lower(p_brand) WHEN 1 THEN lower(p_type) ELSE '' END AS parents, CASE p_partkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS n FROM part
""")
def jsn1_parent_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent codes from JSON; what is no array is none."""
    part = views.table(spark, sf_dir, "part")
    kind, brand, key = F.lower("p_type"), F.lower("p_brand"), F.col("p_partkey") % 5
    text = F.when(key == 0, F.to_json(F.array(kind, brand))).when(key == 1, F.concat(F.lit('[ "'), kind, F.lit('" ]'))).when(key == 2, F.concat(F.lit('{"a": "'), kind, F.lit('"}'))).when(key == 3, "nope")
    parents = F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
    return part.select("p_partkey", F.array_join(parents, "|").alias("parents"), F.size(parents).alias("n"))
