"""Projections of the input tables to the engine's logical tables.

Each view exists twice, as a DataFrame and as SQL, and both have the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SQL: dict[str, str] = {
    "workspace_files": """
        SELECT o_orderkey AS id, 'fp_' || o_orderkey AS file_fingerprint,
               '/ws/' || lower(o_orderstatus) || '/' || o_orderkey AS path,
               o_custkey % 3 AS workspace_id, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END AS status
        FROM orders""",
    "tag_paths": """
        SELECT row_number() OVER (ORDER BY code_path) AS path_id, leaf_code, code_path, 3 AS depth
        FROM (SELECT DISTINCT 'builtin.' || lower(replace(p_brand, '#', '_')) AS leaf_code,
                     '/builtin.content_tags/builtin.' || lower(p_type) || '/builtin.' || lower(replace(p_brand, '#', '_')) AS code_path
              FROM part)""",
    "file_tag_relations": """
        SELECT 'fp_' || l_orderkey AS file_fingerprint,
               'builtin.' || lower(replace(p_brand, '#', '_')) AS tag_code,
               '/builtin.content_tags/builtin.' || lower(p_type) || '/builtin.' || lower(replace(p_brand, '#', '_')) AS code_path,
               1 - max(l_discount) AS confidence
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3""",
    "tag_aliases": """
        SELECT tag_code, locale, lemma, bool_or(canonical) AS is_canonical, max(n) AS n
        FROM (SELECT 'builtin.' || lower(replace(p_brand, '#', '_')) AS tag_code,
                     CASE WHEN p_partkey % 2 = 0 THEN 'en' ELSE 'fr' END AS locale,
                     p_name AS lemma, p_partkey % 5 = 0 AS canonical, p_size AS n
              FROM part) GROUP BY 1, 2, 3""",
    "scored_tags": """
        SELECT l_orderkey AS file, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ordinal,
               'builtin.' || l_returnflag AS code, l_linestatus AS dim, round(1 - 5 * l_discount - 2 * l_tax, 4) AS confidence
        FROM lineitem""",
    "chain_tags": """
        SELECT file, ordinal, k % 8 AS kind, CASE WHEN k % 8 = 5 THEN 'builtin.frame' WHEN k % 8 = 7 THEN CASE WHEN s % 2 = 0 THEN 'omw.00918939.s' ELSE 'omw.02423762.v' END ELSE 'builtin.t' || s % 5 END AS code,
               CASE k % 8 WHEN 0 THEN 'builtin.system_ecology' WHEN 1 THEN 'builtin.subject_type' WHEN 2 THEN 'nowhere' WHEN 7 THEN 'builtin.emotion_tags' END AS via,
               CASE k % 8 WHEN 2 THEN ['x', 'builtin.time_season'] WHEN 3 THEN ['builtin.theme', 'builtin.frame'] END AS parents,
               CASE k % 8 WHEN 4 THEN '/builtin.file_type/ builtin.document_quality /builtin.t' || s % 5 WHEN 5 THEN '/a/builtin.frame' END AS path,
               CASE WHEN k % 29 = 0 THEN CAST('nan' AS DOUBLE) ELSE confidence END AS confidence
        FROM (SELECT l_orderkey AS file, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ordinal,
                     l_partkey AS k, l_suppkey AS s, round(1 - 5 * l_discount - 2 * l_tax, 4) AS confidence FROM lineitem)""",
    "tag_nodes": """
        SELECT 'r' || r_regionkey AS code, r_name AS name, CAST(NULL AS VARCHAR) AS parent FROM region
        UNION ALL SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey FROM nation
        UNION ALL SELECT DISTINCT 's_' || c_mktsegment, c_mktsegment, 'n' || c_nationkey FROM customer""",
    "words": """
        SELECT DISTINCT word FROM (
            SELECT unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]+')) AS word FROM documents)""",
    "tokens": """
        SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]+')) AS word FROM documents""",
}


def workspace_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("fp_"), "o_orderkey").alias("file_fingerprint"),
        F.concat(F.lit("/ws/"), F.lower("o_orderstatus"), F.lit("/"), "o_orderkey").alias("path"),
        (F.col("o_custkey") % 3).alias("workspace_id"),
        F.when(F.col("o_orderstatus") == "P", 0).otherwise(1).alias("status"),
    )


def _brand_code():
    return F.concat(F.lit("builtin."), F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("_"))))


def _code_path():
    return F.concat(F.lit("/builtin.content_tags/builtin."), F.lower("p_type"), F.lit("/"), _brand_code())


def tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path dictionary: distinct types and brands, so small at any scale."""
    paths = table(spark, sf_dir, "part").select(_brand_code().alias("leaf_code"), _code_path().alias("code_path")).distinct()
    return paths.select(F.row_number().over(Window.orderBy("code_path")).alias("path_id"), "leaf_code", "code_path", F.lit(3).alias("depth"))


def file_tag_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table, one row for each file and path."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_discount")
    part = table(spark, sf_dir, "part").select("p_partkey", _brand_code().alias("tag_code"), _code_path().alias("code_path"))
    facts = line.join(part, line.l_partkey == part.p_partkey)
    return facts.groupBy("l_orderkey", "tag_code", "code_path").agg((1 - F.max("l_discount")).alias("confidence")).select(F.concat(F.lit("fp_"), "l_orderkey").alias("file_fingerprint"), "tag_code", "code_path", "confidence")


def tag_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    rows = part.select(_brand_code().alias("tag_code"), F.when(F.col("p_partkey") % 2 == 0, "en").otherwise("fr").alias("locale"), F.col("p_name").alias("lemma"), (F.col("p_partkey") % 5 == 0).alias("canonical"), F.col("p_size").alias("n"))
    return rows.groupBy("tag_code", "locale", "lemma").agg(F.bool_or("canonical").alias("is_canonical"), F.max("n").alias("n"))


def scored_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("file"),
        F.row_number().over(order).alias("ordinal"),
        F.concat(F.lit("builtin."), "l_returnflag").alias("code"),
        F.col("l_linestatus").alias("dim"),
        F.round(1 - 5 * F.col("l_discount") - 2 * F.col("l_tax"), 4).alias("confidence"),
    )


def chain_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags with their parents, each kind placed in its dimension in another way, some without a number."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    k, s = F.col("l_partkey") % 8, F.col("l_suppkey")
    code = F.concat(F.lit("builtin.t"), s % 5)
    mood = F.when(s % 2 == 0, "omw.00918939.s").otherwise("omw.02423762.v")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("file"),
        F.row_number().over(order).alias("ordinal"),
        k.alias("kind"),
        F.when(k == 5, "builtin.frame").when(k == 7, mood).otherwise(code).alias("code"),
        F.when(k == 0, "builtin.system_ecology").when(k == 1, "builtin.subject_type").when(k == 2, "nowhere").when(k == 7, "builtin.emotion_tags").alias("via"),
        F.when(k == 2, F.array(F.lit("x"), F.lit("builtin.time_season"))).when(k == 3, F.array(F.lit("builtin.theme"), F.lit("builtin.frame"))).alias("parents"),
        F.when(k == 4, F.concat(F.lit("/builtin.file_type/ builtin.document_quality /"), code)).when(k == 5, "/a/builtin.frame").alias("path"),
        F.when(F.col("l_partkey") % 29 == 0, F.lit(float("nan"))).otherwise(F.round(1 - 5 * F.col("l_discount") - 2 * F.col("l_tax"), 4)).alias("confidence"),
    )


def tag_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taxonomy edges (code, name, parent): regions, nations, market segments."""
    region = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("code"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent"))
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey"), "n_name", F.concat(F.lit("r"), "n_regionkey"))
    segment = table(spark, sf_dir, "customer").select(F.concat(F.lit("s_"), "c_mktsegment"), "c_mktsegment", F.concat(F.lit("n"), "c_nationkey")).distinct()
    return region.union(nation).union(segment)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-zà-ÿ]+)"))).alias("word"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(spark, sf_dir).select("word").distinct()


VIEWS: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (workspace_files, tag_paths, file_tag_relations, tag_aliases, scored_tags, chain_tags, tag_nodes, tokens, words)}
__all__ = ["SQL", "VIEWS", "table", "with_views"]


def with_views(body: str) -> str:
    """``body`` with the views that it names in front of it."""
    used = [v for v in SQL if re.search(rf"\b{v}\b", body)]
    if not used:
        return body
    head = ", ".join(f"{v} AS ({SQL[v]})" for v in used)
    recursive = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", body, re.I)
    if recursive:
        return f"WITH {recursive[1] or ''}{head}, {body[recursive.end():]}"
    return f"WITH {head} {body}"
