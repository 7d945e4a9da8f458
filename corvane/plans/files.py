"""File listings, searches and small decisions about files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cluster import cluster_vectors
from ..sources import views
from ..sources.files import optional
from .base import query


@query("SELECT id, path FROM workspace_files WHERE contains(lower(path), 'ws/o/1') ORDER BY path LIMIT 100")
def flt12_name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-insensitive substring search in a total order, at most 100 hits."""
    limit = max(1, min(2000, 100))
    return views.workspace_files(spark, sf_dir).where(F.lower("path").contains("WS/O/1".lower())).orderBy("path").limit(limit).select("id", "path")


@query("SELECT id FROM workspace_files WHERE starts_with(lower(path), '/ws/f/')")
def flt11_strict_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = "\\WS\\F".replace("\\", "/").lower()
    return views.workspace_files(spark, sf_dir).where(F.lower(F.translate("path", "\\", "/")).startswith(base + "/")).select("id")


@query("SELECT code, regexp_matches(code, '^(builtin|omw|hownet)\\.') AS controlled FROM (SELECT DISTINCT tag_code AS code FROM tag_aliases UNION SELECT '_ext.a' UNION SELECT 'omw.b.n' UNION SELECT 'builtins')")
def flt10_controlled_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = views.tag_aliases(spark, sf_dir).select(F.col("tag_code").alias("code")).union(spark.createDataFrame([("_ext.a",), ("omw.b.n",), ("builtins",)], "code string")).distinct()
    return codes.select("code", F.col("code").rlike("^(builtin|omw|hownet)\\.").alias("controlled"))


@query("SELECT o_orderkey AS id, 0 AS status, 'none' AS owner, o_orderpriority AS priority FROM orders")
def src3_column_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that a table lacks become constants."""
    orders = views.table(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("id"), optional(orders, "status", 0), optional(orders, "owner", "none"), optional(orders, "o_orderpriority", "x").alias("priority"))


@query("""
    WITH d AS (SELECT doc_id, strlen(text) AS size, sha256(text) AS hash FROM documents),
    k AS (SELECT *, row_number() OVER (PARTITION BY size, hash ORDER BY doc_id) AS n FROM d)
    SELECT doc_id, CASE WHEN n = 1 THEN 'keep' ELSE 'remove' END AS action FROM k WHERE (size, hash) IN (SELECT (size, hash) FROM k WHERE n = 2)
""")
def snk5_fix_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a clean-up would do; nothing is removed."""
    docs = views.table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("size"), F.sha2("text", 256).alias("hash"))
    groups = docs.groupBy("size", "hash").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return docs.join(groups, ["size", "hash"]).select("doc_id", F.when(F.col("doc_id") == F.col("first"), "keep").otherwise("remove").alias("action"))


@query("SELECT source, count(*) AS n, count(*) * 100 // (SELECT count(*) FROM documents) AS percent FROM documents GROUP BY 1")
def snk4_progress_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress payloads of a scan by source."""
    docs = views.table(spark, sf_dir, "documents")
    total = docs.count()
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("percent", F.expr(f"n * 100 div {max(1, total)}"))


@query("SELECT doc_id, CASE WHEN length(text) >= 60 OR lang IN ('zh') THEN TRUE ELSE FALSE END AS expanded FROM documents")
def str29_expanded_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    cjk = F.char_length("text") - F.char_length(F.regexp_replace("text", "[\\x{4E00}-\\x{9FFF}]", ""))
    return views.table(spark, sf_dir, "documents").select("doc_id", ((F.char_length("text") >= 60) | (cjk >= 20)).alias("expanded"))


@query("SELECT word, translate(word, 'àâäéèêëîïôöùûüç', 'aaaeeeeiioouuuc') AS plain FROM words")
def str8_character_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters mapped one to one, as from one script variant to another."""
    return views.words(spark, sf_dir).select("word", F.translate("word", "àâäéèêëîïôöùûüç", "aaaeeeeiioouuuc").alias("plain"))


@query("SELECT n, CASE WHEN n <= 0 THEN -1 ELSE n * 1024 END AS bytes FROM (SELECT unnest(range(-5, 100)) AS n)")
def mth11_config_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kilobytes of a configuration; zero and less mean no limit."""
    n = F.col("id")
    return spark.range(-5, 100).select(n.alias("n"), F.when(n <= 0, -1).otherwise(n * 1024).alias("bytes"))


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN label % 5 ELSE 1 END AS encoder FROM embeddings")
def mth12_main_encoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text's encoder if there is a text vector, else the image's."""
    e = views.table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 3 == 0, F.col("label") % 5).alias("text_encoder"), F.lit(1).alias("image_encoder"))
    return e.select("vec_id", F.coalesce("text_encoder", "image_encoder").alias("encoder"))


@query("SELECT event_id, greatest(value, value * 2 - 10, 5.0) + 1.5 AS wall FROM events")
def agg16_parallel_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest of the parallel parts and the serial part."""
    return views.table(spark, sf_dir, "events").select("event_id", (F.greatest("value", F.col("value") * 2 - 10, F.lit(5.0)) + 1.5).alias("wall"))


@query("SELECT doc_id, regexp_matches(source, '^(tmp|src1[0-9])') AS temporary, source || '.tmp' AS name FROM documents")
def dup6_temporary_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select("doc_id", F.col("source").rlike("^(tmp|src1[0-9])").alias("temporary"), F.concat("source", F.lit(".tmp")).alias("name"))


@query("SELECT fp, vec_id FROM (SELECT 'v' || vec_id AS fp, vec_id, label % 5 AS encoder_id FROM embeddings) WHERE encoder_id IN (0, 4) AND vec_id IN (SELECT vec_id * 3 FROM embeddings)")
def jn21_vector_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored vectors of the asked fingerprints, of allowed encoders only."""
    e = views.table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 5).alias("encoder_id"))
    asked = e.select((F.col("vec_id") * 3).alias("vec_id"))
    return e.where(F.col("encoder_id").isin(0, 4)).join(asked, "vec_id", "left_semi").select(F.concat(F.lit("v"), "vec_id").alias("fp"), "vec_id")


@query()
def clu1_cluster_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of similar documents by average linkage, under size and distance limits."""
    e = views.table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("fp"), "label", "embedding")
    return cluster_vectors(e, group="label")
