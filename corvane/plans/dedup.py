"""Duplicate scans and file checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import sign_hash
from ..operators.hashes import fnv1a, sampled_fingerprint
from ..operators.similar import near_classes
from ..sources import views
from .base import query


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("hash"))


GROUPS = """
    WITH d AS (SELECT doc_id, strlen(text) AS size, sha256(text) AS hash FROM documents),
    g AS (SELECT size, hash, count(*) AS n, min(doc_id) AS first FROM d GROUP BY 1, 2 HAVING count(*) > 1)
"""


@query(GROUPS + "SELECT hash, size, n, first, size * (n - 1) AS freed FROM g")
def agg11_exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of equal size and hash, and the bytes that one copy each would free."""
    groups = sized(spark, sf_dir).groupBy("size", "hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1")
    return groups.withColumn("freed", F.col("size") * (F.col("n") - 1))


@query(GROUPS + "SELECT (SELECT count(*) FROM d) AS scanned, sum(n - 1)::BIGINT AS redundant, sum(size * (n - 1))::BIGINT AS freed FROM g")
def agg13_scan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = sized(spark, sf_dir).groupBy("size", "hash").agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.sum("n").alias("scanned"), F.sum(F.col("n") - 1).alias("redundant"), F.sum(F.col("size") * (F.col("n") - 1)).alias("freed"))


@query("SELECT source, count(*) AS n, CAST(floor(sum(strlen(text)) / count(*)) AS BIGINT) * (count(*) - 1) AS freed FROM documents GROUP BY 1 HAVING count(*) > 1")
def agg12_group_freed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of unequal files free their mean size for all but one."""
    groups = sized(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total")).where("n > 1")
    return groups.select("source", "n", (F.floor(F.col("total") / F.col("n")) * (F.col("n") - 1)).alias("freed"))


@query("SELECT doc_id, size FROM (SELECT doc_id, strlen(text) AS size FROM documents ORDER BY size DESC, doc_id LIMIT 50) WHERE size >= 12000")
def lim3_big_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty largest, of which those beyond the limit: limited first, then filtered."""
    return sized(spark, sf_dir).orderBy(F.desc("size"), "doc_id").limit(50).where("size >= 12000").select("doc_id", "size")


@query("SELECT doc_id, coalesce(strlen(text), 0) = 0 AS corrupted FROM documents")
def hsh3_corrupted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) == 0).alias("corrupted"))


@query("""
    WITH s AS (SELECT unnest(range(0, 101)) AS s), f AS (SELECT s, (10 - least(10.0, greatest(0.0, CASE WHEN s > 10 THEN s / 10.0 ELSE s END))) / 10 AS f FROM s)
    SELECT s, round(f, 6) AS factor, CAST(round(f * 70) AS BIGINT) AS image_diff, round(f * 9 + 1, 6) AS audio_diff, CAST(round(f * 20) AS BIGINT) AS video_tolerance, round(0.8 - 0.6 * f, 6) AS min_match, round(0.7 - 0.5 * f, 6) AS subclip FROM f
""")
def mth1_similarity_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s")
    level = F.least(F.lit(10.0), F.greatest(F.lit(0.0), F.when(s > 10, s / 10.0).otherwise(s.cast("double"))))
    f = (10 - level) / 10
    whole = lambda x: F.round(x).cast("long")
    return spark.range(101).select(F.col("id").alias("s")).select("s", F.round(f, 6).alias("factor"), whole(f * 70).alias("image_diff"), F.round(f * 9 + 1, 6).alias("audio_diff"), whole(f * 20).alias("video_tolerance"), F.round(0.8 - 0.6 * f, 6).alias("min_match"), F.round(0.7 - 0.5 * f, 6).alias("subclip"))


HASHES = """
    h AS (SELECT vec_id AS id, list_sum(list_transform(embedding, lambda x, i: CASE WHEN x > 0 AND i % 8 <> 0 AND i <= 24 THEN CAST(1 AS BIGINT) << (i - 1) ELSE 0 END))::BIGINT AS bits FROM embeddings)
"""


@query(f"""
    WITH RECURSIVE {HASHES}, e AS (SELECT a.id AS a, b.id AS b FROM h a JOIN h b ON bit_count(xor(a.bits, b.bits)) <= 1),
    r AS (SELECT id, id AS root FROM h UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id)
    SELECT id, min(root) AS class_id FROM r GROUP BY 1
""")
def jn20_similar_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of files whose content hashes differ in one bit or none, from a hash column (here: signs of a vector)."""
    part = F.transform("embedding", lambda x, i: F.when((x > 0) & ((i + 1) % 8 != 0) & (i < 24), F.lit(1.0)).otherwise(F.lit(0.0)))
    rows = views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), sign_hash(part).alias("bits"))
    return near_classes(rows, 1)


@query("""
    SELECT page_id, ext, CASE ext WHEN 'html' THEN 'text/html' WHEN 'png' THEN 'image/png' ELSE 'application/octet-stream' END AS declared, starts_with(lower(trim(html)), '<!doctype html') AND ext NOT IN ('', 'html') AS bad_extension
    FROM (SELECT page_id, html, lower(regexp_extract(url, '/[^/?#]*\\.([a-z0-9]+)([?#].*)?$', 1)) AS ext FROM pages)
""")
def dup5_bad_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared type against the content's own signature."""
    p = views.table(spark, sf_dir, "pages").select("page_id", "html", F.lower(F.regexp_extract("url", "/[^/?#]*\\.([a-z0-9]+)([?#].*)?$", 1)).alias("ext"))
    is_html = F.lower(F.trim("html")).startswith("<!doctype html")
    return p.select("page_id", "ext", F.when(F.col("ext") == "html", "text/html").when(F.col("ext") == "png", "image/png").otherwise("application/octet-stream").alias("declared"), (is_html & ~F.col("ext").isin("", "html")).alias("bad_extension"))


@query()
def hsh1_sampled_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polynomial hash of the length and of the head and tail of the content."""
    docs = views.table(spark, sf_dir, "documents")
    return docs.select("doc_id", sampled_fingerprint(F.encode("text", "UTF-8")).alias("fingerprint"))


@query()
def hsh2_fnv1a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "part").select("p_partkey", fnv1a(F.encode("p_name", "UTF-8")).alias("hash"))


# Names of scan strategies and what they ask for (fixed values).
STRATEGIES = {
    "exact_hash": "exact", "exact": "exact", "duplicates": "exact", "image_phash": "image", "image": "image", "similar_images": "image", "audio_hash": "audio", "audio": "audio", "same_music": "audio",
    "video_phash": "video", "video": "video", "similar_videos": "video", "bad_extensions": "bad_extensions", "empty_folders": "empty_folders", "empty_folder": "empty_folders", "big_files": "big_files", "big_file": "big_files",
    "empty_files": "empty_files", "empty_file": "empty_files", "temporary_files": "temporary", "temporary": "temporary", "invalid_symlinks": "symlinks", "invalid_symlink": "symlinks",
    "broken_files": "broken", "broken_file": "broken", "bad_names": "bad_names", "bad_name": "bad_names", "exif_remover": "exif", "video_optimizer": "video_optimizer",
}
DEFAULT_STRATEGIES = ["exact_hash", "image_phash"]
_cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STRATEGIES.items())


@query(f"""
    WITH r AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN [] WHEN 1 THEN ['same_music', 'audio', 'nothing'] WHEN 2 THEN [lower(o_orderstatus) || 'x', 'big_file'] ELSE ['duplicates', 'video'] END AS asked FROM orders),
    x AS (SELECT o_orderkey, unnest(CASE WHEN len(asked) = 0 THEN ['exact_hash', 'image_phash'] ELSE asked END) AS name FROM r),
    k AS (SELECT o_orderkey, CASE name {_cases} END AS scan FROM x)
    SELECT o_orderkey, coalesce(string_agg(DISTINCT scan, ' ' ORDER BY scan), '') AS scans FROM k GROUP BY 1
""")
def dup8_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scans that a request's strategy names ask for; none means exact copies and images, unknown names nothing."""
    key = F.col("o_orderkey") % 4
    lists = lambda *names: F.array(*[n if not isinstance(n, str) else F.lit(n) for n in names])
    asked = F.when(key == 0, F.array().cast("array<string>")).when(key == 1, lists("same_music", "audio", "nothing")).when(key == 2, lists(F.concat(F.lower("o_orderstatus"), F.lit("x")), "big_file")).otherwise(lists("duplicates", "video"))
    named = F.create_map(*[F.lit(x) for kv in STRATEGIES.items() for x in kv])
    names = F.when(F.size(asked) == 0, lists(*DEFAULT_STRATEGIES)).otherwise(asked)
    scans = F.array_sort(F.array_distinct(F.array_compact(F.transform(names, lambda x: F.try_element_at(named, x)))))
    return views.table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(scans, " ").alias("scans"))


@query("""
    WITH p AS (SELECT page_id, lower(regexp_extract(url, '/[^/?#]*\\.([a-z0-9]+)([?#].*)?$', 1)) AS ext, strlen(html) AS size, NOT contains(lower(html), '</html>') AS failed, starts_with(lower(trim(html)), '<!doctype html') AS is_html FROM pages)
    SELECT page_id, size FROM p WHERE failed AND size > 0 AND NOT (is_html AND ext NOT IN ('', 'html'))
""")
def dup7_broken_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that their reader finds broken (here: markup without an end), but for empty ones and those whose extension is wrong."""
    bad = dup5_bad_extension(spark, sf_dir).where("bad_extension").select("page_id")
    pages = views.table(spark, sf_dir, "pages").select("page_id", F.octet_length("html").cast("long").alias("size"), (~F.lower("html").contains("</html>")).alias("failed"))
    return pages.where(F.col("failed") & (F.col("size") > 0)).join(bad, "page_id", "left_anti").select("page_id", "size")
