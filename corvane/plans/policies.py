"""Arbitration by the dimension policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.policies import MULTI, OPPOSED_MOODS, OPPOSED_PICTURES, SINGLE, Policies, arbitrate, opposition_registry, survivors, tag_dimension
from ..sources import views
from .base import query

POLICIES = Policies(thresholds={"builtin.subject_type": 0.75, "builtin.time_season": 0.5})
OPPOSED = [("omw.00918939.s", "omw.02423762.v")]
_in = lambda codes: ", ".join(f"'{c}'" for c in codes)
KNOWN, MANY = _in([*SINGLE, *MULTI]), _in(MULTI)
CTE = f"""
    WITH d AS (
        SELECT *, coalesce(CASE WHEN via IN ({KNOWN}) THEN via END,
                           list_filter(parents, lambda x: x IN ({KNOWN}))[1],
                           list_filter(list_reverse(list_transform(string_split(path, '/'), lambda x: trim(x))), lambda x: x IN ({KNOWN}) AND x <> code)[1],
                           CASE WHEN code IN ({KNOWN}) THEN code END) AS dim
        FROM chain_tags
    ), s AS (
        SELECT * FROM d WHERE NOT isnan(confidence) AND confidence >= CASE dim WHEN 'builtin.subject_type' THEN 0.75 WHEN 'builtin.time_season' THEN 0.5 ELSE 0.6 END
    )
"""


@query(CTE + "SELECT file, ordinal, code, dim FROM d")
def arb1_tag_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.chain_tags(spark, sf_dir).select("file", "ordinal", "code", tag_dimension(POLICIES).alias("dim"))


@query(CTE + "SELECT file, ordinal, code, dim, confidence FROM s")
def arb2_dimension_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each dimension's own threshold; tags without a dimension need the usual one."""
    return survivors(views.chain_tags(spark, sf_dir), POLICIES).select("file", "ordinal", "code", "dim", "confidence")


@query(
    CTE
    + f"""
    , w AS (SELECT *, row_number() OVER (PARTITION BY file, dim ORDER BY confidence DESC, ordinal) AS k FROM s),
    b AS (SELECT file, code, max(confidence) AS c, arg_min(ordinal, (-confidence, ordinal)) AS o FROM s WHERE code IN ('{OPPOSED[0][0]}', '{OPPOSED[0][1]}') GROUP BY 1, 2),
    lost AS (SELECT x.file, CASE WHEN x.c > y.c OR (x.c = y.c AND x.o < y.o) THEN y.code ELSE x.code END AS code FROM b x JOIN b y ON x.file = y.file AND x.code < y.code),
    kept AS (SELECT * FROM w WHERE (dim IS NULL OR dim IN ({MANY}) OR k = 1) AND NOT EXISTS (SELECT 1 FROM lost l WHERE l.file = w.file AND l.code = w.code))
    SELECT file, ordinal, code, dim, confidence FROM (SELECT *, row_number() OVER (PARTITION BY file, code ORDER BY ordinal) AS n FROM kept) WHERE n = 1
"""
)
def arb3_policy_arbitration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arbitrate(views.chain_tags(spark, sf_dir), POLICIES, OPPOSED).select("file", "ordinal", "code", "dim", "confidence")


@query(f"SELECT code, trim(code) IN ({MANY}) AS multi, count(*) AS tags FROM (SELECT CASE WHEN ordinal % 2 = 0 THEN ' ' || via || ' ' ELSE coalesce(via, code) END AS code FROM chain_tags) WHERE code IS NOT NULL GROUP BY 1, 2")
def arb12_multi_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a code, blanks around it aside, is a dimension that takes several tags; unknown codes are not."""
    code = F.when(F.col("ordinal") % 2 == 0, F.concat(F.lit(" "), "via", F.lit(" "))).otherwise(F.coalesce("via", "code"))
    rows = views.chain_tags(spark, sf_dir).select(code.alias("code")).where("code IS NOT NULL").groupBy("code").agg(F.count(F.lit(1)).alias("tags"))
    return rows.select("code", POLICIES.is_multi(F.col("code")).alias("multi"), "tags")


@query(
    f"""
    WITH p AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in [*OPPOSED_MOODS, *OPPOSED_PICTURES])}) t(a, b)
               UNION ALL SELECT c_mktsegment, 'not ' || lower(c_mktsegment) FROM customer UNION ALL SELECT 'not ' || lower(c_mktsegment), c_mktsegment FROM customer
               UNION ALL SELECT n_name, n_name FROM nation)
    SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM p WHERE a <> b
"""
)
def arb5_opposition_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curated pairs and those of a lexicon, each once and in one order."""
    seg = views.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("a"), F.concat(F.lit("not "), F.lower("c_mktsegment")).alias("b"))
    self_pairs = views.table(spark, sf_dir, "nation").select(F.col("n_name").alias("a"), F.col("n_name").alias("b"))
    curated = spark.createDataFrame([*OPPOSED_MOODS, *OPPOSED_PICTURES], "a string, b string")
    return opposition_registry(curated.unionByName(seg).unionByName(seg.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(self_pairs))
