"""Arbitration between competing tags of a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.arbitration import above_threshold, opposition_losers, single_select, winner_by_margin
from ..sources import views
from .base import query

KEPT = """
    WITH s AS (SELECT * FROM scored_tags WHERE confidence >= 0.60),
    f AS (SELECT *, row_number() OVER (PARTITION BY file, dim ORDER BY confidence DESC, ordinal) AS k FROM s),
    chosen AS (SELECT * FROM f WHERE dim <> 'O' OR k = 1),
    once AS (SELECT *, row_number() OVER (PARTITION BY file, code ORDER BY ordinal) AS c FROM chosen)
    SELECT file, ordinal, code, dim, confidence FROM once WHERE c = 1
"""


@query(KEPT)
def arb3_dimension_arbitration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold, one tag of the single-select dimension, the first of equal codes."""
    kept = single_select(above_threshold(views.scored_tags(spark, sf_dir)), ["O"])
    return kept.groupBy("file", "code").agg(F.min(F.struct("ordinal", "dim", "confidence")).alias("t")).select("file", "t.ordinal", "code", "t.dim", "t.confidence")


@query("SELECT file, ordinal, code, confidence FROM scored_tags WHERE confidence >= 0.60")
def arb2_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return above_threshold(views.scored_tags(spark, sf_dir)).select("file", "ordinal", "code", "confidence")


@query("""
    WITH s AS (SELECT * FROM scored_tags WHERE confidence >= 0.60),
    b AS (SELECT file, code, arg_min((confidence, ordinal), (-confidence, ordinal)) AS best FROM s GROUP BY 1, 2),
    pairs AS (SELECT 'builtin.A' AS x, 'builtin.R' AS y UNION ALL SELECT 'builtin.N', 'builtin.R'),
    lost AS (SELECT l.file, CASE WHEN l.best[1] > r.best[1] OR (l.best[1] = r.best[1] AND l.best[2] < r.best[2]) THEN r.code ELSE l.code END AS code
             FROM pairs p JOIN b l ON l.code = p.x JOIN b r ON r.code = p.y AND r.file = l.file)
    SELECT s.file, s.ordinal, s.code FROM s WHERE NOT EXISTS (SELECT 1 FROM lost WHERE lost.file = s.file AND lost.code = s.code)
""")
def arb4_opposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two opposed concepts in a file the less confident one goes, with all its rows."""
    tags = above_threshold(views.scored_tags(spark, sf_dir))
    losers = opposition_losers(tags, [("builtin.A", "builtin.R"), ("builtin.N", "builtin.R")])
    return tags.join(losers, ["file", "code"], "left_anti").select("file", "ordinal", "code")


@query("""
    WITH s AS (SELECT file, dim, code, max(confidence) AS c FROM scored_tags GROUP BY 1, 2, 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY file, dim ORDER BY c DESC, code) AS k, lead(c) OVER (PARTITION BY file, dim ORDER BY c DESC, code) AS second FROM s)
    SELECT file, dim, code FROM r WHERE k = 1 AND c >= 0.7 AND (second IS NULL OR round(c - second, 6) >= 0.05)
""")
def rnk5_mutual_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of a group if it is good enough and far enough ahead."""
    best = views.scored_tags(spark, sf_dir).groupBy("file", "dim", "code").agg(F.max("confidence").alias("c"))
    return winner_by_margin(best, ["file", "dim"], 0.7, 0.05).select("file", "dim", "code")


@query("""
    WITH e AS (SELECT user_id, event_id, value, CASE event_type WHEN 'purchase' THEN 6 WHEN 'signup' THEN 5 WHEN 'click' THEN 4 WHEN 'view' THEN 3 ELSE 2 END AS p FROM events)
    SELECT user_id, arg_min(event_id, (-p, event_id)) AS event_id, max(p) AS priority FROM e GROUP BY 1
""")
def agg17_engine_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source of highest priority, the first of equals."""
    ranks = {"purchase": 6, "signup": 5, "click": 4, "view": 3}
    p = F.lit(2)
    for kind, rank in ranks.items():
        p = F.when(F.col("event_type") == kind, rank).otherwise(p)
    rows = views.table(spark, sf_dir, "events").select("user_id", "event_id", p.alias("p"))
    return rows.groupBy("user_id").agg(F.min_by("event_id", F.struct((-F.col("p")).alias("p"), "event_id")).alias("event_id"), F.max("p").alias("priority"))


@query("""
    WITH r AS (SELECT file, code, dim, min(ordinal) AS ordinal, max(confidence) AS c FROM scored_tags WHERE confidence >= 0.8 GROUP BY 1, 2, 3),
    g AS (SELECT *, row_number() OVER (PARTITION BY file, dim ORDER BY c DESC, ordinal) AS in_group FROM r),
    t AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY c DESC, ordinal) AS k FROM g WHERE in_group = 1)
    SELECT file, code, dim FROM t WHERE k <= 5
""")
def rnk6_confident_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most five confident tags, one of each exclusive group."""
    rows = views.scored_tags(spark, sf_dir).where("confidence >= 0.8").groupBy("file", "code", "dim").agg(F.min("ordinal").alias("ordinal"), F.max("confidence").alias("c"))
    order = F.struct((-F.col("c")).alias("c"), "ordinal", "code", "dim")
    one = rows.groupBy("file", "dim").agg(F.min(order).alias("t"))
    picked = one.groupBy("file").agg(F.slice(F.array_sort(F.collect_list("t")), 1, 5).alias("ts"))
    return picked.select("file", F.explode("ts").alias("t")).select("file", "t.code", "t.dim")


@query("""
    WITH l AS (SELECT file, coalesce(list(code ORDER BY ordinal) FILTER (dim = 'F'), []) AS f, coalesce(list(code ORDER BY ordinal) FILTER (dim = 'O'), []) AS o FROM scored_tags GROUP BY 1),
    m AS (SELECT file, list_concat(f, o) AS m FROM l)
    SELECT file, array_to_string(list_filter(m, lambda x, i: list_position(m, x) = i), ' ') AS codes FROM m
""")
def set1_concat_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of several sources one after the other, each once, in order."""
    lists = views.scored_tags(spark, sf_dir).groupBy("file").agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("dim") == d, F.struct("ordinal", "code")))), lambda x: x["code"]).alias(d) for d in ("F", "O")])
    return lists.select("file", F.array_join(F.array_distinct(F.concat("F", "O")), " ").alias("codes"))


@query("""
    WITH p AS (SELECT DISTINCT p_brand AS x, 'Brand#' || (25 - CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER)) AS y FROM part),
    m AS (SELECT x, y FROM p WHERE x <> y UNION SELECT y, x FROM p WHERE x <> y),
    k AS (SELECT x, min(y) AS opposite FROM m GROUP BY 1)
    SELECT w.p_brand AS concept, opposite FROM (SELECT DISTINCT p_brand FROM part) w LEFT JOIN k ON k.x = w.p_brand
""")
def arb13_counterparts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counterpart of a concept, whichever way its pair is written; none is none."""
    brands = views.table(spark, sf_dir, "part").select(F.col("p_brand").alias("concept")).distinct()
    pairs = brands.select(F.col("concept").alias("x"), F.concat(F.lit("Brand#"), (25 - F.regexp_extract("concept", "([0-9]+)", 1).cast("int")).cast("string")).alias("y")).where("x <> y")
    both = pairs.union(pairs.select("y", "x")).distinct().groupBy(F.col("x").alias("concept")).agg(F.min("y").alias("opposite"))
    return brands.join(both, "concept", "left")
