"""Stateful replay over event streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.state import crash_breaker
from ..sources import views
from .base import query

TTL_SECONDS = 30 * 60


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


@query("""
    WITH o AS (SELECT event_id, user_id, ts, event_type, value FROM events WHERE event_type IN ('signup', 'purchase')),
    p AS (SELECT *, lag(event_type) OVER w AS before, lag(ts) OVER w AS put_at, lag(CAST(floor(value) AS BIGINT) % 3) OVER w AS encoder FROM o WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, user_id, CASE WHEN before IS DISTINCT FROM 'signup' THEN 'missing' WHEN epoch_us(ts) - epoch_us(put_at) > 1800000000 THEN 'expired'
           WHEN encoder <> CAST(floor(value) AS BIGINT) % 3 THEN 'encoder_mismatch' ELSE 'hit' END AS outcome
    FROM p WHERE event_type = 'purchase'
""")
def stm1_anchor_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache whose entries are taken once and live for thirty minutes: a take finds what the
    key's operation just before it put, whatever its age, and removes it."""
    ops = views.table(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "purchase"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    encoder = F.floor("value") % 3
    seen = ops.withColumns({"before": F.lag("event_type").over(w), "put_at": F.lag("ts").over(w), "put_encoder": F.lag(encoder).over(w)}).where("event_type = 'purchase'")
    age = _micros(F.col("ts")) - _micros(F.col("put_at"))
    out = F.when(~F.col("before").eqNullSafe("signup"), "missing").when(age > TTL_SECONDS * 1_000_000, "expired").when(F.col("put_encoder") != encoder, "encoder_mismatch").otherwise("hit")
    return seen.select("event_id", "user_id", out.alias("outcome"))


@query("""
    WITH g AS (SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 300000000 THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
    SELECT user_id, min(ts) AS first_active, max(ts) AS last_active, count(*) AS actions FROM s GROUP BY user_id, session
""")
def stm3_idle_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of activity that a gap of more than 300 seconds ends."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = _micros(F.col("ts")) - _micros(F.lag("ts").over(w))
    rows = views.table(spark, sf_dir, "events").withColumn("fresh", F.when(gap > 300_000_000, 1).otherwise(0)).withColumn("session", F.sum("fresh").over(w))
    return rows.groupBy("user_id", "session").agg(F.min("ts").alias("first_active"), F.max("ts").alias("last_active"), F.count(F.lit(1)).alias("actions")).drop("session")


@query("""
    WITH h AS (SELECT user_id, max(CASE WHEN event_type = 'signup' THEN event_id END) AS heated FROM events GROUP BY 1),
    n AS (SELECT h.user_id, h.heated, count(*) FILTER (e.event_type = 'error' AND (h.heated IS NULL OR e.event_id > h.heated)) AS n FROM h JOIN events e USING (user_id) GROUP BY 1, 2)
    SELECT user_id AS boot, CASE WHEN heated IS NULL THEN n WHEN n > 0 THEN 2 ELSE 0 END AS crashes, CASE WHEN heated IS NULL THEN n WHEN n > 0 THEN 2 ELSE 0 END >= 2 AS is_open FROM n
""")
def stm4_crash_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("boot"), F.col("event_id").alias("at"), F.col("event_type").alias("kind"))
    return crash_breaker(events)


@query("""
    SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2
""")
def stm7_tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts and sums; the same plan runs as a stream in ``corvane.streaming``."""
    from ..streaming.windows import hourly

    return hourly(views.table(spark, sf_dir, "events")).select("hour", "event_type", "n", F.round("total", 2).alias("total"))


@query("""
    SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, json_extract_string(props, '$.missing') AS missing, coalesce(json_extract_string(props, '$.latitude'), json_extract_string(props, '$.k')) AS alternate FROM events
""")
def jsn2_metadata_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda key: F.get_json_object("props", f"$.{key}")
    return views.table(spark, sf_dir, "events").select("event_id", pick("k").try_cast("double").alias("k"), pick("missing").alias("missing"), F.coalesce(pick("latitude"), pick("k")).alias("alternate"))


@query("""
    WITH b AS (SELECT DISTINCT p_brand AS dim, CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER) AS k FROM part)
    SELECT dim, CAST(CASE WHEN k % 3 = 0 THEN 0.75 ELSE 0.6 END AS DOUBLE) AS threshold, FALSE AS multi FROM b
    UNION ALL SELECT 'new ' || dim, CAST(0.5 AS DOUBLE), TRUE FROM b WHERE k % 3 = 1
""")
def jsn3_policy_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults overlaid by configurations in JSON; fields left out keep theirs, what cannot be read changes nothing."""
    brands = views.table(spark, sf_dir, "part").select(F.col("p_brand").alias("dim"), (F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int") % 3).alias("k")).distinct()
    base = brands.select("dim", F.lit(0.6).alias("threshold"), F.lit(False).alias("multi"))
    text = F.when(F.col("k") == 0, F.concat(F.lit('[{"dim": "'), "dim", F.lit('", "threshold": 0.75}]'))).when(F.col("k") == 1, F.concat(F.lit('[{"dim": "new '), "dim", F.lit('", "threshold": 0.5, "multi": true}]'))).otherwise("{broken")
    policies = F.coalesce(F.from_json(text, "array<struct<dim:string,threshold:double,multi:boolean>>"), F.array())
    over = brands.select(F.explode(policies).alias("p")).select("p.*").where("dim IS NOT NULL").toDF("dim", "t", "m")
    return base.join(over, "dim", "full").select("dim", F.coalesce("t", "threshold", F.lit(0.6)).alias("threshold"), F.coalesce("m", "multi", F.lit(True)).alias("multi"))
