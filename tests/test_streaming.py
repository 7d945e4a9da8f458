"""Streams against the same work on tables."""

from pyspark.sql import functions as F

from corvane.plans.state import stm1_anchor_cache
from corvane.streaming.cache import replay
from corvane.streaming.windows import stream_table

SF = "/root/testdata/sf0.001"


def test_cache_replay_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").where(F.col("event_type").isin("signup", "purchase"))
    ops = events.select(
        F.col("user_id").alias("key"), F.col("event_id").alias("op_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        F.when(F.col("event_type") == "signup", "put").otherwise("take").alias("kind"), (F.floor("value") % 3).alias("encoder"),
    )
    ops.coalesce(1).sortWithinPartitions("at", "op_id").write.parquet(str(tmp_path / "in"))
    query = replay(stream_table(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("takes").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.op_id, r.outcome) for r in spark.sql("SELECT * FROM takes").collect()}
    assert got == {(r.event_id, r.outcome) for r in stm1_anchor_cache(spark, SF).collect()}
