"""audit_chain_verified chains every tick, also those with large numbers."""

from tickloom import plans


def test_all_ticks_are_chained(spark, small, tmp_path):
    from pyspark.sql import functions as F

    events = spark.read.parquet(f"{small}/events.parquet")
    events.withColumn("event_id", F.col("event_id") + 5000).write.parquet(f"{tmp_path}/events.parquet")
    found = plans.QUERIES["audit_chain_verified"](spark, str(tmp_path)).collect()
    assert [(r["fault"], r["n"]) for r in found] == [(None, events.count())]
