"""Seeded feeds with faults, for tests: duplicates, gaps, disorder, anomalies, crossed quotes; made by column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def simulate(spark: SparkSession, n: int, seed: int = 42, sources: tuple[str, ...] = ("FEEDX", "FEEDY", "FEEDZ"), instruments: tuple[str, ...] = ("AAPL", "MSFT", "BTC/USD"), start: float = 1_700_000_000.0) -> DataFrame:
    """n ticks with the fault of each in `fault` (null if none). The same seed gives the same ticks for any partitioning."""
    draw = lambda k: (F.pmod(F.xxhash64(F.lit(seed), "id", F.lit(k)), F.lit(1_000_000)) / F.lit(1e6))
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), F.floor(draw(k) * len(names)).cast("int") + 1)
    rows = spark.range(n).select("id", pick(sources, 1).alias("source"), pick(instruments, 2).alias("instrument_id"), (draw(3) < 0.5).alias("quote"), draw(4).alias("r"), draw(5).alias("u"), draw(6).alias("w"))
    fault = F.when(F.col("r") < 0.002, "duplicate").when(F.col("r") < 0.003, "missing").when(F.col("r") < 0.0035, "out_of_order").when(F.col("r") < 0.004, "malformed").when(F.col("r") < 0.0045, "price_anomaly").when((F.col("r") < 0.0048) & F.col("quote"), "crossed")
    rows = rows.withColumn("fault", fault).where("fault is null or fault <> 'missing'")
    at = F.lit(start) + F.col("id") * 0.001
    base = 100 + 10 * F.sin(F.col("id") / 5000) + F.col("u")
    price = F.when(F.col("fault") == "price_anomaly", base * F.when(F.col("w") < 0.5, 0.7).otherwise(1.3)).otherwise(base)
    rows = rows.select(
        F.concat(F.lit("t"), "id").alias("event_id"), F.when(F.col("fault") == "malformed", F.lit("BAD")).when(F.col("quote"), "QUOTE").otherwise("TRADE").alias("event_type"), "instrument_id", "source",
        (at - F.when(F.col("fault") == "out_of_order", 1.0).otherwise(0.0)).alias("exchange_timestamp"), (at + 0.0008 + F.col("w") * 0.0006).alias("receive_timestamp"), (at + 0.002).alias("processing_timestamp"), F.col("id").alias("sequence_number"),
        F.when(~F.col("quote"), price).alias("price"), F.when(~F.col("quote"), 1 + F.floor(F.col("w") * 100)).cast("double").alias("quantity"),
        F.when(F.col("quote"), base + F.when(F.col("fault") == "crossed", 0.05).otherwise(-0.01)).alias("bid_price"), F.when(F.col("quote"), F.lit(100.0)).alias("bid_size"), F.when(F.col("quote"), base + 0.01).alias("ask_price"), F.when(F.col("quote"), F.lit(100.0)).alias("ask_size"), "fault",
    )
    again = rows.where("fault = 'duplicate'").withColumns({"event_id": F.concat("event_id", F.lit("d")), "receive_timestamp": F.col("receive_timestamp") + 0.0001})
    return rows.withColumn("fault", F.when(F.col("fault") != "duplicate", F.col("fault"))).unionByName(again)
