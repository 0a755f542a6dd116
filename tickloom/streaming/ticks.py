"""Streams of ticks: bars, deduplication, verdicts, and writing them; the same operators as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickloom.operators.quality_state import judge_stream  # noqa: F401  (part of this module's surface)
from tickloom.schema import TICK


def read_ticks(spark: SparkSession, path: str, files_per_trigger: int = 16, fmt: str = "parquet") -> DataFrame:
    """A stream over the tick files of a folder."""
    return spark.readStream.schema(TICK).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def timed(ticks: DataFrame) -> DataFrame:
    return ticks.withColumn("event_time", F.timestamp_micros((F.col("exchange_timestamp") * 1e6).cast("long")))


def bars(ticks: DataFrame, interval: str = "5 seconds", lateness: str = "25 seconds") -> DataFrame:
    """Bars of windows; rows later than `lateness` are dropped, earlier ones revise their bar."""
    rows = timed(ticks).where("price is not null").withWatermark("event_time", lateness)
    order = F.struct("exchange_timestamp", "event_id")
    return rows.groupBy("instrument_id", F.window("event_time", interval)).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.sum(F.coalesce("quantity", F.lit(0.0))).alias("volume"), F.count(F.lit(1)).alias("trade_count"),
    ).select("instrument_id", F.unix_timestamp("window.start").cast("double").alias("bucket"), "open", "high", "low", "close", "volume", "trade_count")


def deduplicated(ticks: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """The first of rows with the same source, instrument and sequence number within the watermark."""
    return timed(ticks).withWatermark("event_time", lateness).dropDuplicatesWithinWatermark(["source", "instrument_id", "sequence_number"]).drop("event_time")


def sessions(ticks: DataFrame, gap: str = "5 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Times of activity per source and instrument that no gap interrupts."""
    rows = timed(ticks).withWatermark("event_time", lateness)
    return rows.groupBy("source", "instrument_id", F.session_window("event_time", gap).alias("s")).agg(F.count(F.lit(1)).alias("n")).select("source", "instrument_id", "s.start", "s.end", "n")


def write_split(judged: DataFrame, canonical: str, quarantine: str, checkpoint: str) -> StreamingQuery:
    """Judged rows into two Parquet folders by batch: what isn't INVALID, and what isn't VALID.

    A batch overwrites its own part of each folder, so that one which is run again leaves no double rows.
    """

    def put(rows: DataFrame, batch: int) -> None:
        held = rows.persist()
        held.where("quality_status <> 'INVALID'").write.mode("overwrite").parquet(f"{canonical}/batch={batch}")
        held.where("quality_status <> 'VALID'").write.mode("overwrite").parquet(f"{quarantine}/batch={batch}")
        held.unpersist()

    return judged.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
