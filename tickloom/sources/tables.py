"""Parquet tables, and the canonical ticks that `events` stands for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


_SCHEMAS: dict[tuple[str, str], StructType] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table. Its schema is read from the files once an application, which spares a job for each later use."""
    path = f"{folder}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


#: Raw event types behind each kind of tick.
KINDS = {"TRADE": ("click", "purchase"), "QUOTE": ("view", "signup"), "STATUS": ("error",)}


def ticks(spark: SparkSession, folder: str, kind: str | None = None) -> DataFrame:
    """`events` as ticks: clicks and purchases trade, views and signups quote, errors are status events.

    With a kind, only those: the filter is on the stored column, so that it reaches the Parquet scan.
    """
    events = table(spark, folder, "events")
    events = events.where(F.col("event_type").isin(*KINDS[kind])) if kind else events
    # in a projection of their own, so that they aren't copied into each column; and as text, since one call
    # parses what would take some hundred calls to build
    return events.selectExpr("*", *NUMBERS).selectExpr(*COLUMNS)


NUMBERS = ("try_cast(get_json_object(props, '$.k') AS INT) AS k", "unix_micros(CAST(ts AS TIMESTAMP)) / 1e6D AS sec")
_TRADE, _QUOTE = "event_type IN ('click', 'purchase')", "event_type IN ('view', 'signup')"
COLUMNS = (
    "concat('e', event_id) AS event_id",
    "concat('I', user_id % 10) AS instrument_id",
    f"CASE WHEN {_TRADE} THEN 'TRADE' WHEN {_QUOTE} THEN 'QUOTE' ELSE 'STATUS' END AS event_type",
    "sec AS exchange_timestamp",
    "sec + (k % 8) * 0.01D AS receive_timestamp",
    "sec + (k % 8) * 0.01D + (k + 1) * 1e-6D AS processing_timestamp",
    "concat('S', user_id % 3) AS source",
    "event_id AS sequence_number",
    f"CASE WHEN {_TRADE} THEN value END AS price",
    f"CASE WHEN {_TRADE} THEN CAST(k + 1 AS DOUBLE) END AS quantity",
    f"CASE WHEN {_QUOTE} THEN value - (k % 7 - 1) * 0.01D END AS bid_price",
    f"CASE WHEN {_QUOTE} THEN CAST(k + 1 AS DOUBLE) END AS bid_size",
    f"CASE WHEN {_QUOTE} THEN value END AS ask_price",
    f"CASE WHEN {_QUOTE} THEN CAST(k % 13 + 1 AS DOUBLE) END AS ask_size",
    "user_id",
)
