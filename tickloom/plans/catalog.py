"""Registry of the named queries and of the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The view of `events` as ticks, and the judged ticks, as SQL.
TICKS = """
ticks_raw AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, epoch_us(ts) / 1e6 AS sec FROM events),
ticks AS (SELECT 'e' || event_id AS event_id, 'I' || user_id % 10 AS instrument_id,
  CASE WHEN event_type IN ('click', 'purchase') THEN 'TRADE' WHEN event_type IN ('view', 'signup') THEN 'QUOTE' ELSE 'STATUS' END AS event_type,
  sec AS exchange_timestamp, sec + (k % 8) * 0.01::DOUBLE AS receive_timestamp, sec + (k % 8) * 0.01::DOUBLE + (k + 1) * 1e-6 AS processing_timestamp,
  'S' || user_id % 3 AS source, event_id AS sequence_number,
  CASE WHEN event_type IN ('click', 'purchase') THEN value END AS price,
  CASE WHEN event_type IN ('click', 'purchase') THEN (k + 1)::DOUBLE END AS quantity,
  CASE WHEN event_type IN ('view', 'signup') THEN value - (k % 7 - 1) * 0.01::DOUBLE END AS bid_price,
  CASE WHEN event_type IN ('view', 'signup') THEN (k + 1)::DOUBLE END AS bid_size,
  CASE WHEN event_type IN ('view', 'signup') THEN value END AS ask_price,
  CASE WHEN event_type IN ('view', 'signup') THEN (k % 13 + 1)::DOUBLE END AS ask_size,
  user_id FROM ticks_raw)"""

JUDGED = TICKS + """,
judged AS (SELECT *, CASE WHEN schema_bad OR crossed THEN 'INVALID' WHEN implausible OR stale THEN 'SUSPICIOUS' ELSE 'VALID' END AS quality_status,
  list_filter([CASE WHEN schema_bad THEN 'SCHEMA_VIOLATION' END, CASE WHEN implausible THEN 'TS_IMPLAUSIBLE' END, CASE WHEN stale THEN 'STALE' END, CASE WHEN crossed THEN 'CROSSED_QUOTE' END], lambda x: x IS NOT NULL) AS reasons
  FROM (SELECT *, coalesce(price < 0 OR bid_price < 0 OR ask_price < 0, false) AS schema_bad, exchange_timestamp > receive_timestamp + 1 AS implausible,
    event_type <> 'STATUS' AND receive_timestamp - exchange_timestamp > 0.05::DOUBLE AS stale,
    coalesce(bid_price > ask_price AND NOT (bid_price < 0 OR ask_price < 0), false) AS crossed FROM ticks))"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that gives the same rows where SQL can say it."""

    def keep(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are called {name}")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep
