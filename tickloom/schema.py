"""The canonical tick: one fact row for trades, quotes and status events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TICK = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("instrument_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("exchange_timestamp", T.DoubleType()),
    T.StructField("receive_timestamp", T.DoubleType()),
    T.StructField("processing_timestamp", T.DoubleType()),
    T.StructField("source", T.StringType()),
    T.StructField("sequence_number", T.LongType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("quantity", T.DoubleType()),
    T.StructField("bid_price", T.DoubleType()),
    T.StructField("bid_size", T.DoubleType()),
    T.StructField("ask_price", T.DoubleType()),
    T.StructField("ask_size", T.DoubleType()),
    T.StructField("quality_status", T.StringType()),
    T.StructField("reasons", T.ArrayType(T.StringType())),
    T.StructField("raw_id", T.StringType()),
])

SEVERITY = ("VALID", "SUSPICIOUS", "INVALID")
#: Codes of bar intervals, in seconds.
INTERVALS = {"1s": 1.0, "5s": 5.0, "1m": 60.0, "5m": 300.0, "15m": 900.0, "1h": 3600.0, "1d": 86400.0}
#: Scale of fixed-point prices.
PRICE_SCALE = 100_000_000


def bucket(ts: Column | str, interval: float) -> Column:
    """Start of the interval that holds ts, in the same unit."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(col / F.lit(float(interval))).cast("double") * F.lit(float(interval))


def order_key(ts: str) -> Column:
    """What rows of an instrument are ordered by in time: `ts`, then the sequence number, then the id. The smallest or greatest row by it is one row only."""
    return F.struct(F.col(ts), F.coalesce("sequence_number", F.lit(-1)).alias("sequence"), F.col("event_id"))


def event_order() -> list[Column]:
    """The total order in which events are replayed."""
    return [F.col("exchange_timestamp"), F.coalesce("sequence_number", F.lit(-1)), F.col("source"), F.col("event_id")]


def symbol_filter(symbol: str | None) -> Column:
    """Rows of a symbol, with - taken for /; ALL, * and none are no filter."""
    if symbol is None or symbol.upper() in ("ALL", "*"):
        return F.lit(True)
    return F.col("instrument_id").isin(symbol.upper(), symbol.upper().replace("-", "/"))
