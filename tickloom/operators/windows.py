"""Window-shaped indicators per instrument, over bars or ticks in order.

Warm-up values are null. What a frame can't express (smoothing that feeds on itself) is in recurrences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def along(by: str = "instrument_id", *order: str) -> Window:
    return Window.partitionBy(by).orderBy(*(order or ("bucket",)))


def _filled(value: Column, order: Window, n: int) -> Column:
    return F.when(F.row_number().over(order) >= n, value)


def sma(rows: DataFrame, n: int, value: str = "close", out: str = "sma") -> DataFrame:
    order = along()
    return rows.withColumn(out, _filled(F.avg(value).over(order.rowsBetween(-(n - 1), 0)), order, n))


def bollinger(rows: DataFrame, n: int = 20, k: float = 2.0, value: str = "close") -> DataFrame:
    """Mean and mean +- k sample deviations of the last n."""
    order = along()
    frame = order.rowsBetween(-(n - 1), 0)
    mid, dev = F.avg(value).over(frame), F.stddev_samp(value).over(frame)
    return rows.withColumns({"bb_mid": _filled(mid, order, n), "bb_upper": _filled(mid + k * dev, order, n), "bb_lower": _filled(mid - k * dev, order, n)})


def returns(rows: DataFrame, value: str = "close") -> DataFrame:
    """Simple and log returns; 0 after a zero, and 0 for logs of what isn't positive. The first row has none."""
    before = F.lag(value).over(along())
    now = F.col(value)
    simple = F.when(before.isNull(), None).when(before == 0, F.lit(0.0)).otherwise((now - before) / before)
    logs = F.when(before.isNull(), None).when((before <= 0) | (now <= 0), F.lit(0.0)).otherwise(F.ln(now / before))
    return rows.withColumns({"ret": simple, "log_ret": logs})


def realized_volatility(rows: DataFrame, n: int, value: str = "close") -> DataFrame:
    """Sample deviation of the last n log returns."""
    order = along()
    return returns(rows, value).withColumn("realized_vol", F.when(F.row_number().over(order) > n, F.stddev_samp("log_ret").over(order.rowsBetween(-(n - 1), 0)))).drop("ret", "log_ret")


def obv(rows: DataFrame) -> DataFrame:
    """Volume summed with the sign of the close's change; the first row counts its own volume."""
    order = along()
    step = F.coalesce(F.signum(F.col("close") - F.lag("close").over(order)), F.lit(1.0)) * F.col("volume")
    return rows.withColumn("_step", step).withColumn("obv", F.sum("_step").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def drawdown(rows: DataFrame, value: str = "close") -> DataFrame:
    """Running peak and the fall from it in percent."""
    peak = F.max(value).over(along().rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("peak", peak).withColumn("drawdown_pct", F.when(F.col("peak") > 0, (F.col("peak") - F.col(value)) / F.col("peak") * 100.0).otherwise(F.lit(0.0)))


def order_flow_imbalance(quotes: DataFrame) -> DataFrame:
    """Changes of best prices and sizes as signed flow, 0 on the first quote, and their running sum."""
    order = along("instrument_id", "exchange_timestamp", "event_id")
    b, bz, a, az = (F.lag(c).over(order) for c in ("bid_price", "bid_size", "ask_price", "ask_size"))
    bid = F.when(F.col("bid_price") > b, F.col("bid_size")).when(F.col("bid_price") == b, F.col("bid_size") - bz).otherwise(-bz)
    ask = F.when(F.col("ask_price") < a, F.col("ask_size")).when(F.col("ask_price") == a, F.col("ask_size") - az).otherwise(-az)
    return quotes.withColumn("ofi", F.when(b.isNull(), F.lit(0.0)).otherwise(bid - ask)).withColumn("ofi_sum", F.sum("ofi").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def trade_toxicity(trades: DataFrame) -> DataFrame:
    """Share of the volume's imbalance by the tick rule; a trade at the same price as the last counts half for each side."""
    before = F.lag("price").over(along("instrument_id", "exchange_timestamp", "event_id"))
    up = F.when(F.col("price") > before, 1.0).when(F.col("price") < before, 0.0).otherwise(0.5)
    rows = trades.withColumn("_buy", up * F.col("quantity")).withColumn("_sell", F.col("quantity") - F.col("_buy"))
    return rows.groupBy("instrument_id").agg(F.round(F.abs(F.sum("_buy") - F.sum("_sell")) / F.sum("quantity"), 6).alias("toxicity"))


def gaps(ticks: DataFrame) -> DataFrame:
    """Sequence numbers that are missing, per source and instrument: from, to, how many. Numbers seen late fill nothing here."""
    order = Window.partitionBy("source", "instrument_id").orderBy("exchange_timestamp", "event_id")
    high = F.max("sequence_number").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return ticks.withColumn("_high", high).where(F.col("sequence_number") > F.col("_high") + 1).select("event_id", "source", "instrument_id", (F.col("_high") + 1).alias("gap_from"), (F.col("sequence_number") - 1).alias("gap_to"), (F.col("sequence_number") - F.col("_high") - 1).alias("missing"))


def duplicates(ticks: DataFrame) -> DataFrame:
    """Rows whose sequence number its source and instrument had before, by arrival."""
    order = Window.partitionBy("source", "instrument_id", "sequence_number").orderBy("receive_timestamp", "event_id")
    return ticks.withColumn("copy", F.row_number().over(order)).where("copy > 1")


def channel_sequence(ticks: DataFrame) -> DataFrame:
    """The simple sequencer of a channel (source): VALID, SEQUENCE_GAP, DUPLICATE (equal to the last or behind by less than 100), OUT_OF_ORDER."""
    order = Window.partitionBy("source").orderBy("receive_timestamp", "event_id")
    high = F.max("sequence_number").over(order.rowsBetween(Window.unboundedPreceding, -1))
    seq = F.col("sequence_number")
    verdict = F.when(high.isNull() | (seq == high + 1), "VALID").when(seq > high + 1, "SEQUENCE_GAP").when(high - seq < 100, "DUPLICATE").otherwise("OUT_OF_ORDER")
    return ticks.withColumn("verdict", verdict)


def epochs(ticks: DataFrame, jump_back: int = 50, quiet_s: float = 60.0) -> DataFrame:
    """Number of the epoch of each row: it grows where the sequence falls far back after a quiet time."""
    order = Window.partitionBy("source", "instrument_id").orderBy("receive_timestamp", "event_id")
    fell = (F.lag("sequence_number").over(order) - F.col("sequence_number") >= jump_back) & (F.col("exchange_timestamp") - F.lag("exchange_timestamp").over(order) >= quiet_s)
    return ticks.withColumn("_new", F.coalesce(fell, F.lit(False)).cast("int")).withColumn("epoch", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def incidents(anomalies: DataFrame, quiet_s: float = 300.0) -> DataFrame:
    """Anomalies of one source, instrument and reason become one incident until quiet_s pass without one."""
    keys = ["source", "instrument_id", "reason"]
    order = Window.partitionBy(*keys).orderBy("exchange_timestamp", "event_id")
    starts = F.coalesce(F.col("exchange_timestamp") - F.lag("exchange_timestamp").over(order) > quiet_s, F.lit(True)).cast("int")
    rows = anomalies.withColumn("_s", starts).withColumn("incident", F.sum("_s").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "incident").agg(F.min("exchange_timestamp").alias("start_ts"), F.max("exchange_timestamp").alias("end_ts"), F.count(F.lit(1)).alias("n"))


def latest(ticks: DataFrame, n: int = 100) -> DataFrame:
    """The newest rows, 1 to 10000 of them."""
    return ticks.orderBy(F.desc("exchange_timestamp"), F.desc("event_id")).limit(max(1, min(10_000, n)))


def latest_per_key(ticks: DataFrame, key: str = "instrument_id") -> DataFrame:
    order = F.struct("exchange_timestamp", "event_id")
    return ticks.groupBy(key).agg(F.max_by(F.struct(*[c for c in ticks.columns if c != key]), order).alias("r")).select(key, "r.*")


def page(rows: DataFrame, after: int, n: int, key: str = "sequence_number") -> DataFrame:
    """Keyset pagination: the n rows that follow a key."""
    return rows.where(F.col(key) > after).orderBy(key).limit(n)
