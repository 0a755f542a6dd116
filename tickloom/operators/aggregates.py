"""Aggregations over ticks: bars, prices, spreads, latencies, counts.

All combine before their one shuffle; results that go to a reader are rounded as the columns' names say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.schema import INTERVALS, bucket, order_key, symbol_filter


def ohlcv(ticks: DataFrame, symbol: str | None = None, interval: float = 5.0, limit: int | None = None) -> DataFrame:
    """Open, high, low, close, volume and count of priced trades per instrument and bucket; with a limit, the newest buckets. Trades at the same time are ordered by sequence number, then by id."""
    rows = ticks.where((F.col("event_type") == "TRADE") & F.col("price").isNotNull() & symbol_filter(symbol))
    rows = rows.select("instrument_id", bucket("exchange_timestamp", interval).alias("bucket"), "price", "quantity", order_key("exchange_timestamp").alias("k"))
    bars = rows.groupBy("instrument_id", "bucket").agg(*map(F.expr, (
        "round(min_by(price, k), 4) AS open", "round(max(price), 4) AS high", "round(min(price), 4) AS low", "round(max_by(price, k), 4) AS close",
        "round(sum(coalesce(quantity, 0D)), 2) AS volume", "count(1) AS trade_count",
    )))
    return bars if limit is None else bars.orderBy(F.desc("bucket"), "instrument_id").limit(limit)


def bars(ticks: DataFrame, intervals: dict[str, float] | None = None) -> DataFrame:
    """Bars of several intervals, with VWAP (the close where nothing was traded); open and close by arrival.

    Where every interval is a multiple of the shortest, ticks are aggregated once, to the shortest, and its
    bars make the others: so ticks are shuffled for one interval, not for each.
    """
    codes = intervals or INTERVALS
    base = min(codes.values())
    if any(s % base for s in codes.values()):
        return _union([bars(ticks, {c: s}) for c, s in codes.items()])
    quantity = F.coalesce("quantity", F.lit(0.0))
    rows = ticks.where("price is not null and quality_status <> 'INVALID'").select("instrument_id", bucket("exchange_timestamp", base).alias("_b"), "price", quantity.alias("q"), (F.col("price") * quantity).alias("n"), order_key("receive_timestamp").alias("k"))
    small = rows.groupBy("instrument_id", "_b").agg(
        F.min_by("price", "k").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "k").alias("close"),
        F.sum("q").alias("volume"), F.count(F.lit(1)).alias("trade_count"), F.sum("n").alias("notional"), F.min("k").alias("k0"), F.max("k").alias("k1"),
    )
    steps = F.array(*(F.struct(F.lit(c).alias("interval"), F.lit(float(s)).alias("s")) for c, s in codes.items()))
    each = small.select("*", F.explode(steps).alias("step"))
    start = F.floor(F.col("_b") / F.col("step.s")).cast("double") * F.col("step.s")
    return each.groupBy("instrument_id", F.col("step.interval").alias("interval"), start.alias("bucket_start")).agg(
        F.min_by("open", "k0").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "k1").alias("close"),
        F.sum("volume").alias("volume"), F.sum("trade_count").alias("trade_count"), F.sum("notional").alias("_notional"),
    ).withColumn("vwap", F.when(F.col("volume") > 0, F.col("_notional") / F.col("volume")).otherwise(F.col("close"))).drop("_notional")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def merge_bars(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by merging: the older open, the newer close, extremes, sums, and the volume-weighted VWAP."""
    both = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    return both.groupBy("instrument_id", "interval", "bucket_start").agg(
        F.min_by("open", "_age").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "_age").alias("close"), F.sum("volume").alias("volume"), F.sum("trade_count").alias("trade_count"),
        F.coalesce(F.try_divide(F.sum(F.col("vwap") * F.col("volume")), F.sum("volume")), F.max_by("close", "_age")).alias("vwap"),
    )


def vwap(ticks: DataFrame, symbol: str | None = None, start: float | None = None, end: float | None = None) -> DataFrame:
    """One row: VWAP, notional, volume, extremes and count of trades with a quantity; zeros where there are none."""
    rows = ticks.where(F.col("price").isNotNull() & (F.col("quantity") > 0) & symbol_filter(symbol))
    if start is not None:
        rows = rows.where(F.col("exchange_timestamp") >= start)
    if end is not None:
        rows = rows.where(F.col("exchange_timestamp") <= end)
    return rows.agg(*map(F.expr, (
        "round(coalesce(sum(price * quantity) / sum(quantity), 0D), 4) AS vwap", "round(coalesce(sum(price * quantity), 0D), 2) AS notional",
        "round(coalesce(sum(quantity), 0D), 4) AS volume", "coalesce(min(price), 0D) AS min_price", "coalesce(max(price), 0D) AS max_price", "count(1) AS trade_count",
    )))


def vwap_by_instrument(ticks: DataFrame) -> DataFrame:
    rows = ticks.where("price is not null and quantity > 0")
    return rows.groupBy("instrument_id").agg(F.round(F.sum(F.col("price") * F.col("quantity")) / F.sum("quantity"), 4).alias("vwap"), F.count(F.lit(1)).alias("trade_count"))


def spreads(ticks: DataFrame) -> DataFrame:
    """Quotes per instrument: mean and extreme spread, and how many are crossed (bid above ask)."""
    rows = ticks.where("bid_price is not null and ask_price is not null").withColumn("spread", F.col("ask_price") - F.col("bid_price"))
    crossed = F.count_if(F.col("bid_price") > F.col("ask_price"))
    return rows.groupBy("instrument_id").agg(
        F.count(F.lit(1)).alias("quote_count"), F.round(F.avg("spread"), 4).alias("avg_spread"),
        F.round(F.min("spread"), 4).alias("min_spread"), F.round(F.max("spread"), 4).alias("max_spread"),
        crossed.alias("crossed_count"), F.round(crossed * F.lit(100.0).cast("double") / F.count(F.lit(1)), 2).alias("crossed_pct"),
    )


def latency_quantiles(ticks: DataFrame) -> DataFrame:
    """Exact quantiles of processing latency in microseconds, where it isn't negative; between two values in proportion."""
    us = (F.col("processing_timestamp") - F.col("receive_timestamp")) * F.lit(1e6)
    placed = with_places(ticks.where("processing_timestamp >= receive_timestamp").select(us.alias("us")), "us")
    out = []
    for name, q in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99), ("p999", 0.999)):
        at = f"({q}D * (max(upto) - 1))"
        low, high = (f"min(us) FILTER (WHERE upto > {f}({q}D * (total - 1)))" for f in ("floor", "ceil"))
        out.append(F.expr(f"round({low} + ({high} - {low}) * ({at} - floor({at})), 2) AS {name}"))
    return placed.agg(*out, F.expr("round(sum(us * times) / sum(times), 2) AS mean"), F.expr("sum(times) AS n"))


#: Parts into which with_places cuts each doubling of a value.
STEPS = 32


def with_places(rows: DataFrame, value: str) -> DataFrame:
    """Each distinct value that isn't null, how many `times` it occurs, how many rows are `upto` it, and the `total`.

    The value with the 0-based place k in order is the least whose `upto` exceeds k. Equal values are
    counted before the shuffle; running sums are taken inside steps of the logarithm (some thousand at the
    most, whatever the rows) and over the steps' sums, so neither all rows nor all values pass through one
    task.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("times"))
    dealt = counts.withColumn("_step", F.expr(f"CAST(signum({value}) * floor(log2(abs({value}) + 1) * {STEPS}) AS INT)"))
    sums = dealt.groupBy("_step").agg(F.sum("times").alias("_n"))
    before = sums.selectExpr("_step", "coalesce(sum(_n) OVER (ORDER BY _step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS _before", "sum(_n) OVER () AS total")
    inside = dealt.selectExpr("*", f"sum(times) OVER (PARTITION BY _step ORDER BY {value} ROWS UNBOUNDED PRECEDING) AS _inside")
    return inside.join(F.broadcast(before), "_step").select(value, "times", (F.col("_inside") + F.col("_before")).alias("upto"), "total")


def volume_profile(ticks: DataFrame, bins: int = 10) -> DataFrame:
    """Volume by price bin per instrument; the highest price falls into a bin of its own, number `bins`."""
    rows = ticks.where("price is not null and quantity > 0")
    bounds = rows.groupBy("instrument_id").agg(F.min("price").alias("low"), F.max("price").alias("high"), F.sum("quantity").alias("total"))
    width = (F.col("high") - F.col("low")) / F.lit(float(bins))
    place = F.when(width > 0, F.floor((F.col("price") - F.col("low")) / width)).otherwise(F.lit(0)).cast("long")
    # instruments are few next to ticks; adaptive execution decides whether the bounds are small enough to broadcast
    return rows.join(bounds, "instrument_id").groupBy("instrument_id", place.alias("bin")).agg(
        F.round(F.sum("quantity"), 2).alias("volume"), F.count(F.lit(1)).alias("trade_count"),
        F.round(F.sum("quantity") / F.max("total") * F.lit(100.0).cast("double"), 4).alias("pct"),
    )


def volatility(ticks: DataFrame) -> DataFrame:
    """Mean, population deviation, extremes and range in percent of the mean, of trade prices per instrument."""
    return ticks.where("price is not null and quality_status <> 'INVALID'").groupBy("instrument_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("price"), 6).alias("mean"), F.round(F.stddev_pop("price"), 6).alias("std_dev"),
        F.min("price").alias("min_price"), F.max("price").alias("max_price"),
        F.round((F.max("price") - F.min("price")) / F.avg("price") * F.lit(100.0).cast("double"), 4).alias("range_pct"),
    )


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("quality_status").agg(F.count(F.lit(1)).alias("n"))


def reason_counts(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def inventory(ticks: DataFrame) -> DataFrame:
    """One row: rows, instruments, first and last time."""
    return ticks.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("instrument_id").alias("instruments"), F.countDistinct("source").alias("sources"), F.round(F.min("exchange_timestamp"), 6).alias("min_ts"), F.round(F.max("exchange_timestamp"), 6).alias("max_ts"))


def symbols(ticks: DataFrame) -> DataFrame:
    return ticks.select("instrument_id").distinct()


def freshness(store: DataFrame, origin: DataFrame) -> DataFrame:
    """One row: counts and newest times of two stores, the lag, and whether the first has caught up."""
    a = store.agg(F.count(F.lit(1)).alias("store_rows"), F.max("exchange_timestamp").alias("a_ts"))
    b = origin.agg(F.count(F.lit(1)).alias("origin_rows"), F.max("exchange_timestamp").alias("b_ts"))
    return a.crossJoin(b).select("store_rows", "origin_rows", F.round(F.col("b_ts") - F.col("a_ts"), 6).alias("lag_s"), (F.col("a_ts") >= F.col("b_ts")).alias("is_fresh"))


def source_health(rows: DataFrame) -> DataFrame:
    """Counts per source of judged rows: all, invalid, suspicious, duplicates, gaps."""
    has = lambda r: F.count_if(F.array_contains("reasons", r))
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("quality_status") == "INVALID").alias("invalid"),
        F.count_if(F.col("quality_status") == "SUSPICIOUS").alias("suspicious"), has("DUPLICATE").alias("duplicate"), has("SEQUENCE_GAP").alias("gap"),
    )


def histogram(rows: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """Cumulative counts of values at or below each edge, and below infinity."""
    sums = [F.count_if(F.col(value) <= F.lit(float(e))).alias(f"_{i}") for i, e in enumerate(edges)]
    one = rows.agg(*sums, F.count(value).alias("_all"))
    pairs = F.array(*(F.struct(F.lit(str(float(e))).alias("le"), F.col(f"_{i}").alias("n")) for i, e in enumerate(edges)), F.struct(F.lit("+Inf").alias("le"), F.col("_all").alias("n")))
    return one.select(F.inline(pairs))


def bar_summary(bars: DataFrame) -> DataFrame:
    return bars.agg(F.count(F.lit(1)).alias("bars"), F.countDistinct("instrument_id").alias("instruments"), F.countDistinct("interval").alias("intervals"), F.min("bucket_start").alias("first"), F.max("bucket_start").alias("last"))


def tear_sheet(returns: DataFrame, value: str = "ret") -> DataFrame:
    """Mean, sample deviation, population skewness and kurtosis (not the excess)."""
    return returns.agg(F.round(F.avg(value), 8).alias("mean"), F.round(F.stddev_samp(value), 8).alias("std"), F.round(F.skewness(value), 6).alias("skewness"), F.round(F.kurtosis(value) + 3, 6).alias("kurtosis"), F.count(value).alias("n"))


def manifest(ticks: DataFrame) -> DataFrame:
    """What each partition of a history holds: rows, and extremes of time and sequence number."""
    day = F.timestamp_micros((F.col("exchange_timestamp") * 1e6).cast("long"))
    return ticks.withColumn("day", F.date_format(day, "yyyy-MM-dd")).groupBy("day", "instrument_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min("exchange_timestamp"), 6).alias("min_ts"), F.round(F.max("exchange_timestamp"), 6).alias("max_ts"),
        F.min("sequence_number").alias("min_seq"), F.max("sequence_number").alias("max_seq"),
    )
