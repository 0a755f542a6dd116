"""Order flow: who was the aggressor, and what it adds up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.joins import as_of


def quote_side(price: Column, bid: Column, ask: Column, band: Column | None = None) -> Column:
    """BUY at or near the ask, SELL at or near the bid, else null; near: max(1e-5, half a percent of the spread)."""
    eps = F.greatest(F.lit(1e-5), F.lit(0.005).cast("double") * (ask - bid)) if band is None else band
    sane = bid.isNotNull() & ask.isNotNull() & (ask > bid)
    return F.when(sane & (price >= ask - eps), "BUY").when(sane & (price <= bid + eps), "SELL")


def classify(trades: DataFrame, quotes: DataFrame) -> DataFrame:
    """Trades with the quote in force and the aggressor's side.

    The quote rule first; then the tick rule; a trade at the same price takes the side of the one before;
    the first trade of an instrument is a BUY.
    """
    met = as_of(trades, quotes, ["bid_price", "ask_price"])
    order = Window.partitionBy("instrument_id").orderBy("exchange_timestamp", "event_id")
    before = F.lag("price").over(order)
    price = F.col("price")
    told = F.coalesce(quote_side(price, F.col("asof_bid_price"), F.col("asof_ask_price")), F.when(price > before, "BUY").when(price < before, "SELL").when(before.isNull(), "BUY"))
    return met.withColumn("_told", told).withColumn("side", F.last("_told", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_told")


def cumulative_delta(classified: DataFrame) -> DataFrame:
    """Signed volume so far."""
    order = Window.partitionBy("instrument_id").orderBy("exchange_timestamp", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    signed = F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))
    return classified.withColumn("_signed", signed).withColumn("cvd", F.sum("_signed").over(order)).drop("_signed")


def summary(classified: DataFrame) -> DataFrame:
    """Per instrument: volume delta, notional delta, share of buying, and which side leads (60 percent or more)."""
    buy = F.col("side") == "BUY"
    notional = F.col("price") * F.col("quantity")
    part = lambda v: F.sum(F.when(buy, v).otherwise(-v))
    rows = classified.groupBy("instrument_id").agg(
        F.round(part(F.col("quantity")), 4).alias("cvd"), F.round(part(notional), 2).alias("cnd"),
        F.round(F.sum(F.when(buy, F.col("quantity")).otherwise(0.0)) / F.sum("quantity") * F.lit(100.0).cast("double"), 2).alias("buy_pct"), F.count(F.lit(1)).alias("trades"),
    )
    return rows.withColumn("bias", F.when(F.col("buy_pct") >= 60, "BUYERS").when(F.col("buy_pct") <= 40, "SELLERS").otherwise("BALANCED"))


def participants(classified: DataFrame, by: str = "broker", top: int = 10, band: float = 50_000.0) -> DataFrame:
    """Bought and sold by participant, its stance, and the `top` by absolute net notional."""
    buy, notional = F.col("side") == "BUY", F.col("price") * F.col("quantity")
    rows = classified.groupBy(by).agg(
        F.round(F.sum(F.when(buy, F.col("quantity")).otherwise(0.0)), 4).alias("buy_volume"), F.round(F.sum(F.when(buy, 0.0).otherwise(F.col("quantity"))), 4).alias("sell_volume"),
        F.round(F.sum(F.when(buy, notional).otherwise(-notional)), 2).alias("net_notional"),
    )
    rows = rows.withColumn("stance", F.when(F.col("net_notional") > band, "ACCUMULATING").when(F.col("net_notional") < -band, "DISTRIBUTING").otherwise("NEUTRAL"))
    return rows.orderBy(F.desc(F.abs("net_notional")), by).limit(top)
