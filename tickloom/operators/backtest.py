"""Backtests: strategies over ordered events, fills with costs, and what they earn."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FILLS = "strategy string, instrument_id string, event_id string, exchange_timestamp double, side string, quantity double, price double, fee double, position double, avg_cost double, realized double, equity double"


class Position:
    """Average-cost position: closing realises, turning over sets the cost to the fill's price."""

    def __init__(self):
        self.quantity = self.cost = self.realized = self.fees = 0.0

    def fill(self, side: str, quantity: float, price: float, fee: float = 0.0) -> None:
        signed = quantity if side == "BUY" else -quantity
        self.fees += fee
        if self.quantity * signed >= 0:
            total = self.quantity + signed
            self.cost = (self.cost * self.quantity + price * signed) / total if total else 0.0
            self.quantity = total
            return
        closed = min(abs(signed), abs(self.quantity))
        self.realized += closed * (price - self.cost) * (1 if self.quantity > 0 else -1)
        left = self.quantity + signed
        if self.quantity * left < 0:
            self.cost = price
        elif left == 0:
            self.cost = 0.0
        self.quantity = left

    def equity(self, price: float) -> float:
        return self.realized - self.fees + self.quantity * (price - self.cost)


def spread_crosser(events: pd.DataFrame) -> list[tuple[int, str, float]]:
    """Buys after three falls of the price, sells after three rises: (event number, side, quantity)."""
    out, run, before = [], 0, None
    for i, price in enumerate(events["price"]):
        if price != price:
            continue
        if before is not None and price != before:
            run = (run + 1 if run > 0 else 1) if price > before else (run - 1 if run < 0 else -1)
        before = price
        if run in (3, -3):
            out.append((i, "SELL" if run > 0 else "BUY", 1.0))
    return out


def run(events: DataFrame, strategies: dict[str, Callable[[pd.DataFrame], list[tuple[int, str, float]]]], latency: int = 1, fee_bps: float = 1.0) -> DataFrame:
    """Fills of every strategy on every instrument. An order is filled at the price of the `latency`-th priced event after it."""

    def fold(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["exchange_timestamp", "event_id"], kind="stable").reset_index(drop=True)
        out = []
        for name, strategy in strategies.items():
            held = Position()
            for i, side, quantity in strategy(own):
                at = i + latency
                if at >= len(own):
                    continue
                e = own.iloc[at]
                fee = e["price"] * quantity * fee_bps / 1e4
                held.fill(side, quantity, e["price"], fee)
                out.append((name, e["instrument_id"], e["event_id"], e["exchange_timestamp"], side, quantity, e["price"], fee, held.quantity, held.cost, held.realized, held.equity(e["price"])))
        return pd.DataFrame(out, columns=[c.split(" ")[0] for c in FILLS.split(", ")])

    rows = events.where("price is not null").select("instrument_id", "event_id", "exchange_timestamp", "price", "quantity")
    return rows.groupBy("instrument_id").applyInPandas(fold, FILLS)


def performance(fills: DataFrame) -> DataFrame:
    """Per strategy and instrument: fills, final equity, greatest fall of it, fees."""
    order = Window.partitionBy("strategy", "instrument_id").orderBy("exchange_timestamp", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = fills.withColumn("_peak", F.greatest(F.lit(0.0), F.max("equity").over(order)))
    return rows.groupBy("strategy", "instrument_id").agg(F.count(F.lit(1)).alias("fills"), F.max_by("equity", F.struct("exchange_timestamp", "event_id")).alias("equity"), F.max(F.col("_peak") - F.col("equity")).alias("max_drawdown"), F.sum("fee").alias("fees"))


def walk_forward(events: DataFrame, splits: int = 5, train: float = 0.6) -> DataFrame:
    """Events with the number of their split and whether they are for training: equal runs of time's order, the first share of each trains."""
    lo_hi = events.agg(F.min("exchange_timestamp").alias("_lo"), F.max("exchange_timestamp").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / splits
    rows = events.crossJoin(lo_hi).withColumn("split", F.least(F.floor((F.col("exchange_timestamp") - F.col("_lo")) / width), F.lit(splits - 1)).cast("int"))
    return rows.withColumn("training", F.col("exchange_timestamp") < F.col("_lo") + width * (F.col("split") + train)).drop("_lo", "_hi")
