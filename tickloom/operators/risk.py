"""Risk of a series of returns: value at risk, shortfall, ratios, concentration, limits."""

from __future__ import annotations

from statistics import NormalDist

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def historical(returns: DataFrame, by: str = "instrument_id", value: str = "ret", confidence: float = 0.95) -> DataFrame:
    """Historical VaR and expected shortfall per key, as shares: the return at rank (1 - confidence) n, and the mean up to it."""
    order = Window.partitionBy(by).orderBy(value)
    rows = returns.where(F.col(value).isNotNull()).withColumns({"_i": F.row_number().over(order) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(by))})
    cut = F.greatest(F.lit(0), F.least(F.floor(F.lit(1 - confidence) * F.col("_n")), F.col("_n") - 1))
    rows = rows.withColumn("_cut", cut)
    return rows.groupBy(by).agg(F.greatest(F.lit(0.0), -F.max(F.when(F.col("_i") == F.col("_cut"), F.col(value)))).alias("var"), F.greatest(F.lit(0.0), -F.avg(F.when(F.col("_i") <= F.col("_cut"), F.col(value)))).alias("shortfall"), F.count(F.lit(1)).alias("n"))


def parametric(returns: DataFrame, by: str = "instrument_id", value: str = "ret", confidence: float = 0.95) -> DataFrame:
    """VaR of normally distributed returns."""
    z = NormalDist().inv_cdf(1 - confidence)
    return returns.groupBy(by).agg(F.greatest(F.lit(0.0), -(F.avg(value) + F.lit(z) * F.stddev_samp(value))).alias("var"))


def ratios(returns: DataFrame, by: str = "instrument_id", value: str = "ret", risk_free: float = 0.0, periods: float = 252.0) -> DataFrame:
    """Annualised Sharpe and Sortino ratios; 0 where nothing varies."""
    rate = (1 + risk_free) ** (1 / periods) - 1 if periods > 0 else risk_free
    x = F.col(value) - rate
    rows = returns.where(F.col(value).isNotNull()).groupBy(by).agg(F.avg(x).alias("_m"), F.stddev_samp(value).alias("_s"), F.sum(F.pow(F.least(F.lit(0.0), x), F.lit(2.0))).alias("_d"), F.count(F.lit(1)).alias("n"))
    down = F.sqrt(F.col("_d") / (F.col("n") - 1))
    root = float(np.sqrt(periods))
    safe = lambda over: F.when((F.col("n") >= 2) & (over > 0), F.col("_m") / over * root).otherwise(F.lit(0.0))
    return rows.select(by, safe(F.col("_s")).alias("sharpe"), safe(down).alias("sortino"), "n")


def monte_carlo(returns: DataFrame, by: str = "instrument_id", value: str = "ret", simulations: int = 10_000, horizon: int = 1, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """VaR of compounded normal returns with the sample's mean and deviation; the same for the same seed."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        x = own[value].dropna().to_numpy()
        if len(x) < 2:
            return pd.DataFrame({by: [own[by].iloc[0]], "var": [0.0]})
        paths = np.random.default_rng(seed).normal(x.mean(), x.std(ddof=1), (simulations, horizon))
        ends = np.sort(np.prod(1 + paths, axis=1) - 1)
        return pd.DataFrame({by: [own[by].iloc[0]], "var": [max(0.0, -float(ends[int((1 - confidence) * simulations)]))]})

    return returns.select(by, value).groupBy(by).applyInPandas(run, f"{by} string, var double")


def concentration(positions: DataFrame, by: str = "instrument_id", value: str = "notional") -> DataFrame:
    """Each position's share of the gross exposure, and the sum of squared shares."""
    gross = positions.agg(F.sum(F.abs(value)).alias("_g"))
    shares = positions.groupBy(by).agg(F.sum(F.abs(value)).alias("_v")).crossJoin(gross).withColumn("share", F.col("_v") / F.col("_g"))
    total = shares.agg(F.sum(F.col("share") * F.col("share")).alias("herfindahl"))
    return shares.select(by, "share").crossJoin(total)


def pre_trade(orders: DataFrame, limits: dict[str, float], any_sign: bool = False) -> DataFrame:
    """The first limit that an order breaks, or none: quantity, notional, distance from the reference price, position after it.

    any_sign: a price of zero or below is none that breaks a limit by itself.
    """
    gates = [
        (F.col("quantity") <= 0, "BAD_QUANTITY"),
        (F.lit(not any_sign) & (F.col("price") <= 0), "BAD_PRICE"),
        (F.col("quantity") > limits.get("max_quantity", float("inf")), "ORDER_SIZE"),
        (F.col("quantity") * F.col("price") > limits.get("max_notional", float("inf")), "ORDER_NOTIONAL"),
        (F.abs(F.col("price") - F.col("reference")) > F.col("reference") * limits.get("max_deviation", float("inf")), "PRICE_BAND"),
        (F.abs(F.col("position") + F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))) > limits.get("max_position", float("inf")), "POSITION"),
    ]
    verdict = F.coalesce(*(F.when(when, F.lit(name)) for when, name in gates))
    return orders.withColumn("rejected_by", verdict).withColumn("accepted", F.col("rejected_by").isNull())


#: What an order is rejected for, in the order of the gates.
GATES = ("KILL_SWITCH", "INVALID_QUANTITY", "FAT_FINGER_QTY", "STALE_QUOTE", "PRICE_COLLAR", "MAX_NOTIONAL", "SHORT_SELLING_DISABLED", "MAX_POSITION", "SYMBOL_CAP", "VENUE_CAP", "GROSS_EXPOSURE", "DUPLICATE_ORDER")


@dataclass(frozen=True)
class OrderLimits:
    """What an order may be; infinite where nothing is asked."""

    kill_switch: bool = False
    max_order_qty: float = float("inf")
    max_quote_age_s: float = float("inf")
    price_collar_bps: float = float("inf")
    max_order_notional: float = float("inf")
    allow_short: bool = True
    max_position_qty: float = float("inf")
    per_symbol_notional_cap: float = float("inf")
    per_venue_notional_cap: float = float("inf")
    max_gross_exposure: float = float("inf")
    idempotency_window_s: float = 0.0
    #: Whether a price of zero is a price; else it stands for none, and the midpoint is taken.
    zero_is_price: bool = False


def validate(orders: DataFrame, limits: OrderLimits = OrderLimits()) -> DataFrame:
    """Add rejected_by, the first gate of GATES that an order fails, or null.

    orders: order_id, ts, side, order_type, quantity, price, mid, quote_ts, order_key (each may be null but the
    first two), and what is held before it: position, and if known venue_exposure, gross_exposure. An order repeats
    another if that had its key, passed and came less than the window before; those rejected don't count.
    """
    inf, lim = float("inf"), limits
    held = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if c in orders.columns else F.lit(0.0)
    reference = F.coalesce(F.when(F.lit(lim.zero_is_price) | (F.col("price") != 0), F.col("price")), F.col("mid"))
    priced = F.coalesce(reference > 0, F.lit(False))
    notional = F.when(priced, F.col("quantity") * reference).otherwise(F.lit(0.0))
    after = F.col("position") + F.when(F.upper("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))
    number = F.col("quantity").isNull() | F.isnan("quantity") | (F.abs("quantity") == F.lit(inf)) | (F.col("quantity") <= 0)
    collar = (F.upper("order_type") == "LIMIT") & (F.col("mid") > 0) & (F.abs(F.col("price") - F.col("mid")) / F.col("mid") * F.lit(10_000.0) > F.lit(lim.price_collar_bps))
    tests = [
        F.lit(lim.kill_switch), number, F.col("quantity") > lim.max_order_qty, F.col("ts") - F.col("quote_ts") > lim.max_quote_age_s, collar, notional > lim.max_order_notional,
        F.lit(not lim.allow_short) & (after < 0), F.abs(after) > lim.max_position_qty, priced & (F.abs(after) * reference > lim.per_symbol_notional_cap),
        held("venue_exposure") + notional > lim.per_venue_notional_cap, held("gross_exposure") + notional > lim.max_gross_exposure,
    ]
    judged = orders.withColumn("rejected_by", F.coalesce(*(F.when(t, F.lit(name)) for t, name in zip(tests, GATES))))
    if not lim.idempotency_window_s:
        return judged
    # of each key, the times of orders that pass otherwise, folded in order: the last that passed, and who repeats it
    came = F.array_sort(F.collect_list(F.struct("ts", "order_id")))
    late = lambda s, x: s["last"].isNotNull() & (x["ts"] - s["last"] < lim.idempotency_window_s)
    start = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast(f"array<{dict(orders.dtypes)['order_id']}>").alias("again"))
    step = lambda s, x: F.struct(F.when(late(s, x), s["last"]).otherwise(x["ts"]).alias("last"), F.when(late(s, x), F.concat(s["again"], F.array(x["order_id"]))).otherwise(s["again"]).alias("again"))
    keyed = judged.where("rejected_by is null and order_key is not null").select("order_key", F.col("ts").cast("double").alias("ts"), "order_id")
    again = keyed.groupBy("order_key").agg(F.aggregate(came, start, step).alias("s")).select(F.explode("s.again").alias("order_id"), F.lit("DUPLICATE_ORDER").alias("_again"))
    return judged.join(again, "order_id", "left").withColumn("rejected_by", F.coalesce("rejected_by", "_again")).drop("_again")
