"""Transaction cost analysis of executions against the quote in force."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.aggregates import with_places

D = lambda v: F.lit(v).cast("double")


def evaluate(executions: DataFrame) -> DataFrame:
    """Costs of each execution (trade_id, side, price, shares, broker, arrival_price, bid, ask).

    Without a quote, 5 hundredths on either side of the price stand for it; without an arrival price, the
    midpoint. Amounts called cents are units of the price.
    """
    quoted = F.col("bid").isNotNull() & F.col("ask").isNotNull() & ~F.isnan("bid") & ~F.isnan("ask")
    rows = executions.withColumns({
        "bid_at_fill": F.when(quoted, F.col("bid")).otherwise(F.round(F.col("price") - D(0.05), 4)),
        "ask_at_fill": F.when(quoted, F.col("ask")).otherwise(F.round(F.col("price") + D(0.05), 4)),
    })
    rows = rows.withColumn("midpoint", (F.col("bid_at_fill") + F.col("ask_at_fill")) / 2)
    mid, px, bid, ask = F.col("midpoint"), F.col("price"), F.col("bid_at_fill"), F.col("ask_at_fill")
    buy = F.upper(F.trim("side")) == "BUY"
    arrival = F.when((F.col("arrival_price") > 0) & ~F.isnan("arrival_price"), F.col("arrival_price")).otherwise(mid)
    rows = rows.withColumns({
        "arrival": arrival,
        "quoted_spread_cents": F.greatest(D(0.001), ask - bid),
        "slippage_cents": F.when(buy, px - arrival).otherwise(arrival - px),
        "effective_spread_cents": D(2.0) * F.when(buy, px - mid).otherwise(mid - px),
        "price_improvement_cents": F.round(F.greatest(D(0.0), F.when(buy, ask - px).otherwise(px - bid)), 4),
        "is_disimproved": F.when(buy, px > ask).otherwise(px < bid),
    })
    bps = lambda x, base: F.when(base > 0, x / base * D(10_000.0)).otherwise(D(0.0))
    rows = rows.withColumns({
        "slippage_bps": bps(F.col("slippage_cents"), F.col("arrival")),
        "effective_spread_bps": bps(F.col("effective_spread_cents"), mid),
        "quoted_spread_bps": bps(F.col("quoted_spread_cents"), mid),
        "price_improvement_usd": F.round(F.col("price_improvement_cents") * F.col("shares"), 2),
        "is_price_improved": F.col("price_improvement_cents") > D(0.0001),
    })
    score = (F.when(F.col("is_price_improved"), F.least(D(100.0), D(85.0) + F.col("price_improvement_cents") / F.col("quoted_spread_cents") * D(15.0)))
        .when(F.col("is_disimproved"), F.greatest(D(0.0), D(50.0) - F.abs("slippage_bps") * D(2.0)))
        .otherwise(F.greatest(D(50.0), D(85.0) - (F.col("effective_spread_cents") / F.col("quoted_spread_cents") - D(0.5)) * D(30.0))))
    return rows.withColumn("quality_score", score)


def _sums() -> list:
    return [
        F.count(F.lit(1)).alias("total_trades"), F.round(F.sum("shares"), 2).alias("total_shares"), F.round(F.sum(F.col("price") * F.col("shares")), 2).alias("total_notional"),
        F.round(F.avg("slippage_bps"), 2).alias("mean_slippage_bps"), F.round(F.avg("effective_spread_bps"), 2).alias("mean_effective_spread_bps"),
        F.count_if("is_price_improved").alias("improved"), F.count_if("is_disimproved").alias("disimproved"),
        F.round(F.sum("price_improvement_usd"), 2).alias("improvement_usd"), F.round(F.sum(F.greatest(D(0.0), F.col("slippage_cents")) * F.col("shares")), 3).alias("slippage_usd"),
    ]


def batch(evaluated: DataFrame) -> DataFrame:
    """One row over all executions. The middle and the 95th of 100 are the values at those places of the sorted slippages."""
    rows = evaluated.agg(*_sums(), F.avg("quality_score").alias("_score"))
    at = {"p50": "floor(total / 2)", "p95": "least(total - 1, floor(total * 0.95D))"}
    places = with_places(evaluated, "slippage_bps").agg(*(F.expr(f"round(min(slippage_bps) FILTER (WHERE upto > {k}), 2) AS {q}_slippage_bps") for q, k in at.items()))
    rows = rows.crossJoin(places)  # a row each
    return rows.withColumns({"overall_quality_score": F.round("_score", 1), "compliant": F.col("_score") >= 65}).drop("_score")


def scorecards(evaluated: DataFrame, by: str = "broker") -> DataFrame:
    """Executions by broker with a rating: 85, 70 and 50 part the tiers."""
    rows = evaluated.groupBy(by).agg(*_sums(), F.avg("quality_score").alias("_score"))
    tier = F.when(F.col("_score") >= 85, "TIER 1").when(F.col("_score") >= 70, "TIER 2").when(F.col("_score") >= 50, "TIER 3").otherwise("POOR")
    return rows.withColumns({"quality_score": F.round("_score", 1), "rating": tier}).drop("_score")


def markouts(fills: DataFrame, mids: DataFrame, horizons: list[float]) -> DataFrame:
    """What each fill has gained after each horizon: the midpoint then (or the last known) against the fill's price, signed by its side."""
    from tickloom.operators.joins import as_of_forward

    out = fills
    for h in horizons:
        name = f"markout_{h:g}s"
        out = as_of_forward(out, mids, "mid", h, out="_later").withColumn(name, F.when(F.upper("side") == "BUY", F.col("_later") - F.col("price")).otherwise(F.col("price") - F.col("_later"))).drop("_later")
    return out
