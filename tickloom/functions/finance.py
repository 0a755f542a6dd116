"""Column expressions of finance: options, market making, FX basis, Sharpe statistics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ERF = np.vectorize(math.erf, otypes=[float])


def norm_cdf(x: Column | str) -> Column:
    """The standard normal distribution; Spark has no error function, so it goes through Arrow batches."""

    @F.pandas_udf("double")
    def of(v: pd.Series) -> pd.Series:
        return pd.Series(0.5 * (1 + _ERF(v.to_numpy(float) / math.sqrt(2))) if len(v) else [], dtype=float)

    return of(x)


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def _d(s: Column, k: Column, t: Column, r: Column, v: Column) -> tuple[Column, Column]:
    d1 = (F.ln(s / k) + (r + v * v / 2) * t) / (v * F.sqrt(t))
    return d1, d1 - v * F.sqrt(t)


def option_values(rows: DataFrame) -> DataFrame:
    """Price and Greeks of European options (spot, strike, years, rate, vol, option_type CALL or PUT).

    At expiry the price is the payoff, at zero volatility the discounted one; the Greeks are null there.
    Theta is per calendar day; vega and rho are per percent.
    """
    s, k, t, r, v = (F.col(c) for c in ("spot", "strike", "years", "rate", "vol"))
    call = F.col("option_type") == "CALL"
    live = (t > 0) & (v > 0)
    d1, d2 = _d(s, k, F.when(live, t), r, F.when(live, v))
    rows = rows.withColumns({"_d1": d1, "_d2": d2})
    rows = rows.withColumns({"_n1": norm_cdf("_d1"), "_n2": norm_cdf("_d2"), "_p1": norm_pdf(F.col("_d1"))})
    n1, n2, p1 = F.col("_n1"), F.col("_n2"), F.col("_p1")
    later = k * F.exp(-r * t)
    payoff = F.when(t <= 0, F.when(call, F.greatest(F.lit(0.0), s - k)).otherwise(F.greatest(F.lit(0.0), k - s))).otherwise(F.when(call, F.greatest(F.lit(0.0), s - later)).otherwise(F.greatest(F.lit(0.0), later - s)))
    decay = -s * p1 * v / (2 * F.sqrt(t))
    return rows.withColumns({
        "price": F.when(~live, payoff).when(call, s * n1 - later * n2).otherwise(later * (1 - n2) - s * (1 - n1)),
        "delta": F.when(live, F.when(call, n1).otherwise(n1 - 1)),
        "gamma": F.when(live, p1 / (s * v * F.sqrt(t))),
        "theta": F.when(live, F.when(call, decay - r * later * n2).otherwise(decay + r * later * (1 - n2)) / 365.0),
        "vega": F.when(live, s * p1 * F.sqrt(t) / 100.0),
        "rho": F.when(live, F.when(call, later * t * n2).otherwise(-later * t * (1 - n2)) / 100.0),
        "vanna": F.when(live, -p1 * F.col("_d2") / v),
        "volga": F.when(live, s * p1 * F.sqrt(t) * F.col("_d1") * F.col("_d2") / v),
    }).drop("_d1", "_d2", "_n1", "_n2", "_p1")


def implied_volatility(rows: DataFrame, tolerance: float = 1e-8, rounds: int = 100) -> DataFrame:
    """iv: the volatility at which the option is worth market_price, by bisection between 1e-6 and 10; null if none."""

    @F.pandas_udf("double")
    def solve(px: pd.Series, s: pd.Series, k: pd.Series, t: pd.Series, r: pd.Series, call: pd.Series) -> pd.Series:
        px, s, k, t, r = (x.to_numpy(float) for x in (px, s, k, t, r))
        call = call.to_numpy(bool)

        def value(v: np.ndarray) -> np.ndarray:
            d1 = (np.log(s / k) + (r + v * v / 2) * t) / (v * np.sqrt(t))
            d2 = d1 - v * np.sqrt(t)
            n1, n2 = (0.5 * (1 + _ERF(d / math.sqrt(2))) for d in (d1, d2))
            later = k * np.exp(-r * t)
            return np.where(call, s * n1 - later * n2, later * (1 - n2) - s * (1 - n1))

        low, high = np.full(len(px), 1e-6), np.full(len(px), 10.0)
        possible = (value(low) <= px + tolerance) & (value(high) >= px - tolerance) & (t > 0)
        for _ in range(rounds):
            mid = (low + high) / 2
            under = value(mid) < px
            low, high = np.where(under, mid, low), np.where(under, high, mid)
        return pd.Series(np.where(possible, (low + high) / 2, np.nan)).replace({np.nan: None}).astype(float)

    return rows.withColumn("iv", F.nanvl(solve("market_price", "spot", "strike", "years", "rate", F.col("option_type") == "CALL"), F.lit(None)))


def binomial_price(s: float, k: float, t: float, r: float, v: float, call: bool, american: bool = True, steps: int = 200) -> float:
    """Price on a recombining tree."""
    if t <= 0:
        return max(0.0, s - k if call else k - s)
    dt = t / steps
    up = math.exp(v * math.sqrt(dt))
    p, discount = (math.exp(r * dt) - 1 / up) / (up - 1 / up), math.exp(-r * dt)
    sign = 1 if call else -1
    ends = s * up ** np.arange(-steps, steps + 1, 2, dtype=float)
    worth = np.maximum(0.0, sign * (ends - k))
    for n in range(steps - 1, -1, -1):
        worth = discount * (p * worth[1:] + (1 - p) * worth[:-1])
        if american:
            worth = np.maximum(worth, sign * (s * up ** np.arange(-n, n + 1, 2, dtype=float) - k))
    return float(worth[0])


def at_the_money(chain: DataFrame, spot: float) -> DataFrame:
    """Of each expiry the strike nearest to the spot; the lower of equals."""
    return chain.groupBy("years").agg(F.min_by("strike", F.struct(F.abs(F.col("strike") - spot), F.col("strike"))).alias("atm_strike"))


def max_pain(chain: DataFrame) -> DataFrame:
    """Of each expiry the strike at which all options together are worth least; the lowest of equals.

    Sums over the options below and above a strike are running sums, so strikes aren't paired.
    """
    from pyspark.sql import Window

    k = F.col("strike")
    per = chain.groupBy("years", "strike").agg(F.sum(F.when(F.col("option_type") == "CALL", 1.0).otherwise(0.0)).alias("c"), F.sum(F.when(F.col("option_type") == "PUT", 1.0).otherwise(0.0)).alias("p"))
    up = Window.partitionBy("years").orderBy("strike").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("years").orderBy(F.desc("strike")).rowsBetween(Window.unboundedPreceding, 0)
    pain = k * F.sum("c").over(up) - F.sum(F.col("c") * k).over(up) + F.sum(F.col("p") * k).over(down) - k * F.sum("p").over(down)
    return per.withColumn("pain", F.round(pain, 9)).groupBy("years").agg(F.min_by("strike", F.struct("pain", "strike")).alias("max_pain"))


def avellaneda_stoikov(mid: Column, inventory: Column, sigma: Column, gamma: float = 0.1, kappa: float = 1.5, left: float = 1.0, tick: float = 0.01) -> dict[str, Column]:
    """Reservation price, half spread and quotes of a market maker averse to inventory."""
    s2 = F.pow(F.greatest(F.lit(1e-6), sigma), F.lit(2.0)) * gamma * max(1e-4, left)
    reservation = mid - inventory * s2
    half = F.greatest(F.lit(tick), (s2 + (2 / gamma) * math.log(1 + gamma / kappa)) / 2)
    return {"reservation": reservation, "half_spread": half, "bid_quote": F.bround(reservation - half, 2), "ask_quote": F.bround(reservation + half, 2)}


def linear_skew(mid: Column, inventory: Column, half_spread: float = 0.05, penalty: float = 0.01, tick: float = 0.01) -> dict[str, Column]:
    half = max(tick, half_spread)
    reservation = mid - inventory * penalty
    return {"reservation": reservation, "bid_quote": F.bround(reservation - half, 2), "ask_quote": F.bround(reservation + half, 2)}


#: Rates to the dollar taken where none are given.
FX_RATES = {"USD": 1.0, "USDT": 0.999, "USDC": 1.0, "EUR": 1.085, "GBP": 1.295}


def quote_currency(symbol: Column) -> Column:
    """The currency behind the last part of a symbol such as BTC-USD, BTC/USDT or BTCUSDT; dollars if unknown."""
    clean = F.regexp_replace(F.upper(symbol), "[/_]", "-")
    ends = F.coalesce(*(F.when(clean.endswith(c), F.lit(c)) for c in ("USDT", "USDC", "USD", "EUR", "GBP")), F.lit("USD"))
    return F.when(clean.contains("-"), F.split(clean, "-")[1]).otherwise(ends)


def fx_basis(rows: DataFrame, rates: dict[str, float] | None = None, slippage_bps: float = 1.0, least_bps: float = 2.0) -> DataFrame:
    """What buying on one venue and selling on another leaves, in dollars and basis points, after fees."""
    table = FX_RATES | (rates or {})
    rate = lambda symbol: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), quote_currency(F.col(symbol))), F.lit(1.0))
    rows = rows.withColumns({"buy_usd": F.col("buy_price") * rate("buy_symbol"), "sell_usd": F.col("sell_price") * rate("sell_symbol")})
    b, s = F.col("buy_usd"), F.col("sell_usd")
    fees = b * F.col("buy_fee_bps") / 1e4 + s * F.col("sell_fee_bps") / 1e4 + b * (slippage_bps / 1e4)
    rows = rows.withColumns({"gross_usd": s - b, "fees_usd": fees, "net_usd": s - b - fees})
    rows = rows.withColumn("net_bps", F.when(b > 0, F.col("net_usd") / b * 1e4).otherwise(F.lit(0.0)))
    reason = F.when(F.col("gross_usd") <= 0, "NEGATIVE_GROSS_SPREAD").when(F.col("net_bps") < least_bps, "FEE_DRAG_UNPROFITABLE").otherwise("PROFITABLE")
    return rows.withColumn("reason", reason)


def probabilistic_sharpe(sharpe: float, benchmark: float = 0.0, n: int = 100, skewness: float = 0.0, kurtosis: float = 3.0) -> float:
    """Probability that the true ratio exceeds the benchmark, for returns that needn't be normal."""
    if n <= 1:
        return 0.0
    term = 1 - skewness * sharpe + (kurtosis - 1) / 4 * sharpe**2
    sigma = math.sqrt((term if term > 0 else 1e-6) / (n - 1))
    if sigma <= 1e-12:
        return float(sharpe > benchmark)
    return 0.5 * (1 + math.erf((sharpe - benchmark) / sigma / math.sqrt(2)))


def deflated_sharpe(sharpe: float, trials: int = 10, n: int = 100, skewness: float = 0.0, kurtosis: float = 3.0) -> float:
    """The same against the best ratio that so many trials would show by luck."""
    if trials <= 1:
        return probabilistic_sharpe(sharpe, 0.0, n, skewness, kurtosis)
    log = max(1e-4, math.log(trials))
    return probabilistic_sharpe(sharpe, math.sqrt(2 * log) * (1 - 0.5772156649 / (2 * log)), n, skewness, kurtosis)


def sharpe_interval(sharpe: float, n: int, skewness: float = 0.0, kurtosis: float = 3.0) -> tuple[float, float]:
    """The asymptotic 95 percent interval of a ratio."""
    if n <= 1:
        return 0.0, 0.0
    term = 1 - skewness * sharpe + (kurtosis - 1) / 4 * sharpe**2
    reach = 1.95996 * math.sqrt((term if term > 0 else 1e-6) / (n - 1))
    return round(sharpe - reach, 4), round(sharpe + reach, 4)


def calmar(annual_return_pct: float, max_drawdown_pct: float) -> float:
    return annual_return_pct / max_drawdown_pct if max_drawdown_pct > 1e-6 else 0.0


def parity_gaps(chain: DataFrame) -> DataFrame:
    """Call less put against spot less discounted strike, where both are quoted: spot, strike, years, rate, option_type, price."""
    keys = ["spot", "strike", "years", "rate"]
    both = chain.groupBy(*keys).agg(F.avg(F.when(F.col("option_type") == "CALL", F.col("price"))).alias("call"), F.avg(F.when(F.col("option_type") == "PUT", F.col("price"))).alias("put")).where("call is not null and put is not null")
    return both.withColumn("gap", F.col("call") - F.col("put") - (F.col("spot") - F.col("strike") * F.exp(-F.col("rate") * F.col("years"))))


def surface_point(surface: DataFrame, strike: float, years: float) -> DataFrame:
    """The volatility of the surface point (strike, years, vol) that is nearest, distances taken in parts of the point asked for."""
    far = F.pow((F.col("strike") - strike) / strike, F.lit(2.0)) + F.pow((F.col("years") - years) / max(years, 1e-9), F.lit(2.0))
    return surface.agg(F.min_by(F.struct("strike", "years", "vol"), F.struct(far, F.col("strike"), F.col("years"))).alias("p")).select("p.*")


def smile(surface: DataFrame, years: float) -> DataFrame:
    """Strikes and volatilities of one expiry, in order."""
    return surface.where(F.abs(F.col("years") - years) < 1e-9).select("strike", "vol").orderBy("strike")


def term_structure(surface: DataFrame, spot: float) -> DataFrame:
    """Of each expiry the volatility at the strike nearest to the spot."""
    return surface.groupBy("years").agg(F.min_by("vol", F.struct(F.abs(F.col("strike") - spot), F.col("strike"))).alias("vol"))


def skew(surface: DataFrame, spot: float, away: float = 0.1) -> DataFrame:
    """Of each expiry the volatility nearest `away` below the spot less the one nearest `away` above."""
    at = lambda k: F.min_by("vol", F.struct(F.abs(F.col("strike") - k), F.col("strike")))
    return surface.groupBy("years").agg((at(spot * (1 - away)) - at(spot * (1 + away))).alias("skew"))


def signal_test(rows: DataFrame, value: str = "ret", periods: float = 252.0) -> DataFrame:
    """Mean, t, two-sided p (normal) and information ratio of a signal's returns."""
    one = rows.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("_s"), F.count(value).alias("n"))
    one = one.withColumn("t", F.when(F.col("_s") > 0, F.col("mean") / (F.col("_s") / F.sqrt("n"))).otherwise(F.lit(0.0)))
    return one.withColumns({"p": 2 * (1 - norm_cdf(F.abs("t"))), "information_ratio": F.when(F.col("_s") > 0, F.col("mean") / F.col("_s") * math.sqrt(periods)).otherwise(F.lit(0.0))}).drop("_s")
