"""Indicators that feed on themselves: EMA, RSI, MACD, ATR, reliability.

Each is a fold over one instrument's rows in order, written once as a function of arrays and applied per
group. Groups are instruments' bars: their length is the history's, not the ticks'.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAN = float("nan")


def ema(values: np.ndarray, n: int) -> np.ndarray:
    """Seeded by the mean of the first n; null before."""
    out = np.full(len(values), NAN)
    if len(values) < n or n < 1:
        return out
    share = 2 / (n + 1)
    out[n - 1] = values[:n].mean()
    for i in range(n, len(values)):
        out[i] = out[i - 1] + share * (values[i] - out[i - 1])
    return out


def rsi(values: np.ndarray, n: int = 14) -> np.ndarray:
    """Wilder's index, seeded by the mean gains and losses of the first n changes; 100 where nothing was lost."""
    out = np.full(len(values), NAN)
    if len(values) <= n:
        return out
    change = np.diff(values)
    gain, loss = np.clip(change, 0, None), np.clip(-change, 0, None)
    g, l = gain[:n].mean(), loss[:n].mean()  # noqa: E741
    out[n] = 100.0 if l == 0 else 100 - 100 / (1 + g / l)
    for i in range(n, len(change)):
        g, l = (g * (n - 1) + gain[i]) / n, (l * (n - 1) + loss[i]) / n  # noqa: E741
        out[i + 1] = 100.0 if l == 0 else 100 - 100 / (1 + g / l)
    return out


def macd(values: np.ndarray, fast: int = 12, slow: int = 26, signal: int = 9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    line = ema(values, fast) - ema(values, slow)
    own = np.full(len(values), NAN)
    first = slow - 1
    if len(values) > first:
        own[first:] = ema(line[first:], signal)
    return line, own, line - own


def atr(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 14) -> np.ndarray:
    """Wilder's mean of true ranges; the first range is high less low."""
    out = np.full(len(close), NAN)
    if len(close) < n:
        return out
    spans = high - low
    spans[1:] = np.maximum(spans[1:], np.maximum(np.abs(high[1:] - close[:-1]), np.abs(low[1:] - close[:-1])))
    out[n - 1] = spans[:n].mean()
    for i in range(n, len(close)):
        out[i] = (out[i - 1] * (n - 1) + spans[i]) / n
    return out


#: Features by name: bars of one instrument in order -> columns.
FEATURES: dict[str, Callable[[pd.DataFrame], dict[str, np.ndarray]]] = {
    "ema_12": lambda b: {"ema_12": ema(b["close"].to_numpy(), 12)},
    "rsi_14": lambda b: {"rsi_14": rsi(b["close"].to_numpy(), 14)},
    "macd": lambda b: dict(zip(("macd", "macd_signal", "macd_hist"), macd(b["close"].to_numpy()))),
    "atr_14": lambda b: {"atr_14": atr(b["high"].to_numpy(copy=True), b["low"].to_numpy(), b["close"].to_numpy(), 14)},
}


def feature_store(bars: DataFrame, names: list[str] | None = None, by: str = "instrument_id", order: str = "bucket", custom: dict | None = None) -> DataFrame:
    """Bars with a column for each feature; custom adds functions of an instrument's bars. Null where not yet known."""
    known = FEATURES | (custom or {})
    chosen = [known[n] for n in (names or list(FEATURES))]
    probe = pd.DataFrame({c: np.ones(3) for c in ("open", "high", "low", "close", "volume")})
    added = [c for f in chosen for c in f(probe)]
    schema = T.StructType([*bars.schema.fields, *(T.StructField(c, T.DoubleType()) for c in added)])

    def fill(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(order, kind="stable").reset_index(drop=True)
        for f in chosen:
            for name, values in f(own).items():
                own[name] = [None if np.isnan(v) else float(v) for v in values]
        return own[[f.name for f in schema]]

    return bars.groupBy(by).applyInPandas(fill, schema)


def reliability(rows: DataFrame, share: float = 0.02) -> DataFrame:
    """Score of each source after its rows, in order of receipt: smoothed accuracy, continuity, uniqueness and latency.

    rows: judged ticks. The first row seeds the averages.
    """
    schema = "source string, n long, latency double, error_rate double, gap_rate double, dup_rate double, score double"

    def fold(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["receive_timestamp", "event_id"], kind="stable")
        lat = np.clip((own["receive_timestamp"] - own["exchange_timestamp"]).to_numpy(), 0, None)
        marks = np.stack([(own["quality_status"] == "INVALID").to_numpy(), own["reasons"].map(lambda r: "SEQUENCE_GAP" in list(r)).to_numpy(), own["reasons"].map(lambda r: "DUPLICATE" in list(r)).to_numpy()]).astype(float)
        state = np.array([lat[0], *marks[:, 0]])
        for i in range(1, len(lat)):
            state = (1 - share) * state + share * np.array([lat[i], *marks[:, i]])
        latency, error, gap, dup = state
        score = 0.40 * (1 - error) + 0.25 * (1 - gap) + 0.20 * (1 - dup) + 0.15 / (1 + 100 * latency)
        return pd.DataFrame({"source": [own["source"].iloc[0]], "n": [len(own)], "latency": [latency], "error_rate": [error], "gap_rate": [gap], "dup_rate": [dup], "score": [round(score, 4)]})

    return rows.select("source", "event_id", "receive_timestamp", "exchange_timestamp", "quality_status", "reasons").groupBy("source").applyInPandas(fold, schema)


#: Newest rows of a source that its mean of gaps is made of: the weight of older ones, 0.9 to this power, is no number any more.
NEWEST = 20_000


def inter_arrival(ticks: DataFrame, keep: float = 0.9) -> DataFrame:
    """Per source the exponential mean of the gaps between its ticks' times (equal times make none), starting from the first gap; and their number.

    Weights are counted from the newest gap, so that only the newest rows of a source matter and each task
    passes on no more of them.
    """
    newest = Window.partitionBy("source").orderBy(F.desc("exchange_timestamp"))
    rows = ticks.select("source", "exchange_timestamp").distinct().withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= NEWEST)
    gaps = rows.withColumn("_gap", F.col("exchange_timestamp") - F.lead("exchange_timestamp").over(newest)).where("_gap is not null")
    weight = F.pow(F.lit(keep), F.col("_n") - 1)
    sums = gaps.groupBy("source").agg(F.sum(F.col("_gap") * weight * (1 - keep)).alias("_s"), F.max_by("_gap", "_n").alias("_first"), F.max("_n").alias("_kept"))
    counts = ticks.groupBy("source").agg((F.count_distinct("exchange_timestamp") - 1).alias("gaps"))
    return sums.join(counts, "source").select("source", (F.col("_s") + F.col("_first") * F.pow(F.lit(keep), F.col("_kept"))).alias("interval_s"), "gaps")
