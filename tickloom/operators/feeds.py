"""Folds over feeds: reconciliation of sources, gaps' life, silence of sources, alerts. All use event time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reconcile(ticks: DataFrame, scores: dict[str, float], window_s: float = 0.25, disagreement: float = 0.005, strategy: str = "reliability") -> DataFrame:
    """After each priced event, which source is believed: event_id, chosen_source, n_sources, disagreement.

    Candidates are each source's last price within window_s; two at least. `reliability` takes the best
    score (then the name), `median` the price nearest the median (then the better score). Sources disagree
    if a price is further than `disagreement` of the mean (or median) from it.
    """
    sources = sorted(scores)
    along = Window.partitionBy("instrument_id").orderBy("exchange_timestamp", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    state = F.struct(F.col("exchange_timestamp").alias("ts"), F.col("price").alias("px"))
    rows = ticks.where("price is not null").withColumns({f"_s{i}": F.last(F.when(F.col("source") == s, state), ignorenulls=True).over(along) for i, s in enumerate(sources)})
    near = [F.when(F.col("exchange_timestamp") - F.col(f"_s{i}.ts") <= window_s, F.struct(F.col(f"_s{i}.px").alias("px"), F.lit(float(scores[s])).alias("score"), F.lit(s).alias("source"))) for i, s in enumerate(sources)]
    rows = rows.withColumn("_c", F.array_compact(F.array(*near))).where(F.size("_c") >= 2)
    if strategy == "median":
        ordered = F.array_sort(F.transform("_c", lambda c: c["px"]))
        n = F.size("_c")
        middle = (F.element_at(ordered, F.floor((n + 1) / 2).cast("int")) + F.element_at(ordered, F.floor(n / 2).cast("int") + 1)) / 2
        rows = rows.withColumn("_m", middle)
        best = F.array_min(F.transform("_c", lambda c: F.struct(F.abs(c["px"] - F.col("_m")).alias("d"), (-c["score"]).alias("s"), c["source"].alias("source"))))
    else:
        rows = rows.withColumn("_m", F.aggregate("_c", F.lit(0.0), lambda a, c: a + c["px"]) / F.size("_c"))
        best = F.array_min(F.transform("_c", lambda c: F.struct((-c["score"]).alias("s"), c["source"].alias("source"))))
    apart = F.exists("_c", lambda c: F.abs(c["px"] - F.col("_m")) > F.col("_m") * disagreement)
    return rows.select("event_id", "instrument_id", best["source"].alias("chosen_source"), F.size("_c").alias("n_sources"), ((F.col("_m") > 0) & apart).alias("disagreement"))


def gap_lifecycle(ticks: DataFrame, timeout_s: float = 2.0, most: int = 1000) -> DataFrame:
    """Every missing sequence number (of a jump, the first `most`): when it was missed, when it came, and its state.

    FILLED if it came within timeout_s, EXPIRED if it came later or the feed went on past that, else OPEN.
    """
    order = Window.partitionBy("source", "instrument_id").orderBy("receive_timestamp", "event_id")
    high = F.max("sequence_number").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = ticks.where("sequence_number is not null").withColumn("_high", high)
    last = rows.groupBy("source", "instrument_id").agg(F.max("receive_timestamp").alias("_end"))
    missed = rows.where(F.col("sequence_number") > F.col("_high") + 1).select("source", "instrument_id", F.col("receive_timestamp").alias("opened_ts"), F.explode(F.sequence(F.col("_high") + 1, F.least(F.col("sequence_number") - 1, F.col("_high") + most))).alias("missing_seq"))
    late = rows.where(F.col("sequence_number") < F.col("_high")).groupBy("source", "instrument_id", F.col("sequence_number").alias("missing_seq")).agg(F.min("receive_timestamp").alias("came_ts"))
    met = missed.join(late, ["source", "instrument_id", "missing_seq"], "left").join(last, ["source", "instrument_id"])
    state = F.when(F.col("came_ts") - F.col("opened_ts") < timeout_s, "FILLED").when(F.col("came_ts").isNotNull() | (F.col("_end") - F.col("opened_ts") >= timeout_s), "EXPIRED").otherwise("OPEN")
    return met.withColumn("state", state).drop("_end")


def silences(ticks: DataFrame, limit_s: float = 2.0) -> DataFrame:
    """Times in which a source was silent for longer than limit_s while it was expected."""
    order = Window.partitionBy("source").orderBy("exchange_timestamp", "event_id")
    rows = ticks.withColumn("_before", F.lag("exchange_timestamp").over(order))
    return rows.where(F.col("exchange_timestamp") - F.col("_before") > limit_s).select("source", F.col("_before").alias("silent_from"), F.col("exchange_timestamp").alias("silent_to"), (F.col("exchange_timestamp") - F.col("_before")).alias("seconds"))


def price_alerts(ticks: DataFrame, alerts: DataFrame, cooldown_s: float = 60.0, hysteresis: float = 0.001) -> DataFrame:
    """Alerts (alert_id, instrument_id, direction above or below, threshold, repeat) that go off: alert_id, event_id, price.

    An alert re-arms when the price has come back past the threshold by `hysteresis`; a repeating one also
    waits cooldown_s; one that doesn't repeat goes off once.
    """
    schema = "alert_id string, event_id string, price double, exchange_timestamp double"

    def fold(own: pd.DataFrame) -> pd.DataFrame:
        a = own.iloc[0]
        above, at = a["direction"] == "above", float(a["threshold"])
        armed, fired, out = True, None, []
        for e in own.sort_values(["exchange_timestamp", "event_id"], kind="stable").itertuples():
            if armed and (e.price >= at if above else e.price <= at):
                if fired is None or a["repeat"] and e.exchange_timestamp - fired >= cooldown_s:
                    out.append((a["alert_id"], e.event_id, e.price, e.exchange_timestamp))
                    fired, armed = e.exchange_timestamp, False
            elif not armed and (e.price < at * (1 - hysteresis) if above else e.price > at * (1 + hysteresis)):
                armed = True
        return pd.DataFrame(out, columns=["alert_id", "event_id", "price", "exchange_timestamp"])

    rows = ticks.where("price is not null").select("event_id", "instrument_id", "price", "exchange_timestamp").join(alerts, "instrument_id")
    return rows.groupBy("alert_id").applyInPandas(fold, schema)
