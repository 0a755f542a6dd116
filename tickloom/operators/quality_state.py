"""The quality rules that need state: sequences, duplicates, time order, the price corridor.

One pure fold, `Judge`, holds the state of one (source, instrument) and judges its events one by one. Batch
applies it per group in the order of receipt; streams keep it in the state store. Both give the same rows.
"""

from __future__ import annotations

import math
import pickle
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import mul

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.schema import SEVERITY


@dataclass(frozen=True)
class Config:
    """Limits of the rules. Fixed values that decide a result: window, samples, deviations, floors and bands."""

    stale_s: float = 0.05
    skew_s: float = 1.0
    window: int = 50
    min_samples: int = 20
    deviations: float = 6.0
    sigma_floor: float = 2e-4
    warm_up_samples: int = 3
    warm_up_ratio: float = 0.10
    reseed_after: int = 8
    reseed_band: float = 0.01
    cluster_band: float = 0.05
    jump_limit: int = 1 << 24
    seen_bits: int = 64
    stale_seen: int = 32
    unsequenced_held: int = 100_000
    venue_bands: tuple = (("XNSE", 0.10, "CIRCUIT_FILTER_BREACH"), ("XETR", 0.05, "VOLATILITY_INTERRUPTION"), ("XTKS", 0.08, "SPECIAL_QUOTE_INDICATION"), ("TSE", 0.08, "SPECIAL_QUOTE_INDICATION"))


def _there(x) -> bool:
    return x is not None and x == x


@dataclass
class Judge:
    """State of one source and instrument. judge() gives (status, reasons) and moves on."""

    config: Config = field(default_factory=Config)
    last: int | None = None
    seen: int = 0
    candidate: int | None = None
    regressions: int = 0
    late_seen: deque = field(default_factory=deque)
    last_ts: float | None = None
    prices: deque = field(default_factory=deque)
    outliers: int = 0
    last_outlier: float = 0.0
    unsequenced: dict = field(default_factory=dict)
    older: dict = field(default_factory=dict)

    def judge(self, e: dict) -> tuple[str, list[str]]:
        self.level, self.reasons = 0, []
        kind = e["event_type"]
        if kind not in ("TRADE", "QUOTE", "HALT", "STATUS"):
            self._mark("INVALID", "SCHEMA_VIOLATION")
            return self._out()
        bad = self._malformed(e, kind)
        if bad:
            self._mark("INVALID", "SCHEMA_VIOLATION")
        seq = e["sequence_number"]
        if _there(seq) and seq >= 0:
            if self._sequence(int(seq)):
                return self._out()
        elif math.isfinite(e["exchange_timestamp"]):
            self._unsequenced(e)
        self._times(e, kind)
        if not bad and _there(e["bid_price"]) and _there(e["ask_price"]) and e["bid_price"] > e["ask_price"]:
            self._mark("INVALID", "CROSSED_QUOTE")
        if self.level < 2 and _there(e["price"]) and math.isfinite(e["price"]):
            self._corridor(float(e["price"]), e.get("venue"))
        return self._out()

    def _out(self) -> tuple[str, list[str]]:
        return SEVERITY[self.level], self.reasons

    def _mark(self, status: str, reason: str) -> None:
        self.level = max(self.level, SEVERITY.index(status))
        if reason not in self.reasons:
            self.reasons.append(reason)

    @staticmethod
    def _malformed(e: dict, kind: str) -> bool:
        if kind == "TRADE" and not _there(e["price"]) or kind == "QUOTE" and not _there(e["bid_price"]) and not _there(e["ask_price"]):
            return True
        for c in ("price", "bid_price", "ask_price", "quantity", "bid_size", "ask_size"):
            x = e[c]
            if x is not None and x == x and not 0 <= x < math.inf:
                return True
        return not (math.isfinite(e["exchange_timestamp"]) and math.isfinite(e["receive_timestamp"]))

    def _sequence(self, seq: int) -> bool:
        """True if the event ends here: its verdict needs no other rule."""
        c = self.config
        if self.last is None:
            self.last, self.seen = seq, 1
            return False
        ahead = seq - self.last
        if ahead > c.jump_limit:
            self._mark("SUSPICIOUS", "SEQUENCE_GAP")
            if self.candidate is not None and 0 < seq - self.candidate <= c.jump_limit:
                self.last, self.seen, self.candidate = seq, 1, None
            else:
                self.candidate = seq
        elif ahead > 0:
            if ahead > 1:
                self._mark("SUSPICIOUS", "SEQUENCE_GAP")
            self.seen = (self.seen << ahead | 1) & ((1 << c.seen_bits) - 1) if ahead < c.seen_bits else 1
            self.last, self.candidate = seq, None
        elif -ahead < c.seen_bits:
            if self.seen >> -ahead & 1:
                self._mark("INVALID", "DUPLICATE")
                if ahead:
                    self._mark("INVALID", "OUT_OF_ORDER")
            else:
                self.seen |= 1 << -ahead
                self._mark("SUSPICIOUS", "OUT_OF_ORDER")
        else:
            return self._far_behind(seq, -ahead)
        return False

    def _far_behind(self, seq: int, behind: int) -> bool:
        c = self.config
        if seq in self.late_seen:
            self._mark("INVALID", "DUPLICATE")
            self._mark("INVALID", "OUT_OF_ORDER")
            return True
        self._mark("SUSPICIOUS", "OUT_OF_ORDER")
        if behind > c.jump_limit:
            self.regressions += 1
            if self.regressions >= 2:  # the sequence has begun anew
                self.last, self.seen, self.candidate, self.regressions = seq, 1, None, 0
                self.late_seen.clear()
                return True
        else:
            self.regressions = 0
        self.late_seen.append(seq)
        if len(self.late_seen) > c.stale_seen:
            self.late_seen.popleft()
        return False

    def _unsequenced(self, e: dict) -> None:
        key = tuple(e[c] if _there(e[c]) else None for c in ("event_type", "exchange_timestamp", "price", "quantity", "bid_price", "ask_price", "bid_size", "ask_size"))
        if key in self.unsequenced or key in self.older:
            self._mark("SUSPICIOUS", "DUPLICATE")
        if key not in self.unsequenced:
            self.unsequenced[key] = None
            if len(self.unsequenced) >= self.config.unsequenced_held:
                self.older, self.unsequenced = self.unsequenced, {}

    def _times(self, e: dict, kind: str) -> None:
        sent, got, c = e["exchange_timestamp"], e["receive_timestamp"], self.config
        if not (math.isfinite(sent) and math.isfinite(got)):
            return
        plausible = sent <= got + c.skew_s
        if not plausible:
            self._mark("SUSPICIOUS", "TS_IMPLAUSIBLE")
        if self.last_ts is not None and sent < self.last_ts:
            self._mark("SUSPICIOUS", "OUT_OF_ORDER")
        elif plausible:
            self.last_ts = sent
        if kind in ("TRADE", "QUOTE") and got - sent > c.stale_s:
            self._mark("SUSPICIOUS", "STALE")

    def _corridor(self, px: float, venue: str | None) -> None:
        c, n = self.config, len(self.prices)
        mean = sum(self.prices) / n if n else 0.0
        off, spread, odd = px - mean, 0.0, False
        if n >= c.warm_up_samples:
            floor = c.sigma_floor * abs(mean)
            square = sum(map(mul, self.prices, self.prices)) / n - mean * mean  # tells most rows apart already
            if n < c.min_samples or off * off > 0.5 * c.deviations**2 * max(square, floor * floor):
                spread = max(sum((x - mean) ** 2 for x in self.prices) / n, floor * floor)
            else:
                spread = max(square, floor * floor)
            odd = off * off > c.deviations**2 * spread if n >= c.min_samples else abs(mean) > 0 and abs(off) > c.warm_up_ratio * abs(mean)
        if not odd:
            self.outliers = 0
            self._fold(px)
            return
        self._mark("SUSPICIOUS", "PRICE_ANOMALY")
        for name, ratio, reason in c.venue_bands:
            if venue == name and mean > 0 and abs(off) / mean >= ratio:
                self._mark("SUSPICIOUS", reason)
        near = max(c.deviations * math.sqrt(spread), c.reseed_band * abs(px), c.cluster_band * abs(px))
        self.outliers = self.outliers + 1 if self.outliers and abs(px - self.last_outlier) <= near else 1
        self.last_outlier = px
        if c.reseed_after and self.outliers >= c.reseed_after:  # the price has moved for good
            self.prices.clear()
            self.outliers = 0
            self._fold(px)

    def _fold(self, px: float) -> None:
        self.prices.append(px)
        if len(self.prices) > self.config.window:
            self.prices.popleft()


COLUMNS = ["event_id", "source", "instrument_id", "event_type", "exchange_timestamp", "receive_timestamp", "sequence_number", "price", "quantity", "bid_price", "bid_size", "ask_price", "ask_size"]
SCHEMA = "event_id string, source string, instrument_id string, quality_status string, reasons array<string>"


def _own_columns(ticks: DataFrame) -> DataFrame:
    """What the rules read; `venue`, which has price bands of its own, where the ticks have it."""
    return ticks.select(*COLUMNS, *(c for c in ("venue",) if c in ticks.columns))


def _judged(judge: Judge, own: pd.DataFrame) -> pd.DataFrame:
    names = list(own.columns)
    found = [(e["event_id"], e["source"], e["instrument_id"], *judge.judge(e)) for e in (dict(zip(names, row)) for row in zip(*(own[c].tolist() for c in names)))]
    return pd.DataFrame(found, columns=["event_id", "source", "instrument_id", "quality_status", "reasons"])


def judge_batch(ticks: DataFrame, config: Config = Config()) -> DataFrame:
    """Verdicts of all rules for every tick; each source and instrument in order of receipt."""

    def fold(own: pd.DataFrame) -> pd.DataFrame:
        return _judged(Judge(config), own.sort_values(["receive_timestamp", "event_id"], kind="stable"))

    return _own_columns(ticks).groupBy("source", "instrument_id").applyInPandas(fold, SCHEMA)


def judge_stream(ticks: DataFrame, config: Config = Config()) -> DataFrame:
    """The same for a stream: state lives in the state store, rows of a micro-batch are taken in order of receipt."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        judge = pickle.loads(state.get[0]) if state.exists else Judge(config)
        own = pd.concat(list(parts), ignore_index=True)
        out = _judged(judge, own.sort_values(["receive_timestamp", "event_id"], kind="stable"))
        state.update((pickle.dumps(judge),))
        yield out

    return _own_columns(ticks).groupBy("source", "instrument_id").applyInPandasWithState(fold, SCHEMA, "judge binary", "append", GroupStateTimeout.NoTimeout)
