"""The quality rules that need no state, severities, quarantine, and the registry of users' rules.

A rule adds its reason once and may only raise the status. Rules with state are in quality_state.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.schema import SEVERITY

#: Bits of the reasons' mask.
BITS = {
    "SCHEMA_VIOLATION": 0, "DUPLICATE": 1, "SEQUENCE_GAP": 2, "OUT_OF_ORDER": 3, "STALE": 4, "PRICE_ANOMALY": 5, "CROSSED_QUOTE": 6,
    "CROSS_FEED_DISAGREEMENT": 7, "MALFORMED": 8, "CIRCUIT_FILTER_BREACH": 9, "VOLATILITY_INTERRUPTION": 10, "SPECIAL_QUOTE_INDICATION": 11,
    "TS_IMPLAUSIBLE": 12, "RATE_LIMITED": 13, "SECURITY_REJECT": 14,
}


@dataclass(frozen=True)
class Limits:
    """stale_s: receive time after exchange time; skew_s: exchange time after receive time; negative: whether prices may be below zero."""

    stale_s: float = 0.05
    skew_s: float = 1.0
    negative: bool = False


@dataclass(frozen=True)
class Rule:
    name: str
    status: str
    when: Column


def _bad(column: str, negative: bool) -> Column:
    c = F.col(column)
    wrong = F.isnan(c) | c.isin(float("inf"), float("-inf"))
    return F.coalesce(wrong if negative else wrong | (c < 0), F.lit(False))


def schema_violation(limits: Limits = Limits()) -> Column:
    """An unknown type, a trade without price, a quote without sides, numbers that aren't finite or are negative."""
    kind = F.col("event_type")
    known = kind.isin("TRADE", "QUOTE", "HALT", "STATUS")
    missing = ((kind == "TRADE") & F.col("price").isNull()) | ((kind == "QUOTE") & F.col("bid_price").isNull() & F.col("ask_price").isNull())
    numbers = [_bad(c, limits.negative) for c in ("price", "bid_price", "ask_price")] + [_bad(c, False) for c in ("quantity", "bid_size", "ask_size")] + [_bad(c, True) for c in ("exchange_timestamp", "receive_timestamp")]
    out = ~F.coalesce(known, F.lit(False)) | F.coalesce(missing, F.lit(False))
    for n in numbers:
        out = out | n
    return out


def stateless_rules(limits: Limits = Limits()) -> list[Rule]:
    status_event = F.col("event_type").isin("HALT", "STATUS")
    bad = schema_violation(limits)
    late = F.col("receive_timestamp") - F.col("exchange_timestamp")
    return [
        Rule("SCHEMA_VIOLATION", "INVALID", bad),
        Rule("TS_IMPLAUSIBLE", "SUSPICIOUS", F.col("exchange_timestamp") > F.col("receive_timestamp") + F.lit(limits.skew_s)),
        Rule("STALE", "SUSPICIOUS", ~status_event & (late > F.lit(limits.stale_s))),
        Rule("CROSSED_QUOTE", "INVALID", ~bad & (F.col("bid_price") > F.col("ask_price"))),
    ]


_USER: dict[int, tuple[Rule, str]] = {}


def register(bit: int, name: str, status: str = "SUSPICIOUS", description: str = "") -> Callable[[Callable[[], Column]], Callable[[], Column]]:
    """Decorator: a function that returns the rule's condition becomes the user rule of this bit (32 to 63)."""
    if not 32 <= bit <= 63:
        raise ValueError("user rules have the bits 32 to 63")
    if status not in SEVERITY:
        raise ValueError(f"unknown status {status}")

    def keep(f: Callable[[], Column]) -> Callable[[], Column]:
        if bit in _USER:
            raise ValueError(f"bit {bit} is taken")
        _USER[bit] = (Rule(name, status, f()), description)
        return f

    return keep


def unregister(bit: int) -> None:
    _USER.pop(bit, None)


def user_rules() -> list[Rule]:
    return [rule for _, (rule, _) in sorted(_USER.items())]


def apply_rules(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add quality_status, reasons and reason_mask; the status is the severest of the rules that hold.

    Conditions are computed once, in a projection of their own, and all is built of functions that compile.
    """
    flags = [(f"_rule{i}", r) for i, r in enumerate(rules)]
    rows = rows.withColumns({name: F.coalesce(r.when, F.lit(False)) for name, r in flags})
    bits = {**BITS, **{rule.name: bit for bit, (rule, _) in _USER.items()}}
    any_of = lambda status: functools.reduce(lambda a, b: a | b, (F.col(n) for n, r in flags if r.status == status), F.lit(False))
    names = F.concat_ws(",", *(F.when(F.col(n), F.lit(r.name)) for n, r in flags))
    none = F.array().cast("array<string>")
    return rows.withColumns({
        "reasons": F.when(functools.reduce(lambda a, b: a | b, (F.col(n) for n, _ in flags), F.lit(False)), F.split(names, ",")).otherwise(none),
        "quality_status": F.when(any_of("INVALID"), "INVALID").when(any_of("SUSPICIOUS"), "SUSPICIOUS").otherwise("VALID"),
        "reason_mask": functools.reduce(lambda a, b: a + b, (F.when(F.col(n), F.lit(1 << bits[r.name]).cast("long")).otherwise(F.lit(0).cast("long")) for n, r in flags), F.lit(0).cast("long")),
    }).drop(*(n for n, _ in flags))


def judge(ticks: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The stateless rules, then users' rules."""
    return apply_rules(ticks, stateless_rules(limits) + user_rules())


def split(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Canonical rows (not INVALID) and quarantined rows (not VALID): suspicious rows are in both."""
    return judged.where("quality_status <> 'INVALID'"), judged.where("quality_status <> 'VALID'")


def severer(a: Column, b: Column) -> Column:
    """The severer of two statuses."""
    rank = lambda c: F.array_position(F.array(*map(F.lit, SEVERITY)), c)
    return F.when(rank(a) >= rank(b), a).otherwise(b)
