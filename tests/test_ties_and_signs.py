"""Quotes at one time, markouts without frames that end with the partition, prices of zero."""

from tickloom.operators import joins, risk
from tickloom.sources import wire

ORDER = "order_id string, ts double, side string, order_type string, quantity double, price double, mid double, quote_ts double, order_key string, position double, reference double"


def test_quotes_at_one_time_see_each_other(spark):
    names = "event_id string, instrument_id string, source string, sequence_number long, exchange_timestamp double, bid_price double, bid_size double, ask_price double, ask_size double"
    rows = [("e2", "I", "A", 2, 5.0, 10.0, 1.0, 12.0, 1.0), ("e10", "I", "B", 10, 5.0, 11.0, 1.0, 13.0, 1.0), ("e9", "I", "B", 9, 5.0, 9.0, 1.0, 11.5, 1.0)]
    found = joins.consolidated_bbo(spark.createDataFrame(rows, names), ["A", "B"], 2.0).collect()
    assert {(r["best_bid"], r["bid_source"], r["best_ask"], r["ask_source"]) for r in found} == {(11.0, "B", 12.0, "A")} and len(found) == 3


def test_later_values_take_no_frame_to_the_end(spark, capsys):
    fills = spark.createDataFrame([("a", "I", 0.0), ("b", "I", 1.0), ("c", "I", 9.0)], "event_id string, instrument_id string, exchange_timestamp double")
    mids = spark.createDataFrame([("I", 2.0, 5.0), ("I", 3.0, None), ("I", 3.0, 7.0)], "instrument_id string, exchange_timestamp double, mid double")
    rows = joins.as_of_forward(fills, mids, "mid", 2.0)
    assert {r["event_id"]: r["later"] for r in rows.collect()} == {"a": 5.0, "b": 7.0, "c": 7.0}
    rows.explain()
    assert "unboundedfollowing" not in capsys.readouterr().out.lower()


def test_gateway_takes_prices_of_any_sign_where_asked(spark):
    raw = spark.createDataFrame([("S", f'{{"instrument": "I", "event_type": "trade", {p} "quantity": 1}}', 1.0, n) for n, p in (("zero", '"price": 0.0,'), ("less", '"price": -1,'), ("none", ""))], "source string, payload string, receive_timestamp double, raw_id string")
    good, bad = wire.normalise(raw, any_sign=True)
    assert {r["event_id"] for r in good.collect()} == {"zero", "less"} and {r["raw_id"] for r in bad.collect()} == {"none"}
    assert wire.normalise(raw)[0].count() == 0


def test_gates_take_prices_of_zero_where_asked(spark):
    orders = spark.createDataFrame([("o", 0.0, "BUY", "LIMIT", 90.0, 0.0, 100.0, None, None, 0.0, 100.0)], ORDER)
    first = lambda rows: rows.collect()[0]["rejected_by"]
    assert first(risk.pre_trade(orders, {}, any_sign=True)) is None and first(risk.pre_trade(orders, {})) == "BAD_PRICE"
    limits = {"max_order_notional": 5000}
    assert first(risk.validate(orders, risk.OrderLimits(**limits, zero_is_price=True))) is None and first(risk.validate(orders, risk.OrderLimits(**limits))) == "MAX_NOTIONAL"
