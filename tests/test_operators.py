"""Hand-computed cases of the operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tickloom.functions import finance
from tickloom.operators import aggregates as A
from tickloom.operators import audit, backtest, book, feeds, flow, joins, quality_state, recurrences, risk, rules, tca, vessels
from tickloom.operators import windows as W
from tickloom.schema import TICK
from tickloom.sources import history, simulator, wire

NONE = dict.fromkeys(f.name for f in TICK)


def tick(i, kind="TRADE", ts=0.0, **more):
    return NONE | {"event_id": f"e{i:04d}", "instrument_id": "AAPL", "event_type": kind, "exchange_timestamp": float(ts), "receive_timestamp": ts + 0.0001, "processing_timestamp": ts + 0.0006, "source": "FEEDX", "sequence_number": i, "quality_status": "VALID", "reasons": []} | more


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[f.name] for f in TICK) for r in rows], TICK)


def test_ohlcv_of_two_buckets(spark):
    prices = [(1000, 150, 100), (1001, 155, 50), (1002, 145, 50), (1003, 152, 100), (1006, 153, 200)]
    rows = frame(spark, [tick(i, ts=t, price=float(p), quantity=float(q)) for i, (t, p, q) in enumerate(prices)])
    found = [tuple(r)[1:] for r in A.ohlcv(rows, "AAPL", 5.0).orderBy("bucket").collect()]
    assert found == [(1000.0, 150.0, 155.0, 145.0, 152.0, 300.0, 4), (1005.0, 153.0, 153.0, 153.0, 153.0, 200.0, 1)]
    assert A.ohlcv(rows, "AAPL", 5.0, limit=1).collect()[0]["bucket"] == 1005.0


def test_vwap_and_its_empty_row(spark):
    rows = frame(spark, [tick(0, price=100.0, quantity=100.0), tick(1, price=103.0, quantity=200.0)])
    assert tuple(A.vwap(rows, "AAPL").first()) == (102.0, 30600.0, 300.0, 100.0, 103.0, 2)
    assert tuple(A.vwap(rows, "MSFT").first()) == (0.0, 0.0, 0.0, 0.0, 0.0, 0)


def test_volume_profile_keeps_all_volume(spark):
    rows = frame(spark, [tick(0, price=100.0, quantity=500.0), tick(1, price=110.0, quantity=300.0), tick(2, price=120.0, quantity=200.0)])
    found = A.volume_profile(rows, 3).collect()
    assert sum(r["volume"] for r in found) == 1000.0 and {r["bin"] for r in found} == {0, 1, 3}


def test_last_as_of(spark):
    rows = frame(spark, [tick(i, ts=t, price=1.0) for i, t in enumerate((1000, 1005, 1010))])
    at = lambda t: [r["event_id"] for r in joins.last_as_of(rows, t).collect()]
    assert at(1006.0) == ["e0001"] and at(999.0) == [] and at(1010.0) == ["e0002"]


def test_bars_and_bar_as_of(spark):
    rows = frame(spark, [tick(i, ts=10 + i, price=100.0 + i, quantity=10.0) for i in range(10)])
    bar = A.bars(rows, {"1m": 60.0}).first()
    assert (bar["open"], bar["high"], bar["low"], bar["close"], bar["volume"], bar["trade_count"]) == (100.0, 109.0, 100.0, 109.0, 100.0, 10)
    bars = A.bars(frame(spark, [tick(i, ts=t, price=1.0, quantity=1.0) for i, t in enumerate((10, 70, 130, 190))]), {"1m": 60.0}).withColumn("interval_s", F.lit(60.0))
    at = lambda t, done=True: [r["bucket_start"] for r in joins.bar_as_of(bars, t, done).collect()]
    assert at(120.0) == [60.0] and at(100.0) == [0.0] and at(100.0, False) == [60.0] and at(60.0) == [0.0] and at(30.0) == []


def test_bars_merge(spark):
    one = A.bars(frame(spark, [tick(0, ts=1, price=10.0, quantity=1.0)]), {"1m": 60.0})
    two = A.bars(frame(spark, [tick(1, ts=2, price=20.0, quantity=3.0)]), {"1m": 60.0})
    r = A.merge_bars(one, two).first()
    assert (r["open"], r["close"], r["high"], r["low"], r["volume"], r["trade_count"], r["vwap"]) == (10.0, 20.0, 20.0, 10.0, 4.0, 2, 17.5)


def test_price_improvement(spark):
    e = spark.createDataFrame([("t1", "BUY", 150.02, 500.0, "B", 150.0, 149.95, 150.05)], "trade_id string, side string, price double, shares double, broker string, arrival_price double, bid double, ask double")
    r = tca.evaluate(e).first()
    assert r["price_improvement_cents"] == 0.03 and r["price_improvement_usd"] == 15.0 and r["is_price_improved"]
    assert tca.batch(tca.evaluate(e)).first()["total_trades"] == 1
    assert tca.batch(tca.evaluate(e.limit(0))).first()["total_trades"] == 0


def test_stateless_rules_and_split(spark):
    rows = frame(spark, [tick(0, "QUOTE", bid_price=2.0, ask_price=1.0), tick(1, "TRADE"), tick(2, price=1.0, receive_timestamp=0.5), tick(3, price=1.0, ts=10, receive_timestamp=1.0), tick(4, "BAD"), tick(5, price=float("nan")), tick(6, "QUOTE", bid_price=1.0, ask_price=1.0)])
    found = {r["event_id"]: (r["quality_status"], r["reasons"], r["reason_mask"]) for r in rules.judge(rows).collect()}
    assert found["e0000"] == ("INVALID", ["CROSSED_QUOTE"], 64) and found["e0001"] == ("INVALID", ["SCHEMA_VIOLATION"], 1)
    assert found["e0002"][:2] == ("SUSPICIOUS", ["STALE"]) and found["e0003"][:2] == ("SUSPICIOUS", ["TS_IMPLAUSIBLE"])
    assert found["e0004"][0] == found["e0005"][0] == "INVALID" and found["e0006"] == ("VALID", [], 0)
    kept, held = rules.split(rules.judge(rows))
    assert kept.count() == 3 and held.count() == 6


def test_user_rules(spark):
    @rules.register(40, "BIG", "SUSPICIOUS")
    def big():
        return F.col("quantity") > 100

    try:
        r = rules.judge(frame(spark, [tick(0, price=1.0, quantity=200.0)])).first()
        assert r["reasons"] == ["BIG"] and r["reason_mask"] == 1 << 40
        with pytest.raises(ValueError):
            rules.register(40, "AGAIN")(big)
    finally:
        rules.unregister(40)


def judged(events):
    judge = quality_state.Judge()
    return [judge.judge(e) for e in events]


def test_sequence_machine():
    seq = lambda *n: [r for _, r in judged([tick(s, price=100.0, ts=i) for i, s in enumerate(n)])]
    assert seq(1, 2, 3) == [[], [], []]
    assert seq(1, 5) == [[], ["SEQUENCE_GAP"]]
    assert seq(1, 2, 2) == [[], [], ["DUPLICATE"]]
    assert seq(1, 5, 3, 3)[2:] == [["OUT_OF_ORDER"], ["DUPLICATE", "OUT_OF_ORDER"]]
    assert seq(1, 200, 100, 100)[2:] == [["OUT_OF_ORDER"], ["DUPLICATE", "OUT_OF_ORDER"]]


def test_price_corridor_and_reseed():
    events = [tick(i, price=100.0 + (i % 3) * 0.01, ts=i) for i in range(30)] + [tick(30 + i, price=150.0, ts=30 + i) for i in range(10)]
    found = [r for _, r in judged(events)]
    assert not any(found[:30]) and all(r == ["PRICE_ANOMALY"] for r in found[30:38]) and found[38] == []


def test_batch_judge_equals_fold(spark):
    sim = simulator.simulate(spark, 3000)
    wanted = {}
    judges = {}
    for r in sorted((r.asDict() for r in sim.collect()), key=lambda r: (r["receive_timestamp"], r["event_id"])):
        wanted[r["event_id"]] = judges.setdefault((r["source"], r["instrument_id"]), quality_state.Judge()).judge(r)
    found = {r["event_id"]: (r["quality_status"], r["reasons"]) for r in quality_state.judge_batch(sim).collect()}
    assert found == wanted and any(s == "INVALID" for s, _ in found.values())


def test_lee_ready(spark):
    trades = frame(spark, [tick(i, ts=10 + i, price=p, quantity=1.0) for i, p in enumerate((10.0, 10.0, 9.9, 9.9, 10.2))])
    quotes = frame(spark, [tick(100, "QUOTE", ts=13.5, bid_price=10.0, ask_price=10.2)])
    found = flow.classify(trades, quotes).orderBy("event_id").collect()
    assert [r["side"] for r in found] == ["BUY", "BUY", "SELL", "SELL", "BUY"]
    assert [r["cvd"] for r in flow.cumulative_delta(flow.classify(trades, quotes)).orderBy("event_id").collect()] == [1.0, 2.0, 1.0, 0.0, 1.0]


def test_as_of_forward_falls_back(spark):
    fills = frame(spark, [tick(0, ts=1, price=10.0), tick(1, ts=50, price=10.0)])
    mids = spark.createDataFrame([("AAPL", 5.0, 11.0), ("AAPL", 8.0, 12.0)], "instrument_id string, exchange_timestamp double, mid double")
    assert [r["later"] for r in joins.as_of_forward(fills, mids, "mid", 5.0).orderBy("event_id").collect()] == [12.0, 12.0]


def test_best_bid_offer_ttl(spark):
    q = lambda i, s, ts, b, a: tick(i, "QUOTE", source=s, ts=ts, bid_price=b, bid_size=1.0, ask_price=a, ask_size=1.0)
    rows = frame(spark, [q(0, "A", 0, 10.0, 11.0), q(1, "B", 1, 10.5, 11.5), q(2, "B", 3, 10.4, 11.4)])
    found = [(r["best_bid"], r["bid_source"], r["best_ask"], r["ask_source"]) for r in joins.consolidated_bbo(rows, ["A", "B"], 2.0).orderBy("event_id").collect()]
    assert found == [(10.0, "A", 11.0, "A"), (10.5, "B", 11.0, "A"), (10.4, "B", 11.4, "B")]


def test_indicators_against_plain_python():
    r = random.Random(5)
    x = [100 + r.random() for _ in range(60)]
    import numpy as np

    a = np.array(x)
    assert math.isclose(recurrences.ema(a, 12)[11], sum(x[:12]) / 12)
    assert math.isnan(recurrences.rsi(a)[13]) and 0 <= recurrences.rsi(a)[14] <= 100
    assert recurrences.rsi(np.arange(20.0))[-1] == 100
    line, signal, hist = recurrences.macd(a)
    assert math.isnan(line[24]) and not math.isnan(line[25]) and math.isclose(hist[-1], line[-1] - signal[-1])
    assert math.isclose(recurrences.atr(a + 1, a - 1, a, 14)[13], np.maximum(2.0, np.maximum(np.abs(a[1:14] + 1 - a[:13]), np.abs(a[1:14] - 1 - a[:13]))).sum() / 14 + 2 / 14)


def test_windows(spark):
    bars = spark.createDataFrame([("I", float(i), float(c), 10.0) for i, c in enumerate((1, 2, 2, 1))], "instrument_id string, bucket double, close double, volume double")
    assert [r["sma"] for r in W.sma(bars, 2).orderBy("bucket").collect()] == [None, 1.5, 2.0, 1.5]
    assert [r["obv"] for r in W.obv(bars).orderBy("bucket").collect()] == [10.0, 20.0, 20.0, 10.0]
    assert [r["drawdown_pct"] for r in W.drawdown(bars).orderBy("bucket").collect()] == [0.0, 0.0, 0.0, 50.0]


def test_book_walk(spark):
    rows = spark.createDataFrame([("I", "ask", 10.0, 5.0, "A"), ("I", "ask", 10.0, 5.0, "B"), ("I", "ask", 11.0, 10.0, "A"), ("I", "bid", 9.0, 1.0, "A")], "instrument_id string, side string, price double, size double, venue string")
    levels = book.levels(rows)
    r = book.walk(levels, "BUY", 15).first()
    assert (r["filled"], round(r["vwap"], 6), r["fully_filled"]) == (15.0, round((100 + 55) / 15, 6), True)
    assert not book.walk(levels, "SELL", 5).first()["fully_filled"]
    assert levels.where("side = 'ask' and level = 1").first()["venue_sizes"] == {"A": 5.0, "B": 5.0}


def test_resting_orders(spark):
    nan = float("nan")
    m = [("I", "add", "a", "bid", 10.0, 5.0, "V", 0), ("I", "add", "b", "bid", 10.0, 5.0, "V", 1), ("I", "execute", "a", "bid", nan, 2.0, "V", 2), ("I", "modify", "b", "bid", nan, 9.0, "V", 3), ("I", "cancel", "x", "bid", nan, nan, "V", 4), ("I", "add", "c", "bid", 9.0, 1.0, "V", 5), ("I", "cancel", "c", "bid", nan, nan, "V", 6)]
    rows = spark.createDataFrame(m, "instrument_id string, op string, order_id string, side string, price double, size double, venue string, ordinal long")
    found = {r["order_id"]: (r["size"], r["priority"]) for r in book.resting_orders(rows).collect()}
    assert found == {"a": (3.0, 0), "b": (9.0, 3)}
    line = {r["order_id"]: r["size_ahead"] for r in book.queue_positions(book.resting_orders(rows)).collect()}
    assert line == {"a": 0.0, "b": 3.0}


def test_rebuilt_book(spark):
    m = [("S", 1, 1, "snapshot", "bid", "10.0", "5"), ("S", 1, 1, "snapshot", "ask", "11.0", "5"), ("S", 2, 2, "update", "bid", "10.5", "1"), ("S", 3, 3, "update", "bid", "10.5", "0"), ("S", 4, 4, "snapshot", "ask", "12", "1")]
    rows = spark.createDataFrame(m, "symbol string, received_time long, message long, event_type string, side string, price string, quantity string")
    found = [(r["bid_price"], r["ask_price"]) for r in book.rebuilt_quotes(rows).orderBy("received_time").collect()]
    assert found == [(10.0, 11.0), (10.5, 11.0), (10.0, 11.0), (None, 12.0)]


def test_options(spark):
    rows = spark.createDataFrame([(100.0, 100.0, 1.0, 0.05, 0.2, "CALL"), (100.0, 100.0, 1.0, 0.05, 0.2, "PUT"), (110.0, 100.0, 0.0, 0.05, 0.2, "CALL")], "spot double, strike double, years double, rate double, vol double, option_type string")
    found = finance.option_values(rows).collect()
    assert round(found[0]["price"], 4) == 10.4506 and round(found[1]["price"], 4) == 5.5735 and found[2]["price"] == 10.0
    assert round(found[0]["delta"], 4) == 0.6368 and found[2]["delta"] is None
    iv = finance.implied_volatility(finance.option_values(rows.limit(2)).withColumnRenamed("price", "market_price")).collect()
    assert all(abs(r["iv"] - 0.2) < 1e-6 for r in iv)
    assert abs(finance.binomial_price(100, 100, 1, 0.05, 0.2, True, False, 500) - 10.4506) < 0.01
    assert finance.binomial_price(100, 100, 1, 0.05, 0.2, False) > 5.5735


def test_sharpe_statistics():
    assert abs(finance.probabilistic_sharpe(0.0) - 0.5) < 1e-12
    assert finance.deflated_sharpe(1.0, 10, 100) < finance.probabilistic_sharpe(1.0, 0.0, 100)


def test_merkle_and_chain(spark):
    leaves = [audit.leaf(str(i).encode()) for i in range(7)]
    root = audit.root_rfc6962(leaves)
    assert all(audit.proves(leaves[i], audit.inclusion_proof(leaves, i), root) for i in range(7))
    assert not audit.proves(leaves[0], audit.inclusion_proof(leaves, 1), root)
    rows = spark.createDataFrame([(i, str(i)) for i in range(7)], "seq long, data string")
    assert audit.merkle_levels(rows).first()["root"] == audit.root_pairwise(leaves).hex()
    entries = spark.createDataFrame([("c", i, float(i), "a", "r", "x", f"d{i}") for i in range(4)], "chain string, seq long, timestamp double, actor string, role string, action string, details string")
    chain = audit.append_chain(entries)
    assert audit.verify_chain(chain).where("fault is not null").count() == 0
    broken = chain.withColumn("details", F.when(F.col("seq") == 2, "changed").otherwise(F.col("details")))
    assert [(r["seq"], r["fault"]) for r in audit.verify_chain(broken).where("fault is not null").collect()] == [(2, "TAMPERED")]


def test_risk(spark):
    rows = spark.createDataFrame([("I", x / 100) for x in range(-10, 10)], "instrument_id string, ret double")
    r = risk.historical(rows).first()
    assert abs(r["var"] - 0.09) < 1e-12 and abs(r["shortfall"] - 0.095) < 1e-12
    assert risk.monte_carlo(rows).first()["var"] == risk.monte_carlo(rows).first()["var"] > 0


def test_vessels(spark):
    rows = spark.createDataFrame([(1, 26.5, 56.3, 10.0), (2, 0.0, 0.0, 5.0)], "imo long, latitude double, longitude double, dwt double")
    found = {r["imo"]: (r["chokepoint"], r["inside"]) for r in vessels.nearest(rows).collect()}
    assert found[1] == ("HORMUZ", True) and not found[2][1]
    assert vessels.traffic(rows).count() == len(vessels.CHOKEPOINTS)


def test_positions():
    p = backtest.Position()
    p.fill("BUY", 10, 100.0)
    p.fill("BUY", 10, 110.0)
    assert p.cost == 105.0
    p.fill("SELL", 30, 120.0)
    assert (p.quantity, p.cost, p.realized) == (-10, 120.0, 300.0)


def test_wire_formats(spark):
    message = wire.fix_encode([(8, "FIX.4.4"), (35, "D"), (55, "AAPL"), (44, "1.5")])
    bad = message.replace("AAPL", "AAPM")
    rows = spark.createDataFrame([(message,), (bad,)], "m string").select(wire.fix_fields(F.col("m")).alias("f"), wire.fix_valid(F.col("m")).alias("ok")).collect()
    assert rows[0]["f"]["55"] == "AAPL" and [r["ok"] for r in rows] == [True, False]
    import struct

    add = b"A" + struct.pack(">HH6sQcI8sI", 1, 2, (5).to_bytes(6, "big"), 77, b"B", 100, b"AAPL    ", 1_500_000)
    raw = len(add).to_bytes(2, "big") + add + b"\0\x02Zz"
    r = wire.decode_itch(spark.createDataFrame([(bytearray(raw),)], "raw binary")).collect()
    assert len(r) == 1 and (r[0]["order_id"], r[0]["side"], r[0]["price"], r[0]["symbol"]) == (77, "bid", 150.0, "AAPL")
    pcap = b"\xd4\xc3\xb2\xa1" + bytes(20) + struct.pack("<IIII", 10, 500_000, 4, 4) + b"abcd"
    assert [(p["ts"], p["payload"]) for p in wire.pcap_packets(pcap)] == [(10.5, b"abcd")]
    log = wire.log_frame(0, 1.0, b"x") + wire.log_frame(1, 2.0, b"y")
    assert [f["valid"] for f in wire.log_frames(log)] == [True, True]
    assert [f["valid"] for f in wire.log_frames(log[:-1] + b"z")] == [True, False]
    assert len(list(wire.log_frames(log[:-3] + b""))) == 1


def test_history(spark, tmp_path):
    rows = frame(spark, [tick(i, ts=1_700_000_000 + i * 40_000, price=1.0, quantity=1.0, instrument_id="BTC/USD" if i % 2 else "AAPL") for i in range(10)])
    history.write_history(rows, str(tmp_path / "h"))
    assert history.scan_history(spark, str(tmp_path / "h"), "BTC-USD").count() == 5
    assert history.scan_history(spark, str(tmp_path / "h"), None, 1_700_040_000.0, 1_700_120_000.0).count() == 3
    for fmt in ("parquet", "json", "csv"):
        history.export(rows, str(tmp_path / fmt), fmt, "AAPL")
        assert spark.read.format(fmt).option("header", True).load(str(tmp_path / fmt)).count() == 5


def test_reconcile_and_gaps(spark):
    rows = frame(spark, [tick(0, source="A", ts=0, price=100.0), tick(1, source="B", ts=0.1, price=102.0), tick(2, source="A", ts=5, price=100.0)])
    r = feeds.reconcile(rows, {"A": 0.5, "B": 0.9}).collect()
    assert [(x["event_id"], x["chosen_source"], x["disagreement"]) for x in r] == [("e0001", "B", True)]
    rows = frame(spark, [tick(s, ts=t) for s, t in ((1, 0), (4, 1), (2, 2))] + [tick(9, ts=20)])
    found = {x["missing_seq"]: x["state"] for x in feeds.gap_lifecycle(rows).collect()}
    assert found[2] == "FILLED" and found[3] == "EXPIRED" and found[8] == "OPEN"


def test_venue_bands_through_the_operators(spark):
    """A jump beyond a venue's band is named after it where ticks have a venue, in batch; without the column it is only an anomaly."""
    from tickloom.operators import quality_state

    rows = [(f"e{i:03}", "S0", "A", "TRADE", float(i), float(i), i, 100.0 + 0.01 * (i % 5) if i < 200 else 115.0, 1.0, None, None, None, None, v) for v in ("XNSE",) for i in range(201)]
    names = "event_id string, source string, instrument_id string, event_type string, exchange_timestamp double, receive_timestamp double, sequence_number long, price double, quantity double, bid_price double, bid_size double, ask_price double, ask_size double, venue string"
    ticks = spark.createDataFrame(rows, names)
    last = lambda t: next(r["reasons"] for r in quality_state.judge_batch(t).collect() if r["event_id"] == "e200")
    assert set(last(ticks)) == {"PRICE_ANOMALY", "CIRCUIT_FILTER_BREACH"}
    assert set(last(ticks.drop("venue"))) == {"PRICE_ANOMALY"}


def test_bars_of_equal_times(spark):
    from tickloom.operators import aggregates

    rows = [(f"e{9 - i}", "A", "TRADE", 5.0, i, 100.0 + i, 1.0) for i in range(6)] + [("q", "A", "QUOTE", 1.0, 0, 7.0, 1.0)]
    ticks = spark.createDataFrame(rows, "event_id string, instrument_id string, event_type string, exchange_timestamp double, sequence_number long, price double, quantity double")
    bar = aggregates.ohlcv(ticks, interval=5.0).collect()
    assert [(b["open"], b["close"], b["low"], b["trade_count"]) for b in bar] == [(100.0, 105.0, 100.0, 6)]


def test_places_of_values(spark):
    from tickloom.operators import aggregates

    values = [3.0, 1.0, 1.0, None, 2.0, 3.0, 3.0]
    found = aggregates.with_places(spark.createDataFrame([(v,) for v in values], "v double"), "v").collect()
    assert sorted((r["v"], r["times"], r["upto"], r["total"]) for r in found) == [(1.0, 2, 2, 6), (2.0, 1, 3, 6), (3.0, 3, 6, 6)]
    assert aggregates.with_places(spark.createDataFrame([], "v double"), "v").count() == 0


def test_repeated_orders_are_told_by_the_last_that_passed(spark):
    """Of orders with one key at 0, 4, 6 and 10 seconds, with a window of 5: the second and the fourth repeat one that passed."""
    from tickloom.operators import risk

    names = "order_id string, ts double, side string, order_type string, quantity double, price double, mid double, quote_ts double, order_key string, position double"
    rows = [(f"o{t}", float(t), "BUY", "LIMIT", 1.0, 10.0, 10.0, None, "k", 0.0) for t in (0, 4, 6, 10)] + [("bad", 5.0, "BUY", "LIMIT", 0.0, 10.0, 10.0, None, "k", 0.0), ("free", 5.0, "SELL", "MARKET", 1.0, None, None, 1.0, None, 0.0)]
    orders = spark.createDataFrame(rows, names)
    found = {r["order_id"]: r["rejected_by"] for r in risk.validate(orders, risk.OrderLimits(idempotency_window_s=5.0)).collect()}
    assert found == {"o0": None, "o4": "DUPLICATE_ORDER", "o6": None, "o10": "DUPLICATE_ORDER", "bad": "INVALID_QUANTITY", "free": None}
    found = {r["order_id"]: r["rejected_by"] for r in risk.validate(orders, risk.OrderLimits(allow_short=False, max_quote_age_s=3.0)).collect()}
    assert found["free"] == "STALE_QUOTE" and found["o4"] is None
    assert {r["rejected_by"] for r in risk.validate(orders, risk.OrderLimits(kill_switch=True)).collect()} == {"KILL_SWITCH"}


def test_mean_gap_of_a_source(spark):
    from tickloom.operators import recurrences

    times = [0.0, 1.0, 1.0, 3.0, 3.5]
    mean = 1.0
    for gap in (2.0, 0.5):
        mean = 0.9 * mean + 0.1 * gap
    found = recurrences.inter_arrival(spark.createDataFrame([("s", t) for t in times], "source string, exchange_timestamp double")).collect()
    assert [(r["source"], round(r["interval_s"], 9), r["gaps"]) for r in found] == [("s", round(mean, 9), 3)]
