"""Hand-computed cases of depth, chunked as-of joins, surfaces, archives and epochs."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests.test_operators import frame, tick
from tickloom.functions import finance
from tickloom.operators import depth, joins
from tickloom.plans import QUERIES
from tickloom.sources import history


def test_ladders(spark):
    rows = [("I", "A", 0.0, [(10.0, 1.0), (9.0, 2.0)], [(11.0, 1.0)]), ("I", "B", 1.0, [(11.5, 3.0)], [(12.0, 1.0)]), ("I", "B", 0.5, [(1.0, 1.0)], []), ("I", "A", 4.5, [(10.0, 2.0)], [(11.0, 2.0)])]
    books = spark.createDataFrame(rows, "instrument_id string, venue string, exchange_timestamp double, bids array<struct<price:double,size:double>>, asks array<struct<price:double,size:double>>")
    found = depth.ladders(books, ttl=3.0).orderBy("exchange_timestamp").collect()
    assert [(r["n_venues"], r["crossed"]) for r in found] == [(1, False), (2, False), (2, True), (1, False)]
    assert [tuple(x) for x in found[2]["bids"]] == [(11.5, 3.0), (10.0, 1.0), (9.0, 2.0)]
    r = depth.read_off(depth.ladders(books, ttl=3.0)).orderBy("exchange_timestamp").first()
    assert (r["best_bid"], r["best_ask"], r["mid"], r["micro"], r["imbalance"]) == (10.0, 11.0, 10.5, 10.5, 0.5)


def test_as_of_by_chunks_is_the_same(spark):
    trades = frame(spark, [tick(i, ts=i * 7.0, price=1.0, instrument_id="A" if i % 3 else "B") for i in range(60)])
    quotes = frame(spark, [tick(1000 + i, "QUOTE", ts=30 + i * 41.0, bid_price=float(i), instrument_id="A") for i in range(8)])
    plain = sorted((r["event_id"], r["asof_bid_price"]) for r in joins.as_of(trades, quotes, ["bid_price"]).collect() if r["asof_bid_price"] is not None)
    for chunk in (1.0, 10.0, 100.0, 1e6):
        found = joins.as_of(trades, quotes, ["bid_price"], chunk_s=chunk)
        assert found.count() == 60 and "_chunk" not in found.columns
        assert sorted((r["event_id"], r["asof_bid_price"]) for r in found.collect() if r["asof_bid_price"] is not None) == plain


def test_parity_and_statistics(spark, small):
    gaps = QUERIES["put_call_parity"](spark, small).collect()
    assert gaps and all(abs(r["gap"]) < 1e-6 for r in gaps)
    assert finance.sharpe_interval(1.0, 1) == (0.0, 0.0) and finance.sharpe_interval(0.5, 101) == (0.2921, 0.7079) and finance.calmar(10, 0) == 0
    r = finance.signal_test(spark.createDataFrame([(0.1,), (0.2,), (0.3,)], "ret double")).first()
    assert abs(r["t"] - 3.4641016) < 1e-6 and abs(r["p"] - 0.000532) < 1e-5


def test_epochs_and_hours(spark):
    rows = spark.createDataFrame([(1_700_000_000,), (1_700_000_000_123,), (1_700_000_000_123_456,), (None,)], "t long")
    assert [r[0] for r in rows.select(history.strict_ns(F.col("t"))).collect()] == [1_700_000_000_000_000_000, 1_700_000_000_123_000_000, 1_700_000_000_123_456_000, None]
    with pytest.raises(PySparkException):
        spark.createDataFrame([(5,)], "t long").select(history.strict_ns(F.col("t"))).collect()
    assert history.hours(3600.0 * 23, 3600.0 * 25) == ["1970-01-01/23", "1970-01-02/00"]


def test_archive(spark, tmp_path):
    raw = spark.createDataFrame([("r1", "A", 1_700_000_001.0, "{}"), ("r0", "A", 1_700_000_000.0, "{}"), ("r2", "B", 1_700_000_000.0, "{}")], "raw_id string, source string, receive_timestamp double, payload string")
    history.write_archive(raw, str(tmp_path / "a"))
    assert [r["raw_id"] for r in history.replay_archive(spark, str(tmp_path / "a"), "2023-11-14", "A").collect()] == ["r0", "r1"]
