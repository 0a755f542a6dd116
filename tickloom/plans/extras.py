"""Queries over depth, volatility surfaces, archives and the like."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tickloom.functions import finance
from tickloom.operators import aggregates, depth, joins
from tickloom.operators import windows as W
from tickloom.plans.catalog import TICKS, query
from tickloom.plans.market import WITH_BARS, _daily, _quotes
from tickloom.plans.more import RET, _chain
from tickloom.sources import history
from tickloom.sources.tables import ticks


def _books(spark, d):
    q = _quotes(spark, d)
    level = lambda p, z: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct((p(i)).alias("price"), (F.col(z) + i).alias("size")))
    return q.select("instrument_id", F.col("source").alias("venue"), "exchange_timestamp", level(lambda i: F.round("bid_price", 0) - i, "bid_size").alias("bids"), level(lambda i: F.round("ask_price", 0) + 500 + i, "ask_size").alias("asks"))


@query("consolidated_ladders")
def consolidated_ladders(spark, d):
    return depth.read_off(depth.ladders(_books(spark, d), ttl=21600.0))


SURFACE = "surface AS (SELECT ((p_partkey % 4 + 1) / 4)::DOUBLE AS years, round(p_retailprice, -1) AS strike, round(avg(0.1::DOUBLE + (p_size % 10) * 0.05::DOUBLE), 6) AS vol FROM part GROUP BY 1, 2)"


def _surface(spark, d):
    return _chain(spark, d).groupBy("years", "strike").agg(F.round(F.avg("vol"), 6).alias("vol"))


@query("vol_smile", f"WITH {SURFACE} SELECT strike, vol FROM surface WHERE years = 0.5")
def vol_smile(spark, d):
    return finance.smile(_surface(spark, d), 0.5)


@query("vol_term_structure", f"WITH {SURFACE} SELECT years, arg_min(vol, row(abs(strike - 1000), strike)) AS vol FROM surface GROUP BY 1")
def vol_term_structure(spark, d):
    return finance.term_structure(_surface(spark, d), 1000.0)


@query("vol_skew", f"WITH {SURFACE} SELECT years, round(arg_min(vol, row(abs(strike - 1000 * 0.9::DOUBLE), strike)) - arg_min(vol, row(abs(strike - 1000 * 1.1::DOUBLE), strike)), 6) AS skew FROM surface GROUP BY 1")
def vol_skew(spark, d):
    return finance.skew(_surface(spark, d), 1000.0).withColumn("skew", F.round("skew", 6))


@query("vol_surface_point", f"WITH {SURFACE} SELECT p.strike AS strike, p.years AS years, p.vol AS vol FROM (SELECT arg_min(surface, row(power((strike - 1234) / 1234, 2) + power((years - 0.6::DOUBLE) / 0.6::DOUBLE, 2), strike, years)) AS p FROM surface)")
def vol_surface_point(spark, d):
    return finance.surface_point(_surface(spark, d), 1234.0, 0.6)


@query("put_call_parity")
def put_call_parity(spark, d):
    both = _chain(spark, d).where("strike > 0").withColumn("option_type", F.explode(F.array(F.lit("CALL"), F.lit("PUT"))))
    return finance.parity_gaps(finance.option_values(both))


@query("signal_test", WITH_BARS + RET + " SELECT round(avg(ret), 8) AS mean, round(avg(ret) / (stddev_samp(ret) / sqrt(count(*))), 6) AS t, round(avg(ret) / stddev_samp(ret) * sqrt(252::DOUBLE), 6) AS information_ratio, count(*) AS n FROM rr")
def signal_test(spark, d):
    r = finance.signal_test(W.returns(_daily(spark, d)).where("ret is not null"))
    return r.select(F.round("mean", 8).alias("mean"), F.round("t", 6).alias("t"), F.round("information_ratio", 6).alias("information_ratio"), "n")


@query("archive_round_trip", f"WITH {TICKS} SELECT event_id AS raw_id, instrument_id AS payload FROM ticks WHERE source = 'S1' AND receive_timestamp >= 1704412800 AND receive_timestamp < 1704499200")
def archive_round_trip(spark, d):
    path = f"{spark.conf.get('spark.sql.warehouse.dir')}/archive-{uuid.uuid4().hex[:12]}"
    history.write_archive(ticks(spark, d).select(F.col("event_id").alias("raw_id"), F.col("instrument_id").alias("payload"), "source", "receive_timestamp"), path)
    return history.replay_archive(spark, path, "2024-01-05", "S1").select("raw_id", "payload")


@query("first_seen_ids", f"WITH {TICKS}, f AS (SELECT instrument_id, min(exchange_timestamp) AS t FROM ticks GROUP BY 1) SELECT instrument_id, CAST(row_number() OVER (ORDER BY t, instrument_id) - 1 AS INTEGER) AS id FROM f")
def first_seen_ids(spark, d):
    return history.first_seen_ids(ticks(spark, d), "instrument_id")


@query("epoch_units", f"WITH {TICKS} SELECT event_id, CAST(round(exchange_timestamp) AS BIGINT) * 1000000000 AS ns FROM ticks")
def epoch_units(spark, d):
    """Times in seconds, milli-, micro- and nanoseconds by turns, all told apart."""
    s = F.round("exchange_timestamp").cast("long")
    mixed = F.element_at(F.array(s, s * 1000, s * 1_000_000, s * 1_000_000_000), (F.col("sequence_number") % 4 + 1).cast("int"))
    return ticks(spark, d).select("event_id", history.strict_ns(mixed).alias("ns"))


@query("epochs_numbered", f"""WITH {TICKS}, x AS (SELECT event_id, source, instrument_id, receive_timestamp AS r, exchange_timestamp AS t, sequence_number % 500 AS s FROM ticks),
  n AS (SELECT *, CASE WHEN lag(s) OVER w - s >= 50 AND t - lag(t) OVER w >= 60 THEN 1 ELSE 0 END AS n FROM x WINDOW w AS (PARTITION BY source, instrument_id ORDER BY r, event_id))
  SELECT event_id, CAST(sum(n) OVER (PARTITION BY source, instrument_id ORDER BY r, event_id) AS BIGINT) AS epoch FROM n""")
def epochs_numbered(spark, d):
    return W.epochs(ticks(spark, d).withColumn("sequence_number", F.col("sequence_number") % 500)).select("event_id", "epoch")


# ---- ticks at the same time -----------------------------------------------------------------------

TIED = f"{TICKS}, tied AS (SELECT * REPLACE (floor(exchange_timestamp / 3600) * 3600 AS exchange_timestamp, floor(receive_timestamp / 3600) * 3600 AS receive_timestamp) FROM ticks)"


def _tied(spark, d, kind=None):
    """Ticks with times cut to the hour, so that many are equal."""
    hour = lambda c: F.floor(F.col(c) / 3600).cast("double") * 3600
    return ticks(spark, d, kind).withColumns({c: hour(c) for c in ("exchange_timestamp", "receive_timestamp")})


@query("ohlcv_tied", f"""WITH {TIED} SELECT instrument_id, floor(exchange_timestamp / 86400::DOUBLE) * 86400::DOUBLE AS bucket,
  round(arg_min(price, row(exchange_timestamp, sequence_number, event_id)), 4) AS open, round(max(price), 4) AS high, round(min(price), 4) AS low,
  round(arg_max(price, row(exchange_timestamp, sequence_number, event_id)), 4) AS close, round(sum(coalesce(quantity, 0)), 2) AS volume, count(*) AS trade_count
  FROM tied WHERE event_type = 'TRADE' AND price IS NOT NULL GROUP BY ALL""")
def ohlcv_tied(spark, d):
    return aggregates.ohlcv(_tied(spark, d), interval=86400.0)


@query("bars_tied", f"""WITH {TIED}, x AS (SELECT *, unnest([3600, 86400]) AS i FROM tied WHERE price IS NOT NULL)
  SELECT instrument_id, CASE i WHEN 3600 THEN '1h' ELSE '1d' END AS interval, floor(exchange_timestamp / i::DOUBLE) * i::DOUBLE AS bucket_start,
  arg_min(price, row(receive_timestamp, sequence_number, event_id)) AS open, arg_max(price, row(receive_timestamp, sequence_number, event_id)) AS close, count(*) AS trade_count
  FROM x GROUP BY instrument_id, i, bucket_start""")
def bars_tied(spark, d):
    rows = _tied(spark, d).withColumn("quality_status", F.lit("VALID"))
    return aggregates.bars(rows, {"1h": 3600.0, "1d": 86400.0}).select("instrument_id", "interval", "bucket_start", "open", "close", "trade_count")


ASOF_TIED = f"""WITH {TIED}, q AS (SELECT instrument_id, exchange_timestamp, arg_max(row(bid_price, ask_price), row(sequence_number, event_id)) AS last FROM tied WHERE event_type = 'QUOTE' GROUP BY 1, 2)
  SELECT t.event_id, q.last[1] AS asof_bid_price, q.last[2] AS asof_ask_price FROM (SELECT * FROM tied WHERE event_type = 'TRADE') t ASOF LEFT JOIN q ON t.instrument_id = q.instrument_id AND t.exchange_timestamp >= q.exchange_timestamp"""


@query("asof_tied", ASOF_TIED)
def asof_tied(spark, d):
    return joins.as_of(_tied(spark, d, "TRADE"), _tied(spark, d, "QUOTE"), ["bid_price", "ask_price"]).select("event_id", "asof_bid_price", "asof_ask_price")


@query("asof_tied_chunked", ASOF_TIED)
def asof_tied_chunked(spark, d):
    return joins.as_of(_tied(spark, d, "TRADE"), _tied(spark, d, "QUOTE"), ["bid_price", "ask_price"], chunk_s=86400.0).select("event_id", "asof_bid_price", "asof_ask_price")
