"""Queries over the ticks: aggregates, joins in time, indicators, rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import aggregates as A
from tickloom.operators import book as B
from tickloom.operators import flow, joins, rules, tca
from tickloom.operators import windows as W
from tickloom.plans.catalog import JUDGED, TICKS, query
from tickloom.schema import bucket
from tickloom.sources.tables import ticks

DAY = 86400.0
R6 = lambda c: F.round(c, 6).alias(c)


def _trades(spark: SparkSession, d: str) -> DataFrame:
    return ticks(spark, d, "TRADE")


def _quotes(spark: SparkSession, d: str) -> DataFrame:
    return ticks(spark, d, "QUOTE")


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return A.ohlcv(_trades(spark, d), interval=DAY)


BARS_SQL = f"""bars AS (SELECT instrument_id, floor(exchange_timestamp / {DAY}::DOUBLE) * {DAY}::DOUBLE AS bucket,
  round(arg_min(price, row(exchange_timestamp, sequence_number, event_id)), 4) AS open, round(max(price), 4) AS high, round(min(price), 4) AS low,
  round(arg_max(price, row(exchange_timestamp, sequence_number, event_id)), 4) AS close, round(sum(coalesce(quantity, 0)), 2) AS volume, count(*) AS trade_count
  FROM ticks WHERE price IS NOT NULL GROUP BY ALL)"""
WITH_BARS = f"WITH {TICKS}, {BARS_SQL} "


@query("ohlcv_daily", WITH_BARS + "SELECT * FROM bars")
def ohlcv_daily(spark, d):
    return _daily(spark, d)


@query("ohlcv_5s_newest", f"""WITH {TICKS} SELECT instrument_id, floor(exchange_timestamp / 5::DOUBLE) * 5::DOUBLE AS bucket,
  round(arg_min(price, row(exchange_timestamp, sequence_number, event_id)), 4) AS open, round(max(price), 4) AS high, round(min(price), 4) AS low,
  round(arg_max(price, row(exchange_timestamp, sequence_number, event_id)), 4) AS close, round(sum(coalesce(quantity, 0)), 2) AS volume, count(*) AS trade_count
  FROM ticks WHERE price IS NOT NULL AND instrument_id = 'I1' GROUP BY ALL ORDER BY bucket DESC LIMIT 100""")
def ohlcv_5s_newest(spark, d):
    return A.ohlcv(_trades(spark, d), "I1", 5.0, 100)


@query("vwap_all", f"""WITH {TICKS} SELECT round(sum(price * quantity) / sum(quantity), 4) AS vwap, round(sum(price * quantity), 2) AS notional,
  round(sum(quantity), 4) AS volume, min(price) AS min_price, max(price) AS max_price, count(*) AS trade_count FROM ticks WHERE price IS NOT NULL AND quantity > 0""")
def vwap_all(spark, d):
    return A.vwap(_trades(spark, d), "ALL")


@query("vwap_by_instrument", f"WITH {TICKS} SELECT instrument_id, round(sum(price * quantity) / sum(quantity), 4) AS vwap, count(*) AS trade_count FROM ticks WHERE price IS NOT NULL AND quantity > 0 GROUP BY 1")
def vwap_by_instrument(spark, d):
    return A.vwap_by_instrument(_trades(spark, d))


@query("vwap_range", f"""WITH {TICKS} SELECT round(sum(price * quantity) / sum(quantity), 4) AS vwap, round(sum(price * quantity), 2) AS notional,
  round(sum(quantity), 4) AS volume, min(price) AS min_price, max(price) AS max_price, count(*) AS trade_count FROM ticks
  WHERE price IS NOT NULL AND quantity > 0 AND instrument_id = 'I3' AND exchange_timestamp BETWEEN 1704499200 AND 1705363200""")
def vwap_range(spark, d):
    return A.vwap(_trades(spark, d), "I3", 1704499200.0, 1705363200.0)


@query("spreads", f"""WITH {TICKS} SELECT instrument_id, count(*) AS quote_count, round(avg(ask_price - bid_price), 4) AS avg_spread, round(min(ask_price - bid_price), 4) AS min_spread,
  round(max(ask_price - bid_price), 4) AS max_spread, CAST(count(*) FILTER (bid_price > ask_price) AS BIGINT) AS crossed_count,
  round(count(*) FILTER (bid_price > ask_price) * 100::DOUBLE / count(*), 2) AS crossed_pct FROM ticks WHERE bid_price IS NOT NULL AND ask_price IS NOT NULL GROUP BY 1""")
def spreads(spark, d):
    return A.spreads(_quotes(spark, d))


@query("latency_quantiles", f"""WITH {TICKS}, l AS (SELECT (processing_timestamp - receive_timestamp) * 1e6 AS us FROM ticks WHERE processing_timestamp >= receive_timestamp)
  SELECT round(quantile_cont(us, 0.5), 2) AS p50, round(quantile_cont(us, 0.9), 2) AS p90, round(quantile_cont(us, 0.95), 2) AS p95, round(quantile_cont(us, 0.99), 2) AS p99,
  round(quantile_cont(us, 0.999), 2) AS p999, round(avg(us), 2) AS mean, count(*) AS n FROM l""")
def latency_quantiles(spark, d):
    return A.latency_quantiles(ticks(spark, d))


@query("volume_profile", f"""WITH {TICKS}, t AS (SELECT * FROM ticks WHERE price IS NOT NULL AND quantity > 0),
  b AS (SELECT instrument_id, min(price) AS low, max(price) AS high, sum(quantity) AS total FROM t GROUP BY 1)
  SELECT t.instrument_id, CAST(CASE WHEN (high - low) / 10::DOUBLE > 0 THEN floor((price - low) / ((high - low) / 10::DOUBLE)) ELSE 0 END AS BIGINT) AS bin,
  round(sum(quantity), 2) AS volume, count(*) AS trade_count, round(sum(quantity) / max(total) * 100::DOUBLE, 4) AS pct FROM t JOIN b USING (instrument_id) GROUP BY 1, 2""")
def volume_profile(spark, d):
    return A.volume_profile(_trades(spark, d))


@query("volatility", f"""WITH {JUDGED} SELECT instrument_id, count(*) AS n, round(avg(price), 6) AS mean, round(stddev_pop(price), 6) AS std_dev, min(price) AS min_price, max(price) AS max_price,
  round((max(price) - min(price)) / avg(price) * 100::DOUBLE, 4) AS range_pct FROM judged WHERE price IS NOT NULL AND quality_status <> 'INVALID' GROUP BY 1""")
def volatility(spark, d):
    return A.volatility(rules.judge(_trades(spark, d)))


@query("quality_status_counts", f"WITH {JUDGED} SELECT quality_status, count(*) AS n FROM judged GROUP BY 1")
def quality_status_counts(spark, d):
    return A.status_counts(rules.judge(ticks(spark, d)))


@query("quality_reason_counts", f"WITH {JUDGED} SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM judged) GROUP BY 1")
def quality_reason_counts(spark, d):
    return A.reason_counts(rules.judge(ticks(spark, d)))


@query("quality_judged", f"WITH {JUDGED} SELECT event_id, quality_status, array_to_string(reasons, ',') AS reasons FROM judged")
def quality_judged(spark, d):
    return rules.judge(ticks(spark, d)).select("event_id", "quality_status", F.array_join("reasons", ",").alias("reasons"))


@query("quarantine", f"WITH {JUDGED} SELECT event_id, instrument_id, source, quality_status FROM judged WHERE quality_status <> 'VALID'")
def quarantine(spark, d):
    return rules.split(rules.judge(ticks(spark, d)))[1].select("event_id", "instrument_id", "source", "quality_status")


@query("source_health", f"""WITH {JUDGED} SELECT source, count(*) AS total, CAST(count(*) FILTER (quality_status = 'INVALID') AS BIGINT) AS invalid, CAST(count(*) FILTER (quality_status = 'SUSPICIOUS') AS BIGINT) AS suspicious,
  CAST(0 AS BIGINT) AS duplicate, CAST(0 AS BIGINT) AS gap FROM judged GROUP BY 1""")
def source_health(spark, d):
    return A.source_health(rules.judge(ticks(spark, d)))


@query("inventory", f"WITH {TICKS} SELECT count(*) AS n, count(DISTINCT instrument_id) AS instruments, count(DISTINCT source) AS sources, round(min(exchange_timestamp), 6) AS min_ts, round(max(exchange_timestamp), 6) AS max_ts FROM ticks")
def inventory(spark, d):
    return A.inventory(ticks(spark, d))


@query("symbols", f"WITH {TICKS} SELECT DISTINCT instrument_id FROM ticks")
def symbols(spark, d):
    return A.symbols(ticks(spark, d))


@query("freshness", f"""WITH {TICKS}, a AS (SELECT * FROM ticks WHERE exchange_timestamp < 1706000000) SELECT (SELECT count(*) FROM a) AS store_rows, (SELECT count(*) FROM ticks) AS origin_rows,
  round((SELECT max(exchange_timestamp) FROM ticks) - (SELECT max(exchange_timestamp) FROM a), 6) AS lag_s, (SELECT max(exchange_timestamp) FROM a) >= (SELECT max(exchange_timestamp) FROM ticks) AS is_fresh""")
def freshness(spark, d):
    t = ticks(spark, d)
    return A.freshness(t.where("exchange_timestamp < 1706000000"), t)


@query("latency_histogram", f"""WITH {TICKS}, l AS (SELECT receive_timestamp - exchange_timestamp AS s FROM ticks)
  SELECT '0.015' AS le, CAST(count(*) FILTER (s <= 0.015::DOUBLE) AS BIGINT) AS n FROM l UNION ALL SELECT '0.035', CAST(count(*) FILTER (s <= 0.035::DOUBLE) AS BIGINT) FROM l
  UNION ALL SELECT '0.055', CAST(count(*) FILTER (s <= 0.055::DOUBLE) AS BIGINT) FROM l UNION ALL SELECT '+Inf', count(*) FROM l""")
def latency_histogram(spark, d):
    t = ticks(spark, d).select((F.col("receive_timestamp") - F.col("exchange_timestamp")).alias("s"))
    return A.histogram(t, "s", [0.015, 0.035, 0.055])


@query("bars_multi_interval", f"""WITH {JUDGED}, x AS (SELECT *, unnest([60, 3600, 86400]) AS i FROM judged WHERE price IS NOT NULL AND quality_status <> 'INVALID')
  SELECT instrument_id, CASE i WHEN 60 THEN '1m' WHEN 3600 THEN '1h' ELSE '1d' END AS interval, floor(exchange_timestamp / i::DOUBLE) * i::DOUBLE AS bucket_start,
  arg_min(price, row(receive_timestamp, sequence_number, event_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, row(receive_timestamp, sequence_number, event_id)) AS close,
  sum(quantity) AS volume, count(*) AS trade_count, round(sum(price * quantity) / sum(quantity), 6) AS vwap FROM x GROUP BY instrument_id, i, bucket_start""")
def bars_multi_interval(spark, d):
    return A.bars(rules.judge(ticks(spark, d)), {"1m": 60.0, "1h": 3600.0, "1d": 86400.0}).withColumn("vwap", F.round("vwap", 6))


@query("bars_merged", f"""WITH {JUDGED}, x AS (SELECT *, floor(exchange_timestamp / 86400::DOUBLE) * 86400::DOUBLE AS bucket_start FROM judged WHERE price IS NOT NULL AND quality_status <> 'INVALID')
  SELECT instrument_id, '1d' AS interval, bucket_start, coalesce(arg_min(price, row(receive_timestamp, sequence_number, event_id)) FILTER (source <> 'S2'), arg_min(price, row(receive_timestamp, sequence_number, event_id))) AS open, max(price) AS high, min(price) AS low,
  coalesce(arg_max(price, row(receive_timestamp, sequence_number, event_id)) FILTER (source = 'S2'), arg_max(price, row(receive_timestamp, sequence_number, event_id))) AS close, sum(quantity) AS volume, CAST(count(*) AS BIGINT) AS trade_count, round(sum(price * quantity) / sum(quantity), 6) AS vwap
  FROM x GROUP BY instrument_id, bucket_start""")
def bars_merged(spark, d):
    j = rules.judge(ticks(spark, d))
    return A.merge_bars(A.bars(j.where("source <> 'S2'"), {"1d": DAY}), A.bars(j.where("source = 'S2'"), {"1d": DAY})).withColumn("vwap", F.round("vwap", 6))


@query("bar_summary", WITH_BARS + "SELECT count(*) AS bars, count(DISTINCT instrument_id) AS instruments, CAST(1 AS BIGINT) AS intervals, min(bucket) AS first, max(bucket) AS last FROM bars")
def bar_summary(spark, d):
    return A.bar_summary(_daily(spark, d).select("*", F.lit("1d").alias("interval"), F.col("bucket").alias("bucket_start")))


@query("history_manifest", f"""WITH {TICKS} SELECT strftime(to_timestamp(exchange_timestamp) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, instrument_id, count(*) AS n, round(min(exchange_timestamp), 6) AS min_ts,
  round(max(exchange_timestamp), 6) AS max_ts, min(sequence_number) AS min_seq, max(sequence_number) AS max_seq FROM ticks GROUP BY 1, 2""")
def history_manifest(spark, d):
    return A.manifest(ticks(spark, d))


# ---- joins ----------------------------------------------------------------------------------------


@query("asof_point", f"""WITH {JUDGED} SELECT event_id, instrument_id, sequence_number FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY exchange_timestamp DESC, sequence_number DESC) AS r
  FROM judged WHERE quality_status <> 'INVALID' AND exchange_timestamp <= 1705000000) WHERE r = 1""")
def asof_point(spark, d):
    return joins.last_as_of(rules.judge(ticks(spark, d)), 1705000000.0).select("event_id", "instrument_id", "sequence_number")


@query("asof_bar", WITH_BARS + "SELECT instrument_id, bucket, close FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY bucket DESC) AS r FROM bars WHERE bucket + 86400 <= 1705000000) WHERE r = 1")
def asof_bar(spark, d):
    bars = _daily(spark, d).select("*", F.col("bucket").alias("bucket_start"), F.lit(DAY).alias("interval_s"))
    return joins.bar_as_of(bars, 1705000000.0).select("instrument_id", "bucket", "close")


@query("asof_trade_quote", f"""WITH {TICKS} SELECT t.event_id, t.price, q.bid_price AS asof_bid_price, q.ask_price AS asof_ask_price FROM (SELECT * FROM ticks WHERE event_type = 'TRADE') t
  ASOF LEFT JOIN (SELECT * FROM ticks WHERE event_type = 'QUOTE') q ON t.instrument_id = q.instrument_id AND t.exchange_timestamp >= q.exchange_timestamp""")
def asof_trade_quote(spark, d):
    return joins.as_of(_trades(spark, d), _quotes(spark, d), ["bid_price", "ask_price"]).select("event_id", "price", "asof_bid_price", "asof_ask_price")


@query("asof_trade_quote_chunked", f"""WITH {TICKS} SELECT t.event_id, t.price, q.bid_price AS asof_bid_price FROM (SELECT * FROM ticks WHERE event_type = 'TRADE') t
  ASOF LEFT JOIN (SELECT * FROM ticks WHERE event_type = 'QUOTE') q ON t.instrument_id = q.instrument_id AND t.exchange_timestamp >= q.exchange_timestamp""")
def asof_trade_quote_chunked(spark, d):
    """The same join with an instrument's history dealt out by hours."""
    return joins.as_of(_trades(spark, d), _quotes(spark, d), ["bid_price"], chunk_s=3600.0).select("event_id", "price", "asof_bid_price")


@query("markout_1h", f"""WITH {TICKS}, t AS (SELECT * FROM ticks WHERE event_type = 'TRADE'), q AS (SELECT instrument_id, exchange_timestamp, (bid_price + ask_price) / 2 AS mid FROM ticks WHERE event_type = 'QUOTE'),
  n AS (SELECT t.event_id, q.mid FROM t ASOF LEFT JOIN q ON t.instrument_id = q.instrument_id AND t.exchange_timestamp + 3600 <= q.exchange_timestamp),
  b AS (SELECT t.event_id, q.mid FROM t ASOF LEFT JOIN q ON t.instrument_id = q.instrument_id AND t.exchange_timestamp + 3600 >= q.exchange_timestamp)
  SELECT t.event_id, round(coalesce(n.mid, b.mid) - t.price, 6) AS markout FROM t JOIN n USING (event_id) JOIN b USING (event_id)""")
def markout_1h(spark, d):
    mids = _quotes(spark, d).select("instrument_id", "exchange_timestamp", ((F.col("bid_price") + F.col("ask_price")) / 2).alias("mid"))
    fills = _trades(spark, d).withColumn("side", F.lit("BUY"))
    return tca.markouts(fills, mids, [3600.0]).select("event_id", F.round("markout_3600s", 6).alias("markout"))


NBBO_SQL = f"""WITH {TICKS}, q AS (SELECT * FROM ticks WHERE event_type = 'QUOTE'),
  c AS (SELECT q.event_id, q.instrument_id, q.exchange_timestamp AS now, s.source, s.n FROM q, (VALUES ('S0', 0), ('S1', 1), ('S2', 2)) s(source, n)),
  l AS (SELECT c.*, p.bid_price, p.bid_size, p.ask_price, p.ask_size FROM c ASOF JOIN q p ON c.instrument_id = p.instrument_id AND c.source = p.source AND c.now >= p.exchange_timestamp WHERE c.now - p.exchange_timestamp <= 21600),
  best AS (SELECT event_id, max(row(bid_price, bid_size, -n, source)) AS b, min(row(ask_price, -ask_size, n, source)) AS a FROM l GROUP BY 1)
"""


@query("nbbo", NBBO_SQL + "SELECT q.event_id, b[1] AS best_bid, b[2] AS bid_size, b[4] AS bid_source, a[1] AS best_ask, -a[2] AS ask_size, a[4] AS ask_source FROM q JOIN best USING (event_id)")
def nbbo(spark, d):
    return joins.consolidated_bbo(_quotes(spark, d), ["S0", "S1", "S2"], 21600.0).drop("instrument_id", "exchange_timestamp")


@query("nbbo_venue_attribution", NBBO_SQL + """SELECT source, CAST(sum(x) AS BIGINT) AS best_bid_n, CAST(sum(y) AS BIGINT) AS best_ask_n, CAST(sum(z) AS BIGINT) AS both_n FROM (
  SELECT b[4] AS source, 1 AS x, 0 AS y, CASE WHEN b[4] = a[4] THEN 1 ELSE 0 END AS z FROM best UNION ALL SELECT a[4], 0, 1, 0 FROM best) GROUP BY 1""")
def nbbo_venue_attribution(spark, d):
    return joins.venue_attribution(joins.consolidated_bbo(_quotes(spark, d), ["S0", "S1", "S2"], 21600.0))


@query("nbbo_stats", NBBO_SQL + "SELECT count(*) AS updates, CAST(count(*) FILTER (b[1] > a[1]) AS BIGINT) AS crossed, CAST(count(*) FILTER (b[1] = a[1]) AS BIGINT) AS locked FROM best")
def nbbo_stats(spark, d):
    return joins.bbo_stats(joins.consolidated_bbo(_quotes(spark, d), ["S0", "S1", "S2"], 21600.0))


@query("incident_slice", f"""WITH {JUDGED}, spans AS (SELECT instrument_id, min(exchange_timestamp) AS start_ts, min(exchange_timestamp) + 600 AS end_ts FROM judged WHERE quality_status = 'INVALID' GROUP BY 1)
  SELECT t.event_id, t.instrument_id FROM judged t JOIN spans USING (instrument_id) WHERE t.exchange_timestamp BETWEEN start_ts - 3600 AND end_ts + 3600""")
def incident_slice(spark, d):
    j = rules.judge(ticks(spark, d))
    spans = j.where("quality_status = 'INVALID'").groupBy("instrument_id").agg(F.min("exchange_timestamp").alias("start_ts")).withColumn("end_ts", F.col("start_ts") + 600)
    return joins.slice_around(j, spans, 3600, 3600).select("event_id", "instrument_id")


@query("insert_or_ignore", f"WITH {TICKS} SELECT event_id, price FROM ticks WHERE source <> 'S0'")
def insert_or_ignore(spark, d):
    t = ticks(spark, d)
    return joins.unseen(t.unionByName(t.where("source = 'S1'")), t.where("source = 'S0'")).select("event_id", "price")


@query("subscriptions", f"WITH {TICKS} SELECT event_id FROM ticks WHERE instrument_id IN ('I1', 'I4')")
def subscriptions(spark, d):
    wanted = spark.range(1).select(F.explode(F.array(F.lit("I1"), F.lit("I4"))).alias("instrument_id"))
    return joins.subscribed(ticks(spark, d), wanted).select("event_id")


@query("ab_arbitration", f"""WITH {TICKS}, p AS (SELECT source AS channel, sequence_number AS sequence, 'A' AS feed, receive_timestamp AS arrival, event_id FROM ticks
  UNION ALL SELECT source, sequence_number, 'B', exchange_timestamp + 0.03::DOUBLE, event_id FROM ticks WHERE sequence_number % 3 <> 0)
  SELECT channel, sequence, feed FROM (SELECT *, row_number() OVER (PARTITION BY channel, sequence ORDER BY arrival, feed) AS r FROM p) WHERE r = 1""")
def ab_arbitration(spark, d):
    t = ticks(spark, d)
    a = t.select(F.col("source").alias("channel"), F.col("sequence_number").alias("sequence"), F.lit("A").alias("feed"), F.col("receive_timestamp").alias("arrival"), "event_id")
    b = t.where("sequence_number % 3 <> 0").select(F.col("source").alias("channel"), F.col("sequence_number").alias("sequence"), F.lit("B").alias("feed"), (F.col("exchange_timestamp") + F.lit(0.03).cast("double")).alias("arrival"), "event_id")
    return joins.arbitrate(a.unionByName(b)).select("channel", "sequence", "feed")


@query("shadow_comparison", f"""WITH {JUDGED}, x AS (SELECT quality_status = 'INVALID' AS f, coalesce(ask_price, 0) - coalesce(bid_price, 0) < 0.005::DOUBLE AND event_type = 'QUOTE' AS t FROM judged), c AS (
  SELECT CAST(count(*) FILTER (f AND t) AS BIGINT) AS tp, CAST(count(*) FILTER (f AND NOT t) AS BIGINT) AS fp, CAST(count(*) FILTER (NOT f AND t) AS BIGINT) AS fn, CAST(count(*) FILTER (NOT f AND NOT t) AS BIGINT) AS tn FROM x)
  SELECT *, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / (tp + fn), 6) AS recall FROM c""")
def shadow_comparison(spark, d):
    j = rules.judge(ticks(spark, d))
    tagged = (F.coalesce("ask_price", F.lit(0.0)) - F.coalesce("bid_price", F.lit(0.0)) < F.lit(0.005).cast("double")) & (F.col("event_type") == "QUOTE")
    return joins.compare_with_baseline(j.select("event_id", (F.col("quality_status") == "INVALID").alias("flagged")), j.select("event_id", tagged.alias("tagged")))


@query("correlations", WITH_BARS + """, r AS (SELECT instrument_id, bucket, (close - lag(close) OVER w) / lag(close) OVER w AS ret FROM bars WINDOW w AS (PARTITION BY instrument_id ORDER BY bucket))
  SELECT a.instrument_id AS a, b.instrument_id AS b, round(corr(a.ret, b.ret), 6) AS corr, count(*) AS n FROM r a JOIN r b USING (bucket) WHERE a.instrument_id < b.instrument_id AND a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2""")
def correlations(spark, d):
    return joins.correlations(W.returns(_daily(spark, d)).where("ret is not null"))


# ---- windows --------------------------------------------------------------------------------------


@query("sma_5", WITH_BARS + "SELECT instrument_id, bucket, CASE WHEN row_number() OVER w >= 5 THEN round(avg(close) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) END AS sma FROM bars WINDOW w AS (PARTITION BY instrument_id ORDER BY bucket)")
def sma_5(spark, d):
    return W.sma(_daily(spark, d), 5).select("instrument_id", "bucket", R6("sma"))


@query("bollinger", WITH_BARS + """, x AS (SELECT instrument_id, bucket, row_number() OVER w AS r, avg(close) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS m, stddev_samp(close) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS s
  FROM bars WINDOW w AS (PARTITION BY instrument_id ORDER BY bucket)) SELECT instrument_id, bucket, CASE WHEN r >= 10 THEN round(m, 6) END AS bb_mid, CASE WHEN r >= 10 THEN round(m + 2 * s, 6) END AS bb_upper, CASE WHEN r >= 10 THEN round(m - 2 * s, 6) END AS bb_lower FROM x""")
def bollinger(spark, d):
    return W.bollinger(_daily(spark, d), 10).select("instrument_id", "bucket", R6("bb_mid"), R6("bb_upper"), R6("bb_lower"))


@query("returns", WITH_BARS + "SELECT instrument_id, bucket, round((close - lag(close) OVER w) / lag(close) OVER w, 6) AS ret, round(ln(close / lag(close) OVER w), 6) AS log_ret FROM bars WINDOW w AS (PARTITION BY instrument_id ORDER BY bucket)")
def returns(spark, d):
    return W.returns(_daily(spark, d)).select("instrument_id", "bucket", R6("ret"), R6("log_ret"))


@query("realized_volatility", WITH_BARS + """, x AS (SELECT instrument_id, bucket, ln(close / lag(close) OVER w) AS l, row_number() OVER w AS r FROM bars WINDOW w AS (PARTITION BY instrument_id ORDER BY bucket))
  SELECT instrument_id, bucket, CASE WHEN r > 5 THEN round(stddev_samp(l) OVER (PARTITION BY instrument_id ORDER BY bucket ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) END AS realized_vol FROM x""")
def realized_volatility(spark, d):
    return W.realized_volatility(_daily(spark, d), 5).select("instrument_id", "bucket", R6("realized_vol"))


@query("obv", WITH_BARS + """, x AS (SELECT instrument_id, bucket, coalesce(sign(close - lag(close) OVER w), 1) * volume AS s FROM bars WINDOW w AS (PARTITION BY instrument_id ORDER BY bucket))
  SELECT instrument_id, bucket, sum(s) OVER (PARTITION BY instrument_id ORDER BY bucket) AS obv FROM x""")
def obv(spark, d):
    return W.obv(_daily(spark, d)).select("instrument_id", "bucket", "obv")


@query("drawdown", WITH_BARS + "SELECT instrument_id, bucket, max(close) OVER w AS peak, round((max(close) OVER w - close) / max(close) OVER w * 100, 6) AS drawdown_pct FROM bars WINDOW w AS (PARTITION BY instrument_id ORDER BY bucket)")
def drawdown(spark, d):
    return W.drawdown(_daily(spark, d)).select("instrument_id", "bucket", "peak", R6("drawdown_pct"))


@query("order_flow_imbalance", f"""WITH {TICKS}, x AS (SELECT event_id, instrument_id, exchange_timestamp, bid_price b, bid_size bz, ask_price a, ask_size az, lag(bid_price) OVER w pb, lag(bid_size) OVER w pbz, lag(ask_price) OVER w pa, lag(ask_size) OVER w paz
  FROM ticks WHERE event_type = 'QUOTE' WINDOW w AS (PARTITION BY instrument_id ORDER BY exchange_timestamp, event_id)),
  y AS (SELECT *, CASE WHEN pb IS NULL THEN 0 ELSE (CASE WHEN b > pb THEN bz WHEN b = pb THEN bz - pbz ELSE -pbz END) - (CASE WHEN a < pa THEN az WHEN a = pa THEN az - paz ELSE -paz END) END AS ofi FROM x)
  SELECT event_id, ofi::DOUBLE AS ofi, sum(ofi::DOUBLE) OVER (PARTITION BY instrument_id ORDER BY exchange_timestamp, event_id) AS ofi_sum FROM y""")
def order_flow_imbalance(spark, d):
    return W.order_flow_imbalance(_quotes(spark, d)).select("event_id", "ofi", "ofi_sum")


@query("trade_toxicity", f"""WITH {TICKS}, x AS (SELECT instrument_id, quantity, price, lag(price) OVER (PARTITION BY instrument_id ORDER BY exchange_timestamp, event_id) AS p FROM ticks WHERE event_type = 'TRADE'),
  y AS (SELECT *, quantity * CASE WHEN price > p THEN 1.0::DOUBLE WHEN price < p THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS buy FROM x) SELECT instrument_id, round(abs(sum(buy) - sum(quantity - buy)) / sum(quantity), 6) AS toxicity FROM y GROUP BY 1""")
def trade_toxicity(spark, d):
    return W.trade_toxicity(_trades(spark, d))


@query("sequence_gaps", f"""WITH {TICKS}, x AS (SELECT *, max(sequence_number) OVER (PARTITION BY source, instrument_id ORDER BY exchange_timestamp, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM ticks)
  SELECT event_id, source, instrument_id, h + 1 AS gap_from, sequence_number - 1 AS gap_to, sequence_number - h - 1 AS missing FROM x WHERE sequence_number > h + 1""")
def sequence_gaps(spark, d):
    return W.gaps(ticks(spark, d))


@query("duplicates", f"""WITH {TICKS}, u AS (SELECT * FROM ticks UNION ALL SELECT * REPLACE (receive_timestamp + 1 AS receive_timestamp) FROM ticks WHERE sequence_number % 50 = 0)
  SELECT event_id, CAST(r AS INTEGER) AS copy FROM (SELECT event_id, row_number() OVER (PARTITION BY source, instrument_id, sequence_number ORDER BY receive_timestamp, event_id) AS r FROM u) WHERE r > 1""")
def duplicates(spark, d):
    t = ticks(spark, d)
    return W.duplicates(t.unionByName(t.where("sequence_number % 50 = 0").withColumn("receive_timestamp", F.col("receive_timestamp") + 1))).select("event_id", "copy")


@query("channel_sequence", f"""WITH {TICKS}, x AS (SELECT event_id, sequence_number AS s, max(sequence_number) OVER (PARTITION BY source ORDER BY receive_timestamp, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM ticks)
  SELECT event_id, CASE WHEN h IS NULL OR s = h + 1 THEN 'VALID' WHEN s > h + 1 THEN 'SEQUENCE_GAP' WHEN h - s < 100 THEN 'DUPLICATE' ELSE 'OUT_OF_ORDER' END AS verdict FROM x""")
def channel_sequence(spark, d):
    return W.channel_sequence(ticks(spark, d)).select("event_id", "verdict")


@query("incidents", f"""WITH {JUDGED}, a AS (SELECT event_id, source, instrument_id, exchange_timestamp AS t, unnest(reasons) AS reason FROM judged),
  s AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 7200 THEN 0 ELSE 1 END AS n FROM a WINDOW w AS (PARTITION BY source, instrument_id, reason ORDER BY t, event_id)),
  g AS (SELECT *, CAST(sum(n) OVER (PARTITION BY source, instrument_id, reason ORDER BY t, event_id) AS BIGINT) AS incident FROM s)
  SELECT source, instrument_id, reason, incident, min(t) AS start_ts, max(t) AS end_ts, count(*) AS n FROM g GROUP BY 1, 2, 3, 4""")
def incidents(spark, d):
    rows = rules.judge(ticks(spark, d)).select("event_id", "source", "instrument_id", "exchange_timestamp", F.explode("reasons").alias("reason"))
    return W.incidents(rows, 7200.0)


@query("latest_100", f"WITH {TICKS} SELECT event_id FROM ticks ORDER BY exchange_timestamp DESC, event_id DESC LIMIT 100")
def latest_100(spark, d):
    return W.latest(ticks(spark, d), 100).select("event_id")


@query("latest_per_instrument", f"WITH {TICKS} SELECT instrument_id, arg_max(event_id, row(exchange_timestamp, event_id)) AS event_id FROM ticks GROUP BY 1")
def latest_per_instrument(spark, d):
    return W.latest_per_key(ticks(spark, d)).select("instrument_id", "event_id")


@query("page_after", f"WITH {TICKS} SELECT event_id FROM ticks WHERE sequence_number > 500 ORDER BY sequence_number LIMIT 50")
def page_after(spark, d):
    return W.page(ticks(spark, d), 500, 50).select("event_id")


# ---- flow and costs -------------------------------------------------------------------------------

SIDES = f"""WITH {TICKS}, t AS (SELECT t.*, q.bid_price AS qb, q.ask_price AS qa FROM (SELECT * FROM ticks WHERE event_type = 'TRADE') t
  ASOF LEFT JOIN (SELECT * FROM ticks WHERE event_type = 'QUOTE') q ON t.instrument_id = q.instrument_id AND t.exchange_timestamp >= q.exchange_timestamp),
  l AS (SELECT *, lag(t.price) OVER (PARTITION BY instrument_id ORDER BY exchange_timestamp, event_id) AS p FROM t),
  told AS (SELECT *, CASE WHEN qa > qb AND price >= qa - greatest(1e-5, 0.005::DOUBLE * (qa - qb)) THEN 'BUY' WHEN qa > qb AND price <= qb + greatest(1e-5, 0.005::DOUBLE * (qa - qb)) THEN 'SELL'
    WHEN price > p THEN 'BUY' WHEN price < p THEN 'SELL' WHEN p IS NULL THEN 'BUY' END AS told FROM l),
  sided AS (SELECT * EXCLUDE (bid_price, ask_price, bid_size, ask_size), last_value(told IGNORE NULLS) OVER (PARTITION BY instrument_id ORDER BY exchange_timestamp, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS side FROM told)
"""


@query("lee_ready", SIDES + "SELECT event_id, side FROM sided")
def lee_ready(spark, d):
    return flow.classify(_trades(spark, d), _quotes(spark, d)).select("event_id", "side")


@query("cumulative_delta", SIDES + "SELECT event_id, sum(CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END) OVER (PARTITION BY instrument_id ORDER BY exchange_timestamp, event_id) AS cvd FROM sided")
def cumulative_delta(spark, d):
    return flow.cumulative_delta(flow.classify(_trades(spark, d), _quotes(spark, d))).select("event_id", "cvd")


@query("flow_summary", SIDES + """, s AS (SELECT instrument_id, round(sum(CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END), 4) AS cvd, round(sum(CASE WHEN side = 'BUY' THEN price * quantity ELSE -price * quantity END), 2) AS cnd,
  round(sum(CASE WHEN side = 'BUY' THEN quantity ELSE 0 END) / sum(quantity) * 100::DOUBLE, 2) AS buy_pct, count(*) AS trades FROM sided GROUP BY 1)
  SELECT *, CASE WHEN buy_pct >= 60 THEN 'BUYERS' WHEN buy_pct <= 40 THEN 'SELLERS' ELSE 'BALANCED' END AS bias FROM s""")
def flow_summary(spark, d):
    return flow.summary(flow.classify(_trades(spark, d), _quotes(spark, d)))


@query("participants", SIDES + """, s AS (SELECT user_id AS broker, round(sum(CASE WHEN side = 'BUY' THEN quantity ELSE 0 END), 4) AS buy_volume, round(sum(CASE WHEN side = 'BUY' THEN 0 ELSE quantity END), 4) AS sell_volume,
  round(sum(CASE WHEN side = 'BUY' THEN price * quantity ELSE -price * quantity END), 2) AS net_notional FROM sided GROUP BY 1)
  SELECT *, CASE WHEN net_notional > 50000 THEN 'ACCUMULATING' WHEN net_notional < -50000 THEN 'DISTRIBUTING' ELSE 'NEUTRAL' END AS stance FROM s ORDER BY abs(net_notional) DESC, broker LIMIT 10""")
def participants(spark, d):
    return flow.participants(flow.classify(_trades(spark, d), _quotes(spark, d)).withColumn("broker", F.col("user_id")))


TCA_SQL = f"""WITH {TICKS}, e AS (SELECT t.event_id, t.price, t.quantity AS shares, 'B' || t.user_id % 4 AS broker, CASE WHEN t.sequence_number % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, q.bid_price AS qb, q.ask_price AS qa
  FROM (SELECT * FROM ticks WHERE event_type = 'TRADE') t ASOF LEFT JOIN (SELECT * FROM ticks WHERE event_type = 'QUOTE') q ON t.instrument_id = q.instrument_id AND t.exchange_timestamp >= q.exchange_timestamp),
  f AS (SELECT *, CASE WHEN qb IS NULL OR qa IS NULL THEN round(price - 0.05::DOUBLE, 4) ELSE qb END AS bid, CASE WHEN qb IS NULL OR qa IS NULL THEN round(price + 0.05::DOUBLE, 4) ELSE qa END AS ask FROM e),
  g AS (SELECT *, (bid + ask) / 2 AS mid, greatest(0.001::DOUBLE, ask - bid) AS qs FROM f),
  h AS (SELECT *, CASE WHEN side = 'BUY' THEN price - mid ELSE mid - price END AS slip, round(greatest(0::DOUBLE, CASE WHEN side = 'BUY' THEN ask - price ELSE price - bid END), 4) AS pi,
    CASE WHEN side = 'BUY' THEN price > ask ELSE price < bid END AS dis FROM g),
  i AS (SELECT *, CASE WHEN mid > 0 THEN slip / mid * 10000::DOUBLE ELSE 0 END AS slip_bps, CASE WHEN mid > 0 THEN 2::DOUBLE * slip / mid * 10000::DOUBLE ELSE 0 END AS es_bps, round(pi * shares, 2) AS pi_usd, pi > 0.0001::DOUBLE AS imp FROM h),
  tca AS (SELECT *, CASE WHEN imp THEN least(100::DOUBLE, 85::DOUBLE + pi / qs * 15::DOUBLE) WHEN dis THEN greatest(0::DOUBLE, 50::DOUBLE - abs(slip_bps) * 2::DOUBLE) ELSE greatest(50::DOUBLE, 85::DOUBLE - (2::DOUBLE * slip / qs - 0.5::DOUBLE) * 30::DOUBLE) END AS score FROM i)
"""
TCA_SUMS = """count(*) AS total_trades, round(sum(shares), 2) AS total_shares, round(sum(price * shares), 2) AS total_notional, round(avg(slip_bps), 2) AS mean_slippage_bps, round(avg(es_bps), 2) AS mean_effective_spread_bps,
  CAST(count(*) FILTER (imp) AS BIGINT) AS improved, CAST(count(*) FILTER (dis) AS BIGINT) AS disimproved, round(sum(pi_usd), 2) AS improvement_usd, round(sum(greatest(0::DOUBLE, slip) * shares), 3) AS slippage_usd"""


def _executions(spark, d):
    rows = joins.as_of(_trades(spark, d), _quotes(spark, d), ["bid_price", "ask_price"])
    return rows.select("event_id", F.col("event_id").alias("trade_id"), "price", F.col("quantity").alias("shares"), F.concat(F.lit("B"), F.col("user_id") % 4).alias("broker"), F.when(F.col("sequence_number") % 2 == 0, "BUY").otherwise("SELL").alias("side"), F.lit(None).cast("double").alias("arrival_price"), F.col("asof_bid_price").alias("bid"), F.col("asof_ask_price").alias("ask"))


@query("tca_executions", TCA_SQL + "SELECT event_id, round(slip_bps, 4) + 0 AS slippage_bps, round(es_bps, 4) + 0 AS effective_spread_bps, pi AS price_improvement_cents, pi_usd AS price_improvement_usd, imp AS is_price_improved, dis AS is_disimproved, round(score, 4) AS quality_score FROM tca")
def tca_executions(spark, d):
    rows = tca.evaluate(_executions(spark, d))
    return rows.select("event_id", (F.round("slippage_bps", 4) + 0.0).alias("slippage_bps"), (F.round("effective_spread_bps", 4) + 0.0).alias("effective_spread_bps"), "price_improvement_cents", "price_improvement_usd", "is_price_improved", "is_disimproved", F.round("quality_score", 4).alias("quality_score"))


@query("tca_batch", TCA_SQL + f", r AS (SELECT slip_bps, row_number() OVER (ORDER BY slip_bps) - 1 AS i, count(*) OVER () AS n FROM tca) SELECT {TCA_SUMS}, round(avg(score), 1) AS overall_quality_score, avg(score) >= 65 AS compliant, (SELECT round(max(slip_bps), 2) FROM r WHERE i = n // 2) AS p50_slippage_bps, (SELECT round(max(slip_bps), 2) FROM r WHERE i = least(n - 1, CAST(floor(n * 0.95::DOUBLE) AS BIGINT))) AS p95_slippage_bps FROM tca")
def tca_batch(spark, d):
    return tca.batch(tca.evaluate(_executions(spark, d)))


@query("tca_scorecards", TCA_SQL + f"SELECT broker, {TCA_SUMS}, round(avg(score), 1) AS quality_score, CASE WHEN avg(score) >= 85 THEN 'TIER 1' WHEN avg(score) >= 70 THEN 'TIER 2' WHEN avg(score) >= 50 THEN 'TIER 3' ELSE 'POOR' END AS rating FROM tca GROUP BY 1")
def tca_scorecards(spark, d):
    return tca.scorecards(tca.evaluate(_executions(spark, d)))


# ---- books ----------------------------------------------------------------------------------------

BOOK_SQL = f"""WITH {TICKS}, o AS (SELECT instrument_id, 'bid' AS side, round(bid_price, 0) + 0 AS price, bid_size AS size, source AS venue FROM ticks WHERE event_type = 'QUOTE' UNION ALL SELECT instrument_id, 'ask', round(ask_price, 0) + 500, ask_size, source FROM ticks WHERE event_type = 'QUOTE'),
  v AS (SELECT instrument_id, side, price, venue, sum(size) AS size FROM o GROUP BY ALL), lv AS (SELECT instrument_id, side, price, sum(size) AS size, count(*) AS order_count FROM v GROUP BY ALL),
  book AS (SELECT *, CAST(row_number() OVER w AS INTEGER) AS level, sum(size) OVER w AS cum_size, sum(size * price) OVER w AS cum_notional FROM lv WINDOW w AS (PARTITION BY instrument_id, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END))
"""


def _venue_levels(spark, d):
    q = _quotes(spark, d)
    side = lambda s, p, z: q.select("instrument_id", F.lit(s).alias("side"), p.alias("price"), F.col(z).alias("size"), F.col("source").alias("venue"))
    rows = side("bid", F.round("bid_price", 0) + 0.0, "bid_size").unionByName(side("ask", F.round("ask_price", 0) + 500, "ask_size"))
    return rows.groupBy("instrument_id", "side", "price", "venue").agg(F.sum("size").alias("size"))


@query("book_levels", BOOK_SQL + "SELECT instrument_id, side, price, size, order_count, level, cum_size, round(cum_notional, 2) AS cum_notional FROM book")
def book_levels(spark, d):
    return B.levels(_venue_levels(spark, d)).drop("venue_sizes").withColumn("cum_notional", F.round("cum_notional", 2))


@query("book_top_10", BOOK_SQL + "SELECT instrument_id, side, level, price, size FROM book WHERE level <= 10")
def book_top_10(spark, d):
    return B.levels(_venue_levels(spark, d)).where("level <= 10").select("instrument_id", "side", "level", "price", "size")


@query("book_walk_buy", BOOK_SQL + """, f AS (SELECT *, greatest(0, least(size, 500 - (cum_size - size))) AS fill FROM book WHERE side = 'ask'), g AS (SELECT instrument_id, sum(fill) AS filled, sum(fill * price) AS cost, arg_min(price, level) AS best FROM f GROUP BY 1)
  SELECT instrument_id, filled, round(cost / filled, 6) AS vwap, best, round((cost / filled - best) / best * 10000::DOUBLE, 4) AS slippage_bps, filled >= 500 AS fully_filled FROM g""")
def book_walk_buy(spark, d):
    return B.walk(B.levels(_venue_levels(spark, d)), "BUY", 500).withColumns({"vwap": F.round("vwap", 6), "slippage_bps": F.round("slippage_bps", 4)})


@query("book_depth_within", BOOK_SQL + """, m AS (SELECT instrument_id, (max(price) FILTER (side = 'bid') + min(price) FILTER (side = 'ask')) / 2 AS mid FROM book GROUP BY 1)
  SELECT instrument_id, round(sum(CASE WHEN side = 'bid' THEN price * size ELSE 0 END), 2) AS bid_notional, round(sum(CASE WHEN side = 'ask' THEN price * size ELSE 0 END), 2) AS ask_notional FROM book JOIN m USING (instrument_id) WHERE abs(price - mid) <= mid * 0.05::DOUBLE GROUP BY 1""")
def book_depth_within(spark, d):
    return B.depth_within(B.levels(_venue_levels(spark, d)), 500).withColumns({c: F.round(c, 2) for c in ("bid_notional", "ask_notional")})


@query("book_crossed_venues", BOOK_SQL + """, b AS (SELECT instrument_id, venue, max(price) FILTER (side = 'bid') AS bid, min(price) FILTER (side = 'ask') - 495 AS ask FROM v GROUP BY 1, 2)
  SELECT x.instrument_id, x.venue AS bid_venue, y.venue AS ask_venue, x.bid, y.ask FROM b x JOIN b y USING (instrument_id) WHERE x.venue <> y.venue AND x.bid > y.ask""")
def book_crossed_venues(spark, d):
    rows = _venue_levels(spark, d).withColumn("price", F.when(F.col("side") == "ask", F.col("price") - 495).otherwise(F.col("price")))
    return B.crossed(rows).select("instrument_id", "bid_venue", "ask_venue", "bid", "ask")


@query("micro_price", f"""WITH {TICKS} SELECT event_id, round((bid_price * ask_size + ask_price * bid_size) / (bid_size + ask_size), 8) AS micro, round((bid_size - ask_size) / (bid_size + ask_size), 6) AS imbalance FROM ticks WHERE event_type = 'QUOTE'""")
def micro_price(spark, d):
    c = [F.col(x) for x in ("bid_price", "ask_price", "bid_size", "ask_size")]
    return _quotes(spark, d).select("event_id", F.round(B.micro_price(*c), 8).alias("micro"), F.round(B.imbalance(c[2], c[3]), 6).alias("imbalance"))


@query("queue_positions", f"""WITH {TICKS}, o AS (SELECT event_id, instrument_id, 'bid' AS side, round(bid_price / 50, 0) + 0 AS price, bid_size AS size, sequence_number AS priority FROM ticks WHERE event_type = 'QUOTE')
  SELECT event_id, CAST(count(*) OVER w AS BIGINT) AS orders_ahead, coalesce(sum(size) OVER w, 0) AS size_ahead, round((1 - coalesce(sum(size) OVER w, 0) / sum(size) OVER (PARTITION BY instrument_id, side, price)) * 100, 6) AS fill_probability_pct
  FROM o WINDOW w AS (PARTITION BY instrument_id, side, price ORDER BY priority ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def queue_positions(spark, d):
    o = _quotes(spark, d).select("event_id", "instrument_id", F.lit("bid").alias("side"), (F.round(F.col("bid_price") / 50, 0) + 0.0).alias("price"), F.col("bid_size").alias("size"), F.col("sequence_number").alias("priority"))
    return B.queue_positions(o).select("event_id", "orders_ahead", "size_ahead", R6("fill_probability_pct"))


@query("daily_ticks_by_bucket", f"WITH {TICKS} SELECT floor(exchange_timestamp / 3600::DOUBLE) * 3600::DOUBLE AS bucket, event_type, count(*) AS n FROM ticks GROUP BY 1, 2")
def daily_ticks_by_bucket(spark, d):
    return ticks(spark, d).groupBy(bucket("exchange_timestamp", 3600).alias("bucket"), "event_type").agg(F.count(F.lit(1)).alias("n"))
