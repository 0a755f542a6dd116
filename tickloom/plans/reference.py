"""Queries over reference data, state machines, binary formats and replays."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import reference_data as R
from tickloom.operators import joins, machines, quality_state, rules
from tickloom.plans.catalog import TICKS, query
from tickloom.plans.market import _quotes, _trades
from tickloom.sources import binary, wire
from tickloom.sources.tables import table, ticks


def _symbols(spark, d):
    """A symbol for every customer: some with suffixes, some numeric."""
    k = F.col("c_custkey")
    ends = F.element_at(F.array(*map(F.lit, ("", ".NS", ".DE", ".T", ".L", ".PA"))), (k % 6 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", F.when(k % 7 == 0, F.lpad((k % 10000).cast("string"), 4, "0")).otherwise(F.concat(F.lit("sym"), k.cast("string"), ends)).alias("symbol"))


@query("symbols_resolved", """WITH s AS (SELECT c_custkey, upper(CASE WHEN c_custkey % 7 = 0 THEN lpad((c_custkey % 10000)::VARCHAR, 4, '0') ELSE 'sym' || c_custkey || ['', '.NS', '.DE', '.T', '.L', '.PA'][c_custkey % 6 + 1] END) AS raw FROM customer),
  e AS (SELECT *, regexp_extract(raw, '\\.(NS|DE|T|L|PA)$', 1) AS x, regexp_matches(raw, '^[0-9]{4}$') AS n FROM s)
  SELECT c_custkey, CASE WHEN n THEN raw || '.T' ELSE raw END AS canonical_id, CASE WHEN x <> '' THEN raw[:-(len(x) + 2)] ELSE raw END AS ticker,
  CASE WHEN n OR x = 'T' THEN 'XTKS' WHEN x = 'NS' THEN 'XNSE' WHEN x = 'DE' THEN 'XETR' WHEN x = 'L' THEN 'XLON' WHEN x = 'PA' THEN 'XPAR' ELSE 'XNAS' END AS venue,
  CASE WHEN n OR x = 'T' THEN 'JPY' WHEN x = 'NS' THEN 'INR' WHEN x IN ('DE', 'PA') THEN 'EUR' WHEN x = 'L' THEN 'GBP' ELSE 'USD' END AS currency FROM e""")
def symbols_resolved(spark, d):
    return R.resolve(_symbols(spark, d)).select("c_custkey", "canonical_id", "ticker", "venue", "currency")


def _bands(name: str) -> str:
    bounds, sizes = R.TICK_TABLES[name]
    op = "<=" if name in R.CLOSED else "<"
    return "CASE WHEN price <= 0 THEN 0.01 " + " ".join(f"WHEN price {op} {b} THEN {s}" for b, s in zip(bounds, sizes)) + f" ELSE {sizes[-1]} END::DOUBLE"


@query("tick_sizes", f"WITH {TICKS} SELECT event_id, {_bands('MIFID2')} AS mifid, {_bands('NSE_DYNAMIC')} AS nse, {_bands('TSE_TIERED')} AS tse FROM ticks WHERE event_type = 'TRADE'")
def tick_sizes(spark, d):
    p = F.col("price")
    return _trades(spark, d).select("event_id", R.tick_size(p, "MIFID2").alias("mifid"), R.tick_size(p, "NSE_DYNAMIC").alias("nse"), R.tick_size(p, "TSE_TIERED").alias("tse"))


@query("session_phases", f"""WITH {TICKS}, h AS (SELECT event_id, extract(isodow FROM t) AS wd, extract(hour FROM t) + extract(minute FROM t) / 60::DOUBLE + floor(extract(second FROM t)) / 3600::DOUBLE AS h FROM (SELECT event_id, to_timestamp(exchange_timestamp) AT TIME ZONE 'UTC' AS t FROM ticks))
  SELECT event_id, CASE WHEN wd >= 6 THEN CASE WHEN wd = 7 AND h >= 13 AND h < 14.5::DOUBLE THEN 'PRE_OPEN' ELSE 'CLOSED' END WHEN h >= 13 AND h < 14.5::DOUBLE THEN 'PRE_OPEN' WHEN h >= 20.5::DOUBLE AND h < 21 THEN 'CLOSING_AUCTION' WHEN h >= 14.5::DOUBLE AND h < 21 THEN 'CONTINUOUS' WHEN h >= 21 AND h < 22 THEN 'POST_CLOSE' ELSE 'CLOSED' END AS phase FROM h""")
def session_phases(spark, d):
    return ticks(spark, d).select("event_id", R.session_phase(F.col("exchange_timestamp"), 14.5, 21.0, 13.0, 20.5).alias("phase"))


@query("fixed_point_prices", f"WITH {TICKS} SELECT event_id, CAST(round(price * 1e8) AS BIGINT) AS price_fp FROM ticks WHERE event_type = 'TRADE'")
def fixed_point_prices(spark, d):
    return _trades(spark, d).select("event_id", R.fixed_point(F.col("price")).alias("price_fp"))


@query("money_formatted")
def money_formatted(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", *(R.money(F.col("c_acctbal") * 1000, code).alias(code.lower()) for code in ("USD", "INR", "JPY", "EUR")))


@query("input_checked", f"WITH {TICKS} SELECT CASE WHEN sequence_number % 11 = 0 THEN 'symbol' WHEN sequence_number % 13 = 0 THEN 'price' END AS error, count(*) AS n FROM ticks WHERE event_type = 'TRADE' GROUP BY 1")
def input_checked(spark, d):
    t = _trades(spark, d)
    payload = F.to_json(F.struct(F.when(F.col("sequence_number") % 11 == 0, F.lit("bad<symbol>")).otherwise(F.col("instrument_id")).alias("instrument"), F.when(F.col("sequence_number") % 13 == 0, F.lit(-1.0)).otherwise(F.col("price")).alias("price"), "quantity", F.col("sequence_number").alias("sequence")))
    return t.select(R.input_error(payload).alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query("config_cascade", f"""WITH {TICKS}, i AS (SELECT DISTINCT instrument_id, CASE WHEN instrument_id IN ('I1', 'I2', 'I3') THEN 'XNSE' ELSE 'XNAS' END AS venue FROM ticks)
  SELECT instrument_id, CASE WHEN instrument_id = 'I1' THEN 9 WHEN venue = 'XNSE' THEN 7 ELSE 6 END::DOUBLE AS deviations, CASE WHEN venue = 'XNSE' THEN 0.5 ELSE 0.05 END::DOUBLE AS stale_s FROM i""")
def config_cascade(spark, d):
    own = ticks(spark, d).select("instrument_id").distinct().withColumns({"venue": F.when(F.col("instrument_id").isin("I1", "I2", "I3"), "XNSE").otherwise("XNAS"), "asset_class": F.lit("EQUITY")})
    one = spark.range(1)
    venues = one.select(F.lit("XNSE").alias("venue"), F.lit(7.0).alias("deviations"), F.lit(0.5).alias("stale_s"))
    classes = one.select(F.lit("CRYPTO").alias("asset_class"), F.lit(12.0).alias("deviations"))
    instruments = one.select(F.lit("I1").alias("instrument_id"), F.lit(9.0).alias("deviations"))
    return R.effective_config(own, {"deviations": 6.0, "stale_s": 0.05}, venues, classes, instruments)


@query("source_states")
def source_states(spark, d):
    return machines.watch(ticks(spark, d), {"S0": 0.95, "S1": 0.92, "S2": 0.85}, silent_s=7200.0)


@query("alerts_of_every_kind")
def alerts_of_every_kind(spark, d):
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(v).alias("threshold"), F.lit(r).alias("repeat")) for k, v, r in (("price_above", 150.0, True), ("price_below", 1.0, True), ("spread_above", 20.0, False), ("volume", 99.0, True), ("change_pct", 300.0, True))))
    wanted = ticks(spark, d).select("instrument_id").distinct().select("instrument_id", F.explode(kinds).alias("k")).select(F.concat_ws("-", "instrument_id", "k.kind").alias("alert_id"), "instrument_id", "k.*", F.lit(None).cast("double").alias("expiry"))
    return machines.alerts(ticks(spark, d), wanted)


@query("rate_limits")
def rate_limits(spark, d):
    return machines.rate_limited(ticks(spark, d), per_second=0.0005, burst=5.0)


@query("reorder_buffer")
def reorder_buffer(spark, d):
    return machines.reorder(ticks(spark, d), slots=64, window_s=3600.0)


@query("feed_recovered")
def feed_recovered(spark, d):
    t = ticks(spark, d)
    live = t.where("sequence_number % 17 <> 0").select(F.lit("c").alias("channel"), (F.col("sequence_number") * 3).alias("ordinal"), F.when(F.col("sequence_number") == 1, "snapshot").otherwise("live").alias("kind"), F.col("sequence_number").alias("sequence"), F.col("exchange_timestamp").alias("ts"))
    again = t.where("sequence_number % 17 = 0").select(F.lit("c").alias("channel"), (F.col("sequence_number") * 3 + 7).alias("ordinal"), F.lit("replay").alias("kind"), F.col("sequence_number").alias("sequence"), F.col("exchange_timestamp").alias("ts"))
    return machines.recover(live.unionByName(again))


@query("matching_engine")
def matching_engine(spark, d):
    """An order for every trade: bids at its price and asks by turns, every fifth one at the market, every fourth one to be cancelled after an hour."""
    t, n = _trades(spark, d), F.col("sequence_number")
    orders = t.select(F.concat(F.lit("o-"), "event_id").alias("order_id"), "instrument_id", F.when(n % 2 == 1, "BUY").otherwise("SELL").alias("side"), F.when(n % 5 == 1, None).otherwise(F.col("price")).alias("price"), F.lit(10.0).alias("quantity"), "exchange_timestamp", F.when(n % 4 == 3, F.col("exchange_timestamp") + 3600).alias("cancel_ts"))
    return machines.match(ticks(spark, d), orders)


@query("replay_equivalence")
def replay_equivalence(spark, d):
    """Digests of the verdicts of two runs, one over rows in another order and partitioning; they are equal."""
    t = ticks(spark, d)
    runs = [machines.replay_digest(quality_state.judge_batch(x).select("event_id", "quality_status", F.array_join("reasons", ",").alias("r")), ["event_id", "quality_status", "r"]).withColumn("run", F.lit(i)) for i, x in enumerate((t, t.orderBy(F.desc("event_id"))))]
    return runs[0].unionByName(runs[1])


@query("provenance", f"WITH {TICKS} SELECT event_id, sha256(instrument_id || ':' || event_id) AS payload_sha256 FROM ticks")
def provenance(spark, d):
    t = ticks(spark, d).withColumn("raw_id", F.concat(F.lit("r"), "event_id"))
    raw = t.select("raw_id", F.concat_ws(":", "instrument_id", "event_id").alias("payload"))
    return machines.provenance(raw, rules.judge(t)).select("event_id", "payload_sha256")


@query("entitled_rows", f"WITH {TICKS} SELECT event_id FROM ticks WHERE source = 'S1' AND instrument_id IN ('I1', 'I5')")
def entitled_rows(spark, d):
    allowed = spark.range(1).select(F.explode(F.array(F.lit("I1"), F.lit("I5"))).alias("instrument_id"))
    return joins.subscribed(ticks(spark, d).where("source = 'S1'"), allowed).select("event_id")


@query("dbn_decoded", f"WITH {TICKS} SELECT 'DBN_' || user_id AS instrument_id, round(price, 6) AS price, quantity FROM ticks WHERE event_type = 'TRADE'")
def dbn_decoded(spark, d):
    """Trades packed into DBN records by column expressions and decoded again."""
    little = lambda c, n: F.unhex(F.concat(*(F.lpad(F.hex(F.shiftrightunsigned(c, 8 * i).bitwiseAND(255)), 2, "0") for i in range(n))))
    t, zero = _trades(spark, d), F.lit(0).cast("long")
    nanos = F.round(F.col("exchange_timestamp") * 1e6).cast("long") * 1000
    raw = F.concat(little(F.lit(12).cast("long"), 1), little(F.lit(0x15).cast("long"), 1), little(F.lit(1).cast("long"), 2), little(F.col("user_id"), 4), little(nanos, 8), little(F.rint(F.col("price") * 1e9).cast("long"), 8), little(F.col("quantity").cast("long"), 4), little(zero, 4), little(nanos, 8), little(zero, 4), little(F.col("sequence_number"), 4))
    return binary.decode(t.select(raw.alias("raw")), "dbn").select("instrument_id", F.round("price", 6).alias("price"), "quantity")


@query("log_verified", f"WITH {TICKS} SELECT true AS valid, count(*) AS n FROM ticks WHERE event_type = 'QUOTE'")
def log_verified(spark, d):
    """Quotes framed as a log and read back; the frames' checksums are verified."""

    def frames(batches):
        import pyarrow as pa

        for b in batches:
            rows = [wire.log_frame(n, ts, e.encode()) for n, ts, e in zip(*(b.column(c).to_pylist() for c in ("sequence_number", "exchange_timestamp", "event_id")))]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["content"])

    content = _quotes(spark, d).select("sequence_number", "exchange_timestamp", "event_id").mapInArrow(frames, "content binary")
    return wire.decode_log(content).groupBy("valid").agg(F.count(F.lit(1)).alias("n"))
