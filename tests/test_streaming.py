"""Streams give what batch gives."""

from pyspark.sql import functions as F

from tickloom.operators import aggregates as A
from tickloom.operators import quality_state
from tickloom.schema import TICK
from tickloom.sources import simulator
from tickloom.streaming import ticks as S


def test_bars_and_verdicts(spark, tmp_path):
    sim = simulator.simulate(spark, 4000)
    sim = sim.select(*(F.col(f.name) if f.name in sim.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in TICK)).persist()
    sim.repartition(3).write.parquet(str(tmp_path / "in"))
    q = S.bars(S.read_ticks(spark, str(tmp_path / "in"), 10), "5 seconds", "1 hour").writeStream.format("memory").queryName("bars").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    key = ["instrument_id", "bucket", "open", "high", "low", "close", "volume", "trade_count"]
    stream = {tuple(round(v, 4) if isinstance(v, float) else v for v in r) for r in spark.table("bars").select(key).collect()}
    batch = {tuple(round(v, 4) if isinstance(v, float) else v for v in r) for r in A.ohlcv(sim, interval=5.0).select(key).collect()}
    assert {(*r[:2], r[3], r[4], r[7]) for r in stream} == {(*r[:2], r[3], r[4], r[7]) for r in batch}
    judged = quality_state.judge_stream(S.read_ticks(spark, str(tmp_path / "in"), 10))
    S.write_split(judged, str(tmp_path / "good"), str(tmp_path / "held"), str(tmp_path / "state")).awaitTermination()
    wanted = {r["event_id"]: r["quality_status"] for r in quality_state.judge_batch(sim).collect()}
    good = {r["event_id"] for r in spark.read.parquet(str(tmp_path / "good")).collect()}
    held = {r["event_id"] for r in spark.read.parquet(str(tmp_path / "held")).collect()}
    assert good == {k for k, v in wanted.items() if v != "INVALID"} and held == {k for k, v in wanted.items() if v != "VALID"}


def test_dedup_within_watermark(spark, tmp_path):
    sim = simulator.simulate(spark, 3000)
    sim = sim.select(*(F.col(f.name) if f.name in sim.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in TICK))
    sim.repartition(2).write.parquet(str(tmp_path / "in"))
    q = S.deduplicated(S.read_ticks(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == sim.select("source", "instrument_id", "sequence_number").distinct().count()
