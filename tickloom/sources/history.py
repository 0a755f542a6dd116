"""History on disk: partitions by day and symbol, exports, retention, and reading back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.schema import symbol_filter

PARTS = ("year", "month", "day", "symbol")


def _dated(ticks: DataFrame) -> DataFrame:
    at = F.timestamp_micros((F.col("exchange_timestamp") * 1e6).cast("long"))
    return ticks.withColumns({"year": F.year(at), "month": F.month(at), "day": F.dayofmonth(at), "symbol": F.regexp_replace("instrument_id", "/", "-")})


def write_history(ticks: DataFrame, path: str, mode: str = "append", fmt: str = "parquet") -> None:
    """Partition by year, month, day and symbol. Rows of a partition meet in few tasks; a hot one is split by its rebalance."""
    rows = _dated(ticks)
    rows = rows.hint("rebalance", *PARTS).sortWithinPartitions(*PARTS, "exchange_timestamp")
    writer = rows.write.mode(mode).partitionBy(*PARTS).format(fmt)
    (writer.option("compression", "zstd") if fmt == "parquet" else writer.option("compression", "gzip")).save(path)


def scan_history(spark: SparkSession, path: str, symbol: str | None = None, start: float | None = None, end: float | None = None, columns: list[str] | None = None) -> DataFrame:
    """Ticks of a symbol and time range, both ends included. Days outside are pruned, columns read as asked."""
    rows = spark.read.parquet(path)
    if symbol is not None and symbol.upper() not in ("ALL", "*"):
        rows = rows.where(F.col("symbol").isin(symbol.upper().replace("/", "-"), symbol.upper())).where(symbol_filter(symbol))
    date = F.make_date("year", "month", "day")
    if start is not None:
        rows = rows.where((date >= F.to_date(F.timestamp_micros(F.lit(int(start * 1e6))))) & (F.col("exchange_timestamp") >= start))
    if end is not None:
        rows = rows.where((date <= F.to_date(F.timestamp_micros(F.lit(int(end * 1e6))))) & (F.col("exchange_timestamp") <= end))
    return rows.select(*columns) if columns else rows


def export(rows: DataFrame, path: str, fmt: str = "parquet", symbol: str | None = None, limit: int | None = None, compression: str = "zstd", partition_by: list[str] | None = None) -> None:
    """Rows of a symbol in order of time, as parquet, json or csv."""
    if fmt not in ("parquet", "json", "csv"):
        raise ValueError(f"unknown format {fmt}")
    out = rows.where(symbol_filter(symbol))
    if "date" in (partition_by or []) and "date" not in out.columns:
        out = out.withColumn("date", F.to_date(F.timestamp_micros((F.col("exchange_timestamp") * 1e6).cast("long"))))
    if limit is not None:
        out = out.orderBy("exchange_timestamp").limit(limit)
    out = out.sortWithinPartitions(*(partition_by or []), "exchange_timestamp") if partition_by else out.orderBy("exchange_timestamp")
    if fmt == "csv":
        out = out.select(*(F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in out.dtypes))
    writer = out.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "parquet":
        writer = writer.option("compression", compression)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def retained(rows: DataFrame, now: float, days: float) -> DataFrame:
    """The rows that a retention of so many days keeps, by processing, else exchange time."""
    return rows.where(F.coalesce("processing_timestamp", "exchange_timestamp") >= now - days * 86400)


def expired_partitions(manifest: DataFrame, cutoff: float) -> DataFrame:
    """Partitions whose newest row is older than the cutoff."""
    return manifest.where(F.col("max_ts") < cutoff)


def sync(store: DataFrame | None, origin: DataFrame) -> DataFrame:
    """Rows of origin that the store lacks: from its newest time on, without events that it has."""
    from tickloom.operators.joins import unseen

    if store is None:
        return unseen(origin, origin.limit(0))
    newest = store.agg(F.max("exchange_timestamp").alias("_t"))
    return unseen(origin.crossJoin(newest).where(F.col("_t").isNull() | (F.col("exchange_timestamp") >= F.col("_t"))).drop("_t"), store)


def verify_log(frames: DataFrame) -> DataFrame:
    """Frames of a log (offset, valid) with what is wrong: BAD_CRC, or a GAP before them."""
    from pyspark.sql import Window

    before = F.lag("offset").over(Window.partitionBy("segment").orderBy("offset"))
    return frames.withColumn("fault", F.when(~F.col("valid"), "BAD_CRC").when(F.col("offset") != before + 1, "GAP"))


def write_archive(raw: DataFrame, path: str) -> None:
    """Raw events (source, receive_timestamp, payload, ...) as gzipped JSON lines by date and source."""
    at = F.timestamp_micros((F.col("receive_timestamp") * 1e6).cast("long"))
    raw.withColumn("date", F.to_date(at)).write.mode("append").partitionBy("date", "source").option("compression", "gzip").json(path)


def replay_archive(spark: SparkSession, path: str, date: str | None = None, source: str | None = None) -> DataFrame:
    """Archived events of a date and source, in order of receipt."""
    rows = spark.read.json(path)
    if date is not None:
        rows = rows.where(F.col("date") == F.lit(date).cast("date"))
    if source is not None:
        rows = rows.where(F.col("source") == source)
    return rows.orderBy("receive_timestamp", "raw_id")


def hours(start: float, end: float) -> list[str]:
    """Partitions YYYY-MM-DD/HH (UTC) that a time range [start, end) touches."""
    import datetime as dt

    first = int(start // 3600)
    last = int(-(-end // 3600))
    return [dt.datetime.fromtimestamp(h * 3600, dt.timezone.utc).strftime("%Y-%m-%d/%H") for h in range(first, last)]


def read_hours(spark: SparkSession, root: str, start: float, end: float) -> DataFrame:
    """Rows received in [start, end) (received_time in nanoseconds) from hourly Parquet partitions, with the file that each came from."""
    rows = spark.read.option("ignoreMissingFiles", True).parquet(*(f"{root}/{h}" for h in hours(start, end)))
    return rows.where((F.col("received_time") >= int(start * 1e9)) & (F.col("received_time") < int(end * 1e9))).withColumn("file", F.input_file_name())


def strict_ns(ts, unit: str = "auto"):
    """Nanoseconds of an epoch column in s, ms, us or ns; auto takes the one unit that falls between 2000 and 2100, and fails if there is none."""
    scale = {"s": 10**9, "ms": 10**6, "us": 10**3, "ns": 1}
    low, high = 946_684_800 * 10**9, 4_102_444_800 * 10**9
    if unit != "auto":
        return (ts.cast("decimal(38,9)") * scale[unit]).cast("long")
    tries = [(ts.cast("decimal(38,9)") * m).cast("decimal(38,0)") for m in scale.values()]
    fits = [F.when((t >= low) & (t < high), t.cast("long")) for t in tries]
    return F.when(ts.isNull(), None).otherwise(F.coalesce(*fits, F.raise_error(F.concat(F.lit("no unit fits "), ts.cast("string"))).cast("long")))


def first_seen_ids(rows: DataFrame, column: str, order: str = "exchange_timestamp") -> DataFrame:
    """Each value of a column and its number in the order of first appearance, from 0. Values are few next to rows."""
    from pyspark.sql import Window

    first = rows.groupBy(column).agg(F.min(order).alias("_at"))
    return first.select(column, (F.row_number().over(Window.orderBy("_at", column)) - 1).alias("id"))
