"""Decoders of wire formats: FIX, ITCH-like and SBE-like binary records, PCAP, vendors' JSON.

Text formats are decoded by column expressions. Binary ones go through Arrow batches, one message to many
rows at most as many as the message holds.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SOH = "\x01"


def fix_fields(message: Column) -> Column:
    """Tag -> value of a FIX message; the last of repeated tags counts."""
    pairs = F.filter(F.split(message, SOH), lambda p: p.contains("="))
    return F.map_from_entries(F.transform(F.array_distinct(F.transform(pairs, lambda p: F.substring_index(p, "=", 1))), lambda tag: F.struct(tag.alias("key"), F.element_at(F.transform(F.filter(pairs, lambda p: F.substring_index(p, "=", 1) == tag), lambda p: F.substring(p, F.length(tag) + 2, 1 << 30)), -1).alias("value"))))


def fix_valid(message: Column) -> Column:
    """Whether the checksum in tag 10 is the sum of the bytes before it modulo 256 (for ASCII messages)."""
    body = F.regexp_extract(message, f"(?s)^(.*{SOH})10=[0-9]+{SOH}?$", 1)
    total = F.aggregate(F.transform(F.split(body, ""), lambda c: F.ascii(c)), F.lit(0), lambda a, x: a + x)
    return F.coalesce((F.length(body) > 0) & (total % 256 == F.regexp_extract(message, f"{SOH}10=([0-9]+)", 1).cast("int")), F.lit(False))


def fix_encode(fields: list[tuple[int, str]]) -> str:
    """A message of these fields with its checksum; body length is put in after the version."""
    rest = "".join(f"{t}={v}{SOH}" for t, v in fields if t not in (8, 9, 10))
    head = f"8={dict(fields).get(8, 'FIX.4.4')}{SOH}9={len(rest)}{SOH}"
    return f"{head}{rest}10={sum((head + rest).encode()) % 256:03d}{SOH}"


#: Layouts of ITCH messages after the type byte (locate, tracking, 6-byte time, then fields), and the price divisor.
ITCH = {
    "A": (">HH6sQcI8sI", ("order_id", "side", "size", "symbol", "price")),
    "F": (">HH6sQcI8sI4s", ("order_id", "side", "size", "symbol", "price", "attribution")),
    "E": (">HH6sQIQ", ("order_id", "size", "match")),
    "C": (">HH6sQIQcI", ("order_id", "size", "match", "printable", "price")),
    "X": (">HH6sQI", ("order_id", "size")),
    "D": (">HH6sQ", ("order_id",)),
    "U": (">HH6sQQII", ("order_id", "new_order_id", "size", "price")),
    "P": (">HH6sQcI8sIQ", ("order_id", "side", "size", "symbol", "price", "match")),
    "Q": (">HH6sQ8sIQc", ("size", "symbol", "price", "match", "cross_type")),
    "S": (">HH6sc", ("event",)),
    "H": (">HH6s8scc4s", ("symbol", "state", "reserved", "reason")),
    "R": (">HH6s8sccIcc2scccccIc", ("symbol", "category", "status", "round_lot")),
    "B": (">HH6sQ", ("match",)),
    "I": (">HH6sQQc8sIIIcc", ("paired", "imbalance", "direction", "symbol")),
}
ITCH_PRICE = 10_000.0
ITCH_SCHEMA = "message_type string, nanoseconds long, order_id long, new_order_id long, side string, size long, symbol string, price double, match long, event string"


def itch_message(raw: bytes) -> dict | None:
    """One ITCH message (type byte first); None if its type or length is unknown."""
    kind = raw[:1].decode("latin-1")
    if kind not in ITCH:
        return None
    layout, names = ITCH[kind]
    if len(raw) - 1 < struct.calcsize(layout):
        return None
    _, _, when, *values = struct.unpack_from(layout, raw, 1)
    out: dict = {"message_type": kind, "nanoseconds": int.from_bytes(when, "big")}
    for name, value in zip(names, values):
        out[name] = value.decode("latin-1").strip() if isinstance(value, bytes) else value
    if "price" in out:
        out["price"] = out["price"] / ITCH_PRICE
    if "side" in out:
        out["side"] = {"B": "bid", "S": "ask"}.get(out["side"], out["side"])
    return out


def decode_itch(frames: DataFrame, column: str = "raw") -> DataFrame:
    """A row for every length-prefixed ITCH message in the frames; unknown ones are passed over."""

    def rows(raw: bytes) -> Iterator[dict]:
        at = 0
        while at + 2 <= len(raw):
            size = int.from_bytes(raw[at : at + 2], "big")
            found = itch_message(raw[at + 2 : at + 2 + size])
            at += 2 + size
            if found:
                yield found

    return _decoded(frames, column, rows, ITCH_SCHEMA)


def pcap_packets(raw: bytes) -> Iterator[dict]:
    """Packets of a PCAP file of either byte order, with micro- or nanosecond times."""
    if len(raw) < 24:
        return
    magic = raw[:4]
    order, scale = {b"\xd4\xc3\xb2\xa1": ("<", 1e-6), b"\xa1\xb2\xc3\xd4": (">", 1e-6), b"\x4d\x3c\xb2\xa1": ("<", 1e-9), b"\xa1\xb2\x3c\x4d": (">", 1e-9)}.get(magic, (None, 0))
    at = 24
    while order and at + 16 <= len(raw):
        seconds, part, kept, size = struct.unpack_from(order + "IIII", raw, at)
        yield {"ts": seconds + part * scale, "length": size, "payload": raw[at + 16 : at + 16 + kept]}
        at += 16 + kept


def decode_pcap(files: DataFrame, column: str = "content") -> DataFrame:
    """ts, length, payload of every packet; files: as spark.read.format('binaryFile') gives them."""
    return _decoded(files, column, pcap_packets, "ts double, length long, payload binary")


def mold_messages(payload: bytes) -> Iterator[dict]:
    """Messages of a MoldUDP64 packet with their sequence numbers."""
    if len(payload) < 20:
        return
    session, first, count = payload[:10].decode("latin-1").strip(), *struct.unpack_from(">QH", payload, 10)
    at = 20
    for i in range(count if count != 0xFFFF else 0):
        if at + 2 > len(payload):
            return
        size = int.from_bytes(payload[at : at + 2], "big")
        yield {"session": session, "sequence": first + i, "message": payload[at + 2 : at + 2 + size]}
        at += 2 + size


def decode_mold(packets: DataFrame, column: str = "payload") -> DataFrame:
    return _decoded(packets, column, mold_messages, "session string, sequence long, message binary")


#: A log frame's header (magic, version, offset, time, length), and its magic.
FRAME = ">HHQdI"
FRAME_MAGIC = 0xAA55


def log_frame(offset: int, ts: float, payload: bytes) -> bytes:
    head = struct.pack(FRAME, FRAME_MAGIC, 2, offset, ts, len(payload))
    return head + struct.pack(">I", zlib.crc32(head + payload)) + payload


def log_frames(raw: bytes) -> Iterator[dict]:
    """Frames of a log segment, with whether the checksum holds; ends at the first that is cut short or no frame."""
    size, at = struct.calcsize(FRAME), 0
    while at + size + 4 <= len(raw):
        magic, _, offset, ts, length = struct.unpack_from(FRAME, raw, at)
        if magic != FRAME_MAGIC or at + size + 4 + length > len(raw):
            return
        (crc,) = struct.unpack_from(">I", raw, at + size)
        payload = raw[at + size + 4 : at + size + 4 + length]
        yield {"offset": offset, "ts": ts, "payload": payload, "valid": zlib.crc32(raw[at : at + size] + payload) == crc}
        at += size + 4 + length


def decode_log(files: DataFrame, column: str = "content") -> DataFrame:
    return _decoded(files, column, log_frames, "offset long, ts double, payload binary, valid boolean")


def _decoded(frames: DataFrame, column: str, rows, schema: str) -> DataFrame:
    names = [p.strip().split(" ")[0] for p in schema.split(",")]
    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_()}
    arrow = pa.schema([pa.field(p.strip().split(" ")[0], kinds[p.strip().split(" ")[1]]) for p in schema.split(",")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [r for raw in batch.column(0).to_pylist() if raw for r in rows(raw)]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in found], f.type) for n, f in zip(names, arrow)], schema=arrow)

    return frames.select(column).mapInArrow(run, schema)


# ---- vendors' JSON --------------------------------------------------------------------------------


def _tick(kind: str, source: str, instrument: Column, ts: Column, price=None, quantity=None, bid=None, bid_size=None, ask=None, ask_size=None, sequence=None) -> list[Column]:
    d = lambda c: (F.lit(None) if c is None else c).cast("double")
    return [F.lit(source).alias("source"), F.lit(kind).alias("event_type"), instrument.alias("instrument_id"), ts.cast("double").alias("exchange_timestamp"), (F.lit(None) if sequence is None else sequence).cast("long").alias("sequence_number"), d(price).alias("price"), d(quantity).alias("quantity"), d(bid).alias("bid_price"), d(bid_size).alias("bid_size"), d(ask).alias("ask_price"), d(ask_size).alias("ask_size")]


def _j(path: str, column: str = "payload") -> Column:
    return F.get_json_object(column, path)


def parse_vendor(raw: DataFrame, vendor: str) -> DataFrame:
    """Ticks of a vendor's JSON in `payload`: binance, coinbase, kraken, okx, bybit or polygon. Messages of other kinds give no row."""
    iso = lambda c: F.unix_micros(F.to_timestamp(c)) / F.lit(1e6)
    ms = lambda c: c.cast("double") / F.lit(1e3)
    if vendor == "binance":
        trades = raw.where(_j("$.e") == "trade").select(*_tick("TRADE", "BINANCE", _j("$.s"), ms(_j("$.T")), _j("$.p"), _j("$.q"), sequence=_j("$.t")))
        quotes = raw.where(_j("$.b").isNotNull() & _j("$.a").isNotNull() & (F.coalesce(_j("$.e"), F.lit("bookTicker")) == "bookTicker")).select(*_tick("QUOTE", "BINANCE", _j("$.s"), ms(F.coalesce(_j("$.T"), _j("$.E"))), bid=_j("$.b"), bid_size=_j("$.B"), ask=_j("$.a"), ask_size=_j("$.A")))
        return trades.unionByName(quotes)
    if vendor == "coinbase":
        trades = raw.where(_j("$.type").isin("match", "last_match")).select(*_tick("TRADE", "COINBASE", _j("$.product_id"), iso(_j("$.time")), _j("$.price"), _j("$.size"), sequence=_j("$.sequence")))
        quotes = raw.where(_j("$.type") == "ticker").select(*_tick("QUOTE", "COINBASE", _j("$.product_id"), iso(_j("$.time")), bid=_j("$.best_bid"), bid_size=_j("$.best_bid_size"), ask=_j("$.best_ask"), ask_size=_j("$.best_ask_size"), sequence=_j("$.sequence")))
        return trades.unionByName(quotes)
    if vendor == "kraken":
        data = raw.where(_j("$.channel").isin("trade", "ticker")).select(_j("$.channel").alias("channel"), F.explode(F.from_json(_j("$.data"), "array<string>")).alias("payload"))
        trades = data.where("channel = 'trade'").select(*_tick("TRADE", "KRAKEN", _j("$.symbol"), iso(_j("$.timestamp")), _j("$.price"), _j("$.qty"), sequence=_j("$.trade_id")))
        quotes = data.where("channel = 'ticker'").select(*_tick("QUOTE", "KRAKEN", _j("$.symbol"), iso(_j("$.timestamp")), bid=_j("$.bid"), bid_size=_j("$.bid_qty"), ask=_j("$.ask"), ask_size=_j("$.ask_qty")))
        return trades.unionByName(quotes)
    if vendor == "okx":
        data = raw.where(_j("$.arg.channel").isin("trades", "tickers")).select(_j("$.arg.channel").alias("channel"), F.explode(F.from_json(_j("$.data"), "array<string>")).alias("payload"))
        trades = data.where("channel = 'trades'").select(*_tick("TRADE", "OKX", _j("$.instId"), ms(_j("$.ts")), _j("$.px"), _j("$.sz"), sequence=_j("$.tradeId")))
        quotes = data.where("channel = 'tickers'").select(*_tick("QUOTE", "OKX", _j("$.instId"), ms(_j("$.ts")), bid=_j("$.bidPx"), bid_size=_j("$.bidSz"), ask=_j("$.askPx"), ask_size=_j("$.askSz")))
        return trades.unionByName(quotes)
    if vendor == "bybit":
        trades = raw.where(_j("$.topic").startswith("publicTrade")).select(F.explode(F.from_json(_j("$.data"), "array<string>")).alias("payload")).select(*_tick("TRADE", "BYBIT", _j("$.s"), ms(_j("$.T")), _j("$.p"), _j("$.v"), sequence=_j("$.seq")))
        quotes = raw.where(_j("$.topic").startswith("tickers")).select(*_tick("QUOTE", "BYBIT", _j("$.data.symbol"), ms(_j("$.ts")), bid=_j("$.data.bid1Price"), bid_size=_j("$.data.bid1Size"), ask=_j("$.data.ask1Price"), ask_size=_j("$.data.ask1Size")))
        return trades.unionByName(quotes)
    if vendor == "polygon":
        t = _j("$.t").cast("double")
        at = F.when(t > 1e15, t / 1e9).when(t > 1e11, t / 1e3).otherwise(t)
        good = (_j("$.p").cast("double") > 0) & (_j("$.s").cast("double") > 0)
        trades = raw.where((_j("$.ev") == "T") & good).select(*_tick("TRADE", "POLYGON", _j("$.sym"), at, _j("$.p"), _j("$.s"), sequence=_j("$.q")))
        quotes = raw.where(_j("$.ev") == "Q").select(*_tick("QUOTE", "POLYGON", _j("$.sym"), at, bid=_j("$.bp"), bid_size=_j("$.bs"), ask=_j("$.ap"), ask_size=_j("$.as"), sequence=_j("$.q")))
        return trades.unionByName(quotes)
    raise ValueError(f"unknown vendor {vendor}")


def epoch_seconds(ts: Column) -> Column:
    """Seconds of an epoch given in seconds, milli-, micro- or nanoseconds; what isn't positive or finite stays."""
    return F.when(ts.isNull() | F.isnan(ts) | (ts <= 0) | (ts == float("inf")), ts).when(ts >= 1e17, ts / 1e9).when(ts >= 1e14, ts / 1e6).when(ts >= 1e11, ts / 1e3).otherwise(ts)


def normalise(raw: DataFrame, any_sign: bool = False) -> tuple[DataFrame, DataFrame]:
    """Raw events (source, payload JSON, receive_timestamp, raw_id) as ticks, and those rejected with their error.

    any_sign: trades may have a price of zero or below, as those of spreads do; it must be there all the same.
    """
    kind = F.upper(F.trim(_j("$.event_type")))
    number = lambda p: _j(p).try_cast("double")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    error = (F.when(F.get_json_object("payload", "$").isNull(), "payload is no object")
        .when(F.coalesce(F.trim(_j("$.instrument")), F.lit("")) == "", "instrument is missing")
        .when(~F.coalesce(kind, F.lit("")).isin("TRADE", "QUOTE", "HALT", "STATUS"), "event_type is unknown")
        .when((kind == "TRADE") & ~(finite(number("$.price")) & (F.lit(any_sign) | (number("$.price") > 0))), "price is missing or not positive")
        .when((kind == "TRADE") & ~(finite(number("$.quantity")) & (number("$.quantity") > 0)), "quantity is missing or not positive")
        .when((kind == "QUOTE") & ~(finite(number("$.bid")) & finite(number("$.ask"))), "bid or ask is missing")
        .when(_j("$.sequence").isNotNull() & _j("$.sequence").try_cast("long").isNull(), "sequence is no integer"))
    rows = raw.withColumn("error", error)
    at = F.coalesce(epoch_seconds(number("$.exchange_ts")), F.col("receive_timestamp"))
    good = rows.where("error is null").select(
        F.col("raw_id").alias("event_id"), F.upper(F.trim(_j("$.instrument"))).alias("instrument_id"), kind.alias("event_type"), at.alias("exchange_timestamp"), "receive_timestamp", F.col("receive_timestamp").alias("processing_timestamp"), "source",
        _j("$.sequence").try_cast("long").alias("sequence_number"), number("$.price").alias("price"), number("$.quantity").alias("quantity"), number("$.bid").alias("bid_price"), number("$.bid_size").alias("bid_size"), number("$.ask").alias("ask_price"), number("$.ask_size").alias("ask_size"),
        F.when(F.upper("source").contains("SIM"), "SIM").when(F.upper("source").contains("REPLAY"), "REPLAY").otherwise("LIVE").alias("source_kind"),
        F.when(number("$.exchange_ts").isNotNull(), "EXCHANGE").otherwise("GATEWAY_RECV").alias("clock_source"), "raw_id",
    )
    return good, rows.where("error is not null")
