"""Symbols, venues, tick sizes, sessions, currencies, input checks: column expressions over small fixed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A ticker's suffix, the venue, currency and country that it stands for.
SUFFIXES = (
    (".NS", "XNSE", "INR", "IN"), (".BO", "XBOM", "INR", "IN"), (".DE", "XETR", "EUR", "DE"), (".T", "XTKS", "JPY", "JP"), (".L", "XLON", "GBP", "GB"),
    (".HK", "XHKG", "HKD", "HK"), (".SI", "XSES", "SGD", "SG"), (".KS", "XKRX", "KRW", "KR"), (".TW", "XTWS", "TWD", "TW"), (".PA", "XPAR", "EUR", "FR"),
)
#: Upper price bounds and tick sizes; the last size holds beyond.
TICK_TABLES = {
    "FIXED_0_01": ((), (0.01,)),
    "NSE_DYNAMIC": ((250.0,), (0.01, 0.05)),
    "MIFID2": ((0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0, 200.0, 500.0), (0.0001, 0.0002, 0.0005, 0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2)),
    "TSE_TIERED": ((1000.0, 3000.0, 10000.0, 30000.0), (0.1, 0.5, 1.0, 5.0, 10.0)),
}
#: Tables whose bounds belong to the band below them.
CLOSED = frozenset({"NSE_DYNAMIC", "TSE_TIERED"})
#: Signs of currencies.
SIGNS = {"INR": "₹", "EUR": "€", "JPY": "¥", "USD": "$", "GBP": "£", "HKD": "HK$", "SGD": "S$", "KRW": "₩", "TWD": "NT$"}


def resolve(rows: DataFrame, symbol: str = "symbol", directory: DataFrame | None = None, renames: DataFrame | None = None, as_of: str | None = None, default_venue: str = "XNAS") -> DataFrame:
    """Rows with canonical_id, ticker, venue, currency and country of their symbol.

    directory (key, canonical_id, ticker, venue, currency, country) holds tickers, ISINs, FIGIs and aliases
    alike; what it lacks is told by its suffix, four digits are Tokyo's, the rest is American. renames
    (old, new, changed) map a symbol to the name that was valid on the date in column as_of.
    """
    rows = rows.withColumn("_raw", F.upper(F.trim(F.col(symbol))))
    if renames is not None and as_of is not None:
        day = F.substring(F.col(as_of).cast("string"), 1, 10)
        both = renames.select(F.col("new").alias("_from"), F.col("old").alias("_to"), F.col("changed").alias("_day"), F.lit(True).alias("_back")).unionByName(renames.select(F.col("old").alias("_from"), F.col("new").alias("_to"), F.col("changed").alias("_day"), F.lit(False).alias("_back")))
        rows = rows.join(both, (F.col("_raw") == F.col("_from")) & ((F.col("_back") & (day < F.col("_day"))) | (~F.col("_back") & (day >= F.col("_day")))), "left").withColumn("_raw", F.coalesce("_to", "_raw")).drop("_from", "_to", "_day", "_back")
    raw = F.col("_raw")
    ends = [(raw.endswith(s) & (F.length(raw) > len(s)), s, v, c, k) for s, v, c, k in SUFFIXES]
    tokyo = raw.rlike("^[0-9]{4}$")

    def told(place: int, otherwise: Column) -> Column:
        out = F
        for test, *values in ends:
            out = out.when(test, F.lit(values[place]))
        return out.when(tokyo, F.lit(("", "XTKS", "JPY", "JP")[place])).otherwise(otherwise)

    cut = F.coalesce(*(F.when(test, F.expr(f"substring(_raw, 1, length(_raw) - {len(s)})")) for test, s, *_ in ends), raw)
    out = {"canonical_id": F.when(tokyo, F.concat(raw, F.lit(".T"))).otherwise(raw), "ticker": cut, "venue": told(1, F.lit(default_venue)), "currency": told(2, F.lit("USD")), "country": told(3, F.lit("US"))}
    if directory is not None:
        known = directory.select(F.upper("key").alias("_raw"), *(F.col(c).alias(f"_k_{c}") for c in out))
        rows = rows.join(known, "_raw", "left")
        out = {c: F.coalesce(f"_k_{c}", e) for c, e in out.items()}
    return rows.withColumns(out).drop("_raw", *(f"_k_{c}" for c in out))


def tick_size(price: Column, table: str = "FIXED_0_01") -> Column:
    """The least step of a price on a venue; 0.01 for what isn't positive."""
    bounds, sizes = TICK_TABLES[table]
    out = F.when(price <= 0, F.lit(0.01))
    for bound, size in zip(bounds, sizes):
        out = out.when(price <= bound if table in CLOSED else price < bound, F.lit(size))
    return out.otherwise(F.lit(sizes[-1]))


def on_tick(price: Column, table: str = "FIXED_0_01") -> Column:
    """The price rounded to its tick, to the even one of two as near."""
    size = tick_size(price, table)
    return F.round(F.rint(price / size) * size, 6)


def session_phase(ts: Column, opens: float, closes: float, pre: float | None = None, auction: float | None = None, always: bool = False) -> Column:
    """CONTINUOUS, PRE_OPEN, CLOSING_AUCTION, POST_CLOSE or CLOSED at a time, for a venue's hours in UTC; sessions may wrap over midnight."""
    if always or opens == 0.0 and closes in (0.0, 24.0):
        return F.when(ts.isNotNull(), F.lit("CONTINUOUS"))
    at = F.timestamp_micros((ts * 1e6).cast("long"))
    hour, day = F.hour(at) + F.minute(at) / 60.0 + F.second(at) / 3600.0, F.dayofweek(at)

    def between(a: float, b: float) -> Column:
        return (hour >= a) & (hour < b) if a < b else (hour >= a) | (hour < b)

    sunday = F.when(F.lit(opens > closes) & (hour >= opens), "CONTINUOUS")
    if pre is not None:
        sunday = sunday.when(hour >= pre if pre > opens else (hour >= pre) & (hour < opens), "PRE_OPEN")
    out = F.when(day == 1, sunday.otherwise("CLOSED")).when(day == 7, "CLOSED")
    if pre is not None:
        out = out.when(between(pre, opens), "PRE_OPEN")
    if auction is not None:
        out = out.when(between(auction, closes), "CLOSING_AUCTION")
    out = out.when(between(opens, closes), "CONTINUOUS")
    if opens < closes:
        out = out.when((hour >= closes) & (hour < closes + 1), "POST_CLOSE")
    return out.otherwise("CLOSED")


def money(amount: Column, currency: str = "USD") -> Column:
    """An amount as text: no decimals for yen, lakhs and crores for rupees, else thousands and two decimals."""
    code = currency.upper().strip()
    sign = SIGNS.get(code, f"{code} ")
    size = F.abs(amount)
    if code == "JPY":
        text = F.format_number(size, 0)
    elif code == "INR":
        whole = F.format_string("%.2f", size)
        digits = F.substring_index(whole, ".", 1)
        head = F.reverse(F.regexp_replace(F.reverse(F.regexp_extract(digits, "^(.*).{3}$", 1)), "(..)(?=.)", "$1,"))
        text = F.when(F.length(digits) <= 3, whole).otherwise(F.concat(head, F.lit(","), F.regexp_extract(whole, r"(.{3}\..*)$", 1)))
    else:
        text = F.format_number(size, 2)
    return F.concat(F.when(amount < 0, "-").otherwise(""), F.lit(sign), text)


SYMBOL = r"^[A-Za-z0-9/_\-.:=^ ]{1,32}$"


def input_error(payload: Column) -> Column:
    """Why a JSON payload is refused (null: it isn't): symbol's form, prices and sizes out of bounds, sequence, depth."""
    j = lambda p: F.get_json_object(payload, p)
    number = lambda p: j(p).try_cast("double")
    low = F.when(j("$.allow_negative") == "true", F.lit(-1e12)).otherwise(F.lit(0.0))
    out_of = lambda p, least: j(p).isNotNull() & ~F.coalesce((number(p) >= least) & (number(p) <= 1e12), F.lit(False))
    return (F.when(j("$").isNull() | ~F.trim(payload).startswith("{"), "payload is no object")
        .when(j("$.instrument").isNotNull() & ~j("$.instrument").rlike(SYMBOL), "symbol")
        .when(out_of("$.price", low), "price").when(out_of("$.bid", low), "bid").when(out_of("$.ask", low), "ask").when(out_of("$.quantity", F.lit(0.0)), "quantity")
        .when(j("$.sequence").isNotNull() & (~j("$.sequence").rlike("^[0-9]+$") | j("$.sequence").try_cast("long").isNull()), "sequence")
        .when((F.coalesce(F.json_array_length(j("$.bids")), F.lit(0)) > 50) | (F.coalesce(F.json_array_length(j("$.asks")), F.lit(0)) > 50), "depth"))


def redacted(payload: Column, keys: tuple[str, ...] = ("account", "account_id", "password", "secret", "trader_id", "1", "11", "50", "554")) -> Column:
    """A JSON text with the values of secret keys taken out."""
    names = "|".join(keys)
    return F.regexp_replace(payload, rf'(?i)("(?:{names})"\s*:\s*)("(?:[^"\\]|\\.)*"|[^,}}\s]+)', '$1"[REDACTED]"')


def effective_config(instruments: DataFrame, defaults: dict[str, float], by_venue: DataFrame, by_class: DataFrame, by_instrument: DataFrame) -> DataFrame:
    """Settings of each instrument (instrument_id, venue, asset_class): its own, else its class's, else its venue's, else the defaults."""
    out = instruments
    for name, table in (("venue", by_venue), ("asset_class", by_class), ("instrument_id", by_instrument)):
        out = out.join(table.select(name, *(F.col(c).alias(f"_{name}_{c}") for c in defaults if c in table.columns)), name, "left")
    pick = lambda c: F.coalesce(*(F.col(f"_{n}_{c}") for n in ("instrument_id", "asset_class", "venue") if f"_{n}_{c}" in out.columns), F.lit(defaults[c]))
    return out.select("instrument_id", *(pick(c).alias(c) for c in defaults))


def shard(instrument: Column, n: int) -> Column:
    """The shard that holds all feeds of an instrument."""
    return F.crc32(F.upper(instrument).cast("binary")) % n


def fixed_point(price: Column) -> Column:
    """Prices as integers of 1e-8, half to even."""
    return F.rint(price * 1e8).cast("long")
