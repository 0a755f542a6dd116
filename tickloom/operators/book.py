"""Order books: levels, walking them, and folds that rebuild them from messages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micro_price(bid: Column, ask: Column, bid_size: Column, ask_size: Column) -> Column:
    """Midpoint weighted by the sizes of the other side; the plain midpoint where there are none."""
    total = bid_size + ask_size
    return F.when(total > 0, (bid * ask_size + ask * bid_size) / total).otherwise((bid + ask) / 2)


def imbalance(bid_size: Column, ask_size: Column) -> Column:
    return F.when(bid_size + ask_size > 0, (bid_size - ask_size) / (bid_size + ask_size)).otherwise(F.lit(0.0))


def levels(rows: DataFrame) -> DataFrame:
    """Sizes of all venues by instrument, side and price, with each level's rank and running size and notional from the best on.

    rows: instrument_id, side (bid or ask), price, size, venue.
    """
    own = rows.groupBy("instrument_id", "side", "price").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("order_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("venue", "size")))).alias("venue_sizes"))
    best = Window.partitionBy("instrument_id", "side").orderBy(F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price")))
    upto = best.rowsBetween(Window.unboundedPreceding, 0)
    return own.withColumns({"level": F.row_number().over(best), "cum_size": F.sum("size").over(upto), "cum_notional": F.sum(F.col("size") * F.col("price")).over(upto)})


def walk(book: DataFrame, side: str, target: float) -> DataFrame:
    """Filling `target` at the levels of a side (asks for BUY): filled size, mean price, slippage from the best in basis points."""
    own = book.where(F.col("side") == ("ask" if side.upper() == "BUY" else "bid"))
    fill = F.greatest(F.lit(0.0), F.least(F.col("size"), F.lit(float(target)) - (F.col("cum_size") - F.col("size"))))
    rows = own.withColumn("fill", fill).groupBy("instrument_id").agg(F.sum("fill").alias("filled"), F.sum(F.col("fill") * F.col("price")).alias("_cost"), F.min_by("price", "level").alias("best"))
    mean = F.when(F.col("filled") > 0, F.col("_cost") / F.col("filled"))
    slip = (mean - F.col("best")) / F.col("best") * F.lit(10_000.0).cast("double") * (1 if side.upper() == "BUY" else -1)
    return rows.select("instrument_id", "filled", mean.alias("vwap"), "best", slip.alias("slippage_bps"), (F.col("filled") >= target).alias("fully_filled"))


def walk_curve(book: DataFrame, side: str, sizes: tuple[float, ...] = (1, 5, 10, 25, 50)) -> DataFrame:
    out = None
    for s in sizes:
        one = walk(book, side, s).withColumn("target", F.lit(float(s)))
        out = one if out is None else out.unionByName(one)
    return out


def depth_within(book: DataFrame, bps: float) -> DataFrame:
    """Notional of each side within bps of the midpoint of the best prices."""
    best = book.groupBy("instrument_id").agg(F.max(F.when(F.col("side") == "bid", F.col("price"))).alias("b"), F.min(F.when(F.col("side") == "ask", F.col("price"))).alias("a")).withColumn("mid", (F.col("a") + F.col("b")) / 2)
    near = F.abs(F.col("price") - F.col("mid")) <= F.col("mid") * (bps / 10_000.0)
    notional = F.col("price") * F.col("size")
    return book.join(best, "instrument_id").where(near).groupBy("instrument_id").agg(F.sum(F.when(F.col("side") == "bid", notional).otherwise(0.0)).alias("bid_notional"), F.sum(F.when(F.col("side") == "ask", notional).otherwise(0.0)).alias("ask_notional"))


def crossed(levels_by_venue: DataFrame) -> DataFrame:
    """Venues whose best bid is above another venue's best ask. Only best prices can tell, so levels are reduced first."""
    best = levels_by_venue.groupBy("instrument_id", "venue").agg(F.max(F.when(F.col("side") == "bid", F.col("price"))).alias("bid"), F.min(F.when(F.col("side") == "ask", F.col("price"))).alias("ask"))
    a = best.select("instrument_id", F.col("venue").alias("bid_venue"), "bid")
    b = best.select("instrument_id", F.col("venue").alias("ask_venue"), "ask")
    return a.join(b, "instrument_id").where("bid_venue <> ask_venue and bid > ask")


def queue_positions(orders: DataFrame) -> DataFrame:
    """Orders and size ahead of each resting order at its price, first come first served."""
    line = Window.partitionBy("instrument_id", "side", "price").orderBy("priority").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("instrument_id", "side", "price")
    rows = orders.withColumns({"orders_ahead": F.count(F.lit(1)).over(line), "size_ahead": F.coalesce(F.sum("size").over(line), F.lit(0.0)), "_all": F.sum("size").over(whole)})
    return rows.withColumn("fill_probability_pct", F.when(F.col("_all") > 0, (F.lit(1.0) - F.col("size_ahead") / F.col("_all")) * 100.0).otherwise(F.lit(0.0))).drop("_all")


def resting_orders(messages: DataFrame) -> DataFrame:
    """Orders that rest after all messages: op (add, modify, cancel, execute), order_id, side, price, size, venue, ordinal.

    A change of price or a larger size moves an order to the end of its line; messages about unknown orders do nothing.
    """
    schema = "instrument_id string, order_id string, side string, price double, size double, venue string, priority long"

    def fold(own: pd.DataFrame) -> pd.DataFrame:
        live: dict[str, dict] = {}
        for n, m in enumerate(own.sort_values("ordinal", kind="stable").to_dict("records")):
            held = live.get(m["order_id"])
            if m["op"] == "add":
                if m["size"] > 0 and held is None:
                    live[m["order_id"]] = {k: m[k] for k in ("instrument_id", "order_id", "side", "price", "size", "venue")} | {"priority": n}
            elif held is None:
                continue
            elif m["op"] == "modify":
                moved = (m["price"] == m["price"] and m["price"] != held["price"]) or m["size"] > held["size"]
                if m["price"] == m["price"]:
                    held["price"] = m["price"]
                held["size"] = m["size"]
                held["priority"] = n if moved else held["priority"]
                if held["size"] <= 0:
                    del live[m["order_id"]]
            else:
                gone = m["size"] if m["op"] == "execute" or m["size"] == m["size"] and m["size"] > 0 else held["size"]
                held["size"] -= gone
                if held["size"] <= 0:
                    del live[m["order_id"]]
        return pd.DataFrame(list(live.values()), columns=["instrument_id", "order_id", "side", "price", "size", "venue", "priority"])

    return messages.groupBy("instrument_id").applyInPandas(fold, schema)


def rebuilt_quotes(messages: DataFrame) -> DataFrame:
    """Best prices after each group of book messages: symbol, received_time, event_type (snapshot or update), side, price, quantity (decimal strings), group.

    A group is applied as a whole; a snapshot clears the book first; quantity 0 deletes a level.
    """
    schema = "symbol string, received_time long, bid_price double, bid_size double, ask_price double, ask_size double"

    def fold(own: pd.DataFrame) -> pd.DataFrame:
        from decimal import Decimal

        book: dict[str, dict] = {"bid": {}, "ask": {}}
        out = []
        own = own.sort_values(["received_time", "message"], kind="stable")
        for (received, _), part in own.groupby(["received_time", "message"], sort=False):
            if (part["event_type"] == "snapshot").any():
                book = {"bid": {}, "ask": {}}
            for side, price, quantity in zip(part["side"], part["price"], part["quantity"]):
                size = Decimal(quantity)
                if size == 0:
                    book[side].pop(Decimal(price), None)
                else:
                    book[side][Decimal(price)] = size
            bid, ask = max(book["bid"], default=None), min(book["ask"], default=None)
            out.append((part["symbol"].iloc[0], int(received), *(float(x) if x is not None else None for x in (bid, book["bid"].get(bid), ask, book["ask"].get(ask)))))
        return pd.DataFrame(out, columns=["symbol", "received_time", "bid_price", "bid_size", "ask_price", "ask_size"])

    return messages.groupBy("symbol").applyInPandas(fold, schema)
