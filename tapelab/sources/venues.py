"""Venue and market JSON to rows; the same functions serve batch and stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The symbol each venue uses per asset.
SYMBOLS = {
    "binance": {"BTC": "BTCUSDT", "ETH": "ETHUSDT"},
    "coinbase": {"BTC": "BTC-USD", "ETH": "ETH-USD"},
    "deribit": {"BTC": "BTC-PERPETUAL", "ETH": "ETH-PERPETUAL"},
}
#: A message of any fields, each as text; lists and objects as their JSON.
_FLAT = "MAP<STRING, STRING>"
_TICK = ("price", "best_bid", "best_ask", "trade_size", "trade_side_buy", "exchange_ms", "symbol")


class Message:
    """Fields of a flat message as text, read from one decoding of it as a map."""

    def __init__(self, decoded: Column) -> None:
        self.decoded = decoded

    def get(self, field: str) -> Column:
        return F.try_element_at(self.decoded, F.lit(field))

    def num(self, field: str) -> Column:
        return self.get(field).try_cast("double")

    def ms(self, field: str) -> Column:
        return self.get(field).try_cast("bigint")


def _tick(price, bid, ask, size, buy, ts, symbol) -> Column:
    none = F.lit(None).cast("double")
    return F.struct(
        price.alias("price"), (bid if bid is not None else none).alias("best_bid"),
        (ask if ask is not None else none).alias("best_ask"), size.alias("trade_size"),
        buy.alias("trade_side_buy"), ts.alias("exchange_ms"), symbol.alias("symbol"),
    )


def _binance(m: Message, _: Message):
    event = m.get("e")
    quote = (event == "bookTicker") | (event.isNull() & m.get("s").isNotNull() & m.get("b").isNotNull() & m.get("a").isNotNull())
    bid, ask = m.num("b"), m.num("a")
    stamp = F.coalesce(m.get("T"), m.get("E"), F.lit("0")).try_cast("bigint")
    trade = _tick(m.num("p"), None, None, m.num("q"), ~m.get("m").try_cast("boolean"), m.ms("T"), m.get("s"))
    book = _tick((bid + ask) / 2.0, bid, ask, F.lit(0.0), F.lit(False), stamp, m.get("s"))
    return F.when(event == "trade", F.array(trade)).when(quote, F.array(book)), (event == "trade") | quote


def _iso_ms(c: Column) -> Column:
    return F.unix_millis(c.try_cast("timestamp"))


def _coinbase(m: Message, _: Message):
    kind, side = m.get("type"), m.get("side")
    buy = F.when(side == "buy", True).when(side == "sell", False)
    ts, symbol = _iso_ms(m.get("time")), m.get("product_id")
    ticker_buy = F.when(side.isNull(), False).otherwise(buy)
    ticker = _tick(m.num("price"), m.num("best_bid"), m.num("best_ask"),
                   F.when(m.get("last_size").isNull(), 0.0).otherwise(m.num("last_size")), ticker_buy, ts, symbol)
    match = _tick(m.num("price"), None, None, m.num("size"), buy, ts, symbol)
    is_match = kind.isin("match", "last_match")
    return F.when(kind == "ticker", F.array(ticker)).when(is_match, F.array(match)), (kind == "ticker") | is_match


_TRADES = "ARRAY<STRUCT<instrument_name: STRING, price: DOUBLE, amount: DOUBLE, direction: STRING, timestamp: BIGINT>>"


def _deribit(m: Message, inner: Message):
    """The notification's ``params`` are decoded as a second map, its list of trades as an array."""
    channel = inner.get("channel")
    sub = m.get("method") == "subscription"
    data = Message(F.from_json(inner.get("data"), _FLAT))
    ticker = _tick(data.num("last_price"), data.num("best_bid_price"), data.num("best_ask_price"),
                   F.lit(0.0), F.lit(False), data.ms("timestamp"), data.get("instrument_name"))
    trades = F.transform(
        F.from_json(inner.get("data"), _TRADES),
        lambda x: _tick(x["price"], None, None, x["amount"],
                        F.when(x["direction"] == "buy", True).when(x["direction"] == "sell", False), x["timestamp"], x["instrument_name"]),
    )
    is_ticker, is_trades = sub & channel.startswith("ticker."), sub & channel.startswith("trades.")
    return F.when(is_ticker, F.array(ticker)).when(is_trades, trades), is_ticker | is_trades


_PARSERS = {"binance": _binance, "coinbase": _coinbase, "deribit": _deribit}


def parse_venue_json(df: DataFrame, venue: str, payload: str = "payload", local_ms: str | None = None) -> DataFrame:
    """One row per tick with ``reject_reason``; messages of other kinds give no row.

    A rejected row keeps its payload: route it to a reject table by the reason.
    """
    flat = F.from_json(payload, _FLAT)
    decoded = df.withColumn("_m", flat).withColumn("_p", F.from_json(F.try_element_at("_m", F.lit("params")), _FLAT))
    ticks, relevant = _PARSERS[venue](Message(F.col("_m")), Message(F.col("_p")))
    # a message that is no object has no map; only then it is asked whether it is JSON at all
    bad_json = F.when(F.col("_m").isNull(), F.try_parse_json(payload).isNull()).otherwise(False)
    none = F.lit(None).cast("double")
    blank = F.array(_tick(none, None, None, none, F.lit(None).cast("boolean"), F.lit(None).cast("bigint"), F.lit(None).cast("string")))
    rows = F.when(bad_json, blank).when(F.coalesce(relevant, F.lit(False)), F.coalesce(ticks, blank))
    out = decoded.withColumns({"_bad": bad_json, "_x": F.explode(rows)})
    x = lambda c: F.col(f"_x.{c}")
    known = [s for s in SYMBOLS[venue].values()]
    reason = (
        F.when(F.col("_bad"), "invalid_json")
        .when(~F.coalesce(x("symbol").isin(*known), F.lit(False)), "unexpected_symbol")
        .when(x("price").isNull() | F.isnan(x("price")), "price")
        .when(x("trade_size").isNull(), "size")
        .when(x("trade_side_buy").isNull(), "side")
        .when(x("exchange_ms").isNull(), "timestamp")
    )
    local = [F.col(local_ms).alias("local_ms")] if local_ms else []
    keep = [c for c in df.columns if c not in (payload, local_ms)]
    return out.select(
        *keep, payload, *local, F.lit(venue).alias("venue"), *[x(c).alias(c) for c in _TICK], reason.alias("reject_reason")
    )


def base_units(size: Column) -> Column:
    """Decimal text to 1e-6 units without going through doubles; null if it does not fit."""
    ok = size.rlike(r"^[0-9]+(\.[0-9]{0,6}0*)?$")
    whole = F.regexp_extract(size, r"^([0-9]+)", 1).try_cast("bigint")
    frac = F.substring(F.rpad(F.regexp_extract(size, r"\.([0-9]*)$", 1), 6, "0"), 1, 6).try_cast("bigint")
    return F.when(ok, whole * 1_000_000 + F.coalesce(frac, F.lit(0)))


def price_micros(price: Column) -> Column:
    p = price.try_cast("double")
    return F.when((p >= 0) & (p <= 1), F.round(p * 1_000_000).cast("long"))


_LEVELS = "ARRAY<STRUCT<price: STRING, size: STRING>>"
_CHANGES = "ARRAY<STRUCT<asset_id: STRING, side: STRING, price: STRING, size: STRING, hash: STRING>>"
# The fields of a market message.
_FIELDS = (
    "event_type", "market", "asset_id", "timestamp", "hash", "bids", "asks", "price_changes", "side", "price", "size", "old_tick_size",
    "new_tick_size", "best_bid", "best_ask", "question", "winning_asset_id", "winning_outcome",
)
_LISTS = {"bids": _LEVELS, "asks": _LEVELS, "price_changes": _CHANGES}


def parse_market_messages(df: DataFrame, payload: str = "payload", msg: str = "msg") -> DataFrame:
    """Market-channel messages as rows of one table, told apart by ``kind``.

    ``snapshot``/``delta`` rows carry one level each; ``last_trade``, ``tick_size``, ``best_bid_ask``,
    ``new_market`` and ``resolved`` rows carry one message each. Each book also has a snapshot row without a level
    (``pos`` -1), so an empty book clears the levels before it. A row with a field that does not parse has
    ``reject_reason``; so have a payload that is no JSON (kind ``invalid``), a book whose levels and a price change whose
    list do not parse. Other events, and changes with an empty list, are of kind ``ignored``: every message gives a row. ``detail`` of a
    book or change row is the hash that the message states.

    A message is decoded once, into the text of its fields; of a book or a change the lists are then decoded from theirs.
    """
    fields = ", ".join(f"{name} STRING" for name in _FIELDS)
    decoded = df.withColumn("_d", F.from_json(payload, f"{fields}, _bad STRING", {"columnNameOfCorruptRecord": "_bad"}))
    s = lambda name: F.col(f"_d.{name}")
    base = decoded.withColumns(
        {"_e": s("event_type"), "condition_id": s("market"), "_asset": s("asset_id"), "event_ms": s("timestamp").try_cast("bigint"),
         **{f"_{name}": F.from_json(s(name), kind) for name, kind in _LISTS.items()}}
    )
    none = F.lit(None).cast("string")

    def row(kind, token, side=none, price=none, size=none, price2=none, detail=none, pos=None):
        return F.struct(
            F.lit(kind).alias("kind"), token.alias("token_id"), side.alias("side"), price.alias("price"),
            size.alias("size"), price2.alias("price2"), detail.alias("detail"), (pos if pos is not None else F.lit(0)).alias("pos"),
        )

    def levels(name: str, side: str):
        got = F.coalesce(F.col(f"_{name}"), F.array().cast(_LEVELS))
        return F.transform(got, lambda x, i: row("snapshot", F.col("_asset"), F.lit(side), x["price"], x["size"], detail=s("hash"), pos=i))

    # an unreadable list parses to null, or to elements without any field
    unreadable = lambda name: s(name).isNotNull() & (
        F.col(f"_{name}").isNull() | ~F.startswith(F.ltrim(s(name)), F.lit("["))
    )
    broken_book = unreadable("bids") | unreadable("asks")
    broken_changes = s("price_changes").isNull() | unreadable("price_changes")
    marker = row("snapshot", F.col("_asset"), detail=s("hash"), pos=F.lit(-1))
    ignored = F.array(row("ignored", F.col("_asset")))
    deltas = F.transform(
        F.col("_price_changes"),
        lambda x, i: row("delta", x["asset_id"], F.when(x["side"] == "BUY", "BID").when(x["side"] == "SELL", "ASK"),
                         x["price"], x["size"], detail=x["hash"], pos=i),
    )
    invalid = F.col("_d").isNull() | s("_bad").isNotNull()
    rows = (
        F.when((F.col("_e") == "book") & broken_book, F.array(marker))
        .when(F.col("_e") == "book", F.concat(F.array(marker), levels("bids", "BID"), levels("asks", "ASK")))
        .when((F.col("_e") == "price_change") & broken_changes, F.array(row("delta", F.col("_asset"))))
        .when(F.col("_e") == "price_change", F.when(F.size("_price_changes") > 0, deltas).otherwise(ignored))
        .when(F.col("_e") == "last_trade_price", F.array(row("last_trade", F.col("_asset"), s("side"), s("price"), s("size"))))
        .when(F.col("_e") == "tick_size_change", F.array(row("tick_size", F.col("_asset"), price=s("old_tick_size"), price2=s("new_tick_size"))))
        .when(F.col("_e") == "best_bid_ask", F.array(row("best_bid_ask", F.col("_asset"), price=s("best_bid"), price2=s("best_ask"))))
        .when(F.col("_e") == "new_market", F.array(row("new_market", none, detail=s("question"))))
        .when(F.col("_e") == "market_resolved", F.array(row("resolved", s("winning_asset_id"), detail=s("winning_outcome"))))
        .when(F.col("_e").isNull() & invalid, F.array(row("invalid", none)))
        .otherwise(ignored)
    )
    bad_list = F.when((F.col("_e") == "book") & broken_book, "levels").when((F.col("_e") == "price_change") & broken_changes, "changes")
    out = base.withColumns({"_bad_list": bad_list, "_x": F.explode(rows)})
    kind, price = F.col("_x.kind"), F.col("_x.price")
    level = kind.isin("snapshot", "delta")
    marks = (kind == "snapshot") & (F.col("_x.pos") < 0)
    priced = kind.isin("snapshot", "delta", "last_trade", "tick_size", "best_bid_ask")
    micros, units = price_micros(price), base_units(F.col("_x.size"))
    reason = (
        F.when(kind == "invalid", "invalid_json").when(F.col("_bad_list").isNotNull(), F.col("_bad_list"))
        .when(marks, F.lit(None)).when(priced & micros.isNull(), "price").when((kind == "delta") & F.col("_x.side").isNull(), "side")
        .when((kind == "snapshot") & units.isNull(), "size")
        .when(F.col("_x.size").isNotNull() & units.isNull(), "size")
        .when(kind.isin("tick_size", "best_bid_ask") & price_micros(F.col("_x.price2")).isNull(), "price")
    )
    return out.select(
        msg, "condition_id", "event_ms", kind.alias("kind"), F.col("_x.token_id").alias("token_id"),
        F.col("_x.side").alias("side"), micros.alias("price_micros"), price_micros(F.col("_x.price2")).alias("price2_micros"),
        units.alias("quantity"), F.col("_x.detail").alias("detail"),
        F.when(level, F.col("_x.pos")).otherwise(0).alias("pos"), reason.alias("reject_reason"),
    )
