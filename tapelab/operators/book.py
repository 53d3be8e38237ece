"""Order-book state from snapshots and absolute deltas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapelab.operators import asof, intervals, scan
from tapelab.session import settle

# Fixed value: the levels a side that a book's hash covers.
DEPTH = 5


def book_levels(levels: DataFrame, token: str = "token_id", at: int | None = None, ts: str = "ts_ms") -> DataFrame:
    """Live levels per token: last quantity per (side, price) since the last snapshot.

    ``levels`` has one row per level message: ``msg`` (order within the token), ``kind``
    (snapshot/delta), ``side`` (BID/ASK), ``price_micros``, ``quantity``, ``pos`` (order
    inside a message). Both steps are aggregates with map-side combining.
    """
    rows = levels if at is None else levels.where(F.col(ts) <= at)
    start = rows.where(F.col("kind") == "snapshot").groupBy(token).agg(F.max("msg").alias("_snap"))
    live = rows.join(start, token).where(F.col("msg") >= F.col("_snap"))
    last = live.groupBy(token, "side", "price_micros").agg(
        F.max_by("quantity", F.struct("msg", "pos")).alias("quantity")
    )
    return last.where(F.col("quantity") > 0)


def book_hash(bids: Column, asks: Column, depth: int = DEPTH) -> Column:
    """Hash of the ``depth`` best levels a side, from arrays of (price_micros, quantity) with the best first."""
    text = lambda side: F.array_join(
        F.transform(F.slice(side, 1, depth), lambda x: F.concat_ws(":", x["price_micros"], x["quantity"])), ","
    )
    return F.md5(F.concat(text(bids), F.lit("|"), text(asks)))


def book_state(levels: DataFrame, token: str = "token_id", depth: int = DEPTH) -> DataFrame:
    """Sorted sides per token, best prices and a hash of the top levels.

    Levels of a token are distinct prices on the tick grid, so the arrays are bounded.
    """
    lv = F.struct("price_micros", "quantity")
    sides = levels.groupBy(token).agg(
        F.array_sort(F.collect_list(F.when(F.col("side") == "ASK", lv))).alias("asks"),
        F.reverse(F.array_sort(F.collect_list(F.when(F.col("side") == "BID", lv)))).alias("bids"),
    )
    return sides.withColumns(
        {
            "best_bid_micros": F.get("bids", F.lit(0))["price_micros"],
            "best_ask_micros": F.get("asks", F.lit(0))["price_micros"],
            "book_hash": book_hash(F.col("bids"), F.col("asks"), depth),
        }
    )


def _covered(levels: DataFrame, token: str, width: int, cover_levels: int) -> tuple[DataFrame, DataFrame]:
    """The blocks of message numbers that each live level fills, and the blocks that each message lies in.

    The messages of a token are numbered without gaps, so that a level that lives for few messages fills few blocks, however far
    apart their ids are. A level is live from its message to the next message about it or the next snapshot. That run of message numbers
    is covered by aligned blocks of 16^k numbers (at most 30 a size), and a message lies in one block of each size: no book is rebuilt,
    and no token needs one task.
    """
    messages = levels.groupBy(token, "msg").agg(F.max(F.col("kind") == "snapshot").alias("_snap"))
    messages = settle(scan.numbered(messages, [token], "msg", width=width, rn="_rn"), "messages")
    snapshots = messages.where("_snap").select(token, F.col("_rn").alias("_next_snap"))
    change = Window.partitionBy(token, "side", "price_micros").orderBy("_rn", "pos")
    rows = levels.where(F.col("price_micros").isNotNull()).join(messages, [token, "msg"]).select(
        token, "side", "price_micros", "quantity", "_rn", F.lead("_rn").over(change).alias("_until")
    )
    rows = rows.where(F.col("quantity") > 0).withColumn("_after", F.col("_rn") + 1)
    rows = asof.asof_forward(rows, snapshots, "_after", [token], ["_next_snap"], right_on="_next_snap", width=width)
    last = messages.groupBy(token).agg(F.max("_rn").alias("_last"))
    level = [token, "side", "price_micros", "quantity"]
    spans = rows.join(last, token).select(
        *level, F.col("_rn").alias("_lo"), F.least("_until", "_next_snap", F.col("_last") + 1).alias("_hi")
    )
    places = F.array(*[F.struct(F.lit(n).alias("level"), F.floor(F.col("_rn") / intervals.FAN**n).cast("long").alias("block")) for n in range(cover_levels)])
    probes = messages.select(token, "msg", F.explode(places).alias("_p")).select(token, "msg", "_p.level", "_p.block")
    return intervals.cover(spans, level, cover_levels), probes


def book_tops(levels: DataFrame, token: str = "token_id", width: int = 100_000, cover_levels: int = 8) -> DataFrame:
    """``token, msg, best_bid_micros, best_ask_micros`` after every message: the book as it was published each time.

    ``levels`` as in ``book_levels``; the times of change of one level (side and price of a token) lie in one task. The blocks
    of ``_covered`` keep their best prices, and a message reads the few blocks it lies in. ``width`` is the number of messages in
    a bucket of the lookup of the next snapshot.
    """
    cover, probes = _covered(levels, token, width, cover_levels)
    price = F.col("price_micros")
    best = cover.groupBy(token, "level", "block").agg(
        F.max(F.when(F.col("side") == "BID", price)).alias("_bid"), F.min(F.when(F.col("side") == "ASK", price)).alias("_ask")
    )
    return probes.join(best, [token, "level", "block"], "left").groupBy(token, "msg").agg(
        F.max("_bid").alias("best_bid_micros"), F.min("_ask").alias("best_ask_micros")
    )


def book_hashes(
    levels: DataFrame, token: str = "token_id", depth: int = DEPTH, width: int = 100_000, cover_levels: int = 8
) -> DataFrame:
    """``token, msg, book_hash`` after every message, as ``book_state`` would give it then.

    As ``book_tops``, but a block keeps its ``depth`` best levels a side; the best of all blocks of a message are among them, as a
    live level is in one block of a message only. An empty side hashes as the empty text.
    """
    cover, probes = _covered(levels, token, width, cover_levels)
    bid = F.col("side") == "BID"
    rank = F.when(bid, -F.col("price_micros")).otherwise(F.col("price_micros"))
    order = Window.partitionBy(token, "level", "block", "side").orderBy(rank)
    best = cover.withColumn("_rank", rank).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= depth)
    best = best.groupBy(token, "level", "block").agg(F.collect_list(F.struct("side", "_rank", "price_micros", "quantity")).alias("_best"))
    held = probes.join(best, [token, "level", "block"], "left").groupBy(token, "msg").agg(F.flatten(F.collect_list("_best")).alias("_all"))
    side = lambda s: F.sort_array(F.filter("_all", lambda x: x["side"] == s))
    return held.select(token, "msg", book_hash(side("BID"), side("ASK"), depth).alias("book_hash"))


def book_metrics(levels: DataFrame, token: str = "token_id") -> DataFrame:
    """Best prices, spread, mid, depth, imbalance and microprice; crossed books are null."""
    bid, ask = F.col("side") == "BID", F.col("side") == "ASK"
    p, q = F.col("price_micros"), F.col("quantity")
    agg = levels.groupBy(token).agg(
        F.max(F.when(bid, p)).alias("best_bid_micros"),
        F.min(F.when(ask, p)).alias("best_ask_micros"),
        F.max_by(q, F.when(bid, p)).alias("_bq"),
        F.min_by(q, F.when(ask, p)).alias("_aq"),
        F.coalesce(F.sum(F.when(bid, q)), F.lit(0)).alias("bid_depth"),
        F.coalesce(F.sum(F.when(ask, q)), F.lit(0)).alias("ask_depth"),
    )
    b, a = F.col("best_bid_micros"), F.col("best_ask_micros")
    total = F.col("bid_depth") + F.col("ask_depth")
    ok = b <= a
    micro = F.try_divide(b * F.col("_aq") + a * F.col("_bq"), F.col("_aq") + F.col("_bq"))
    return agg.withColumns(
        {
            "spread_micros": F.when(ok, a - b),
            "mid_micros": F.when(ok, F.floor((a + b) / 2).cast("long")),
            "imbalance": F.when(total > 0, F.try_divide(F.col("bid_depth") - F.col("ask_depth"), total)).otherwise(0.0),
            "microprice": F.when(ok, micro / 1e6),
            "crossed": F.coalesce(b > a, F.lit(False)),
        }
    ).drop("_bq", "_aq")


def stale_flags(
    messages: DataFrame, by: Sequence[str], ts: str, tie: Sequence[str] = (), width: int = scan.HOUR_MS
) -> DataFrame:
    """``stale`` per message: before any snapshot, or after a break since the last one.

    Expects ``kind``, nullable ``sequence`` and boolean ``hash_ok``. A break is a delta whose
    sequence is not the expected one, a delta without a sequence where one is expected, or
    a failed hash; only a snapshot clears it.
    """
    snap = F.col("kind") == "snapshot"
    seen = F.when(snap | F.col("sequence").isNotNull(), F.struct(F.col("sequence").alias("s")))
    bad = ~F.coalesce(F.col("hash_ok"), F.lit(True))
    work = scan.with_bucket(messages, ts, width).withColumns({"_seen": seen, "_bad": bad})
    rows = scan.bucket_window(by).orderBy(ts, *tie)
    so_far = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    work = work.withColumn("_last", scan.last_value(F.col("_seen")).over(rows.rowsBetween(Window.unboundedPreceding, -1)))
    # Before the first sequence of its bucket a delta is judged by the sequence that the bucket inherits. Until then only breaks can
    # happen: a failed hash at once, no sequence if the bucket inherits one, another sequence than the inherited one plus one.
    head = ~snap & F.col("_last").isNull()
    expected = F.col("_last.s") + 1
    gap = ~snap & ~head & expected.isNotNull() & ~F.coalesce(F.col("sequence") == expected, F.lit(False))
    broke = gap | F.col("_bad")
    work = work.withColumns(
        {
            "_event": F.when(snap | broke, broke),
            "_none": head & F.col("sequence").isNull(),
            "_first": F.when(head, F.col("sequence")),
        }
    )
    run = {"_event": scan.last_value, "_none": F.max, "_first": F.max}
    work = work.withColumns({c: f(F.col(c)).over(so_far) for c, f in run.items()})
    order = F.struct(ts, *tie)
    ends = work.groupBy(*by, scan.BUCKET).agg(
        F.max_by("_seen", F.when(F.col("_seen").isNotNull(), order)).alias("_seen"), *[F.max_by(c, order).alias(c) for c in run]
    )

    def broken(inherited: Column) -> Column:
        """Whether the head of a bucket broke, given the sequence it inherits (null: none is expected)."""
        wrong = F.col("_none") | F.coalesce(F.col("_first") != inherited + 1, F.lit(False))
        return inherited.isNotNull() & wrong

    before = scan.across(by)
    ends = ends.withColumn("_inherited", scan.last_value(F.col("_seen")).over(before)["s"])
    state = F.coalesce("_event", F.when(broken(F.col("_inherited")), F.lit(True)))
    ends = ends.withColumn("_state", scan.last_value(state).over(before)).select(*by, scan.BUCKET, "_inherited", "_state")
    work = scan.join_carry(work, ends, by)
    stale = F.coalesce("_event", F.when(broken(F.col("_inherited")), F.lit(True)), "_state", F.lit(True))
    return work.select(*messages.columns, stale.alias("stale"))
