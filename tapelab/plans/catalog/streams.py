"""Streaming operators run over the event files with the available-now trigger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelab.operators import book, scan
from tapelab.operators.scan import HOUR_MS
from tapelab.plans.catalog.corpus import _LV, _levels, _messages
from tapelab.plans.registry import query, r
from tapelab.plans.views import Tables
from tapelab.sources import sinks, venues
from tapelab.session import settle
from tapelab.streaming import streams

col = F.col


#: How late a row may come.
DELAY_MS = HOUR_MS


#: Files of each micro-batch, so that tasks share the writing and the reading.
FILES = 8


class StreamTables(Tables):
    """The same domain tables over a stream of the driver's events, in ``parts`` micro-batches of several files.

    ``late``: some rows of the last hour before a part ends come with the next.
    """

    late = True
    parts = 2

    def raw(self, name: str) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        out = sinks.scratch(self.spark, f"stream-{name}")
        ms = F.unix_millis(col("ts").cast("timestamp"))
        part = F.lit(0)
        # The cuts are read once: an approximate percentile of several partitions may come out differently when it is taken again.
        shares = [i / self.parts for i in range(1, self.parts)]
        for cut in (rows.select(F.percentile_approx(ms, shares)).first()[0] or []) if shares else []:
            after = ms > cut
            if self.late:
                after = after | ((ms > cut - DELAY_MS) & (col("event_id") % 3 == 0))
            part = part + F.coalesce(after, F.lit(False)).cast("int")
        # The stream takes files by age: each part has FILES of them, small tables one.
        each = FILES if rows.count() >= 100 * FILES * self.parts else 1
        marked = rows.withColumn("_part", part)
        for i in range(self.parts):
            marked.where(col("_part") == i).drop("_part").repartition(each).write.parquet(f"{out}/{i}")
        # As many files as were written: a session may deal to more tasks, and a part cut in two would leave rows behind the watermark.
        files = max(len(self.spark.read.schema(rows.schema).parquet(f"{out}/{i}").inputFiles()) for i in range(self.parts))
        return self.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{out}/*")


def _stream(t, late: bool = True, parts: int = 2) -> StreamTables:
    tables = StreamTables(t.spark, t.dir)
    tables.late, tables.parts = late, parts
    return tables


def run(df: DataFrame, mode: str, name: str) -> DataFrame:
    """Runs the stream to the end of its input and returns what it wrote, with the batch."""
    spark = df.sparkSession
    streams.state_store(spark)
    out = sinks.scratch(spark, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/table/batch={batch_id}")

    q = (
        df.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.parquet(f"{out}/table")


def _timed(ticks: DataFrame) -> DataFrame:
    return streams.event_time(ticks.withColumn("exchange_ms", col("ts_ms")), f"{DELAY_MS} milliseconds", "exchange_ms", "ts_ms")


@query("T1_tick_stream", using="ticks", sql="""
SELECT seq, CASE user_id % 4 WHEN 0 THEN 'BTC' WHEN 1 THEN 'BTC' WHEN 2 THEN 'ETH' END AS asset, CASE WHEN user_id % 4 = 3 THEN 'unsupported_symbol' END AS reject_reason FROM ticks""")
def _(t):
    symbol = F.get(F.array(*[F.lit(s) for s in ("btcusdt", "XBT-PERP", "ETH-USD", "SOLUSDT")]), (col("user_id") % 4).cast("int"))
    got = streams.tick_stream(_stream(t).ticks.withColumn("symbol", symbol))
    return run(got.select("seq", "asset", "reject_reason"), "append", "T1").drop("batch")


@query("T2_event_time", using="ticks", sql="SELECT seq, CASE WHEN event_type = 'view' THEN ts_ms + 5 ELSE ts_ms END AS event_ms FROM ticks")
def _(t):
    rows = _stream(t).ticks.select("seq", F.when(col("event_type") == "view", 0).otherwise(col("ts_ms")).alias("exchange_ms"), (col("ts_ms") + 5).alias("local_ms"))
    return run(streams.event_time(rows, "10 seconds").select("seq", "event_ms"), "append", "T2").drop("batch")


@query("T3_sliding_flow", using="ticks", sql="""
WITH w AS (SELECT *, unnest([ts_ms // 7200000 * 7200000, ts_ms // 7200000 * 7200000 - 7200000, ts_ms // 7200000 * 7200000 - 14400000]) AS start_ms FROM ticks),
g AS (SELECT asset, start_ms, start_ms + 21600000 AS end_ms, coalesce(sum(qty) FILTER (side = 'BUY'), 0) AS buy_vol, coalesce(sum(qty) FILTER (side = 'SELL'), 0) AS sell_vol FROM w
WHERE start_ms + 21600000 <= (SELECT max(ts_ms) FROM ticks) - 3600000 GROUP BY 1, 2)
SELECT *, buy_vol - sell_vol AS ofi, CASE WHEN buy_vol + sell_vol > 0 THEN buy_vol / (buy_vol + sell_vol) ELSE 0 END AS buy_ratio FROM g""")
def _(t):
    got = streams.sliding_flow(_timed(_stream(t).ticks), "asset", "6 hours", "2 hours")
    return run(got, "append", "T3").drop("batch")


@query("T3_stream_order_flow", using="ticks", sql="""
SELECT asset, seq, ts_ms AS event_ms, coalesce(sum(qty) FILTER (side = 'BUY') OVER s, 0) AS buy_vol, coalesce(sum(qty) FILTER (side = 'SELL') OVER s, 0) AS sell_vol,
  coalesce(sum(CASE side WHEN 'BUY' THEN qty WHEN 'SELL' THEN -qty END) OVER s, 0) AS ofi_short, coalesce(sum(CASE side WHEN 'BUY' THEN qty WHEN 'SELL' THEN -qty END) OVER l, 0) AS ofi_long,
  round(CASE WHEN sum(qty) FILTER (side IS NOT NULL) OVER s > 0 THEN coalesce(sum(CASE side WHEN 'BUY' THEN qty WHEN 'SELL' THEN -qty END) OVER s, 0) / sum(qty) FILTER (side IS NOT NULL) OVER s ELSE 0 END, 6) AS imbalance,
  round(CASE WHEN sum(qty) FILTER (side IS NOT NULL) OVER s > 0 THEN coalesce(sum(qty) FILTER (side = 'BUY') OVER s, 0) / sum(qty) FILTER (side IS NOT NULL) OVER s ELSE 0 END, 6) AS buy_ratio
FROM ticks WINDOW s AS (PARTITION BY asset ORDER BY ts_ms RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW), l AS (PARTITION BY asset ORDER BY ts_ms RANGE BETWEEN 18000000 PRECEDING AND CURRENT ROW)
QUALIFY ts_ms <= (SELECT max(ts_ms) FROM ticks) - 3600000""")
def _(t):
    return trailing(t, 2)


def trailing(t, parts: int) -> DataFrame:
    """Spans of one and five hours, as the ticks are minutes apart; slices of a day."""
    got = streams.trailing_flow(_timed(_stream(t, parts=parts).ticks), "asset", "seq", HOUR_MS, 5 * HOUR_MS, slice_ms=24 * HOUR_MS)
    got = run(got, "append", "T3").drop("batch")
    return got.select(
        "asset", "seq", "event_ms", "buy_vol", "sell_vol", (col("ofi_short") + 0.0).alias("ofi_short"), (col("ofi_long") + 0.0).alias("ofi_long"),
        r("imbalance", "imbalance"), r("buy_ratio", "buy_ratio"),
    )


@query("T4_latest_venue_price", using="ticks", sql="""
SELECT asset, venue, arg_max(CASE WHEN event_type = 'view' THEN (price + (price + 2)) / 2 ELSE price END, ts_ms::HUGEINT * 1000000000 + seq) AS microprice, max(ts_ms) AS as_of_ms FROM ticks GROUP BY 1, 2""")
def _(t):
    view = col("event_type") == "view"
    rows = _stream(t).ticks.withColumns({"best_bid": F.when(view, col("price")), "best_ask": F.when(view, col("price") + 2), "event_ms": col("ts_ms")})
    got = run(streams.latest_venue_price(rows), "complete", "T4")
    return got.groupBy("asset", "venue").agg(F.max_by("microprice", "batch").alias("microprice"), F.max_by("as_of_ms", "batch").alias("as_of_ms"))


def _newest(df: DataFrame) -> DataFrame:
    cols = ("n", "oldest_ms", "newest_ms", "last_price")
    return df.groupBy("asset").agg(*[F.max_by(c, "batch").alias(c) for c in cols])


@query("T5_spot_history", using="ticks", sql="""
WITH m AS (SELECT *, max(ts_ms) OVER (PARTITION BY asset) AS mx FROM ticks) SELECT asset, count(DISTINCT ts_ms) AS n, min(ts_ms) AS oldest_ms, max(ts_ms) AS newest_ms, arg_max(price, ts_ms::HUGEINT * 1000000000 + seq) AS last_price
FROM m WHERE ts_ms >= mx - 234000000 GROUP BY 1""")
def _(t):
    return history(t, 2)


def history(t, parts: int) -> DataFrame:
    """The last 65 hours of each asset, read from the samples that the stream has written."""
    span = 65 * HOUR_MS
    rows = _timed(_stream(t, parts=parts).ticks.withColumn("event_ms", col("ts_ms")))
    wrote = run(streams.spot_history(rows, retention_ms=span, slice_ms=6 * HOUR_MS), "update", "T5")
    held = wrote.groupBy("asset", "event_ms").agg(F.max_by("price", F.struct("seq", "batch")).alias("price"))
    newest = held.groupBy(col("asset").alias("_a")).agg(F.max("event_ms").alias("_newest"))
    held = held.join(newest, col("asset") == col("_a")).where(col("event_ms") >= col("_newest") - span)
    return held.groupBy("asset").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_ms").alias("oldest_ms"), F.max("event_ms").alias("newest_ms"), F.max_by("price", "event_ms").alias("last_price"))


@query("T6_late_history", using="ticks", sql="""
WITH m AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts_ms DESC) AS k FROM ticks) SELECT asset, count(*) AS n, min(ts_ms) AS oldest_ms, max(ts_ms) AS newest_ms, arg_max(price, ts_ms) AS last_price FROM m WHERE k <= 500 GROUP BY 1""")
def _(t):
    rows = _stream(t).ticks.withColumn("event_ms", col("ts_ms"))
    return _newest(run(streams.late_history(_timed(rows), 500, expire_ms=1000 * HOUR_MS), "update", "T6"))


_HZ = tuple(h * HOUR_MS for h in (1, 5, 10, 30, 60))
_GRACE = 2 * HOUR_MS


@query("T7_stream_labels", using="ticks", sql=f"""
WITH e AS (SELECT * FROM ticks WHERE event_type = 'purchase'), one AS (SELECT asset, ts_ms, arg_min(price, seq) AS price FROM ticks GROUP BY 1, 2),
{', '.join(f"h{i} AS (SELECT a.seq, b.price, b.ts_ms FROM (SELECT seq, asset, ts_ms + {h} AS g FROM e) a ASOF JOIN one b ON a.asset = b.asset AND a.g <= b.ts_ms)" for i, h in enumerate(_HZ))}
SELECT e.asset, e.seq AS eval_id, e.ts_ms AS event_ms, {', '.join(f'h{i}.price AS mid_{h}' for i, h in enumerate(_HZ))} FROM e {' '.join(f'JOIN h{i} ON h{i}.seq = e.seq AND h{i}.ts_ms <= e.ts_ms + {_HZ[-1] + _GRACE}' for i in range(len(_HZ)))}
WHERE h{len(_HZ) - 1}.ts_ms < (SELECT max(ts_ms) FROM ticks) - 3600000""")
def _(t):
    ticks = _timed(_stream(t).ticks)
    kinds = F.when(col("event_type") == "purchase", F.array(F.lit("mid"), F.lit("eval"))).otherwise(F.array(F.lit("mid")))
    rows = ticks.select("asset", "event_ts", "event_ms", col("seq").alias("eval_id"), "price", F.explode(kinds).alias("kind"))
    return run(streams.stream_labels(rows, "asset", _HZ, _GRACE, partial=False), "append", "T7").drop("batch")


# Every 97th message states a wrong hash, the others the hash that the batch form finds.
@query("T8_stream_book", using="quotes", sql=f"""
WITH {_LV}, z AS (SELECT * FROM cur WHERE q > 0),
n AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY seq) + CASE WHEN seq % 11 = 1 THEN 1 ELSE 0 END AS s FROM (SELECT DISTINCT asset, seq, kind FROM lv)),
k AS (SELECT *, lag(s) OVER (PARTITION BY asset ORDER BY seq) AS e FROM n),
f AS (SELECT *, CASE WHEN seq % 97 = 5 OR (kind = 'delta' AND s <> e + 1) THEN 1 ELSE 0 END AS bad, sum(CASE WHEN kind = 'snapshot' THEN 1 ELSE 0 END) OVER (PARTITION BY asset ORDER BY seq) AS ep FROM k),
st AS (SELECT asset, arg_max(stale, seq) AS stale FROM (SELECT asset, seq, ep = 0 OR sum(bad) OVER (PARTITION BY asset, ep ORDER BY seq) > 0 AS stale FROM f) GROUP BY 1),
b AS (SELECT asset, max(p) FILTER (side = 'BID') AS best_bid_micros, min(p) FILTER (side = 'ASK') AS best_ask_micros, count(*) AS n FROM z GROUP BY 1)
SELECT asset AS token_id, best_bid_micros, best_ask_micros, coalesce(n, 0) AS n_levels, stale FROM st LEFT JOIN b USING (asset)""")
def _(t):
    return streamed_book(t, 2)


def streamed_book(t, parts: int) -> DataFrame:
    """The last row of each token; sequences follow each other but for every 11th message."""
    levels = _levels(t)
    msgs = scan.numbered(levels.select("token_id", "msg").distinct(), ["token_id"], "msg", width=100_000, rn="n")
    stated = book.book_hashes(levels, width=10_000).join(msgs, ["token_id", "msg"]).select(
        "token_id", "msg", F.when(col("msg") % 97 == 5, "wrong").otherwise(col("book_hash")).alias("stated_hash"),
        (col("n") + F.when(col("msg") % 11 == 1, 1).otherwise(0)).alias("sequence"))
    rows = venues.parse_market_messages(_messages(_stream(t, late=False, parts=parts)))
    rows = rows.where(col("kind").isin("snapshot", "delta") & col("reject_reason").isNull()).join(settle(stated, "T8-stated"), ["token_id", "msg"])
    rows = rows.withColumn("event_ts", F.timestamp_millis("event_ms")).withWatermark("event_ts", f"{DELAY_MS} milliseconds")
    got = run(streams.stream_book(rows, expire_ms=10_000 * HOUR_MS), "update", "T8")
    cols = ("best_bid_micros", "best_ask_micros", "n_levels", "stale")
    # max_by skips nothing: a side emptied by the last batch stays null.
    last = F.max_by(F.struct(*cols), "batch").alias("s")
    return got.groupBy("token_id").agg(last).select("token_id", *[f"s.{c}" for c in cols])


@query("T9_stream_candles", using="ticks", sql="""
SELECT asset, ts_ms // 86400000 * 86400000 AS start_ms, arg_min(price, ts_ms::HUGEINT * 1000000000 + seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts_ms::HUGEINT * 1000000000 + seq) AS close FROM ticks
WHERE ts_ms // 86400000 * 86400000 + 86400000 <= (SELECT max(ts_ms) FROM ticks) - 3600000 GROUP BY 1, 2""")
def _(t):
    got = streams.stream_candles(_timed(_stream(t).ticks), "asset")
    return run(got, "append", "T9").drop("batch")


@query("T10_stream_cooldown", using="ticks", sql="""
WITH RECURSIVE acc AS (SELECT asset, min(ts_ms) AS ts_ms FROM ticks GROUP BY 1
 UNION ALL SELECT a.asset, (SELECT min(t.ts_ms) FROM ticks t WHERE t.asset = a.asset AND t.ts_ms >= a.ts_ms + 7200000) FROM acc a WHERE a.ts_ms IS NOT NULL)
SELECT a.asset, min(t.seq) AS seq, a.ts_ms AS event_ms FROM acc a JOIN ticks t ON a.asset = t.asset AND a.ts_ms = t.ts_ms GROUP BY 1, 3""")
def _(t):
    rows = _timed(_stream(t, late=False).ticks)
    return run(streams.stream_cooldown(rows, "asset", 2 * HOUR_MS, expire_ms=3 * HOUR_MS), "append", "T10").drop("batch")


@query("T11_stream_tables", using="ticks", sql="SELECT asset, count(*) AS n, round(sum(price), 2) AS total FROM ticks GROUP BY 1")
def _(t):
    out = sinks.scratch(t.spark, "T11")
    ticks = _timed(_stream(t).ticks).select("seq", "asset", "price", "event_ts")
    twice = ticks.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    streams.stream_tables(twice, f"{out}/table", f"{out}/checkpoint", ["seq"]).awaitTermination()
    back = t.spark.read.parquet(f"{out}/table")
    return back.groupBy("asset").agg(F.count(F.lit(1)).alias("n"), r(F.sum("price"), "total", 2))
