"""The driver's tables seen as the domain tables of the library.

``Tables`` gives the DataFrames; ``SQL_VIEWS`` holds the same mapping as SQL, so that
a query and its twin start from the same rows. Only columns a query uses are read.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapelab.session import settle, spread

DAY_MS = 86_400_000

SQL_VIEWS: dict[str, str] = {
    "ticks": """
        SELECT event_id AS seq, epoch_us(ts) // 1000 AS ts_ms, 'A' || (user_id % 8) AS asset,
          CASE user_id % 3 WHEN 0 THEN 'binance' WHEN 1 THEN 'coinbase' ELSE 'deribit' END AS venue,
          value AS price, CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS qty,
          CASE WHEN event_type IN ('click','purchase') THEN 'BUY'
               WHEN event_type IN ('view','error') THEN 'SELL' END AS side,
          event_type, user_id
        FROM events WHERE value > 0""",
    "quotes": """
        SELECT event_id AS seq, epoch_us(ts) // 1000 AS ts_ms, 'A' || (user_id % 8) AS asset,
          event_type, user_id,
          least(CAST(round(value * 100) AS BIGINT) * 18, 990000) AS bid_micros,
          least(least(CAST(round(value * 100) AS BIGINT) * 18, 990000)
                + CAST(regexp_extract(props, '[0-9]+') AS BIGINT) * 100, 1000000) AS ask_micros,
          least(CAST(round(value * 100) AS BIGINT) * 18, 990000) / 1000000.0::DOUBLE AS yes_bid,
          least(least(CAST(round(value * 100) AS BIGINT) * 18, 990000)
                + CAST(regexp_extract(props, '[0-9]+') AS BIGINT) * 100, 1000000)
             / 1000000.0::DOUBLE AS yes_ask,
          CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS size
        FROM events""",
    "prints": """
        SELECT event_id AS seq, epoch_us(ts) // 1000 AS ts_ms, 'A' || (user_id % 8) AS market,
          least(1 + CAST(round(value * 100) AS BIGINT) // 500, 99) AS level,
          least(1 + CAST(round(value * 100) AS BIGINT) // 500, 99) / 100.0::DOUBLE AS price,
          CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS qty,
          CASE WHEN event_type IN ('click','purchase') THEN 'BUY'
               WHEN event_type IN ('view','error') THEN 'SELL' ELSE 'UNKNOWN' END AS aggressor,
          event_type, user_id
        FROM events""",
    "resting": """
        SELECT seq AS order_id, market, ts_ms + 50 AS arrival_ms,
          ts_ms + 50 + 172800000 AS end_ms, level, price, qty AS size,
          (user_id % 2 = 0) AS side_buy
        FROM prints WHERE event_type = 'purchase'""",
    "episodes": """
        SELECT *, gross_pnl_usd - fees_usd AS net_pnl_usd,
          CASE WHEN l_linenumber % 3 <> 0 THEN gross_pnl_usd - fees_usd * 1.5::DOUBLE END AS pnl_historical_usd,
          CASE WHEN exit_type = 'no_fill' THEN NULL ELSE f0 END AS fill_ts_ms,
          CASE WHEN exit_type = 'no_fill' THEN NULL ELSE x0 END AS exit_ts_ms,
          (exit_type <> 'no_fill') AS is_filled
        FROM (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS episode_id,
          'S' || (l_suppkey % 3) AS strategy_version, 'M' || o_custkey AS market,
          l_returnflag AS asset, o_orderpriority AS horizon, o_orderstatus AS regime,
          l_linestatus AS fill_profile, (l_suppkey % 2 = 0) AS is_maker,
          epoch_ms(least(o_orderdate, l_shipdate)) AS f0,
          epoch_ms(greatest(o_orderdate, l_shipdate)) AS x0,
          CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 'no_fill'
               WHEN l_linenumber = 2 THEN 'hedge' WHEN l_linenumber = 3 THEN 'sell'
               WHEN l_linenumber = 4 THEN 'stop' ELSE 'resolution' END AS exit_type,
          l_extendedprice AS actual_notional_usd, l_quantity AS stake_usd,
          l_extendedprice * (l_discount - l_tax) AS gross_pnl_usd,
          l_extendedprice * 0.001::DOUBLE * l_linenumber AS fees_usd,
          (l_discount - l_tax) * 100 AS markout_5s_pp,
          l_quantity / 51.0::DOUBLE AS fill_price, l_discount * 10 AS exit_price,
          l_quantity AS fill_qty, l_linenumber, o_custkey, l_orderkey
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "evals": """
        SELECT 'run-1' AS run_id, 'P' || l_orderkey AS pair_id, 'M' || o_custkey AS market_id,
          CASE l_linenumber WHEN 1 THEN 'CONTROL' WHEN 2 THEN 'QUANT'
               ELSE 'ARM' || l_linenumber END AS variant,
          l_returnflag AS asset, o_orderpriority AS horizon, o_orderstatus AS regime,
          CASE WHEN l_linestatus = 'O' THEN 'OUT_OF_SAMPLE' ELSE 'EXPLORATION' END AS split,
          CASE WHEN l_tax > 0.04 THEN 'EXACT' ELSE 'PROXY' END AS fidelity,
          'F' || (l_suppkey % 3) AS fill_model, 'L' || (l_suppkey % 2) AS latency_profile,
          l_partkey % 1000 AS latency_ms,
          (l_discount >= 0.03) AS quoted, (l_discount >= 0.03 AND l_tax <= 0.05) AS filled,
          CASE WHEN l_discount >= 0.03 AND l_tax <= 0.05 THEN (l_discount - l_tax) * 100 END AS markout_5s_pp,
          CASE WHEN l_quantity <> 13 THEN (l_quantity - 25) / 10 END AS drift_5s_pp,
          CASE WHEN l_quantity <> 13 THEN (l_quantity - 25) / 20 + l_tax END AS drift_1s_pp,
          l_discount * 10 AS fair_p_yes, l_tax * 10 AS pressure,
          CASE WHEN l_discount >= 0.03 AND l_tax <= 0.05 THEN (l_discount - l_tax) * l_quantity ELSE 0 END AS pnl_pp,
          (l_partkey % 7 = 0) AS stale_skipped, (l_linenumber > 5) AS incomplete_pair,
          l_discount * 10 AS underreact_up, l_tax * 10 AS underreact_down,
          l_quantity / 50 AS move_persists, l_quantity / 51 AS p_up,
          1 - l_tax * 10 AS fill_before_decay, l_tax * 5 AS fill_toxic, l_tax * 4 AS no_pressure_5s,
          (l_discount + l_tax) * 5 AS yes_pressure_5s,
          l_extendedprice / 1000 AS ret_5s_pct, l_extendedprice / (l_quantity * 1000) AS spread,
          epoch_ms(l_shipdate) AS ts_ms, l_orderkey, l_linenumber, l_partkey, l_suppkey,
          l_extendedprice, o_custkey
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "ab": """
        SELECT * FROM evals WHERE l_linenumber IN (1, 2)
        QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
          ORDER BY l_partkey, l_suppkey, l_extendedprice, ts_ms) = 1""",
    "spans": """
        SELECT 'M' || o_custkey AS condition_id, min(epoch_ms(o_orderdate)) AS info_start_ms,
          max(epoch_ms(o_orderdate)) AS resolution_ms, count(*) AS n_orders
        FROM orders GROUP BY o_custkey""",
}

_DEPENDS = {"resting": ["prints"], "ab": ["evals"]}


def with_views(using: str, sql: str) -> str:
    names: list[str] = []
    for name in using.split():
        for needed in [*_DEPENDS.get(name, []), name]:
            if needed not in names:
                names.append(needed)
    if not names:
        return sql
    head = ", ".join(f"{n} AS ({SQL_VIEWS[n]})" for n in names)
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {head}, {body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {head}, {body[5:]}"
    return f"WITH {head} {body}"


def _ms(c: str) -> Column:
    return F.unix_millis(F.col(c).cast("timestamp"))


class Tables:
    """Lazy access to one scale's tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def wide(self) -> Tables:
        """The same tables for costly row functions: scans of fewer partitions than cores are dealt out to all cores."""
        return _Wide(self.spark, self.dir)

    @property
    def joined(self) -> Tables:
        """The same tables, with lines and orders joined once for all their readers."""
        return Joined(self.spark, self.dir)

    @cached_property
    def _events(self) -> DataFrame:
        k = F.regexp_extract("props", "[0-9]+", 0)
        cents = F.round(F.col("value") * 100).cast("long")
        return self.raw("events").select(
            F.col("event_id").alias("seq"),
            _ms("ts").alias("ts_ms"),
            F.concat(F.lit("A"), (F.col("user_id") % 8).cast("string")).alias("asset"),
            F.col("value").alias("price"),
            k.cast("long").alias("k"),
            cents.alias("cents"),
            "event_type",
            "user_id",
        )

    @cached_property
    def ticks(self) -> DataFrame:
        venue = (
            F.when(F.col("user_id") % 3 == 0, "binance")
            .when(F.col("user_id") % 3 == 1, "coinbase")
            .otherwise("deribit")
        )
        return self._events.where(F.col("price") > 0).select(
            "seq", "ts_ms", "asset", venue.alias("venue"), "price",
            F.col("k").cast("double").alias("qty"), self._side().alias("side"),
            "event_type", "user_id",
        )

    @staticmethod
    def _side() -> Column:
        return F.when(F.col("event_type").isin("click", "purchase"), "BUY").when(
            F.col("event_type").isin("view", "error"), "SELL"
        )

    @cached_property
    def quotes(self) -> DataFrame:
        bid = F.least(F.col("cents") * 18, F.lit(990000))
        ask = F.least(bid + F.col("k") * 100, F.lit(1000000))
        return self._events.select(
            "seq", "ts_ms", "asset", "event_type", "user_id",
            bid.alias("bid_micros"), ask.alias("ask_micros"),
            (bid / 1000000.0).alias("yes_bid"), (ask / 1000000.0).alias("yes_ask"),
            F.col("k").cast("double").alias("size"),
        )

    @cached_property
    def prints(self) -> DataFrame:
        level = F.least(1 + F.floor(F.col("cents") / 500), F.lit(99)).cast("long")
        return self._events.select(
            "seq", "ts_ms", F.col("asset").alias("market"), level.alias("level"),
            (level / 100.0).alias("price"), F.col("k").cast("double").alias("qty"),
            F.coalesce(self._side(), F.lit("UNKNOWN")).alias("aggressor"),
            "event_type", "user_id",
        )

    @cached_property
    def resting(self) -> DataFrame:
        return self.prints.where(F.col("event_type") == "purchase").select(
            F.col("seq").alias("order_id"), "market",
            (F.col("ts_ms") + 50).alias("arrival_ms"),
            (F.col("ts_ms") + 50 + 2 * DAY_MS).alias("end_ms"),
            "level", "price", F.col("qty").alias("size"),
            (F.col("user_id") % 2 == 0).alias("side_buy"),
        )

    @cached_property
    def _lines(self) -> DataFrame:
        return self.raw("lineitem").join(
            self.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey")
        )

    @cached_property
    def episodes(self) -> DataFrame:
        col = F.col
        exit_type = (
            F.when((col("l_linestatus") == "F") & (col("l_returnflag") == "R"), "no_fill")
            .when(col("l_linenumber") == 2, "hedge")
            .when(col("l_linenumber") == 3, "sell")
            .when(col("l_linenumber") == 4, "stop")
            .otherwise("resolution")
        )
        filled = col("exit_type") != "no_fill"
        return (
            self._lines.select(
                F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("episode_id"),
                F.concat(F.lit("S"), (col("l_suppkey") % 3).cast("string")).alias("strategy_version"),
                F.concat(F.lit("M"), col("o_custkey").cast("string")).alias("market"),
                col("l_returnflag").alias("asset"),
                col("o_orderpriority").alias("horizon"),
                col("o_orderstatus").alias("regime"),
                col("l_linestatus").alias("fill_profile"),
                (col("l_suppkey") % 2 == 0).alias("is_maker"),
                F.least(_ms("o_orderdate"), _ms("l_shipdate")).alias("f0"),
                F.greatest(_ms("o_orderdate"), _ms("l_shipdate")).alias("x0"),
                exit_type.alias("exit_type"),
                col("l_extendedprice").alias("actual_notional_usd"),
                col("l_quantity").alias("stake_usd"),
                (col("l_extendedprice") * (col("l_discount") - col("l_tax"))).alias("gross_pnl_usd"),
                (col("l_extendedprice") * F.lit(0.001) * col("l_linenumber")).alias("fees_usd"),
                ((col("l_discount") - col("l_tax")) * 100).alias("markout_5s_pp"),
                (col("l_quantity") / 51.0).alias("fill_price"),
                (col("l_discount") * 10).alias("exit_price"),
                col("l_quantity").alias("fill_qty"),
                "l_linenumber", "o_custkey", "l_orderkey",
            )
            .withColumns(
                {
                    "net_pnl_usd": col("gross_pnl_usd") - col("fees_usd"),
                    "pnl_historical_usd": F.when(col("l_linenumber") % 3 != 0, col("gross_pnl_usd") - col("fees_usd") * 1.5),
                    "fill_ts_ms": F.when(filled, col("f0")),
                    "exit_ts_ms": F.when(filled, col("x0")),
                    "is_filled": filled,
                }
            )
        )

    @cached_property
    def evals(self) -> DataFrame:
        col = F.col
        d, t, q = col("l_discount"), col("l_tax"), col("l_quantity")
        filled = (d >= 0.03) & (t <= 0.05)
        return self._lines.select(
            F.lit("run-1").alias("run_id"),
            F.concat(F.lit("P"), col("l_orderkey").cast("string")).alias("pair_id"),
            F.concat(F.lit("M"), col("o_custkey").cast("string")).alias("market_id"),
            F.when(col("l_linenumber") == 1, "CONTROL")
            .when(col("l_linenumber") == 2, "QUANT")
            .otherwise(F.concat(F.lit("ARM"), col("l_linenumber").cast("string")))
            .alias("variant"),
            col("l_returnflag").alias("asset"),
            col("o_orderpriority").alias("horizon"),
            col("o_orderstatus").alias("regime"),
            F.when(col("l_linestatus") == "O", "OUT_OF_SAMPLE").otherwise("EXPLORATION").alias("split"),
            F.when(t > 0.04, "EXACT").otherwise("PROXY").alias("fidelity"),
            F.concat(F.lit("F"), (col("l_suppkey") % 3).cast("string")).alias("fill_model"),
            F.concat(F.lit("L"), (col("l_suppkey") % 2).cast("string")).alias("latency_profile"),
            (col("l_partkey") % 1000).alias("latency_ms"),
            (d >= 0.03).alias("quoted"),
            filled.alias("filled"),
            F.when(filled, (d - t) * 100).alias("markout_5s_pp"),
            F.when(q != 13, (q - 25) / 10).alias("drift_5s_pp"),
            F.when(q != 13, (q - 25) / 20 + t).alias("drift_1s_pp"),
            (d * 10).alias("fair_p_yes"),
            (t * 10).alias("pressure"),
            F.when(filled, (d - t) * q).otherwise(0.0).alias("pnl_pp"),
            (col("l_partkey") % 7 == 0).alias("stale_skipped"),
            (col("l_linenumber") > 5).alias("incomplete_pair"),
            (d * 10).alias("underreact_up"),
            (t * 10).alias("underreact_down"),
            (q / 50).alias("move_persists"),
            (q / 51).alias("p_up"),
            (1 - t * 10).alias("fill_before_decay"),
            (t * 5).alias("fill_toxic"),
            (t * 4).alias("no_pressure_5s"),
            ((d + t) * 5).alias("yes_pressure_5s"),
            (col("l_extendedprice") / 1000).alias("ret_5s_pct"),
            (col("l_extendedprice") / (q * 1000)).alias("spread"),
            _ms("l_shipdate").alias("ts_ms"),
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "o_custkey",
        )

    @cached_property
    def ab(self) -> DataFrame:
        rows = self.evals.where(F.col("l_linenumber").isin(1, 2))
        order = F.struct("l_partkey", "l_suppkey", "l_extendedprice", "ts_ms")
        return (
            rows.groupBy("l_orderkey", "l_linenumber")
            .agg(F.min_by(F.struct(*rows.columns), order).alias("_r"))
            .select("_r.*")
        )

    @cached_property
    def spans(self) -> DataFrame:
        return self.raw("orders").groupBy("o_custkey").agg(
            F.min(_ms("o_orderdate")).alias("info_start_ms"),
            F.max(_ms("o_orderdate")).alias("resolution_ms"),
            F.count(F.lit(1)).alias("n_orders"),
        ).select(
            F.concat(F.lit("M"), F.col("o_custkey").cast("string")).alias("condition_id"),
            "info_start_ms", "resolution_ms", "n_orders",
        )


class _Wide(Tables):
    def raw(self, name: str) -> DataFrame:
        return spread(super().raw(name))


class Joined(Tables):
    """The same tables for queries that read lines several times: lines and orders are joined and written once.

    The columns of the tables are written and not those derived from them, which take several times their space.
    """

    def lines_read(self) -> DataFrame:
        return Tables._lines.func(self).select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
            "l_linestatus", "l_shipdate", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority",
        )

    @cached_property
    def _lines(self) -> DataFrame:
        return settle(self.lines_read(), "lines")
