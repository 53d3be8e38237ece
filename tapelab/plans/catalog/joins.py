"""As-of family on the driver's events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapelab.operators import asof
from tapelab.operators.scan import DAY_MS, HOUR_MS
from tapelab.plans.registry import query, r
from tapelab.session import tasks_for

_BUY = "buys AS (SELECT * FROM ticks WHERE side = 'BUY'), sells AS (SELECT * FROM ticks WHERE side = 'SELL')"


@query("J1_asof_backward", using="ticks", sql=f"""
WITH {_BUY}
SELECT b.seq, b.asset, b.ts_ms, s.price AS sell_price, s.seq AS sell_seq
FROM buys b ASOF LEFT JOIN sells s ON b.asset = s.asset AND b.ts_ms >= s.ts_ms
""")
def _(t):
    left = t.ticks.where(F.col("side") == "BUY").select("seq", "asset", "ts_ms")
    right = t.ticks.where(F.col("side") == "SELL").select(
        "asset", "ts_ms", F.col("price").alias("sell_price"), F.col("seq").alias("sell_seq")
    )
    return asof.asof_backward(
        left, right, "ts_ms", ["asset"], ["sell_price", "sell_seq"], tie="sell_seq", width=DAY_MS
    )


_H = {"mid_1h": HOUR_MS, "mid_5h": 5 * HOUR_MS, "mid_10h": 10 * HOUR_MS, "mid_30h": 30 * HOUR_MS, "mid_60h": 60 * HOUR_MS}


def _offset_sql(offsets, op):
    cols = ", ".join(f"x{i}.price AS {n}" for i, n in enumerate(offsets))
    joins = " ".join(
        f"LEFT JOIN h{i} x{i} ON x{i}.seq = t.seq" for i in range(len(offsets))
    )
    ctes = ", ".join(
        f"h{i} AS (SELECT a.seq, b.price FROM (SELECT seq, asset, ts_ms + {ms} AS tgt FROM ticks) a "
        f"ASOF LEFT JOIN b ON a.asset = b.asset AND a.tgt {op} b.ts_ms)"
        for i, ms in enumerate(offsets.values())
    )
    # Of ticks of one time the one nearest to the target in seq order counts.
    pick = "arg_min" if op == "<=" else "arg_max"
    ctes = f"b AS (SELECT asset, ts_ms, {pick}(price, seq) AS price FROM ticks GROUP BY 1, 2), {ctes}"
    return f"WITH {ctes} SELECT t.seq, t.asset, t.ts_ms, {cols} FROM ticks t {joins}"


@query("J2_asof_forward", using="ticks", sql=_offset_sql(_H, "<="))
def _(t):
    ticks = t.ticks.select("seq", "asset", "ts_ms", "price")
    out = asof.forward_labels(
        ticks.drop("price"), ticks, "ts_ms", ["asset"], ["seq"], "price", _H, tie="seq", width=DAY_MS
    )
    return out


_LAGS = {"price_1h_ago": HOUR_MS, "price_5h_ago": 5 * HOUR_MS, "price_30h_ago": 30 * HOUR_MS}


@query("J3_lag_asof", using="ticks", sql=_offset_sql({k: -v for k, v in _LAGS.items()}, ">="))
def _(t):
    ticks = t.ticks.select("seq", "asset", "ts_ms", "price")
    return asof.lag_asof(
        ticks.drop("price"), ticks, "ts_ms", ["asset"], ["seq"], "price", _LAGS, tie="seq", width=DAY_MS
    )


@query("J4_lag_exact", using="evals", sql="""
WITH s AS (SELECT market_id, ts_ms // 86400000 * 86400000 AS ts_ms, max(ret_5s_pct) AS mid FROM evals GROUP BY ALL)
SELECT a.market_id, a.ts_ms, a.mid, b.mid AS mid_1d, c.mid AS mid_5d,
  CASE WHEN a.mid IS NULL THEN 'null_quote' WHEN b.mid IS NULL OR c.mid IS NULL THEN 'short_history' END AS incomplete_reason
FROM s a LEFT JOIN s b ON a.market_id = b.market_id AND b.ts_ms = a.ts_ms - 86400000
LEFT JOIN s c ON a.market_id = c.market_id AND c.ts_ms = a.ts_ms - 432000000
""")
def _(t):
    day = F.col("ts_ms") - F.pmod("ts_ms", F.lit(DAY_MS))
    # Dealt to tasks by rows: nearly every line is a day of its market of its own, so a task holds what it reads.
    lines = t.evals.select("market_id", day.alias("ts_ms"), "ret_5s_pct").repartition(tasks_for(t.raw("lineitem")), "market_id", "ts_ms")
    s = lines.groupBy("market_id", "ts_ms").agg(F.max("ret_5s_pct").alias("mid"))
    return asof.lag_exact(s, "ts_ms", ["market_id"], "mid", {"mid_1d": DAY_MS, "mid_5d": 5 * DAY_MS}, width=365 * DAY_MS)


# Rounded half up by its decimal digits, as Spark rounds a double; DuckDB's own rounding multiplies the double first.
@query("J5_interpolate", using="ticks", sql="""
WITH g AS (SELECT seq, asset, ts_ms + 3600000 AS tgt FROM ticks),
one AS (SELECT asset, ts_ms, arg_min(price, seq) AS first, arg_max(price, seq) AS last FROM ticks GROUP BY 1, 2),
lo AS (SELECT g.seq, b.last AS price, b.ts_ms FROM g ASOF LEFT JOIN one b ON g.asset = b.asset AND g.tgt > b.ts_ms),
hi AS (SELECT g.seq, b.first AS price, b.ts_ms FROM g ASOF LEFT JOIN one b ON g.asset = b.asset AND g.tgt <= b.ts_ms)
SELECT g.seq, g.asset, g.tgt, round((CASE WHEN hi.ts_ms = g.tgt THEN hi.price
  WHEN lo.ts_ms IS NOT NULL AND hi.ts_ms IS NOT NULL
  THEN lo.price + (hi.price - lo.price) * ((g.tgt - lo.ts_ms) / (hi.ts_ms - lo.ts_ms)) END)::VARCHAR::DECIMAL(38, 20), 6)::DOUBLE AS price_at
FROM g JOIN lo ON g.seq = lo.seq JOIN hi ON g.seq = hi.seq
""")
def _(t):
    ticks = t.ticks.select("seq", "asset", "ts_ms", "price")
    targets = ticks.select("seq", "asset", (F.col("ts_ms") + HOUR_MS).alias("tgt"))
    got = asof.interpolate(
        targets, ticks, "tgt", ["asset"], "price", tick_on="ts_ms", tie="seq", width=DAY_MS
    )
    return got.select("seq", "asset", "tgt", r("price_at", "price_at"))


@query("J6_asof_regime", using="evals", sql="""
WITH reg AS (SELECT asset || 'USDT' AS symbol, ts_ms // 2592000000 * 2592000 AS day_ts,
  CASE WHEN avg(ret_5s_pct) > 50 THEN 'HIGH_VOL' ELSE 'LOW_VOL' END || '-' ||
  CASE WHEN avg(spread) > 2 THEN 'STRONG_UP' ELSE 'SIDEWAYS' END AS label
  FROM evals WHERE asset <> 'N' GROUP BY 1, 2)
SELECT e.pair_id, e.l_linenumber, e.l_partkey, e.l_suppkey, e.asset, e.ts_ms, coalesce(g.label, 'UNKNOWN-UNKNOWN') AS regime
FROM (SELECT *, ts_ms // 86400000 * 86400 AS d FROM evals) e
ASOF LEFT JOIN reg g ON starts_with(g.symbol, e.asset) AND e.asset || 'USDT' = g.symbol AND e.d >= g.day_ts
""")
def _(t):
    month = 30 * DAY_MS
    regimes = (
        t.evals.where(F.col("asset") != "N")
        .groupBy(
            F.concat("asset", F.lit("USDT")).alias("symbol"),
            (F.floor(F.col("ts_ms") / month) * (month // 1000)).cast("long").alias("day_ts"),
        )
        .agg(
            F.when(F.avg("ret_5s_pct") > 50, "HIGH_VOL").otherwise("LOW_VOL").alias("vol_regime"),
            F.when(F.avg("spread") > 2, "STRONG_UP").otherwise("SIDEWAYS").alias("trend_regime"),
        )
    )
    rows = t.evals.select("pair_id", "l_linenumber", "l_partkey", "l_suppkey", "asset", "ts_ms")
    return asof.asof_regime(rows, regimes, "ts_ms", "asset")


@query("J16_merge_events", using="ticks quotes prints", sql="""
SELECT ts_ms, 'tick' AS kind, 0 AS rank, seq, price AS v FROM ticks
UNION ALL SELECT ts_ms, 'top', 1, seq, yes_bid FROM quotes
UNION ALL SELECT ts_ms, 'trade', 2, seq, price FROM prints
ORDER BY ts_ms, rank, seq
""")
def _(t):
    return asof.merge_events(
        {
            "tick": t.ticks.select("ts_ms", "seq", F.col("price").alias("v")),
            "top": t.quotes.select("ts_ms", "seq", F.col("yes_bid").alias("v")),
            "trade": t.prints.select("ts_ms", "seq", F.col("price").alias("v")),
        },
        "ts_ms",
        "seq",
    )


@query("J19_anchor_price", using="ticks", sql="""
WITH m AS (SELECT DISTINCT asset, ts_ms // 21600000 * 21600000 AS start_ms FROM ticks
  UNION SELECT DISTINCT asset, 1706700000000 FROM ticks),
f AS (SELECT asset, arg_min(price, struct_pack(ts_ms, seq)) AS p FROM ticks GROUP BY asset)
SELECT m.asset, m.start_ms, coalesce(b.price, f.p) AS anchor,
  CASE WHEN b.price IS NOT NULL THEN 'at_or_after_start' ELSE 'earliest_loaded' END AS anchor_rule
FROM m ASOF LEFT JOIN ticks b ON m.asset = b.asset AND m.start_ms <= b.ts_ms JOIN f ON f.asset = m.asset
""")
def _(t):
    ticks = t.ticks.select("asset", "ts_ms", "price", "seq")
    six = 6 * HOUR_MS
    starts = ticks.select(
        "asset", (F.col("ts_ms") - F.pmod("ts_ms", F.lit(six))).alias("start_ms")
    ).union(ticks.select("asset", F.lit(1706700000000).cast("long")))
    return asof.anchor_price(
        starts.distinct(), ticks, "start_ms", ["asset"], "price", "ts_ms", tie="seq", width=DAY_MS
    )
