"""Order flow, rolling windows, sampling, fills and sorting."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapelab.operators import fills, flow, intervals, sampling, scan
from tapelab.operators.scan import DAY_MS, HOUR_MS
from tapelab.plans import features
from tapelab.plans.registry import query, r

col = F.col


@query("A28_order_flow", using="ticks", sql="""
WITH f AS (SELECT *, coalesce(sum(CASE WHEN side = 'BUY' THEN qty END) OVER w1, 0) AS b1, coalesce(sum(CASE WHEN side = 'SELL' THEN qty END) OVER w1, 0) AS s1,
  coalesce(sum(CASE WHEN side = 'BUY' THEN qty END) OVER w5, 0) AS b5, coalesce(sum(CASE WHEN side = 'SELL' THEN qty END) OVER w5, 0) AS s5 FROM ticks
  WINDOW w1 AS (PARTITION BY asset ORDER BY ts_ms RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW),
         w5 AS (PARTITION BY asset ORDER BY ts_ms RANGE BETWEEN 18000000 PRECEDING AND CURRENT ROW))
SELECT seq, b1 AS buy_vol, s1 AS sell_vol, b1 - s1 AS ofi_short, b5 - s5 AS ofi_long,
  round(CASE WHEN b5 + s5 > 0 THEN (b5 - s5) / (b5 + s5) ELSE 0 END, 6) AS imbalance,
  round(CASE WHEN b5 + s5 > 0 THEN b5 / (b5 + s5) ELSE 0.5 END, 6) AS buy_ratio FROM f""")
def _(t):
    got = flow.order_flow(
        t.ticks, ["asset"], "ts_ms", short_ms=HOUR_MS, long_ms=5 * HOUR_MS, basis="long", empty_ratio=0.5, width=DAY_MS
    )
    return got.select(
        "seq", "buy_vol", "sell_vol", (col("ofi_short") + 0.0).alias("ofi_short"), (col("ofi_long") + 0.0).alias("ofi_long"),
        r("imbalance", "imbalance"), r("buy_ratio", "buy_ratio"),
    )


@query("E1_rolling_stats", using="ticks", sql="""
SELECT seq, round(avg(price) OVER w, 6) AS roll_mean, round(var_pop(price) OVER w, 2) AS roll_var, list(price) OVER w AS last_n FROM ticks
WINDOW w AS (PARTITION BY asset ORDER BY ts_ms, seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def _(t):
    got = flow.rolling_stats(t.ticks, ["asset"], "ts_ms", "price", 20, ("seq",), width=DAY_MS, block=500)
    return got.select("seq", r("roll_mean", "roll_mean"), r("roll_var", "roll_var", 2), "last_n")


_HZ = {"ret_1h": HOUR_MS, "ret_6h": 6 * HOUR_MS, "ret_24h": 24 * HOUR_MS}


def _interp_sql(offsets):
    ctes, sel, joins = [], [], []
    for n, ms in offsets.items():
        ctes.append(f"""g{n} AS (SELECT seq, asset, ts_ms - {ms} AS tgt FROM ticks),
 l{n} AS (SELECT g.seq, b.last p, b.ts_ms s FROM g{n} g ASOF LEFT JOIN one b ON g.asset = b.asset AND g.tgt > b.ts_ms),
 h{n} AS (SELECT g.seq, g.tgt, b.first p, b.ts_ms s FROM g{n} g ASOF LEFT JOIN one b ON g.asset = b.asset AND g.tgt <= b.ts_ms),
 v{n} AS (SELECT h.seq, CASE WHEN h.s = h.tgt THEN h.p WHEN l.s IS NOT NULL AND h.s IS NOT NULL THEN l.p + (h.p - l.p) * ((h.tgt - l.s) / (h.s - l.s)) END AS v
   FROM h{n} h JOIN l{n} l ON h.seq = l.seq)""")
        sel.append(f"round(coalesce((one.first / v{n}.v - 1) * 100, 0), 6) AS {n}")
        joins.append(f"JOIN v{n} ON v{n}.seq = t.seq")
    # The series has one price a time: the first in seq order where a time is hit or lies ahead, the last where it lies behind.
    one = "one AS (SELECT asset, ts_ms, arg_min(price, seq) AS first, arg_max(price, seq) AS last FROM ticks GROUP BY 1, 2)"
    ends = "JOIN one ON one.asset = t.asset AND one.ts_ms = t.ts_ms"
    return f"WITH {one}, {', '.join(ctes)} SELECT t.seq, {', '.join(sel)} FROM ticks t {ends} {' '.join(joins)}"


@query("E2_horizon_returns", using="ticks", sql=_interp_sql(_HZ))
def _(t):
    ticks = t.ticks.select("seq", "asset", "ts_ms", "price")
    got = flow.horizon_returns(ticks, ticks, "ts_ms", ["asset"], ["seq"], "price", _HZ, tie="seq", width=DAY_MS)
    return got.select("seq", *[r(n, n) for n in _HZ])


_VOL_SQL = """
WITH e AS (SELECT DISTINCT asset, ts_ms // 21600000 * 21600000 AS ts_ms FROM ticks),
g AS (SELECT DISTINCT asset, ts_ms - k * 360000 AS tgt FROM e, range(0, 3601) r(k)),
l AS (SELECT g.asset, g.tgt, b.price p, b.ts_ms s FROM g ASOF LEFT JOIN ticks b ON g.asset = b.asset AND g.tgt > b.ts_ms),
h AS (SELECT g.asset, g.tgt, b.price p, b.ts_ms s FROM g ASOF LEFT JOIN ticks b ON g.asset = b.asset AND g.tgt <= b.ts_ms),
v AS (SELECT h.asset, h.tgt, CASE WHEN h.s = h.tgt THEN h.p WHEN l.s IS NOT NULL AND h.s IS NOT NULL THEN l.p + (h.p - l.p) * ((h.tgt - l.s) / (h.s - l.s)) END AS v
  FROM h JOIN l ON h.asset = l.asset AND h.tgt = l.tgt),
ret AS (SELECT a.asset, a.tgt, (a.v / b.v - 1) * 100 AS r FROM v a JOIN v b ON a.asset = b.asset AND b.tgt = a.tgt - 360000)
SELECT e.asset, e.ts_ms, round(CASE WHEN count(r) FILTER (tgt > e.ts_ms - 60 * 360000) = 60 THEN stddev_pop(r) FILTER (tgt > e.ts_ms - 60 * 360000) ELSE 0 END, 4) AS vol_60,
 round(CASE WHEN count(r) FILTER (tgt > e.ts_ms - 300 * 360000) = 300 THEN stddev_pop(r) FILTER (tgt > e.ts_ms - 300 * 360000) ELSE 0 END, 4) AS vol_300,
 round(CASE WHEN count(r) = 3600 THEN stddev_pop(r) ELSE 0 END, 4) AS vol_3600
FROM e LEFT JOIN ret ON e.asset = ret.asset AND tgt <= e.ts_ms AND tgt > e.ts_ms - 3600 * 360000 GROUP BY 1, 2"""


@query("E3_realized_vol", using="ticks", sql=_VOL_SQL)
def _(t):
    ticks = t.ticks.select("seq", "asset", "ts_ms", "price")
    ends = ticks.select("asset", (col("ts_ms") - F.pmod("ts_ms", F.lit(6 * HOUR_MS))).alias("ts_ms")).distinct()
    got = flow.realized_vol(
        ends, ticks, "ts_ms", ["asset"], "price", {f"vol_{n}": n for n in features.VOLS.values()}, step_ms=360_000, tie="seq", width=DAY_MS
    )
    return got.select("asset", "ts_ms", *[r(f"vol_{n}", f"vol_{n}", 4) for n in features.VOLS.values()])


@query("E4_ret_prev", using="ticks", sql="""
SELECT seq, round(price / lag(price) OVER (PARTITION BY asset ORDER BY ts_ms, seq) - 1, 6) AS ret FROM ticks""")
def _(t):
    return flow.ret_prev(t.ticks, ["asset"], "ts_ms", "price", ("seq",)).select("seq", r("ret", "ret"))


_EQ = """eq AS (SELECT asset, horizon, variant, ts_ms, pair_id || '-' || l_partkey || '-' || l_suppkey || '-' || l_extendedprice AS id, l_extendedprice - 40000 AS total_pnl FROM evals)"""


def _equity(t):
    ident = F.concat_ws("-", "pair_id", "l_partkey", "l_suppkey")
    return t.evals.select(
        "asset", "horizon", "variant", "ts_ms", ident.alias("id"), "l_extendedprice",
        (col("l_extendedprice") - 40000).alias("total_pnl"),
    )


@query("E5_equity_curve", using="evals", sql="""
WITH eq AS (SELECT asset, horizon, variant, ts_ms, pair_id || '-' || l_partkey || '-' || l_suppkey AS id, l_extendedprice, l_extendedprice - 40000 AS total_pnl FROM evals)
SELECT asset, horizon, variant, ts_ms, id, l_extendedprice, round(max(total_pnl) OVER w, 4) AS high_watermark, round(max(total_pnl) OVER w - total_pnl, 4) AS drawdown
FROM eq WINDOW w AS (PARTITION BY asset, horizon, variant ORDER BY ts_ms, id, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def _(t):
    got = flow.equity_curve(
        _equity(t), ["asset", "horizon", "variant"], "ts_ms", "total_pnl", ("id", "l_extendedprice"), width=30 * DAY_MS
    )
    return got.select(
        "asset", "horizon", "variant", "ts_ms", "id", "l_extendedprice",
        r("high_watermark", "high_watermark", 4), r("drawdown", "drawdown", 4),
    )


@query("A9_sample_by_day", using="ticks", sql="""
SELECT asset, venue, ts_ms // 86400000 * 86400000 AS day_ms, arg_min(price, (ts_ms, seq)) AS first_value, arg_max(price, (ts_ms, seq)) AS last_value,
  round(arg_max(price, (ts_ms, seq)) - arg_min(price, (ts_ms, seq)), 6) AS day_change, max(price) AS peak, min(price) AS trough FROM ticks GROUP BY 1, 2, 3""")
def _(t):
    got = flow.sample_by_day(t.ticks, ["asset", "venue"], "ts_ms", "price", ("seq",))
    return got.withColumn("day_change", r("day_change", "x"))


@query("A11_daily_vol_drift", using="ticks", sql="""
WITH rt AS (SELECT *, price / lag(price) OVER (PARTITION BY asset ORDER BY ts_ms, seq) - 1 AS ret FROM ticks)
SELECT asset, ts_ms // 86400000 * 86400000 AS day_ms, arg_max(price, (ts_ms, seq)) AS close, round(stddev_samp(ret), 4) AS vol_1m,
  round((arg_max(price, (ts_ms, seq)) / arg_min(price, (ts_ms, seq)) - 1) * 100, 4) AS drift_pp FROM rt GROUP BY 1, 2""")
def _(t):
    got = flow.daily_vol_drift(t.ticks, "asset", "ts_ms", "price", ("seq",))
    return got.select("asset", "day_ms", "close", r("vol_1m", "vol_1m", 4), r("drift_pp", "drift_pp", 4))


@query("A12_candles", using="ticks", sql="""
WITH c AS (SELECT asset, ts_ms // 86400000 * 86400000 AS start_ms, arg_min(price, (ts_ms, seq)) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, (ts_ms, seq)) AS close, count(*) AS n_ticks FROM ticks GROUP BY 1, 2)
SELECT *, start_ms = max(start_ms) OVER (PARTITION BY asset) AS forming FROM c""")
def _(t):
    return flow.candles(t.ticks, ["asset"], "ts_ms", "price", ("seq",))


@query("E16_print_touch", using="prints", sql="""
WITH k AS (SELECT *, last_value(CASE WHEN aggressor = 'SELL' THEN price END IGNORE NULLS) OVER w AS b, last_value(CASE WHEN aggressor = 'BUY' THEN price END IGNORE NULLS) OVER w AS a
 FROM prints WINDOW w AS (PARTITION BY market ORDER BY ts_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT seq, round(coalesce(b, greatest(price - 0.01, 0)), 6) AS touch_bid, round(coalesce(a, least(price + 0.01, 1)), 6) AS touch_ask FROM k""")
def _(t):
    got = flow.print_touch(t.prints, ["market"], "ts_ms", tie=("seq",), width=DAY_MS)
    return got.select("seq", r("touch_bid", "touch_bid"), r("touch_ask", "touch_ask"))


@query("S5_scan_window", using="ticks", sql="""
WITH k AS (SELECT *, row_number() OVER (ORDER BY ts_ms, seq) - 1 AS p FROM ticks WHERE asset = 'A3' AND ts_ms BETWEEN 1704200000000 AND 1706000000000)
SELECT seq, ts_ms, price FROM k WHERE p % 3 = 0 AND p // 3 < 200""")
def _(t):
    got = sampling.scan_window(t.ticks, "asset", "A3", "ts_ms", 1704200000000, 1706000000000, 3, 200, ("seq",))
    return got.select("seq", "ts_ms", "price")


@query("E11_sample_even", using="ticks", sql="""
WITH k AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts_ms, seq) - 1 AS p, count(*) OVER (PARTITION BY asset) AS n FROM ticks),
i AS (SELECT a.asset, least(12, a.n) AS take, a.n, unnest(range(0, least(12, a.n))) AS o FROM (SELECT DISTINCT asset, n FROM k) a)
SELECT k.seq, k.asset FROM k JOIN i ON k.asset = i.asset AND k.p = i.o * i.n // i.take""")
def _(t):
    return sampling.sample_even(t.ticks, ["asset"], "ts_ms", 12, ("seq",)).select("seq", "asset")


@query("E12_sample_endpoints", using="ticks", sql="""
WITH k AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts_ms, seq) - 1 AS p, count(*) OVER (PARTITION BY asset) AS n FROM ticks),
i AS (SELECT a.asset, least(9, a.n) AS take, a.n, unnest(range(0, least(9, a.n))) AS o FROM (SELECT DISTINCT asset, n FROM k) a)
SELECT k.seq, k.asset FROM k JOIN i ON k.asset = i.asset AND k.p = i.o * (i.n - 1) // (i.take - 1)""")
def _(t):
    return sampling.sample_endpoints(t.ticks, ["asset"], "ts_ms", 9, ("seq",), most=30).select("seq", "asset")


@query("E13_stride", using="ticks", sql="""
WITH k AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts_ms, seq) - 1 AS p, count(*) OVER (PARTITION BY asset) AS n FROM ticks),
s AS (SELECT *, greatest(n // 50, 1) AS st FROM k)
SELECT seq, asset, 'strided' AS part FROM s WHERE p % st = 0 AND p // st < 500 UNION ALL SELECT seq, asset, 'dense' FROM s WHERE p < 500""")
def _(t):
    strided, dense = sampling.stride(t.ticks, ["asset"], "ts_ms", 50, 500, ("seq",))
    return strided.select("seq", "asset", F.lit("strided").alias("part")).unionByName(
        dense.select("seq", "asset", F.lit("dense").alias("part"))
    )


@query("E14_cap_per_bucket", using="ticks", sql="""
SELECT seq, asset, venue FROM ticks QUALIFY row_number() OVER (PARTITION BY asset, venue ORDER BY ts_ms, seq) <= 60""")
def _(t):
    return sampling.cap_per_bucket(t.ticks, ["asset", "venue"], "ts_ms", 60, ("seq",)).select("seq", "asset", "venue")


@query("E14_round_robin", using="ticks", sql="""
SELECT seq, asset, row_number() OVER (PARTITION BY asset ORDER BY ts_ms, seq) AS round FROM ticks ORDER BY round, asset""")
def _(t):
    return sampling.round_robin(t.ticks, ["asset"], "ts_ms", ("seq",)).select("seq", "asset", "round")


@query("E17_latest_by", using="ticks", sql="""
SELECT seq, asset, venue, ts_ms, price FROM ticks QUALIFY row_number() OVER (PARTITION BY asset, venue ORDER BY ts_ms DESC, seq DESC) = 1""")
def _(t):
    df = t.ticks.select("seq", "asset", "venue", "ts_ms", "price")
    return sampling.latest_by(df, ["asset", "venue"], ["ts_ms", "seq"])


@query("E18_run_status", using="evals", sql="""
SELECT variant AS run, count(*) AS n_rows, count(*) FILTER (quoted) AS n_quotes, max(ts_ms) AS latest_ts, max(p_up) AS best_signal,
  greatest(1.2 - max(p_up), 0) AS gap_to_gate FROM evals GROUP BY 1""")
def _(t):
    df = t.evals.select(
        col("variant").alias("run"), "ts_ms", F.when(col("quoted"), "QUOTE").otherwise("SKIP").alias("decision"), "p_up"
    )
    return sampling.run_status(df, "run", "ts_ms", "decision", "p_up", 1.2)


@query("E21_temporal_split", using="ticks", sql="""
WITH k AS (SELECT seq, row_number() OVER (ORDER BY ts_ms, seq) AS rn, count(*) OVER () AS n FROM ticks)
SELECT seq, CASE WHEN rn <= CAST(floor(n * 0.5::DOUBLE) AS BIGINT) THEN 'EXPLORATION' WHEN rn <= CAST(floor(n * 0.5::DOUBLE) AS BIGINT) + CAST(floor(n * 0.25::DOUBLE) AS BIGINT) THEN 'VALIDATION' ELSE 'OUT_OF_SAMPLE' END AS split FROM k""")
def _(t):
    fr = {"EXPLORATION": 0.5, "VALIDATION": 0.25, "OUT_OF_SAMPLE": 0.25}
    return sampling.temporal_split(t.ticks, fr, "ts_ms", ("seq",)).select("seq", "split")


@query("O1_sort_tape", using="ticks", sql="SELECT seq, ts_ms, asset, price FROM ticks ORDER BY ts_ms, asset, seq")
def _(t):
    return sampling.sort_tape(t.ticks.select("seq", "ts_ms", "asset", "price"), "ts_ms", "asset", "seq")


@query("O2_top_n", using="ticks", sql="SELECT seq, ts_ms, asset, price FROM ticks ORDER BY ts_ms DESC, seq DESC LIMIT 25")
def _(t):
    return sampling.top_n(t.ticks.select("seq", "ts_ms", "asset", "price"), 25, "ts_ms", "seq")


@query("O3_union_dedupe", using="ticks", sql="""
SELECT asset, seq, ts_ms, CASE WHEN side IS NULL OR side = 'BUY' THEN 'daily' ELSE 'monthly' END AS archive FROM ticks""")
def _(t):
    base = t.ticks.select("asset", "seq", "ts_ms", "side")
    daily = base.where(col("side").isNull() | (col("side") == "BUY")).withColumn("archive", F.lit("daily"))
    monthly = base.withColumn("archive", F.lit("monthly"))
    return sampling.union_dedupe([daily, monthly], ["asset", "seq"], ["ts_ms"]).select("asset", "seq", "ts_ms", "archive")


@query("O4_dedupe_rows", sql="SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem")
def _(t):
    return sampling.dedupe_rows(t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"))


@query("O7_first_by", sql="""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1""")
def _(t):
    df = t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return sampling.first_by(df, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])


_EVID = """ev AS (SELECT o.order_id, p.ts_ms, p.seq, o.size, p.qty * CASE WHEN p.aggressor = 'UNKNOWN' THEN 0.5 ELSE 1 END * CASE WHEN p.level = o.level THEN 0.5 ELSE 1 END AS v,
    CASE WHEN p.level <> o.level THEN 1 ELSE 0 END AS thr
  FROM resting o JOIN prints p ON p.market = o.market AND p.ts_ms BETWEEN o.arrival_ms AND o.end_ms AND p.qty > 0
   AND (p.aggressor = 'UNKNOWN' OR (o.side_buy AND p.aggressor = 'SELL') OR (NOT o.side_buy AND p.aggressor = 'BUY'))
   AND (CASE WHEN o.side_buy THEN p.level <= o.level ELSE p.level >= o.level END)),
 cum AS (SELECT *, sum(v) OVER w AS cv, sum(thr) OVER w AS ct FROM ev WINDOW w AS (PARTITION BY order_id ORDER BY ts_ms))"""


@query("J11_order_evidence", using="resting", sql=f"""
WITH {_EVID}, a AS (SELECT order_id, sum(v) AS q, sum(thr) AS n, max(ts_ms) AS l FROM ev GROUP BY 1)
SELECT o.order_id, coalesce(q, 0)::DOUBLE AS evidence_qty, coalesce(n, 0)::BIGINT AS through_prints, l AS last_print_ms FROM resting o LEFT JOIN a USING (order_id)""")
def _(t):
    got = fills.order_evidence(t.resting, t.prints, width=DAY_MS)
    return got.select("order_id", "evidence_qty", "through_prints", "last_print_ms")


def _fill_sql(profile):
    q = fills.QUEUE_AHEAD[profile]
    share = f"(1.0::DOUBLE - {q})"
    if profile == "CONSERVATIVE":
        want = "CASE WHEN n >= 2 AND eff >= 2 * size - 1e-9 THEN 1.0 WHEN n >= 2 AND eff >= 0.5 * size - 1e-9 THEN 0.5 END"
        done = f"(SELECT min(c.ts_ms) FROM cum c WHERE c.order_id = k.order_id AND c.ct >= 2 AND c.cv * {share} >= CASE WHEN want = 1.0 THEN 2 * k.size ELSE 0.5 * k.size END - 1e-6)"
        ts = f"CASE WHEN want IS NOT NULL THEN {done} ELSE l END"
    else:
        want = "CASE WHEN eff > 0 THEN 1.0 END"
        done = f"(SELECT min(c.ts_ms) FROM cum c WHERE c.order_id = k.order_id AND c.cv * {share} >= k.size - 1e-6)"
        ts = f"CASE WHEN eff >= size - 1e-9 THEN {done} ELSE l END"
    return f"""
WITH {_EVID}, a AS (SELECT o.order_id, o.size, coalesce(sum(v), 0) * {share} AS eff, coalesce(sum(thr), 0) AS n, max(ts_ms) AS l FROM resting o LEFT JOIN ev USING (order_id) GROUP BY 1, 2),
k AS (SELECT *, {want} AS want FROM a), f AS (SELECT *, CASE WHEN want IS NULL OR size = 0 THEN 0 ELSE least(size * want, eff) END AS fq FROM k)
SELECT order_id, fq > 0 AS filled, CASE WHEN fq > 0 THEN round(fq / size, 6) ELSE 0.0::DOUBLE END AS fill_fraction, CASE WHEN fq > 0 THEN {ts} END AS fill_ts_ms FROM f k"""


def _fill_query(profile):
    @query(f"E15_fill_labels_{profile.lower()}", using="resting", sql=_fill_sql(profile))
    def _(t):
        got = fills.fill_labels(t.resting, t.prints, profile, width=DAY_MS)
        return got.select("order_id", "filled", r("fill_fraction", "fill_fraction"), "fill_ts_ms")


for _profile in fills.QUEUE_AHEAD:
    _fill_query(_profile)


@query("D1_excursions", using="quotes resting", sql="""
WITH m AS (SELECT asset AS market, ts_ms, (bid_micros + ask_micros) / 2000000.0::DOUBLE AS mid FROM quotes),
x AS (SELECT o.order_id, min(m.mid) AS lo, max(m.mid) AS hi FROM resting o JOIN m ON m.market = o.market AND m.ts_ms BETWEEN o.arrival_ms AND o.end_ms GROUP BY 1)
SELECT o.order_id, round(least(coalesce((lo - price) * size, 0), 0), 6) + 0.0::DOUBLE AS max_adverse_excursion, round(greatest(coalesce((hi - price) * size, 0), 0), 6) + 0.0::DOUBLE AS max_favorable_excursion
FROM resting o LEFT JOIN x USING (order_id)""")
def _(t):
    mids = t.quotes.select(
        col("asset").alias("market"), "ts_ms", ((col("bid_micros") + col("ask_micros")) / 2000000.0).alias("mid")
    )
    got = intervals.excursions(
        t.resting, mids, ["order_id"], ["market"], "arrival_ms", "end_ms", "ts_ms", "mid", "price", "size"
    )
    return got.select("order_id", r("max_adverse_excursion", "max_adverse_excursion"), r("max_favorable_excursion", "max_favorable_excursion"))


@query("D5_triggers", using="ticks", sql="""
WITH k AS (SELECT *, CASE WHEN side = 'BUY' THEN qty WHEN side = 'SELL' THEN -qty ELSE 0 END AS ofi, user_id % 2 AS spread FROM ticks),
w AS (SELECT *, lag(price) OVER o AS pp, lag(spread) OVER o AS ps, avg(ofi) OVER n AS mo, stddev_pop(ofi) OVER n AS so, avg(qty) OVER n AS mq, stddev_pop(qty) OVER n AS sq FROM k
 WINDOW o AS (PARTITION BY asset ORDER BY ts_ms, seq), n AS (PARTITION BY asset ORDER BY ts_ms, seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT seq, CASE WHEN abs(price / pp - 1) * 10000 > 20000 THEN 'spot_move' WHEN so > 0 AND abs(ofi - mo) > 1.7 * so THEN 'ofi_spike'
 WHEN spread <> ps THEN 'spread_change' WHEN sq > 0 AND abs(qty - mq) > 1.7 * sq THEN 'abnormal_volume' END AS trigger FROM w""")
def _(t):
    df = t.ticks.withColumns(
        {
            "ofi": F.when(col("side") == "BUY", col("qty")).when(col("side") == "SELL", -col("qty")).otherwise(0.0),
            "spread": col("user_id") % 2,
        }
    )
    got = flow.triggers(
        df, ["asset"], "ts_ms", "price", "qty", "ofi", "spread", ("seq",), n=20, move_bps=20000.0, z=1.7, width=DAY_MS, block=500
    )
    return got.select("seq", "trigger")


@query("J12_assign_windows", using="spans", sql="""
WITH w AS (SELECT 'w' || lpad(k::VARCHAR, 2, '0') AS name, 788918400000 + k * 10368000000 AS a, 788918400000 + k * 10368000000 + 20736000000 AS b, 788918400000 + k * 10368000000 + 31104000000 AS c FROM range(0, 30) t(k) WHERE 788918400000 + k * 10368000000 + 31104000000 <= 1009843200000)
SELECT s.condition_id, w.name, CASE WHEN s.resolution_ms < w.b THEN 'IN_SAMPLE' ELSE 'OUT_OF_SAMPLE' END AS assignment
FROM spans s JOIN w ON s.resolution_ms >= w.a AND s.resolution_ms < w.c""")
def _(t):
    from tapelab.operators import walkforward

    win = walkforward.plan_windows(t.spark, 788918400000, 1009843200000, 20736000000, 10368000000, 10368000000)
    got = walkforward.assign_windows(t.spans, win, "resolution_ms", width=10368000000)
    return got.select("condition_id", "name", "assignment")
