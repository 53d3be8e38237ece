"""Order flow, returns, volatility, candles and equity curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapelab.functions.prices import finite, pct_return, positive
from tapelab.operators import asof, scan
from tapelab.operators.scan import DAY_MS, HOUR_MS


def order_flow(
    df: DataFrame,
    by: Sequence[str],
    ts: str,
    side: str = "side",
    qty: str = "qty",
    short_ms: int = 1_000,
    long_ms: int = 5_000,
    basis: str = "short",
    empty_ratio: float = 0.0,
    width: int = HOUR_MS,
) -> DataFrame:
    """Trailing buy/sell volume, imbalance and buy ratio, closed at both ends.

    The live form takes its totals from the short span and reports 0.0 when empty; the
    replay form takes the long span and reports 0.5. Both are settings here.
    """
    size = F.when(positive(F.col(qty)), F.col(qty))
    buy = F.sum(F.when(F.col(side) == "BUY", size))
    sell = F.sum(F.when(F.col(side) == "SELL", size))
    work = scan.range_window(
        df, by, ts,
        {"_b1": (short_ms, buy), "_s1": (short_ms, sell), "_b5": (long_ms, buy), "_s5": (long_ms, sell)},
        width,
    ).fillna(0.0, subset=["_b1", "_s1", "_b5", "_s5"])
    b, s = ("_b1", "_s1") if basis == "short" else ("_b5", "_s5")
    total = F.col(b) + F.col(s)
    return work.withColumns(
        {
            "buy_vol": F.col("_b1"),
            "sell_vol": F.col("_s1"),
            "ofi_short": F.col("_b1") - F.col("_s1"),
            "ofi_long": F.col("_b5") - F.col("_s5"),
            "imbalance": F.when(total > 0, F.try_divide(F.col(b) - F.col(s), total)).otherwise(0.0),
            "buy_ratio": F.when(total > 0, F.try_divide(F.col(b), total)).otherwise(F.lit(empty_ratio)),
        }
    ).drop("_b1", "_s1", "_b5", "_s5")


def rolling_stats(
    df: DataFrame, by: Sequence[str], ts: str, value: str, n: int, tie: Sequence[str] = (),
    width: int = HOUR_MS, block: int = 100_000,
) -> DataFrame:
    """Mean, population variance and the last ``n`` values over the last ``n`` rows."""
    v = F.col(value)
    return scan.rows_window(
        df, by, ts, n,
        {"roll_mean": F.avg(v), "roll_var": F.var_pop(v), "last_n": F.collect_list(v)},
        tie, width, block,
    )


def horizon_returns(
    ends: DataFrame, ticks: DataFrame, on: str, by: Sequence[str], ids: Sequence[str], price: str,
    horizons: dict[str, int], tick_on: str | None = None, tie: str | None = None, width: int = HOUR_MS,
) -> DataFrame:
    """Percent return from ``t - h`` to ``t`` on the interpolated series; 0.0 if short."""
    offsets = {"_end": 0, **{f"_p_{n}": -ms for n, ms in horizons.items()}}
    got = asof.interpolated_offsets(ends, ticks, on, by, ids, price, offsets, tick_on, tie, width)
    rets = {
        n: F.coalesce(pct_return(F.col(f"_p_{n}"), F.col("_end")), F.lit(0.0)) for n in horizons
    }
    return got.withColumns(rets).drop(*offsets)


#: Returns are summed as whole numbers of 1e-11 percent, so sums over a span are exact differences of running sums.
_UNIT = 1e11


def realized_vol(
    ends: DataFrame, ticks: DataFrame, on: str, by: Sequence[str], price: str,
    steps: dict[str, int], step_ms: int = 1_000, tie: str | None = None, width: int = HOUR_MS,
) -> DataFrame:
    """Population std of step returns over the last ``n`` steps; any gap gives 0.0.

    Ends that share a phase (time modulo step) share one grid per key. An end adds only the points that the end before it does
    not have, so overlapping spans are expanded once and no point is made twice. Each point is interpolated once; a spread is a
    difference of running sums ``n`` rows apart, whatever ``n``. A step of more than a million percent counts as a gap.
    """
    longest = max(steps.values())
    keys = [*by, "_phase"]
    marks = ends.select(*by, on, F.pmod(F.col(on), F.lit(step_ms)).alias("_phase")).distinct()
    marks = scan.ordered(marks, keys, on, {"_before": scan.previous(on)}, width=max(width, step_ms))
    first = F.greatest(F.col(f"_before.`{on}`") + step_ms, F.col(on) - longest * step_ms)
    grid = marks.select(*keys, F.explode(F.sequence(first, F.col(on), F.lit(step_ms).cast("long"))).alias("_g"))
    work = asof.interpolate(grid, ticks, "_g", by, price, tick_on=on, tie=tie, out="_p", width=width)
    # A point is copied into the next bucket if a span that ends there may reach back to it.
    reach = longest * step_ms
    wide = max(width, reach)
    home = scan.bucket_of(F.col("_g"), wide)
    copies = F.when(F.col("_g") + reach >= (home + 1) * wide, F.array(home, home + 1)).otherwise(F.array(home))
    work = work.withColumn("_home", home).withColumn(scan.BUCKET, F.explode(copies))
    rows = scan.bucket_window(keys).orderBy("_g")
    work = work.withColumn("_o", F.lag(F.struct("_g", "_p")).over(rows))
    ret = F.when(F.col("_g") - F.col("_o._g") == step_ms, pct_return(F.col("_o._p"), F.col("_p")))
    work = work.withColumn("_r", F.when(F.abs(ret) <= 1e6, F.round(ret * _UNIT).cast("decimal(18,0)")))
    so_far = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = {"_n": F.count("_r"), "_s": F.sum("_r"), "_q": F.sum(F.col("_r") * F.col("_r"))}
    work = work.withColumns({k: v.over(so_far) for k, v in sums.items()})
    state = F.struct("_g", *sums)
    work = work.withColumns({f"_b_{name}": F.lag(state, n).over(rows) for name, n in steps.items()})

    def spread(name: str, n: int) -> Column:
        was = lambda c: F.col(f"_b_{name}").getField(c)
        since = lambda c: (F.col(c) - F.coalesce(was(c), F.lit(0))).cast("double")
        whole = (was("_g") == F.col("_g") - n * step_ms) & (F.col("_n") - was("_n") == n)
        var = since("_q") / n - F.pow(since("_s") / n, F.lit(2))
        return F.when(whole, F.sqrt(F.greatest(var, F.lit(0.0))) / _UNIT).otherwise(0.0)

    vols = work.where(F.col(scan.BUCKET) == F.col("_home")).select(
        *by, F.col("_g").alias(on), *[spread(name, n).alias(name) for name, n in steps.items()]
    )
    return ends.join(vols, [*by, on], "left")


def ret_prev(
    df: DataFrame, by: Sequence[str], ts: str, price: str, tie: Sequence[str] = (), width: int = DAY_MS
) -> DataFrame:
    """Simple return on the previous row of the key."""
    got = scan.previous_row(df, by, ts, [price], tie, width)
    return got.withColumn("ret", F.try_divide(F.col(price), F.col(f"prev_{price}")) - 1.0)


def equity_curve(
    df: DataFrame, by: Sequence[str], ts: str, total: str, tie: Sequence[str] = (), width: int = DAY_MS
) -> DataFrame:
    """High-water mark and drawdown; the first sample is the first peak."""
    got = scan.running_max(df, by, ts, F.col(total), "high_watermark", tie, width)
    return got.withColumn("drawdown", F.col("high_watermark") - F.col(total))


def sample_by_day(df: DataFrame, by: Sequence[str], ts: str, value: str, tie: Sequence[str] = ()) -> DataFrame:
    """First, last, change, peak and trough per UTC day; absent days stay absent."""
    day = (F.col(ts) - F.pmod(F.col(ts), F.lit(DAY_MS))).alias("day_ms")
    order = F.struct(ts, *tie)
    return df.groupBy(*by, day).agg(
        F.min_by(value, order).alias("first_value"),
        F.max_by(value, order).alias("last_value"),
        (F.max_by(value, order) - F.min_by(value, order)).alias("day_change"),
        F.max(value).alias("peak"),
        F.min(value).alias("trough"),
    )


def candles(ticks: DataFrame, by: Sequence[str], ts: str, price: str, tie: Sequence[str] = (),
            span_ms: int = DAY_MS) -> DataFrame:
    """OHLC per key and UTC span of valid ticks; the last span of a key is forming."""
    good = ticks.where(positive(F.col(price)))
    order = F.struct(ts, *tie)
    out = good.groupBy(*by, (F.col(ts) - F.pmod(F.col(ts), F.lit(span_ms))).alias("start_ms")).agg(
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        F.count(F.lit(1)).alias("n_ticks"),
    )
    # One row per key and span is left, so this window is bounded by the time range.
    newest = F.max("start_ms").over(Window.partitionBy(*by))
    return out.withColumn("forming", F.col("start_ms") == newest)


def daily_vol_drift(closes: DataFrame, symbol: str, ts: str, close: str, tie: Sequence[str] = ()) -> DataFrame:
    """Daily close, sample std of row returns and first-to-last drift in percent."""
    rets = ret_prev(closes, [symbol], ts, close, tie)
    order = F.struct(ts, *tie)
    day = (F.col(ts) - F.pmod(F.col(ts), F.lit(DAY_MS))).alias("day_ms")
    drift = F.try_divide(F.max_by(close, order), F.min_by(close, order)) - 1.0
    return rets.groupBy(symbol, day).agg(
        F.max_by(close, order).alias("close"),
        F.stddev_samp("ret").alias("vol_1m"),
        (F.coalesce(drift, F.lit(0.0)) * 100.0).alias("drift_pp"),
    )


def print_touch(
    prints: DataFrame, by: Sequence[str], ts: str, price: str = "price", side: str = "aggressor",
    tie: Sequence[str] = (), tick: float = 0.01, width: int = HOUR_MS,
) -> DataFrame:
    """Touch from prints alone: last seller-hit price as bid, last buyer-lifted as ask.

    Where a side was never hit the last print stands one tick away, inside [0, 1].
    """
    p = F.col(price)
    ok = finite(p) & (p > 0) & (p < 1)
    got = scan.running_last(
        prints, by, ts,
        {
            "_last": F.when(ok, p),
            "_bid": F.when(ok & (F.col(side) == "SELL"), p),
            "_ask": F.when(ok & (F.col(side) == "BUY"), p),
        },
        tie, width,
    )
    return got.withColumns(
        {
            "touch_bid": F.coalesce("_bid", F.greatest(F.col("_last") - tick, F.lit(0.0))),
            "touch_ask": F.coalesce("_ask", F.least(F.col("_last") + tick, F.lit(1.0))),
        }
    ).drop("_last", "_bid", "_ask")


def triggers(
    ticks: DataFrame, by: Sequence[str], ts: str, price: str, qty: str, ofi: str, spread: str,
    tie: Sequence[str] = (), n: int = 20, move_bps: float = 2.0, z: float = 3.0,
    width: int = HOUR_MS, block: int = 100_000,
) -> DataFrame:
    """Names the first trigger of each row: spot move, flow spike, spread change, volume.

    Spikes compare the row with the mean and standard deviation of the ``n`` rows up to
    and including it.
    """
    marked = scan.ordered(ticks, by, ts, {"_prev": scan.previous(price, spread), "_rn": scan.number()}, tie, width)
    before = lambda c: F.col(f"_prev.`{c}`")
    stats = {}
    for name, c in (("ofi", ofi), ("qty", qty)):
        stats[f"_m_{name}"] = F.avg(F.col(c))
        stats[f"_d_{name}"] = F.stddev_pop(F.col(c))
    rolled = scan.rows_window(marked, by, ts, n, stats, tie, width, block, rn="_rn")
    move = F.try_divide(F.col(price), before(price)) - 1.0
    high = lambda c, k: (F.col(f"_d_{k}") > 0) & (F.abs(F.col(c) - F.col(f"_m_{k}")) > z * F.col(f"_d_{k}"))
    trigger = (
        F.when(F.abs(move) * 10_000 > move_bps, "spot_move")
        .when(high(ofi, "ofi"), "ofi_spike")
        .when(F.col(spread) != before(spread), "spread_change")
        .when(high(qty, "qty"), "abnormal_volume")
    )
    return rolled.withColumn("trigger", trigger).select(*ticks.columns, "trigger")
