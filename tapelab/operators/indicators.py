"""Daily indicators and the position walk.

A key has one candle per day, so a key's history is bounded by its calendar span and
is the natural unit of work for the recursive averages.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_CLOSED = 60


def ema(x: np.ndarray, period: int) -> np.ndarray:
    """EMA seeded with the mean of the first ``period`` values; null before that."""
    out = np.full(len(x), np.nan)
    if period <= 0 or len(x) < period:
        return out
    bad = np.flatnonzero(~np.isfinite(x))
    end = bad[0] if len(bad) else len(x)
    if end < period:
        return out
    k = 2.0 / (period + 1.0)
    value = float(np.mean(x[:period]))
    out[period - 1] = value
    for i in range(period, end):
        value = value * (1.0 - k) + x[i] * k
        out[i] = value
    return out


def _wilder(x: np.ndarray, period: int) -> np.ndarray:
    """Running mean of the first ``period`` values, then Wilder smoothing."""
    out = np.full(len(x), np.nan)
    if len(x) < period:
        return out
    value = float(np.mean(x[:period]))
    out[period - 1] = value
    w = 1.0 / period
    for i in range(period, len(x)):
        value = value * (1.0 - w) + x[i] * w
        out[i] = value
    return out


def rsi(x: np.ndarray, period: int) -> np.ndarray:
    """Wilder RSI; no losses (a flat series too) reads 100."""
    out = np.full(len(x), np.nan)
    bad = np.flatnonzero(~np.isfinite(x))
    end = bad[0] if len(bad) else len(x)
    if period <= 0 or end <= period:
        return out
    change = np.diff(x[:end])
    gain, loss = _wilder(np.maximum(change, 0.0), period), _wilder(np.maximum(-change, 0.0), period)
    with np.errstate(invalid="ignore", divide="ignore"):
        value = np.where(loss == 0.0, 100.0, 100.0 * gain / (gain + loss))
    out[1:end] = np.where(np.isnan(gain), np.nan, np.clip(value, 0.0, 100.0))
    return out


def adx(high: np.ndarray, low: np.ndarray, close: np.ndarray, period: int) -> np.ndarray:
    """Wilder ADX seeded by the first DX; a zero range or no direction ends the series."""
    n = len(close)
    out = np.full(n, np.nan)
    if period <= 0 or n <= period:
        return out
    finite = np.isfinite(high) & np.isfinite(low) & np.isfinite(close)
    end = n if finite.all() else int(np.flatnonzero(~finite)[0])
    if end <= period:
        return out
    h, lo, c = high[:end], low[:end], close[:end]
    up, down = h[1:] - h[:-1], lo[:-1] - lo[1:]
    tr = np.maximum.reduce([h[1:] - lo[1:], np.abs(h[1:] - c[:-1]), np.abs(lo[1:] - c[:-1])])
    plus = np.where((up > down) & (up > 0), up, 0.0)
    minus = np.where((down > up) & (down > 0), down, 0.0)
    str_, sp, sm = _wilder(tr, period), _wilder(plus, period), _wilder(minus, period)
    with np.errstate(invalid="ignore", divide="ignore"):
        pdi, mdi = 100.0 * sp / str_, 100.0 * sm / str_
        dx = np.where((str_ == 0) | (pdi + mdi == 0), np.nan, 100.0 * np.abs(pdi - mdi) / (pdi + mdi))
    w = 1.0 / period
    value = np.nan
    for i in range(period - 1, len(dx)):
        if np.isnan(dx[i]):
            break
        value = dx[i] if i == period - 1 else value * (1.0 - w) + dx[i] * w
        out[i + 1] = min(max(value, 0.0), 100.0)
    return out


def sma(candles: DataFrame, key: str, day: str, n: int, close: str = "close") -> DataFrame:
    w = Window.partitionBy(key).orderBy(day).rowsBetween(-(n - 1), 0)
    full = F.count(close).over(w) == n
    return candles.withColumn(f"sma{n}", F.when(full, F.avg(close).over(w)))


def indicators(candles: DataFrame, key: str, day: str, sma_n=50, ema_n=7, rsi_n=2, adx_n=2) -> DataFrame:
    """SMA, EMA, RSI and ADX as of each closed candle; null where undefined."""
    base = sma(candles.select(key, day, "open", "high", "low", "close"), key, day, sma_n)
    names = [f"ema{ema_n}", f"rsi{rsi_n}", f"adx{adx_n}"]
    schema = T.StructType([*base.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(day)
        h, lo, c = (pdf[x].to_numpy(dtype=float) for x in ("high", "low", "close"))
        got = {names[0]: ema(c, ema_n), names[1]: rsi(c, rsi_n), names[2]: adx(h, lo, c, adx_n)}
        return pdf.assign(**got).replace({np.nan: None})

    return base.groupBy(key).applyInPandas(walk, schema)


def daily_positions(ind: DataFrame, key: str, day: str, min_closed: int = MIN_CLOSED) -> DataFrame:
    """Decision and position per day from the indicator columns.

    An entry needs a close above SMA and EMA with RSI above ADX, an exit RSI below ADX; the two
    exclude each other, so the position after a day is the last of the two seen so far.
    """
    w = Window.partitionBy(key).orderBy(day)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rsi_c, adx_c = F.col("rsi2"), F.col("adx2")
    ready = (F.row_number().over(w) >= min_closed) & F.col("sma50").isNotNull() & F.col("ema7").isNotNull()
    ready = ready & rsi_c.isNotNull() & adx_c.isNotNull()
    entry = ready & (F.col("close") > F.col("sma50")) & (F.col("close") > F.col("ema7")) & (rsi_c > adx_c)
    leave = ready & (rsi_c < adx_c)
    work = ind.withColumns({"_ready": ready, "_flip": F.when(entry, 1).when(leave, 0)})
    after = F.coalesce(F.last("_flip", ignorenulls=True).over(so_far), F.lit(0))
    work = work.withColumn("_after", after)
    work = work.withColumn("_before", F.coalesce(F.lag("_after").over(w), F.lit(0)))
    b, a = F.col("_before"), F.col("_after")
    decision = (
        F.when(~F.col("_ready"), "hold_insufficient_history").when((b == 0) & (a == 1), "enter_long_up")
        .when((b == 1) & (a == 0), "exit_flat").when(b == 0, "hold_no_signal").otherwise("hold_still_long")
    )
    since = F.last(F.when((b == 0) & (a == 1), F.col(day)), ignorenulls=True).over(so_far)
    work = work.withColumns({"decision": decision, "position": F.when(a == 1, "long_up").otherwise("flat")})
    work = work.withColumn("since_day", F.when(a == 1, since))
    entry_ref = F.last(F.when(F.col("decision") == "enter_long_up", F.col("close")), ignorenulls=True).over(so_far)
    work = work.withColumn("_ref", entry_ref)
    pnl = F.when(F.col("decision") == "exit_flat", F.col("close") - F.col("_ref"))
    return work.withColumn("realized_pnl", pnl).drop("_ready", "_flip", "_after", "_before", "_ref")
