"""Volatility regimes without look-ahead, and whole-history daily regimes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapelab.functions.prices import finite
from tapelab.operators import scan
from tapelab.operators.scan import DAY_MS
from tapelab.session import settle


def earlier_smaller(values: np.ndarray) -> np.ndarray:
    """For each position, how many earlier positions hold a smaller value.

    Merges sorted halves bottom-up: at each level the left halves are counted against
    the right halves with one sort, so the cost is n log^2 n in whole-array steps.
    """
    n = len(values)
    out = np.zeros(n, dtype=np.int64)
    pos = np.arange(n)
    size = 1
    while size < n:
        pair = pos // (2 * size)
        right = (pos // size) % 2
        # Equal values: rights come first, so a left neighbour of equal value is not counted.
        order = np.lexsort((1 - right, values, pair))
        left_seen = np.cumsum(1 - right[order])
        pair_sorted = pair[order]
        starts = np.r_[True, pair_sorted[1:] != pair_sorted[:-1]]
        base = np.where(starts, left_seen - (1 - right[order]), 0)
        base = np.maximum.accumulate(base)
        counts = left_seen - base
        is_right = right[order] == 1
        out[order[is_right]] += counts[is_right]
        size *= 2
    return out


#: Rows of a block in time and, up to the error of a sketch, of a block of values.
BLOCK_ROWS = 200_000
#: Value borders that a row is compared with in each of two steps.
STEP = 64


def _value_block(value: str, edges: str) -> Column:
    """Twice the number of borders below the value, plus one if it is a border itself; borders are searched in two steps."""
    v = F.col(value)
    coarse = F.filter(edges, lambda e, i: (i % STEP == STEP - 1) & (e < v))
    rest = F.slice(edges, F.size(coarse) * STEP + 1, STEP)
    below = F.size(coarse) * STEP + F.size(F.filter(rest, lambda e: e < v))
    return 2 * below + F.exists(rest, lambda e: e == v).cast("int")


def expanding_rank(
    df: DataFrame, by: Sequence[str], ts: str, value: str, tie: Sequence[str] = (), width: int = DAY_MS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Adds ``_rn`` (rows so far) and ``_less`` (earlier rows with a smaller value), exact.

    A pair (earlier, smaller) falls into one of three cases, each counted apart: both its time block and its value block are
    lower (a table of block counts), the time block is the same and the value block lower (inside a time block), or the value block is the
    same (inside a value block). Time blocks have ``block_rows`` rows. Value blocks lie between borders that a sketch sets for as many
    rows each; the rows on a border are a block of equal values, of which none is smaller than another, so a value that
    most rows share costs nothing. The two inner counts see numbers of rows and values alone.
    """
    keys = list(by)
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("")
    rows = scan.numbered(df.where(finite(F.col(value))), by, ts, tie, width, rn="_rn").withColumn("_key", key)
    most = rows.groupBy("_key").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    blocks = min(STEP * STEP, max(2, -(-most // block_rows)))
    probs = [i / blocks for i in range(1, blocks)]
    edges = rows.groupBy("_key").agg(F.array_distinct(F.percentile_approx(value, probs, max(10_000, 20 * blocks))).alias("_edges"))
    tb = F.expr(f"cast((_rn - 1) div {block_rows} as int)")
    narrow = rows.select("_key", "_rn", value, tb.alias("_tb")).join(edges, "_key")
    narrow = settle(narrow.select("_key", "_rn", value, "_tb", _value_block(value, "_edges").alias("_vb")), "ranks")

    grid = narrow.groupBy("_key", "_tb", "_vb").agg(F.count(F.lit(1)).alias("_c"))
    # Blocks of a key are few (rows / block_rows), and each row is one small array.
    counts = grid.groupBy("_key", "_tb").agg(F.sort_array(F.collect_list(F.struct("_vb", "_c"))).alias("_m"))
    below = F.transform(
        F.sequence(F.lit(0), F.lit(2 * blocks)),
        lambda v: F.aggregate(F.filter("_m", lambda x: x["_vb"] < v), F.lit(0).cast("long"), lambda acc, x: acc + x["_c"]),
    )
    counts = counts.select("_key", "_tb", F.posexplode(below).alias("_vb", "_below"))
    earlier = F.sum("_below").over(Window.partitionBy("_key", "_vb").orderBy("_tb").rowsBetween(Window.unboundedPreceding, -1))
    table = counts.select("_key", "_tb", "_vb", F.coalesce(earlier, F.lit(0)).cast("long").alias("_a"))

    def inside(column: str, out: str):
        def count(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_rn")
            return pdf.assign(**{out: earlier_smaller(pdf[column].to_numpy())})[["_key", "_rn", out]]

        return count

    times = narrow.select("_key", "_tb", "_rn", "_vb").groupBy("_key", "_tb").applyInPandas(inside("_vb", "_b"), "_key string, _rn long, _b long")
    between = narrow.where(F.col("_vb") % 2 == 0).select("_key", "_vb", "_rn", F.col(value).cast("double").alias("_v"))
    values = between.groupBy("_key", "_vb").applyInPandas(inside("_v", "_d"), "_key string, _rn long, _d long")
    less = (
        narrow.join(table, ["_key", "_tb", "_vb"], "left").join(times, ["_key", "_rn"], "left").join(values, ["_key", "_rn"], "left")
        .select("_key", "_rn", (F.col("_a") + F.col("_b") + F.coalesce("_d", F.lit(0))).alias("_less"))
    )
    return rows.join(less, ["_key", "_rn"]).select(*df.columns, "_rn", "_less")


def pit_vol_regime(
    df: DataFrame, by: Sequence[str], ts: str, vol: str, warmup: int, tie: Sequence[str] = (),
    width: int = DAY_MS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """low/normal/high/extreme against the quartiles of the history up to the row.

    The row's own value is in that history, so ``v <= linear quantile q`` holds exactly
    when the number of smaller earlier values is at most ``floor(q * (n - 1))``: the
    labels follow from ranks and no quantile is ever computed. Rows before ``warmup`` finite
    values, and rows without a finite value, are normal.
    """
    ranked = expanding_rank(df, by, ts, vol, tie, width, block_rows)
    n, less = F.col("_rn"), F.col("_less")
    at_most = lambda q: less <= F.floor(F.lit(q) * (n - 1))
    label = (
        F.when(n < warmup, "normal").when(at_most(0.25), "low").when(at_most(0.5), "normal")
        .when(at_most(0.75), "high").otherwise("extreme")
    )
    known = ranked.withColumn("vol_regime", label).drop("_rn", "_less")
    rest = df.where(~F.coalesce(finite(F.col(vol)), F.lit(False))).withColumn("vol_regime", F.lit("normal"))
    return known.unionByName(rest)


def daily_regime(days: DataFrame, symbol: str, vol: str = "vol_1m", drift: str = "drift_pp") -> DataFrame:
    """Tertile vol regime over the symbol's whole history, trend from the day's drift.

    The cut is the value at rank ``round(q * (n - 1))``. A symbol has one row per day.
    """
    ordered = days.groupBy(symbol).agg(F.array_sort(F.collect_list(vol)).alias("_v"))
    n = F.size("_v")
    at = lambda q: F.get("_v", F.round(F.lit(q) * (n - 1)).cast("int"))
    cuts = ordered.select(symbol, at(0.33).alias("_q33"), at(0.66).alias("_q66"))
    v, d = F.col(vol), F.coalesce(F.col(drift), F.lit(0.0))
    return days.join(cuts, symbol, "left").withColumns(
        {
            "vol_regime": F.when(v.isNull(), "UNKNOWN").when(v <= F.col("_q33"), "LOW_VOL")
            .when(v <= F.col("_q66"), "NORMAL_VOL").otherwise("HIGH_VOL"),
            "trend_regime": F.when(d >= 3.0, "STRONG_UP").when(d <= -3.0, "STRONG_DOWN").otherwise("SIDEWAYS"),
        }
    ).drop("_q33", "_q66")
