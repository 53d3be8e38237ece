"""Walk-forward planning, assignment, purge, embargo and fit/apply."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapelab.operators.intervals import interval_join


def plan_windows(
    spark: SparkSession, first_ms: int, last_ms: int, train_ms: int, test_ms: int, step_ms: int, embargo_ms: int = 0
) -> DataFrame:
    """Rolling windows whose test ends at or before ``last_ms``; bad arguments give none."""
    ok = first_ms > 0 and last_ms >= first_ms and min(train_ms, test_ms, step_ms) > 0 and embargo_ms >= 0
    room = last_ms - first_ms - train_ms - embargo_ms - test_ms
    n = room // step_ms + 1 if ok and room >= 0 else 0
    start = F.lit(first_ms) + F.col("id") * F.lit(step_ms)
    number = F.col("id").cast("string")
    name = F.concat(F.lit("w"), F.when(F.col("id") < 10, F.concat(F.lit("0"), number)).otherwise(number))
    return spark.range(n).select(
        name.alias("name"),
        start.alias("train_start_ms"),
        (start + train_ms).alias("train_end_ms"),
        (start + train_ms + embargo_ms).alias("test_start_ms"),
        (start + train_ms + embargo_ms + test_ms).alias("test_end_ms"),
    )


def assign_windows(df: DataFrame, windows: DataFrame, ts: str, width: int) -> DataFrame:
    """Rows per window they fall in: IN_SAMPLE or OUT_OF_SAMPLE; gaps stay unassigned."""
    got = interval_join(df, windows, ts, "train_start_ms", "test_end_ms", width)
    t = F.col(ts)
    side = F.when(t < F.col("train_end_ms"), "IN_SAMPLE").when(t >= F.col("test_start_ms"), "OUT_OF_SAMPLE")
    return got.withColumn("assignment", side).where(F.col("assignment").isNotNull())


def valid_span(start: str, end: str):
    return (F.col(start) > 0) & (F.col(end) > 0) & (F.col(start) <= F.col(end))


def purge_train(df: DataFrame, train_end: str | int, purge_ms: int, start="info_start_ms", end="resolution_ms") -> DataFrame:
    """Adds ``purged``: a label later than ``train_end - purge`` may not train."""
    cut = (F.col(train_end) if isinstance(train_end, str) else F.lit(train_end)) - purge_ms
    keep = valid_span(start, end) & (F.col(end) <= cut)
    return df.withColumn("purged", ~F.coalesce(keep, F.lit(False)))


def purge_embargo(
    df: DataFrame, test_start: int, test_end: int, purge_ms: int, embargo_ms: int,
    start="info_start_ms", end="resolution_ms",
) -> DataFrame:
    """Adds ``drop_reason``: purge first, then contact with the embargo zone."""
    s, e = F.col(start), F.col(end)
    bad = test_start <= 0 or test_end <= 0 or test_end < test_start or purge_ms < 0 or embargo_ms < 0
    zone_end = test_end + embargo_ms
    inside = (s >= test_end) & (s < zone_end)
    crosses = (s < test_end) & (e >= test_end)
    zone = F.lit(embargo_ms > 0) & (inside | crosses)
    purge = ~F.coalesce(valid_span(start, end) & (e <= test_start - purge_ms), F.lit(False))
    reason = F.when(F.lit(bad), "bad_bounds").when(purge, "purge").when(zone, "embargo")
    return df.withColumn("drop_reason", reason)


def embargo_flags(windows: DataFrame, embargo_ms: int) -> DataFrame:
    """True where the next window trains too soon after this window's test.

    Windows are a planner's output (hundreds at most), so one ordered window is fine.
    """
    nxt = F.lead("train_start_ms").over(Window.partitionBy(F.lit(0)).orderBy("train_start_ms"))
    gap = F.col("next_train_start_ms") - F.col("test_end_ms")
    return windows.withColumn("next_train_start_ms", nxt).withColumns(
        {"gap_ms": gap, "requires_gap": F.when(gap.isNotNull(), gap < embargo_ms)}
    )


def slice_windows(tape: DataFrame, windows: DataFrame, ts: str, width: int) -> DataFrame:
    """Lossless slices: every tape row once per window holding it, with its part."""
    got = interval_join(tape, windows, ts, "train_start_ms", "test_end_ms", width)
    t = F.col(ts)
    part = (
        F.when(t < F.col("train_end_ms"), "train")
        .when(t < F.col("test_start_ms"), "embargo")
        .otherwise("test")
    )
    return got.withColumn("part", part)


def slice_counts(slices: DataFrame, market: str) -> DataFrame:
    return slices.groupBy("name", "part").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(market).alias("markets")
    )


def walkforward(
    assigned: DataFrame, fit: Callable[[DataFrame], DataFrame], apply: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Fits on IN_SAMPLE rows of each window, applies the result to its OUT_OF_SAMPLE rows.

    ``fit`` gets only in-sample rows and returns one row per window ``name``; ``apply``
    gets out-of-sample rows with the fitted columns joined on.
    """
    fitted = fit(assigned.where(F.col("assignment") == "IN_SAMPLE"))
    oos = assigned.where(F.col("assignment") == "OUT_OF_SAMPLE")
    return apply(oos.join(fitted, "name", "left"))
