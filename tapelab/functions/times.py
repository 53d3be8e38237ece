"""Timestamps, windows and freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Market horizons in seconds.
HORIZON_SECS = {"5m": 300, "15m": 900, "1h": 3600, "4h": 14400, "daily": 86400}


def epoch_ms(raw: Column) -> Column:
    """Epoch ms from seconds, ms, us or ns text/number by magnitude, or from RFC 3339."""
    text = F.trim(raw.cast("string"))
    n = text.try_cast("bigint")
    size = F.abs(n)
    number = (
        F.when(size >= 10**17, F.floor(n / 10**6))
        .when(size >= 10**14, F.floor(n / 10**3))
        .when(size >= 10**11, n)
        .otherwise(n * 1000)
    ).cast("long")
    dated = text.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$")
    stamp = F.unix_millis(F.when(dated, text).try_cast("timestamp"))
    missing = (text == "") | (F.lower(text) == "nat")
    return F.when(missing, F.lit(None).cast("long")).otherwise(F.coalesce(number, stamp))


def archive_ms(raw: Column) -> Column:
    """Archive rule: above 1e15 the number is microseconds; unreadable gives -1."""
    n = raw.cast("string").try_cast("bigint")
    big = n > 1_000_000_000_000_000
    return F.coalesce(F.when(big, F.floor(n / 1000)).otherwise(n), F.lit(-1)).cast("long")


def time_remaining(end_ms: Column, at_ms: Column) -> Column:
    return F.floor(F.greatest(F.lit(0), end_ms - at_ms) / 1000).cast("long")


def is_active(start_ms: Column, end_ms: Column, at_ms: Column) -> Column:
    return (at_ms >= start_ms) & (at_ms < end_ms)


def horizon_secs(horizon: Column) -> Column:
    out = F.lit(None).cast("long")
    for name, secs in HORIZON_SECS.items():
        out = F.when(horizon == name, F.lit(secs).cast("long")).otherwise(out)
    return out


def rollover(at_ms: Column, secs: Column) -> Column:
    """Start of the horizon-long epoch the time falls in, ms."""
    span = secs * 1000
    return (at_ms - F.pmod(at_ms, span)).cast("long")


def event_time(exchange_ms: Column, local_ms: Column) -> Column:
    """Exchange time when positive, else local time, never below zero."""
    return F.greatest(F.when(exchange_ms > 0, exchange_ms).otherwise(local_ms), F.lit(0))


def is_fresh(
    state_seq: Column, current_seq: Column, latency_ms: Column, max_lag=2, max_latency_ms=1500
) -> Column:
    return (state_seq + max_lag >= current_seq) & (latency_ms <= max_latency_ms)


def decision_time(df: DataFrame, scenarios: DataFrame, ts: str) -> DataFrame:
    """Rows of each latency scenario with ``ts + percentile + execution`` time.

    ``scenarios`` is a handful of rows (one per latency setting) and every row is
    wanted under each, so it is one array value exploded per row: no join.
    """
    packed = scenarios.agg(
        F.collect_list(F.struct("scenario", "latency_ms", "execution_latency_ms")).alias("_s")
    )
    long = df.withColumn("_s", packed.scalar()).withColumn("_x", F.explode("_s"))
    when = F.col(ts) + F.col("_x.latency_ms") + F.col("_x.execution_latency_ms")
    return long.select(
        *df.columns, F.col("_x.scenario").alias("scenario"), when.alias("decision_ms")
    )
