"""Completeness, coverage, admission and lineage checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapelab.functions import signals
from tapelab.functions.prices import finite, unit
from tapelab.operators import scan
from tapelab.operators.scan import DAY_MS
from tapelab.session import tasks_for


def reason_counts(df: DataFrame, reason: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per reason; a null reason counts as ok."""
    return df.groupBy(*by, F.coalesce(reason, F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def complete_windows(ticks: DataFrame, markets: DataFrame, n: int, key: str = "condition_id") -> DataFrame:
    """Per market: in-window rows, distinct seconds, null quotes and the drop reason.

    A market is kept when every one of its ``n`` seconds is present once. ``t`` and
    ``start_s`` are seconds; rows outside ``[start, start + n)`` are only counted. Both tables are dealt by market once, to as
    many tasks as the ticks need, so that the memory of a task does not grow with the tables.
    """
    tasks = tasks_for(ticks)
    ticks, markets = ticks.repartition(tasks, key), markets.repartition(tasks, key)
    off = F.col("t") - F.col("start_s")
    inside = off.between(0, n - 1)
    null_quote = F.col("bid").isNull() | F.isnan("bid") | F.col("ask").isNull() | F.isnan("ask")
    rows = ticks.join(markets.select(key, "start_s"), key)
    # One row per (market, second) first.
    per_second = rows.groupBy(key, F.when(inside, off).alias("_off")).agg(
        F.count(F.lit(1)).alias("_c"), F.count_if(null_quote).alias("_null")
    )
    in_ = F.col("_off").isNotNull()
    stats = per_second.groupBy(key).agg(
        F.coalesce(F.sum(F.when(in_, F.col("_c"))), F.lit(0)).alias("in_window_rows"),
        F.count("_off").alias("distinct_seconds"),
        F.coalesce(F.sum(F.when(in_, F.col("_null"))), F.lit(0)).alias("null_quote_rows"),
        F.coalesce(F.sum(F.when(~in_, F.col("_c"))), F.lit(0)).alias("out_of_window_rows"),
    )
    names = ("in_window_rows", "distinct_seconds", "null_quote_rows", "out_of_window_rows")
    df = markets.join(stats, key, "left").fillna(0, subset=list(names))
    reason = (
        F.when(F.col("in_window_rows") == 0, "no_in_window_ticks")
        .when(F.col("in_window_rows") > F.col("distinct_seconds"), "duplicate_second")
        .when(F.col("distinct_seconds") != n, "incomplete_1s_tick_window")
    )
    return df.withColumn("drop_reason", reason)


def drop_accounting(markets: DataFrame, by: Sequence[str]) -> DataFrame:
    """Candidate, kept and dropped markets and rows per group, from ``complete_windows``."""
    reason = F.col("drop_reason")
    n = lambda r: F.count_if(reason == r)
    kept = F.when(reason.isNull(), F.col("in_window_rows") - F.col("null_quote_rows"))
    return markets.groupBy(*by).agg(
        F.count(F.lit(1)).alias("candidate"),
        F.count_if(reason.isNull()).alias("kept"),
        F.count_if(reason.isNotNull()).alias("dropped"),
        n("no_in_window_ticks").alias("no_in_window_ticks"),
        n("incomplete_1s_tick_window").alias("incomplete_1s_tick_window"),
        n("duplicate_second").alias("duplicate_second"),
        F.coalesce(F.sum(kept), F.lit(0)).alias("kept_rows"),
        F.coalesce(F.sum(F.when(reason.isNull(), F.col("null_quote_rows"))), F.lit(0)).alias("dropped_null_quotes"),
        F.coalesce(F.sum(F.when(reason.isNotNull(), F.col("in_window_rows"))), F.lit(0)).alias("dropped_incomplete_rows"),
        F.sum("out_of_window_rows").alias("dropped_out_of_window"),
    )


def coverage_gaps(df: DataFrame, key: str, day: str, requested: DataFrame | None = None) -> DataFrame:
    """Requested days without data per key; by default every day between first and last.

    ``day`` and the output ``day`` are epoch ms at UTC midnight.
    """
    seen = df.select(key, F.col(day).alias("day")).distinct()
    if requested is None:
        # Days between neighbouring observed days: nothing that is listed here is shuffled or joined. A key has one row per day.
        before = F.lag("day").over(Window.partitionBy(key).orderBy("day"))
        gaps = seen.where(F.col("day").isNotNull()).withColumn("_p", before).where(F.col("day") - F.col("_p") > DAY_MS)
        step = F.lit(DAY_MS).cast("long")
        return gaps.select(key, F.explode(F.sequence(F.col("_p") + step, F.col("day") - step, step)).alias("day"))
    return requested.join(seen, [key, "day"], "left_anti")


def gap_spans(days: DataFrame, key: str, day: str, longer_than: int = DAY_MS) -> DataFrame:
    """Neighbouring observed days of a key that lie further apart than allowed."""
    prev = scan.previous_row(days, [key], day, [day], width=400 * DAY_MS)
    return prev.where(F.col(day) - F.col(f"prev_{day}") > longer_than).select(
        key, F.col(f"prev_{day}").alias("gap_from"), F.col(day).alias("gap_to")
    )


def tape_bounds(df: DataFrame, ts: str) -> DataFrame:
    """Tape range in ms with an exclusive upper bound; the tape may be in s or ms."""
    lo, hi = F.min(ts), F.max(ts)
    both = df.agg(lo.alias("lo"), hi.alias("hi"))
    div = F.when(F.col("lo") > 10**12, 1000).otherwise(1)
    return both.select(
        (F.floor(F.col("lo") / div) * 1000).cast("long").alias("lo_ms"),
        ((F.floor(F.col("hi") / div) + 1) * 1000).cast("long").alias("hi_ms"),
    )


def validate_corpus(df: DataFrame, column: str) -> DataFrame:
    """Count and percentage of every value, nulls included."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))
    return counts.select(column, "n", (F.col("n") * 100.0 / total.scalar()).alias("percent"))


def strata_counts(df: DataFrame, expected: Sequence[Sequence[str]], keys: Sequence[str]) -> DataFrame:
    """Counts of every expected stratum, empty ones as zero, plus unexpected ones."""
    spark = df.sparkSession
    want = spark.createDataFrame([tuple(x) for x in expected], ", ".join(f"{k} string" for k in keys))
    got = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return want.join(got, list(keys), "full").fillna(0, subset=["n"])


# The version columns of an evaluation.
PINS = (
    "model_id", "model_version", "strategy_version", "prompt_version", "question_document_sha256",
    "question_schema_version", "feature_builder_version", "normalization_version",
    "serialization_version", "variant",
)
PROBABILITIES = signals.PROBABILITY_ANSWERS


def _malformed(required: Sequence[str]) -> Column:
    bad = F.lit(False)
    for c in required:
        bad = bad | F.col(c).isNull()
    for c in PROBABILITIES:
        bad = bad | ~F.coalesce(unit(F.col(c)), F.lit(False))
    conf = F.col("repricing_confidence")
    bad = bad | ~F.coalesce(unit(conf), F.lit(False))
    buckets = [F.col(f"_tick_{f}").try_cast("double") for f in signals.BUCKET_FIELDS]
    total = sum(buckets[1:], buckets[0])
    for b in buckets:
        bad = bad | ~F.coalesce(unit(b), F.lit(False))
    return bad | ~F.coalesce(finite(total) & (F.abs(total - 1.0) <= signals.SUM_TOLERANCE), F.lit(False))


def admit_evaluations(
    df: DataFrame, allow_live: bool, allow_stub: bool, pins: dict | None = None,
    required: Sequence[str] = ("timestamp", "state_hash", "observed_latency_ms"),
) -> DataFrame:
    """Adds ``skip_reason``: error, mode, version or malformed, the first that applies."""
    off = F.lit(False)
    for name, value in (pins or {}).items():
        off = off | ~F.col(name).eqNullSafe(F.lit(value))
    has_error = F.coalesce(F.trim("error") != "", F.lit(False))
    mode = (F.col("live") & F.lit(not allow_live)) | (~F.col("live") & F.lit(not allow_stub))
    reason = (
        F.when(has_error, "error").when(F.col("live").isNull(), "malformed").when(mode, "mode")
        .when(off, "version").when(_malformed(required), "malformed")
    )
    # The object is read once for all its fields.
    ticks = F.json_tuple("repricing_ticks", *signals.BUCKET_FIELDS).alias(*[f"_tick_{f}" for f in signals.BUCKET_FIELDS])
    return df.select("*", ticks).select(*df.columns, reason.alias("skip_reason"))


def audit_lineage(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (path, sha256) that no manifest entry covers."""
    return files.join(manifest.select("path", "sha256"), ["path", "sha256"], "left_anti")


def repair_lineage(manifest: DataFrame, order: Sequence[str]) -> DataFrame:
    """First entry per (path, sha256)."""
    return manifest.groupBy("path", "sha256").agg(
        F.min_by(F.struct(*manifest.columns), F.struct(*order)).alias("_r")
    ).select("_r.*")
