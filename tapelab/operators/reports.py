"""Segment summaries, A/B reports and audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelab.functions.prices import finite

SEGMENT = (
    "variant", "asset", "horizon", "regime", "split", "fidelity", "fill_model", "latency_profile",
)


def mean0(c: Column) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def hit_rate(c: Column, over_all: bool = False) -> Column:
    """Share above zero of the non-null values, or of all rows where asked."""
    n = F.count(F.lit(1)) if over_all else F.count(c)
    return F.coalesce(F.try_divide(F.count_if(c > 0), n), F.lit(0.0))


def segment_summary(df: DataFrame, keys: Sequence[str] = SEGMENT) -> DataFrame:
    mo, dr = F.col("markout_5s_pp"), F.col("drift_5s_pp")
    quotes, fills = F.count_if("quoted"), F.count_if("filled")
    pnl = F.coalesce(F.sum("pnl_pp"), F.lit(0.0))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("evaluations"),
        quotes.alias("quotes"),
        fills.alias("fills"),
        F.coalesce(F.try_divide(fills, quotes), F.lit(0.0)).alias("fill_rate"),
        mean0(mo).alias("mean_markout_5s_pp"),
        F.avg("latency_ms").alias("mean_latency_ms"),
        hit_rate(mo).alias("hit_rate_5s"),
        mean0(dr).alias("mean_drift_5s_pp"),
        hit_rate(dr).alias("hit_rate_drift_5s"),
        F.count(dr).alias("n_drift_5s"),
        mean0(F.col("fair_p_yes")).alias("mean_fair_p_yes"),
        mean0(F.col("pressure")).alias("mean_pressure"),
        pnl.alias("total_pnl_pp"),
        F.coalesce(F.try_divide(pnl, fills), F.lit(0.0)).alias("pnl_per_trade"),
        F.count_if("stale_skipped").alias("stale_skips"),
        F.count_if("incomplete_pair").alias("incomplete_pairs"),
    )


def breakdowns(df: DataFrame, dims: Sequence[str], value: str) -> DataFrame:
    """Count and mean of ``value`` for every level of every dimension, in one pass."""
    grouped = df.groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims]).agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n"), mean0(F.col(value)).alias("mean_value")
    )
    n = len(dims)
    # A set keeps one dimension: its bit in the grouping id is 0 and all others are 1.
    which, level = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, d in enumerate(dims):
        mine = F.col("_g") == F.lit(2**n - 1 - 2 ** (n - 1 - i))
        which = F.when(mine, F.lit(d)).otherwise(which)
        level = F.when(mine, F.col(d).cast("string")).otherwise(level)
    return grouped.select(which.alias("dimension"), level.alias("level"), "n", "mean_value")


def variant_summary(df: DataFrame, variants: Sequence[str], where: Column | None = None) -> DataFrame:
    rows = df.where(F.col("variant").isin(*variants))
    rows = rows if where is None else rows.where(where)
    return rows.groupBy("variant").agg(
        F.count(F.lit(1)).alias("n"),
        mean0(F.col("markout_5s_pp")).alias("mean_markout_5s"),
        F.coalesce(F.sum("pnl_pp"), F.lit(0.0)).alias("sum_pnl"),
    )


def complete_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("status") == "complete").select("run_id", "pair_id")


def ab_summary(markouts: DataFrame, pairs: DataFrame, keys: Sequence[str], hits_over_all: bool = False) -> DataFrame:
    """Signed markout per variant over complete pairs only."""
    rows = markouts.join(complete_pairs(pairs), ["run_id", "pair_id"])
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_markouts"),
        F.avg("markout_1s_pp").alias("mean_markout_1s_pp"),
        F.avg("markout_5s_pp").alias("mean_markout_5s_pp"),
        hit_rate(F.col("markout_5s_pp"), hits_over_all).alias("hit_rate_5s"),
    )


def paired(df: DataFrame, ref: str, alt: str, values: Sequence[str], keys: Sequence[str] = ("run_id", "pair_id")) -> DataFrame:
    """One row per pair that has both variants: ``ref_*`` and ``alt_*`` columns.

    A conditional pivot: one shuffle of the two variants instead of a self-join.
    """
    two = df.where(F.col("variant").isin(ref, alt))
    side = lambda name, c: F.max_by(c, F.when(F.col("variant") == name, F.lit(1)))
    out = two.groupBy(*keys).agg(
        F.count_if(F.col("variant") == ref).alias("_r"),
        F.count_if(F.col("variant") == alt).alias("_a"),
        *[side(ref, F.col(v)).alias(f"ref_{v}") for v in values],
        *[side(alt, F.col(v)).alias(f"alt_{v}") for v in values],
    )
    return out.where((F.col("_r") > 0) & (F.col("_a") > 0)).drop("_r", "_a")


def ab_delta(df: DataFrame, pairs: DataFrame, ref: str, alt: str, values: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Mean alt-minus-ref per segment over complete pairs."""
    rows = df.join(complete_pairs(pairs), ["run_id", "pair_id"])
    got = paired(rows, ref, alt, [*values, *keys])
    seg = [F.col(f"ref_{k}").alias(k) for k in keys]
    return got.groupBy(*seg).agg(
        F.count(F.lit(1)).alias("n_complete_pairs"),
        *[F.avg(F.col(f"alt_{v}") - F.col(f"ref_{v}")).alias(f"delta_{v}") for v in values],
    )


def joined_research(markouts: DataFrame, signals: DataFrame, pairs: DataFrame) -> DataFrame:
    """Markouts with the signal of the same pair and variant, complete pairs only."""
    rows = markouts.join(signals, ["run_id", "pair_id", "variant"])
    return rows.join(complete_pairs(pairs), ["run_id", "pair_id"])


def conditional_mean(df: DataFrame, x: str, y: str, level: float, keys: Sequence[str] = ()) -> DataFrame:
    """Count and mean of finite ``y`` where finite ``x`` exceeds the level; empty is 0."""
    pick = F.when(finite(F.col(x)) & (F.col(x) > level) & finite(F.col(y)), F.col(y))
    return df.groupBy(*keys).agg(F.count(pick).alias("n"), mean0(pick).alias("mean_y"))


def threshold_ladder(df: DataFrame, x: str, y: str, levels: Sequence[float], keys: Sequence[str]) -> DataFrame:
    rungs = [
        F.avg(F.when(F.col(x) > v, F.col(y))).alias(f"mean_above_{int(round(v * 100)):03d}") for v in levels
    ]
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean_y"), hit_rate(F.col(y)).alias("hit_rate"), *rungs
    )


def decision_counts(decisions: DataFrame, fills: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Decisions and quotes beside fills and filled size; neither is inferred."""
    d = decisions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_decisions"), F.count_if(F.col("decision") == "QUOTE").alias("n_quotes")
    )
    f = fills.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_fills"), F.sum("size").alias("filled_size"))
    return d.join(f, list(keys), "full").fillna(0)


def pair_audit(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return pairs.groupBy(*keys, "status").agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.sum("control_ok").alias("control_ok_rows"),
        F.sum("quant_ok").alias("quant_ok_rows"),
    )


def pair_status(df: DataFrame, ref: str, alt: str, keys: Sequence[str]) -> DataFrame:
    """Completeness of each pair from its variant rows."""
    return (
        df.groupBy("run_id", "pair_id", *keys)
        .agg(
            F.max(F.when(F.col("variant") == ref, 1).otherwise(0)).cast("long").alias("control_ok"),
            F.max(F.when(F.col("variant") == alt, 1).otherwise(0)).cast("long").alias("quant_ok"),
        )
        .withColumn(
            "status", F.when(F.col("control_ok") + F.col("quant_ok") == 2, "complete").otherwise("incomplete")
        )
    )


def repricing_accuracy(df: DataFrame, buckets: str, move: str, keys: Sequence[str]) -> DataFrame:
    """Share of rows whose likeliest bucket points the way the price then moved.

    ``buckets`` is a map from bucket name to probability; ties go to the first name.
    """
    entries = F.transform(
        F.map_entries(buckets), lambda e: F.struct(e["value"].alias("p"), e["key"].alias("b"))
    )
    top = F.aggregate(
        entries, F.struct(F.lit(-1.0).alias("p"), F.lit("").alias("b")),
        lambda acc, e: F.when(e["p"] > acc["p"], e).otherwise(acc),
    )["b"]
    said = F.when(top.startswith("UP"), 1).when(top.startswith("DOWN"), -1).otherwise(0)
    seen = F.signum(F.col(move)).cast("int")
    return df.where(F.col(move).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(said == seen, 1.0).otherwise(0.0)).alias("accuracy")
    )
