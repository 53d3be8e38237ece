"""Quantitative enrichment and regime buckets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelab.functions.prices import finite, positive

MIN_VOL_PCT = 1e-6
BASELINE_MODEL = "zero_drift_lognormal"


# The rational approximation of the normal tail by Hart (1968), numerator and denominator from the highest power
# down, and where the continued fraction of four terms takes over.
_TAIL_NUMERATOR = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376,
)
_TAIL_DENOMINATOR = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948,
    440.413735824752,
)
_FAR, _LAST = 5.0 * 2.0**0.5, 0.65


def _horner(x: Column, factors: tuple[float, ...]) -> Column:
    out = F.lit(factors[0])
    for f in factors[1:]:
        out = out * x + f
    return out


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function as a column expression; the error is under 1e-14.

    The tail is exp(-z^2 / 2) times a ratio of two polynomials, and beyond five times the root of two times a short continued
    fraction. ``z`` should be a plain column, as it occurs in every term.
    """
    x = F.abs(z)
    far = x + _LAST
    for k in (4.0, 3.0, 2.0, 1.0):
        far = x + k / far
    near = _horner(x, _TAIL_NUMERATOR) / _horner(x, _TAIL_DENOMINATOR)
    tail = F.exp(-z * z / 2.0) * F.when(x < _FAR, near).otherwise(1.0 / ((2.0 * math.pi) ** 0.5 * far))
    return F.when(z > 0, 1.0 - tail).when(z <= 0, tail)


def _floor_vol(v: Column, low: float) -> Column:
    return F.when(positive(v), F.greatest(v, F.lit(low))).otherwise(F.lit(low))


def _ratio(a: Column, b: Column) -> Column:
    q = F.try_divide(a, b)
    return F.when(finite(a) & finite(q), q).otherwise(F.lit(0.0))


def quant_features(
    df: DataFrame, min_vol_pct: float = MIN_VOL_PCT, vol_source: str = "short_1m",
    horizon_scaling: bool = True,
) -> DataFrame:
    """Adds z-score, sigma distance, lognormal baseline P(YES) and the vol ratio.

    Expects ``ret_1s_pct, realized_vol_1m_pct, realized_vol_5m_pct, spot, target,
    distance_to_target_pct, time_remaining_secs``.
    """
    low = min_vol_pct if min_vol_pct > 0 and min_vol_pct < float("inf") else MIN_VOL_PCT
    raw = "realized_vol_1m_pct" if vol_source == "short_1m" else "realized_vol_5m_pct"
    sigma = _floor_vol(F.col(raw), low)
    secs = F.col("time_remaining_secs")
    spot, target = F.col("spot"), F.col("target")
    dist = F.col("distance_to_target_pct")
    if horizon_scaling:
        dsig = F.when(finite(dist) & (secs > 0), _ratio(dist, sigma * F.sqrt(secs.cast("double"))))
    else:
        dsig = F.when(finite(dist), _ratio(dist, sigma))
    s = sigma / 100.0
    d2 = F.try_divide(
        F.ln(F.try_divide(spot, target)) - 0.5 * s * s * secs, s * F.sqrt(secs.cast("double"))
    )
    usable = positive(spot) & positive(target)
    df = df.withColumn("_z", F.when(usable & (secs > 0) & finite(d2), d2))
    cdf = normal_cdf(F.col("_z"))
    p = (
        F.when(~F.coalesce(usable, F.lit(False)), 0.5)
        .when(secs == 0, F.when(spot > target, 1.0).when(spot < target, 0.0).otherwise(0.5))
        .otherwise(F.coalesce(F.least(F.greatest(cdf, F.lit(0.0)), F.lit(1.0)), F.lit(0.5)))
    )
    v1, v5 = F.col("realized_vol_1m_pct"), F.col("realized_vol_5m_pct")
    ratio = _floor_vol(v1, low) / _floor_vol(v5, low)
    usable_vols = finite(v1) & finite(v5) & (v1 >= 0) & (v5 >= 0) & finite(ratio)
    return df.withColumns(
        {
            "move_zscore_1s": _ratio(F.col("ret_1s_pct"), sigma),
            "z_vol_pct": sigma,
            "z_vol_source": F.lit(vol_source),
            "distance_sigma": F.coalesce(dsig, F.lit(0.0)),
            "sigma_horizon_secs": secs if horizon_scaling else F.lit(1).cast("long"),
            "quant_baseline_p_yes": p,
            "baseline_model": F.lit(BASELINE_MODEL),
            "vol_regime_ratio": F.when(usable_vols, ratio).otherwise(F.lit(1.0)),
        }
    ).drop("_z")


# Regime cut-offs.
TREND_CUT, OFI_CUT, BASIS_CUT = 0.1, 0.3, 0.0005
FAR_MIN, MID_MIN, NEAR_MIN = 240, 60, 10


def _three_way(x: Column, cut: float, high: str, low: str, mid: str) -> Column:
    return F.when(finite(x) & (x > cut), high).when(finite(x) & (x < -cut), low).otherwise(mid)


def bucket_regime(df: DataFrame) -> DataFrame:
    """Fixed-threshold trend, time, sigma, flow and basis buckets."""
    m, s = F.col("minutes_to_resolution"), F.col("distance_sigma")
    return df.withColumns(
        {
            "trend_bucket": _three_way(F.col("trend_score"), TREND_CUT, "bull", "bear", "sideways"),
            "time_bucket": F.when(m > FAR_MIN, "far").when(m >= MID_MIN, "mid")
            .when(m >= NEAR_MIN, "near").otherwise("very_near"),
            "sigma_bucket": F.when(~finite(s), "pos_0_to_1").when(s < -2, "neg_beyond_2")
            .when(s < -1, "neg_2_to_1").when(s < 0, "neg_1_to_0").when(s < 1, "pos_0_to_1")
            .when(s <= 2, "pos_1_to_2").otherwise("pos_beyond_2"),
            "flow_bucket": _three_way(F.col("ofi"), OFI_CUT, "strong_buy", "strong_sell", "neutral"),
            "basis_bucket": _three_way(F.col("basis"), BASIS_CUT, "positive", "negative", "neutral"),
        }
    )
