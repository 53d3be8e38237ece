"""Joins and aggregates over time intervals without pairing everything with everything."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_join(
    points: DataFrame, intervals: DataFrame, ts: str, start: str, end: str, width: int,
    by: Sequence[str] = (),
) -> DataFrame:
    """Points inside half-open intervals ``[start, end)``.

    Intervals are listed under every time bucket they touch, so the join is an equi-join
    on the bucket and only candidates of one bucket are tested. An interval spanning
    many buckets costs that many rows; choose ``width`` near the usual interval length.
    """
    last = F.greatest(F.col(end) - 1, F.col(start))
    spread = intervals.where(F.col(end) > F.col(start)).withColumn(
        "_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(last / width)))
    )
    home = points.withColumn("_b", F.floor(F.col(ts) / width))
    inside = (F.col(ts) >= F.col(start)) & (F.col(ts) < F.col(end))
    return home.join(spread, [*by, "_b"], "inner").where(inside).drop("_b")


FAN = 16


def cover(spans: DataFrame, keep: Sequence[str], levels: int) -> DataFrame:
    """Cut ``[_lo, _hi)`` into aligned blocks of 16^level: at most 30 per level.

    At each level the span keeps what the next coarser level cannot cover.
    """
    size = F.pow(F.lit(float(FAN)), F.col("level"))
    long = spans.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    long = long.withColumns(
        {
            "_a": F.ceil(F.col("_lo") / size).cast("long"),
            "_b": F.floor(F.col("_hi") / size).cast("long"),
            "_up": F.ceil(F.col("_lo") / (size * FAN)).cast("long") * FAN,
            "_down": F.floor(F.col("_hi") / (size * FAN)).cast("long") * FAN,
        }
    ).where(F.col("_b") > F.col("_a"))
    coarser = (F.col("_up") < F.col("_down")) & (F.col("level") < levels - 1)
    none = F.array().cast("array<bigint>")

    def run(a: str, b: str):
        return F.when(F.col(b) > F.col(a), F.sequence(F.col(a), F.col(b) - 1)).otherwise(none)

    pieces = F.when(coarser, F.concat(run("_a", "_up"), run("_down", "_b"))).otherwise(run("_a", "_b"))
    return long.select(*keep, "level", F.explode(pieces).alias("block"))


def interval_extremes(
    spans: DataFrame, ticks: DataFrame, ids: Sequence[str], by: Sequence[str], start: str, end: str,
    ts: str, value: str, unit_ms: int = 1, levels: int = 10,
) -> DataFrame:
    """Lowest and highest tick value inside each closed span ``[start, end]``.

    Ticks are pre-aggregated into aligned blocks of 16^level ms; a span is covered by a
    bounded number of whole blocks, so a span over millions of ticks still joins to a
    few hundred block rows and no span meets single ticks twice.
    """
    lo = F.floor(F.col(start) / unit_ms).cast("long")
    hi = (F.floor(F.col(end) / unit_ms) + 1).cast("long")
    keep = [*ids, *[b for b in by if b not in ids]]
    whole = spans.where(F.col(end) >= F.col(start)).select(*keep, lo.alias("_lo"), hi.alias("_hi"))
    pieces = cover(whole, keep, levels)
    units = F.floor(F.col(ts) / unit_ms).cast("long")
    leaf = ticks.groupBy(*by, units.alias("_u")).agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi")
    )
    blocks = (
        leaf.withColumn(
            "_x",
            F.explode(
                F.array(
                    *[
                        F.struct(
                            F.lit(n).alias("level"),
                            F.floor(F.col("_u") / (FAN**n)).cast("long").alias("block"),
                        )
                        for n in range(levels)
                    ]
                )
            ),
        )
        .groupBy(*by, "_x.level", "_x.block")
        .agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    )
    hits = pieces.join(blocks, [*by, "level", "block"])
    found = hits.groupBy(*ids).agg(F.min("_lo").alias("low"), F.max("_hi").alias("high"))
    return spans.join(found, list(ids), "left")


def excursions(
    positions: DataFrame, mids: DataFrame, ids: Sequence[str], by: Sequence[str], start: str, end: str,
    ts: str, mid: str, entry: str, qty: str,
) -> DataFrame:
    """Worst and best marked PnL of a long position between fill and exit."""
    got = interval_extremes(positions, mids, ids, by, start, end, ts, mid)
    pnl = lambda c: (F.col(c) - F.col(entry)) * F.col(qty)
    return got.withColumns(
        {
            "max_adverse_excursion": F.least(F.coalesce(pnl("low"), F.lit(0.0)), F.lit(0.0)),
            "max_favorable_excursion": F.greatest(F.coalesce(pnl("high"), F.lit(0.0)), F.lit(0.0)),
        }
    ).drop("low", "high")
