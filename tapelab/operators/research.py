"""Signal research statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapelab.functions.decisions import GATES, THRESHOLDS, passes_gate
from tapelab.functions.prices import finite


def corr_matrix(df: DataFrame, xs: Sequence[str], ys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Pearson r of every (x, y) in one pass; null under 3 rows or without variance.

    A row gives one entry per pair of which it has both values; the entries are summed per pair before the shuffle.
    """
    value = lambda c: F.col(c).cast("double")
    entries = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), value(x).alias("a"), value(y).alias("b")) for x in xs for y in ys])
    long = df.select(*by, F.explode(entries).alias("c")).select(*by, "c.x", "c.y", "c.a", "c.b")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    a, b = F.when(both, F.col("a")), F.when(both, F.col("b"))
    # Without variance the co-moments are exactly zero and corr is NaN.
    r = F.corr(a, b)
    return long.groupBy(*by, "x", "y").agg(F.count(a).alias("n"), F.when((F.count(a) >= 3) & ~F.isnan(r), r).alias("r"))


def _stack(cols: Sequence[str]) -> Column:
    return F.explode(
        F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in cols])
    )


def variance_split(df: DataFrame, cols: Sequence[str], by: str) -> DataFrame:
    """Overall, mean within-group and between-group population std per column.

    Groups of one row count for "between" but not for "within".
    """
    long = df.select(by, _stack(cols).alias("x")).select(by, "x.name", "x.v")
    groups = long.groupBy("name", by).agg(
        F.count("v").alias("n"), F.avg("v").alias("m"), F.stddev_pop("v").alias("s")
    )
    inner = groups.groupBy("name").agg(
        F.coalesce(F.avg(F.when(F.col("n") > 1, F.col("s"))), F.lit(0.0)).alias("std_within"),
        F.when(F.count(F.lit(1)) > 1, F.stddev_pop("m")).otherwise(0.0).alias("std_between"),
    )
    whole = long.groupBy("name").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"),
    )
    return whole.join(inner, "name")


def rank_values(df: DataFrame, x: str, probs: Sequence[float], accuracy: int = 10_000, most: int = 100_000) -> DataFrame:
    """``sorted(x)[floor(n * p)]`` for each ``p``: one row, array ``cuts``.

    A sketch brackets each rank by three of its error bounds. While a bracket holds more than ``most`` rows, a sketch of the rows inside
    brackets the rank again; then the distinct values inside are ordered, so no task orders more than that. Only the borders and
    counts of the brackets reach the driver. A rank outside its bracket fails the query instead of being wrong.
    """
    v = df.where(F.col(x).isNotNull()).select(F.col(x).cast("double").alias("v"))
    whole = v.agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    ranks = [min(int(math.floor(whole.n * p)), whole.n - 1) for p in probs]
    # of every rank: its bracket, the rows below the bracket and those inside
    brackets = [(whole.lo, whole.hi, 0, whole.n)] * len(ranks)
    slack = 3.0 / accuracy
    while any(inside > most and lo < hi for lo, hi, _, inside in brackets):
        asks = []
        for (lo, hi, below, inside), t in zip(brackets, ranks, strict=True):
            p = (t - below) / inside
            held = F.when(F.col("v").between(lo, hi), F.col("v"))
            asks.append(F.percentile_approx(held, [max(p - slack, 0.0), min(p + slack, 1.0)], accuracy))
        narrowed = v.agg(*[a.alias(f"b{i}") for i, a in enumerate(asks)]).first()
        borders = [tuple(b) for b in narrowed]
        within = lambda lo, hi: F.count_if(F.col("v").between(lo, hi))
        counts = v.agg(*[c for i, (lo, hi) in enumerate(borders) for c in (F.count_if(F.col("v") < lo).alias(f"l{i}"), within(lo, hi).alias(f"n{i}"))]).first()
        after = [(*b, counts[2 * i], counts[2 * i + 1]) for i, b in enumerate(borders)]
        if [b[:2] for b in after] == [b[:2] for b in brackets]:
            break  # as narrow as sketches can make it
        brackets = after
    sides = F.array(*[F.struct(F.lit(i).alias("i"), *(F.lit(b).alias(n) for n, b in zip(("lo", "hi", "below", "t"), (*b[:3], t), strict=True))) for i, (b, t) in enumerate(zip(brackets, ranks, strict=True))])
    near = v.withColumn("_b", F.explode(F.filter(sides, lambda b: F.col("v").between(b["lo"], b["hi"])))).groupBy("_b", "v").agg(F.count(F.lit(1)).alias("c"))
    cum = F.sum("c").over(Window.partitionBy("_b.i").orderBy("v"))
    first = near.withColumn("cum", cum).where(F.col("_b.below") + F.col("cum") > F.col("_b.t"))
    picks = first.groupBy("_b.i").agg(F.min("v").alias("cut"), F.min(F.col("_b.below") - F.col("_b.t")).alias("gap"))
    checked = F.when(F.col("gap") > 0, F.raise_error(F.lit("rank outside its bracket"))).otherwise(F.col("cut"))
    ordered = F.array_sort(F.collect_list(F.struct("i", checked.alias("cut"))))
    return picks.agg(F.transform(ordered, lambda s: s["cut"]).alias("cuts"))


def quintile_means(df: DataFrame, x: str, ys: Sequence[str], accuracy: int = 10_000) -> DataFrame:
    """Mean of each ``y`` by the number of quintile cuts ``x`` exceeds (0..4)."""
    cuts = rank_values(df, x, (0.2, 0.4, 0.6, 0.8), accuracy)
    rows = df.where(F.col(x).isNotNull()).withColumn("cuts", cuts.scalar())
    bucket = F.size(F.filter("cuts", lambda c: F.col(x) > c))
    return rows.groupBy(bucket.cast("long").alias("bucket")).agg(
        *[F.count(y).alias(f"n_{y}") for y in ys], *[F.avg(y).alias(f"mean_{y}") for y in ys]
    )


# Pressure bins; all half open but the top one.
PRESSURE_BINS = (
    ("[-1.0,-0.6)", -1.0, -0.6), ("[-0.6,-0.2)", -0.6, -0.2), ("[-0.2,+0.2]", -0.2, 0.2),
    ("(+0.2,+0.6]", 0.2, 0.6), ("(+0.6,+1.0]", 0.6, 1.0),
)


def binned_means(df: DataFrame, x: str, y: str, bins=PRESSURE_BINS) -> DataFrame:
    v, top = F.col(x), max(hi for _, _, hi in bins)
    label = F.lit(None).cast("string")
    for name, lo, hi in reversed(bins):
        inside = (v >= lo) & (v < hi)
        inside = inside | (v == hi) if hi == top else inside
        label = F.when(inside, F.lit(name)).otherwise(label)
    rows = df.where(F.col(y).isNotNull()).withColumn("bin", label).where(F.col("bin").isNotNull())
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean_y"))


def paired_delta_stats(pairs: DataFrame, names: Sequence[str]) -> DataFrame:
    """Per answer over ``ref_*``/``alt_*`` pairs: mean |d|, P(|d|>=.10), sign agreement."""
    long = pairs.select(
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("name"), (F.col(f"alt_{n}") - F.col(f"ref_{n}")).alias("d")) for n in names])
        ).alias("x")
    ).select("x.name", "x.d")
    big = F.abs("d") >= 0.05
    up = F.try_divide(F.count_if(big & (F.col("d") > 0)), F.count_if(big))
    return long.groupBy("name").agg(
        F.count("d").alias("n_pairs"),
        F.coalesce(F.avg(F.abs("d")), F.lit(0.0)).alias("mean_abs_delta"),
        F.coalesce(F.avg(F.when(F.abs("d") >= 0.10, 1.0).otherwise(0.0)), F.lit(0.0)).alias("p_big"),
        F.when(up.isNotNull(), F.greatest(up, 1 - up)).alias("sign_agreement"),
    )


def probe_vs_rest(df: DataFrame, cols: Sequence[str], is_probe: Column) -> DataFrame:
    long = df.select(is_probe.alias("p"), _stack(cols).alias("x")).select("p", "x.name", "x.v")
    probe, rest = F.when(F.col("p"), F.col("v")), F.when(~F.col("p"), F.col("v"))
    return long.groupBy("name").agg(
        F.count(probe).alias("n_probe"), F.count(rest).alias("n_rest"),
        F.avg(probe).alias("probe_mean"), F.avg(rest).alias("rest_mean"),
        F.coalesce(F.stddev_pop(probe), F.lit(0.0)).alias("probe_std"),
        F.coalesce(F.stddev_pop(rest), F.lit(0.0)).alias("rest_std"),
    )


def group_means(df: DataFrame, by: str, cols: Sequence[str]) -> DataFrame:
    """Mean of every column per group: the wide table comes straight from one aggregate."""
    return df.groupBy(by).agg(*[F.avg(c).alias(c) for c in cols])


# The cut-offs that were set before the experiment.
SIGN_MIN, NO_MARKOUT_R, PREDICTIVE_R, PREDICTIVE_N, PREDICTIVE_SPREAD_PP, SENSIBLE_STD = 0.75, 0.15, 0.30, 50, 1.0, 0.10


def verdicts(stats: DataFrame, deltas: DataFrame, markout: DataFrame | None = None, sign_min: float = SIGN_MIN) -> DataFrame:
    """Flags over the small per-answer frames (``name, std``; ``name, mean_abs_delta, sign_agreement``; ``x, r``).

    ``uses_both`` needs two answers that move strongly with one sign in at least ``sign_min`` of their large moves (the experiment
    asks for a consistent sign and names no part; 0.75 is the choice here). ``reacts_without_markout`` needs one of the reacting
    verdicts and no answer whose correlation with the drift (``markout``) reaches 0.15; it is null without ``markout``.
    """
    s = stats.select("name", "std").join(deltas.select("name", "mean_abs_delta", "sign_agreement"), "name", "left")
    flat, varied = F.count_if(F.col("std") < 0.05), F.count_if(F.col("std") >= 0.10)
    moved = F.count_if(F.col("mean_abs_delta") >= 0.05)
    strong = F.count_if((F.col("mean_abs_delta") >= 0.10) & (F.col("sign_agreement") >= sign_min))
    found = s.agg(
        flat.alias("flat"), varied.alias("varied"), moved.alias("moved"),
        (flat >= 6).alias("ignores_state"),
        ((varied >= 4) & (moved == 0)).alias("state_not_quant"),
        ((varied >= 4) & (strong >= 2)).alias("uses_both"),
    )
    tied = None if markout is None else markout.agg(F.count_if(F.abs("r") >= NO_MARKOUT_R)).scalar()
    quiet = F.lit(None).cast("boolean") if tied is None else tied == 0
    return found.withColumn("reacts_without_markout", (F.col("state_not_quant") | F.col("uses_both")) & quiet)


def branch_verdict(df: DataFrame, answer: str, drift: str, variant: str) -> DataFrame:
    """One row: does an answer vary (overall, and the least and most by variant), does it predict the drift, and the branch.

    Branch 1: it varies and predicts (correlation of 0.30 or more on 50 rows or more, and 1.0 pp between the quintile means of the
    drift; an empty quintile counts as 0); branch 2: it varies only; branch 3: it does not vary.
    """
    a, d = F.col(answer).cast("double"), F.col(drift).cast("double")
    both = finite(a) & finite(d)
    r = F.corr(F.when(both, a), F.when(both, d))
    n = F.count_if(both)
    whole = df.agg(
        F.coalesce(F.stddev_pop(a), F.lit(0.0)).alias("std"), n.alias("n"), F.when((n >= 3) & ~F.isnan(r), r).alias("r")
    )
    by = df.groupBy(variant).agg(F.coalesce(F.stddev_pop(a), F.lit(0.0)).alias("s"))
    spread = by.agg(F.struct(F.min("s").alias("least"), F.max("s").alias("most"))).scalar()
    means = F.when(F.col(f"n_{drift}") > 0, F.col(f"mean_{drift}"))
    empty = F.when(F.count(means) < 5, 0.0)
    quintiles = quintile_means(df, answer, [drift]).agg(F.greatest(F.max(means), empty) - F.least(F.min(means), empty)).scalar()
    out = whole.withColumns({"_v": spread, "spread_pp": quintiles})
    sensible = F.col("std") >= SENSIBLE_STD
    predicts = (F.abs("r") >= PREDICTIVE_R) & (F.col("n") >= PREDICTIVE_N) & (F.col("spread_pp") >= PREDICTIVE_SPREAD_PP)
    branch = F.when(sensible & F.coalesce(predicts, F.lit(False)), 1).when(sensible, 2).otherwise(3)
    return out.select("std", F.col("_v.least").alias("std_least"), F.col("_v.most").alias("std_most"), "n", "r", "spread_pp", branch.alias("branch"))


def gate_report(df: DataFrame, thresholds: dict = THRESHOLDS) -> DataFrame:
    """Per gate: min, mean, max and passes; plus the rows that pass all of them."""
    cells, aggs = [], []
    for name, answer, is_min in GATES:
        v = F.when(finite(F.col(answer)), F.col(answer))
        ok = v > thresholds[name] if is_min else v < thresholds[name]
        aggs += [
            F.count(v).alias(f"n_{answer}"), F.min(v).alias(f"lo_{answer}"), F.avg(v).alias(f"m_{answer}"),
            F.max(v).alias(f"hi_{answer}"), F.count_if(ok).alias(f"p_{answer}"),
        ]
        cells.append(
            F.struct(
                F.lit(answer).alias("signal"), F.col(f"n_{answer}").alias("n"), F.col(f"lo_{answer}").alias("min"),
                F.col(f"m_{answer}").alias("mean"), F.col(f"hi_{answer}").alias("max"), F.col(f"p_{answer}").alias("passed"),
            )
        )
    none = F.lit(None).cast("double")
    cells.append(
        F.struct(
            F.lit("CONJUNCTION").alias("signal"), F.col("_rows").alias("n"), none.alias("min"), none.alias("mean"),
            none.alias("max"), F.col("_all").alias("passed"),
        )
    )
    wide = df.agg(*aggs, F.count(F.lit(1)).alias("_rows"), F.count_if(passes_gate(thresholds)).alias("_all"))
    return wide.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def latency_profile(df: DataFrame, by: Sequence[str], value: str, accuracy: int | None = None) -> DataFrame:
    """p50..p99.9 per span from a mergeable sketch; relative rank error 1/accuracy."""
    names = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}
    q = F.percentile_approx(value, list(names.values()), accuracy or 100_000)
    wide = df.groupBy(*by).agg(F.count(value).alias("n"), q.alias("_q"), F.max(value).alias("max"))
    return wide.select(*by, "n", *[F.col("_q")[i].alias(n) for i, n in enumerate(names)], "max")


def sweep_grid(spark, **dims: Sequence[float]) -> DataFrame:
    """Every combination of a few short lists: one id range read in mixed radix."""
    n = 1
    for values in dims.values():
        n *= len(values)
    cols, step = [], n
    for name, values in dims.items():
        step //= len(values)
        index = (F.floor(F.col("id") / step) % len(values)).cast("int")
        cols.append(F.get(F.array(*[F.lit(v) for v in values]), index).alias(name))
    return spark.range(n).select(F.col("id").alias("param_id"), *cols)


def sweep_report(df: DataFrame, grid: Sequence[dict], by: Sequence[str]) -> DataFrame:
    """Gate passes per threshold set and segment in one pass over the rows.

    Each set is one conditional count, so the table is read once and never multiplied
    by the number of sets.
    """
    aggs = [F.count_if(passes_gate({**THRESHOLDS, **g})).alias(f"g{i}") for i, g in enumerate(grid)]
    wide = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_evaluated"), *aggs)
    cells = F.array(
        *[F.struct(F.lit(i).cast("long").alias("param_id"), F.col(f"g{i}").alias("n_pass")) for i in range(len(grid))]
    )
    return wide.select(*by, "n_evaluated", F.explode(cells).alias("c")).select(*by, "n_evaluated", "c.param_id", "c.n_pass")
