"""Numbering, thinning, splitting, deduplication and top-n.

Where rows are numbered, ``most`` sets the rows of a bucket in crowded times (``scan.even_buckets``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapelab.operators import scan
from tapelab.operators.scan import DAY_MS, KEYLESS_MS


def scan_window(
    df: DataFrame, asset_col: str, asset: str, ts: str, lo: int, hi: int, every: int = 1,
    limit: int | None = None, tie: Sequence[str] = (), width: int = KEYLESS_MS, most: int | None = None,
) -> DataFrame:
    """Rows of one asset in ``[lo, hi]``, every n-th, up to a cap the user asked for."""
    got = df.where((F.col(asset_col) == asset) & F.col(ts).between(lo, hi))
    if every <= 1 and limit is None:
        return got
    got = scan.numbered(got, [], ts, tie, width, rn="_rn", most=most)
    keep = F.pmod(F.col("_rn") - 1, F.lit(every)) == 0
    if limit is not None:
        keep = keep & (F.floor((F.col("_rn") - 1) / every) < limit)
    return got.where(keep).drop("_rn")


def sample_even(df: DataFrame, by: Sequence[str], ts: str, k: int, tie: Sequence[str] = (), width: int = DAY_MS, most: int | None = None) -> DataFrame:
    """Rows at positions ``floor(i * n / k)``; all rows when a key has at most ``k``."""
    got = scan.numbered(df, by, ts, tie, width, rn="_rn", total="_n", most=most)
    pos, n = F.col("_rn") - 1, F.col("_n")
    i = F.ceil(pos * k / n).cast("long")
    hit = (i < k) & (F.floor(i * n / k) == pos)
    return got.where((n <= k) | hit).drop("_rn", "_n")


def sample_endpoints(df: DataFrame, by: Sequence[str], ts: str, k: int, tie: Sequence[str] = (), width: int = DAY_MS, most: int | None = None) -> DataFrame:
    """Rows at positions ``i * (n - 1) div (k - 1)``; the middle row when ``k`` is 1."""
    got = scan.numbered(df, by, ts, tie, width, rn="_rn", total="_n", most=most)
    pos, n = F.col("_rn") - 1, F.col("_n")
    if k <= 0:
        return got.where(F.lit(False)).drop("_rn", "_n")
    take = F.least(F.lit(k), n)
    i = F.ceil(F.try_divide(pos * (take - 1), n - 1)).cast("long")
    # i = smallest ordinal whose position can reach this row.
    hit = (i <= take - 1) & (F.floor(F.try_divide(i * (n - 1), take - 1)) == pos)
    middle = pos == F.floor(n / 2)
    return got.where(F.when(take == 1, middle).otherwise(hit)).drop("_rn", "_n")


def stride(df: DataFrame, by: Sequence[str], ts: str, cap: int, head: int, tie: Sequence[str] = (), width: int = DAY_MS, most: int | None = None):
    """Strided rows (stride ``n div cap``, up to ``head``) and the dense head for labels."""
    got = scan.numbered(df, by, ts, tie, width, rn="_rn", total="_n", most=most)
    step = F.greatest(F.floor(F.col("_n") / max(cap, 1)), F.lit(1))
    pos = F.col("_rn") - 1
    strided = got.where((F.pmod(pos, step) == 0) & (F.floor(pos / step) < head))
    dense = got.where(pos < head)
    return strided.drop("_rn", "_n"), dense.drop("_rn", "_n")


def cap_per_bucket(df: DataFrame, bucket: Sequence[str], ts: str, cap: int, tie: Sequence[str] = ()) -> DataFrame:
    """The first ``cap`` rows of each bucket in source order; each task keeps no more than ``cap`` of a bucket before the shuffle."""
    order = Window.partitionBy(*bucket).orderBy(ts, *tie)
    return df.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= cap).drop("_rn")


def round_robin(df: DataFrame, bucket: Sequence[str], ts: str, tie: Sequence[str] = (), width: int = DAY_MS, most: int | None = None) -> DataFrame:
    """First of every bucket, then second of every bucket, and so on; adds ``round``."""
    got = scan.numbered(df, bucket, ts, tie, width, rn="round", most=most)
    return got.orderBy("round", *bucket)


def temporal_split(
    df: DataFrame, fractions: dict[str, float], ts: str, tie: Sequence[str] = (), width: int = KEYLESS_MS,
    most: int | None = None,
) -> DataFrame:
    """Chronological split: each named fraction takes ``floor(n * f)`` rows, the last name the rest."""
    got = scan.numbered(df, [], ts, tie, width, rn="_rn", total="_n", most=most)
    names = list(fractions)
    label, end = F.lit(None).cast("string"), F.lit(0)
    conditions = []
    for name in names[:-1]:
        end = end + F.floor(F.col("_n") * F.lit(fractions[name]))
        conditions.append((F.col("_rn") <= end, name))
    label = F.lit(names[-1])
    for cond, name in reversed(conditions):
        label = F.when(cond, F.lit(name)).otherwise(label)
    return got.withColumn("split", label).drop("_rn", "_n")


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row per key, combined on the map side."""
    return _pick(df, keys, order, F.max_by)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key in the given order, combined on the map side."""
    return _pick(df, keys, order, F.min_by)


def _pick(df, keys, order, fn) -> DataFrame:
    return (
        df.groupBy(*keys)
        .agg(fn(F.struct(*df.columns), F.struct(*order)).alias("_row"))
        .select("_row.*")
    )


def union_dedupe(frames: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Overlapping archives as one table: the earlier archive's row wins per key."""
    tagged = [df.withColumn("_src", F.lit(i)) for i, df in enumerate(frames)]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return first_by(out, keys, ["_src", *order]).drop("_src")


def dedupe_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def sort_tape(df: DataFrame, *order: str) -> DataFrame:
    return df.orderBy(*order)


def top_n(df: DataFrame, n: int, *order, newest: bool = True) -> DataFrame:
    cols = [F.col(c).desc() if newest else F.col(c).asc() for c in order]
    return df.orderBy(*cols).limit(n)


def run_status(rows: DataFrame, run: str, ts: str, decision: str, signal: str, gate: float) -> DataFrame:
    """Per run: rows, quotes, latest time, best signal and what it lacks to the gate."""
    return rows.groupBy(run).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(decision) == "QUOTE").alias("n_quotes"),
        F.max(ts).alias("latest_ts"),
        F.max(signal).alias("best_signal"),
        F.greatest(F.lit(gate) - F.max(signal), F.lit(0.0)).alias("gap_to_gate"),
    )
