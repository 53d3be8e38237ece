"""Ordered scans that survive hot keys.

A plain ``Window.partitionBy(key).orderBy(ts)`` puts every row of a key into one
task. The functions here cut each key into time buckets, scan each bucket on its
own, and carry the state across buckets through a summary of one row per
(key, bucket). The summary is built with partial aggregation, so its shuffle is
small, and the second window runs over ``time range / width`` rows per key (ten
years at one hour: 87,600) however many rows the key has. ``ordered`` takes any number of
running values over one order from one such pass.

``width`` is in the unit of the ordering column (ms for every time column here).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapelab.session import settle

HOUR_MS = 3_600_000
DAY_MS = 86_400_000
#: Bucket of scans without a key: a busy day is 96 buckets, ten years are 350,000 rows of the second window.
KEYLESS_MS = 900_000
BUCKET = "_bucket"
#: Slots of the histogram of a crowded time cell.
FINE = 4096


def bucket_of(ts: Column, width: int) -> Column:
    return F.floor(ts / F.lit(width)).cast("long")


def with_bucket(df: DataFrame, ts: str, width: int) -> DataFrame:
    return df.withColumn(BUCKET, bucket_of(F.col(ts), width))


def bucket_window(by: Sequence[str]):
    return Window.partitionBy(*by, BUCKET)


def across(by: Sequence[str], descending: bool = False):
    """Buckets strictly before (after, if descending) the current one."""
    order = F.col(BUCKET).desc() if descending else F.col(BUCKET).asc()
    keys = [F.col(k) for k in by] or [F.lit(0)]
    return (
        Window.partitionBy(*keys)
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def join_null_safe(df: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on ``keys``, null keys included."""
    renamed = right.withColumnsRenamed({k: f"_c{i}" for i, k in enumerate(keys)})
    cond = None
    for i, k in enumerate(keys):
        term = df[k].eqNullSafe(renamed[f"_c{i}"])
        cond = term if cond is None else cond & term
    return df.join(renamed, cond, "left").drop(*[f"_c{i}" for i in range(len(keys))])


def join_carry(df: DataFrame, carried: DataFrame, by: Sequence[str]) -> DataFrame:
    return join_null_safe(df, carried, [*by, BUCKET])


def even_buckets(df: DataFrame, by: Sequence[str], ts: str, width: int, most: int) -> DataFrame:
    """Buckets of about ``most`` rows where time cells of ``width`` hold more, in place of one bucket per cell.

    Cells are counted first. Those above ``most`` get a histogram of ``FINE`` slots, whose running count says where a bucket ends; a bucket
    holds ``most`` rows and one slot at most. The map has at most ``FINE`` rows per crowded cell and is written once, so
    that all readers of the buckets see the same borders.
    """
    by = list(by)
    cell = bucket_of(F.col(ts), width)
    slot = F.floor((F.col(ts) - F.col("_cell") * width) * FINE / width).cast("long")
    work = df.withColumn("_cell", cell)
    crowded = settle(work.groupBy(*by, "_cell").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most), "crowded")
    if crowded.isEmpty():
        return df.withColumn(BUCKET, cell * FINE)
    work = work.withColumn("_slot", slot)
    inside = join_null_safe(work.select(*by, "_cell", "_slot"), crowded, [*by, "_cell"]).where(F.col("_n").isNotNull())
    slots = inside.groupBy(*by, "_cell", "_slot").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by, "_cell").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1))
    slots = settle(slots.select(*by, "_cell", "_slot", F.floor(F.coalesce(before, F.lit(0)) / most).cast("long").alias("_part")), "slots")
    work = join_null_safe(work, slots, [*by, "_cell", "_slot"])
    return work.withColumn(BUCKET, F.col("_cell") * FINE + F.coalesce("_part", F.lit(0))).drop("_cell", "_slot", "_part")


def last_value(c: Column) -> Column:
    return F.last(c, ignorenulls=True)


@dataclass(frozen=True)
class Running:
    """One value of an ordered pass: what a row takes from its bucket, and what its bucket takes from the others.

    ``local`` and ``outer`` are aggregates over a frame of rows and of bucket summaries; ``summary`` reduces a bucket to
    one value, given the value column and the order; ``joined`` makes the result of the two (either may be null).
    """

    value: Column | None
    local: Callable[[Column], Column]
    summary: Callable[[Column, Column], Column]
    outer: Callable[[Column], Column]
    joined: Callable[[Column, Column], Column]
    #: The first and last row of the local frame, from the current row; None: no frame (a ranking function).
    frame: tuple[int, int] | None = (Window.unboundedPreceding, Window.currentRow)
    #: Over all buckets of the key and not only over those before.
    everywhere: bool = False


def total(value: Column) -> Running:
    """Sum up to and including the row; null counts as zero."""
    x = F.coalesce(value.cast("double"), F.lit(0.0))
    return Running(x, F.sum, lambda v, _: F.sum(v), F.sum, lambda here, before: here + F.coalesce(before, F.lit(0.0)))


def latest(value: Column, inclusive: bool = True) -> Running:
    """Last non-null value up to the row, itself included or not."""
    newest = lambda v, order: F.max_by(v, F.when(v.isNotNull(), order))
    end = Window.currentRow if inclusive else -1
    return Running(value, last_value, newest, last_value, lambda here, before: F.coalesce(here, before), (Window.unboundedPreceding, end))


def highest(value: Column) -> Running:
    return Running(value, F.max, lambda v, _: F.max(v), F.max, lambda here, before: F.greatest(here, before))


def number() -> Running:
    """Row number, from 1."""
    count = lambda _, __: F.count(F.lit(1))
    return Running(None, lambda _: F.row_number(), count, F.sum, lambda here, before: (here + F.coalesce(before, F.lit(0))).cast("long"), None)


def rows_of_key() -> Running:
    count = lambda _, __: F.count(F.lit(1))
    return Running(None, lambda _: F.lit(None), count, F.sum, lambda _, every: every, None, True)


def previous(*columns: str) -> Running:
    """The row before, as a struct of ``columns``."""
    row = F.struct(*columns)
    return Running(row, lambda v: F.lag(v), lambda v, order: F.max_by(v, order), last_value, lambda here, before: F.coalesce(here, before), None)


def ordered(
    df: DataFrame, by: Sequence[str], ts: str, outputs: dict[str, Running], tie: Sequence[str] = (), width: int = HOUR_MS,
    most: int | None = None,
) -> DataFrame:
    """Adds every running value of ``outputs`` in (ts, tie) order per key.

    All of them share one bucket, one summary, one sort of the rows and one join; the input is read twice, for the rows and for
    the summary. With ``most`` a bucket holds about so many rows, however crowded its time (``even_buckets``).
    """
    names, by = list(outputs), list(by)
    made = list(outputs.values())
    work = with_bucket(df, ts, width) if most is None else even_buckets(df, by, ts, width, most)
    work = work.withColumns({f"_x{i}": o.value for i, o in enumerate(made) if o.value is not None})
    value = lambda i: F.col(f"_x{i}") if made[i].value is not None else F.lit(1)
    order = F.struct(ts, *tie)
    summary = work.groupBy(*by, BUCKET).agg(*[o.summary(value(i), order).alias(f"_s{i}") for i, o in enumerate(made)])
    every = Window.partitionBy(*([F.col(k) for k in by] or [F.lit(0)]))
    before = summary.select(
        *by, BUCKET, *[o.outer(F.col(f"_s{i}")).over(every if o.everywhere else across(by)).alias(f"_b{i}") for i, o in enumerate(made)]
    )
    rows = bucket_window(by).orderBy(ts, *tie)
    local = {}
    for i, o in enumerate(made):
        if not o.everywhere:
            local[f"_l{i}"] = o.local(value(i)).over(rows.rowsBetween(*o.frame) if o.frame else rows)
    work = join_carry(work.withColumns(local) if local else work, before, by)
    here = lambda i: F.lit(None) if made[i].everywhere else F.col(f"_l{i}")
    kept = [c for c in df.columns if c not in outputs]
    return work.select(*kept, *[o.joined(here(i), F.col(f"_b{i}")).alias(names[i]) for i, o in enumerate(made)])


def running_sum(
    df: DataFrame, by: Sequence[str], ts: str, values: dict[str, Column], tie: Sequence[str] = (), width: int = HOUR_MS
) -> DataFrame:
    """Inclusive running sums per key in (ts, tie) order: ``out name -> value``."""
    return ordered(df, by, ts, {n: total(v) for n, v in values.items()}, tie, width)


def running_last(
    df: DataFrame, by: Sequence[str], ts: str, values: dict[str, Column], tie: Sequence[str] = (), width: int = HOUR_MS,
    inclusive: bool = True,
) -> DataFrame:
    """Last non-null value per key up to the row (itself included or not): ``out -> value``."""
    return ordered(df, by, ts, {n: latest(v, inclusive) for n, v in values.items()}, tie, width)


def running_max(
    df: DataFrame, by: Sequence[str], ts: str, value: Column, out: str, tie: Sequence[str] = (), width: int = DAY_MS
) -> DataFrame:
    """Highest value per key up to and including the row."""
    return ordered(df, by, ts, {out: highest(value)}, tie, width)


def numbered(
    df: DataFrame, by: Sequence[str], ts: str, tie: Sequence[str] = (), width: int = HOUR_MS, rn: str = "_rn",
    total: str | None = None, most: int | None = None,
) -> DataFrame:
    """Row number per key in (ts, tie) order, from 1; optionally the key's row count."""
    return ordered(df, by, ts, {rn: number()} | ({total: rows_of_key()} if total else {}), tie, width, most)


def previous_row(
    df: DataFrame, by: Sequence[str], ts: str, columns: Sequence[str], tie: Sequence[str] = (), width: int = HOUR_MS,
    prefix: str = "prev_",
) -> DataFrame:
    """``lag`` by one row per key, across bucket borders."""
    work = ordered(df, by, ts, {"_prev": previous(*columns)}, tie, width)
    return work.select(*df.columns, *[F.col(f"_prev.`{c}`").alias(f"{prefix}{c}") for c in columns])


def _two_parts(df: DataFrame, by: Sequence[str], ts: str, span: int, aggs: dict[str, Column]) -> DataFrame:
    """Aggregates over ``[ts - span, ts]`` in two parts, as ``_here_<name>`` and ``_before_<name>``.

    Time is cut into blocks as long as the span, so a span is the end of one block and the start of the next. Both parts are running
    aggregates of their block, one forward and one backward: a row costs the same however many rows its span holds, and nothing is
    subtracted. Of the block before only the columns that ``aggs`` read are copied; an aggregate must skip nulls.
    """
    by, size = list(by), max(int(span), 1)
    running = (Window.unboundedPreceding, Window.currentRow)
    forward = bucket_window(by).orderBy(F.col(ts).asc()).rangeBetween(*running)
    backward = bucket_window(by).orderBy(F.col("_at").desc()).rangeBetween(*running)
    work = with_bucket(df.where(F.col(ts).isNotNull()), ts, size)
    here = {f"_here_{n}": agg.over(forward) for n, agg in aggs.items()}
    # Own rows look back from the start of their span and bring no values to the backward pass; the copies bring only these.
    own, rest = F.col("_x.own"), [c for c in df.columns if c not in by]
    home = F.struct(F.col(BUCKET).alias("bucket"), F.lit(True).alias("own"))
    after = F.struct((F.col(BUCKET) + 1).alias("bucket"), F.lit(False).alias("own"))
    work = work.withColumns(here).withColumn("_x", F.explode(F.array(home, after))).select(
        *by, F.col("_x.bucket").alias(BUCKET), own.alias("_own"),
        (F.col(ts) - F.when(own, F.lit(int(span))).otherwise(F.lit(0))).alias("_at"),
        *[F.when(~own, F.col(c)).alias(c) for c in rest],
        *[F.when(own, F.col(c)).alias(f"_own_{c}") for c in rest],
        *[F.when(own, F.col(c)).alias(c) for c in here],
    )
    work = work.withColumns({f"_before_{n}": agg.over(backward) for n, agg in aggs.items()}).where("_own")
    return work.select(
        *[F.col(c if c in by else f"_own_{c}").alias(c) for c in df.columns], *here, *[f"_before_{n}" for n in aggs]
    )


def range_window(
    df: DataFrame,
    by: Sequence[str],
    ts: str,
    aggs: dict[str, tuple[int, Column]],
    width: int = HOUR_MS,
) -> DataFrame:
    """Trailing closed range sums and counts ``[ts - span, ts]``: out -> (span, aggregate).

    An aggregate is a sum or a count of columns, whose two parts (``_two_parts``) add up. The aggregates of one span share a pass; ``width``
    is not needed, as a bucket is as long as the span.
    """
    names = df.columns
    for span in dict.fromkeys(span for span, _ in aggs.values()):
        chosen = {n: agg for n, (s, agg) in aggs.items() if s == span}
        work = _two_parts(df, by, ts, span, chosen)
        both = lambda n: F.coalesce(F.col(f"_here_{n}") + F.col(f"_before_{n}"), f"_here_{n}", f"_before_{n}")
        df = work.select(*df.columns, *[both(n).alias(n) for n in chosen])
    return df.select(*names, *aggs)


def range_spread(df: DataFrame, by: Sequence[str], ts: str, span: int, value: str, out: str) -> DataFrame:
    """Population standard deviation of ``value`` over ``[ts - span, ts]``; null without a value.

    Counts, means and variances of the two parts are joined, which loses no digits to large means.
    """
    work = _two_parts(df, by, ts, span, {"n": F.count(value), "m": F.avg(value), "v": F.var_pop(value)})
    part = lambda p, c: F.coalesce(F.col(f"_{p}_{c}"), F.lit(0.0))
    n0, n1 = part("here", "n"), part("before", "n")
    n, apart = n0 + n1, part("here", "m") - part("before", "m")
    var = (part("here", "v") * n0 + part("before", "v") * n1 + apart * apart * n0 * n1 / n) / n
    return work.select(*df.columns, F.when(n > 0, F.sqrt(var)).alias(out))


def rows_window(
    df: DataFrame,
    by: Sequence[str],
    ts: str,
    n: int,
    aggs: dict[str, Column],
    tie: Sequence[str] = (),
    width: int = HOUR_MS,
    block: int = 100_000,
    rn: str | None = None,
) -> DataFrame:
    """Aggregates over the last ``n`` rows per key.

    Rows are numbered (unless ``rn`` names a column that numbers them from 1), cut into blocks of ``block`` rows, and the last
    ``n - 1`` rows of a block are copied into the next one as context.
    """
    block = max(block, n)
    work = df if rn else numbered(df, by, ts, tie, width, rn="_rn")
    at = F.col(rn or "_rn")
    home = F.floor((at - 1) / block).cast("long")
    tail = F.pmod(at - 1, F.lit(block)) >= block - (n - 1)
    copies = F.when(tail, F.array(home, home + 1)).otherwise(F.array(home))
    work = work.withColumn("_home", home).withColumn(BUCKET, F.explode(copies))
    w = bucket_window(by).orderBy(at).rowsBetween(-(n - 1), 0)
    work = work.withColumns({name: agg.over(w) for name, agg in aggs.items()})
    return work.where(F.col(BUCKET) == F.col("_home")).drop("_home", BUCKET, *([] if rn else ["_rn"]))


def max_drawdown(
    df: DataFrame,
    by: Sequence[str],
    ts: str,
    value: Column,
    tie: Sequence[str] = (),
    width: int = DAY_MS,
    out: str = "max_drawdown",
    zero_start: bool = True,
) -> DataFrame:
    """Largest peak-to-trough fall of the running sum of ``value`` per key.

    Each bucket reduces to (sum, highest prefix, lowest prefix, own drawdown); these
    four combine across buckets without going back to the rows.
    """
    work = with_bucket(df.withColumn("_v", value.cast("double")), ts, width)
    w = (
        bucket_window(by)
        .orderBy(ts, *tie)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    work = work.withColumn("_eq", F.sum("_v").over(w))
    work = work.withColumn("_peak", F.max("_eq").over(w))
    parts = work.groupBy(*by, BUCKET).agg(
        F.sum("_v").alias("_sum"),
        F.max("_eq").alias("_hi"),
        F.min("_eq").alias("_lo"),
        F.max(F.col("_peak") - F.col("_eq")).alias("_dd"),
    )
    earlier = across(by)
    parts = parts.withColumn("_base", F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)))
    peak = F.max(F.col("_base") + F.col("_hi")).over(earlier)
    peak = F.greatest(F.lit(0.0), F.coalesce(peak, F.lit(0.0))) if zero_start else peak
    parts = parts.withColumn("_peak", peak)
    fall = F.greatest(F.col("_dd"), F.col("_peak") - (F.col("_base") + F.col("_lo")))
    return parts.groupBy(*by).agg(F.greatest(F.max(fall), F.lit(0.0)).alias(out))


def peak_level(
    df: DataFrame,
    by: Sequence[str],
    ts: str,
    change: Column,
    width: int = DAY_MS,
    out: str = "peak",
) -> DataFrame:
    """Highest running level of ``change`` after netting equal timestamps, at least 0."""
    net = df.groupBy(*by, ts).agg(F.sum(change).alias("_v"))
    work = with_bucket(net, ts, width)
    w = (
        bucket_window(by)
        .orderBy(ts)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    parts = (
        work.withColumn("_lvl", F.sum("_v").over(w))
        .groupBy(*by, BUCKET)
        .agg(F.sum("_v").alias("_sum"), F.max("_lvl").alias("_hi"))
    )
    base = F.coalesce(F.sum("_sum").over(across(by)), F.lit(0.0))
    return (
        parts.withColumn("_top", base + F.col("_hi"))
        .groupBy(*by)
        .agg(F.greatest(F.lit(0.0), F.max("_top")).alias(out))
    )
