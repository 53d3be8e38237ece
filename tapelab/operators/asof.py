"""As-of joins, interpolation and event merging.

Every as-of join here is a union of both sides and one sort inside (key, time bucket);
what a bucket inherits from others is looked up in a table of one row per bucket that has rows. No range
condition is ever joined and a hot key is spread over its buckets (see ``scan``).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapelab.operators import scan


def edges(cells: DataFrame, right: DataFrame, by: Sequence[str], prev: bool, nxt: bool) -> DataFrame:
    """What each bucket inherits from the right rows of other buckets: ``_cprev`` and ``_cnext``.

    ``cells`` has the (key, bucket) of every left row, ``right`` the right rows. Both shrink to one row per (key, bucket) before
    the shuffle, and the values are filled along each key's buckets, so the table has at most as many rows as the two sides have
    buckets, however far these lie apart.
    """
    order = F.when(F.col("_v").isNotNull(), F.struct("_t", "_tie"))
    aggs = [F.max_by("_v", order).alias("_hi")] if prev else []
    aggs += [F.min_by("_v", order).alias("_lo")] if nxt else []
    narrow = right.select(*by, scan.BUCKET, "_t", "_tie", "_v")
    summary = narrow.unionByName(cells, allowMissingColumns=True).groupBy(*by, scan.BUCKET).agg(*aggs)
    out = []
    if prev:
        out.append(scan.last_value(F.col("_hi")).over(scan.across(by)).alias("_cprev"))
    if nxt:
        out.append(scan.last_value(F.col("_lo")).over(scan.across(by, descending=True)).alias("_cnext"))
    return summary.select(*by, scan.BUCKET, *out)


def neighbours(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str,
    by: Sequence[str],
    cols: Sequence[str],
    tie: str | None = None,
    equal_to: str = "prev",
    want: Sequence[str] = ("prev",),
    width: int = scan.HOUR_MS,
    cells: DataFrame | None = None,
) -> DataFrame:
    """Left rows plus ``_prev`` and/or ``_next`` structs of the nearest right rows.

    ``equal_to`` says which neighbour a right row at exactly the left time belongs
    to. Each struct holds ``cols`` and ``_ts``. Among right rows of one time, ``_prev``
    takes the last and ``_next`` the first in ``tie`` order.

    The rows of the left side are read once; besides, its (key, time) columns alone are read to list its buckets. Where the left side is
    costly, ``cells`` names a cheaper table with the same columns that holds at least these keys and times.
    """
    by = list(by)
    prev, nxt = "prev" in want, "next" in want
    payload = F.struct(*[F.col(c) for c in cols], F.col(right_on).alias("_ts"))
    seq = F.col(tie).cast("long") if tie else F.lit(0).cast("long")
    right_side = 0 if equal_to == "prev" else 1
    lrows = left.select(
        F.struct(*left.columns).alias("_l"),
        *by,
        F.col(left_on).cast("long").alias("_t"),
        F.lit(1 - right_side).alias("_side"),
        F.lit(None).cast("long").alias("_tie"),
    )
    rrows = right.select(
        *by,
        F.col(right_on).cast("long").alias("_t"),
        F.lit(right_side).alias("_side"),
        seq.alias("_tie"),
        payload.alias("_v"),
    )
    rrows = scan.with_bucket(rrows, "_t", width)
    rows = scan.with_bucket(lrows, "_t", width).unionByName(rrows, allowMissingColumns=True)
    local = {}
    frame = (Window.unboundedPreceding, Window.currentRow)
    if prev:
        w = scan.bucket_window(by).orderBy("_t", "_side", "_tie").rowsBetween(*frame)
        local["_lprev"] = scan.last_value(F.col("_v")).over(w)
    if nxt:
        w = (
            scan.bucket_window(by)
            .orderBy(F.col("_t").desc(), F.col("_side").desc(), F.col("_tie").desc())
            .rowsBetween(*frame)
        )
        local["_lnext"] = scan.last_value(F.col("_v")).over(w)
    listed = (left if cells is None else cells).select(*by, scan.bucket_of(F.col(left_on).cast("long"), width).alias(scan.BUCKET))
    carried = edges(listed, rrows, by, prev, nxt)
    rows = rows.withColumns(local).where(F.col("_l").isNotNull()).drop("_v", "_side", "_tie")
    rows = scan.join_carry(rows, carried, by)
    out = [F.col(f"_l.`{c}`").alias(c) for c in left.columns]
    if prev:
        out.append(F.coalesce(F.col("_lprev"), F.col("_cprev")).alias("_prev"))
    if nxt:
        out.append(F.coalesce(F.col("_lnext"), F.col("_cnext")).alias("_next"))
    return rows.select(*out)


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    on: str,
    by: Sequence[str],
    cols: Sequence[str],
    right_on: str | None = None,
    tie: str | None = None,
    tolerance: int | None = None,
    allow_equal: bool = True,
    matched_ts: str | None = None,
    width: int = scan.HOUR_MS,
    cells: DataFrame | None = None,
) -> DataFrame:
    """Newest right row with ``ts <= t`` (``< t`` if not ``allow_equal``), else nulls."""
    got = neighbours(
        left, right, on, right_on or on, by, cols, tie,
        "prev" if allow_equal else "next", ("prev",), width, cells,
    )
    return _unpack(got, left, "_prev", on, cols, tolerance, matched_ts)


def asof_forward(
    left: DataFrame,
    right: DataFrame,
    on: str,
    by: Sequence[str],
    cols: Sequence[str],
    right_on: str | None = None,
    tie: str | None = None,
    tolerance: int | None = None,
    matched_ts: str | None = None,
    width: int = scan.HOUR_MS,
    cells: DataFrame | None = None,
) -> DataFrame:
    """Oldest right row with ``ts >= t``; the first row of a time wins."""
    got = neighbours(
        left, right, on, right_on or on, by, cols, tie, "next", ("next",), width, cells
    )
    return _unpack(got, left, "_next", on, cols, tolerance, matched_ts)


def _unpack(got, left, struct, on, cols, tolerance, matched_ts) -> DataFrame:
    hit = F.col(struct).isNotNull()
    if tolerance is not None:
        hit = hit & (F.abs(F.col(on) - F.col(f"{struct}._ts")) <= F.lit(tolerance))
    out = [F.when(hit, F.col(f"{struct}.`{c}`")).alias(c) for c in cols]
    if matched_ts:
        out.append(F.when(hit, F.col(f"{struct}._ts")).alias(matched_ts))
    return got.select(*left.columns, *out)


def _targets(left: DataFrame, on: str, by: Sequence[str], ids: Sequence[str], offsets: dict[str, int]) -> DataFrame:
    """One row per offset; the left row itself travels with the first offset only."""
    row = F.struct(*left.columns)
    none = F.lit(None).cast(left.select(row.alias("_r")).schema["_r"].dataType)
    entries = [
        F.struct(
            F.lit(n).alias("_h"),
            (F.col(on) + F.lit(ms)).alias("_target"),
            (row if i == 0 else none).alias("_row"),
        )
        for i, (n, ms) in enumerate(offsets.items())
    ]
    need = list(dict.fromkeys([*ids, *by]))
    long = left.select(*need, F.explode(F.array(*entries)).alias("_x"))
    return long.select(*need, "_x._h", "_x._target", "_x._row")


def _fold(got: DataFrame, ids: Sequence[str], columns: Sequence[str], offsets: dict[str, int]) -> DataFrame:
    """Back to one row per id: the left row and one value column per offset."""
    wide = got.groupBy(*[F.col(i).alias(f"_id{n}") for n, i in enumerate(ids)]).agg(
        F.first("_row", ignorenulls=True).alias("_row"),
        *[F.max(F.when(F.col("_h") == n, F.col("_value"))).alias(f"_v{i}") for i, n in enumerate(offsets)],
    )
    return wide.select(
        *[F.col(f"_row.`{c}`").alias(c) for c in columns],
        *[F.col(f"_v{i}").alias(n) for i, n in enumerate(offsets)],
    )


def _per_offset(
    left: DataFrame,
    right: DataFrame,
    on: str,
    by: Sequence[str],
    ids: Sequence[str],
    value: str,
    offsets: dict[str, int],
    forward: bool,
    right_on: str | None,
    tie: str | None,
    width: int,
) -> DataFrame:
    """One as-of pass for all offsets, folded back by ``ids`` (unique in ``left``)."""
    joiner = asof_forward if forward else asof_backward
    got = joiner(
        _targets(left, on, by, ids, offsets), right.withColumnRenamed(value, "_value"), "_target", by,
        ["_value"], right_on=right_on or on, tie=tie, width=width,
    )
    return _fold(got, ids, left.columns, offsets)


def forward_labels(
    left, right, on, by, ids, value, horizons: dict[str, int], right_on=None, tie=None,
    width: int = scan.HOUR_MS,
) -> DataFrame:
    """First value at or after ``t + h`` for every horizon; null when never observed."""
    return _per_offset(
        left, right, on, by, ids, value, horizons, True, right_on, tie, width
    )


def lag_asof(
    left, right, on, by, ids, value, lags: dict[str, int], right_on=None, tie=None,
    width: int = scan.HOUR_MS,
) -> DataFrame:
    """Last value known at ``t - lag`` for every lag."""
    back = {n: -ms for n, ms in lags.items()}
    return _per_offset(left, right, on, by, ids, value, back, False, right_on, tie, width)


def interpolated_offsets(
    left: DataFrame,
    ticks: DataFrame,
    on: str,
    by: Sequence[str],
    ids: Sequence[str],
    price: str,
    offsets: dict[str, int],
    tick_on: str | None = None,
    tie: str | None = None,
    width: int = scan.HOUR_MS,
) -> DataFrame:
    """Interpolated price at ``t + offset`` for every offset, in one pass."""
    got = interpolate(
        _targets(left, on, by, ids, offsets), ticks, "_target", by, price, tick_on=tick_on or on, tie=tie,
        out="_value", width=width,
    )
    return _fold(got, ids, left.columns, offsets)


def lag_exact(
    df: DataFrame, on: str, by: Sequence[str], value: str, lags: dict[str, int], width: int = scan.DAY_MS
) -> DataFrame:
    """Value exactly ``lag`` earlier (the highest of equal times); ``incomplete_reason`` names a missing lag.

    Rows are dealt by key and time bucket, and those that a row of the next bucket may look back to are copied into it: one
    shuffle and one sort for all lags, and nothing is joined. A bucket is ``width`` wide, or four times the longest lag.
    """
    keys, size = list(by), max(width, 4 * max(lags.values()))
    home = scan.bucket_of(F.col(on), size)
    near_end = F.col(on) + max(lags.values()) >= (home + 1) * size
    copies = F.when(near_end, F.array(home, home + 1)).otherwise(F.array(home))
    work = df.withColumn("_home", home).withColumn(scan.BUCKET, F.explode(copies))
    rows = scan.bucket_window(keys).orderBy(on)
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*keys, on)])
    work = work.withColumns({n: F.when(known, F.max(value).over(rows.rangeBetween(-ms, -ms))) for n, ms in lags.items()})
    out = work.where(F.col(scan.BUCKET).eqNullSafe(F.col("_home"))).drop("_home", scan.BUCKET)
    missing = F.when(F.col(value).isNull(), F.lit("null_quote"))
    complete = reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in lags])
    return out.withColumn(
        "incomplete_reason", missing.when(~complete, F.lit("short_history"))
    )


def interpolate(
    targets: DataFrame,
    ticks: DataFrame,
    on: str,
    by: Sequence[str],
    price: str,
    tick_on: str | None = None,
    tie: str | None = None,
    out: str = "price_at",
    width: int = scan.HOUR_MS,
) -> DataFrame:
    """Exact hit, else linear between the two neighbours, else null (no extrapolation)."""
    got = neighbours(
        targets, ticks, on, tick_on or on, by, [price], tie, "next", ("prev", "next"), width
    )
    p0, t0 = F.col(f"_prev.`{price}`"), F.col("_prev._ts")
    p1, t1 = F.col(f"_next.`{price}`"), F.col("_next._ts")
    share = (F.col(on) - t0) / (t1 - t0)
    value = F.when(t1 == F.col(on), _positive(p1)).when(
        t0.isNotNull() & t1.isNotNull(),
        _positive(p0) + (_positive(p1) - _positive(p0)) * share,
    )
    return got.select(*targets.columns, value.alias(out))


def _positive(p: Column) -> Column:
    return F.when((p > 0) & (p < F.lit(float("inf"))), p)


def asof_regime(
    rows: DataFrame, regimes: DataFrame, ts: str, asset: str, width: int = 400 * scan.DAY_MS
) -> DataFrame:
    """Regime of the newest regime day at or before the row's UTC day, by symbol prefix.

    A symbol serves every asset it starts with: its prefixes are listed, which leaves an
    equality on the asset.
    """
    length = F.length("symbol")
    prefixes = F.transform(F.sequence(F.lit(0), length), lambda i: F.substring(F.col("symbol"), F.lit(1), i))
    label = F.concat_ws("-", "vol_regime", "trend_regime")
    right = (
        regimes.withColumn("_a", F.explode(prefixes))
        .groupBy(F.col("_a").alias(asset), (F.col("day_ts") * 1000).alias("_day"))
        .agg(F.max_by(label, F.col("symbol")).alias("regime"))
    )
    day = F.col(ts) - F.pmod(F.col(ts), F.lit(scan.DAY_MS))
    left = rows.withColumn("_day", day)
    got = asof_backward(left, right, "_day", [asset], ["regime"], width=width)
    return got.withColumn(
        "regime", F.coalesce("regime", F.lit("UNKNOWN-UNKNOWN"))
    ).drop("_day")


def merge_events(frames: dict[str, DataFrame], ts: str, seq: str) -> DataFrame:
    """One ordered event log: by time, then by the order of ``frames``, then by ``seq``."""
    tagged = [
        df.withColumns({"kind": F.lit(kind), "rank": F.lit(i)})
        for i, (kind, df) in enumerate(frames.items())
    ]
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return merged.orderBy(ts, "rank", seq)


def anchor_price(
    markets: DataFrame,
    ticks: DataFrame,
    start: str,
    by: Sequence[str],
    price: str,
    tick_on: str,
    tie: str | None = None,
    width: int = scan.HOUR_MS,
) -> DataFrame:
    """Price of the first tick at or after the start, else of the key's earliest tick."""
    got = asof_forward(
        markets, ticks, start, by, [price], right_on=tick_on, tie=tie, width=width
    )
    order = F.struct(tick_on, tie) if tie else F.col(tick_on)
    first = ticks.groupBy(*by).agg(F.min_by(price, order).alias("_first"))
    return got.join(first, list(by), "left").select(
        *markets.columns,
        F.coalesce(price, "_first").alias("anchor"),
        F.when(F.col(price).isNotNull(), F.lit("at_or_after_start"))
        .when(F.col("_first").isNotNull(), F.lit("earliest_loaded"))
        .alias("anchor_rule"),
    )
