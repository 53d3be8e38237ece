"""Resting orders against later prints, without pairing orders with prints.

The prints of a market are numbered in time order and cut into blocks of ``BLOCK``. A block keeps two things: its prints as one
short array, and for every price level that has orders how much volume the block adds there, from one running sum along the price
axis. Running sums of these over the blocks answer for all whole blocks; a reading in the middle of a block adds what it
finds in the block's array. So a print makes two rows along the price axis, a block one row per order level, and an order reads
two blocks, and the block in which the sum passes what it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapelab.functions.prices import finite
from tapelab.operators import asof, scan
from tapelab.session import settle

# Share of volume assumed queued ahead, per fill profile.
QUEUE_AHEAD = {"OPTIMISTIC": 0.0, "BASE": 0.3, "CONSERVATIVE": 0.6}
LOT = 1_000_000
#: Prints in a block.
BLOCK = 64
#: Blocks that are summed together.
WIDTH = 4096
KEYS = ("market", "side_buy", "level")


def numbered_prints(prints: DataFrame, width: int = scan.HOUR_MS) -> DataFrame:
    """Usable prints, one row per (market, time, price, aggressor), with ``rn`` from 1 in time order and the block."""
    qty = F.when(finite(F.col("qty")) & (F.col("qty") > 0), F.col("qty"))
    merged = (
        prints.where(qty.isNotNull())
        .groupBy("market", "ts_ms", F.col("level").alias("p"), "aggressor")
        .agg(F.sum("qty").alias("q"), F.count(F.lit(1)).alias("n"))
    )
    got = scan.numbered(merged, ["market"], "ts_ms", ("p", "aggressor"), width, rn="rn")
    return got.withColumn("block", F.expr(f"(rn - 1) div {BLOCK}"))


def _weight(buy: Column, aggressor: Column) -> Column:
    """Part of a print that meets resting orders of one side: all of the other side's aggression, half if unknown."""
    return (
        F.when(aggressor == "UNKNOWN", 0.5).when(buy & (aggressor == "SELL"), 1.0).when(~buy & (aggressor == "BUY"), 1.0)
    )


def block_sums(orders: DataFrame, numbered: DataFrame) -> DataFrame:
    """Per order level and block: volume, through prints and last print of the block, and the sums to its end.

    A print through the level counts whole, one at the level half. Along the price axis the better prices come first.
    """
    toward = lambda price: F.when(F.col("side_buy"), F.col(price)).otherwise(-F.col(price))
    sides = numbered.withColumn("side_buy", F.explode(F.array(F.lit(True), F.lit(False))))
    sides = sides.withColumn("_w", _weight(F.col("side_buy"), F.col("aggressor"))).where(F.col("_w").isNotNull())
    added = sides.groupBy("market", "side_buy", "block", toward("p").alias("_x")).agg(
        F.sum(F.col("q") * F.col("_w")).alias("_v"), F.sum("n").alias("_n"), F.max("ts_ms").alias("_ts")
    )
    levels = orders.groupBy("market").agg(F.collect_set(F.struct("side_buy", "level")).alias("_levels"))
    marks = numbered.select("market", "block").distinct().join(levels, "market").select("market", "block", F.inline("_levels"))
    marks = marks.select("market", "side_buy", "block", toward("level").alias("_x"), "level")
    axis = Window.partitionBy("market", "side_buy", "block").orderBy("_x")
    through, here = axis.rangeBetween(Window.unboundedPreceding, -1), axis.rangeBetween(0, 0)
    zero = lambda c: F.coalesce(c, F.lit(0))
    both = added.unionByName(marks, allowMissingColumns=True).withColumns(
        {
            "vol": zero(F.sum("_v").over(through)) + 0.5 * zero(F.sum("_v").over(here)),
            "thr": zero(F.sum("_n").over(through)),
            "last": F.max("_ts").over(axis.rangeBetween(Window.unboundedPreceding, 0)),
        }
    )
    sums = {"cum_vol": scan.total(F.col("vol")), "cum_thr": scan.total(F.col("thr")), "last_ms": scan.highest(F.col("last"))}
    rows = both.where(F.col("level").isNotNull()).select(*KEYS, "block", "vol", "thr", "last")
    return scan.ordered(rows, KEYS, "block", sums, width=WIDTH)


def block_prints(numbered: DataFrame) -> DataFrame:
    """The prints of each block as one array in time order, ``BLOCK`` at most."""
    return numbered.groupBy("market", "block").agg(F.sort_array(F.collect_list(F.struct("rn", "ts_ms", "p", "aggressor", "q", "n"))).alias("prints"))


def _meets(x: Column) -> tuple[Column, Column, Column]:
    """Volume and through prints that a print brings to an order of this row, and whether it counts at all."""
    buy, level = F.col("side_buy"), F.col("level")
    better = F.when(buy, x["p"] < level).otherwise(x["p"] > level)
    weight = F.coalesce(_weight(buy, x["aggressor"]), F.lit(0.0))
    counts = (weight > 0) & (better | (x["p"] == level))
    vol = F.when(counts, x["q"] * weight * F.when(better, 1.0).otherwise(0.5)).otherwise(0.0)
    return vol, F.when(counts & better, x["n"]).otherwise(F.lit(0).cast("long")), counts


def _lots(volume: Column) -> Column:
    return F.round(volume * LOT).cast("long")


def _read(orders: DataFrame, numbered: DataFrame, sums: DataFrame, arrays: DataFrame, width: int) -> DataFrame:
    """Running volume, through prints and last print of each order's level at two times: before arrival (k = 0) and at its end."""
    times = F.array(
        F.struct(F.lit(0).alias("_k"), (F.col("arrival_ms") - 1).alias("_at")), F.struct(F.lit(1).alias("_k"), F.col("end_ms").alias("_at"))
    )
    asked = orders.select("order_id", *KEYS, F.explode(times).alias("_x")).select("order_id", *KEYS, "_x.*")
    got = asof.asof_backward(asked, numbered.select("market", "ts_ms", "rn"), "_at", ["market"], ["rn"], right_on="ts_ms", tie="rn", width=width)
    got = got.withColumns({"rn": F.coalesce("rn", F.lit(0)), "block": F.expr(f"coalesce(rn, 0) div {BLOCK}")})
    whole = sums.select(*KEYS, (F.col("block") + 1).alias("block"), "cum_vol", "cum_thr", "last_ms")
    got = got.join(whole, [*KEYS, "block"], "left").join(arrays, ["market", "block"], "left")

    def add(done: Column, x: Column) -> Column:
        vol, thr, counts = _meets(x)
        return F.struct((done["v"] + vol).alias("v"), (done["n"] + thr).alias("n"), F.when(counts, x["ts_ms"]).otherwise(done["t"]).alias("t"))

    zero = F.struct(F.lit(0.0).alias("v"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("t"))
    part = F.filter(F.coalesce("prints", F.array().cast(arrays.schema["prints"].dataType)), lambda x: x["rn"] <= F.col("rn"))
    got = got.withColumn("_p", F.aggregate(part, zero, add))
    return got.select(
        "order_id", "_k", _lots(F.coalesce("cum_vol", F.lit(0.0)) + F.col("_p.v")).alias("v"),
        (F.coalesce("cum_thr", F.lit(0.0)).cast("long") + F.col("_p.n")).alias("n"), F.coalesce("_p.t", "last_ms").alias("t"),
    )


def _tables(orders: DataFrame, prints: DataFrame, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Numbered prints, block sums and block arrays. The first two have several readers and are written once: a row per print, and one
    per block and order level."""
    numbered = settle(numbered_prints(prints, width), "prints")
    return numbered, settle(block_sums(orders, numbered), "blocks"), block_prints(numbered)


def _evidence(orders: DataFrame, numbered: DataFrame, sums: DataFrame, arrays: DataFrame, width: int) -> DataFrame:
    pick = lambda k, c: F.max(F.when(F.col("_k") == k, F.col(c)))
    wide = _read(orders, numbered, sums, arrays, width).groupBy("order_id").agg(
        pick(0, "v").alias("base_vol"), pick(0, "n").alias("base_thr"), pick(1, "v").alias("_v"), pick(1, "n").alias("_n"), pick(1, "t").alias("_t")
    )
    return orders.join(wide, "order_id", "left").withColumns(
        {
            "evidence_qty": (F.col("_v") - F.col("base_vol")) / LOT,
            "through_prints": F.col("_n") - F.col("base_thr"),
            "last_print_ms": F.when(F.col("_v") > F.col("base_vol"), F.col("_t")),
        }
    ).drop("_v", "_n", "_t")


def order_evidence(orders: DataFrame, prints: DataFrame, width: int = scan.HOUR_MS) -> DataFrame:
    """Per order: weighted volume, through prints and last print in [arrival, end]."""
    return _evidence(orders, *_tables(orders, prints, width), width)


def _passed(
    orders: DataFrame, sums: DataFrame, arrays: DataFrame, need: str, volume: bool, width: int, out: str, cells: DataFrame | None = None
) -> DataFrame:
    """Adds the time at which an order's running sum reaches ``need``: the block by an as-of join on the sums, then the print in it.

    ``volume`` says which sum: of volume, in lots, or of through prints. ``cells`` is a cheaper table with the keys and needs of the orders.
    """
    total = _lots(F.col("cum_vol")) if volume else F.col("cum_thr").cast("long")
    before = F.col("cum_vol") - F.col("vol") if volume else F.col("cum_thr") - F.col("thr")
    ends = sums.select(*KEYS, total.alias("_sum"), before.cast("double").alias("_before"), F.col("block").alias("_block"))
    got = asof.asof_forward(orders, ends, need, KEYS, ["_block", "_before"], right_on="_sum", tie="_block", width=width, cells=cells)
    got = got.join(arrays.withColumnsRenamed({"market": "_m", "block": "_b"}), (F.col("market") == F.col("_m")) & (F.col("_block") == F.col("_b")), "left")

    def step(done: Column, x: Column) -> Column:
        vol, thr, _ = _meets(x)
        now = done["s"] + (vol if volume else thr.cast("double"))
        reached = (_lots(now) if volume else now.cast("long")) >= F.col(need)
        return F.struct(now.alias("s"), F.coalesce(done["t"], F.when(reached, x["ts_ms"])).alias("t"))

    zero = F.struct(F.coalesce("_before", F.lit(0.0)).alias("s"), F.lit(None).cast("long").alias("t"))
    return got.withColumn(out, F.aggregate("prints", zero, step)["t"]).drop("_block", "_before", "_m", "_b", "prints")


def fill_labels(
    orders: DataFrame, prints: DataFrame, profile: str = "BASE", queue_ahead: float | None = None,
    through_multiple: float = 2.0, width: int = scan.HOUR_MS, volume_width: int = 10_000 * LOT,
) -> DataFrame:
    """Filled flag, fraction and completing print time of each resting order."""
    queue = QUEUE_AHEAD[profile] if queue_ahead is None else min(max(queue_ahead, 0.0), 1.0)
    numbered, sums, arrays = _tables(orders, prints, width)
    # Read for the evidence and for each time that is looked up.
    arrays = settle(arrays, "arrays")
    ev = _evidence(orders, numbered, sums, arrays, width)
    size = F.when(finite(F.col("size")) & (F.col("size") > 0), F.col("size"))
    share = 1.0 - queue
    effective = F.col("evidence_qty") * share
    small = 1e-9
    if profile == "CONSERVATIVE":
        full, half = size * through_multiple, size * through_multiple * 0.25
        enough = F.col("through_prints") >= 2
        want = F.when(enough & (effective >= full - small), 1.0).when(enough & (effective >= half - small), 0.5)
        threshold = F.when(F.col("_want") == 1.0, full).otherwise(half)
        complete = F.col("_want").isNotNull()
    else:
        want = F.when(effective > 0, 1.0)
        threshold = size
        complete = effective >= size - small
    work = ev.withColumns({"_eff": effective, "_want": want})
    qty = F.least(size * F.col("_want"), F.col("_eff"))
    work = work.withColumns(
        {
            "fill_qty": F.when((F.col("_eff") > 0) & size.isNotNull() & F.col("_want").isNotNull(), qty).otherwise(0.0),
            "_complete": F.coalesce(complete, F.lit(False)),
            "_need": F.col("base_vol") + F.ceil(F.round(threshold / max(share, 1e-12) * LOT, 2) - 0.01).cast("long"),
        }
    )
    # Orders that never complete look nothing up: their target is null.
    work = work.withColumns({c: F.when(F.col("_complete"), v) for c, v in (("_need", F.col("_need")), ("_two", F.col("base_thr") + 2))})
    # An as-of join reads the keys of its left side a second time: the evidence is written once.
    work = settle(work, "evidence")
    out = _passed(work, sums, arrays, "_need", True, volume_width, "_vts")
    done: Column = F.col("_vts")
    if profile == "CONSERVATIVE":
        out = _passed(out, sums, arrays, "_two", False, 100_000, "_tts", cells=work)
        done = F.greatest("_vts", "_tts")
    out = out.withColumn("_done", done)
    filled = F.col("fill_qty") > 0
    return out.select(
        *orders.columns,
        filled.alias("filled"),
        F.when(filled, F.least(F.col("fill_qty") / F.col("size"), F.lit(1.0))).otherwise(0.0).alias("fill_fraction"),
        "fill_qty",
        F.when(filled, F.when(F.col("_complete"), F.col("_done")).otherwise(F.col("last_print_ms"))).alias("fill_ts_ms"),
        F.lit(profile).alias("fill_profile"),
    )
