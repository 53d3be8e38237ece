"""Seeded block bootstrap and out-of-sample headlines."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapelab.functions.decisions import splitmix64
from tapelab.functions.prices import finite
from tapelab.operators import ledger
from tapelab.session import mounted, scratch

#: Totals in a file of the stored table, draws of a task, and picks that it makes at once.
CHUNK, DRAWS_PER_TASK, PICKS = 1 << 20, 250, 1 << 20
_GAMMA = np.uint64(0x9E3779B97F4A7C15)


def dense_blocks(df: DataFrame, block: str, value: str) -> DataFrame:
    """One row per block: total of finite values and a dense index from 0.

    The index is numbered inside 4096 hash shards (the first digits of the label's md5) and shifted by the shard
    sizes, so no task sees all blocks; it depends on the block labels alone.
    """
    v = F.when(finite(F.col(value)), F.col(value)).otherwise(0.0)
    totals = df.groupBy(block).agg(F.sum(v).alias("total"))
    shard = F.substring(F.md5(F.coalesce(F.col(block).cast("string"), F.lit("")).cast("binary")), 1, 3)
    totals = totals.withColumn("_shard", shard)
    sizes = totals.groupBy("_shard").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(
        Window.partitionBy(F.lit(0)).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    )
    shift = sizes.select("_shard", F.coalesce(before, F.lit(0)).alias("_shift"))
    local = F.row_number().over(Window.partitionBy("_shard").orderBy(block)) - 1
    return (
        totals.withColumn("_i", local)
        .join(shift, "_shard")
        .select(block, "total", (F.col("_i") + F.col("_shift")).cast("long").alias("index"))
    )


def stored_totals(blocks: DataFrame) -> tuple[str, int]:
    """Writes the totals of numbered blocks as one array a ``CHUNK`` of indexes; returns the folder and the number of blocks.

    Each task writes its own files and puts them in place whole, so a repeated task changes nothing that is read.
    """
    folder = mounted(scratch(blocks.sparkSession, "totals"))
    held = F.array_sort(F.collect_list(F.struct("index", "total")))
    chunks = blocks.groupBy(F.floor(F.col("index") / CHUNK).alias("chunk")).agg(held.alias("held")).select("chunk", F.col("held.total").alias("totals"))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for part in batches:
            sizes = []
            for chunk, totals in zip(part.column("chunk").to_pylist(), part.column("totals"), strict=True):
                values = totals.values.to_numpy(zero_copy_only=False)
                own = f"{folder}/{chunk}-{uuid.uuid4().hex}"
                values.astype("<f8").tofile(own)
                os.replace(own, f"{folder}/{chunk}")
                sizes.append(len(values))
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64())], ["n"])

    return folder, chunks.mapInArrow(store, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def drawn(spark: SparkSession, folder: str, size: int, draws: int, seed: int) -> DataFrame:
    """``draw, total, picks`` over a stored table of ``size`` totals, which the tasks map into memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.memmap(f"{folder}/{c}", np.dtype("<f8"), "r") for c in range(-(-size // CHUNK))]
        starts = np.arange(len(tables) + 1, dtype=np.uint64) * np.uint64(CHUNK)
        for part in batches:
            ids = part.column("id").to_numpy()
            sums, made = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
            for k, draw in enumerate(ids.tolist()):
                for at in range(0, size, PICKS):
                    places = np.arange(draw * size + at, draw * size + min(size, at + PICKS), dtype=np.uint64)
                    with np.errstate(over="ignore"):
                        picks = splitmix64(np.uint64(seed % 2**64) + places * _GAMMA) % np.uint64(size)
                    # in order they fall into one run a file
                    picks.sort()
                    cuts = np.searchsorted(picks, starts)
                    for table, first, a, b in zip(tables, starts, cuts, cuts[1:]):
                        sums[k] += table[picks[a:b] - first].sum()
                    made[k] += len(picks)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(sums), pa.array(made)], ["draw", "total", "picks"])

    tasks = spark.range(0, draws if size else 0, 1, max(1, -(-draws // DRAWS_PER_TASK)))
    return tasks.mapInArrow(run, "draw int, total double, picks long")


def block_bootstrap(df: DataFrame, block: str, value: str, draws: int = 10_000, seed: int = 42) -> DataFrame:
    """``draw, total``: each draw takes as many whole blocks, with replacement, as exist; no blocks give no draws.

    Pick ``i`` of draw ``d`` is the output of the splitmix64 stream of ``seed`` at ``d * n + i``, modulo ``n``, so a draw
    does not depend on any other. The totals are written once, by index, to the shared folder (a mounted one), and the task
    of a range of draws maps them: every pick is made once, and neither picks nor totals are shuffled for a draw.
    """
    folder, size = stored_totals(dense_blocks(df, block, value))
    return drawn(df.sparkSession, folder, size, draws, seed).select("draw", "total")


def summarize_distribution(samples: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """n, mean, linear 2.5/50/97.5 percentiles and P(>0) of the finite samples.

    The samples are bootstrap draws: their number is a parameter, not data.
    """
    v = F.when(finite(F.col(value)), F.col(value))
    q = F.percentile(v, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    zero = F.lit(0.0)
    return samples.groupBy(*by).agg(
        F.count(v).alias("n"),
        F.coalesce(F.avg(v), zero).alias("mean"),
        F.coalesce(q[0], zero).alias("ci95_low"),
        F.coalesce(q[1], zero).alias("median"),
        F.coalesce(q[2], zero).alias("ci95_high"),
        F.coalesce(F.try_divide(F.count_if(v > 0), F.count(v)), zero).alias("p_positive"),
    )


def oos_headline(episodes: DataFrame, is_oos: Column, block: str, draws: int, seed: int) -> DataFrame:
    """One row per side (IN_SAMPLE, OUT_OF_SAMPLE); the interval belongs to OOS only."""
    rows = episodes.withColumn("side", F.when(is_oos, "OUT_OF_SAMPLE").otherwise("IN_SAMPLE"))
    filled = F.col("is_filled")
    rows = rows.withColumn("_net", ledger.historical_net(episodes))
    net = F.when(filled & finite(F.col("_net")), F.col("_net"))
    used = F.sum(F.when(filled, F.col("actual_notional_usd")))
    base = rows.groupBy("side").agg(
        F.coalesce(F.sum(net), F.lit(0.0)).alias("net_pnl_usd"),
        F.count_if(filled).alias("fills"),
        F.count_if(~filled).alias("nofills"),
        F.coalesce(F.try_divide(F.sum(net), F.count_if(filled)), F.lit(0.0)).alias("pnl_per_trade"),
        F.when(used > 0, F.sum(net) / used).alias("roi"),
        ledger.profit_factor(net).alias("profit_factor"),
        F.coalesce(F.sum(F.when(filled, F.col("capital_seconds_usd_s"))), F.lit(0.0)).alias("capital_seconds"),
    )
    dd = ledger.drawdown(rows, ["side"])
    oos = rows.where((F.col("side") == "OUT_OF_SAMPLE") & filled)
    ci = summarize_distribution(block_bootstrap(oos, block, "_net", draws, seed), "total")
    ci = ci.select(F.lit("OUT_OF_SAMPLE").alias("side"), "ci95_low", "median", "ci95_high", "p_positive")
    peak = ledger.peak_capital(rows, ["side"])
    return base.join(dd, "side", "left").join(peak, "side", "left").join(ci, "side", "left")
