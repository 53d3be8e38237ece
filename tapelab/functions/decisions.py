"""Quote decisions, sizing and latency."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapelab.functions.prices import candidate_micros, finite

# Default gate thresholds.
THRESHOLDS = {
    "under_min": 0.75, "next_up_min": 0.65, "persist_min": 0.60, "fill_min": 0.60,
    "toxic_max": 0.30, "conflict_max": 0.30, "no_pressure_max": 0.30,
}
# Answer column each threshold bounds, and whether it is a minimum.
GATES = (
    ("under_min", "underreact_up", True), ("next_up_min", "p_up", True),
    ("persist_min", "move_persists", True), ("fill_min", "fill_before_decay", True),
    ("toxic_max", "fill_toxic", False), ("conflict_max", "underreact_down", False),
    ("no_pressure_max", "no_pressure_5s", False),
)


def passes_gate(thresholds: dict | Column | None = None) -> Column:
    """All seven strict comparisons; a null answer fails.

    ``thresholds`` is a dict of numbers or a struct column with the same fields.
    """
    t = thresholds if thresholds is not None else THRESHOLDS
    out = F.lit(True)
    for name, answer, is_min in GATES:
        cut = F.lit(t[name]) if isinstance(t, dict) else t.getField(name)
        out = out & ((F.col(answer) > cut) if is_min else (F.col(answer) < cut))
    return F.coalesce(out, F.lit(False))


def decide(df: DataFrame, thresholds: dict | None = None) -> DataFrame:
    """QUOTE or SKIP with the first reason that applies.

    Expects ``size, book_stale, bid_micros, ask_micros, tick_micros`` and the answers.
    """
    bid, ask, tick = F.col("bid_micros"), F.col("ask_micros"), F.col("tick_micros")
    price = candidate_micros(bid, ask, tick)
    reason = (
        F.when(F.col("size") <= 0, "size_zero")
        .when(F.col("book_stale"), "stale_book")
        .when(bid.isNull(), "missing_bid")
        .when(ask.isNull(), "missing_ask")
        .when(price.isNull(), "invalid_candidate")
        .when(~passes_gate(thresholds), "strategy_rejected")
    )
    work = df.withColumn("skip_reason", reason)
    quote = F.col("skip_reason").isNull()
    return work.withColumns(
        {
            "decision": F.when(quote, "QUOTE").otherwise("SKIP"),
            "quote_micros": F.when(quote, price),
        }
    )


def risk_block(killed: Column, stale: Column, outstanding: Column, limit, latency: Column, max_latency) -> Column:
    return (
        F.when(killed, "killed")
        .when(stale, "stale_book")
        .when(outstanding >= limit, "too_many_outstanding_quotes")
        .when(latency > max_latency, "latency_exceeded")
    )


def _sized(df: DataFrame, raw: Column, share_qty: Column, tick: float, step: float, min_size: float,
           first_reason: Column, stake: Column | None) -> DataFrame:
    price = F.floor(raw / tick + 0.5) * tick
    work = df.withColumns({"_bad": first_reason, "_p": price})
    shares = F.floor((stake / F.col("_p") if stake is not None else share_qty) / step) * step
    work = work.withColumn("_s", F.when((F.col("_p") > 0) & (F.col("_p") < 1), shares))
    reason = F.coalesce(
        F.col("_bad"),
        F.when(~finite(raw) | (raw <= 0) | (raw >= 1) | raw.isNull(), "price_range"),
        F.when((F.col("_p") <= 0) | (F.col("_p") >= 1), "rounded_price_range"),
        F.when(F.col("_s").isNull() | (F.col("_s") <= 0), "no_shares"),
        F.when(F.col("_s") < min_size, "below_min_size"),
    )
    work = work.withColumn("size_reject", reason)
    ok = F.col("size_reject").isNull()
    intended = stake if stake is not None else share_qty * F.col("_p")
    return work.withColumns(
        {
            "limit_price": F.when(ok, F.col("_p")),
            "shares": F.when(ok, F.col("_s")),
            "intended_stake_usd": F.when(ok, intended),
            "actual_notional_usd": F.when(ok, F.col("_s") * F.col("_p")),
            "rounding_delta_usd": F.when(ok, intended - F.col("_s") * F.col("_p")),
        }
    ).drop("_bad", "_p", "_s")


def size_entry(df: DataFrame, price: str, stake: str, tick: float, step: float, min_size: float) -> DataFrame:
    """Price half-up to the tick, shares down to the step; rejects carry a reason."""
    s = F.col(stake)
    bad = F.when(~F.coalesce(finite(s) & (s > 0), F.lit(False)), "stake")
    raw = F.col(price)
    price_bad = F.when(~F.coalesce(finite(raw) & (raw > 0) & (raw < 1), F.lit(False)), "price_range")
    return _sized(df, raw, s, tick, step, min_size, F.coalesce(price_bad, bad), s)


def size_hedge(df: DataFrame, shares: str, price: str, tick: float, step: float, min_size: float) -> DataFrame:
    """The entry's shares at the opposite price; the hedge is not resized to a stake."""
    q = F.col(shares)
    bad = F.when(~F.coalesce(finite(q) & (q > 0), F.lit(False)), "entry_shares")
    return _sized(df, F.col(price), q, tick, step, min_size, bad, None)


def splitmix64(x: np.ndarray) -> np.ndarray:
    """The published splitmix64 mix of ``x + golden gamma``, wrapping in 64 bits."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def splitmix_index(seed: int):
    """UDF ``(sequence, n) -> splitmix64(seed + sequence) mod n``."""

    @F.pandas_udf(T.LongType())
    def pick(seq: pd.Series, n: pd.Series) -> pd.Series:
        base = np.uint64(seed % 2**64)
        with np.errstate(over="ignore"):
            mixed = splitmix64(seq.to_numpy().astype(np.uint64) + base)
        return pd.Series((mixed % n.to_numpy().astype(np.uint64)).astype(np.int64))

    return pick


def sample_latency(seq: Column, samples: list[int], seed: int, exact: bool = True) -> Column:
    """Observed latency picked by hashing ``seed + sequence``; no global random state."""
    if not samples or min(samples) <= 0:
        raise ValueError("latency samples must be positive")
    values = F.array(*[F.lit(int(s)).cast("long") for s in samples])
    n = len(samples)
    if exact:
        index = splitmix_index(seed)(seq.cast("long"), F.lit(n).cast("long"))
    else:
        index = F.pmod(F.xxhash64(seq + F.lit(seed)), F.lit(n))
    return F.get(values, index.cast("int"))


def hold(quantity: Column, thresholds: dict = THRESHOLDS) -> Column:
    return (
        (quantity > 0)
        & (F.col("move_persists") >= thresholds["persist_min"])
        & (F.col("fill_toxic") < thresholds["toxic_max"])
    )


def cancel(active: Column, expires_ms: Column, now_ms: Column, thresholds: dict = THRESHOLDS) -> Column:
    return active & (
        (now_ms >= expires_ms)
        | ~passes_gate(thresholds)
        | (F.col("fill_toxic") >= thresholds["toxic_max"])
    )


def exit_now(quantity, opened_ms, now_ms, entry, mark, p_down, levels: dict) -> Column:
    """Time, toxicity, downward probability or price level closes a position."""
    timed = (
        (now_ms - opened_ms >= levels["max_hold_ms"]) if levels["max_hold_ms"] > 0 else F.lit(False)
    )
    move = (mark - entry) * 100.0
    level = (move <= -levels["stop_loss_pp"]) | (move >= levels["take_profit_pp"])
    out = (
        timed
        | (F.col("fill_toxic") >= levels["toxicity_exit_min"])
        | (p_down >= levels["down_probability_exit_min"])
        | F.coalesce(level, F.lit(False))
    )
    return (quantity > 0) & out
