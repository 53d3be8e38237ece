"""Fees, settlement, execution path and episode rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelab.functions.prices import finite


def valid_rate(x: Column) -> Column:
    return F.coalesce(finite(x) & (x >= 0) & (x < 1), F.lit(False))


def apply_fees(df: DataFrame, historical: dict, current: dict) -> DataFrame:
    """Two fee views of each episode; the historical one is the principal.

    Regimes are dicts ``maker_rate, taker_rate, maker_rebate, label``. Expects
    ``gross_pnl_usd, fill_notional, exit_notional, is_maker, no_fill``. Rebates are
    shown as upside only and never booked.
    """
    gross, fill, leave = F.col("gross_pnl_usd"), F.col("fill_notional"), F.col("exit_notional")
    total = fill + leave

    def fee(regime):
        rate = F.when(F.col("is_maker"), regime["maker_rate"]).otherwise(regime["taker_rate"])
        return total * rate

    rates = [r[k] for r in (historical, current) for k in ("maker_rate", "taker_rate", "maker_rebate")]
    rates_ok = all(0 <= x < 1 for x in rates)
    amount_ok = lambda x: F.coalesce(finite(x) & (x >= 0), F.lit(False))
    reason = (
        F.when(~F.coalesce(finite(gross), F.lit(False)), "gross_not_finite")
        .when(~amount_ok(fill), "fill_notional")
        .when(~amount_ok(leave), "exit_notional")
        .when(F.lit(not rates_ok), "fee_rate")
        .when((total == 0) & ~F.col("no_fill"), "zero_notional_filled")
        .when((total == 0) & (gross != 0), "no_fill_with_gross")
        .when((total > 0) & F.col("no_fill"), "notional_on_no_fill")
    )
    work = df.withColumn("fee_reject", reason)
    ok = F.col("fee_reject").isNull()
    rebate = total * F.lit(historical["maker_rebate"])
    hist, cur = fee(historical), fee(current)
    return work.withColumns(
        {
            "fees_usd": F.when(ok, hist),
            "rebates_usd": F.when(ok, F.lit(0.0)),
            "net_pnl_usd": F.when(ok, gross - hist),
            "pnl_historical_usd": F.when(ok, gross - hist),
            "pnl_current_usd": F.when(ok, gross - cur),
            "upside_with_rebate_usd": F.when(ok, gross - hist + rebate),
            "fee_regime": F.lit(historical["label"]),
        }
    )


def net_invariant_ok(df: DataFrame) -> Column:
    gap = F.col("gross_pnl_usd") - F.col("fees_usd") + F.col("rebates_usd") - F.col("net_pnl_usd")
    return finite(gap) & (F.abs(gap) <= 1e-9)


def _filled_reason(prefix: str = "") -> Column:
    ts, p, q = F.col(prefix + "fill_ts_ms"), F.col(prefix + "fill_price"), F.col(prefix + "fill_qty")
    return (
        F.when(ts.isNull() | p.isNull() | q.isNull(), "not_filled")
        .when(~(finite(p) & (p > 0) & (p < 1)), "fill_price")
        .when(~(finite(q) & (q > 0)), "fill_qty")
    )


def settle_resolution(df: DataFrame, payoff_win: float = 1.0) -> DataFrame:
    """Terminal payoff of a filled episode against the observed outcome.

    Expects ``side`` (BUY_YES/BUY_NO), ``yes_won``, ``resolution_ts_ms`` and the fill
    columns; a rejected row keeps null accounting and a reason.
    """
    p, q, ts = F.col("fill_price"), F.col("fill_qty"), F.col("resolution_ts_ms")
    reason = F.coalesce(
        _filled_reason(),
        F.when(ts.isNull() | F.col("yes_won").isNull(), "no_resolution"),
        F.when(ts < F.col("fill_ts_ms"), "resolution_before_fill"),
        F.when(F.lit(not 0.0 <= payoff_win <= 1.0), "payoff"),
    )
    won = F.when(F.col("side") == "BUY_YES", F.col("yes_won")).otherwise(~F.col("yes_won"))
    pay = F.when(won, F.lit(float(payoff_win))).otherwise(0.0)
    work = df.withColumn("settle_reject", reason)
    ok = F.col("settle_reject").isNull()
    return work.withColumns(
        {
            "exit_type": F.when(ok, "resolution"),
            "exit_price": F.when(ok, pay),
            "exit_ts_ms": F.when(ok, ts),
            "gross_pnl_usd": F.when(ok, q * (pay - p)),
        }
    )


def settle_hedge(entries: DataFrame, hedges: DataFrame, key: str) -> DataFrame:
    """Locks the pair's value on the entry leg; the hedge leg comes out flat."""
    cols = ("side", "order_arrival_ts_ms", "fill_ts_ms", "fill_price", "fill_qty")
    h = hedges.select(key, *[F.col(c).alias(f"hedge_{c}") for c in cols])
    df = entries.join(h, key, "left")
    late = F.greatest("fill_ts_ms", "hedge_fill_ts_ms")
    reason = F.coalesce(
        _filled_reason(),
        _filled_reason("hedge_"),
        F.when(F.col("fill_ts_ms") > F.col("hedge_fill_ts_ms"), "hedge_before_entry"),
        F.when(F.col("fill_ts_ms") < F.col("order_arrival_ts_ms"), "fill_before_arrival"),
        F.when(F.col("hedge_fill_ts_ms") < F.col("hedge_order_arrival_ts_ms"), "fill_before_arrival"),
        F.when(F.col("side") == F.col("hedge_side"), "same_side"),
        F.when(F.abs(F.col("fill_qty") - F.col("hedge_fill_qty")) > 1e-9, "quantity_mismatch"),
    )
    work = df.withColumn("hedge_reject", reason)
    ok = F.col("hedge_reject").isNull()
    exit_price = 1.0 - F.col("hedge_fill_price")
    return work.withColumns(
        {
            "exit_price": F.when(ok, exit_price),
            "exit_ts_ms": F.when(ok, late),
            "gross_pnl_usd": F.when(ok, F.col("fill_qty") * (exit_price - F.col("fill_price"))),
            "hedge_gross_pnl_usd": F.when(ok, 0.0),
            "hedge_pair_id": F.when(ok, F.concat(F.lit("hedge:"), F.col(key).cast("string"))),
        }
    )


def merge_pair(yes_cost: Column, no_cost: Column, qty: Column) -> dict[str, Column]:
    """A complete pair pays one per share."""
    ok = finite(qty) & (qty > 0) & finite(yes_cost) & finite(no_cost)
    total = yes_cost + no_cost
    return {
        "total_cost_usd": F.when(ok, total),
        "terminal_value": F.when(ok, qty),
        "locked_pnl": F.when(ok, qty - total),
    }


def should_hedge_profit(entry: Column, opposite: Column, target: Column) -> Column:
    inside = lambda x: finite(x) & (x > 0) & (x < 1)
    ok = inside(entry) & inside(opposite) & finite(target) & (target >= 0)
    return F.coalesce(ok & (entry + opposite <= 1.0 - target + 1e-12), F.lit(False))


def execution_path(entry: Column, leave: Column) -> dict[str, Column]:
    """Entry/exit liquidity class and whether it belongs to the maker headline."""
    known = entry.isin("maker", "taker") & leave.isin("maker", "taker")
    name = F.concat(F.upper(entry), F.lit("_ENTRY_"), F.upper(leave), F.lit("_EXIT"))
    path = F.when(known, name).otherwise("UNKNOWN")
    return {"execution_path": path, "is_headline": path == "MAKER_ENTRY_MAKER_EXIT"}


def resolution_filter(provenance: Column, exact_only: bool) -> Column:
    return F.coalesce(provenance == "exact", F.lit(False)) if exact_only else F.lit(True)


def validate_episodes(df: DataFrame) -> DataFrame:
    """Adds arrival, capital-seconds and the first broken rule of each episode.

    Expects ``signal_ts_ms, judge_latency_ms, submit_latency_ms, limit_price,
    stake_usd, fill_ts_ms, fill_price, fill_qty, exit_type, exit_ts_ms,
    resolution_at_ms`` and the accounting columns.
    """
    fill, leave = F.col("fill_ts_ms"), F.col("exit_ts_ms")
    p, q = F.col("fill_price"), F.col("fill_qty")
    work = df.withColumn(
        "order_arrival_ts_ms",
        F.col("signal_ts_ms") + F.col("judge_latency_ms") + F.col("submit_latency_ms"),
    )
    any_fill = fill.isNotNull() | p.isNotNull() | q.isNotNull()
    gap = F.col("gross_pnl_usd") - F.col("fees_usd") + F.col("rebates_usd") - F.col("net_pnl_usd")
    positive = lambda x: F.coalesce(finite(x) & (x > 0), F.lit(False))
    reason = (
        F.when(~positive(F.col("limit_price")), "limit_price")
        .when(~positive(F.col("stake_usd")), "stake")
        .when(any_fill & ~positive(p), "fill_price")
        .when(any_fill & ~positive(q), "fill_qty")
        .when(fill < F.col("order_arrival_ts_ms"), "fill_before_arrival")
        .when((F.col("exit_type") == "no_fill") & any_fill, "no_fill_after_fill")
        .when((F.col("exit_type") != "no_fill") & fill.isNull(), "exit_without_fill")
        .when(leave < fill, "exit_before_fill")
        .when(F.col("resolution_at_ms") < fill, "resolution_before_fill")
        .when(~F.coalesce(finite(gap) & (F.abs(gap) <= 1e-9), F.lit(False)), "net_invariant")
    )
    held = F.greatest(leave - fill, F.lit(0)) / 1000.0
    return work.withColumns(
        {
            "violation": reason,
            "capital_seconds_usd_s": F.coalesce(F.col("stake_usd") * held, F.lit(0.0)),
        }
    )
