"""Episode economics, capital, drawdown and portfolio state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelab.functions.prices import finite
from tapelab.operators import scan
from tapelab.operators.scan import DAY_MS

ROI_FLOOR = 1e-9
HOLD_EXITS = ("resolution", "sell", "stop")


def exit_class(exit_type: Column) -> Column:
    return F.when(exit_type == "hedge", "hedge").when(exit_type == "no_fill", "no_fill").otherwise("hold")


def historical_net(df: DataFrame) -> Column:
    """The PnL at the fees of its time; rows (or tables) without it have their net PnL."""
    net = F.col("net_pnl_usd")
    return F.coalesce("pnl_historical_usd", net) if "pnl_historical_usd" in df.columns else net


def breakdown_key(df: DataFrame) -> Column:
    """``asset|horizon|regime|strategy|profile|exit class``; missing parts read unknown."""
    return F.concat_ws(
        "|", "asset", "horizon", F.coalesce("regime", F.lit("unknown")), "strategy_version",
        F.coalesce("fill_profile", F.lit("unknown")), exit_class(F.col("exit_type")),
    )


def profit_factor(value: Column) -> Column:
    """Gains over losses as an aggregate; null without losses."""
    gains = F.sum(F.when(value > 0, value))
    losses = F.sum(F.when(value < 0, -value))
    return F.when(losses > 0, F.coalesce(gains, F.lit(0.0)) / losses)


def peak_capital(df: DataFrame, by: Sequence[str], width: int = 30 * DAY_MS) -> DataFrame:
    """Most notional open at once; releases at a time come before adds."""
    moves = df.where("is_filled").select(
        *by,
        F.explode(
            F.array(
                F.struct(F.col("fill_ts_ms").alias("ts"), F.col("actual_notional_usd").alias("d")),
                F.struct(F.col("exit_ts_ms").alias("ts"), (-F.col("actual_notional_usd")).alias("d")),
            )
        ).alias("_m"),
    ).select(*by, "_m.ts", "_m.d").where(F.col("ts").isNotNull())
    return scan.peak_level(moves, by, "ts", F.col("d"), width, "max_simultaneous_capital_usd")


def drawdown(df: DataFrame, by: Sequence[str], width: int = 30 * DAY_MS) -> DataFrame:
    """Max drawdown of historical net PnL of filled episodes in exit order."""
    rows = df.where("is_filled").withColumn("_ts", F.coalesce("exit_ts_ms", "fill_ts_ms"))
    return scan.max_drawdown(
        rows.where(F.col("_ts").isNotNull()), by, "_ts", historical_net(df), ("episode_id",), width,
        "max_drawdown_usd",
    )


def economy_summary(df: DataFrame, by: Sequence[str], width: int = 30 * DAY_MS) -> DataFrame:
    """The episode metrics per key (``by`` may be empty for one overall row).

    Expects ``is_filled, gross_pnl_usd, net_pnl_usd``, optionally ``pnl_historical_usd``, ``pnl_current_usd,
    actual_notional_usd, capital_seconds_usd_s, exit_type, is_maker, markout_5s_pp``.
    """
    filled = F.col("is_filled")
    only = lambda c: F.when(filled, c)
    total = lambda c: F.coalesce(F.sum(only(c)), F.lit(0.0))
    net, gross, cap = historical_net(df), F.col("gross_pnl_usd"), F.col("actual_notional_usd")
    n, nf = F.count(F.lit(1)), F.count_if(filled)
    mark = F.when(F.col("is_maker") & finite(F.col("markout_5s_pp")), F.col("markout_5s_pp"))
    used = total(cap)
    seconds = total(F.col("capital_seconds_usd_s"))
    base = df.groupBy(*by).agg(
        n.alias("n_episodes"),
        nf.alias("n_filled"),
        (n - nf).alias("n_nofill"),
        F.coalesce(F.try_divide(nf, n), F.lit(0.0)).alias("fill_rate"),
        F.coalesce(F.try_divide(n - nf, n), F.lit(0.0)).alias("nofill_rate"),
        total(gross).alias("gross_pnl_usd"),
        total(net).alias("historical_net_usd"),
        total(F.coalesce("pnl_current_usd", F.lit(0.0))).alias("current_net_usd"),
        F.coalesce(F.try_divide(total(net), nf), F.lit(0.0)).alias("pnl_per_trade"),
        (total(net) / F.greatest(used, F.lit(ROI_FLOOR))).alias("roi_on_used_capital"),
        F.count_if(filled & (net > 0)).alias("wins"),
        F.count_if(filled & (net < 0)).alias("losses"),
        profit_factor(only(gross)).alias("profit_factor"),
        used.alias("turnover_usd"),
        seconds.alias("total_capital_seconds"),
        F.coalesce(F.try_divide(seconds, nf), F.lit(0.0)).alias("mean_capital_seconds"),
        F.avg(only(mark)).alias("adverse_selection_pp"),
        total(F.when(F.col("exit_type").isin(*HOLD_EXITS), net)).alias("hold_pnl_usd"),
        total(F.when(F.col("exit_type") == "hedge", net)).alias("hedge_pnl_usd"),
    )
    dd, pk = drawdown(df, by, width), peak_capital(df, by, width)
    if by:
        out = base.join(dd, list(by), "left").join(pk, list(by), "left")
    else:
        out = base.withColumns({dd.columns[0]: dd.scalar(), pk.columns[0]: pk.scalar()})
    return out.fillna(0.0, subset=["max_drawdown_usd", "max_simultaneous_capital_usd"])


def portfolio(fills: DataFrame, exits: DataFrame, mids: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Average-cost position per key marked at the last mid.

    ``fills``: price, size, toxic; ``exits``: price, size; ``mids``: mid, ts_ms. PnL is in
    percentage points times size.
    """
    price, size = F.col("price"), F.col("size")
    b = fills.groupBy(*keys).agg(
        F.sum(price * size).alias("_bn"), F.sum(size).alias("_bs"),
        F.count(F.lit(1)).alias("fills"), F.count_if("toxic").alias("_tox"),
    )
    x = exits.groupBy(*keys).agg(F.sum(price * size).alias("_xn"), F.sum(size).alias("_xs"))
    m = mids.groupBy(*keys).agg(F.max_by("mid", "ts_ms").alias("last_mid"))
    df = b.join(x, list(keys), "full").join(m, list(keys), "left")
    df = df.fillna(0.0, subset=["_bn", "_bs", "_xn", "_xs"]).fillna(0, subset=["fills", "_tox"])
    avg = F.coalesce(F.try_divide("_bn", "_bs"), F.lit(0.0))
    open_ = F.col("_bs") - F.col("_xs")
    realised = F.when(F.col("_bs") > 0, (F.col("_xn") - avg * F.col("_xs")) * 100).otherwise(0.0)
    unrealised = F.when(
        (open_ > 0) & F.col("last_mid").isNotNull(), (F.col("last_mid") - avg) * 100 * open_
    ).otherwise(0.0)
    return df.select(
        *keys, avg.alias("average_buy"), realised.alias("realized_pp"), unrealised.alias("unrealized_pp"),
        (realised + unrealised).alias("total_pp"), open_.alias("inventory"),
        (F.col("_bs") + F.col("_xs")).alias("turnover"), "fills",
        F.coalesce(F.try_divide("_tox", "fills"), F.lit(0.0)).alias("toxic_fill_rate"),
        F.when(open_ > 0, avg * open_).otherwise(0.0).alias("exposure"),
    )
