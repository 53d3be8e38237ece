"""Point-in-time feature rows and the user hooks around them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelab.functions import prices, quant, signals, times
from tapelab.operators import asof, flow, scan
from tapelab.operators.scan import DAY_MS, HOUR_MS
from tapelab.session import settle

# The return horizons, volatility spans and quote lags of a feature row, in ms.
RETURNS = {
    "ret_250ms_pct": 250, "ret_1s_pct": 1_000, "ret_5s_pct": 5_000, "ret_30s_pct": 30_000, "ret_1m_pct": 60_000,
    "ret_5m_pct": 300_000, "ret_15m_pct": 900_000, "ret_30m_pct": 1_800_000, "ret_1h_pct": 3_600_000,
}
VOLS = {"realized_vol_1m_pct": 60, "realized_vol_5m_pct": 300, "realized_vol_1h_pct": 3_600}
LAGS = {"price_1s_ago": 1_000, "price_5s_ago": 5_000, "price_30s_ago": 30_000}


def flow_at(evals: DataFrame, ticks: DataFrame, ids: Sequence[str], by: Sequence[str], ts: str, **settings) -> DataFrame:
    """Order flow of the ticks as of each evaluation: evaluations join the tick series as rows without volume."""
    marks = evals.select(*by, ts, *[i for i in ids if i not in by], F.lit(True).alias("_eval"))
    trades = ticks.select(*by, ts, "side", "qty")
    both = trades.unionByName(marks, allowMissingColumns=True)
    got = flow.order_flow(both, by, ts, **settings).where(F.col("_eval"))
    keep = ("buy_vol", "sell_vol", "ofi_short", "ofi_long", "imbalance", "buy_ratio")
    return got.select(*ids, *keep)


def build_features(
    evals: DataFrame, spot: DataFrame, perp: DataFrame, quotes: DataFrame, scale: int = 1, width: int = HOUR_MS,
    vols: dict[str, int] | None = None,
) -> DataFrame:
    """One feature row per evaluation from data at or before its time.

    ``evals``: eval_id, asset, market, ts_ms, target, end_ms. ``spot``: asset, ts_ms, seq, price, qty, side. ``perp``: asset,
    ts_ms, seq, price. ``quotes``: market, ts_ms, seq, yes_bid, yes_ask. ``scale`` stretches every horizon, for series
    sparser than a second.
    """
    by, ids = ["asset"], ["eval_id"]
    vols = vols or VOLS
    series = spot.select("asset", "ts_ms", "seq", "price")
    # The end of the series is the newest tick known at the evaluation. All that follows starts from here, so it is written once.
    base = settle(
        asof.asof_backward(
            evals, series.withColumnRenamed("price", "spot"), "ts_ms", by, ["spot"], tie="seq", matched_ts="spot_ts", width=width
        ),
        "feature-base",
    )
    spans = {n: ms * scale for n, ms in RETURNS.items()}
    ended = base.select(*ids, *by, "spot_ts")
    rets = flow.horizon_returns(ended, series, "spot_ts", by, ids, "price", spans, tick_on="ts_ms", tie="seq", width=width)
    ends = base.where(F.col("spot_ts").isNotNull()).select(*by, F.col("spot_ts").alias("ts_ms")).distinct()
    vol_rows = flow.realized_vol(
        ends, series, "ts_ms", by, "price", vols, step_ms=1_000 * scale, tie="seq", width=width
    ).withColumnRenamed("ts_ms", "spot_ts")
    rows = asof.asof_backward(
        base, perp.select("asset", "ts_ms", "seq", F.col("price").alias("perp_price")), "ts_ms", by, ["perp_price"],
        tie="seq", matched_ts="perp_ts", width=width,
    )
    # The quote at the evaluation and the mids before it are lags of one series.
    mids = quotes.withColumn("mid", (F.col("yes_bid") + F.col("yes_ask")) / 2.0)
    quote = F.struct("yes_bid", "yes_ask", "mid", F.col("ts_ms").alias("quote_ts"))
    lags = {"_quote": 0} | {n: ms * scale for n, ms in LAGS.items()}
    known = asof.lag_asof(
        base.select(*ids, "market", "ts_ms"), mids.select("market", "ts_ms", "seq", quote.alias("_q")), "ts_ms", ["market"], ids, "_q",
        lags, tie="seq", width=width,
    ).select(*ids, "_quote.*", *[F.col(f"{n}.mid").alias(n) for n in LAGS])
    flows = flow_at(
        evals, spot, ids, by, "ts_ms", short_ms=1_000 * scale, long_ms=5_000 * scale, basis="long", empty_ratio=0.5, width=width
    )
    rows = rows.join(rets.select(*ids, *RETURNS), ids, "left").join(known, ids, "left").join(flows, ids, "left")
    rows = rows.join(vol_rows, [*by, "spot_ts"], "left")
    zero = [*RETURNS, *vols, "spot", "perp_price"]
    rows = rows.fillna(0.0, subset=zero)
    rows = rows.withColumns(
        {
            "time_remaining_secs": times.time_remaining(F.col("end_ms"), F.col("ts_ms")),
            "distance_to_target_pct": prices.rel_diff(F.col("spot"), F.col("target")),
            "spot_perp_diff_pct": prices.rel_diff(F.col("spot"), F.col("perp_price")),
        }
    )
    rows = quant.quant_features(rows)
    inputs = F.array(
        *[F.struct(F.lit(n).alias("name"), F.col(c).alias("ts_ms"))
          for n, c in (("spot", "spot_ts"), ("perp", "perp_ts"), ("quote", "quote_ts"))]
    )
    state = F.to_json(F.struct("asset", "spot", "target", "time_remaining_secs"))
    audited = signals.audit_causality(rows.withColumns({"_in": inputs, "_state": state}), "ts_ms", "_in", "_state")
    return audited.drop("_in", "_state", "late_input", "late_input_ts_ms", "forbidden_field")


def market_features(quotes: DataFrame, prints: DataFrame, ends: DataFrame, scale: int = 1, width: int = DAY_MS) -> DataFrame:
    """Momentum, volatility, traded volume, day change and time left of every quote.

    ``quotes``: market, ts_ms, seq, yes_bid, yes_ask; ``prints``: market, ts_ms, qty; ``ends``: market, end_ms, target and, if the
    venue tells it, liquidity (null otherwise).
    """
    if "liquidity" not in ends.columns:
        ends = ends.withColumn("liquidity", F.lit(None).cast("double"))
    q = quotes.withColumns({"mid": (F.col("yes_bid") + F.col("yes_ask")) / 2.0, "spread": F.col("yes_ask") - F.col("yes_bid")})
    mids = q.select("market", "ts_ms", "seq", F.col("mid").alias("_m"))
    lags = {"_5m": 300_000 * scale, "_1h": 3_600_000 * scale, "_1d": DAY_MS}
    rows = asof.lag_asof(q, mids, "ts_ms", ["market"], ["seq"], "_m", lags, tie="seq", width=width)
    back = scan.previous_row(q, ["market"], "ts_ms", ["mid"], ("seq",), width)
    ret = back.withColumn("_r", prices.pct_return(F.col("prev_mid"), F.col("mid")))
    vol = scan.range_spread(
        ret.select("market", "ts_ms", "seq", "_r"), ["market"], "ts_ms", 3_600_000 * scale, "_r", "volatility_1h"
    ).select("seq", "volatility_1h")
    both = prints.select("market", "ts_ms", "qty").unionByName(q.select("market", "ts_ms", "seq"), allowMissingColumns=True)
    volume = scan.range_window(both, ["market"], "ts_ms", {"_v": (DAY_MS, F.sum("qty"))}, width)
    volume = volume.where(F.col("seq").isNotNull()).select("seq", F.coalesce("_v", F.lit(0.0)).alias("volume_24h"))
    rows = rows.join(vol, "seq", "left").join(volume, "seq", "left").join(ends, "market", "left")
    return rows.select(
        "market", "ts_ms", "seq", "mid", "spread",
        prices.pct_return(F.col("_5m"), F.col("mid")).alias("momentum_5m"),
        prices.pct_return(F.col("_1h"), F.col("mid")).alias("momentum_1h"),
        "volatility_1h", "volume_24h", "liquidity",
        prices.pct_return(F.col("_1d"), F.col("mid")).alias("one_day_change"),
        F.floor(F.greatest(F.col("end_ms") - F.col("ts_ms"), F.lit(0)) / 60_000).cast("long").alias("minutes_to_resolution"),
        F.when(F.col("target").isNotNull(), prices.rel_diff(F.col("mid"), F.col("target"))).alias("distance_to_target"),
    )


def toxic_fills(fills: DataFrame, markout: str, limit_pp: float) -> DataFrame:
    """Flags fills whose later signed markout fell below ``-limit``; unknown stays null."""
    return fills.withColumn("toxic", F.col(markout) < -limit_pp)


def dedupe_news(news: DataFrame, text: str, published_ms: str, now_ms: int, tie: Sequence[str] = ()) -> DataFrame:
    """First item per text hash, with its age in whole minutes."""
    body = news.withColumn("dedup_hash", F.sha2(F.lower(F.trim(text)), 256))
    first = body.groupBy("dedup_hash").agg(
        F.min_by(F.struct(*news.columns), F.struct(published_ms, *tie)).alias("_r"), F.count(F.lit(1)).alias("n_copies")
    )
    age = F.floor(F.greatest(F.lit(now_ms) - F.col(published_ms), F.lit(0)) / 60_000).cast("long")
    return first.select("_r.*", "dedup_hash", "n_copies").withColumn("published_minutes_ago", age)


def evaluate(misses: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema) -> DataFrame:
    """Runs the user's evaluator over the memo misses, batch by batch on the executors."""
    return misses.mapInPandas(fn, schema)


def strategy(df: DataFrame, rule: Callable, by: Sequence[str] = (), schema=None, order: Sequence[str] = ()) -> DataFrame:
    """A strategy is a DataFrame function, or a per-key pandas function where it must keep state.

    With a state ``rule(state, rows)`` gets the rows of a key in ``order``, a batch at a time, and returns its new state and the rows it
    writes (of ``schema``); the state of a key's first batch is None. A task holds a batch and a state, however many rows a key has.
    """
    if schema is None:
        return rule(df)
    by = list(by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for pdf in batches:
            # Sorted by key, so every change of the key starts another one; nulls are equal to each other.
            keys = pdf[by]
            same = (keys == keys.shift()) | (keys.isna() & keys.shift().isna())
            starts = [0, *[int(i) for i in np.flatnonzero(~same.all(axis=1).to_numpy()) if i], len(pdf)] if len(pdf) else []
            for a, b in zip(starts, starts[1:], strict=False):
                key = tuple(None if pd.isna(x) else x for x in keys.iloc[a])
                if key != now:
                    now, state = key, None
                state, out = rule(state, pdf.iloc[a:b])
                yield out

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, schema)


# The ablation arms; which inputs each uses and whether it asks the judge.
ARMS = {
    "QUANT_ONLY": {"calls_judge": False, "uses_quant": True, "uses_micro_regime": False},
    "JUDGE_ONLY": {"calls_judge": True, "uses_quant": False, "uses_micro_regime": False},
    "QUANT_PLUS_JUDGE": {"calls_judge": True, "uses_quant": True, "uses_micro_regime": False},
    "MICRO_PLUS_REGIME": {"calls_judge": True, "uses_quant": False, "uses_micro_regime": True},
}


def arms(df: DataFrame, quant_cols: Sequence[str], micro_cols: Sequence[str], table: dict = ARMS) -> DataFrame:
    """Every row once per arm, with the inputs the arm does not use set to null."""
    listed = F.array(
        *[F.struct(F.lit(n).alias("arm"), *[F.lit(v).alias(k) for k, v in p.items()]) for n, p in table.items()]
    )
    out = df.withColumn("_a", F.explode(listed))
    cut = {c: F.when(F.col("_a.uses_quant"), F.col(c)) for c in quant_cols}
    cut |= {c: F.when(F.col("_a.uses_micro_regime"), F.col(c)) for c in micro_cols}
    return out.withColumns({**cut, "arm": F.col("_a.arm"), "calls_judge": F.col("_a.calls_judge")}).drop("_a")
