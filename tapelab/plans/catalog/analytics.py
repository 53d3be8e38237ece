"""Ledger, reports, research statistics, bootstrap and walk-forward."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapelab.functions import accounting
from tapelab.operators import bootstrap, ledger, reports, research, sampling, walkforward
from tapelab.operators.scan import DAY_MS
from tapelab.plans.registry import query, r
from tapelab.session import settle

col = F.col
_SEG = ", ".join(reports.SEGMENT)
_KEYS = ["asset", "horizon", "market_id"]


@query("A1_segment_summary", using="evals", sql=f"""
SELECT {_SEG}, count(*) AS evaluations, count(*) FILTER (quoted) AS quotes, count(*) FILTER (filled) AS fills,
  round(coalesce(count(*) FILTER (filled) / nullif(count(*) FILTER (quoted), 0), 0), 9) AS fill_rate,
  round(coalesce(avg(markout_5s_pp), 0), 9) + 0.0::DOUBLE AS mean_markout_5s_pp, round(avg(latency_ms), 4) AS mean_latency_ms,
  round(coalesce(count(*) FILTER (markout_5s_pp > 0) / nullif(count(markout_5s_pp), 0), 0), 9) AS hit_rate_5s,
  round(coalesce(avg(drift_5s_pp), 0), 9) + 0.0::DOUBLE AS mean_drift_5s_pp, round(coalesce(count(*) FILTER (drift_5s_pp > 0) / nullif(count(drift_5s_pp), 0), 0), 9) AS hit_rate_drift_5s,
  count(drift_5s_pp) AS n_drift_5s, round(avg(fair_p_yes), 9) AS mean_fair_p_yes, round(avg(pressure), 9) AS mean_pressure,
  round(sum(pnl_pp), 9) + 0.0::DOUBLE AS total_pnl_pp, round(coalesce(sum(pnl_pp) / nullif(count(*) FILTER (filled), 0), 0), 9) + 0.0::DOUBLE AS pnl_per_trade,
  count(*) FILTER (stale_skipped) AS stale_skips, count(*) FILTER (incomplete_pair) AS incomplete_pairs FROM evals GROUP BY {_SEG}""")
def _(t):
    got = reports.segment_summary(t.evals)
    rounded = ("fill_rate", "mean_markout_5s_pp", "hit_rate_5s", "mean_drift_5s_pp", "hit_rate_drift_5s",
               "mean_fair_p_yes", "mean_pressure", "total_pnl_pp", "pnl_per_trade")
    return got.withColumns({c: r(c, c, 9) for c in rounded}).withColumn("mean_latency_ms", r("mean_latency_ms", "x", 4))


def _ep(t):
    return t.episodes.withColumns(
        {
            "pnl_current_usd": F.when(col("l_linenumber") != 5, col("gross_pnl_usd") - 0.07 * col("actual_notional_usd")),
            "capital_seconds_usd_s": col("stake_usd") * (col("exit_ts_ms") - col("fill_ts_ms")) / 1000,
        }
    )


def _economy_sql(keys):
    k = "".join(f"{x}, " for x in keys)
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    join = " AND ".join(f"b.{x} = d.{x}" for x in keys) or "true"
    join2 = " AND ".join(f"b.{x} = p.{x}" for x in keys) or "true"
    return f"""
WITH e AS (SELECT *, CASE WHEN l_linenumber <> 5 THEN gross_pnl_usd - 0.07::DOUBLE * actual_notional_usd END AS cur, stake_usd * (exit_ts_ms - fill_ts_ms) / 1000 AS cs, coalesce(pnl_historical_usd, net_pnl_usd) AS hist FROM episodes),
eq AS (SELECT {k} sum(hist) OVER ({part} ORDER BY exit_ts_ms, episode_id, actual_notional_usd ROWS UNBOUNDED PRECEDING) AS q, exit_ts_ms, episode_id, actual_notional_usd FROM e WHERE is_filled),
pk AS (SELECT *, greatest(0, max(q) OVER ({part} ORDER BY exit_ts_ms, episode_id, actual_notional_usd ROWS UNBOUNDED PRECEDING)) AS peak FROM eq),
d AS (SELECT {k} max(peak - q) AS dd FROM pk {group}),
mv AS (SELECT {k} fill_ts_ms AS ts, actual_notional_usd AS v FROM e WHERE is_filled UNION ALL SELECT {k} exit_ts_ms, -actual_notional_usd FROM e WHERE is_filled),
nt AS (SELECT {k} ts, sum(v) AS v FROM mv GROUP BY {k} ts),
lv AS (SELECT {k} sum(v) OVER ({part} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS l FROM nt),
p AS (SELECT {k} greatest(0, max(l)) AS pc FROM lv {group}),
b AS (SELECT {k} count(*) AS n_episodes, count(*) FILTER (is_filled) AS n_filled, count(*) FILTER (NOT is_filled) AS n_nofill,
  coalesce(sum(gross_pnl_usd) FILTER (is_filled), 0) AS g, coalesce(sum(hist) FILTER (is_filled), 0) AS h, coalesce(sum(cur) FILTER (is_filled), 0) AS c,
  coalesce(sum(actual_notional_usd) FILTER (is_filled), 0) AS u, count(*) FILTER (is_filled AND hist > 0) AS wins, count(*) FILTER (is_filled AND hist < 0) AS losses,
  coalesce(sum(gross_pnl_usd) FILTER (is_filled AND gross_pnl_usd > 0), 0) / nullif(-sum(gross_pnl_usd) FILTER (is_filled AND gross_pnl_usd < 0), 0) AS pf,
  coalesce(sum(cs) FILTER (is_filled), 0) AS s, avg(markout_5s_pp) FILTER (is_filled AND is_maker) AS adv,
  coalesce(sum(hist) FILTER (is_filled AND exit_type IN ('resolution','sell','stop')), 0) AS hold, coalesce(sum(hist) FILTER (is_filled AND exit_type = 'hedge'), 0) AS hedge
  FROM e {group})
SELECT {''.join(f'b.{x}, ' for x in keys)} n_episodes, n_filled, n_nofill, round(n_filled / n_episodes, 6) AS fill_rate, round(n_nofill / n_episodes, 6) AS nofill_rate,
 round(g, 2) AS gross_pnl_usd, round(h, 2) AS historical_net_usd, round(c, 2) AS current_net_usd, round(coalesce(h / nullif(n_filled, 0), 0), 4) AS pnl_per_trade,
 round(h / greatest(u, 1e-9), 6) AS roi_on_used_capital, wins, losses, round(pf, 6) AS profit_factor, round(u, 2) AS turnover_usd, round(s, 0) AS total_capital_seconds,
 round(coalesce(s / nullif(n_filled, 0), 0), 2) AS mean_capital_seconds, round(adv, 6) AS adverse_selection_pp, round(hold, 2) AS hold_pnl_usd, round(hedge, 2) AS hedge_pnl_usd,
 round(coalesce(dd, 0), 2) AS max_drawdown_usd, round(coalesce(pc, 0), 2) AS max_simultaneous_capital_usd
FROM b LEFT JOIN d ON {join} LEFT JOIN p ON {join2}"""


_DIGITS = {
    "fill_rate": 6, "nofill_rate": 6, "gross_pnl_usd": 2, "historical_net_usd": 2, "current_net_usd": 2, "pnl_per_trade": 4,
    "roi_on_used_capital": 6, "profit_factor": 6, "turnover_usd": 2, "total_capital_seconds": 0, "mean_capital_seconds": 2,
    "adverse_selection_pp": 6, "hold_pnl_usd": 2, "hedge_pnl_usd": 2, "max_drawdown_usd": 2, "max_simultaneous_capital_usd": 2,
}


def _economy(t, keys):
    # The summary reads its episodes three times.
    got = ledger.economy_summary(_ep(t.joined), keys)
    return got.withColumns({c: r(c, c, n) for c, n in _DIGITS.items()})


@query("A2_economy_summary_by_key", using="episodes", sql=_economy_sql(["asset", "horizon", "regime", "strategy_version", "fill_profile"]))
def _(t):
    return _economy(t, ["asset", "horizon", "regime", "strategy_version", "fill_profile"])


@query("A2_economy_summary_overall", using="episodes", sql=_economy_sql([]))
def _(t):
    return _economy(t, [])


@query("A2_breakdown_key", using="episodes", sql="""
SELECT asset || '|' || horizon || '|' || regime || '|' || strategy_version || '|' || fill_profile || '|' ||
 CASE exit_type WHEN 'hedge' THEN 'hedge' WHEN 'no_fill' THEN 'no_fill' ELSE 'hold' END AS key, count(*) AS n FROM episodes GROUP BY 1""")
def _(t):
    return t.episodes.groupBy(ledger.breakdown_key(t.episodes).alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("A3_breakdowns", using="evals", sql="\nUNION ALL ".join(
    f"SELECT '{d}' AS dimension, {d} AS level, count(*) AS n, round(coalesce(avg(markout_5s_pp), 0), 6) AS mean_value FROM evals GROUP BY {d}"
    for d in ("asset", "horizon", "regime", "split", "fidelity", "fill_model")))
def _(t):
    got = reports.breakdowns(t.evals, ["asset", "horizon", "regime", "split", "fidelity", "fill_model"], "markout_5s_pp")
    return got.withColumn("mean_value", r("mean_value", "x"))


@query("A3_oos_only", using="evals", sql="""
SELECT variant, count(*) AS n, round(coalesce(avg(markout_5s_pp), 0), 6) AS mean_markout_5s, round(sum(pnl_pp), 4) AS sum_pnl FROM evals
WHERE split = 'OUT_OF_SAMPLE' AND variant IN ('CONTROL', 'QUANT') GROUP BY 1""")
def _(t):
    got = reports.variant_summary(t.evals, ["CONTROL", "QUANT"], col("split") == "OUT_OF_SAMPLE")
    return got.select("variant", "n", r("mean_markout_5s", "mean_markout_5s"), r("sum_pnl", "sum_pnl", 4))


_PAIRS = """pairs AS (SELECT run_id, pair_id, market_id, horizon, count(*) FILTER (variant = 'CONTROL') AS control_ok, count(*) FILTER (variant = 'QUANT') AS quant_ok,
 CASE WHEN count(*) = 2 THEN 'complete' ELSE 'incomplete' END AS status FROM ab GROUP BY ALL)"""


def _ab(t):
    df = t.ab.withColumn("markout_1s_pp", col("drift_1s_pp"))
    return df, reports.pair_status(df, "CONTROL", "QUANT", ["market_id", "horizon"]).drop("market_id", "horizon")


@query("A4_ab_summary", using="ab", sql=f"""
WITH {_PAIRS} SELECT a.asset, a.horizon, a.variant, count(*) AS n_markouts, round(avg(drift_1s_pp), 6) AS mean_markout_1s_pp, round(avg(markout_5s_pp), 6) AS mean_markout_5s_pp,
 round(coalesce(count(*) FILTER (markout_5s_pp > 0) / nullif(count(markout_5s_pp), 0), 0), 6) AS hit_rate_5s
FROM ab a JOIN pairs p ON a.pair_id = p.pair_id WHERE status = 'complete' GROUP BY 1, 2, 3""")
def _(t):
    df, pairs = _ab(t)
    got = reports.ab_summary(df, pairs, ["asset", "horizon", "variant"])
    return got.withColumns({c: r(c, c) for c in ("mean_markout_1s_pp", "mean_markout_5s_pp", "hit_rate_5s")})


@query("A5_ab_delta", using="ab", sql="""
SELECT c.horizon, c.regime, count(*) AS n_complete_pairs, round(avg(q.drift_5s_pp - c.drift_5s_pp), 6) AS delta_drift_5s_pp, round(avg(q.drift_1s_pp - c.drift_1s_pp), 6) AS delta_drift_1s_pp
FROM ab c JOIN ab q ON c.pair_id = q.pair_id AND c.variant = 'CONTROL' AND q.variant = 'QUANT' GROUP BY 1, 2""")
def _(t):
    df, pairs = _ab(t)
    got = reports.ab_delta(df, pairs, "CONTROL", "QUANT", ["drift_5s_pp", "drift_1s_pp"], ["horizon", "regime"])
    return got.withColumns({c: r(c, c) for c in ("delta_drift_5s_pp", "delta_drift_1s_pp")})


@query("J13_paired", using="ab", sql="""
SELECT c.run_id, c.pair_id, c.p_up AS ref_p_up, q.p_up AS alt_p_up, c.fair_p_yes AS ref_fair_p_yes, q.fair_p_yes AS alt_fair_p_yes
FROM ab c JOIN ab q ON c.pair_id = q.pair_id AND c.variant = 'CONTROL' AND q.variant = 'QUANT'""")
def _(t):
    return reports.paired(t.ab, "CONTROL", "QUANT", ["p_up", "fair_p_yes"])


@query("J14_joined_research", using="ab", sql=f"""
WITH {_PAIRS} SELECT a.run_id, a.pair_id, a.variant, a.markout_5s_pp, b.underreact_up FROM ab a JOIN ab b ON a.pair_id = b.pair_id AND a.variant = b.variant
JOIN pairs p ON a.pair_id = p.pair_id WHERE p.status = 'complete'""")
def _(t):
    df, pairs = _ab(t)
    marks = df.select("run_id", "pair_id", "variant", "markout_5s_pp")
    sig = df.select("run_id", "pair_id", "variant", "underreact_up")
    return reports.joined_research(marks, sig, pairs)


@query("A6_conditional_mean", using="evals", sql="""
SELECT asset, horizon, count(drift_5s_pp) FILTER (underreact_up > 0.75) AS n, round(coalesce(avg(drift_5s_pp) FILTER (underreact_up > 0.75), 0), 6) AS mean_y FROM evals GROUP BY 1, 2""")
def _(t):
    got = reports.conditional_mean(t.evals, "underreact_up", "drift_5s_pp", 0.75, ["asset", "horizon"])
    return got.withColumn("mean_y", r("mean_y", "x"))


@query("A7_threshold_ladder", using="evals", sql="""
SELECT asset, variant, count(*) AS n, round(avg(drift_5s_pp), 6) AS mean_y, round(count(*) FILTER (drift_5s_pp > 0) / count(drift_5s_pp), 6) AS hit_rate,
 round(avg(drift_5s_pp) FILTER (underreact_up > 0.75), 6) AS mean_above_075, round(avg(drift_5s_pp) FILTER (underreact_up > 0.60), 6) AS mean_above_060,
 round(avg(drift_5s_pp) FILTER (underreact_up > 0.45), 6) AS mean_above_045, round(avg(drift_5s_pp) FILTER (underreact_up > 0.31), 6) AS mean_above_031 FROM evals GROUP BY 1, 2""")
def _(t):
    got = reports.threshold_ladder(t.evals, "underreact_up", "drift_5s_pp", (0.75, 0.60, 0.45, 0.31), ["asset", "variant"])
    cols = [c for c in got.columns if c.startswith("mean") or c == "hit_rate"]
    return got.withColumns({c: r(c, c) for c in cols})


@query("A8_decision_counts", using="evals", sql="""
SELECT asset, horizon, variant, count(*) AS n_decisions, count(*) FILTER (quoted) AS n_quotes, count(*) FILTER (filled) AS n_fills, coalesce(sum(move_persists * 50) FILTER (filled), 0) AS filled_size FROM evals GROUP BY 1, 2, 3""")
def _(t):
    keys = ["asset", "horizon", "variant"]
    dec = t.evals.select(*keys, F.when(col("quoted"), "QUOTE").otherwise("SKIP").alias("decision"))
    fl = t.evals.where("filled").select(*keys, (col("move_persists") * 50).alias("size"))
    return reports.decision_counts(dec, fl, keys)


@query("A10_pair_audit", using="ab", sql=f"""
WITH {_PAIRS} SELECT horizon, status, count(*) AS n_pairs, CAST(sum(control_ok) AS BIGINT) AS control_ok_rows, CAST(sum(quant_ok) AS BIGINT) AS quant_ok_rows FROM pairs GROUP BY 1, 2""")
def _(t):
    pairs = reports.pair_status(t.ab, "CONTROL", "QUANT", ["market_id", "horizon"])
    return reports.pair_audit(pairs, ["horizon"])


@query("D6_repricing_accuracy", using="evals", sql="""
SELECT asset, count(*) AS n, round(avg(CASE WHEN (CASE WHEN p_up / 2 > -1 AND p_up / 2 >= 1 - p_up AND p_up / 2 >= p_up / 2 THEN 1 WHEN 1 - p_up > p_up / 2 THEN 0 ELSE 1 END) = sign(drift_5s_pp) THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM evals WHERE drift_5s_pp IS NOT NULL GROUP BY 1""")
def _(t):
    up = col("p_up") / 2
    probs = F.map_from_arrays(
        F.array(F.lit("UP_1_TICK"), F.lit("FLAT"), F.lit("DOWN_1_TICK")), F.array(up, 1 - col("p_up"), up)
    )
    got = reports.repricing_accuracy(t.evals.withColumn("b", probs), "b", "drift_5s_pp", ["asset"])
    return got.withColumn("accuracy", r("accuracy", "x"))


@query("A13_peak_capital", using="episodes", sql="""
WITH mv AS (SELECT market, fill_ts_ms AS ts, actual_notional_usd AS v FROM episodes WHERE is_filled UNION ALL SELECT market, exit_ts_ms, -actual_notional_usd FROM episodes WHERE is_filled),
nt AS (SELECT market, ts, sum(v) AS v FROM mv GROUP BY 1, 2), lv AS (SELECT market, sum(v) OVER (PARTITION BY market ORDER BY ts ROWS UNBOUNDED PRECEDING) AS l FROM nt)
SELECT market, round(greatest(0, max(l)), 2) AS max_simultaneous_capital_usd FROM lv GROUP BY 1""")
def _(t):
    got = ledger.peak_capital(t.episodes, ["market"])
    return got.select("market", r("max_simultaneous_capital_usd", "max_simultaneous_capital_usd", 2))


@query("A14_max_drawdown", using="episodes", sql="""
WITH e AS (SELECT asset, horizon, exit_ts_ms, episode_id, actual_notional_usd, sum(coalesce(pnl_historical_usd, net_pnl_usd)) OVER w AS q FROM episodes WHERE is_filled WINDOW w AS (PARTITION BY asset, horizon ORDER BY exit_ts_ms, episode_id, actual_notional_usd ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, greatest(0, max(q) OVER (PARTITION BY asset, horizon ORDER BY exit_ts_ms, episode_id, actual_notional_usd ROWS UNBOUNDED PRECEDING)) AS peak FROM e)
SELECT asset, horizon, round(max(peak - q), 2) AS max_drawdown_usd FROM p GROUP BY 1, 2""")
def _(t):
    got = ledger.drawdown(t.episodes, ["asset", "horizon"])
    return got.select("asset", "horizon", r("max_drawdown_usd", "max_drawdown_usd", 2))


@query("A15_profit_factor", using="episodes", sql="""
SELECT market, round(coalesce(sum(gross_pnl_usd) FILTER (gross_pnl_usd > 0), 0) / -sum(gross_pnl_usd) FILTER (gross_pnl_usd < 0), 6) AS gross_profit_factor,
 round(coalesce(sum(net_pnl_usd) FILTER (net_pnl_usd > 0), 0) / -sum(net_pnl_usd) FILTER (net_pnl_usd < 0), 6) AS net_profit_factor FROM episodes GROUP BY 1""")
def _(t):
    return t.episodes.groupBy("market").agg(
        r(ledger.profit_factor(col("gross_pnl_usd")), "gross_profit_factor"), r(ledger.profit_factor(col("net_pnl_usd")), "net_profit_factor")
    )


@query("A16_portfolio", using="evals prints", sql="""
WITH f AS (SELECT asset, variant, sum(fair_p_yes * move_persists) AS bn, sum(move_persists) AS bs, count(*) AS n, count(*) FILTER (pressure > 0.4) AS tox FROM evals WHERE filled GROUP BY 1, 2),
x AS (SELECT asset, variant, sum(pressure * move_persists / 2) AS xn, sum(move_persists / 2) AS xs FROM evals WHERE filled AND stale_skipped GROUP BY 1, 2),
m AS (SELECT asset, variant, max(fair_p_yes) FILTER (ts_ms = mx) AS mid FROM (SELECT *, max(ts_ms) OVER (PARTITION BY asset, variant) AS mx FROM evals) GROUP BY 1, 2)
SELECT f.asset, f.variant, round(bn / bs, 6) AS average_buy, round((xn - bn / bs * xs) * 100, 4) AS realized_pp, round(CASE WHEN bs > xs THEN (mid - bn / bs) * 100 * (bs - xs) ELSE 0 END, 4) AS unrealized_pp,
 round(bs - xs, 6) AS inventory, round(bs + xs, 6) AS turnover, n AS fills, round(tox / n, 6) AS toxic_fill_rate, round(bn / bs * (bs - xs), 6) AS exposure
FROM f JOIN x USING (asset, variant) JOIN m USING (asset, variant)""")
def _(t):
    keys = ["asset", "variant"]
    filled = t.evals.where("filled")
    fl = filled.select(*keys, col("fair_p_yes").alias("price"), col("move_persists").alias("size"), (col("pressure") > 0.4).alias("toxic"))
    ex = filled.where("stale_skipped").select(*keys, col("pressure").alias("price"), (col("move_persists") / 2).alias("size"))
    order = F.struct("ts_ms", "fair_p_yes")
    mids = t.evals.select(*keys, col("fair_p_yes").alias("mid"), order.alias("ts_ms"))
    got = ledger.portfolio(fl, ex, mids, keys)
    return got.select(
        *keys, r("average_buy", "average_buy"), r("realized_pp", "realized_pp", 4), r("unrealized_pp", "unrealized_pp", 4), r("inventory", "inventory"),
        r("turnover", "turnover"), "fills", r("toxic_fill_rate", "toxic_fill_rate"), r("exposure", "exposure"),
    )


_LOW = "4294967295::UBIGINT"


def _mul64(x: str, by: int) -> str:
    """``x * by`` modulo 2^64 from 32-bit halves, which no unsigned 64-bit product or sum here exceeds."""
    hi, lo = f"{by >> 32}::UBIGINT", f"{by & 0xFFFFFFFF}::UBIGINT"
    low = f"(({x} & {_LOW}) * {lo})"
    upper = f"(({low} >> 32) + ((({x} >> 32) * {lo}) & {_LOW}) + ((({x} & {_LOW}) * {hi}) & {_LOW}))"
    return f"((({upper} & {_LOW}) * 4294967296::UBIGINT) | ({low} & {_LOW}))"


def _add64(x: str, more: int) -> str:
    low = f"(({x} & {_LOW}) + {more & 0xFFFFFFFF}::UBIGINT)"
    return f"((((({x} >> 32) + {more >> 32}::UBIGINT + ({low} >> 32)) & {_LOW}) * 4294967296::UBIGINT) | ({low} & {_LOW}))"


def _boot_sql(rows: str, value: str, draws: int = 10_000, seed: int = 42) -> str:
    """Tables blk and boot (draw, total): whole blocks drawn with replacement by the splitmix64 stream of the seed."""
    gamma = 0x9E3779B97F4A7C15
    return f"""blk AS (SELECT market, sum({value}) AS total, row_number() OVER (ORDER BY substr(md5(market), 1, 3), market) - 1 AS i FROM {rows} GROUP BY market),
cnt AS (SELECT count(*) AS n FROM blk),
p0 AS (SELECT t.d AS draw, n, (t.d * n + b.i)::UBIGINT AS k FROM range(0, {draws}) t(d), blk b, cnt),
p1 AS (SELECT draw, n, {_mul64('k', gamma)} AS g FROM p0),
p2 AS (SELECT draw, n, {_add64('g', (seed + gamma) % 2**64)} AS a FROM p1),
p3 AS (SELECT draw, n, xor(a, a >> 30) AS a FROM p2),
p4 AS (SELECT draw, n, {_mul64('a', 13787848793156543929)} AS b FROM p3),
p5 AS (SELECT draw, n, xor(b, b >> 27) AS b FROM p4),
p6 AS (SELECT draw, n, {_mul64('b', 10723151780598845931)} AS c FROM p5),
p7 AS (SELECT draw, (xor(c, c >> 31) % n::UBIGINT)::BIGINT AS pick FROM p6),
boot AS (SELECT draw, sum(total) AS total FROM p7 JOIN blk ON blk.i = p7.pick GROUP BY draw)"""


@query("A17_block_bootstrap", using="episodes", sql=f"""
WITH e AS (SELECT * FROM episodes WHERE is_filled), {_boot_sql("e", "net_pnl_usd")}
SELECT draw::INT AS draw, round(total, 5) AS total FROM boot""")
def _(t):
    rows = t.episodes.where("is_filled")
    return bootstrap.block_bootstrap(rows, "market", "net_pnl_usd", seed=42).withColumn("total", r("total", "x", 5))


@query("A18_summarize_distribution", using="episodes", sql="""
WITH s AS (SELECT asset, market, sum(net_pnl_usd) AS v FROM episodes WHERE is_filled GROUP BY 1, 2)
SELECT asset, count(*) AS n, round(avg(v), 4) AS mean, round(quantile_cont(v, 0.025), 4) AS ci95_low, round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.975), 4) AS ci95_high,
 round(count(*) FILTER (v > 0) / count(*), 6) AS p_positive FROM s GROUP BY 1""")
def _(t):
    s = t.episodes.where("is_filled").groupBy("asset", "market").agg(F.sum("net_pnl_usd").alias("v"))
    got = bootstrap.summarize_distribution(s, "v", ["asset"])
    return got.select("asset", "n", *[r(c, c, 4) for c in ("mean", "ci95_low", "median", "ci95_high")], r("p_positive", "p_positive"))


@query("A19_oos_headline", using="episodes", sql=f"""
WITH x AS (SELECT *, CASE WHEN fill_profile = 'O' THEN 'OUT_OF_SAMPLE' ELSE 'IN_SAMPLE' END AS side, coalesce(pnl_historical_usd, net_pnl_usd) AS v, stake_usd * (exit_ts_ms - fill_ts_ms) / 1000 AS cs FROM episodes),
e AS (SELECT * FROM x WHERE is_filled AND side = 'OUT_OF_SAMPLE'), {_boot_sql("e", "v")},
b AS (SELECT side, coalesce(sum(v) FILTER (is_filled), 0) AS net, count(*) FILTER (is_filled) AS fills, count(*) FILTER (NOT is_filled) AS nofills, sum(actual_notional_usd) FILTER (is_filled) AS used,
  coalesce(sum(v) FILTER (is_filled AND v > 0), 0) / nullif(-sum(v) FILTER (is_filled AND v < 0), 0) AS pf, coalesce(sum(cs) FILTER (is_filled), 0) AS cs FROM x GROUP BY 1),
q AS (SELECT side, exit_ts_ms, episode_id, actual_notional_usd, sum(v) OVER w AS q FROM x WHERE is_filled WINDOW w AS (PARTITION BY side ORDER BY exit_ts_ms, episode_id, actual_notional_usd ROWS UNBOUNDED PRECEDING)),
d AS (SELECT side, max(peak - q) AS dd FROM (SELECT *, greatest(0, max(q) OVER (PARTITION BY side ORDER BY exit_ts_ms, episode_id, actual_notional_usd ROWS UNBOUNDED PRECEDING)) AS peak FROM q) GROUP BY 1),
mv AS (SELECT side, fill_ts_ms AS ts, actual_notional_usd AS v FROM x WHERE is_filled UNION ALL SELECT side, exit_ts_ms, -actual_notional_usd FROM x WHERE is_filled),
nt AS (SELECT side, ts, sum(v) AS v FROM mv GROUP BY 1, 2), lv AS (SELECT side, sum(v) OVER (PARTITION BY side ORDER BY ts ROWS UNBOUNDED PRECEDING) AS l FROM nt),
pk AS (SELECT side, greatest(0, max(l)) AS pc FROM lv GROUP BY 1),
ci AS (SELECT 'OUT_OF_SAMPLE' AS side, quantile_cont(total, 0.025) AS lo, quantile_cont(total, 0.5) AS mid, quantile_cont(total, 0.975) AS hi, count(*) FILTER (total > 0) / count(*) AS pp FROM boot)
SELECT side, fills, nofills, round(net, 6) AS net_pnl_usd, round(coalesce(net / nullif(fills, 0), 0), 4) AS pnl_per_trade, round(CASE WHEN used > 0 THEN net / used END, 4) AS roi, round(pf, 4) AS profit_factor,
  round(cs, 0) AS capital_seconds, round(dd, 6) AS max_drawdown_usd, round(pc, 2) AS max_simultaneous_capital_usd, round(lo, 2) AS ci95_low, round(mid, 2) AS median, round(hi, 2) AS ci95_high, round(pp, 4) AS p_positive
FROM b LEFT JOIN d USING (side) LEFT JOIN pk USING (side) LEFT JOIN ci USING (side)""")
def _(t):
    got = bootstrap.oos_headline(_ep(t.joined), col("fill_profile") == "O", "market", draws=10_000, seed=42)
    # sums are multiples of 5e-6, so six digits are exact and no sum lies on a rounding edge
    digits = {"capital_seconds": 0, "max_simultaneous_capital_usd": 2, "net_pnl_usd": 6, "max_drawdown_usd": 6, "ci95_low": 2, "median": 2, "ci95_high": 2}
    return got.select("side", "fills", "nofills", *[r(c, c, digits.get(c, 4)) for c in got.columns if c not in ("side", "fills", "nofills")])


_ANS = ["yes_pressure_5s", "no_pressure_5s", "move_persists", "underreact_up", "underreact_down", "p_up", "fill_before_decay", "fill_toxic"]
_FEA = ["ret_5s_pct", "spread", "drift_1s_pp"]


@query("A20_corr_matrix", using="evals", sql="\nUNION ALL ".join(
    f"SELECT '{x}' AS x, '{y}' AS y, count({y}) AS n, round(corr({x}, {y}), 4) AS r FROM evals" for x in _ANS for y in _FEA))
def _(t):
    return research.corr_matrix(t.evals, _ANS, _FEA).withColumn("r", r("r", "x", 4))


@query("A21_variance_split", using="evals", sql="\nUNION ALL ".join(f"""
SELECT * FROM (WITH g AS (SELECT market_id, count(*) AS n, avg({x}) AS m, stddev_pop({x}) AS s FROM evals GROUP BY 1)
SELECT '{x}' AS name, (SELECT count(*) FROM evals) AS n, round((SELECT avg({x}) FROM evals), 6) AS mean, round((SELECT stddev_pop({x}) FROM evals), 6) AS std,
 round(avg(s) FILTER (n > 1), 6) AS std_within, round(stddev_pop(m), 6) AS std_between FROM g)""" for x in _ANS[:4]))
def _(t):
    got = research.variance_split(t.evals, _ANS[:4], "market_id")
    return got.select("name", "n", *[r(c, c) for c in ("mean", "std", "std_within", "std_between")])


@query("A22_quintile_means", using="evals", sql="""
WITH s AS (SELECT list_sort(list(ret_5s_pct)) AS l, count(*) AS n FROM evals),
c AS (SELECT [l[CAST(floor(n * 0.2::DOUBLE) AS BIGINT) + 1], l[CAST(floor(n * 0.4::DOUBLE) AS BIGINT) + 1], l[CAST(floor(n * 0.6::DOUBLE) AS BIGINT) + 1], l[CAST(floor(n * 0.8::DOUBLE) AS BIGINT) + 1]] AS q FROM s)
SELECT CAST(len(list_filter(q, lambda x: ret_5s_pct > x)) AS BIGINT) AS bucket, count(drift_5s_pp) AS n_drift_5s_pp, round(avg(drift_5s_pp), 6) AS mean_drift_5s_pp FROM evals, c GROUP BY 1""")
def _(t):
    got = research.quintile_means(t.evals, "ret_5s_pct", ["drift_5s_pp"])
    return got.withColumn("mean_drift_5s_pp", r("mean_drift_5s_pp", "x"))


@query("A23_binned_means", using="evals", sql="""
WITH k AS (SELECT (fair_p_yes * 2 - 1) AS v, drift_5s_pp AS y FROM evals WHERE drift_5s_pp IS NOT NULL)
SELECT CASE WHEN v >= -1 AND v < -0.6 THEN '[-1.0,-0.6)' WHEN v >= -0.6 AND v < -0.2 THEN '[-0.6,-0.2)' WHEN v >= -0.2 AND v < 0.2 THEN '[-0.2,+0.2]' WHEN v >= 0.2 AND v < 0.6 THEN '(+0.2,+0.6]' WHEN v >= 0.6 AND v <= 1 THEN '(+0.6,+1.0]' END AS bin,
 count(*) AS n, round(avg(y), 6) AS mean_y FROM k GROUP BY 1 HAVING bin IS NOT NULL""")
def _(t):
    df = t.evals.withColumn("v", col("fair_p_yes") * 2 - 1)
    return research.binned_means(df, "v", "drift_5s_pp").withColumn("mean_y", r("mean_y", "x"))


@query("A24_paired_delta_stats", using="ab", sql="\nUNION ALL ".join(f"""
SELECT '{x}' AS name, count(*) AS n_pairs, round(avg(abs(q.{x} - c.{x})), 6) AS mean_abs_delta, round(avg(CASE WHEN abs(q.{x} - c.{x}) >= 0.1::DOUBLE THEN 1.0 ELSE 0.0 END), 6) AS p_big,
 round(greatest(avg(CASE WHEN q.{x} > c.{x} THEN 1.0 ELSE 0.0 END) FILTER (abs(q.{x} - c.{x}) >= 0.05::DOUBLE), 1 - avg(CASE WHEN q.{x} > c.{x} THEN 1.0 ELSE 0.0 END) FILTER (abs(q.{x} - c.{x}) >= 0.05::DOUBLE)), 6) AS sign_agreement
FROM ab c JOIN ab q ON c.pair_id = q.pair_id AND c.variant = 'CONTROL' AND q.variant = 'QUANT'""" for x in _ANS[:4]))
def _(t):
    pairs = reports.paired(t.ab, "CONTROL", "QUANT", _ANS[:4])
    got = research.paired_delta_stats(pairs, _ANS[:4])
    return got.select("name", "n_pairs", *[r(c, c) for c in ("mean_abs_delta", "p_big", "sign_agreement")])


@query("A25_probe_vs_rest", using="evals", sql="\nUNION ALL ".join(f"""
SELECT '{x}' AS name, count(*) FILTER (market_id = 'M7') AS n_probe, count(*) FILTER (market_id <> 'M7') AS n_rest, round(avg({x}) FILTER (market_id = 'M7'), 6) AS probe_mean,
 round(avg({x}) FILTER (market_id <> 'M7'), 6) AS rest_mean, round(coalesce(stddev_pop({x}) FILTER (market_id = 'M7'), 0), 6) AS probe_std, round(stddev_pop({x}) FILTER (market_id <> 'M7'), 6) AS rest_std FROM evals""" for x in _ANS[:4]))
def _(t):
    got = research.probe_vs_rest(t.evals, _ANS[:4], col("market_id") == "M7")
    return got.select("name", "n_probe", "n_rest", *[r(c, c) for c in ("probe_mean", "rest_mean", "probe_std", "rest_std")])


@query("A25_group_means", using="evals", sql=f"""
SELECT market_id, {', '.join(f'round(avg({x}), 9) AS {x}' for x in _ANS)} FROM evals GROUP BY 1""")
def _(t):
    return research.group_means(t.evals, "market_id", _ANS).select("market_id", *[r(c, c, 9) for c in _ANS])


@query("A26_verdicts", using="ab", sql=f"""
WITH s AS ({' UNION ALL '.join(f"SELECT '{x}' AS name, stddev_pop({x}) AS std FROM ab" for x in _ANS)}),
d AS ({' UNION ALL '.join(f"SELECT '{x}' AS name, avg(abs(q.{x} - c.{x})) AS m, greatest(count(*) FILTER (q.{x} - c.{x} >= 0.05) / count(*) FILTER (abs(q.{x} - c.{x}) >= 0.05), 1 - count(*) FILTER (q.{x} - c.{x} >= 0.05) / count(*) FILTER (abs(q.{x} - c.{x}) >= 0.05)) AS sa FROM ab c JOIN ab q ON c.pair_id = q.pair_id AND c.variant = 'CONTROL' AND q.variant = 'QUANT'" for x in _ANS)}),
c AS ({' UNION ALL '.join(f"SELECT corr({x}, drift_1s_pp) AS r FROM ab" for x in _ANS)})
SELECT count(*) FILTER (std < 0.05) AS flat, count(*) FILTER (std >= 0.1) AS varied, count(*) FILTER (m >= 0.05) AS moved, count(*) FILTER (std < 0.05) >= 6 AS ignores_state,
 (count(*) FILTER (std >= 0.1) >= 4 AND count(*) FILTER (m >= 0.05) = 0) AS state_not_quant, (count(*) FILTER (std >= 0.1) >= 4 AND count(*) FILTER (m >= 0.1 AND sa >= 0.75) >= 2) AS uses_both,
 ((count(*) FILTER (std >= 0.1) >= 4 AND count(*) FILTER (m >= 0.05) = 0) OR (count(*) FILTER (std >= 0.1) >= 4 AND count(*) FILTER (m >= 0.1 AND sa >= 0.75) >= 2)) AND (SELECT count(*) FROM c WHERE abs(r) >= 0.15) = 0 AS reacts_without_markout FROM s JOIN d USING (name)""")
def _(t):
    stats = research.variance_split(t.ab, _ANS, "market_id")
    deltas = research.paired_delta_stats(reports.paired(t.ab, "CONTROL", "QUANT", _ANS), _ANS)
    return research.verdicts(stats, deltas, research.corr_matrix(t.ab, _ANS, ["drift_1s_pp"]))


@query("A26_branch_verdict", using="evals", sql="""
WITH v AS (SELECT variant, stddev_pop(underreact_up) AS s FROM evals GROUP BY 1), o AS (SELECT list_sort(list(underreact_up)) AS l, count(underreact_up) AS n FROM evals),
b AS (SELECT (underreact_up > l[floor(n * 0.2::DOUBLE)::BIGINT + 1])::INT + (underreact_up > l[floor(n * 0.4::DOUBLE)::BIGINT + 1])::INT + (underreact_up > l[floor(n * 0.6::DOUBLE)::BIGINT + 1])::INT + (underreact_up > l[floor(n * 0.8::DOUBLE)::BIGINT + 1])::INT AS k, avg(drift_1s_pp) AS m FROM evals, o GROUP BY 1),
w AS (SELECT stddev_pop(underreact_up) AS std, count(*) FILTER (drift_1s_pp IS NOT NULL AND underreact_up IS NOT NULL) AS n, corr(underreact_up, drift_1s_pp) AS r FROM evals),
q AS (SELECT CASE WHEN count(m) < 5 THEN greatest(max(m), 0) - least(min(m), 0) ELSE max(m) - min(m) END AS x FROM b)
SELECT round(std, 6) AS std, (SELECT round(min(s), 6) FROM v) AS std_least, (SELECT round(max(s), 6) FROM v) AS std_most, n, round(r, 6) AS r, round(x, 6) AS spread_pp,
 CASE WHEN std >= 0.1 AND abs(r) >= 0.3 AND n >= 50 AND x >= 1 THEN 1 WHEN std >= 0.1 THEN 2 ELSE 3 END AS branch FROM w, q""")
def _(t):
    rows = settle(t.evals.select("variant", "underreact_up", "drift_1s_pp"), "branch")
    got = research.branch_verdict(rows, "underreact_up", "drift_1s_pp", "variant")
    return got.select(*[r(c, c) if c not in ("n", "branch") else c for c in got.columns])


_CUTS = {"under_min": 0.3, "next_up_min": 0.2, "persist_min": 0.2, "fill_min": 0.3, "toxic_max": 0.35, "conflict_max": 0.7, "no_pressure_max": 0.3}


def _gate(c):
    return (f"underreact_up > {c['under_min']} AND p_up > {c['next_up_min']} AND move_persists > {c['persist_min']} AND fill_before_decay > {c['fill_min']} "
            f"AND fill_toxic < {c['toxic_max']} AND underreact_down < {c['conflict_max']} AND no_pressure_5s < {c['no_pressure_max']}")


from tapelab.functions.decisions import GATES  # noqa: E402


@query("A27_gate_report", using="evals", sql="\nUNION ALL ".join(
    f"SELECT '{a}' AS signal, count({a}) AS n, min({a}) AS min, round(avg({a}), 9) AS mean, max({a}) AS max, count(*) FILTER ({a} {'>' if up else '<'} {_CUTS[n]}) AS passed FROM evals" for n, a, up in GATES)
    + f" UNION ALL SELECT 'CONJUNCTION', count(*), NULL, NULL, NULL, count(*) FILTER ({_gate(_CUTS)}) FROM evals")
def _(t):
    return research.gate_report(t.evals, _CUTS).withColumn("mean", r("mean", "x", 9))


@query("A36_latency_profile", using="evals", sql="""
SELECT variant, count(*) AS n, quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.75) AS p75, quantile_disc(latency_ms, 0.9) AS p90, quantile_disc(latency_ms, 0.95) AS p95,
 quantile_disc(latency_ms, 0.99) AS p99, quantile_disc(latency_ms, 0.999) AS p999, max(latency_ms) AS max FROM evals GROUP BY 1""")
def _(t):
    return research.latency_profile(t.evals, ["variant"], "latency_ms", 1_000_000)


_GRID = [{"under_min": u, "next_up_min": 0.1, "persist_min": p, "fill_min": 0.3, "toxic_max": x, "conflict_max": 0.7, "no_pressure_max": 0.3}
         for u in (0.2, 0.4, 0.6) for p in (0.1, 0.5) for x in (0.2, 0.35)]


@query("J18_sweep_grid", using="evals", sql="""
WITH g AS (SELECT row_number() OVER (ORDER BY u, p, x) - 1 AS param_id, u, p, x FROM (SELECT unnest([0.2::DOUBLE, 0.4, 0.6]) AS u), (SELECT unnest([0.1::DOUBLE, 0.5]) AS p), (SELECT unnest([0.2::DOUBLE, 0.35]) AS x))
SELECT param_id, u AS under_min, p AS persist_min, x AS toxic_max, (SELECT count(*) FROM evals WHERE underreact_up > u AND move_persists > p AND fill_toxic < x) AS n_pass FROM g""")
def _(t):
    grid = research.sweep_grid(t.spark, under_min=[0.2, 0.4, 0.6], persist_min=[0.1, 0.5], toxic_max=[0.2, 0.35])
    sets = [{**_CUTS, "next_up_min": -1.0, "fill_min": -10.0, "conflict_max": 10.0, "no_pressure_max": 10.0, "under_min": u, "persist_min": p, "toxic_max": x}
            for u in (0.2, 0.4, 0.6) for p in (0.1, 0.5) for x in (0.2, 0.35)]
    passes = research.sweep_report(t.evals, sets, []).select("param_id", "n_pass")
    return grid.join(passes, "param_id")


@query("A37_sweep_report", using="evals", sql="\nUNION ALL ".join(
    f"SELECT split, count(*) AS n_evaluated, {i} AS param_id, count(*) FILTER ({_gate(c)}) AS n_pass FROM evals GROUP BY 1" for i, c in enumerate(_GRID)))
def _(t):
    return research.sweep_report(t.evals, _GRID, ["split"])


_FIRST, _SPAN = 800000000000, 20000000000


def _windows(t):
    return walkforward.plan_windows(t.spark, _FIRST, 1009843200000, 3 * _SPAN, _SPAN, _SPAN, embargo_ms=60_000)


_WSQL = f"""w AS (SELECT 'w' || lpad(k::VARCHAR, 2, '0') AS name, {_FIRST} + k * {_SPAN} AS train_start_ms, {_FIRST} + k * {_SPAN} + {3 * _SPAN} AS train_end_ms,
 {_FIRST} + k * {_SPAN} + {3 * _SPAN} + 60000 AS test_start_ms, {_FIRST} + k * {_SPAN} + {4 * _SPAN} + 60000 AS test_end_ms FROM range(0, 7) t(k) WHERE {_FIRST} + k * {_SPAN} + {4 * _SPAN} + 60000 <= 1009843200000)"""


@query("E22_plan_windows", using="evals", sql=f"""
WITH {_WSQL} SELECT w.*, (SELECT count(*) FROM evals e WHERE e.ts_ms >= train_start_ms AND e.ts_ms < train_end_ms) AS n_train FROM w""")
def _(t):
    win = _windows(t)
    got = walkforward.assign_windows(t.evals.select("ts_ms"), win, "ts_ms", _SPAN)
    n = got.where(col("assignment") == "IN_SAMPLE").groupBy("name").agg(F.count(F.lit(1)).alias("n_train"))
    return win.join(n, "name", "left").fillna(0, subset=["n_train"])


@query("E23_purge_train", using="spans", sql=f"""
WITH {_WSQL} SELECT condition_id, name, NOT (info_start_ms > 0 AND info_start_ms <= resolution_ms AND resolution_ms <= train_end_ms - 5000000000) AS purged FROM spans JOIN w ON info_start_ms >= train_start_ms AND info_start_ms < train_end_ms""")
def _(t):
    got = walkforward.assign_windows(t.spans, _windows(t), "info_start_ms", _SPAN).where(col("assignment") == "IN_SAMPLE")
    return walkforward.purge_train(got, "train_end_ms", 5_000_000_000).select("condition_id", "name", "purged")


@query("E24_purge_embargo", using="spans", sql="""
SELECT condition_id, CASE WHEN NOT (info_start_ms > 0 AND info_start_ms <= resolution_ms AND resolution_ms <= 970000000000 - 1000000000) THEN 'purge'
 WHEN (info_start_ms >= 975000000000 AND info_start_ms < 975000000000 + 5000000000) OR (info_start_ms < 975000000000 AND resolution_ms >= 975000000000) THEN 'embargo' END AS drop_reason FROM spans""")
def _(t):
    return walkforward.purge_embargo(t.spans, 970_000_000_000, 975_000_000_000, 1_000_000_000, 5_000_000_000).select("condition_id", "drop_reason")


@query("E25_embargo_flags", using="evals", sql="""
WITH m AS (SELECT ts_ms // 20000000000 AS k, min(ts_ms) AS train_start_ms, max(ts_ms) + 1 AS test_end_ms FROM evals GROUP BY 1),
n AS (SELECT *, lead(train_start_ms) OVER (ORDER BY train_start_ms) - test_end_ms AS gap_ms FROM m)
SELECT train_start_ms, test_end_ms, gap_ms, gap_ms < 86400000 AS requires_gap FROM n""")
def _(t):
    win = t.evals.groupBy(F.floor(col("ts_ms") / _SPAN).alias("k")).agg(
        F.min("ts_ms").alias("train_start_ms"), (F.max("ts_ms") + 1).alias("test_end_ms")
    )
    return walkforward.embargo_flags(win, DAY_MS).select("train_start_ms", "test_end_ms", "gap_ms", "requires_gap")


@query("E26_slice_windows", using="evals", sql=f"""
WITH {_WSQL} SELECT name, CASE WHEN ts_ms < train_end_ms THEN 'train' WHEN ts_ms < test_start_ms THEN 'embargo' ELSE 'test' END AS part, count(*) AS rows, count(DISTINCT market_id) AS markets
FROM evals JOIN w ON ts_ms >= train_start_ms AND ts_ms < test_end_ms GROUP BY 1, 2""")
def _(t):
    got = walkforward.slice_windows(t.evals.select("ts_ms", "market_id"), _windows(t), "ts_ms", _SPAN)
    return walkforward.slice_counts(got, "market_id")


@query("A38_walkforward", using="evals", sql=f"""
WITH {_WSQL}, f AS (SELECT name, avg(drift_5s_pp) AS cut FROM evals JOIN w ON ts_ms >= train_start_ms AND ts_ms < train_end_ms GROUP BY 1)
SELECT w.name, round(max(cut), 6) AS cut, count(*) AS n, count(*) FILTER (drift_5s_pp > cut) AS n_above FROM evals JOIN w ON ts_ms >= test_start_ms AND ts_ms < test_end_ms JOIN f ON f.name = w.name GROUP BY 1""")
def _(t):
    rows = walkforward.assign_windows(t.evals.select("ts_ms", "drift_5s_pp"), _windows(t), "ts_ms", _SPAN)
    got = walkforward.walkforward(
        rows, lambda d: d.groupBy("name").agg(F.avg("drift_5s_pp").alias("cut")),
        lambda d: d.groupBy("name").agg(r(F.max("cut"), "cut"), F.count(F.lit(1)).alias("n"), F.count_if(col("drift_5s_pp") > col("cut")).alias("n_above")),
    )
    return got


_HIST = {"maker_rate": 0.0, "taker_rate": 0.02, "maker_rebate": 0.001, "label": "historical"}
_CUR = {"maker_rate": 0.0, "taker_rate": 0.07, "maker_rebate": 0.0, "label": "current"}


@query("P29_apply_fees", using="episodes", sql="""
WITH k AS (SELECT *, CASE WHEN is_filled THEN actual_notional_usd ELSE CASE WHEN l_linenumber = 6 THEN 5 ELSE 0 END END AS f, CASE WHEN l_linenumber = 7 THEN -1 WHEN is_filled THEN actual_notional_usd / 2 ELSE 0 END AS x,
 CASE WHEN is_filled OR l_linenumber = 5 THEN gross_pnl_usd ELSE 0 END AS g FROM episodes),
z AS (SELECT *, CASE WHEN x < 0 THEN 'exit_notional' WHEN f + x = 0 AND is_filled THEN 'zero_notional_filled' WHEN f + x = 0 AND g <> 0 THEN 'no_fill_with_gross' WHEN f + x > 0 AND NOT is_filled THEN 'notional_on_no_fill' END AS fee_reject FROM k)
SELECT episode_id, actual_notional_usd, fee_reject, CASE WHEN fee_reject IS NULL THEN round(CASE WHEN is_maker THEN 0 ELSE (f + x) * 0.02::DOUBLE END, 6) END AS fees_usd,
 CASE WHEN fee_reject IS NULL THEN round(g - CASE WHEN is_maker THEN 0 ELSE (f + x) * 0.02::DOUBLE END, 6) + 0.0::DOUBLE END AS net_pnl_usd, CASE WHEN fee_reject IS NULL THEN round(g - CASE WHEN is_maker THEN 0 ELSE (f + x) * 0.07::DOUBLE END, 6) + 0.0::DOUBLE END AS pnl_current_usd FROM z""")
def _(t):
    filled = col("is_filled")
    df = t.episodes.withColumns(
        {
            "fill_notional": F.when(filled, col("actual_notional_usd")).otherwise(F.when(col("l_linenumber") == 6, 5.0).otherwise(0.0)),
            "exit_notional": F.when(col("l_linenumber") == 7, -1.0).when(filled, col("actual_notional_usd") / 2).otherwise(0.0),
            "gross_pnl_usd": F.when(filled | (col("l_linenumber") == 5), col("gross_pnl_usd")).otherwise(0.0),
            "no_fill": ~filled,
        }
    )
    got = accounting.apply_fees(df, _HIST, _CUR)
    return got.select("episode_id", "actual_notional_usd", "fee_reject", r("fees_usd", "fees_usd", 6), r("net_pnl_usd", "net_pnl_usd", 6), r("pnl_current_usd", "pnl_current_usd", 6))


@query("P30_settle_resolution", using="episodes", sql="""
WITH k AS (SELECT *, CASE WHEN NOT is_filled THEN 'not_filled' WHEN l_linenumber = 5 THEN 'no_resolution' WHEN l_linenumber = 6 THEN 'resolution_before_fill' END AS settle_reject,
 CASE WHEN (l_linenumber % 2 = 0) = (o_custkey % 3 = 0) THEN 1.0 ELSE 0.0 END AS pay FROM episodes)
SELECT episode_id, actual_notional_usd, settle_reject, CASE WHEN settle_reject IS NULL THEN pay::DOUBLE END AS exit_price, CASE WHEN settle_reject IS NULL THEN round(fill_qty * (pay - fill_price), 6) END AS gross_pnl_usd FROM k""")
def _(t):
    df = t.episodes.withColumns(
        {
            "side": F.when(col("l_linenumber") % 2 == 0, "BUY_YES").otherwise("BUY_NO"),
            "yes_won": F.when(col("l_linenumber") != 5, col("o_custkey") % 3 == 0),
            "resolution_ts_ms": F.when(col("l_linenumber") == 6, col("fill_ts_ms") - 1).otherwise(col("exit_ts_ms")),
        }
    )
    got = accounting.settle_resolution(df)
    return got.select("episode_id", "actual_notional_usd", "settle_reject", "exit_price", r("gross_pnl_usd", "gross_pnl_usd"))


@query("P30_settle_hedge", using="ab", sql="""
WITH e AS (SELECT * FROM ab WHERE variant = 'CONTROL'), h AS (SELECT * FROM ab WHERE variant = 'QUANT'),
k AS (SELECT e.pair_id, e.fair_p_yes AS ep, e.ts_ms AS ets, h.fair_p_yes AS hp, h.ts_ms AS hts, h.pair_id AS hid, e.l_partkey AS pk FROM e LEFT JOIN h USING (pair_id)),
z AS (SELECT *, CASE WHEN ep <= 0 OR ep >= 1 THEN 'fill_price' WHEN hid IS NULL THEN 'not_filled' WHEN hp <= 0 OR hp >= 1 THEN 'fill_price' WHEN ets > hts THEN 'hedge_before_entry' WHEN pk % 5 = 0 THEN 'quantity_mismatch' END AS hedge_reject FROM k)
SELECT pair_id, hedge_reject, CASE WHEN hedge_reject IS NULL THEN round(10 * (1 - hp - ep), 6) + 0.0::DOUBLE END AS gross_pnl_usd, CASE WHEN hedge_reject IS NULL THEN 'hedge:' || pair_id END AS hedge_pair_id FROM z""")
def _(t):
    def legs(variant, side, qty):
        return t.ab.where(col("variant") == variant).select(
            "pair_id", F.lit(side).alias("side"), (col("ts_ms") - 1).alias("order_arrival_ts_ms"), col("ts_ms").alias("fill_ts_ms"),
            col("fair_p_yes").alias("fill_price"), qty.alias("fill_qty"),
        )
    got = accounting.settle_hedge(
        legs("CONTROL", "BUY_YES", F.when(col("l_partkey") % 5 == 0, 11.0).otherwise(10.0)), legs("QUANT", "BUY_NO", F.lit(10.0)), "pair_id"
    )
    return got.select("pair_id", "hedge_reject", r("gross_pnl_usd", "gross_pnl_usd"), "hedge_pair_id")


@query("P30_merge_pair", using="evals", sql="""
SELECT pair_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN stale_skipped THEN NULL ELSE round(move_persists - (fair_p_yes + pressure), 6) + 0.0::DOUBLE END AS locked_pnl,
 (fair_p_yes > 0 AND fair_p_yes < 1 AND pressure > 0 AND pressure < 1 AND fair_p_yes + pressure <= 1.0 - 0.05 + 1e-12) AS hedge_ok FROM evals""")
def _(t):
    qty = F.when(col("stale_skipped"), 0.0).otherwise(col("move_persists"))
    got = accounting.merge_pair(col("fair_p_yes"), col("pressure"), qty)
    return t.evals.select(
        "pair_id", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", r(got["locked_pnl"], "locked_pnl"),
        accounting.should_hedge_profit(col("fair_p_yes"), col("pressure"), F.lit(0.05)).alias("hedge_ok"),
    )


@query("P31_execution_path", using="episodes", sql="""
SELECT CASE WHEN l_linenumber > 5 OR l_linenumber = 1 THEN 'UNKNOWN' ELSE CASE WHEN is_maker THEN 'MAKER' ELSE 'TAKER' END || '_ENTRY_' || CASE WHEN l_linenumber % 2 = 0 THEN 'MAKER' ELSE 'TAKER' END || '_EXIT' END AS execution_path,
 count(*) AS n, count(*) FILTER (l_linenumber = 3) AS n_exact FROM episodes GROUP BY 1""")
def _(t):
    entry = F.when(col("l_linenumber") <= 5, F.when(col("is_maker"), "maker").otherwise("taker"))
    leave = F.when(col("l_linenumber") == 1, "other").when(col("l_linenumber") % 2 == 0, "maker").otherwise("taker")
    path = accounting.execution_path(entry, leave)
    prov = F.when(col("l_linenumber") == 3, "exact").when(col("l_linenumber") == 4, "proxy")
    return t.episodes.groupBy(F.coalesce(path["execution_path"], F.lit("UNKNOWN")).alias("execution_path")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(accounting.resolution_filter(prov, True)).alias("n_exact")
    )


@query("P32_validate_episodes", using="episodes", sql="""
WITH k AS (SELECT *, f0 - 500 - l_linenumber * 100 AS sig, CASE WHEN l_linenumber = 4 THEN 500 ELSE 50 END AS sub FROM episodes)
SELECT episode_id, actual_notional_usd, sig + 400 + sub AS order_arrival_ts_ms,
 CASE WHEN fill_ts_ms < sig + 400 + sub THEN 'fill_before_arrival' WHEN is_filled AND l_linenumber = 5 THEN 'exit_before_fill'
  WHEN is_filled AND l_linenumber = 6 THEN 'resolution_before_fill' WHEN l_linenumber = 7 THEN 'net_invariant' END AS violation,
 round(coalesce(stake_usd * greatest(CASE WHEN l_linenumber = 5 THEN -1 ELSE exit_ts_ms - fill_ts_ms END, 0) / 1000, 0), 2) AS capital_seconds_usd_s FROM k""")
def _(t):
    n = col("l_linenumber")
    df = t.episodes.withColumns(
        {
            "signal_ts_ms": col("f0") - 500 - n * 100, "judge_latency_ms": F.lit(400), "submit_latency_ms": F.when(n == 4, 500).otherwise(50),
            "limit_price": col("stake_usd"), "fill_price": F.when(col("is_filled"), col("fill_price")), "fill_qty": F.when(col("is_filled"), col("fill_qty")),
            "exit_ts_ms": F.when(n == 5, col("fill_ts_ms") - 1).otherwise(col("exit_ts_ms")),
            "resolution_at_ms": F.when(n == 6, col("fill_ts_ms") - 1).otherwise(col("exit_ts_ms")), "rebates_usd": F.when(n == 7, 1.0).otherwise(0.0),
        }
    )
    got = accounting.validate_episodes(df)
    return got.select("episode_id", "actual_notional_usd", "order_arrival_ts_ms", "violation", r("capital_seconds_usd_s", "capital_seconds_usd_s", 2))
