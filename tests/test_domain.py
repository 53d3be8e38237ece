import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tapelab import session
from tapelab.functions import accounting, decisions, prices, quant, signals, text, times
from tapelab.operators import bootstrap, fills, indicators, ledger, lookups, quality, walkforward
from tapelab.plans import features


def one(df):
    return df.collect()[0]


def test_tick_regression_and_candidate(spark):
    row = one(spark.range(1).select(
        prices.to_micros(F.lit(0.7774992903471105)).alias("m"),
        prices.is_tick_multiple(F.lit(0.7774992903471105), F.lit(0.0025)).alias("on"),
        prices.candidate_micros(F.lit(400000), F.lit(500000), F.lit(10000)).alias("c"),
        prices.candidate_micros(F.lit(405000), F.lit(500000), F.lit(10000)).alias("up"),
        prices.candidate_micros(F.lit(400000), F.lit(410000), F.lit(10000)).alias("none"),
    ))
    assert (row.m, row.on, row.c, row.up, row.none) == (777499, False, 410000, 420000, None)


def test_complement_reasons(spark):
    rows = [(0.4, 0.5, 1.0, 2.0), (0.6, 0.5, 1.0, 1.0), (1.2, 0.5, 1.0, 1.0), (0.4, 0.5, -1.0, 1.0), (float("nan"), 0.5, 1.0, 1.0)]
    got = prices.complement(spark.createDataFrame(rows, "no_bid double, no_ask double, no_bid_size double, no_ask_size double")).collect()
    assert [r.reject_reason for r in got] == [None, "bad_spread", "range", "range", "range"]
    assert (got[0].yes_bid, got[0].yes_ask, got[0].yes_bid_size) == (0.5, 0.6, 2.0)


def test_quant_golden(spark):
    base = dict(ret_1s_pct=0.0, realized_vol_1m_pct=0.01, realized_vol_5m_pct=0.01, spot=100.0, target=100.0, distance_to_target_pct=-0.1, time_remaining_secs=3600)
    row = one(quant.quant_features(spark.createDataFrame([tuple(base.values())], list(base))))
    assert row.distance_sigma == pytest.approx(-0.1 / 0.6)
    d2 = -0.5 * 0.0001**2 * 3600 / (0.0001 * 60)
    assert row.quant_baseline_p_yes == pytest.approx(0.5 * math.erfc(-d2 / math.sqrt(2)), abs=1e-12)


def test_normal_distribution_function(spark):
    z = [-40.0, -37.5, -10.0, -5.0, -3.0001, -3.0, -2.0, -1e-9, 0.0, 0.3, 1.0, 2.9, 3.0, 3.1, 6.0, 9.0, 40.0]
    got = spark.createDataFrame([(x,) for x in z], "z double").select("z", quant.normal_cdf(F.col("z")).alias("p")).collect()
    for r in got:
        want = 0.5 * math.erfc(-r.z / math.sqrt(2))
        assert r.p == pytest.approx(want, abs=1e-13, rel=1e-9), r
    assert one(spark.range(1).select(quant.normal_cdf(F.lit(None).cast("double")).alias("p"))).p is None


def test_epoch_units(spark):
    raw = ["1700000000", "1700000000123", "1700000000123456", "1700000000123456789", "2023-11-14T22:13:20Z", "2023-11-14T23:13:20+01:00", "NaT", "", "x"]
    got = [r.m for r in spark.createDataFrame([(x,) for x in raw], "s string").select(times.epoch_ms(F.col("s")).alias("m")).collect()]
    assert got == [1700000000000, 1700000000123, 1700000000123, 1700000000123, 1700000000000, 1700000000000, None, None, None]


def test_window_respects_daylight_saving(spark):
    q = spark.createDataFrame([("BTC - April 28, 1:00PM-1:15PM ET", 2026), ("BTC - January 5, 12:00AM-12:05AM ET", 2026), ("no window", 2026), ("Smarch 3, 1:00PM-1:15PM ET", 2026)], "q string, y int")
    got = q.select(*[v.alias(k) for k, v in text.parse_window(F.col("q"), F.col("y")).items()]).collect()
    assert (got[0].start_ms, got[0].end_ms - got[0].start_ms) == (1777395600000, 900000)
    assert got[1].start_ms == 1767589200000
    assert got[2].start_ms is None and got[3].start_ms is None


#: Texts with the strike that a reader picks by hand.
STRIKES = [
    ("Will Bitcoin be above $97,500 on May 3?", "Uses the 5m candle of BTC/USDT.", "BTC", 97_500.0),
    ("ETH above 2500 at 4PM?", "Resolves by 12 sources", "ETH", 2_500.0),
    ("Will BTC reach 100k?", "", "BTC", 100_000.0),
    ("Ethereum below 3.5k or over $3,400.50", "x 1,000 y", "ETH", 3_400.0),
    ("nothing here", "5 10 15", "", None),
    ("", "", "", None),
]


def strikes(spark, cases):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "id int, q string, r string")
    got = {r.id: (r.reference, r.strike) for r in text.extract_strike(df, "q", "r").collect()}
    return [got[i] for i in range(len(cases))]


def test_strikes_worked_by_hand(spark):
    assert strikes(spark, [c[:2] for c in STRIKES]) == [c[2:] for c in STRIKES]


def test_strike_properties(spark):
    base = "Will Bitcoin be above $97,500 on May 3?"
    weaker = [(base, more) for more in ("", "see 12 rules", "page 4 of 9", "about 2.5k", "above 250")]
    assert {s for _, s in strikes(spark, weaker)} == {97_500.0}
    # of equal marks the earlier counts; a mark more beats the order
    pairs = [("BTC above $90,000 or above $95,000", ""), ("BTC above $95,000 or above $90,000", ""), ("Bitcoin above 300 or $400", ""), ("Bitcoin above $400 or 300", "")]
    assert [s for _, s in strikes(spark, pairs)] == [90_000.0, 95_000.0, 400.0, 400.0]


def test_strike_on_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source")
    found = {r.doc_id: r for r in text.extract_strike(docs, "text", "source").collect()}
    assert len(found) == docs.count()
    # a strong number at the front of a long text beats what the text holds
    front = docs.withColumn("text", F.concat(F.lit("Bitcoin above $123,456 today. "), "text"))
    assert {(r.reference, r.strike) for r in text.extract_strike(front, "text", "source").collect()} == {("BTC", 123_456.0)}


def test_signal_rules(spark):
    import json

    good = {n: {"type": "noul", "noul": 0.5} for n in signals.PROBABILITY_ANSWERS}
    probs = dict.fromkeys(signals.BUCKETS, 0.0) | {"UP_1_TICK": 0.6, "FLAT": 0.41}
    good["repricing_ticks"] = {"type": "choice", "probabilities": probs, "confidence": 0.9}

    def alter(path, value):
        body = json.loads(json.dumps(good))
        node = body
        for p in path[:-1]:
            node = node[p]
        if value is None:
            node.pop(path[-1])
        else:
            node[path[-1]] = value
        return json.dumps({"answers": body})

    cases = {
        None: json.dumps({"answers": good}), "json": "{not json", "missing_answer:fill_toxic": alter(["fill_toxic"], None),
        "answer_type:move_persists": alter(["move_persists", "type"], "choice"), "probability:underreact_up": alter(["underreact_up", "noul"], 1.5),
        "missing_bucket": alter(["repricing_ticks", "probabilities", "FLAT"], None), "unexpected_bucket": alter(["repricing_ticks", "probabilities", "X"], 0.1),
        "distribution_sum": alter(["repricing_ticks", "probabilities", "FLAT"], 0.5), "missing_field:repricing_ticks.confidence": alter(["repricing_ticks", "confidence"], None),
        "confidence": alter(["repricing_ticks", "confidence"], 2.0),
    }
    df = spark.createDataFrame(list(cases.items()), "want string, j string")
    for r in signals.parse_signal(df, "j").collect():
        assert r.signal_error == r.want
        assert (r.signal is None) == (r.want is not None)
    row = one(signals.parse_signal(df.where("want is null"), "j"))
    assert row.signal.p_up == pytest.approx(0.6)


def test_causality(spark):
    df = spark.createDataFrame([(10, [("a", 10), ("b", 11)], "{}"), (10, [("a", 10)], '{"x":[{"resolved_ts_ms":1}]}'), (10, [("a", 9)], '{"s":"\\"outcome\\": yes"}')],
                               "t long, i array<struct<name:string, ts_ms:long>>, j string")
    got = signals.audit_causality(df, "t", "i", "j").collect()
    assert [(r.verdict, r.late_input, r.forbidden_field) for r in got] == [("future_input", "b", None), ("forbidden_field", None, "resolved_ts_ms"), ("ok", None, None)]


def test_latency_sampling_matches_the_published_generator(spark):
    def mix(x):
        m = 2**64 - 1
        z = (x + 0x9E3779B97F4A7C15) & m
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & m
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & m
        return z ^ (z >> 31)

    samples = [307, 1019, 5]
    got = {r.id: r.v for r in spark.range(50).select("id", decisions.sample_latency(F.col("id"), samples, 42).alias("v")).collect()}
    assert got == {i: samples[mix(42 + i) % 3] for i in range(50)}
    # The bootstrap takes the generator's stream: value k has state seed + (k + 1) * gamma.
    rows = spark.createDataFrame([("b1", 1.0), ("b2", 10.0), ("b2", 5.0), ("b3", 100.0)], "b string, v double")
    totals = {r["index"]: r.total for r in bootstrap.dense_blocks(rows, "b", "v").collect()}
    assert sorted(totals) == [0, 1, 2] and sorted(totals.values()) == [1.0, 15.0, 100.0]
    gamma = 0x9E3779B97F4A7C15
    draws = {r.draw: r.total for r in bootstrap.block_bootstrap(rows, "b", "v", draws=20, seed=7).collect()}
    for d in range(20):
        want = sum(totals[mix((7 + (d * 3 + i) * gamma) % 2**64) % 3] for i in range(3))
        assert draws[d] == pytest.approx(want)


def test_bootstrap_makes_each_pick_once(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "CHUNK", 4)
    monkeypatch.setattr(bootstrap, "PICKS", 5)
    rows = spark.createDataFrame([(f"b{i % 19}", float(i)) for i in range(60)] + [(None, 1.5), ("b1", None), ("b2", float("nan"))], "b string, v double").repartition(5)
    blocks = bootstrap.dense_blocks(rows, "b", "v")
    folder, size = bootstrap.stored_totals(blocks)
    totals = [r.total for r in blocks.orderBy("index").collect()]
    assert size == len(totals) == 20
    got = bootstrap.drawn(spark, folder, size, 300, 7).collect()
    assert sorted(r.draw for r in got) == list(range(300)) and sum(r.picks for r in got) == 300 * 20
    m, gamma = 2**64 - 1, 0x9E3779B97F4A7C15
    for r in got:
        want = 0.0
        for i in range(20):
            z = (7 + (r.draw * 20 + i + 1) * gamma) & m
            z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & m
            z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & m
            want += totals[(z ^ (z >> 31)) % 20]
        assert r.total == pytest.approx(want)
    assert bootstrap.block_bootstrap(rows.limit(0), "b", "v").count() == 0


EP = "episode_id string, is_filled boolean, gross_pnl_usd double, net_pnl_usd double, pnl_current_usd double, actual_notional_usd double, capital_seconds_usd_s double, exit_type string, is_maker boolean, markout_5s_pp double, fill_ts_ms long, exit_ts_ms long"


def test_economy_golden(spark):
    rows = [("a", True, 7.5, 7.5, 7.0, 10.0, 50.0, "resolution", True, 1.0, 0, 10), ("b", True, 0.3, 0.3, None, 5.0, 10.0, "hedge", True, -3.0, 5, 20), ("c", False, 0.0, 0.0, None, 0.0, 0.0, "no_fill", None, None, None, None)]
    row = one(ledger.economy_summary(spark.createDataFrame(rows, EP), []))
    assert row.fill_rate == pytest.approx(2 / 3)
    assert row.gross_pnl_usd == pytest.approx(7.8) and row.pnl_per_trade == pytest.approx(3.9)
    assert row.roi_on_used_capital == pytest.approx(0.52)
    assert row.profit_factor is None and row.max_drawdown_usd == 0.0
    assert row.max_simultaneous_capital_usd == 15.0 and row.adverse_selection_pp == -1.0
    assert (row.hold_pnl_usd, row.hedge_pnl_usd, row.current_net_usd) == (7.5, 0.3, 7.0)


def test_release_before_add(spark):
    rows = [("a", True, 0.0, -5.0, None, 10.0, 0.0, "sell", True, None, 0, 10), ("b", True, 0.0, 2.0, None, 4.0, 0.0, "sell", True, None, 10, 20)]
    row = one(ledger.economy_summary(spark.createDataFrame(rows, EP), []))
    assert row.max_simultaneous_capital_usd == 10.0 and row.max_drawdown_usd == 5.0


def test_portfolio_golden(spark):
    key = ["k"]
    f = spark.createDataFrame([("k", 0.40, 10.0, False)], "k string, price double, size double, toxic boolean")
    m = spark.createDataFrame([("k", 0.42, 1)], "k string, mid double, ts_ms long")
    none = spark.createDataFrame([], "k string, price double, size double")
    assert one(ledger.portfolio(f, none, m, key)).unrealized_pp == pytest.approx(20.0)
    x = spark.createDataFrame([("k", 0.43, 10.0)], "k string, price double, size double")
    row = one(ledger.portfolio(f, x, m, key))
    assert row.realized_pp == pytest.approx(30.0) and row.inventory == 0.0 and row.exposure == 0.0


@pytest.mark.parametrize("qty,fraction", [(15.0, 0.5), (60.0, 1.0)])
def test_conservative_fill_golden(spark, qty, fraction):
    order = spark.createDataFrame([(1, "m", 43, 10.0, 0, 100, True)], "order_id long, market string, level long, size double, arrival_ms long, end_ms long, side_buy boolean")
    prints = spark.createDataFrame([("m", 5, 42, qty, "UNKNOWN"), ("m", 6, 42, qty, "UNKNOWN")], "market string, ts_ms long, level long, qty double, aggressor string")
    row = one(fills.fill_labels(order, prints, "CONSERVATIVE", width=3))
    assert (row.filled, row.fill_fraction, row.fill_ts_ms) == (True, fraction, 6)


def test_fees_and_validity(spark):
    rows = [(10.0, 100.0, 50.0, False, False), (0.0, 0.0, 0.0, False, True), (1.0, 0.0, 0.0, True, True), (1.0, 0.0, 0.0, True, False), (1.0, -1.0, 0.0, True, False)]
    df = spark.createDataFrame(rows, "gross_pnl_usd double, fill_notional double, exit_notional double, is_maker boolean, no_fill boolean")
    zero = {"maker_rate": 0.0, "taker_rate": 0.02, "maker_rebate": 0.01, "label": "h"}
    got = accounting.apply_fees(df, zero, {**zero, "taker_rate": 0.07, "label": "c"}).collect()
    assert [r.fee_reject for r in got] == [None, None, "no_fill_with_gross", "zero_notional_filled", "fill_notional"]
    assert got[0].net_pnl_usd == pytest.approx(7.0) and got[0].pnl_current_usd == pytest.approx(-0.5)
    assert got[0].rebates_usd == 0.0 and got[0].upside_with_rebate_usd == pytest.approx(8.5)


def test_walkforward_golden(spark):
    win = walkforward.plan_windows(spark, 1000, 1300, 100, 50, 150).orderBy("name").collect()
    assert [tuple(r) for r in win] == [("w00", 1000, 1100, 1100, 1150), ("w01", 1150, 1250, 1250, 1300)]
    assert walkforward.plan_windows(spark, 0, 10, 1, 1, 1).count() == 0
    spans = spark.createDataFrame([("a", 1, 950), ("b", 1, 900), ("c", 1, 800)], "condition_id string, info_start_ms long, resolution_ms long")
    got = {r.condition_id: r.purged for r in walkforward.purge_train(spans, 1000, 100).collect()}
    assert got == {"a": True, "b": False, "c": False}
    seen = []
    rows = spark.createDataFrame([("w00", 1.0, "IN_SAMPLE"), ("w00", 99.0, "OUT_OF_SAMPLE")], "name string, v double, assignment string")

    def fit(d):
        seen.extend(r.v for r in d.collect())
        return d.groupBy("name").agg(F.max("v").alias("cut"))

    assert one(walkforward.walkforward(rows, fit, lambda d: d)).cut == 1.0 and seen == [1.0]


def test_indicators_golden():
    import numpy as np

    assert indicators.rsi(np.array([10.0, 12.0, 11.0, 14.0]), 2)[-1] == pytest.approx(800 / 9)
    assert indicators.rsi(np.array([5.0] * 4), 2)[-1] == 100.0
    x = np.arange(1.0, 11.0)
    assert indicators.ema(x, 3)[2] == 2.0 and indicators.ema(x, 3)[3] == 3.0
    assert np.isnan(indicators.ema(np.array([1.0, np.nan, 3.0]), 2)).all()
    a = indicators.adx(x + 1, x - 1, x, 2)
    assert np.isnan(a[:2]).all() and a[-1] == pytest.approx(100.0)


def test_positions_latch(spark):
    rows = [("k", i, c, 10.0, 10.0, r, 50.0) for i, (c, r) in enumerate([(9.0, 60.0), (11.0, 60.0), (12.0, 60.0), (13.0, 40.0), (14.0, 40.0), (15.0, 50.0)])]
    df = spark.createDataFrame(rows, "k string, d long, close double, sma50 double, ema7 double, rsi2 double, adx2 double")
    got = indicators.daily_positions(df, "k", "d", min_closed=1).orderBy("d").collect()
    assert [r.decision for r in got] == ["hold_no_signal", "enter_long_up", "hold_still_long", "exit_flat", "hold_no_signal", "hold_no_signal"]
    assert got[3].realized_pnl == 2.0 and got[2].since_day == 1


def test_admission_and_windows(spark):
    ticks = spark.createDataFrame([("a", 10, 0.1, 0.2), ("a", 11, None, 0.2), ("b", 10, 0.1, 0.2), ("c", 10, 0.1, 0.2), ("c", 10, 0.1, 0.2), ("a", 99, 0.1, 0.2)], "condition_id string, t long, bid double, ask double")
    markets = spark.createDataFrame([(m, 10) for m in "abcd"], "condition_id string, start_s long")
    got = {r.condition_id: r.drop_reason for r in quality.complete_windows(ticks, markets, 2).collect()}
    assert got == {"a": None, "b": "incomplete_1s_tick_window", "c": "duplicate_second", "d": "no_in_window_ticks"}
    gaps = quality.coverage_gaps(spark.createDataFrame([("x", 0), ("x", 3 * 86_400_000)], "s string, d long"), "s", "d")
    assert sorted(r.day for r in gaps.collect()) == [86_400_000, 2 * 86_400_000]


def test_windows_are_dealt_to_tasks_by_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS", 10)
    ticks = spark.range(200).selectExpr("id div 4 AS condition_id", "1 + id % 4 AS t", "0.1D AS bid", "0.2D AS ask")
    markets = spark.range(50).selectExpr("id AS condition_id", "1L AS start_s")
    got = quality.complete_windows(ticks, markets, 3)
    assert got.rdd.getNumPartitions() == 20
    assert got.where("drop_reason IS NULL AND out_of_window_rows = 1").count() == 50


def test_memo_budget(spark):
    states = spark.createDataFrame([("h1", 1), ("h2", 2), ("h2", 3), ("h3", 4), ("h4", 5)], "h string, ts long")
    cache = spark.createDataFrame([("h1", True, 1.0), ("h3", False, 2.0)], "h string, live boolean, result double")
    got = {r.ts: r.memo for r in lookups.memo_join(states, cache, ["h"], True, "ts", 2).collect()}
    assert got == {1: "hit", 2: "call", 3: "reuse", 4: "call", 5: "over_budget"}


def test_fee_rates_and_net_invariant(spark):
    rates = spark.createDataFrame([(x,) for x in (0.0, 0.5, 1.0, -0.1, float("nan"), None)], "x double")
    assert [r.ok for r in rates.select(accounting.valid_rate(F.col("x")).alias("ok")).collect()] == [True, True, False, False, False, False]
    rows = spark.createDataFrame([(1.0, 0.2, 0.1, 0.9), (1.0, 0.2, 0.0, 0.9), (float("inf"), 0.0, 0.0, 1.0)], "gross_pnl_usd double, fees_usd double, rebates_usd double, net_pnl_usd double")
    assert [r.ok for r in rows.select(accounting.net_invariant_ok(rows).alias("ok")).collect()] == [True, False, False]


def test_coverage_gaps_shuffle_no_generated_day(spark):
    day = 86_400_000
    rows = spark.createDataFrame([("x", 0), ("x", 0), ("x", 3 * day), ("x", 4 * day), ("y", 7 * day), (None, 0), (None, 2 * day)], "s string, d long")
    got = quality.coverage_gaps(rows, "s", "d")
    assert sorted((r.s or "", r.day // day) for r in got.collect()) == [("", 1), ("x", 1), ("x", 2)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_strategy_with_a_state_sees_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        rows = spark.range(100).select((F.col("id") % 3).alias("k"), (100 - F.col("id")).alias("ts"))

        def rule(state, pdf):
            return (state or 0) + len(pdf), pdf.assign(first=int(state is None), most=len(pdf), before=state or 0)

        got = features.strategy(rows, rule, ["k"], "k long, ts long, first long, most long, before long", ["ts"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 100 and max(r.most for r in got) <= 10
    for k in range(3):
        mine = sorted(r.ts for r in got if r.k == k)
        assert [r.ts for r in sorted((r for r in got if r.k == k), key=lambda r: (r.before, r.ts))] == mine
        assert {r.before for r in got if r.k == k and r.first} == {0}


def test_admission_reads_its_object_once(spark):
    names = ("timestamp", "state_hash", "observed_latency_ms", "error", *quality.PROBABILITIES, "repricing_confidence")
    good = '{"up_3_plus":0,"up_2":0,"up_1":0.5,"flat":"0.5","down_1":0,"down_2":0,"down_3_plus":0}'
    rows = spark.createDataFrame(
        [("t", "h", "1", None, *[0.5] * len(quality.PROBABILITIES), 0.5, True, x) for x in (good, good.replace("0.5", "0.7"), "{", None)],
        ", ".join(f"{n} {'string' if i < 4 else 'double'}" for i, n in enumerate(names)) + ", live boolean, repricing_ticks string",
    )
    got = quality.admit_evaluations(rows, True, False)
    assert [r.skip_reason for r in got.collect()] == [None, "malformed", "malformed", "malformed"]
    assert got.columns == [*rows.columns, "skip_reason"]
    assert "get_json_object" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_horizon_words_without_token_lists(spark):
    """Against lists of tokens, on texts of pieces of horizon words; no expression builds such a list."""
    horizon = {w: h for h, ws in text.HORIZON_WORDS.items() for w in ws}
    pieces = ["5", "15", "1", "4", "m", "h", "r", "hr", "hour", "our", "min", "mins", "s", "es", "5m", "15M", "1Hour", "x", "51", "m5", "é", "日本", "\U0001f600", "\n"]
    rng = random.Random(7)
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " ", "-", " \n-", "日"]) for _ in range(rng.randrange(9))) for _ in range(3000)]

    def want(value: str) -> str:
        tokens = [x for x in re.split("[^a-z0-9]+", value.lower()) if x]
        joined = [a + b for a, b in zip(tokens, tokens[1:], strict=False)]
        return next((horizon[x] for x in [*tokens, *joined] if x in horizon), "")

    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").withColumn("h", text.guess_horizon(F.col("t")))
    got = {r.id: r.h for r in df.collect()}
    assert [got[i] for i in range(len(texts))] == [want(t) for t in texts]
    assert len(set(got.values())) == 5
    assert "lambda" not in df._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("profile", list(fills.QUEUE_AHEAD))
def test_fill_evidence_is_computed_once(spark, profile):
    """The plan after the evidence reads it back; it neither reads blocks nor builds their arrays again."""
    orders = spark.createDataFrame([(1, "m", 10, 99, 43, 1.0, True)], "order_id long, market string, arrival_ms long, end_ms long, level long, size double, side_buy boolean")
    prints = spark.createDataFrame([("m", 20 + i, 42, 5.0, "SELL") for i in range(3)], "market string, ts_ms long, level long, qty double, aggressor string")
    got = fills.fill_labels(orders, prints, profile)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "_p.v" not in plan
    row = one(got)
    assert row.filled and row.fill_fraction == 1.0 and row.fill_ts_ms == (21 if profile == "CONSERVATIVE" else 20)
