import hashlib
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tapelab.operators import book, cooldown, fills, flow, intervals, regimes, research, sampling, scan


def rows(seed=3, n=200, span=500):
    rnd = random.Random(seed)
    return [("hot" if rnd.random() < 0.34 else rnd.choice("ab"), rnd.randrange(span), i, round(rnd.uniform(-1, 1), 3)) for i in range(n)]


@pytest.fixture(scope="module")
def data():
    return rows()


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame(data, "k string, ts long, seq long, v double").cache()


def by_key(data):
    out = {}
    for r in sorted(data, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("width", [7, 100_000])
def test_running_and_numbered(df, data, width):
    got = scan.running_sum(df, ["k"], "ts", {"s": F.col("v")}, ("seq",), width)
    got = {r.seq: r.s for r in got.collect()}
    num = {r.seq: (r._rn, r.n) for r in scan.numbered(df, ["k"], "ts", ("seq",), width, total="n").collect()}
    top = {r.seq: r.m for r in scan.running_max(df, ["k"], "ts", F.col("v"), "m", ("seq",), width).collect()}
    prev = {r.seq: r.prev_v for r in scan.previous_row(df, ["k"], "ts", ["v"], ("seq",), width).collect()}
    roll = {r.seq: r.a for r in scan.rows_window(df, ["k"], "ts", 4, {"a": F.sum("v")}, ("seq",), width, block=5).collect()}
    for part in by_key(data).values():
        total, last = 0.0, None
        for i, r in enumerate(part):
            total += r[3]
            assert got[r[2]] == pytest.approx(total)
            assert num[r[2]] == (i + 1, len(part))
            assert top[r[2]] == max(x[3] for x in part[: i + 1])
            assert prev[r[2]] == last
            assert roll[r[2]] == pytest.approx(sum(x[3] for x in part[max(0, i - 3) : i + 1]))
            last = r[3]


@pytest.mark.parametrize("width", [7, 100_000])
def test_one_pass_gives_all_outputs(df, data, width):
    outputs = {
        "sum": scan.total(F.col("v")), "low": scan.latest(F.when(F.col("v") < 0, F.col("v"))),
        "before": scan.latest(F.when(F.col("v") < 0, F.col("v")), inclusive=False), "top": scan.highest(F.col("v")),
        "rn": scan.number(), "n": scan.rows_of_key(), "prev": scan.previous("seq", "v"),
    }
    for frame, keys in ((df, ["k"]), (df, [])):
        got = scan.ordered(frame, keys, "ts", outputs, ("seq",), width)
        assert got.columns == [*frame.columns, *outputs]
        rows_ = {r.seq: r for r in got.collect()}
        parts = by_key(data).values() if keys else [sorted(data, key=lambda r: (r[1], r[2]))]
        for part in parts:
            total, low, top, prev = 0.0, None, None, None
            for i, r in enumerate(part):
                total, mine = total + r[3], rows_[r[2]]
                assert mine.before == low
                low = r[3] if r[3] < 0 else low
                top = r[3] if top is None else max(top, r[3])
                assert mine.sum == pytest.approx(total) and (mine.low, mine.top, mine.rn, mine.n) == (low, top, i + 1, len(part))
                assert (mine.prev and tuple(mine.prev)) == prev
                prev = (r[2], r[3])


@pytest.mark.parametrize("most", [10, 1_000])
def test_buckets_of_a_crowded_key_are_even(spark, most):
    """All rows of one key in one time cell, half of them in a tenth of it; another key is sparse, a third is null."""
    rnd = random.Random(15)
    rows_ = [("hot", rnd.randrange(4_096 if i % 2 else 400), i, 1.0) for i in range(400)] + [("b", i * 5_000, 1_000 + i, 1.0) for i in range(20)]
    rows_ += [(None, rnd.randrange(4_096), 2_000 + i, 1.0) for i in range(60)]
    frame = spark.createDataFrame(rows_, "k string, ts long, seq long, v double")
    made = scan.even_buckets(frame, ["k"], "ts", 4_096, most)
    sizes = [r["count"] for r in made.groupBy("k", scan.BUCKET).count().collect()]
    slot = max(Counter((k, t) for k, t, *_ in rows_).values())
    assert max(sizes) < most + slot and (most > 400 or len(sizes) > 40)
    spans = made.groupBy("k", scan.BUCKET).agg(F.min("ts"), F.max("ts")).orderBy("k", scan.BUCKET).collect()
    assert all(a[0] != b[0] or a[3] < b[2] for a, b in zip(spans, spans[1:]))
    got = {r.seq: (r._rn, r.n) for r in scan.numbered(frame, ["k"], "ts", ("seq",), 4_096, total="n", most=most).collect()}
    for k in ("hot", "b", None):
        part = sorted((r for r in rows_ if r[0] == k), key=lambda r: (r[1], r[2]))
        assert all(got[r[2]] == (i + 1, len(part)) for i, r in enumerate(part))


def scans_of(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("FileScan")


@pytest.mark.parametrize(("key", "most"), [("E29_quote_lock", 4), ("E10_stale_flags", 4), ("D5_triggers", 2), ("E28_cooldown", 3), ("J1_asof_backward", 4), ("E11_sample_even", 2)])
def test_scans_per_query(spark, key, most):
    """How often a query reads its table; E10 numbers its messages first, which is half of its reads."""
    import __spark_entry__ as entry

    assert scans_of(entry.queries()[key](spark, "/root/testdata/sf0.001")) <= most


@pytest.mark.parametrize("width", [9, 100_000])
def test_stale_flags(spark, width):
    """Every kind of message against the state machine: gaps, missing sequences, wrong hashes, snapshots with and without sequence."""
    rnd = random.Random(6)
    rows_, n = [], 0
    for i in range(400):
        n += 1
        kind = "snapshot" if rnd.random() < 0.12 else "delta"
        seq = None if rnd.random() < 0.2 else n + (rnd.random() < 0.1)
        rows_.append((rnd.choice("ab"), i // 2, i, kind, seq, rnd.choice((True, True, True, True, True, None, False))))
    msgs = spark.createDataFrame(rows_, "k string, ts long, seq long, kind string, sequence long, hash_ok boolean")
    got = {r.seq: r.stale for r in book.stale_flags(msgs, ["k"], "ts", ("seq",), width).collect()}
    for key in "ab":
        stale, expected = True, None
        for k, _, i, kind, seq, ok in rows_:
            if k != key:
                continue
            if kind == "snapshot":
                stale, expected = False, None if seq is None else seq + 1
            else:
                stale = stale or (expected is not None and seq != expected)
                expected = expected if seq is None else seq + 1
            stale = stale or ok is False
            assert got[i] == stale, i


@pytest.mark.parametrize("width", [5, 64])
def test_book_hashes_after_every_message(spark, width):
    rnd = random.Random(8)
    rows_, held, want = [], {"BID": {}, "ASK": {}}, {}
    for msg in range(150):
        kind = "snapshot" if rnd.random() < 0.1 else "delta"
        if kind == "snapshot":
            held = {"BID": {}, "ASK": {}}
            rows_.append(("t", msg, kind, None, None, None, -1))
        for pos in range(rnd.randrange(1, 5)):
            side, price, qty = rnd.choice(("BID", "ASK")), rnd.randrange(12) * 10_000, rnd.choice((0, 3, 7))
            rows_.append(("t", msg, kind, side, price, qty, pos))
            held[side].pop(price, None)
            if qty:
                held[side][price] = qty
        bids, asks = (sorted(held[s].items(), reverse=s == "BID")[:5] for s in ("BID", "ASK"))
        text = "|".join(",".join(f"{p}:{q}" for p, q in side) for side in (bids, asks))
        want[msg] = hashlib.md5(text.encode()).hexdigest()
    levels = spark.createDataFrame(rows_, "token_id string, msg long, kind string, side string, price_micros long, quantity long, pos int")
    assert {r.msg: r.book_hash for r in book.book_hashes(levels, width=width).collect()} == want
    last = book.book_state(book.book_levels(levels)).first()
    assert last.book_hash == want[149]


def test_volatility_over_shared_grids(spark):
    """Ends of several phases, long and short gaps between them, against the definition."""
    import numpy as np

    rnd = random.Random(12)
    ticks = [("k", t, i, 50 + rnd.random() * 10) for i, t in enumerate(sorted(rnd.sample(range(0, 60_000, 7), 300)))]
    ends = sorted({rnd.choice((0, 100, 137)) + 1_000 * rnd.randrange(1, 60) for _ in range(60)})
    ts, price = np.array([t[1] for t in ticks]), np.array([t[3] for t in ticks])

    def at(x):
        return np.interp(x, ts, price) if ts[0] <= x <= ts[-1] else np.nan

    got = flow.realized_vol(
        spark.createDataFrame([("k", e) for e in ends], "k string, ts long"), spark.createDataFrame(ticks, "k string, ts long, seq long, p double"),
        "ts", ["k"], "p", {"v3": 3, "v20": 20}, step_ms=1_000, tie="seq", width=5_000,
    )
    rows_ = {r.ts: r for r in got.collect()}
    assert len(rows_) == len(ends)
    for e in ends:
        for name, n in (("v3", 3), ("v20", 20)):
            p = np.array([at(e - k * 1_000) for k in range(n + 1)])
            r = (p[:-1] / p[1:] - 1) * 100
            assert rows_[e][name] == pytest.approx(0.0 if np.isnan(r).any() else r.std(), abs=1e-7)


@pytest.mark.parametrize("block", [3, 64])
def test_fills_equal_brute_force(spark, monkeypatch, block):
    """Many prints of one time, both sides, all profiles; blocks of three prints cut times and levels apart."""
    monkeypatch.setattr(fills, "BLOCK", block)
    monkeypatch.setattr(fills, "WIDTH", 4)
    rnd = random.Random(21)
    prints = [("m", rnd.randrange(120), rnd.randrange(1, 9), rnd.choice(("BUY", "SELL", "UNKNOWN")), float(rnd.choice((0, 1, 2, 5)))) for _ in range(160)]
    orders = []
    for i in range(60):
        a = rnd.randrange(-5, 115)
        orders.append((i, "m" if i % 10 else "none", rnd.random() < 0.5, rnd.randrange(1, 9), a, a + rnd.randrange(60), float(rnd.choice((0, 1, 3, 12)))))
    p = spark.createDataFrame(prints, "market string, ts_ms long, level long, aggressor string, qty double")
    o = spark.createDataFrame(orders, "order_id long, market string, side_buy boolean, level long, arrival_ms long, end_ms long, size double")
    got = {x: {r.order_id: r for r in fills.fill_labels(o, p, x, width=17, volume_width=3_000_000).collect()} for x in fills.QUEUE_AHEAD}
    seen = {r.order_id: r for r in fills.order_evidence(o, p, width=17).collect()}
    for i, m, buy, level, start, end, size in orders:
        mine = {}
        for market, ts, price, who, qty in prints:
            weight = 0.5 if who == "UNKNOWN" else float(who == ("SELL" if buy else "BUY"))
            better = price < level if buy else price > level
            if market == m and start <= ts <= end and qty > 0 and weight and (better or price == level):
                v, n = mine.get(ts, (0.0, 0))
                mine[ts] = (v + qty * weight * (1.0 if better else 0.5), n + better)
        total, through = sum(v for v, _ in mine.values()), sum(n for _, n in mine.values())
        assert (seen[i].evidence_qty, seen[i].through_prints, seen[i].last_print_ms) == (total, through, max(mine, default=None)), i
        for profile, queue in fills.QUEUE_AHEAD.items():
            share, r = 1.0 - queue, got[profile][i]
            eff = total * share
            if profile == "CONSERVATIVE":
                want = (1.0 if eff >= 2 * size - 1e-9 else 0.5 if eff >= size / 2 - 1e-9 else None) if through >= 2 and size else None
                threshold, two, complete = (2 * size if want == 1.0 else size / 2), 2, want is not None
            else:
                want, threshold, two, complete = (1.0 if eff > 0 else None), size, 0, size > 0 and eff >= size - 1e-9
            qty = min(size * want, eff) if want and size and eff > 0 else 0.0
            assert r.fill_qty == pytest.approx(qty) and r.filled == (qty > 0)
            if qty > 0:
                done, sum_v, sum_n = None, 0.0, 0
                for ts in sorted(mine):
                    sum_v, sum_n = sum_v + mine[ts][0], sum_n + mine[ts][1]
                    if done is None and sum_n >= two and sum_v * share >= threshold - 1e-6:
                        done = ts
                assert r.fill_ts_ms == (done if complete else max(mine)), (i, profile)


@pytest.mark.parametrize("width", [40, 100_000])
def test_range_window(df, data, width):
    got = {r.seq: (r.a, r.b) for r in scan.range_window(df, ["k"], "ts", {"a": (5, F.count("v")), "b": (30, F.sum("v"))}, width).collect()}
    for k, ts, seq, _ in data:
        near = lambda s: [x for x in data if x[0] == k and ts - s <= x[1] <= ts]  # noqa: E731, B023
        assert got[seq][0] == len(near(5))
        assert got[seq][1] == pytest.approx(sum(x[3] for x in near(30)))


def test_range_spread(df, data):
    high = df.withColumn("v", F.col("v") + 1e6)
    got = {r.seq: r.d for r in scan.range_spread(high, ["k"], "ts", 30, "v", "d").collect()}
    for k, ts, seq, _ in data:
        near = [x[3] for x in data if x[0] == k and ts - 30 <= x[1] <= ts]
        mean = sum(near) / len(near)
        assert got[seq] == pytest.approx((sum((v - mean) ** 2 for v in near) / len(near)) ** 0.5, abs=1e-6)


def test_range_window_of_a_crowded_span(spark):
    # 120,000 rows in one span: frames that are summed anew for every row would add 7,200,000,000 values.
    n = 120_000
    rows = spark.range(n).select(F.lit("a").alias("k"), F.col("id").alias("ts"), F.lit(1.0).alias("v"))
    begun = time.monotonic()
    got = scan.range_window(rows, ["k"], "ts", {"s": (n, F.sum("v")), "c": (n, F.count("v"))}).agg(F.sum("s"), F.sum("c")).first()
    assert tuple(got) == (n * (n + 1) / 2, n * (n + 1) // 2)
    assert time.monotonic() - begun < 30


@pytest.mark.parametrize("width", [9, 100_000])
def test_drawdown_and_peak(df, data, width):
    dd = {r.k: r.max_drawdown for r in scan.max_drawdown(df, ["k"], "ts", F.col("v"), ("seq",), width).collect()}
    pk = {r.k: r.peak for r in scan.peak_level(df, ["k"], "ts", F.col("v"), width).collect()}
    for k, part in by_key(data).items():
        eq = peak = worst = 0.0
        for r in part:
            eq += r[3]
            peak = max(peak, eq)
            worst = max(worst, peak - eq)
        level = best = 0.0
        for ts in sorted({r[1] for r in part}):
            level += sum(r[3] for r in part if r[1] == ts)
            best = max(best, level)
        assert dd[k] == pytest.approx(worst)
        assert pk[k] == pytest.approx(best)


@pytest.mark.parametrize("width", [15, 100_000])
def test_cooldown_and_lock(df, data, width):
    got = {r.seq: r.accepted for r in cooldown.cooldown(df, ["k"], "ts", 12, ("seq",), width).collect()}
    lock_in = df.withColumn("ok", F.col("v") > -0.3)
    lock = {r.seq: (r.entered, r.cancelled) for r in cooldown.quote_lock(lock_in, ["k"], "ts", "ok", 12, ("seq",), width).collect()}
    for part in by_key(data).values():
        last, quote = None, None
        for _, ts, seq, v in part:
            ok = last is None or ts - last >= 12
            assert got[seq] == ok
            last = ts if ok else last
            entered = cancelled = False
            if quote is not None and (ts >= quote or not v > -0.3):
                cancelled, quote = True, None
            if quote is None and v > -0.3:
                entered, quote = True, ts + 12
            assert lock[seq] == (entered, cancelled)


def test_regime_walk_and_brute_force(spark, df, data):
    walk = spark.createDataFrame([("A", i, float(v)) for i, v in enumerate((1, 2, 3, 4))], "k string, ts long, vol double")
    for warmup, want in ((1, ["low", "extreme", "extreme", "extreme"]), (4, ["normal", "normal", "normal", "extreme"])):
        got = regimes.pit_vol_regime(walk, ["k"], "ts", "vol", warmup, width=2, block_rows=2)
        assert [r.vol_regime for r in sorted(got.collect(), key=lambda r: r.ts)] == want
    import numpy as np

    got = {r.seq: r.vol_regime for r in regimes.pit_vol_regime(df, ["k"], "ts", "v", 10, ("seq",), 50, 20).collect()}
    for part in by_key(data).values():
        for i, r in enumerate(part):
            hist = np.array([x[3] for x in part[: i + 1]])
            q = np.quantile(hist, [0.25, 0.5, 0.75])
            want = "normal" if i + 1 < 10 else "low" if r[3] <= q[0] else "normal" if r[3] <= q[1] else "high" if r[3] <= q[2] else "extreme"
            assert got[r[2]] == want


def test_ranks_with_one_value_in_most_rows(spark):
    """Nine of ten rows are equal, and one key is null."""
    rnd = random.Random(2)
    data = [("a", i, 5.0 if rnd.random() < 0.9 else round(rnd.random() * 9, 2)) for i in range(600)] + [(None, i, 1.0) for i in range(40)]
    frame = spark.createDataFrame(data, "k string, ts long, v double")
    got = {(r.k, r.ts): (r._rn, r._less) for r in regimes.expanding_rank(frame, ["k"], "ts", "v", (), 50, 30).collect()}
    for k in ("a", None):
        part = [v for x, _, v in data if x == k]
        for i, v in enumerate(part):
            assert got[k, i] == (i + 1, sum(x < v for x in part[:i]))
    assert len(got) == len(data)


def test_earlier_smaller():
    import numpy as np

    rnd = np.random.default_rng(0)
    for n in (0, 1, 2, 17, 64, 100):
        x = rnd.integers(0, 10, n)
        assert list(regimes.earlier_smaller(x)) == [int((x[:i] < x[i]).sum()) for i in range(n)]


def test_rank_values_and_sampling(df, data):
    cuts = research.rank_values(df, "v", (0.2, 0.4, 0.6, 0.8), accuracy=50).collect()[0].cuts
    ordered = sorted(r[3] for r in data)
    assert list(cuts) == [ordered[int(len(ordered) * p)] for p in (0.2, 0.4, 0.6, 0.8)]
    for k in (1, 2, 5, 400):
        even = {r.seq for r in sampling.sample_even(df, ["k"], "ts", k, ("seq",), 50).collect()}
        ends = {r.seq for r in sampling.sample_endpoints(df, ["k"], "ts", k, ("seq",), 50).collect()}
        want_even, want_ends = set(), set()
        for part in by_key(data).values():
            n, take = len(part), min(k, len(part))
            want_even |= {part[i * n // take][2] for i in range(take)}
            want_ends |= {part[n // 2][2]} if take == 1 else {part[i * (n - 1) // (take - 1)][2] for i in range(take)}
        assert even == want_even and ends == want_ends


def test_interval_extremes(spark, df, data):
    spans = [(i, k, a, a + w) for i, (k, a, w) in enumerate([("hot", 0, 499), ("a", 17, 3), ("b", 100, 300), ("hot", 255, 0), ("zz", 0, 9)])]
    s = spark.createDataFrame(spans, "id long, k string, lo long, hi long")
    got = {r.id: (r.low, r.high) for r in intervals.interval_extremes(s, df, ["id"], ["k"], "lo", "hi", "ts", "v", levels=4).collect()}
    for i, k, lo, hi in spans:
        inside = [r[3] for r in data if r[0] == k and lo <= r[1] <= hi]
        assert got[i] == ((min(inside), max(inside)) if inside else (None, None))
