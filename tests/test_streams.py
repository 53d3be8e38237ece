"""Streams fed in several micro-batches must end where the batch form ends."""

import hashlib
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapelab.operators import asof, cooldown, flow
from tapelab.plans.catalog.streams import run
from tapelab.streaming import streams

SCHEMA = "k string, seq long, event_ms long, price double, side string, qty double"


@pytest.fixture
def feed(spark, tmp_path):
    """Five files of ticks, read one per micro-batch in time order."""
    rows = [("ab"[i % 2], i, 1_000_000 + i * 700, 10.0 + (i * 7) % 13, ("BUY", "SELL", None)[i % 3], float(i % 5)) for i in range(200)]
    for n in range(5):
        part = spark.createDataFrame(rows[n * 40 : (n + 1) * 40], SCHEMA).coalesce(1)
        part.write.parquet(str(tmp_path / f"p{n}"))
        files = list((tmp_path / f"p{n}").glob("*.parquet"))
        target = tmp_path / "in"
        target.mkdir(exist_ok=True)
        files[0].rename(target / f"{n}.parquet")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream = stream.withColumn("event_ts", F.timestamp_millis("event_ms")).withWatermark("event_ts", "0 seconds")
    return spark.createDataFrame(rows, SCHEMA), stream, rows


def test_cooldown_equals_batch(feed):
    batch, stream, _ = feed
    got = {r.seq for r in run(streams.stream_cooldown(stream, "k", 3_000), "append", "t").collect()}
    want = cooldown.cooldown(batch, ["k"], "event_ms", 3_000, ("seq",), width=20_000).where("accepted")
    assert got == {r.seq for r in want.collect()}


def test_labels_equal_batch(feed):
    batch, stream, rows = feed
    horizons = (1_000, 5_000, 20_000)
    kinds = F.when(F.col("seq") % 4 == 0, F.array(F.lit("mid"), F.lit("eval"))).otherwise(F.array(F.lit("mid")))
    s = stream.select("k", "event_ts", "event_ms", F.col("seq").alias("eval_id"), "price", F.explode(kinds).alias("kind"))
    got = {r.eval_id: (r.mid_1000, r.mid_5000, r.mid_20000) for r in run(streams.stream_labels(s, "k", horizons, grace_ms=2_000), "append", "t").collect()}
    evals = batch.where(F.col("seq") % 4 == 0).select("k", "event_ms", F.col("seq").alias("eval_id"))
    lab = asof.forward_labels(evals, batch, "event_ms", ["k"], ["eval_id"], "price", {f"h{h}": h for h in horizons}, tie="seq", width=10_000)
    want = {r.eval_id: (r.h1000, r.h5000, r.h20000) for r in lab.collect()}
    last = rows[-1][2]
    for i, w in want.items():
        if None not in w:
            assert got[i] == w
        elif i in got:
            assert got[i] == w and 1_000_000 + i * 700 + 21_000 <= last
    assert len(got) > 30


@pytest.mark.parametrize("files", [1, 2, 7])
def test_labels_do_not_depend_on_the_cut(spark, tmp_path, files):
    """Rows come up to two seconds out of order; every cut gives the labels of the whole table."""
    rows = [("a", i, 1_000_000 + i * 700, float((i * 7) % 13)) for i in range(140)]
    arrival = sorted(rows, key=lambda r: r[2] + (1_900 if r[1] % 4 == 1 else 0))
    size = -(-len(rows) // files)
    (tmp_path / "in").mkdir()
    for n in range(files):
        part = spark.createDataFrame(arrival[n * size : (n + 1) * size], "k string, seq long, event_ms long, price double").coalesce(1)
        part.write.parquet(str(tmp_path / f"p{n}"))
        next((tmp_path / f"p{n}").glob("*.parquet")).rename(tmp_path / "in" / f"{n}.parquet")
    stream = spark.readStream.schema("k string, seq long, event_ms long, price double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream = stream.withColumn("event_ts", F.timestamp_millis("event_ms")).withWatermark("event_ts", "2 seconds")
    kinds = F.when(F.col("seq") % 5 == 0, F.array(F.lit("mid"), F.lit("eval"))).otherwise(F.array(F.lit("mid")))
    s = stream.select("k", "event_ts", "event_ms", F.col("seq").alias("eval_id"), "price", F.explode(kinds).alias("kind"))
    got = {r.eval_id: (r.mid_1000, r.mid_9000) for r in run(streams.stream_labels(s, "k", (1_000, 9_000), grace_ms=3_000), "append", "t").collect()}
    passed = rows[-1][2] - 2_000
    want = {}
    for _, i, t, _ in rows[::5]:
        mids = [next((r for r in rows if r[2] >= t + h), None) for h in (1_000, 9_000)]
        if None not in mids and mids[-1][2] < passed:
            want[i] = tuple(m[3] for m in mids)
    assert got == want and len(want) > 20


@pytest.mark.parametrize("slice_ms", [1_500, 9_000])
def test_labels_do_not_depend_on_the_slices(feed, slice_ms):
    """Evaluations of a key lie in many slices, shorter than a horizon or longer, and find mids of later ones."""
    _, stream, _ = feed
    kinds = F.when(F.col("seq") % 4 == 0, F.array(F.lit("mid"), F.lit("eval"))).otherwise(F.array(F.lit("mid")))
    s = stream.select("k", "event_ts", "event_ms", F.col("seq").alias("eval_id"), "price", F.explode(kinds).alias("kind"))
    made = [run(streams.stream_labels(s, "k", (1_000, 5_000), 2_000, slice_ms=x), "append", "t").drop("batch") for x in (slice_ms, 10**9)]
    got, whole = (sorted(map(str, m.collect())) for m in made)
    assert got == whole and len(got) > 40


def test_labels_pack_their_state():
    """The mids of a slice are 24 bytes each in a few values, and go with the slice."""
    held, seen, timers = _Clearing(), _Clearing(), []
    handle = SimpleNamespace(getListState=lambda *_: held, getValueState=lambda *_: seen, registerTimer=timers.append)
    labels = streams._Labels("k", (1_000,), 500, True, 100_000)
    labels.init(handle)
    at = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    frame = lambda t, is_eval: pd.DataFrame({"is_eval": is_eval, "event_ms": t, "eval_id": t, "price": [float(x) for x in t]})
    for low in range(0, 100_000, 50_000):
        times = range(low, low + 50_000)
        list(labels.handleInputRows(("a", 0), iter([frame(times[:40_000], False), frame(times[40_000:], False), frame(times[::10_000], True)]), at(0)))
    assert sum(len(m) for m, _ in held.rows) == 24 * 100_000 and held.calls <= 4 and set(timers) == {100_000, 1_000, 51_000}
    out, = labels.handleExpiredTimer(("a", 0), at(45_000), None)
    assert out["event_ms"].tolist() == [0, 10_000, 20_000, 30_000, 40_000] and (out["mid_1000"] == out["event_ms"] + 1_000).all()
    assert sum(len(m) for m, _ in held.rows) == 24 * (100_000 - 46_000)
    last, = labels.handleExpiredTimer(("a", 0), at(200_000), None)
    assert len(last) == 5 and not list(labels.handleExpiredTimer(("a", 0), at(200_000), None)) and not held.rows
    list(labels.handleInputRows(("a", 0), iter([frame(range(100_500, 100_600), False)]), at(200_000)))
    assert not held.rows


def test_state_goes_after_expiry(feed):
    _, stream, _ = feed
    one = stream.where("k = 'b' OR seq < 40")
    got = run(streams.late_history(one, 5, "k", expire_ms=20_000), "update", "t")
    # the batch in which a's state times out is the last that knows it
    assert got.where("k = 'a'").agg(F.max("batch")).first()[0] < got.where("k = 'b'").agg(F.max("batch")).first()[0]
    assert got.where("k = 'b'").agg(F.max("n_late")).first()[0] == 0


def test_history_takes_late_samples(feed):
    batch, stream, rows = feed
    late = stream.withColumn("event_ms", F.when(F.col("seq") % 9 == 0, F.col("event_ms") - 40_000).otherwise(F.col("event_ms")))
    got = run(streams.late_history(late, 30, "k"), "update", "t").groupBy("k").agg(F.max_by(F.struct("n", "samples"), "batch").alias("s")).collect()
    for r in got:
        mine = sorted((t - 40_000 if s % 9 == 0 else t, p) for k, s, t, p, *_ in rows if k == r.k)[-30:]
        assert [(x.ts, x.price) for x in r.s.samples] == mine and r.s.n == 30


def test_spot_history_writes_what_changes(spark, tmp_path):
    """Repeated and late samples: each time is written when it changes, and the newest rows are the history."""
    steps = [
        [("a", 1, 1_000, 5.0), ("a", 2, 2_000, 6.0), ("b", 3, 1_000, 1.0)], [("a", 2, 2_000, 6.0), ("a", 4, 1_500, 7.0), ("a", 5, 2_000, 8.0)],
        [("a", 3, 2_000, 9.0), ("a", 6, 9_000, 2.0), ("a", 7, 9_500, -1.0)],
    ]
    streams.state_store(spark)
    schema = "k string, seq long, event_ms long, price double"
    (tmp_path / "in").mkdir()
    for n, rows in enumerate(steps):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"p{n}"))
        next((tmp_path / f"p{n}").glob("*.parquet")).rename(tmp_path / "in" / f"{n}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream = stream.withColumn("event_ts", F.timestamp_millis("event_ms")).withWatermark("event_ts", "1 minute")
    got = run(streams.spot_history(stream, "k", retention_ms=60_000, slice_ms=1_000), "update", "t").collect()
    assert {(r.batch, r.k, r.event_ms, r.price) for r in got} == {
        (0, "a", 1_000, 5.0), (0, "a", 2_000, 6.0), (0, "b", 1_000, 1.0), (1, "a", 1_500, 7.0), (1, "a", 2_000, 8.0), (2, "a", 9_000, 2.0)}


def test_windows_and_candles(feed):
    batch, stream, rows = feed
    got = {(r.k, r.start_ms): (r.buy_vol, r.sell_vol) for r in run(streams.sliding_flow(stream, "k", "10 seconds", "5 seconds"), "append", "t").collect()}
    assert got
    for (k, a), (b, s) in got.items():
        inside = [x for x in rows if x[0] == k and a <= x[2] < a + 10_000]
        assert b == sum(x[5] for x in inside if x[4] == "BUY") and s == sum(x[5] for x in inside if x[4] == "SELL")
    assert flow.candles(batch, ["k"], "event_ms", "price", ("seq",)).count() == 2


@pytest.mark.parametrize("files", [1, 2, 7])
def test_trailing_flow_equals_batch(spark, tmp_path, files):
    """Rows come out of order within the delay; each cut gives every tick that the watermark has passed, and counts late rows."""
    rows = [("ab"[i % 3 == 0], i, 1_000_000 + i * 700 // (1 + i % 2), 1.0, ("BUY", "SELL", None)[i % 3], float(i % 5)) for i in range(210)]
    arrival = sorted(rows, key=lambda r: r[2] + (1_900 if r[1] % 4 == 1 else 0))
    size = -(-len(rows) // files)
    (tmp_path / "in").mkdir()
    for n in range(files):
        spark.createDataFrame(arrival[n * size : (n + 1) * size], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"p{n}"))
        next((tmp_path / f"p{n}").glob("*.parquet")).rename(tmp_path / "in" / f"{n}.parquet")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream = stream.withColumn("event_ts", F.timestamp_millis("event_ms")).withWatermark("event_ts", "80 seconds")
    got = run(streams.trailing_flow(stream, "k", slice_ms=9_000), "append", "t").drop("batch")
    want = flow.order_flow(spark.createDataFrame(rows, SCHEMA), ["k"], "event_ms", width=20_000)
    passed = max(r[2] for r in rows) - 80_000
    columns = ("k", "seq", "event_ms", "buy_vol", "sell_vol", "ofi_short", "ofi_long", "imbalance", "buy_ratio")
    want = {tuple(r) for r in want.where(F.col("event_ms") <= passed).select(*columns).collect()}
    assert {tuple(r) for r in got.select(*columns).collect()} == want and len(want) > 60 and got.count() == len(want)


def test_late_rows_are_counted(spark, tmp_path):
    rows = [[("a", i, 1_000_000 + i * 1_000, 1.0, "BUY", 1.0) for i in range(60)], [("a", 89, 1_069_000, 1.0, "BUY", 1.0)], [("a", 90, 1_001_000, 1.0, "BUY", 1.0), ("a", 91, 1_070_000, 1.0, "BUY", 1.0)]]
    streams.state_store(spark)
    (tmp_path / "in").mkdir()
    for n, part in enumerate(rows):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"p{n}"))
        next((tmp_path / f"p{n}").glob("*.parquet")).rename(tmp_path / "in" / f"{n}.parquet")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream = stream.withColumn("event_ts", F.timestamp_millis("event_ms")).withWatermark("event_ts", "5 seconds")
    q = streams.trailing_flow(stream, "k", slice_ms=1_000_000).writeStream.format("noop").trigger(availableNow=True)
    q = q.option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert streams.late_rows(q) == 1


@pytest.mark.parametrize("parts", [1, 7])
def test_entries_do_not_depend_on_the_cut(spark, parts):
    from tapelab.plans.catalog import streams as entries
    from tapelab.plans.views import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    for made in (entries.trailing, entries.streamed_book, entries.history):
        assert sorted(map(str, made(t, parts).collect())) == sorted(map(str, made(t, 2).collect()))


def test_book_hash_marks_a_book_stale(spark, tmp_path):
    schema = "token_id string, msg long, pos int, kind string, side string, price_micros long, quantity long, sequence long, stated_hash string"
    right = hashlib.md5(b"410000:7|450000:9").hexdigest()
    steps = [
        [("t", 1, 0, "snapshot", "BID", 410000, 7, 1, right), ("t", 1, 1, "snapshot", "ASK", 450000, 9, 1, right)],
        [("t", 2, 0, "delta", "ASK", 450000, 9, 2, "wrong")], [("t", 3, 0, "delta", "ASK", 450000, 9, 3, right)],
        [("t", 4, 0, "snapshot", "ASK", 460000, 1, 4, None)],
    ]
    (tmp_path / "in").mkdir()
    for n, rows in enumerate(steps):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"p{n}"))
        next((tmp_path / f"p{n}").glob("*.parquet")).rename(tmp_path / "in" / f"{n}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(streams.stream_book(stream), "update", "t").orderBy("batch").collect()
    assert [(r.best_bid_micros, r.n_levels, r.stale) for r in got] == [(410000, 2, False), (410000, 2, True), (410000, 2, True), (None, 1, False)]


def test_book_recovers_only_by_snapshot(spark, tmp_path):
    schema = "token_id string, msg long, pos int, kind string, side string, price_micros long, quantity long, sequence long"
    steps = [
        [("t", 1, 0, "delta", "BID", 400000, 5, 1)],
        [("t", 2, 0, "snapshot", "BID", 410000, 7, 2), ("t", 2, 1, "snapshot", "ASK", 450000, 9, 2)],
        [("t", 3, 0, "delta", "BID", 420000, 3, 3)], [("t", 4, 0, "delta", "BID", 420000, 0, 5)], [("t", 5, 0, "snapshot", "BID", 390000, 1, 6)],
    ]
    for n, rows in enumerate(steps):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"p{n}"))
        (tmp_path / "in").mkdir(exist_ok=True)
        next((tmp_path / f"p{n}").glob("*.parquet")).rename(tmp_path / "in" / f"{n}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(streams.stream_book(stream), "update", "t").orderBy("batch").collect()
    assert [(r.best_bid_micros, r.best_ask_micros, r.stale) for r in got] == [
        (400000, None, True), (410000, 450000, False), (420000, 450000, False), (410000, 450000, True), (390000, None, False)]


class _Counting:
    """A state handle in memory that counts the calls made on its states."""

    def __init__(self):
        self.calls, self.rows = 0, []

    def registerTimer(self, _):
        pass

    def getListState(self, *_):
        return self

    getMapState = getListState

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            if name in ("exists", "containsKey"):
                return name == "exists" and bool(self.rows)
            if name == "get":
                return iter(list(self.rows))
            if name in ("put", "appendList"):
                self.rows = [*([] if name == "put" else self.rows), *args[0]]
            return None

        return call


class _Clearing(_Counting):
    def clear(self):
        self.rows = []


def test_spot_history_calls_its_state_a_few_times_a_batch():
    held, samples = _Counting(), streams._Samples("asset", "event_ms", "price", "seq", 1_000_000, 10_000)
    samples.init(held)
    batch = lambda low, high, shift: pd.DataFrame(
        {"event_ms": range(low, high), "seq": range(low + shift, high + shift), "price": [float(i + shift) for i in range(low, high)]})
    first, = samples.handleInputRows(("A", 0), iter([batch(0, 600, 0), batch(500, 1000, 0)]), None)
    assert len(first) == 1000 and held.calls <= 3
    again, = samples.handleInputRows(("A", 0), iter([batch(900, 1100, 0)]), None)
    assert again["event_ms"].tolist() == list(range(1000, 1100)) and held.calls <= 6
    for shift in (1, 2):
        later, = samples.handleInputRows(("A", 0), iter([batch(0, 1100, shift)]), None)
        assert len(later) == 1100 and later["price"].tolist() == [float(i + shift) for i in range(1100)]
    assert len(held.rows) == 1100
