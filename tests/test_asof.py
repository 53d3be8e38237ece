import random

import pytest
from pyspark.sql import functions as F

from tapelab.operators import asof, scan


def series(seed, n, keys="ab", span=400):
    rnd = random.Random(seed)
    # A third of all rows share one key.
    return [
        ("hot" if rnd.random() < 0.34 else rnd.choice(keys), rnd.randrange(span), i, round(rnd.random(), 3))
        for i in range(n)
    ]


def frame(spark, rows, names="k string, ts long, seq long, v double"):
    return spark.createDataFrame(rows, names)


def test_backward_golden(spark):
    right = frame(spark, [("m", 10, 0, 1.0), ("m", 20, 1, 2.0), ("m", 30, 2, 3.0)])
    left = frame(spark, [("m", t, t, 0.0) for t in (5, 10, 25, 30)]).drop("v", "seq")
    got = asof.asof_backward(left, right.withColumnRenamed("v", "x"), "ts", ["k"], ["x"], tie="seq", width=7)
    assert {r.ts: r.x for r in got.collect()} == {5: None, 10: 1.0, 25: 2.0, 30: 3.0}


@pytest.mark.parametrize("width", [3, 50, 10_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_neighbours_match_brute_force(spark, width, seed):
    rights, lefts = series(seed, 150), series(seed + 50, 80)
    left = frame(spark, lefts).select("k", "ts", F.col("seq").alias("id"))
    right = frame(spark, rights).withColumnRenamed("v", "x")
    back = {r.id: r.x for r in asof.asof_backward(left, right, "ts", ["k"], ["x"], tie="seq", width=width).collect()}
    ahead = {r.id: r.x for r in asof.asof_forward(left, right, "ts", ["k"], ["x"], tie="seq", width=width).collect()}
    for k, ts, i, _ in lefts:
        before = [r for r in rights if r[0] == k and r[1] <= ts]
        after = [r for r in rights if r[0] == k and r[1] >= ts]
        assert back[i] == (max(before, key=lambda r: (r[1], r[2]))[3] if before else None)
        assert ahead[i] == (min(after, key=lambda r: (r[1], r[2]))[3] if after else None)


def test_no_keys_and_tolerance(spark):
    left = spark.createDataFrame([(5,), (50,)], "ts long")
    right = spark.createDataFrame([(1, 9.0)], "ts long, x double")
    got = asof.asof_backward(left, right, "ts", [], ["x"], tolerance=10, width=4)
    assert {r.ts: r.x for r in got.collect()} == {5: 9.0, 50: None}


def test_edges_list_no_bucket_without_rows(spark):
    """Two ticks ten years apart and one reading between them: three buckets a key, whatever the distance."""
    year = 365 * 24 * 3_600_000
    right = spark.createDataFrame([(f"k{k}", t * year, 0, float(t)) for k in range(100) for t in (0, 10)], "k string, ts long, seq long, x double")
    left = spark.createDataFrame([(f"k{k}", t * year) for k in range(100) for t in (-1, 5, 5, 11)], "k string, ts long")
    narrow = right.select("k", scan.bucket_of(F.col("ts"), scan.HOUR_MS).alias(scan.BUCKET), F.col("ts").alias("_t"), F.lit(0).alias("_tie"), F.struct("x").alias("_v"))
    cells = left.select("k", scan.bucket_of(F.col("ts"), scan.HOUR_MS).alias(scan.BUCKET))
    assert asof.edges(cells, narrow, ["k"], True, True).count() == 100 * (3 + 2)
    back = asof.asof_backward(left, right, "ts", ["k"], ["x"], tie="seq")
    ahead = asof.asof_forward(left, right, "ts", ["k"], ["x"], tie="seq")
    assert {(r.ts // year, r.x) for r in back.collect()} == {(-1, None), (5, 0.0), (11, 10.0)}
    assert {(r.ts // year, r.x) for r in ahead.collect()} == {(-1, 0.0), (5, 10.0), (11, None)}


def test_cells_of_another_table_serve_as_well(spark):
    rights, lefts = series(3, 100), series(4, 60)
    left = frame(spark, lefts).select("k", "ts", F.col("seq").alias("id"))
    right = frame(spark, rights).withColumnRenamed("v", "x")
    more = left.select("k", "ts").unionByName(right.select("k", "ts"))
    read = lambda **o: sorted(map(str, asof.asof_backward(left, right, "ts", ["k"], ["x"], tie="seq", width=7, **o).collect()))
    assert read() == read(cells=more)


def test_look_ahead_is_impossible(spark):
    rows = series(7, 120)
    left = frame(spark, rows).select("k", "ts", F.col("seq").alias("id")).where("ts <= 200")
    full = frame(spark, rows).withColumnRenamed("v", "x")
    cut = full.where("ts <= 200")
    read = lambda r: sorted(map(tuple, asof.asof_backward(left, r, "ts", ["k"], ["x"], tie="seq", width=20).collect()))
    assert read(full) == read(cut)


def test_interpolation_and_forward_labels(spark):
    ticks = spark.createDataFrame([("k", 0, 0, 100.0), ("k", 299_000, 1, 100.0), ("k", 300_000, 2, 110.0)], "k string, ts long, seq long, p double")
    targets = spark.createDataFrame([("k", t) for t in (-1, 0, 299_500, 300_000, 300_001)], "k string, ts long")
    got = asof.interpolate(targets, ticks, "ts", ["k"], "p", tie="seq", width=1_000)
    assert {r.ts: r.price_at for r in got.collect()} == {-1: None, 0: 100.0, 299_500: 105.0, 300_000: 110.0, 300_001: None}
    lab = asof.forward_labels(
        spark.createDataFrame([(1, "k", 0)], "id long, k string, ts long"), ticks, "ts", ["k"], ["id"], "p",
        {"a": 1, "b": 299_500, "c": 400_000}, tie="seq", width=1_000,
    ).collect()[0]
    assert (lab.a, lab.b, lab.c) == (100.0, 110.0, None)


def test_merge_order(spark):
    tick = spark.createDataFrame([(1, 0), (2, 1)], "ts long, seq long")
    trade = spark.createDataFrame([(3, 0), (2, 0)], "ts long, seq long")
    got = asof.merge_events({"tick": tick, "trade": trade}, "ts", "seq").collect()
    assert [(r.ts, r.kind) for r in got] == [(1, "tick"), (2, "tick"), (2, "trade"), (3, "trade")]


def test_plan_has_no_nested_loop_for_keyed_joins(spark):
    left = frame(spark, series(1, 10)).select("k", "ts")
    right = frame(spark, series(2, 10)).withColumnRenamed("v", "x")
    plan = asof.asof_backward(left, right, "ts", ["k"], ["x"], tie="seq")._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_lag_exact_is_one_pass_and_whole(spark):
    rows = [(k, t, v) for k, t, _, v in series(5, 300)] + [(None, 7, 1.0), ("a", None, 2.0), ("b", 11, None)]
    df = frame(spark, rows, "k string, ts long, v double")
    got = asof.lag_exact(df, "ts", ["k"], "v", {"l3": 3, "l40": 40}, width=50)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    best = {}
    for k, t, v in rows:
        if None not in (k, t, v):
            best[k, t] = max(best.get((k, t), v), v)
    want = [(k, t, v, *(best.get((k, t - ms)) if t is not None else None for ms in (3, 40))) for k, t, v in rows]
    assert sorted(map(repr, ((r.k, r.ts, r.v, r.l3, r.l40) for r in got.collect()))) == sorted(map(repr, want))
