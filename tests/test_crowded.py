"""Queries against their SQL twins where many rows share a time, numbers have seven digits and keys have few rows."""

import os
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

import __spark_entry__ as entry
from tapelab.operators import cooldown
from tapelab.plans.catalog import streams
from tests.test_twins import SF, table

KEYS = (
    "A15_profit_factor", "E28_cooldown", "E29_quote_lock", "E2_horizon_returns", "P20_pair_id", "J2_asof_forward", "J3_lag_asof",
    "J5_interpolate", "T1_tick_stream", "T2_event_time", "T7_stream_labels", "T11_stream_tables",
)


@pytest.fixture(scope="module")
def crowded(tmp_path_factory):
    folder = tmp_path_factory.mktemp("crowded")
    con = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            con.execute(f"CREATE TABLE {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    # Cells of half an hour: an asset has several ticks of one time.
    con.execute("UPDATE events SET ts = time_bucket(INTERVAL 30 MINUTES, ts), event_id = 999500 + event_id")
    con.execute("UPDATE orders SET o_custkey = o_orderkey")
    for (name,) in con.execute("SELECT table_name FROM duckdb_tables()").fetchall():
        con.execute(f"COPY {name} TO '{folder}/{name}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("key", KEYS)
def test_twin_of_crowded_tables(spark, crowded, key):
    folder, con = crowded
    df = entry.queries()[key](spark, folder)
    mine = table(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(entry.oracle_sql()[key])
    assert mine == table([d[0] for d in res.description], res.fetchall())


@pytest.fixture
def drift(monkeypatch):
    """A percentile that differs whenever it is taken, as that of a table of many partitions may."""

    @F.pandas_udf("double")
    def drifting(v: pd.Series) -> float:
        return float(v.min() + (v.max() - v.min()) * random.SystemRandom().uniform(0.3, 0.7))

    fake = lambda c, share: F.array(drifting(c)) if isinstance(share, list) else drifting(c)
    monkeypatch.setattr(streams.F, "percentile_approx", fake)


@pytest.mark.parametrize("key", ("T2_event_time", "T11_stream_tables"))
def test_stream_twin_where_percentiles_drift(spark, drift, key):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    df = entry.queries()[key](spark, SF)
    res = con.execute(entry.oracle_sql()[key])
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table([d[0] for d in res.description], res.fetchall())


def test_stream_parts_hold_every_row_once(spark, drift):
    tables = streams.StreamTables(spark, SF)
    got = streams.run(tables.raw("events").select("event_id"), "append", "whole")
    want = spark.read.parquet(f"{SF}/events.parquet").select("event_id")
    assert got.select("event_id").exceptAll(want).isEmpty() and want.exceptAll(got.select("event_id")).isEmpty()


def test_stream_parts_of_more_files_lose_no_row(spark, monkeypatch):
    """A session that deals to more tasks than it was asked for writes more files a part."""
    folder = SF.replace("sf0.001", "sf0.01")
    dealt = DataFrame.repartition
    monkeypatch.setattr(DataFrame, "repartition", lambda df, n, *columns: dealt(df, n + 5 if n == streams.FILES else n, *columns))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    df = entry.queries()["T11_stream_tables"](spark, folder)
    res = con.execute(entry.oracle_sql()["T11_stream_tables"])
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table([d[0] for d in res.description], res.fetchall())


@pytest.mark.parametrize("width", (1_000, 100_000))
def test_cooldown_where_a_join_turns_into_a_broadcast(spark, width):
    """Several map tasks, and joins that become broadcasts while they run: each bucket must still meet in one task."""
    joins = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "20k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    rows = spark.range(0, 4_000, 1, 6).selectExpr("id AS seq", "pmod(id * 7919, 4000) div 2 AS ts", "substr('aaab', 1 + id % 4, 1) AS k")
    for key, value in joins.items():
        spark.conf.set(key, value)
    try:
        got = cooldown.cooldown(rows, ["k"], "ts", 30, ("seq",), width).collect()
    finally:
        for key in joins:
            spark.conf.unset(key)
    want = set()
    for key in "ab":
        free = 0
        for t, seq in sorted((r.ts, r.seq) for r in got if r.k == key):
            if t >= free:
                want.add(seq)
                free = t + 30
    assert len(got) == 4_000 and {r.seq for r in got if r.accepted} == want
