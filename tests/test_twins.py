"""Every registered query against its SQL twin at the smallest scale.

``TAPELAB_TWINS=all`` runs them all (several minutes); by default a spread of them.
"""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tapelab.plans.catalog import corpus
from tapelab.session import checkpoint_dir
from tapelab.sources import sinks

SF = "/root/testdata/sf0.001"
QUICK = (
    "J1_asof_backward", "J12_assign_windows", "A1_segment_summary", "A2_economy_summary_overall", "A14_max_drawdown",
    "A22_quintile_means", "A28_order_flow", "E6_pit_vol_regime", "E10_stale_flags", "E15_fill_labels_base", "S9_parse_venue_json",
    "P16_parse_signal", "T9_stream_candles", "S5_scan_window", "S7_market_metas", "S10_parse_market_messages", "S19_window_table", "E8_book_tops",
    "A17_block_bootstrap", "A19_oos_headline", "A20_corr_matrix", "A26_branch_verdict", "D3_external_ticks", "E21_temporal_split", "E29_quote_lock", "J17_memo_join",
    "P35_exact_latency", "T3_stream_order_flow", "T7_stream_labels", "T8_stream_book",
    "S11_all_event_tables",
)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


KEYS = sorted(entry.queries()) if os.environ.get("TAPELAB_TWINS") == "all" else QUICK


@pytest.mark.parametrize("key", KEYS)
def test_twin(spark, con, key):
    df = entry.queries()[key](spark, SF)
    mine = table(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(key)
    if sql is None:
        assert mine
        return
    res = con.execute(sql)
    assert sorted(d[0] for d in res.description) == sorted(df.columns)
    assert mine == table([d[0] for d in res.description], res.fetchall())


def test_event_rows_reach_every_table():
    assert set(corpus._EVENT_ROWS) == set(sinks.EVENT_TABLES)
    for name, (_, _, columns) in corpus._EVENT_ROWS.items():
        assert set(columns) <= set(sinks.event_columns(name))


def test_entry_and_inventory(spark):
    assert entry.entry(spark).limit(1).count() == 1
    have = {k.split("_")[0] for k in entry.queries()}
    want = {f"{c}{i}" for c, n in (("S", 19), ("P", 39), ("J", 19), ("A", 38), ("E", 29), ("O", 7), ("T", 11), ("U", 4), ("D", 7)) for i in range(1, n + 1)}
    assert want - have == set()
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("key", ("A26_branch_verdict", "A2_economy_summary_overall", "A19_oos_headline"))
def test_lines_are_joined_once(spark, key):
    files = entry.queries()[key](spark, SF).inputFiles()
    assert files and not [f for f in files if f.endswith(("lineitem.parquet", "orders.parquet"))]


def test_event_tables_by_day_are_written_whole(spark, tmp_path):
    rows = spark.range(5000).selectExpr("timestamp_millis(id * 60000) AS ts", "'A' AS symbol", "id / 2 AS price")
    days = sinks.by_day(rows, F.to_date("ts"), "days")
    sinks.write_event_table(days, "external_ticks", str(tmp_path / "t"), clustered=True)
    back = spark.read.parquet(str(tmp_path / "t"))
    assert (back.count(), back.agg(F.sum("price")).first()[0]) == (5000, 4999 * 5000 / 4)
    assert back.where("date != to_date(ts)").isEmpty()


def test_event_tables_go_once_they_are_summed_up(spark):
    """One table at a time is on the disk, and in the end none, nor the sources that were written for them."""
    before = set(os.listdir(checkpoint_dir(spark)))
    held, write = [], sinks.write_event_table

    def counted(df, name, path, **more):
        write(df, name, path, **more)
        held.append(len(os.listdir(os.path.dirname(path))))

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(sinks, "write_event_table", counted)
        rows = entry.queries()["S11_all_event_tables"](spark, SF)
    assert {r.stored for r in rows.select("stored").distinct().collect()} == set(sinks.EVENT_TABLES) and held == [1] * len(sinks.EVENT_TABLES)
    made = [os.path.join(checkpoint_dir(spark), f) for f in set(os.listdir(checkpoint_dir(spark))) - before]
    kinds = {os.path.basename(f).rsplit("-", 1)[0] for f in made if any(files for *_, files in os.walk(f))}
    assert kinds == {"tapelab-event-days"}
