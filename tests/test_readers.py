"""Readers over real files: archives of both layouts, markets without their files, window tables, market messages."""

import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tapelab import session
from tapelab.operators import book
from tapelab.sources import readers, sinks, venues


def test_archives_of_both_layouts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,10.5,2,1,1,1700000000000,true,true\nbad,1,1,1,1,1700000000001,false,true\n2,x,1,1,1,1700000000002,false,true\n3,11,4,1,1,1700000000003000,False,true\n")
    head = "agg_trade_id,price,quantity,first_trade_id,last_trade_id,transact_time,is_buyer_maker\n"
    with gzip.open(tmp_path / "b.csv.gz", "wt") as out:
        out.write(head + "3,12,1,0,0,1700000000003,false\n4,13,5,0,0,1700000000004,TRUE\n5,14,1,0,0,1800000000000,true\n")
    archives = [(str(tmp_path / "a.csv"), 8, "BTC", "spot"), (str(tmp_path / "b.csv.gz"), 7, "BTC", "spot")]
    got = readers.read_underlying(spark, archives, 1_600_000_000_000, 1_750_000_000_000).orderBy("ts_ms").collect()
    # the first archive wins for id 3; microseconds become milliseconds; rows that can't be read and later ones go
    assert [(r.ts_ms, r.price, r.qty, r.aggressor_side) for r in got] == [
        (1_700_000_000_000, 10.5, 2.0, "SELL"), (1_700_000_000_003, 11.0, 4.0, "BUY"), (1_700_000_000_004, 13.0, 5.0, "SELL")]


def test_trades_know_their_file(spark, tmp_path):
    spark.createDataFrame([("c1", 1), ("c2", 2)], "condition_id string, x int").coalesce(1).write.parquet(str(tmp_path / "t"))
    chosen = spark.createDataFrame([("c2",)], "condition_id string")
    got = readers.read_trades(spark, str(tmp_path / "t"), chosen).collect()
    assert [(r.condition_id, r.source_file.endswith(".parquet")) for r in got] == [("c2", True)]


def test_market_metas_without_files(spark, tmp_path):
    assert readers.read_market_metas(spark, str(tmp_path)).count() == 0
    markets = spark.createDataFrame([("c1", "VALIDATION"), ("c2", None), (None, "x"), ("", "x")], "condition_id string, split string")
    markets.write.parquet(str(tmp_path / "selected_markets.parquet"))
    got = {(r.condition_id, r.split, r.fidelity, r.question) for r in readers.read_market_metas(spark, str(tmp_path)).collect()}
    assert got == {("c1", "VALIDATION", "UNKNOWN", ""), ("c2", "EXPLORATION", "UNKNOWN", "")}


def test_no_window_is_lost(spark):
    row = "| {} | 2024-01-01T00:00:00Z – 2024-01-02T00:00:00Z | 2024-01-02T00:01:00Z – 2024-01-03T00:00:00Z |"
    lines = ["# text", "| name | train | test |", "|---|---|---|", *(row.format(n) for n in ("w98", "w99", "w100", "w101", "v1")), "| w7 | soon | later |"]
    got = readers.parse_window_table(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert {r.name: r.window_reject for r in got} == {"w98": None, "w99": None, "w100": None, "w101": None, "v1": "name"}


def test_every_message_gives_a_row(spark):
    def msg(kind, **more):
        return json.dumps({"event_type": kind, "market": "m", "asset_id": "t", "timestamp": "5", **more})

    level = [{"price": "0.4", "size": "3"}]
    cases = [
        msg("book", bids=level, asks=[]), msg("book", bids=[], asks=[]), "{broken", msg("price_change", price_changes="oops"), msg("price_change", price_changes=[]),
        msg("price_change"), msg("mystery"), "{}", None, msg("book", bids="oops"),
    ]
    df = spark.createDataFrame(list(enumerate(cases)), "msg long, payload string")
    got = [(r.msg, r.kind, r.pos, r.reject_reason) for r in venues.parse_market_messages(df).orderBy("msg", "pos").collect()]
    assert got == [
        (0, "snapshot", -1, None), (0, "snapshot", 0, None), (1, "snapshot", -1, None), (2, "invalid", 0, "invalid_json"), (3, "delta", 0, "changes"),
        (4, "ignored", 0, None), (5, "delta", 0, "changes"), (6, "ignored", 0, None), (7, "ignored", 0, None), (8, "invalid", 0, "invalid_json"),
        (9, "snapshot", -1, "levels")]
    rows = venues.parse_market_messages(df).where("reject_reason IS NULL AND kind IN ('snapshot', 'delta')").withColumn("ts_ms", F.col("event_ms"))
    assert book.book_levels(rows.where("msg = 0")).count() == 1 and book.book_levels(rows).count() == 0


def test_reports_in_every_format(spark, tmp_path):
    rep = spark.createDataFrame([("b", 2, None), ("a", 1, 0.5)], "name string, n int, x double")
    for fmt in ("markdown", "csv", "json"):
        sinks.write_report(rep, str(tmp_path / fmt), fmt, order=["name"])
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "markdown")).collect())
    assert text == "| name | n | x |\n|---|---|---|\n| a | 1 | 0.5000 |\n| b | 2 | n/a |"
    back = [spark.read.option("header", True).csv(str(tmp_path / "csv")), spark.read.json(str(tmp_path / "json"))]
    assert [{(r["name"], int(r["n"])) for r in b.collect()} for b in back] == [{("a", 1), ("b", 2)}] * 2
    with pytest.raises(ValueError):
        sinks.write_report(rep, str(tmp_path / "x"), "pdf")


def test_a_cluster_must_name_the_shared_folder():
    class Conf:
        def __init__(self, named):
            self.named = named

        def get(self, key, default):
            return self.named

    class Session:
        def __init__(self, master, named):
            self.conf = Conf(named)
            self.sparkContext = type("Context", (), {"master": master})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session("yarn", None))
    with pytest.raises(ValueError):
        session.checkpoint_dir(Session("local-cluster[2,1,1024]", None))
    assert session.checkpoint_dir(Session("yarn", "hdfs://x/y")) == "hdfs://x/y"
    assert session.checkpoint_dir(Session("local[2]", None)) == session.checkpoint_dir(Session("local[2]", None))


def test_files_are_hashed_in_pieces(spark, tmp_path):
    held = {"a.bin": b"", "b c%20.bin": b"abc", "d.bin": bytes(range(256)) * 12_289, "skip.txt": b"no", "e.gz.bin": gzip.compress(b"x")}
    for name, data in held.items():
        (tmp_path / name).write_bytes(data)
    got = sinks.lineage(spark, str(tmp_path), "set", "*.bin")
    assert {(r.path.rsplit("/", 1)[1], r.bytes, r.sha256, r.dataset) for r in got.collect()} == {
        (name, len(data), hashlib.sha256(data).hexdigest(), "set") for name, data in held.items() if data and name != "skip.txt"
    }
    assert "content" not in got._jdf.queryExecution().executedPlan().toString()
    assert sinks.file_digest(f"file://{tmp_path}/d.bin", len(held["d.bin"]), 7) == hashlib.sha256(held["d.bin"]).hexdigest()
    with pytest.raises(ValueError, match="bytes of"):
        sinks.file_digest(str(tmp_path / "d.bin"), 5)
