"""Writers. These are the only functions of the library that run jobs."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapelab.session import scratch as scratch  # noqa: PLC0414
from tapelab.session import settle

# The stored event tables and their columns after ``ts``.
_DIMS = "run_id STRING, pair_id STRING, market_id STRING, asset STRING, horizon STRING"
EVENT_TABLES = {
    "trades": "condition_id STRING, token_id STRING, outcome STRING, price DOUBLE, size DOUBLE, fee_bps DOUBLE, tx_hash STRING",
    "top_of_book": "token_id STRING, best_bid DOUBLE, best_ask DOUBLE, spread DOUBLE, mid DOUBLE",
    "book_snapshots": "token_id STRING, book_hash STRING, bids_json STRING, asks_json STRING, imbalance DOUBLE, microprice DOUBLE",
    "market_features": "condition_id STRING, mid DOUBLE, spread DOUBLE, momentum_5m DOUBLE, momentum_1h DOUBLE, volatility_1h DOUBLE, "
    "volume_24h DOUBLE, liquidity DOUBLE, one_day_change DOUBLE, minutes_to_resolution BIGINT, distance_to_target DOUBLE",
    "external_ticks": "symbol STRING, price DOUBLE, ret_5m DOUBLE, ret_1h DOUBLE, vol_1h DOUBLE",
    "news_items": "source STRING, condition_id STRING, text_en STRING, published_minutes_ago BIGINT, dedup_hash STRING",
    "signals": "condition_id STRING, state_seq BIGINT, state_hash STRING, state_json STRING, questions_json STRING, yes_pressure_5s DOUBLE, "
    "no_pressure_5s DOUBLE, move_persists DOUBLE, underreact_up DOUBLE, underreact_down DOUBLE, repricing_up_3_plus DOUBLE, "
    "repricing_up_2 DOUBLE, repricing_up_1 DOUBLE, repricing_flat DOUBLE, repricing_down_1 DOUBLE, repricing_down_2 DOUBLE, "
    "repricing_down_3_plus DOUBLE, repricing_confidence DOUBLE, fill_before_decay DOUBLE, fill_toxic DOUBLE, latency_ms BIGINT, "
    f"tokens_in BIGINT, tokens_out BIGINT, trigger STRING, variant STRING, {_DIMS}",
    "paper_decisions": "condition_id STRING, signal_ts TIMESTAMP, edge DOUBLE, threshold DOUBLE, decision STRING, variant STRING, "
    f"paper_price DOUBLE, size DOUBLE, fair_value DOUBLE, {_DIMS}",
    "resolutions": "condition_id STRING, winning_token_id STRING, winning_outcome STRING",
    "maker_markouts": "condition_id STRING, signal_ts TIMESTAMP, side STRING, price DOUBLE, size DOUBLE, mid_1s DOUBLE, mid_5s DOUBLE, "
    "mid_10s DOUBLE, mid_30s DOUBLE, mid_60s DOUBLE, variant STRING, pnl_1s_pp DOUBLE, pnl_5s_pp DOUBLE, pnl_10s_pp DOUBLE, "
    f"pnl_30s_pp DOUBLE, pnl_60s_pp DOUBLE, {_DIMS}",
    "ab_pairs": "run_id STRING, pair_id STRING, market_id STRING, asset STRING, horizon STRING, condition_id STRING, status STRING, "
    "state_seq BIGINT, observed_at_ms BIGINT, control_ok BIGINT, quant_ok BIGINT",
    "paper_fills": f"condition_id STRING, variant STRING, side STRING, order_id BIGINT, price DOUBLE, size DOUBLE, filled_at_ms BIGINT, maker BIGINT, {_DIMS}",
    "paper_equity": "condition_id STRING, variant STRING, position DOUBLE, realized_pnl DOUBLE, unrealized_pnl DOUBLE, total_pnl DOUBLE, "
    f"exposure DOUBLE, {_DIMS}",
    "signal_markouts": "condition_id STRING, variant STRING, signal_ts TIMESTAMP, ref_price DOUBLE, mid_1s DOUBLE, mid_5s DOUBLE, "
    "mid_10s DOUBLE, mid_30s DOUBLE, mid_60s DOUBLE, mo_1s_pp DOUBLE, mo_5s_pp DOUBLE, mo_10s_pp DOUBLE, mo_30s_pp DOUBLE, "
    f"mo_60s_pp DOUBLE, {_DIMS}",
    "trade_episodes": "episode_id STRING, strategy_version STRING, market STRING, asset STRING, horizon STRING, judge_start_ts_ms BIGINT, "
    "judge_latency_ms BIGINT, submit_latency_ms BIGINT, order_arrival_ts_ms BIGINT, side STRING, limit_price DOUBLE, stake_usd DOUBLE, "
    "shares DOUBLE, fill_ts_ms TIMESTAMP, fill_price DOUBLE, fill_qty DOUBLE, exit_type STRING, exit_price DOUBLE, exit_ts_ms TIMESTAMP, "
    "gross_pnl_usd DOUBLE, fees_usd DOUBLE, rebates_usd DOUBLE, net_pnl_usd DOUBLE, max_adverse_excursion_usd DOUBLE, "
    "max_favorable_excursion_usd DOUBLE, capital_seconds_usd_s DOUBLE, pnl_historical_usd DOUBLE, pnl_current_usd DOUBLE, "
    "fill_profile STRING, is_maker BOOLEAN, fee_regime STRING, hedge_pair_id STRING, prompt_version STRING, model STRING",
}
QUOTE_TAPE = (
    "ts_ms BIGINT, condition_id STRING, asset STRING, horizon STRING, yes_bid DOUBLE, yes_ask DOUBLE, bid_size DOUBLE, "
    "ask_size DOUBLE, bid_depth_5c DOUBLE, ask_depth DOUBLE, has_ask_depth BOOLEAN, spread DOUBLE, mid DOUBLE, source STRING, fidelity STRING, date STRING"
)
EVALUATIONS = (
    "timestamp BIGINT, state_hash STRING, questions_hash STRING, model_id STRING, model_version STRING, strategy_version STRING, "
    "prompt_version STRING, question_document_sha256 STRING, question_schema_version STRING, feature_builder_version STRING, "
    "normalization_version STRING, serialization_version STRING, variant STRING, yes_pressure_5s DOUBLE, no_pressure_5s DOUBLE, "
    "move_persists DOUBLE, underreact_up DOUBLE, underreact_down DOUBLE, repricing_ticks STRING, repricing_confidence DOUBLE, "
    "fill_before_decay DOUBLE, fill_toxic DOUBLE, observed_latency_ms BIGINT, tokens_in BIGINT, tokens_out BIGINT, attempt_count BIGINT, "
    "error STRING, trigger STRING, split STRING, fidelity STRING, live BOOLEAN"
)


def shaped(df: DataFrame, schema: str) -> DataFrame:
    """The schema's columns in order; absent ones are null."""
    fields = T._parse_datatype_string(schema).fields
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in fields
        ]
    )


def event_columns(name: str) -> dict[str, str]:
    """The columns of an event table after its time, and their types."""
    return dict(c.split() for c in EVENT_TABLES[name].split(", "))


def write_event_table(df: DataFrame, name: str, path: str, mode: str = "append", clustered: bool = False) -> None:
    """One of the event tables, partitioned by UTC day and sorted by time inside a file.

    The rows are clustered by day with AQE free to split large days, so a day is neither
    thousands of small files nor one task. ``clustered``: the rows come from files that hold few days each (``by_day``) and
    are not dealt out again.
    """
    rows = shaped(df, f"ts TIMESTAMP, {EVENT_TABLES[name]}").withColumn("date", F.to_date("ts"))
    rows = rows if clustered else rows.hint("rebalance", "date")
    rows.sortWithinPartitions("date", "ts").write.mode(mode).partitionBy("date").parquet(path)


def by_day(df: DataFrame, day: Column, name: str, path: str | None = None) -> DataFrame:
    """The rows clustered by day and written once, for a source of several event tables: their writes then need no shuffle."""
    rows = df.withColumn("_day", day).hint("rebalance", "_day").sortWithinPartitions("_day")
    return settle(rows, name, path).drop("_day")


def drop(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared storage that nothing reads any more, and the shuffle files of jobs that are over.

    Spark keeps the latter until the driver collects its garbage, which one that only plans seldom does.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    spark._jvm.System.gc()


def write_checked(df: DataFrame, path: str, schema: str = QUOTE_TAPE, partition: str | None = "date") -> int:
    """Writes, reads back, and fails unless schema and row count agree; returns the count."""
    from pyspark.sql import Observation

    seen = Observation()
    rows = shaped(df, schema).observe(seen, F.count(F.lit(1)).alias("n"))
    writer = rows.write.mode("errorifexists")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
    want = T._parse_datatype_string(schema)
    back = df.sparkSession.read.schema(want).parquet(path)
    stored = df.sparkSession.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", "false").parquet(path)
    got = {f.name: f.dataType for f in stored.schema.fields if f.name != partition}
    expected = {f.name: f.dataType for f in want.fields if f.name != partition}
    if got != expected:
        raise ValueError(f"stored schema differs: {got} != {expected}")
    n = back.count()
    if n != seen.get["n"]:
        raise ValueError(f"stored {n} rows, wrote {seen.get['n']}")
    return n


def write_evaluations(df: DataFrame, path: str, mode: str = "append") -> None:
    shaped(df, EVALUATIONS).write.mode(mode).parquet(path)


def write_report(df: DataFrame, path: str, fmt: str, mode: str = "overwrite", order: Sequence[str] = ()) -> None:
    """A summary as CSV, JSON or a Markdown table (its rows in ``order``)."""
    if fmt == "markdown":
        df.sparkSession.createDataFrame([(markdown(df, order or df.columns),)], "value string").coalesce(1).write.mode(mode).text(path)
    elif fmt == "csv":
        df.write.mode(mode).option("header", True).csv(path)
    elif fmt == "json":
        df.write.mode(mode).json(path)
    else:
        raise ValueError(f"unknown report format {fmt}")


def markdown(summary: DataFrame, order: Sequence[str], limit: int = 10_000) -> str:
    """A Markdown table of a summary; refuses anything that is not one."""
    rows = summary.orderBy(*order).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report of more than {limit} rows is not a summary; write it as a table")
    cell = lambda v: "n/a" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    head = "| " + " | ".join(summary.columns) + " |"
    rule = "|" + "|".join(["---"] * len(summary.columns)) + "|"
    return "\n".join([head, rule, *("| " + " | ".join(cell(v) for v in r) + " |" for r in rows)])


def lineage(spark: SparkSession, path: str, dataset: str, glob: str = "*") -> DataFrame:
    """One row per file: path, size, change time and SHA-256, hashed on the executors.

    Spark lists the files; a worker reads each from the file system in pieces of 1 MB, so a file may have any size and takes
    constant memory. A file that changed or went since the listing fails the query; empty files have no row, as Spark's scans
    leave them out.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length", "modificationTime")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            named = zip(part.column("path").to_pylist(), part.column("length").to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([file_digest(p, n) for p, n in named], pa.string())], [*part.schema.names, "sha256"])

    found = files.mapInArrow(run, "path string, length long, modificationTime timestamp, sha256 string")
    return found.select(
        F.lit(dataset).alias("dataset"), "path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), "sha256",
    )


def file_digest(path: str, length: int, piece: int = 1 << 20) -> str:
    """SHA-256 of a file of a known length, by its path or URI."""
    if urlsplit(path).scheme in ("", "file"):
        system, place = fs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    else:
        system, place = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
    found, seen = hashlib.sha256(), 0
    with system.open_input_stream(place, compression=None) as stream:
        while data := stream.read(piece):
            found.update(data)
            seen += len(data)
    if seen != length:
        raise ValueError(f"{path}: read {seen} bytes of {length}")
    return found.hexdigest()


def lineage_entry(before: DataFrame, after: DataFrame, ts: str, market: str, dataset: str, filters: str) -> DataFrame:
    """Row counts before and after, time range and markets of one processing step."""
    b = before.agg(F.count(F.lit(1)).alias("rows_before"))
    a = after.agg(
        F.count(F.lit(1)).alias("rows_after"), F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"),
        F.approx_count_distinct(market).alias("markets_approx"),
    )
    return a.withColumns({"rows_before": b.scalar(), "dataset": F.lit(dataset), "filters": F.lit(filters)})
