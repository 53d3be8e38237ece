"""Greedy rate limits: at most one accepted row per key and interval.

The chain "accept, wait, accept the next row" is sequential. It is split by time bucket: every bucket reports, for each time
a chain could enter at, the time from which the next row may be accepted after it has left; that short list is walked once per key in
time order, and the buckets then replay from their known entry on their own. All three steps stream over sorted partitions: none holds
more than a bucket's times, and the walk holds one number.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapelab.operators import scan
from tapelab.session import settle

_KEY, _T = "_key", "_t"


def _whole_buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of a partition sorted by key and bucket, cut where a bucket ends."""
    rest: pd.DataFrame | None = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if not len(pdf):
            continue
        last = (pdf[_KEY] == pdf[_KEY].iloc[-1]) & (pdf[scan.BUCKET] == pdf[scan.BUCKET].iloc[-1])
        cut = int(np.argmax(last.to_numpy()))
        rest = pdf.iloc[cut:].reset_index(drop=True)
        if cut:
            yield pdf.iloc[:cut].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest


class _Steps:
    """Of every row of whole buckets: its bucket's number and end, and the first row of the bucket an interval later."""

    def __init__(self, pdf: pd.DataFrame, width: int, interval: int) -> None:
        key, bucket, self.t = pdf[_KEY].to_numpy(), pdf[scan.BUCKET].to_numpy(), pdf[_T].to_numpy()
        fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])))
        self.starts = np.flatnonzero(fresh)
        self.code = np.cumsum(fresh) - 1
        self.end = np.append(self.starts[1:], len(key))[self.code]
        self.rel = self.t - bucket * width
        span = width + 2 * interval
        self.place = self.code * span + self.rel
        self.next = np.searchsorted(self.place, self.place + interval, side="left")
        self.span = span


def cooldown(
    df: DataFrame, by: Sequence[str], ts: str, interval_ms: int, tie: Sequence[str] = (),
    width: int = scan.HOUR_MS, out: str = "accepted", among: Column | None = None,
) -> DataFrame:
    """Adds ``out``: true on rows a first-come limit of one per interval would accept.

    Of rows of one time the first in ``tie`` order can be accepted. With ``among`` only rows where it is true take part.
    """
    interval = int(interval_ms)
    width = max(width, interval)
    # Keys of any type, nulls included, as one text.
    key = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")
    taking = F.lit(True) if among is None else F.coalesce(among, F.lit(False))
    times = df.where(taking).select(key.alias(_KEY), F.col(ts).cast("long").alias(_T)).where(F.col(_T).isNotNull())
    times = times.withColumn(scan.BUCKET, scan.bucket_of(F.col(_T), width))
    group = [_KEY, scan.BUCKET]
    schema = f"{_KEY} string, {scan.BUCKET} long"

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_buckets(batches):
            s = _Steps(pdf, width, interval)
            # The last row of the chain from each row: steps doubled until none moves.
            last = np.where(s.next < s.end, s.next, np.arange(len(pdf)))
            while not np.array_equal(further := last[last], last):
                last = further
            late = s.rel >= interval
            first_late = late & np.concatenate(([True], ~late[:-1] | (s.code[1:] != s.code[:-1])))
            may = ~late | first_late
            fresh = np.concatenate(([True], s.place[1:] != s.place[:-1]))
            at = np.flatnonzero(may & fresh)
            yield pdf.iloc[at].rename(columns={_T: "_enter"}).assign(_leave=s.t[last[at]] + interval)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        need, now, done = 0, None, None
        for pdf in batches:
            picks = []
            columns = (pdf[c].tolist() for c in (_KEY, scan.BUCKET, "_enter", "_leave"))
            for i, (k, b, enter, leave) in enumerate(zip(*columns, strict=True)):
                if k != now:
                    now, need, done = k, enter, None
                if b != done and enter >= need:
                    picks.append(i)
                    need, done = leave, b
            yield pdf.iloc[picks][[*group, "_enter"]].rename(columns={"_enter": "_start"})

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_buckets(batches):
            s = _Steps(pdf, width, interval)
            at = np.flatnonzero(pdf["_start"].to_numpy())
            picks = [at]
            while len(at):
                at = s.next[at[s.next[at] < s.end[at]]]
                picks.append(at)
            yield pdf.iloc[np.concatenate(picks)][[_KEY, _T]]

    dealt = times.repartition(*group)
    doors = dealt.sortWithinPartitions(*group, _T).mapInPandas(entries, f"{schema}, _enter long, _leave long")
    starts = doors.repartition(_KEY).sortWithinPartitions(*group, "_enter").mapInPandas(walk, f"{schema}, _start long")
    # Starts are rows of their own and are not joined: Spark drops a dealing out that follows a join by the same columns, and a join that
    # becomes a broadcast while it runs then leaves a bucket in several tasks.
    marked = times.select(*group, _T, F.lit(False).alias("_start"))
    begun = marked.unionByName(starts.select(*group, F.col("_start").alias(_T), F.lit(True).alias("_start")))
    begun = begun.repartition(*group).sortWithinPartitions(*group, _T)
    hits = begun.mapInPandas(replay, f"{_KEY} string, {_T} long").withColumn("_hit", F.lit(True))
    rows = df.withColumns({_KEY: key, _T: F.col(ts).cast("long"), "_among": taking}).join(hits, [_KEY, _T], "left")
    first = F.row_number().over(Window.partitionBy(_KEY, _T).orderBy(F.desc("_among"), *tie)) == 1
    ok = F.coalesce(F.col("_hit") & F.col("_among"), F.lit(False)) & first
    return rows.withColumn(out, ok).drop(_KEY, _T, "_among", "_hit")


def quote_lock(
    df: DataFrame, by: Sequence[str], ts: str, passes: str, lock_ms: int = 5_000, tie: Sequence[str] = (),
    width: int = scan.HOUR_MS,
) -> DataFrame:
    """Entries and cancels with one live quote per key.

    A row that fails the gate always ends the quote, so the passing rows after one failing row are a cooldown of their own:
    the first enters, the others skip while the quote lives, cancel and enter again. A cancel is counted where a live quote ends. The rows
    are marked in one pass and written once, as the cooldown reads them three times.
    """
    ok = F.coalesce(F.col(passes), F.lit(False))
    outputs = {"_was": scan.previous(passes), "_run": scan.latest(F.when(~ok, F.struct(ts, *tie)))}
    work = settle(scan.ordered(df, by, ts, outputs, tie, width), "quotes")
    was = F.coalesce(F.col(f"_was.`{passes}`"), F.lit(False))
    got = cooldown(work, [*by, "_run"], ts, lock_ms, tie, width, "entered", among=ok)
    ended = F.when(ok, F.col("entered") & was).otherwise(was)
    return got.withColumn("cancelled", ended).select(*df.columns, "entered", "cancelled")
