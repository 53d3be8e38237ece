"""Streaming forms of the tick operators.

Aggregations use windows and watermarks; operators with their own memory use ``transformWithStateInPandas`` (lists and maps, of
which a batch writes what changed) or ``applyInPandasWithState``, with state bounded by a retention, a capacity or a book's price grid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tapelab.functions import times
from tapelab.functions.prices import positive
from tapelab.operators.book import DEPTH

SPOT_RETENTION_MS = 65 * 60 * 1_000
HORIZONS_MS = (1_000, 5_000, 10_000, 30_000, 60_000)


def tick_stream(raw: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Routes ticks to BTC or ETH by symbol; other symbols get a reject reason."""
    s = F.upper(symbol)
    asset = F.when(s.contains("BTC") | s.contains("XBT"), "BTC").when(s.contains("ETH"), "ETH")
    return raw.withColumns({"asset": asset, "reject_reason": F.when(asset.isNull(), "unsupported_symbol")})


def event_time(df: DataFrame, delay: str, exchange: str = "exchange_ms", local: str = "local_ms") -> DataFrame:
    """Adds ``event_ms`` and ``event_ts`` and sets the watermark."""
    ms = times.event_time(F.col(exchange), F.col(local))
    return df.withColumn("event_ms", ms).withColumn("event_ts", F.timestamp_millis("event_ms")).withWatermark("event_ts", delay)


def state_store(spark) -> None:
    """Queries started from here on keep their state in RocksDB, which the operators with list and map state need."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )


def late_rows(query) -> int:
    """Rows that a query has dropped behind its watermark so far.

    Operators that aggregate before their state count what is left after the tasks' own sums; ``trailing_flow`` counts rows.
    """
    return sum(int(op.numRowsDroppedByWatermark) for p in query.recentProgress for op in p.stateOperators)


def sliding_flow(df: DataFrame, key: str, span: str = "5 seconds", slide: str = "1 second") -> DataFrame:
    """Buy and sell volume per key and sliding window; state is one row per open window."""
    size = F.when(positive(F.col("qty")), F.col("qty"))
    buy = F.coalesce(F.sum(F.when(F.col("side") == "BUY", size)), F.lit(0.0))
    sell = F.coalesce(F.sum(F.when(F.col("side") == "SELL", size)), F.lit(0.0))
    out = df.groupBy(key, F.window("event_ts", span, slide)).agg(buy.alias("buy_vol"), sell.alias("sell_vol"))
    total = F.col("buy_vol") + F.col("sell_vol")
    return out.select(
        key, F.unix_millis("window.start").alias("start_ms"), F.unix_millis("window.end").alias("end_ms"),
        "buy_vol", "sell_vol", (F.col("buy_vol") - F.col("sell_vol")).alias("ofi"),
        F.when(total > 0, F.try_divide("buy_vol", total)).otherwise(0.0).alias("buy_ratio"),
    )


class _TrailingFlow(StatefulProcessor):
    """The ticks of one key and time slice until the watermark has passed them, and as long as later ticks look back on them."""

    def __init__(self, key: str, ident: str, short_ms: int, long_ms: int, slice_ms: int) -> None:
        self.key, self.ident, self.short, self.long, self.slice = key, ident, short_ms, long_ms, slice_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "ts BIGINT, id BIGINT, buy DOUBLE, sell DOUBLE, own BOOLEAN")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            own = (pdf["at_ms"] // self.slice == key[1]).to_numpy()
            values = zip(pdf["at_ms"].tolist(), pdf[self.ident].tolist(), pdf["buy"].tolist(), pdf["sell"].tolist(), own.tolist(), strict=True)
            self.rows.appendList(list(values))
            if own.any():
                low = int(pdf["at_ms"][own].min())
                first = low if first is None else min(first, low)
        self.handle.registerTimer((key[1] + 1) * self.slice)
        if first is not None:
            self.handle.registerTimer(first)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = sorted(self.rows.get()) if self.rows.exists() else []
        ts, ident = np.array([r[0] for r in held], np.int64), np.array([r[1] for r in held], np.int64)
        own = np.array([r[4] for r in held], bool)
        sums = [np.concatenate(([0.0], np.cumsum([r[i] for r in held]))) for i in (2, 3)]
        ready = own & (ts <= passed)
        now, end = ts[ready], np.searchsorted(ts, ts[ready], side="right")
        spans = {n: [s[end] - s[np.searchsorted(ts, now - ms, side="left")] for s in sums] for n, ms in (("short", self.short), ("long", self.long))}
        if (key[1] + 1) * self.slice <= passed:
            self.rows.clear()
        else:
            keep = (ts > passed - self.long) | (own & ~ready)
            left = [(t, i, b, s, bool(o and not r)) for (t, i, b, s, o), r, k in zip(held, ready.tolist(), keep.tolist(), strict=True) if k]
            self.rows.put(left) if left else self.rows.clear()
            waiting = ts[own & ~ready]
            if len(waiting):
                self.handle.registerTimer(int(waiting.min()))
        if ready.any():
            (sb, ss), (lb, ls) = spans["short"], spans["long"]
            yield pd.DataFrame({self.key: key[0], self.ident: ident[ready], "event_ms": now, "short_buy": sb, "short_sell": ss, "long_buy": lb, "long_sell": ls})
        else:
            yield pd.DataFrame()

    def close(self) -> None:
        pass


def trailing_flow(
    df: DataFrame, key: str, ident: str = "seq", short_ms: int = 1_000, long_ms: int = 5_000, basis: str = "short",
    empty_ratio: float = 0.0, slice_ms: int = 60_000,
) -> DataFrame:
    """Order flow of every tick over its trailing spans, closed at both ends: the live form of ``flow.order_flow``.

    A tick is emitted once the watermark has passed it, so the answer does not depend on how the stream is cut into batches; rows
    behind the watermark are dropped and counted (``late_rows``). State is dealt by key and time slice: a busy key
    is many tasks, a slice's state goes when the watermark passes its end, and ticks near that end are context of the next slice. Needs
    ``state_store``.
    """
    wide = max(slice_ms, long_ms)
    size = F.when(positive(F.col("qty")), F.col("qty"))
    home = F.expr(f"event_ms div {wide}")
    rows = df.select(
        key, ident, "event_ts", F.col("event_ms").alias("at_ms"),
        F.coalesce(F.when(F.col("side") == "BUY", size), F.lit(0.0)).alias("buy"),
        F.coalesce(F.when(F.col("side") == "SELL", size), F.lit(0.0)).alias("sell"),
        F.explode(F.when(F.col("event_ms") + long_ms >= (home + 1) * wide, F.array(home, home + 1)).otherwise(F.array(home))).alias("slice"),
    )
    kind = df.schema[key].dataType.simpleString()
    spans = "short_buy DOUBLE, short_sell DOUBLE, long_buy DOUBLE, long_sell DOUBLE"
    got = rows.groupBy(key, "slice").transformWithStateInPandas(
        _TrailingFlow(key, ident, short_ms, long_ms, wide), f"{key} {kind}, {ident} BIGINT, event_ms BIGINT, {spans}", "append", "EventTime"
    )
    b, s = (F.col("short_buy"), F.col("short_sell")) if basis == "short" else (F.col("long_buy"), F.col("long_sell"))
    total = b + s
    return got.select(
        key, ident, "event_ms", F.col("short_buy").alias("buy_vol"), F.col("short_sell").alias("sell_vol"),
        (F.col("short_buy") - F.col("short_sell")).alias("ofi_short"), (F.col("long_buy") - F.col("long_sell")).alias("ofi_long"),
        F.when(total > 0, F.try_divide(b - s, total)).otherwise(0.0).alias("imbalance"),
        F.when(total > 0, F.try_divide(b, total)).otherwise(F.lit(empty_ratio)).alias("buy_ratio"),
    )


def latest_venue_price(df: DataFrame, tie: str = "seq") -> DataFrame:
    """Newest usable price per asset and venue: the mid if both sides are positive, else the trade; ``tie`` orders equal times."""
    quoted = positive(F.col("best_bid")) & positive(F.col("best_ask"))
    p = F.when(quoted, (F.col("best_bid") + F.col("best_ask")) / 2.0).when(positive(F.col("price")), F.col("price"))
    good = df.withColumn("_p", p).where(F.col("_p").isNotNull())
    return good.groupBy("asset", "venue").agg(
        F.max_by("_p", F.struct("event_ms", tie)).alias("microprice"), F.max("event_ms").alias("as_of_ms")
    )


def _timeout(expire_ms: int | None) -> str:
    return GroupStateTimeout.NoTimeout if expire_ms is None else GroupStateTimeout.EventTimeTimeout


def _keep_until(state: GroupState, newest_ms: int, expire_ms: int | None) -> None:
    """The state goes once the watermark passes the newest time plus ``expire_ms``."""
    if expire_ms is not None:
        state.setTimeoutTimestamp(max(newest_ms + expire_ms, state.getCurrentWatermarkMs() + 1))


_HISTORY = "n INT, n_late BIGINT, oldest_ms BIGINT, newest_ms BIGINT, last_price DOUBLE, samples ARRAY<STRUCT<ts: BIGINT, price: DOUBLE>>"
_HISTORY_STATE = "ts ARRAY<BIGINT>, price ARRAY<DOUBLE>, late BIGINT"


def _history(df: DataFrame, key: str, ts: str, price: str, capacity: int, expire_ms: int | None) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()

    def update(group, batches: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        old_ts, old_price, late = state.get if state.exists else ([], [], 0)
        pdf = pd.concat(list(batches), ignore_index=True)
        held = pd.Series([*old_price, *pdf[price]], index=[*old_ts, *pdf[ts].astype("int64")])
        held = held[~held.index.duplicated(keep="last")].sort_index()
        kept = held.iloc[-capacity:]
        # a new sample older than what was held before, and than what is kept, came too late to count
        if old_ts:
            late += int((pdf[ts] < min(kept.index[0], old_ts[0])).sum())
        times_, prices_ = kept.index.tolist(), kept.tolist()
        state.update((times_, prices_, late))
        _keep_until(state, times_[-1], expire_ms)
        samples = [{"ts": t, "price": p} for t, p in zip(times_, prices_, strict=True)]
        yield pd.DataFrame(
            {key: [group[0]], "n": [len(times_)], "n_late": [late], "oldest_ms": [times_[0]], "newest_ms": [times_[-1]],
             "last_price": [prices_[-1]], "samples": [samples]}
        )

    stamp = [c for c in ("event_ts",) if c in df.columns]
    rows = df.where(positive(F.col(price))).select(key, ts, price, *stamp)
    return rows.groupBy(key).applyInPandasWithState(
        update, f"{key} {kind}, {_HISTORY}", _HISTORY_STATE, "update", _timeout(expire_ms)
    )


class _Samples(StatefulProcessor):
    """Samples of one key and time slice until the retention has passed: a list that a batch reads once and adds its changes to."""

    def __init__(self, key: str, ts: str, price: str, tie: str, retention_ms: int, slice_ms: int) -> None:
        self.names, self.retention, self.slice = (key, ts, price, tie), retention_ms, slice_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.samples = handle.getListState("samples", "ts BIGINT, tie BIGINT, price DOUBLE")

    @staticmethod
    def newest(rows: pd.DataFrame) -> pd.DataFrame:
        """The sample of each time with the highest tie, then price."""
        return rows.sort_values(["ts", "tie", "price"], kind="stable").drop_duplicates("ts", keep="last")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        name, ts, price, tie = self.names
        new = None
        for pdf in rows:
            part = self.newest(pd.DataFrame({"ts": pdf[ts], "tie": pdf[tie], "price": pdf[price]}))
            new = part if new is None else self.newest(pd.concat([new, part], ignore_index=True))
        self.handle.registerTimer((key[1] + 1) * self.slice + self.retention)
        stored = [tuple(r) for r in self.samples.get()] if self.samples.exists() else []
        if stored:
            held = self.newest(pd.DataFrame(stored, columns=["ts", "tie", "price"]))
            at = new.merge(held, "left", "ts", suffixes=("", "_was"))
            higher = (at["tie"] > at["tie_was"]) | ((at["tie"] == at["tie_was"]) & (at["price"] > at["price_was"]))
            new = at.loc[at["tie_was"].isna() | higher, ["ts", "tie", "price"]]
        if len(new):
            added = list(zip(*(new[c].tolist() for c in ("ts", "tie", "price")), strict=True))
            whole = {r[0]: r for r in [*zip(*(held[c].tolist() for c in held), strict=True), *added]} if stored else {}
            # What later samples have replaced goes once it is half of the list.
            if stored and len(stored) + len(added) > 2 * len(whole):
                self.samples.put(list(whole.values()))
            else:
                self.samples.appendList(added)
        yield pd.DataFrame({name: key[0], ts: new["ts"].tolist(), tie: new["tie"].tolist(), price: new["price"].tolist()})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.samples.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def spot_history(
    df: DataFrame, key: str = "asset", ts: str = "event_ms", price: str = "price", tie: str = "seq",
    retention_ms: int = SPOT_RETENTION_MS, slice_ms: int = 300_000,
) -> DataFrame:
    """The samples of the spot history as they come or change, late ones too: key, ts, tie, price.

    Of samples of one time the highest ``tie`` counts, whatever order they come in, so the newest row of each time in the output is the
    history for any cut of the stream; readers look back as far as they need. State is dealt by key and time slice, a batch
    reads its slices once and writes the samples that changed, and a slice goes once the watermark is the retention past its end. Rows behind the watermark
    are dropped and counted (``late_rows``), so its delay says how late a sample may be. Needs ``state_store``.
    """
    rows = df.where(positive(F.col(price))).select(key, ts, price, tie, "event_ts", F.expr(f"{ts} div {slice_ms}").alias("slice"))
    kind = df.schema[key].dataType.simpleString()
    return rows.groupBy(key, "slice").transformWithStateInPandas(
        _Samples(key, ts, price, tie, retention_ms, slice_ms), f"{key} {kind}, {ts} BIGINT, {tie} BIGINT, {price} DOUBLE", "update", "EventTime"
    )


def late_history(
    df: DataFrame, cap: int, key: str = "asset", ts: str = "event_ms", price: str = "price", expire_ms: int | None = None
) -> DataFrame:
    """The newest ``cap`` samples per key; an equal time replaces the older sample, ``n_late`` counts what came too late."""
    return _history(df, key, ts, price, cap, expire_ms)


class _Labels(StatefulProcessor):
    """Open evaluations of one key and time slice and the mids that they may need, packed as bytes by the batch."""

    def __init__(self, key: str, horizons_ms, grace_ms: int, partial: bool, slice_ms: int) -> None:
        self.key, self.names, self.h = key, [f"mid_{h}" for h in horizons_ms], np.array(horizons_ms, dtype=np.int64)
        self.last, self.partial, self.slice = int(self.h.max()) + grace_ms, partial, slice_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "mids BINARY, evals BINARY")
        self.seen = handle.getValueState("seen", "passed BIGINT")

    @staticmethod
    def packed(mids: np.ndarray, evals: np.ndarray, most: int = 100_000) -> list[tuple[bytes, bytes]]:
        """Mids (time, id, price by its bits) and evaluations (time, id) in pieces."""
        n = max(mids.shape[1], evals.shape[1])
        return [(mids[:, i : i + most].tobytes(), evals[:, i : i + most].tobytes()) for i in range(0, n, most)]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        end, pieces, first = (key[1] + 1) * self.slice, [], []
        for pdf in rows:
            new = pdf["is_eval"].to_numpy(dtype=bool)
            at, ident = pdf["event_ms"].to_numpy(dtype=np.int64), pdf["eval_id"].to_numpy(dtype=np.int64)
            price = pdf["price"].to_numpy(dtype=np.float64, na_value=np.nan).view(np.int64)
            pieces += self.packed(np.stack((at, ident, price))[:, ~new], np.stack((at, ident))[:, new])
            first += [int(at[new].min())] if new.any() else []
        # Once the watermark has passed the slice, mids are of use to open evaluations only.
        live = end >= timerValues.getCurrentWatermarkInMs()
        if live or first or self.rows.exists():
            self.rows.appendList(pieces)
        for at in [end] * live + [t + int(self.h.max()) for t in sorted(first)[:1]]:
            self.handle.registerTimer(at)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        # Several timers of a slice may end at once.
        if not self.rows.exists() or (self.seen.exists() and self.seen.get()[0] == passed):
            return
        held = [[np.frombuffer(x, np.int64).reshape(n, -1) for x, n in zip(r, (3, 2), strict=True)] for r in self.rows.get()]
        mids, (eval_ts, eval_id) = (np.concatenate(parts, axis=1) for parts in zip(*held, strict=True))
        del held
        mids = mids[:, np.lexsort((mids[1], mids[0]))]
        at = np.searchsorted(mids[0], eval_ts[:, None] + self.h, side="left")
        when = np.append(mids[0], np.iinfo(np.int64).max)[at]
        limit = eval_ts[:, None] + self.last
        found = when <= limit
        # a horizon is settled when the watermark has passed its mid, or the time until which one would count
        done = np.where(found, when, limit).max(axis=1) < passed
        emit = done & (found.all(axis=1) | self.partial)
        values = np.where(found, np.append(mids[2].view(np.float64), np.nan)[at], np.nan)[emit]
        open_ts, open_id = eval_ts[~done], eval_id[~done]
        # an evaluation may still come at the watermark
        low = [int(open_ts.min())] if len(open_ts) else []
        low += [passed] if (key[1] + 1) * self.slice >= passed else []
        kept = self.packed(mids[:, mids[0] >= min(low) + self.h.min()], np.stack((open_ts, open_id))) if low else []
        if kept:
            self.rows.put(kept)
            self.seen.update((passed,))
        else:
            self.rows.clear()
            self.seen.clear()
        if len(open_ts):
            self.handle.registerTimer(max(int(open_ts.min() + self.h.max()), passed))
        yield pd.DataFrame({self.key: key[0], "eval_id": eval_id[emit], "event_ms": eval_ts[emit]} | dict(zip(self.names, values.T, strict=True)))

    def close(self) -> None:
        pass


def stream_labels(
    df: DataFrame, key: str, horizons_ms=HORIZONS_MS, grace_ms: int = 60_000, partial: bool = True, slice_ms: int | None = None
) -> DataFrame:
    """Forward mids of every evaluation, however the stream is cut into batches.

    ``df`` is one stream of ``kind`` (eval/mid), ``event_ms``, ``eval_id`` and ``price`` with a watermark. The mid
    of a horizon is the first at or after its time (of equal times the lowest id), and no later than the last horizon
    plus the grace. It counts only once the watermark has passed it, so that no earlier one can come. An evaluation
    is emitted when all its horizons are settled; what is missing stays null (the row is dropped, if ``partial`` is false).
    State is dealt by key and time slice of the evaluations (by default as long as the last horizon and the grace): a mid goes to the slices
    whose evaluations may need it, two by default, and a slice holds its mids from the oldest open evaluation (or the watermark) on. Needs
    ``state_store``.
    """
    kind = df.schema[key].dataType.simpleString()
    last = int(max(horizons_ms)) + grace_ms
    wide = last if slice_ms is None else slice_ms
    is_eval = F.col("kind") == "eval"
    home = lambda back: F.floor((F.col("event_ms") - F.lit(int(back))) / wide).cast("long")
    slices = F.when(is_eval, F.array(home(0))).otherwise(F.sequence(home(last), home(min(horizons_ms))))
    rows = df.where(F.col("kind").isin("eval", "mid")).select(
        key, "event_ts", "event_ms", F.col("eval_id").cast("long").alias("eval_id"), F.col("price").cast("double").alias("price"), is_eval.alias("is_eval"),
        F.explode(slices).alias("slice"),
    )
    cols = ", ".join(f"mid_{h} DOUBLE" for h in horizons_ms)
    return rows.groupBy(key, "slice").transformWithStateInPandas(
        _Labels(key, horizons_ms, grace_ms, partial, wide), f"{key} {kind}, eval_id BIGINT, event_ms BIGINT, {cols}", "append", "EventTime"
    )


class _Book(StatefulProcessor):
    """Live levels of one token, a map entry each; the expected sequence and whether the book is stale."""

    def __init__(self, token: str, ts: str, expire_ms: int | None, depth: int) -> None:
        self.token, self.ts, self.expire, self.depth = token, ts, expire_ms, depth

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.levels = handle.getMapState("levels", "side STRING, price BIGINT", "quantity BIGINT")
        self.mark = handle.getValueState("mark", "expected BIGINT, stale BOOLEAN, until BIGINT")

    def hash(self, book: dict[tuple[str, int], int]) -> str:
        def side(name: str, sign: int) -> str:
            best = sorted((sign * p, p, q) for (s, p), q in book.items() if s == name)[: self.depth]
            return ",".join(f"{p}:{q}" for _, p, q in best)

        return hashlib.md5(f"{side('BID', -1)}|{side('ASK', 1)}".encode()).hexdigest()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["msg", "pos"])
        expected, stale, until = self.mark.get() if self.mark.exists() else (None, True, 0)
        before = {tuple(k): v[0] for k, v in self.levels.iterator()} if self.levels.exists() else {}
        book = dict(before)
        columns = [pdf[c].tolist() for c in ("msg", "kind", "sequence", "stated_hash", "side", "price_micros", "quantity")]
        last = None
        for i, (msg, kind, seq, stated, side, price, quantity) in enumerate(zip(*columns, strict=True)):
            if msg != last:
                last = msg
                seq = None if pd.isna(seq) else int(seq)
                if kind == "snapshot":
                    book.clear()
                    stale, expected = False, seq
                else:
                    stale = stale or (expected is not None and seq != expected + 1)
                    expected = expected if seq is None else seq
            if not pd.isna(quantity):
                if quantity > 0:
                    book[side, int(price)] = int(quantity)
                else:
                    book.pop((side, int(price)), None)
            ends = i + 1 == len(pdf) or columns[0][i + 1] != msg
            if ends and isinstance(stated, str) and stated != self.hash(book):
                stale = True
        for level in before.keys() - book.keys():
            self.levels.removeKey(level)
        for level, quantity in book.items():
            if before.get(level) != quantity:
                self.levels.updateValue(level, (quantity,))
        if self.expire is not None:
            until = max(until, int(pdf[self.ts].max()) + self.expire)
            self.handle.registerTimer(max(until, timerValues.getCurrentWatermarkInMs() + 1))
        self.mark.update((expected, stale, until))
        sides = [[p for s, p in book if s == name] for name in ("BID", "ASK")]
        yield pd.DataFrame(
            {self.token: [key[0]], "msg": [int(pdf["msg"].max())], "best_bid_micros": pd.array([max(sides[0], default=None)], "Int64"),
             "best_ask_micros": pd.array([min(sides[1], default=None)], "Int64"), "n_levels": [len(book)], "stale": [stale]}
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.mark.exists() and self.mark.get()[2] <= timerValues.getCurrentWatermarkInMs():
            self.levels.clear()
            self.mark.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def stream_book(
    df: DataFrame, token: str = "token_id", expire_ms: int | None = None, ts: str = "event_ms", depth: int = DEPTH
) -> DataFrame:
    """Book per token from snapshot and delta level rows; only a snapshot clears ``stale``.

    Rows carry ``msg, pos, kind, side, price_micros, quantity, sequence`` and, if messages state it, ``stated_hash``; a snapshot row
    without a level clears the book, so an empty snapshot leaves none. A book is stale before its first snapshot, after a gap
    in the sequence, and after a message whose hash is not that of the book then (``book.book_hash``). The state holds one
    entry per live level, which the price grid bounds, and a batch writes the changed ones; with ``expire_ms`` (and a watermark) it goes
    that long after the token's newest message. Needs ``state_store``.
    """
    kind = df.schema[token].dataType.simpleString()
    out = f"{token} {kind}, msg BIGINT, best_bid_micros BIGINT, best_ask_micros BIGINT, n_levels INT, stale BOOLEAN"
    if "stated_hash" not in df.columns:
        df = df.withColumn("stated_hash", F.lit(None).cast("string"))
    columns = ("msg", "pos", "kind", "side", "price_micros", "quantity", "sequence", "stated_hash")
    stamp = [c for c in ("event_ts",) if c in df.columns]
    rows = df.select(token, *columns, *([ts] if expire_ms is not None else []), *stamp)
    mode = "None" if expire_ms is None else "EventTime"
    return rows.groupBy(token).transformWithStateInPandas(_Book(token, ts, expire_ms, depth), out, "update", mode)


def stream_candles(df: DataFrame, key: str, price: str = "price", tie: str = "seq") -> DataFrame:
    """UTC-day candles, each emitted once the watermark passes its day; ``tie`` orders ticks of one time.

    Rows behind the watermark are dropped; ``late_rows`` tells how many.
    """
    good = df.where(positive(F.col(price)))
    out = good.groupBy(key, F.window("event_ts", "1 day")).agg(
        F.min_by(price, F.struct("event_ms", tie)).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, F.struct("event_ms", tie)).alias("close"),
    )
    return out.select(key, F.unix_millis("window.start").alias("start_ms"), "open", "high", "low", "close")


def stream_cooldown(
    df: DataFrame, key: str, interval_ms: int, ts: str = "event_ms", ident: str = "seq", expire_ms: int | None = None
) -> DataFrame:
    """Rows a limit of one per key and interval accepts; the state is one time per key.

    With ``expire_ms`` (at least the interval, and a watermark) it goes that long after the accepted time: no row that can still
    come would be held back by it.
    """
    kind = df.schema[key].dataType.simpleString()

    def update(group, batches: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        pdf = pd.concat(list(batches), ignore_index=True).sort_values([ts, ident])
        t, ids = pdf[ts].to_numpy(dtype=np.int64), pdf[ident].to_numpy(dtype=np.int64)
        picks = []
        i = 0 if last is None else int(np.searchsorted(t, last + interval_ms, side="left"))
        while i < len(t):
            picks.append(i)
            last = int(t[i])
            i = int(np.searchsorted(t, last + interval_ms, side="left"))
        if last is not None:
            state.update((last,))
            _keep_until(state, last, expire_ms)
        yield pd.DataFrame({key: [group[0]] * len(picks), ident: ids[picks], ts: t[picks]})

    stamp = [c for c in ("event_ts",) if c in df.columns]
    return df.select(key, ident, ts, *stamp).groupBy(key).applyInPandasWithState(
        update, f"{key} {kind}, {ident} BIGINT, {ts} BIGINT", "last BIGINT", "append", _timeout(expire_ms)
    )


def stream_tables(df: DataFrame, path: str, checkpoint: str, dedupe: list[str] | None = None):
    """Checkpointed table sink: a repeated batch overwrites its own folder, so none is lost or doubled."""
    rows = df.dropDuplicatesWithinWatermark(dedupe) if dedupe else df

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
