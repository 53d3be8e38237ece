"""Shared pieces of the corpus operators: tables, hashing, words as hash arrays, settled intermediates."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapelab.session import scratch

#: Bytes of text that a vectorised step handles at once; one longer text makes a slice of its own.
SLICE_BYTES = 1 << 20
GOLD = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def fold_of(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % parts


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes an intermediate table to the shared folder and reads it back.

    It cuts the lineage: a lost executor costs a read, and rows that carry a generated id keep it.
    """
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over slices of bounded text size; ``fn`` gets one slice at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield from fn(part)

    return df.mapInArrow(run, schema)


def kept_rows(docs: DataFrame, text: str, good: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows of ``docs`` whose text (null: empty) is good, with all their columns, in one pass and without a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            texts = pa.RecordBatch.from_arrays([part.column(text).fill_null("")], ["text"])
            yield part.filter(pa.array(np.concatenate([np.zeros(0, bool), *(good(p.column("text")) for p in slices([texts]))])))

    return docs.mapInArrow(run, docs.schema)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches into slices of at most ``most`` bytes of text (one row at least)."""
    for batch in batches:
        ends = offsets_of(batch.column(column))
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
            yield batch.slice(at, min(to, n) - at)
            at = to


def offsets_of(texts: pa.Array) -> np.ndarray:
    """Byte offsets of the rows of a text column, as 64-bit integers."""
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    raw = np.frombuffer(texts.buffers()[1], kind) if texts.buffers()[1] is not None else np.zeros(1, kind)
    found = raw[texts.offset : texts.offset + len(texts) + 1]
    return found.astype(np.int64) if len(found) else np.zeros(1, np.int64)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, end to end, and the row borders in them."""
    at = offsets_of(texts)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads 64-bit values evenly."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WEIGHT = mix((_LOWER.astype(np.uint64) + np.uint64(1)) * GOLD)


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE), np.full(n, _INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of the byte hash and of its inverse modulo 2^64, at least n of them."""
    return _powers(1 << max(21, int(n).bit_length()))


def word_spans(raw: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of each row, and each row's first word (n + 1 values)."""
    word = ~_BLANK[raw]
    fresh = np.ones(len(raw) + 1, bool)
    fresh[1:-1] = ~word[:-1]
    fresh[borders] = True
    starts = np.flatnonzero(word & fresh[:-1])
    last = np.ones(len(raw), bool)
    last[:-1] = ~word[1:]
    last |= fresh_end(borders, len(raw))
    ends = np.flatnonzero(word & last) + 1
    return starts, ends, np.searchsorted(starts, borders)


def fresh_end(borders: np.ndarray, n: int) -> np.ndarray:
    """Marks the last byte of each row."""
    out = np.zeros(n, bool)
    inner = borders[(borders > 0) & (borders <= n)]
    out[inner - 1] = True
    return out


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, weight: np.ndarray = _WEIGHT) -> np.ndarray:
    """64-bit hashes of byte spans from one running polynomial; ``weight`` maps a byte to its 64-bit value."""
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(weight[raw] * up[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * GOLD)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, A-Z lower-cased, and each row's first word (n + 1 values)."""
    raw, borders = bytes_of(texts)
    starts, ends, first = word_spans(raw, borders)
    return span_hashes(raw, starts, ends), first


def rows_of(first: np.ndarray) -> np.ndarray:
    """The row of each item, from the rows' first items."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def list_array(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values))


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))
