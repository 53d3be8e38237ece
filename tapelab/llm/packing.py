"""Packing: token ids of all documents end to end, cut into sequences of a fixed length, with a record of every piece."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapelab.llm.common import keep, slices, text_of

LENGTH = 1024
#: The id that closes a document.
END = 0
#: Partitions whose totals are summed in one window: 800,000 input tasks make 800 rows of the second one.
BLOCK = 1024
ID_BYTES = 4


@functools.cache
def encoder(vocabulary: str | None = None):
    """The byte-level BPE of a rank file, as a function from a text to its ids (unsigned 32-bit).

    Strings that look like special tokens are plain text.
    """
    import public_tokenizers
    import tiktoken

    with open(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    made = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: made.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


def tokenised(docs: DataFrame, key: str, text: str, vocabulary: str | None, end: int) -> DataFrame:
    """First pass: key, ids (little-endian, ``end`` included), how many, the partition, and the ids before it there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, close = encoder(vocabulary), np.array([end], "<u4")
        part, before = TaskContext.get().partitionId(), 0
        for rows in slices(batches, "text"):
            ids = [x for t in rows.column("text").to_pylist() for x in (encode(t), close)]
            n = np.array([len(x) for x in ids], np.int64).reshape(-1, 2).sum(axis=1)
            at = np.concatenate(([0], np.cumsum(n)))
            data = pa.Array.from_buffers(
                pa.binary(), len(n), [None, pa.py_buffer((at * ID_BYTES).astype(np.int32)), pa.py_buffer(np.concatenate(ids))]
            )
            yield pa.RecordBatch.from_arrays(
                [rows.column("key"), pa.array(np.full(len(n), part)), pa.array(before + at[:-1]), pa.array(n), data],
                ["key", "part", "before", "n", "ids"],
            )
            before += int(at[-1])

    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, part long, before long, n long, ids binary")


def partition_starts(tokens: DataFrame) -> DataFrame:
    """Second pass: the ids in all partitions before each, from sums by partition, then by block of partitions."""
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total")).withColumn("block", F.expr(f"part div {BLOCK}"))
    blocks = totals.groupBy("block").agg(F.sum("total").alias("total"))
    upto = lambda w: F.coalesce(F.sum("total").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("block", upto(Window.partitionBy(F.lit(0)).orderBy("block")).alias("outer"))
    inner = totals.select("part", "block", upto(Window.partitionBy("block").orderBy("part")).alias("inner"))
    return inner.join(blocks, "block").select("part", (F.col("outer") + F.col("inner")).alias("base"))


def pack(
    docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, length: int = LENGTH, end: int = END
) -> DataFrame:
    """One row per piece: ``key``, start, length, ids (binary, little-endian 32-bit), doc_tokens, sequence_id, offset.

    All ids lie end to end, in the order of the input's partitions and of the rows in them; sequence s holds the ids from
    s * ``length`` on, so all sequences but the last are full and only that one needs padding. Null texts are empty: such a document
    is its end alone. Repeated rows and null keys are packed like others; an empty table gives no piece; other columns
    are not carried. The ids are written once with their places, so a task that is run again changes nothing.
    """
    tokens = keep(tokenised(docs, key, text, vocabulary, end), "packing-tokens")
    starts = keep(partition_starts(tokens), "packing-starts")
    placed = tokens.join(starts, "part").withColumn("_at", F.col("base") + F.col("before"))

    def piece(s: Column) -> Column:
        first = F.greatest(s * length, F.col("_at"))
        size = F.least((s + 1) * length, F.col("_at") + F.col("n")) - first
        start = first - F.col("_at")
        data = F.substring("ids", (start * ID_BYTES + 1).cast("int"), (size * ID_BYTES).cast("int"))
        fields = {"start": start, "length": size, "ids": data, "sequence_id": s, "offset": first - s * length}
        return F.struct(*(c.alias(name) for name, c in fields.items()))

    spans = F.sequence(F.expr(f"_at div {length}"), F.expr(f"(_at + n - 1) div {length}"))
    cut = placed.select("key", F.col("n").alias("doc_tokens"), F.inline(F.transform(spans, piece)))
    return cut.select(F.col("key").alias(key), "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


def sequences(pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per sequence: sequence_id, length, ids, and its boundary records (offset, length, key, start) in order.

    A sequence holds at most as many pieces as ids, so no group grows with the input.
    """
    record = F.sort_array(F.collect_list(F.struct("offset", "length", F.col(key).alias("key"), "start", "ids")))
    held = pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), record.alias("r"))
    ids = F.aggregate("r", F.lit(b""), lambda done, x: F.concat(done, x["ids"]))
    bounds = F.transform("r", lambda x: F.struct(x["offset"].alias("offset"), x["length"].alias("length"), x["key"].alias("key"), x["start"].alias("start")))
    return held.select("sequence_id", "length", ids.alias("ids"), bounds.alias("boundaries"))
