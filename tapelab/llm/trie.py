"""Prefix trie of conversations by whole-sequence collapse.

Identical conversations become one weighted sequence; only one of each is spread over its prefixes. A prefix is known by
128 bits: the exclusive or, over its turns, of two 64-bit hashes of the turn and its place. n distinct prefixes share one by
accident with probability n^2 / 2^129. Texts are hashed at the scan and are not shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapelab.llm.common import keep

#: Conversations in a group, and the most turns that one takes from the first of its group.
GROUP, MOST = 5, 8
#: Turns of one conversation that are ordered together.
BLOCK = 4096
#: Ids in one chunk of an end list.
CHUNK = 4096
ID, PLACE = ("xa", "xb", "depth"), ("conv_id", "place")
NO_ENDS = hashlib.sha256(b"").hexdigest()


def places(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), ta, tb, bytes: the turns of each conversation by turn (null first), ties by the hashes.

    A long conversation is numbered in blocks of turn numbers; each block starts from the counts of the blocks before it.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.expr(f"turn div {BLOCK}").alias("block"),
        F.xxhash64(role, text).alias("ta"), F.xxhash64(text, role).alias("tb"), F.octet_length(text).cast("long").alias("bytes"),
    )
    rows = keep(rows, "trie-turns")
    counts = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    several = counts.withColumn("before", F.sum("n").over(earlier)).where("before > 0")
    local = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "ta", "tb"))
    later = several.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "before")
    found = rows.withColumn("local", local).join(later, (F.col("conv_id") == F.col("c")) & F.col("block").eqNullSafe(F.col("b")), "left")
    return found.select("conv_id", (F.col("local") + F.coalesce("before", F.lit(0))).alias("place"), "ta", "tb", "bytes")


def taken(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its group."""
    return F.crc32(conv.cast("string")) % (MOST + 1)


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, place, ta, tb, bytes of every rebuilt conversation, and a row of place 0 for each.

    Its first h turns are those of conversation c - c % 5 (all if fewer, none if absent), the others its own after its first h.
    """
    placed = keep(places(turns), "trie-places")
    first = F.col("conv_id") - F.col("conv_id") % GROUP
    convs = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = convs.select("conv_id", "n", first.alias("first"), taken(F.col("conv_id")).alias("h"))
    firsts = convs.where(F.col("conv_id") == F.col("first")).select(F.col("conv_id").alias("first"), F.col("n").alias("there"))
    convs = keep(convs.join(firsts, "first", "left").select("conv_id", "first", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("lent")), "trie-conversations")
    zero = [F.lit(0).cast("long").alias(c) for c in ("place", "ta", "tb", "bytes")]
    lent = placed.where((F.col("conv_id") % GROUP == 0) & (F.col("place") <= MOST)).withColumnRenamed("conv_id", "first")
    lent = lent.join(convs, "first").where("place <= h").select("conv_id", "place", "ta", "tb", "bytes")
    own = placed.join(convs, "conv_id").where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("lent")).alias("place"), "ta", "tb", "bytes")
    return convs.select("conv_id", *zero).unionByName(lent).unionByName(own)


def prefixes(rows: DataFrame) -> DataFrame:
    """conv_id, xa, xb, depth, bytes (of the last turn), upto (bytes of all turns): every prefix of the conversations given.

    A conversation is scanned in blocks of places; a block takes the hashes and bytes of the blocks before it.
    """
    rows = rows.withColumn("block", F.expr(f"place div {BLOCK}"))
    sums = rows.groupBy("conv_id", "block").agg(F.bit_xor("ha").alias("sa"), F.bit_xor("hb").alias("sb"), F.sum("bytes").alias("sn"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    over = {"pa": F.bit_xor("sa"), "pb": F.bit_xor("sb"), "pn": F.sum("sn")}
    later = sums.select("conv_id", "block", *(c.over(earlier).alias(n) for n, c in over.items())).where("block > 0")
    here = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"sa": F.bit_xor("ha").over(here), "sb": F.bit_xor("hb").over(here), "sn": F.sum("bytes").over(here)})
    rows = rows.join(later, ["conv_id", "block"], "left")
    plus = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return rows.select(
        "conv_id", F.col("sa").bitwiseXOR(plus("pa")).alias("xa"), F.col("sb").bitwiseXOR(plus("pb")).alias("xb"),
        F.col("place").alias("depth"), "bytes", (F.col("sn") + plus("pn")).alias("upto"),
    )


def end_digests(ends: DataFrame) -> DataFrame:
    """ID and ends_sha256 of every sequence, from rows of ID and conv_id.

    Rows are ranged by sequence and id, so the copies of one sequence are spread; each task writes runs of ids as chunks of
    bounded size, and the chunks of a sequence are then digested one after another in constant memory.
    """
    names = [*ID, "conv_id"]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, start = None, [], None

        def chunk() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{**dict(zip(ID, now, strict=True)), "start": start, "ids": ",".join(held)}])

        for part in batches:
            for *key, conv in zip(*(part.column(c).to_pylist() for c in names), strict=True):
                if key != now or len(held) == CHUNK:
                    if held:
                        yield chunk()
                    now, held, start = key, [], conv
                held.append(str(conv))
        if held:
            yield chunk()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for part in batches:
            out = []
            for *key, ids in zip(*(part.column(c).to_pylist() for c in (*ID, "ids")), strict=True):
                if key != now:
                    if now is not None:
                        out.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, KINDS, strict=True)], [*ID, "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*now, state.hexdigest()), KINDS, strict=True)], [*ID, "ends_sha256"])

    kinds = "xa long, xb long, depth long"
    runs = ends.select(*names).repartitionByRange(*names).sortWithinPartitions(*names).mapInArrow(chunks, f"{kinds}, start long, ids string")
    return runs.repartition(*ID).sortWithinPartitions(*ID, "start").select(*ID, "ids").mapInArrow(digests, f"{kinds}, ends_sha256 string")


KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.string())


def sequences(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The weighted sequences (ID, conv_id, weight, total, ends_sha256), and all rows with their place's hashes ha and hb."""
    ha, hb = (F.when(F.col("place") > 0, F.xxhash64(*c, "place")).otherwise(0) for c in (("ta", "tb"), ("tb", "ta")))
    rows = keep(rows.select("conv_id", "place", ha.alias("ha"), hb.alias("hb"), "bytes"), "trie-rows")
    whole = rows.groupBy("conv_id").agg(
        F.bit_xor("ha").alias("xa"), F.bit_xor("hb").alias("xb"), F.max("place").alias("depth"), F.sum("bytes").alias("total")
    )
    whole = keep(whole, "trie-whole")
    found = whole.groupBy(*ID).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight"), F.max("total").alias("total"))
    return found.join(end_digests(whole), list(ID)), rows


def nodes(turns: DataFrame) -> DataFrame:
    """Every node of the trie of rebuilt conversations, from rows of (conv_id, turn, role, text).

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Null
    roles and texts are empty; turns of one number are ordered by hash, repeated rows are turns of their own; rows without conv_id
    belong to no conversation and are left out; an empty table has no node; other columns are ignored.

    A node belongs to the sequence of its smallest member, and below a node of its own every prefix of a sequence is its own too.
    So each sequence carries the bytes above its first own node, and all sums over a subtree are sums over the sequences through its top.
    """
    seqs, rows = sequences(rebuilt(turns))
    seqs = keep(seqs, "trie-sequences")
    of = seqs.select("conv_id", F.col("depth").alias("length"), "weight", "total", F.col("ends_sha256").alias("ends"))
    paths = keep(prefixes(rows.join(seqs.select("conv_id"), "conv_id", "left_semi")).join(of, "conv_id"), "trie-prefixes")
    known = keep(paths.groupBy(*ID).agg(F.min("conv_id").alias("owner"), F.max(F.col("depth") < F.col("length")).alias("proper")), "trie-nodes")
    leaves = seqs.join(known.where("proper"), list(ID), "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    paths = keep(paths.join(known.drop("proper"), list(ID)), "trie-owned")
    foreign = F.col("owner") != F.col("conv_id")
    above = paths.where(foreign).groupBy("conv_id").agg(
        F.max("depth").alias("shared"), F.sum("bytes").alias("shared_bytes"), F.max_by("owner", "depth").alias("parent")
    )
    marks = seqs.select("conv_id").join(leaves, "conv_id", "left").join(above, "conv_id", "left").select(
        "conv_id", F.coalesce("leaf", F.lit(0)).cast("long").alias("leaf"), F.coalesce("shared", F.lit(-1)).alias("shared"),
        F.coalesce("shared_bytes", F.lit(0)).alias("shared_bytes"), "parent",
    )
    before = F.col("upto") - F.col("bytes")
    saved = F.col("weight") * (F.col("total") - before) - (F.col("total") - F.greatest(before, "shared_bytes"))
    parent = F.when(F.col("depth") == 0, None).when(F.col("depth") - 1 == F.col("shared"), F.col("parent")).otherwise(F.col("conv_id"))
    child = (F.col("depth") < F.col("length")) & (F.col("depth") >= F.col("shared"))
    out = paths.join(marks, "conv_id").groupBy(*ID).agg(
        F.min("conv_id").alias("conv_id"), F.max(F.when(~foreign, parent)).alias("parent_conv_id"), F.sum("weight").alias("n_convs"),
        F.sum(child.cast("long")).alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum(saved).alias("saved_tokens"),
        F.coalesce(F.max(F.when(F.col("depth") == F.col("length"), F.col("ends"))), F.lit(NO_ENDS)).alias("ends_sha256"),
    )
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
