"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapelab.llm.common import keep

#: A rank of 60 bits is refined in steps of 12 bits.
RANK_BITS, STEP_BITS = 60, 12
#: No document is repeated, and no source is raised, beyond this many times its size.
MOST = 3


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null counts none."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def rank_of(doc_id: Column) -> Column:
    """60 bits of the md5 of the id as text: the document's place in the draw."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """Each source's target: weights 1, 2, 3, repeating, by code point with null last, raised to at most 3 times its size.

    ``sizes`` has one row per source (source, source_size). The excess of a source that would be raised further is
    shared again by weight until none is above. That is a water level: sorted by ``3 size / weight`` the sources at
    their limit are a prefix, and each of the others gets ``weight x level``. One task orders the sources (not their documents).
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weighted = sizes.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1).withColumn(
        "need", (F.col("source_size") * 6 / F.col("weight")).cast("long")
    )
    before = Window.orderBy("need", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shared = (
        weighted.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("left", F.col("total") - MOST * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("limited", F.col("weight") * F.col("left") >= MOST * F.col("source_size") * F.col("weights"))
    )
    level = F.struct("left", "weights")
    level = F.min(F.when(~F.col("limited"), F.struct(F.col("need"), F.col("source").isNull(), F.col("source"), level.alias("level")))).over(everything)
    return shared.withColumn("_level", level["level"]).select(
        "source",
        "source_size",
        F.when(F.col("limited"), (MOST * F.col("source_size")).cast("double"))
        .otherwise((F.col("weight") * F.col("_level.left")).cast("double") / F.col("_level.weights"))
        .alias("target"),
    )


def thresholds(ranked: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each source the largest rank that is still taken (-1: none), by nested histograms.

    ``wanted`` has (source, rest): the words to be drawn. Words are summed by source and by the first 12 bits of the
    rank; the bucket in which the running sum crosses ``rest`` is the boundary, and only its rows are summed by the next
    12 bits, down to one rank. The last rank is taken if that brings the sum nearer to ``rest``.
    """
    edge = wanted.select("source", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    done = []
    for bits in range(STEP_BITS, RANK_BITS + 1, STEP_BITS):
        shift = RANK_BITS - bits
        inside = ranked if bits == STEP_BITS else ranked.join(
            edge.select(F.col("source").alias("_s"), F.col("prefix").alias("_p")),
            F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("rank", shift + STEP_BITS) == F.col("_p")),
            "left_semi",
        )
        counts = inside.groupBy("source", F.shiftright("rank", shift).alias("bucket")).agg(F.sum("size").alias("size"))
        running = Window.partitionBy("source").orderBy("bucket")
        sums = (
            counts.join(edge.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
            .withColumn("upto", F.col("below") + F.sum("size").over(running))
            .withColumn("before", F.col("upto") - F.col("size"))
        )
        whole = F.max(F.when(F.col("upto") <= F.col("rest"), F.shiftleft(F.col("bucket") + 1, shift) - 1))
        cross = F.min(F.when(F.col("upto") > F.col("rest"), F.struct("bucket", "before", "upto")))
        found = keep(sums.groupBy("source", "rest").agg(whole.alias("whole"), cross.alias("cross")), "mix")
        done.append(found.select("source", F.col("whole").alias("last")))
        if shift == 0:
            near = (F.col("cross.before") < F.col("rest")) & (F.col("cross.before") + F.col("cross.upto") <= 2 * F.col("rest"))
            done.append(found.select("source", F.when(near, F.col("cross.bucket")).alias("last")))
        edge = found.where("cross IS NOT NULL").select(
            "source", "rest", F.col("cross.bucket").alias("prefix"), F.col("cross.before").alias("below")
        )
    union = done[0]
    for one in done[1:]:
        union = union.unionByName(one)
    return union.groupBy("source").agg(F.coalesce(F.max("last"), F.lit(-1)).alias("last"))


def plan_mix(ranked: DataFrame) -> DataFrame:
    """One row per source of (source, size, rank): source_size, target, times (whole repeats) and last (threshold)."""
    sizes = keep(targets(ranked.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-targets")
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    planned = sizes.withColumn("times", times).withColumn("rest", F.col("target") - F.col("times") * F.col("source_size"))
    last = thresholds(ranked, planned.select("source", "rest"))
    plan = planned.join(last.withColumnRenamed("source", "_l"), F.col("source").eqNullSafe(F.col("_l")), "left")
    return keep(plan.select("source", "source_size", "target", "times", F.coalesce("last", F.lit(-1)).alias("last")), "mix-plan")


def planned(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds source_size, target and taken to rows with (source, size, rank)."""
    plan = plan.withColumnRenamed("source", "_source")
    taken = F.col("size") * (F.col("times") + F.when(F.col("rank") <= F.col("last"), 1).otherwise(0))
    return rows.join(plan, F.col("source").eqNullSafe(F.col("_source")), "left").withColumn("taken", taken).drop("_source", "times", "last")


def ranked_rows(docs: DataFrame, id_column: str, text: str, source: str) -> DataFrame:
    return docs.select(
        F.struct("*").alias("doc"), F.col(id_column).alias("doc_id"), F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"), rank_of(F.col(id_column)).alias("rank"),
    )


def mix_sources(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken (words the mix takes, repeats counted).

    A source whose target is k whole times its size and a rest takes each document k times, and those whose rank lies
    under its threshold once more; so no document is taken more than 3 times, and the words taken miss the target by at
    most half the size of one rank. The draw depends on the id alone: reruns agree, and rows with one id go together.
    Null texts have size 0, null sources are a source of their own (last in the order), null ids rank as the empty text,
    an empty table gives no rows. A hot source is summed in parts before the shuffle; what is joined back
    is one row per source, and Spark picks the join by its size; a task orders at most 4096 buckets of a source.
    """
    ranked = keep(ranked_rows(docs, id_column, text, source).drop("doc"), "mix-ranked")
    return planned(ranked, plan_mix(ranked)).drop("rank")


def mixed_documents(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents of which the mix takes words: all their columns, and ``mix_taken`` (repeats counted).

    Nulls, repeated rows and ties as in ``mix_sources``; a document without words is never taken; an empty table gives no rows; a column
    ``mix_taken`` of the documents is replaced.
    """
    rows = ranked_rows(docs, id_column, text, source)
    plan = plan_mix(keep(rows.drop("doc"), "mix-ranked"))
    return planned(rows, plan).where("taken > 0").select(
        *[F.col(f"doc.`{c}`") for c in docs.columns if c.lower() != "mix_taken"], F.col("taken").alias("mix_taken")
    )
