"""The corpus pipeline: five stages over ``documents``, each written and read again before the next.

Each stage works on all rows its predecessor kept, and returns the columns of ``documents``; the last adds ``mix_taken``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapelab.llm import decontam, mixing, neardup, pii, quality
from tapelab.llm.common import keep, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; the network learns from ``labels`` outside the held-out fold."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (shingles of five words, similarity of 0.8 or more)."""
    return neardup.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of ``benchmark``, up to its edits, go."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that disclose it are replaced in the texts; ``n_chars`` follows."""
    return pii.sanitised(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix of sources takes nothing go; ``mix_taken`` has the words it takes of the others."""
    return mixing.mixed_documents(docs)


STAGES = [("quality", classify), ("near_duplicates", deduplicate), ("decontamination", decontaminate), ("personal_data", sanitise), ("mix", mix)]

#: The quality model and the sketches can't be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
