"""The corpus pipeline: quality rules, line dedup, near duplicates, decontamination, piece ids.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written
as parquet and read again as the next stage's ``docs``.  All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ridgeline.llm import decontaminate, jaccard, line_dedup, pieces, quality
from ridgeline.llm.common import small_batches, stash, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the model; the model learns from the labelled rows of ``docs``."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_blocks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of lines that an earlier one has; those left without a word go."""
    return line_dedup.drop_common_blocks(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 on five-word shingles."""
    return jaccard.keep_one(docs, percent=80, shingle=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as piece ids."""
    small_batches(spark)
    return pieces.encode_and_check(docs, ["doc_id", "lang", "source"])


STAGES = [
    ("quality", quality_rules),
    ("line_dedup", line_blocks),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pieces", piece_ids),
]

#: The trained model, patience diff and Viterbi are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
