"""Corpus pipeline: toxicity, near duplicates, repeated passages, benchmark passages, packing.

Each stage takes what its predecessor kept, is written as Parquet and read again by the next one, so a
lost executor costs at most its own stage. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shoalmap.llm.decontaminate import drop_contaminated
from shoalmap.llm.packing import packed
from shoalmap.llm.queries import table
from shoalmap.llm.simhash import keep_one
from shoalmap.llm.substring_dedup import remove_repeats
from shoalmap.llm.toxicity import drop_toxic
from shoalmap.session import cut


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose most toxic sentence scores 0.5 or more go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose three-word fingerprints are linked by three bits or fewer, the one with the
    smallest doc_id stays."""
    return keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated passages go from all documents but the first; empty ones go."""
    return remove_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, with their sequences and offsets."""
    return packed(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

# SQL can't express a trained classifier and a tokenizer; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
