"""The corpus pipeline: stages over the documents table, each written and reread.

Every stage takes empty tables and further columns of any name; all but the last return the columns they got.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from watchpost.llm import decontaminate, exact_dedup, near_copies, packing, quality
from watchpost.llm.common import read, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores 0.7 or more; it learns from the labelled ones among them.

    Null texts are scored as empty ones.  Without labels all documents stay.
    """
    return quality.keep_good(docs, quality.train(docs, read(spark, sf_dir, "labels")), threshold=0.7)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each different text stays, that of the largest doc_id; null texts count as empty, of equal rows one stays."""
    return exact_dedup.drop_exact_copies(docs, keep="largest")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of 0.8 similar 5-word shingle sets stays, that of the smallest doc_id; texts without words are one group."""
    return near_copies.drop_near_copies(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten-word window of a benchmark item stands; texts and items without words match nothing."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"), n=10)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents and their places in sequences of 1024 tokens; a null text is one end id."""
    return packing.pack(docs, room=1024)


STAGES = [("quality classifier", good_quality), ("exact dedup", exact_copies), ("SimHash near-dedup", without_near_copies),
          ("benchmark decontamination", benchmark_free), ("best-fit packing", packed)]
#: Trained scores, fingerprints and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
