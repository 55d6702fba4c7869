"""Corpus pipeline: quality, exact copies, near copies, benchmark passages, tokens.

Every stage works on all that its predecessor kept and takes effect on it.  All but the last return the
columns of ``documents``; each result is written as Parquet and read again as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evigraph.llm import quality
from evigraph.llm.decontaminate import clean
from evigraph.llm.exact_dedup import without_exact_copies
from evigraph.llm.near_dedup import without_near_copies
from evigraph.llm.queries import PIECES, table
from evigraph.llm.sentencepiece_codec import sentencepiece_tokens
from evigraph.llm.workspace import Workspace


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return without_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: shingles of five words, similarity of 0.8 or more."""
    return without_near_copies(docs, words=5, percent=80)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of a benchmark item."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as SentencePiece ids."""
    return sentencepiece_tokens(docs, PIECES)


STAGES = [("quality", good_quality), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("decontamination", benchmark_passages), ("sentencepiece", tokens)]

#: SQL can express neither the classifier nor the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    space = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = space.put(stage(spark, docs, sf_dir), name)
    return docs
