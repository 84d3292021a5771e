"""Corpus pipeline: quality, exact and near duplicates, repeated passages, packing.

Each stage works on all rows that the stage before kept, and returns the columns of documents (the last one: pieces of
sequences). Stages are written as Parquet and read again, so a lost executor costs at most one stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayframe.llm.exact_dedup import exact_dedup
from wayframe.llm.jaccard_join import near_dedup
from wayframe.llm.packing import packed
from wayframe.llm.quality import quality_filter
from wayframe.llm.registry import table, tokenizer_file
from wayframe.llm.substring_dedup import without_repeats
from wayframe.llm.tables import Steps


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    return quality_filter(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one of the largest doc_id stays."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similarity 0.8 on five words join, the one of the smallest doc_id stays."""
    return near_dedup(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words and more that occurred before are cut; every document stays, n_chars follows its text."""
    return without_repeats(docs, size_column="n_chars")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids."""
    return packed(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("substring dedup", substrings), ("packing", packing),
]

#: SQL can express neither the classifier nor the tokenizer; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    steps = Steps(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = steps.table(stage(spark, docs, sf_dir), f"stage-{number}")
        if number:
            steps.drop(f"stage-{number - 1}")
    return docs
