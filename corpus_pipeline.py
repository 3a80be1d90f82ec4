"""A corpus in five stages: reject low quality, drop exact copies, keep one of each near-duplicate group, remove
documents that hold benchmark items, pack the rest into sequences. Each stage works on all that the one before kept.

Defined cases: null texts count as empty in every stage, and of all empty texts one at most stays; rows with a null id
stay in near_duplicates, which decides by id, and lose to any id in exact_copies; rows that share an id go or stay
together in near_duplicates and are packed each for itself; very long texts are handled whole; of equal texts with
equal ids one row stays; an empty table gives an empty result with the same columns; extra columns are kept by all
stages but the last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, exact_dedup, ngram_join, packing, quality
from tidemark.llm._common import materialise, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model accepts; it learns from the labels of sf_dir."""
    return quality.keep(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup.survivors(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents, the one with the smallest id."""
    return ngram_join.keep_first(docs)


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequences and offsets."""
    return packing.pack(docs)


STAGES = [
    ("quality_filter", quality_filter),
    ("exact_copies", exact_copies),
    ("near_duplicates", near_duplicates),
    ("benchmark_items", benchmark_items),
    ("sequences", sequences),
]

#: A trained model and a tokenizer are beyond SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
