"""A training corpus from raw documents: quality, exact and near duplicates, mixing, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; its result is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrajobs.functions.storage import drop, materialize
from terrajobs.llm import bpe_trie, exact_dedup, mixing, near_copies, quality


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels of the documents at hand."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id, and of rows that repeat it one."""
    return exact_dedup.deduplicate(docs, exact_dedup.open_index(spark), once=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard similarity 0.8 or more) the document with the smallest doc_id."""
    return near_copies.keep_representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks, so some more than once and some not at all."""
    return mixing.repeat_documents(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count, and digests of ids and decoded text, of every copy."""
    return bpe_trie.encode_digests(docs, bpe_trie.vocabulary_path())


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_exact_copies),
    ("simhash near-dedup", drop_near_copies),
    ("mix sources", mix_sources),
    ("bpe", encode_tokens),
]

#: A trained classifier, fingerprints and byte-pair encoding are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        last, docs = docs, materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        drop(last)
    return STAGES[-1][1](spark, docs, sf_dir)
