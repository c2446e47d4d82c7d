"""A training-data pipeline over ``documents``: filter, deduplicate, mix and pack.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as
Parquet and read again as the next stage's documents. All but the last keep the columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import mixing, packing, quality, simhash, suffix_dedup
from plumbline.llm.common import ensure_checkpoint_dir
from plumbline.session import ship


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier does not reject."""
    ship(spark)
    return quality.keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar ones: SimHash, BK-trees, an exact check (five-word shingles, similarity 0.8)."""
    ship(spark)
    return simhash.drop_similar(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one already has."""
    ship(spark)
    return suffix_dedup.remove_repeated_bytes(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, repeated as the target weights ask."""
    ship(spark)
    return mixing.curriculum(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 1024 tokens."""
    ship(spark)
    import public_tokenizers

    cutted = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return packing.pack(cutted).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", quality_classifier),
    ("simhash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("source mixing", source_mix),
    ("best-fit packing", best_fit_packing),
]

#: SQL cannot express the classifier, the similarity classes or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{n}")
            docs = spark.read.parquet(f"{folder}/{n}")
    return docs
