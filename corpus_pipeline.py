"""The corpus pipeline: rules, classifier, near-dedup, suffix-array dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; run()
writes each result as Parquet in the shared folder and hands it on. All stages but the last return
the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lorekeep.llm import cotraining, minhash_dedup, packing, quality_rules, suffix_dedup
from lorekeep.session import staged

#: Bytes that a worker may remember while it packs: executors still hold what the stages before have touched.
PACKING_CACHE = 32 << 20


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or that the isolation forest singles out go."""
    return quality_rules.filter_by_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier takes for bad or toxic go."""
    return cotraining.filter_by_classifier(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles, Jaccard of 0.8 or more."""
    return minhash_dedup.drop_near_duplicates(docs, k=5, percent=80)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes and more that occur twice are taken out of the texts."""
    return suffix_dedup.remove_repeats(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents in sequences of at most 4096 ids."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), cache_bytes=PACKING_CACHE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", classifier_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("suffix_array_dedup", suffix_dedup_stage),
    ("packing", packing_stage),
]

#: Fitted models and tokenizer files have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
