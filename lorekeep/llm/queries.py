"""The registered query of each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lorekeep.llm import byte_bpe, compact_windows, context_tree, cotraining, exact_search, importance, minhash_dedup, packing, quality_rules, suffix_dedup, token_counts, token_files, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that occur again, exactly or nearly, in all documents."""
    return compact_windows.near_duplicate_passages(table(spark, sf_dir, "documents"))


def op2_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated views, combined score and verdict for all documents."""
    return cotraining.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 ids."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products of every 50th vector with all the others."""
    return exact_search.top_k(table(spark, sf_dir, "embeddings"), every=50, k=5, scale=256)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple-8b token files of all documents, read back."""
    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of all documents and of what they decode to."""
    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 4-word shingles, Jaccard of 0.8 or more."""
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op8_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram base and context-tree scores of all documents; every tenth is held out."""
    return context_tree.score_texts(table(spark, sf_dir, "documents"), modulus=10, held_out=0)


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without 200-byte strings that start twice."""
    return suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts and the isolation forest's verdict for all documents."""
    return quality_rules.score_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 8 strongest whitened components of all vectors."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=8, scale=1024, shift=100000)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of all documents, drawn for their likeness to the benchmark texts."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=1, buckets=10000, seed="2024", min_words=20, percent=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_compact_windows": op1_compact_windows,
    "op2_cotraining": op2_cotraining,
    "op3_packing": op3_packing,
    "op4_exact_search": op4_exact_search,
    "op5_token_files": op5_token_files,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_minhash": op7_minhash,
    "op8_context_tree": op8_context_tree,
    "op9_suffix_array": op9_suffix_array,
    "op10_quality_rules": op10_quality_rules,
    "op11_whitening": op11_whitening,
    "op12_token_counts": op12_token_counts,
    "op13_importance": op13_importance,
}

ORACLE_SQL: dict[str, str] = {
    "op4_exact_search": """
        WITH usable AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
}
