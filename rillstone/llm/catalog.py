"""The registered queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.llm import backoff, bpe, graph_search, licenses, mixing, ngram_join, outliers, repair, resampling, spelling, substrings, token_counts, toxicity
from rillstone.llm.statements import statements

__all__ = ["queries", "statements"]

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op2_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judged(table(spark, sf_dir, "documents"))


def op3_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return graph_search.neighbours(vectors, vectors.filter("vec_id % 20 = 0"))


def op4_digest_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills a new cache from the documents with even ids, so that the run over all documents has hits and misses."""
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), token_counts.fresh_cache(spark)
    docs = table(spark, sf_dir, "documents")
    token_counts.count_tokens(docs.filter("doc_id % 2 = 0"), path, public_tokenizers.PATTERN, cache)
    return token_counts.count_tokens(docs, path, public_tokenizers.PATTERN, cache)


def op5_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked_components(table(spark, sf_dir, "documents"))


def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Towards the documents that are labelled good."""
    good = table(spark, sf_dir, "labels").filter("quality = 1")
    return resampling.resampled(table(spark, sf_dir, "documents"), good)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents"))


def op9_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounded to six digits, as sums in another order differ in the last ones."""
    scores = backoff.scored(table(spark, sf_dir, "documents"))
    rounded = [(F.floor(F.col(c) * 1e6 + 0.5).cast("double") / 1e6).alias(c) for c in ("score", "mean_score")]
    return scores.select("doc_id", "n_words", *rounded)


def op10_raked_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digits(mixing.mixed(table(spark, sf_dir, "documents")))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.audited(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Query]:
    return {
        "op1_byte_bpe": op1_byte_bpe,
        "op2_robust_outliers": op2_robust_outliers,
        "op3_graph_neighbours": op3_graph_neighbours,
        "op4_digest_cache": op4_digest_cache,
        "op5_weak_toxicity": op5_weak_toxicity,
        "op6_ngram_jaccard": op6_ngram_jaccard,
        "op7_importance_resampling": op7_importance_resampling,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_backoff_scores": op9_backoff_scores,
        "op10_raked_mixing": op10_raked_mixing,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_license_diagonals": op12_license_diagonals,
        "op13_conversation_repair": op13_conversation_repair,
    }
