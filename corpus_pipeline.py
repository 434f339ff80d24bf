"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next one.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows of ``docs``. All but the last return the columns of
``docs``, in their order.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.llm import bpe, mixing, ngram_join, shared, substrings, toxicity

TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier scores below ``TOXIC``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn(docs, labels)
    score = "_toxic_score"
    return toxicity.scored(docs, model, *docs.columns, name=score).filter(F.col(score) < TOXIC).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id; rows without id stay."""
    groups = ngram_join.linked_components(docs.select("doc_id", "text"))
    dropped = shared.written(groups.filter("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words that a document with a smaller id has; ``n_chars`` follows the text."""
    out = substrings.deduplicated(docs, as_is=True)
    size = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    out = out.withColumn("n_chars", size) if "n_chars" in docs.columns else out
    return out.select(*[F.col("kept").alias(c) if c == "text" else F.col(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of documents whose tokens, without weights, have the target shares of sources, languages and topics.

    It is the largest that can have them: the value that is rarest against its target keeps all its documents.
    """
    return mixing.sampled(docs, unweighted=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, tokens`` of each document that is left."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(docs, path, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", drop_repeats),
    ("mixing", mix),
    ("byte_bpe", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
