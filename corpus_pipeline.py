"""The corpus pipeline: stages over the documents, each written and read again as the next one's input.

Rejected documents go, one of each group of near-duplicates stays, repeated byte strings are cut out, the sources are
mixed to equal weights, and every text is encoded.  All stages but the last return the columns of documents; n_chars
follows the text where a stage changes it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortloom.llm import mixing, near, quality, suffixes, tokens
from cohortloom.session import lineage_dir, tune

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return near.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    changed = suffixes.drop_repeats(docs)
    return changed.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else changed


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return tokens.token_digests(docs, ranks, public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_documents), ("near_duplicates", one_of_each_group), ("repeated_strings", without_repeats),
    ("mixture", mixed_sources), ("tokens", encoded),
]
ORACLE_SQL = None  # the outlier estimates, the components and the token ids have no SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of ``sf_dir``."""
    docs = tune(spark).read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{lineage_dir(spark)}/cohortloom/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return docs
