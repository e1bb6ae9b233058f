"""Registered queries of the operators: each applies one with its production parameters to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cohortloom.llm import anchors, archive, imatch, langid, lm, mixing, near, orchard, quality, suffixes, tokens, whitening, wordpieces
from cohortloom.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(tune(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return run


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@_query
def op1_tokens(spark, sf_dir):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return tokens.token_digests(_documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)


@_query
def op2_suffixes(spark, sf_dir):
    return suffixes.repeat_report(_documents(spark, sf_dir))


@_query
def op3_language(spark, sf_dir):
    return langid.language_report(_documents(spark, sf_dir))


@_query
def op4_imatch(spark, sf_dir):
    return imatch.neighbour_report(_documents(spark, sf_dir))


@_query
def op5_quality(spark, sf_dir):
    return quality.quality_report(_documents(spark, sf_dir))


@_query
def op6_archive(spark, sf_dir):
    return archive.archived(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@_query
def op7_mix(spark, sf_dir):
    """Every source at the same weight; the mixture is as large as the input on average."""
    return mixing.mixture_report(_documents(spark, sf_dir))


@_query
def op8_mixing_lm(spark, sf_dir):
    return lm.score(_documents(spark, sf_dir))


@_query
def op9_near(spark, sf_dir):
    return near.component_report(_documents(spark, sf_dir))


@_query
def op10_anchors(spark, sf_dir):
    return anchors.repeat_report(_documents(spark, sf_dir))


@_query
def op11_whitening(spark, sf_dir):
    return whitening.whitening_report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@_query
def op12_orchard(spark, sf_dir):
    return orchard.cluster_report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@_query
def op13_wordpieces(spark, sf_dir):
    return wordpieces.token_digests(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


ORACLES |= {"op12_orchard": orchard.oracle_sql(), "op6_archive": archive.ORACLE_SQL, "op7_mix": mixing.ORACLE_SQL}
