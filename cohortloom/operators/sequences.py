"""Frequent sequences of visit contents: thresholds, visit numbers, and the two kinds of sequences that are asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortloom.operators import lattice
from cohortloom.operators.lattice import min_count  # noqa: F401
from cohortloom.operators.ranks import dense_rank_within

DEFAULT_SUPPORT = 0.25

# Visits of a subject that are numbered together, whatever the length of its history.
CHUNK = 256


def renumber_visits(tidy: DataFrame, visit: str = "admit_id") -> DataFrame:
    """Dense visit numbers 1, 2, … per subject, for sources whose numbers have gaps."""
    return (
        dense_rank_within(tidy, ["subject_id"], visit, "_dense", F.floor(F.col(visit) / CHUNK))
        .drop(visit)
        .withColumnRenamed("_dense", visit)
    )


def occurrences(items: DataFrame, item: str = "item", visit: str = "admit_id") -> DataFrame:
    """Visit rows as single-item occurrences."""
    return items.select("subject_id", F.col(visit).cast("int").alias("visit"), F.col(item).alias("state"))


def frequent_sequences(
    items: DataFrame, support: float = DEFAULT_SUPPORT, max_elements: int | None = None
) -> DataFrame:
    """Frequent sequences of single items, ``states array<string>``: all that the sequence table keeps in the end.

    Support is relative to all subjects in ``items``.
    """
    mined = frequent_itemset_sequences(items, support, max_elements, 1)
    return mined.withColumn("states", F.flatten("states"))


def frequent_itemset_sequences(
    items: DataFrame, support: float = DEFAULT_SUPPORT, max_elements: int | None = None, max_items: int | None = None
) -> DataFrame:
    """Frequent sequences whose elements are item sets: ``states array<array<string>>``, ``count``, ``support``."""
    return lattice.mine(occurrences(items), support, max_elements, max_items)
