"""Frequencies of conditions and demographic values."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortloom.functions.levels import level
from cohortloom.operators.cohort import times
from cohortloom.operators.ranks import top_with_ties


def _described(per_code: DataFrame, mapping: DataFrame, desc: str, on: str, sentinel: str | None) -> DataFrame:
    """Attach the condition; with a sentinel, unknown codes stay and stand under it."""
    names = mapping.select(on, F.col(desc).alias("condition"))
    if sentinel is None:
        return per_code.join(names, on)
    return per_code.join(names, on, "left").withColumn("condition", F.coalesce("condition", F.lit(sentinel)))


def condition_rows(
    tidy: DataFrame, mapping: DataFrame, mining_level: str, n: int = 20, on: str = "icd_code", sentinel: str | None = None
) -> DataFrame:
    """Visit rows per condition over all subjects, top ``n`` with ties.

    Rows are counted per code before the hierarchy is joined; a code with several rows in the
    hierarchy still counts once for each.
    """
    per_code = tidy.select(on, times(tidy).alias("_times")).groupBy(on).agg(F.sum("_times").alias("_n"))
    counts = (
        _described(per_code, mapping, level(mining_level).desc, on, sentinel)
        .groupBy("condition")
        .agg(F.sum("_n").alias("count"))
    )
    return top_with_ties(counts, "count", n)


def condition_patients(
    tidy: DataFrame, mapping: DataFrame, subjects: DataFrame, mining_level: str, n: int = 20, on: str = "icd_code",
    sentinel: str | None = None,
) -> DataFrame:
    """Distinct cohort subjects per condition, top ``n`` with ties."""
    desc = level(mining_level).desc
    pairs = (
        _described(tidy.select("subject_id", on), mapping.select(on, desc).distinct(), desc, on, sentinel)
        .select("subject_id", "condition")
        .distinct()
        .join(subjects, "subject_id", "left_semi")
    )
    return top_with_ties(pairs.groupBy("condition").agg(F.count("*").alias("count")), "count", n)


def value_counts(table: DataFrame, column: str) -> DataFrame:
    """Rows per value of one column."""
    return table.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count"))


def grouped_counts(table: DataFrame, by: list[str]) -> DataFrame:
    return table.groupBy(*by).agg(F.count("*").alias("count"))
