"""Mortality source: one death record to two visits and decoded demographics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from cohortloom.functions.text import code_list, drop_first
from cohortloom.sources.codebooks import MORTALITY_CODEBOOKS, codebook


def split_axes(records: DataFrame) -> DataFrame:
    """Entity and record axis: the causes before and after the first two-digit count."""
    parts = F.split("multiple_causes", r"\s\d{2}\s")
    return records.withColumns(
        {"entity_axis": F.get(parts, F.lit(0)), "record_axis": F.get(parts, F.lit(1))}
    )


def temporal(records: DataFrame) -> DataFrame:
    """Packed visits: the underlying cause at visit 1, the other record-axis causes at visit 2.

    Both visits come from one pass over the records; empty and missing lists give no visit.
    """
    rest = drop_first(F.col("record_axis"), F.col("underlying_cause"))
    visits = F.array(
        F.struct(F.lit(1).alias("admit_id"), F.col("underlying_cause").alias("codes")),
        F.struct(F.lit(2).alias("admit_id"), rest.alias("codes")),
    )
    return (
        split_axes(records)
        .select("ID", F.explode(visits).alias("v"))
        .filter(F.col("v.codes") != "")
        .select(F.col("ID").alias("subject_id"), F.col("v.admit_id").alias("admit_id"),
                code_list(F.col("v.codes")).alias("icd_code"))
    )


def decode(records: DataFrame, column: str) -> DataFrame:
    """Add ``<column>_label``; a missing code may have a label of its own."""
    book = F.broadcast(codebook(records.sparkSession, column))  # at most 23 rows
    return records.join(book, F.col(column).eqNullSafe(F.col(f"{column}_key")), "left").drop(f"{column}_key")


def demographics(records: DataFrame) -> DataFrame:
    decoded = reduce(decode, MORTALITY_CODEBOOKS, records)
    return decoded.select(
        F.col("ID").alias("subject_id"),
        F.col("res_status_label").alias("citizenship"),
        F.col("education_89_label").alias("education1"),
        F.col("education_03_label").alias("education2"),
        F.col("sex").alias("sex_at_birth"),
        F.col("age_group_label").alias("age_group"),
        F.col("age_infant_label").alias("age_infant"),
        "marital",
        F.col("race_label").alias("race"),
        F.col("hispanic_recode_label").alias("hispanic"),
    )
