"""Between packed visits (one comma list per visit) and tidy rows (one code per row)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortloom.functions.text import item_text


def unpack(packed: DataFrame, column: str = "icd_code") -> DataFrame:
    """One row per code of a comma list."""
    keep = [c for c in packed.columns if c != column]
    return packed.select(*keep, F.explode(F.split(column, ",")).alias(column))


def count_codes(tidy: DataFrame, column: str = "icd_code") -> DataFrame:
    """Tidy rows in the counted form :func:`cohortloom.operators.cohort.basket_text` packs."""
    return tidy.groupBy("subject_id", "admit_id", item_text(F.col(column)).alias("item")).agg(
        F.count("*").alias("n")
    )
