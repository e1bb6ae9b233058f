"""The three supported sources and where their inputs come from."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Source:
    """What cohort selection needs from one source.

    ``selection`` are the visit rows conditions are looked up in, joined to the hierarchy on
    ``selection_key``; ``visits`` are the rows reported and mined.  They differ only where a source
    is searched by another code system than it is reported in.
    """

    name: str
    mapping: DataFrame
    visits: DataFrame
    demographics: DataFrame
    selection: DataFrame | None = None
    selection_key: str = "icd_code"
    keep_unmapped: bool = False
    dense_visits: bool = True  # whether visit numbers count 1, 2, … within each subject

    def selection_rows(self) -> DataFrame:
        return self.visits if self.selection is None else self.selection


# fixed values: names of the sources and the hierarchy each is joined to
SOURCE_MAPPINGS = {"mimic": "icd9", "cdc_mortality": "icd10", "aeolus": "icd9"}


def source(
    name: str,
    mappings: dict[str, DataFrame],
    visits: DataFrame,
    demographics: DataFrame,
    selection: DataFrame | None = None,
) -> Source:
    """Put a source together; the adverse-event source is selected by secondary code and keeps
    rows of unknown codes."""
    if name not in SOURCE_MAPPINGS:
        raise ValueError(f"unknown source {name!r}; choose one of {sorted(SOURCE_MAPPINGS)}")
    adverse = name == "aeolus"
    return Source(
        name=name,
        mapping=mappings[SOURCE_MAPPINGS[name]],
        visits=visits,
        demographics=demographics,
        selection=selection,
        selection_key="snomed_code" if adverse else "icd_code",
        keep_unmapped=adverse,
        dense_visits=not adverse,
    )


def reader(kind: str, **options) -> Callable[[SparkSession, str], DataFrame]:
    """How raw tables are fetched: ``parquet``, or ``jdbc`` with ``url#table`` as the location.

    ``options`` go to the database reader: with ``key`` and ``bounds`` a table is read in ranges,
    without them by one task.
    """
    if kind == "parquet":
        return lambda spark, location: spark.read.parquet(location)
    if kind == "jdbc":
        from cohortloom.sources.jdbc import read_table

        return lambda spark, location: read_table(spark, *location.rsplit("#", 1), **options)
    raise ValueError(f"unknown reader {kind!r}")
