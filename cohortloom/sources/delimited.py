"""Delimited text: explicit schemas, several missing-value tokens, cleaned header names."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

# fixed values: texts that stand for a missing value
NA_TOKENS = ["NA", "", "NULL", "null"]
NA_TOKENS_TSV = [*NA_TOKENS, "\\N", "\\\\N"]


def strings(*names: str) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


def _raw(spark: SparkSession, path: str, schema: StructType, header: bool, sep: str, by_position: bool, multi_line: bool) -> DataFrame:
    """The wanted fields as text.  A backslash is data here ("\\N"), not an escape."""
    options = {"sep": sep, "escape": '"', "multiLine": multi_line}
    found = spark.read.csv(path, header=header, **options).columns  # the first line only
    if header and not by_position:
        # every file is held to the header of the first
        raw = spark.read.schema(strings(*found)).csv(path, header=True, enforceSchema=False, **options)
        cleaned = [clean_name(c) for c in found]
        missing = [n for n in schema.names if clean_name(n) not in cleaned]
        if missing:
            raise ValueError(f"{path} has no column {', '.join(missing)}; its columns are {', '.join(found)}")
        raw = raw.toDF(*[f"_{i}" for i in range(len(found))])
        return raw.select(*[F.col(f"_{cleaned.index(clean_name(n))}").alias(n) for n in schema.names])
    if found and len(found) != len(schema.names):
        raise ValueError(f"{path} has {len(found)} columns, not {len(schema.names)}")
    return spark.read.schema(strings(*schema.names)).csv(path, header=header, enforceSchema=True, **options)


def read_delimited(
    spark: SparkSession,
    path: str,
    schema: StructType,
    header: bool = True,
    sep: str = ",",
    na: list[str] | None = None,
    partitions: int | None = None,
    by_position: bool = False,
    multi_line: bool = False,
) -> DataFrame:
    """Read delimited text.

    With a header the columns of ``schema`` are picked by their cleaned names, wherever they stand
    and whatever else the file holds; one that is missing is an error.  Without a header, or with
    ``by_position`` (files whose headers are replaced), the columns are taken in order, and a
    different number of columns is an error.

    Fields are read as text, tokens for missing values become null, and only then is each column
    cast; a text that does not parse becomes null too.  A gzip file is one task however large it
    is: ``partitions`` spreads its rows before the work that follows.  ``multi_line`` lets quoted fields hold line breaks;
    a file is then one task as well, so large tables should come in many files.
    """
    tokens = NA_TOKENS if na is None else na
    raw = _raw(spark, path, schema, header, sep, by_position, multi_line)
    if partitions:
        raw = raw.repartition(partitions)
    return raw.select(
        *[
            F.when(~F.col(f.name).isin(tokens), F.col(f.name)).try_cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def read_tsv(spark: SparkSession, path: str, schema: StructType, header: bool = False) -> DataFrame:
    return read_delimited(spark, path, schema, header=header, sep="\t", na=NA_TOKENS_TSV)


def clean_name(name: str) -> str:
    """Header name without quotes, vendor prefixes and blanks, in lower case."""
    # fixed values: prefixes of the category file's headers
    for fragment in ("'", "ccs ", "multi ", "icd-10-cm ", " "):
        name = name.lower().replace(fragment, "")
    return name


def clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[clean_name(c) for c in df.columns])


def rename_position(df: DataFrame, position: int, name: str) -> DataFrame:
    """Rename the column at a 1-based position."""
    return df.toDF(*[name if i == position else c for i, c in enumerate(df.columns, start=1)])


def drop_containing(df: DataFrame, fragment: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if fragment in c])


def safe_file_name(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9._=+-]", "_", name)
