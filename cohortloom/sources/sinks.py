"""Writers, and the readers of what they write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortloom.operators.cohort import CohortSpec, basket_text, counted_text
from cohortloom.session import forget, written
from cohortloom.sources.delimited import safe_file_name

KINDS = ("temporal", "association", "counted")


def write_delimited(df: DataFrame, path: str, quote_all: bool) -> None:
    """Comma-separated text without a header.

    With ``quote_all`` every field is quoted; without it only fields that need it are, so a comma
    inside a demographic value does not break its row.
    """
    df.write.csv(path, header=False, quoteAll=quote_all, escape='"', emptyValue="", nullValue="NA")


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """The native form of every result: parquet, partitioned where asked."""
    writer = df.write
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def basket_path(root: str, spec: CohortSpec, source: str, kind: str) -> str:
    """Output folder, a partition of the baskets in ``root``, built from every parameter of the cohort, its source and the kind of basket."""
    parts = _partition(spec, source, kind)
    return "/".join([root, *(f"{name}={value}" for name, value in parts.items())])


def _partition(spec: CohortSpec, source: str, kind: str) -> dict[str, str]:
    """Partition values; "=" would be written in another form in a path."""
    plain = [safe_file_name(v).replace("=", "-") for v in (source, spec.name(), kind)]
    return dict(zip(("source", "cohort", "kind"), plain))


def temporal_lines(items: DataFrame) -> DataFrame:
    """``subject,visit,item,item,…``"""
    return basket_text(items).select(
        F.concat_ws(",", F.col("subject_id").cast("string"), F.col("admit_id").cast("string"), "items").alias("value")
    )


def association_lines(items: DataFrame) -> DataFrame:
    """``subject,item,item,…``: one line per visit, the visit number left out."""
    return basket_text(items).select(
        F.concat_ws(",", F.col("subject_id").cast("string"), "items").alias("value")
    )


def counted_lines(items: DataFrame) -> DataFrame:
    """``subject,visit,item,n,item,n,…``"""
    return counted_text(items).select(
        F.concat_ws(",", F.col("subject_id").cast("string"), F.col("admit_id").cast("string"), "items").alias("value")
    )


def write_baskets(items: DataFrame, root: str, spec: CohortSpec, source: str, kind: str) -> str:
    """Write, or write again, the baskets of one cohort; those of others in ``root`` stay.

    The new files take the place of the old ones when all are written.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind of basket {kind!r}; choose one of {KINDS}")
    lines = {"temporal": temporal_lines, "association": association_lines, "counted": counted_lines}[kind](items)
    path = basket_path(root, spec, source, kind)
    lines = written(lines, "basket_lines")
    if lines.isEmpty():  # a partition without rows would be left as it was
        lines.write.mode("overwrite").text(path)
    else:
        values = {name: F.lit(value) for name, value in _partition(spec, source, kind).items()}
        lines.withColumns(values).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*values).text(root)
    forget(lines)
    return path


def read_temporal_baskets(spark: SparkSession, path: str) -> DataFrame:
    """Baskets back as one row per (subject, visit, distinct item)."""
    parts = F.split("value", ",")
    return (
        spark.read.text(path)
        .select(
            F.get(parts, F.lit(0)).cast("long").alias("subject_id"),
            F.get(parts, F.lit(1)).cast("long").alias("admit_id"),
            F.explode(F.array_distinct(F.slice(parts, 3, F.size(parts)))).alias("item"),
        )
    )


def read_counted_baskets(spark: SparkSession, path: str) -> DataFrame:
    """Counted baskets back as one row per (subject, visit, item) with its count ``n``."""
    parts = F.split("value", ",")
    pairs = F.transform(F.sequence(F.lit(2), F.size(parts) - 2, F.lit(2)), lambda i: F.struct(F.get(parts, i).alias("item"), F.get(parts, i + 1).cast("long").alias("n")))
    rows = spark.read.text(path).select(F.get(parts, F.lit(0)).cast("long").alias("subject_id"), F.get(parts, F.lit(1)).cast("long").alias("admit_id"), F.explode(pairs).alias("p"))
    return rows.select("subject_id", "admit_id", "p.item", "p.n")


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """Baskets back as transactions: the first field is the id, repeats within a line are dropped."""
    parts = F.split("value", ",")
    return spark.read.text(path).select(
        F.get(parts, F.lit(0)).alias("txn_id"),
        F.array_distinct(F.slice(parts, 2, F.size(parts))).alias("items"),
    )
