"""Ranks, row ids and top-n that never put one whole group, or one whole table, into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortloom.session import written

_BEFORE = (Window.unboundedPreceding, -1)


def dense_rank_within(
    df: DataFrame, keys: list[str], order: str, out: str, bucket: Column
) -> DataFrame:
    """Dense rank of ``order`` within ``keys``, null where ``order`` is null.

    A plain window would sort all rows of a key in one task, however many there are.  Here each
    (key, ``bucket``) is reduced to its distinct values, and the window only sees one number per
    bucket, to know how many values lie in the earlier ones.  ``bucket`` must grow with ``order``
    and hold a bounded number of distinct values.
    """
    buckets = (
        df.filter(F.col(order).isNotNull())
        .groupBy(*keys, bucket.alias("_bucket"))
        .agg(F.array_sort(F.collect_set(order)).alias("_values"))
    )
    # the window sees numbers only; the values stay where they were gathered
    sizes = buckets.select(*keys, "_bucket", F.size("_values").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(*_BEFORE))
    starts = sizes.select(*keys, "_bucket", F.coalesce(before, F.lit(0)).alias("_start"))
    ranks = buckets.join(starts, [*keys, "_bucket"]).select(*keys, "_start", F.posexplode("_values").alias("_at", order))
    ranks = ranks.select(*keys, order, (F.col("_start") + F.col("_at") + 1).cast("int").alias(out))
    return df.join(ranks, [*keys, order], "left")


def visit_bucket(col: str) -> Column:
    """Hour of the calendar: bounded in number per subject, and in distinct instants each."""
    return F.date_trunc("hour", F.col(col))


def _numbered(df: DataFrame, out: str, name: str) -> DataFrame:
    """Number the rows 1..n in the order of their partitions, and inside each as they stand.

    Ids drawn while scanning would change if a lost task were planned differently, so they are
    written once.  The offsets are one row per partition.
    """
    drawn = written(df.withColumn("_drawn", F.monotonically_increasing_id()), name)
    part = F.shiftright(F.col("_drawn"), 33)
    counts = drawn.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(*_BEFORE))
    starts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    inside = F.col("_drawn").bitwiseAND(F.lit((1 << 33) - 1))
    return drawn.withColumn("_part", part).join(starts, "_part").select(
        *df.columns, (F.col("_start") + inside + 1).alias(out)
    )


def dense_rank_all(df: DataFrame, order: str, out: str, ranges: int | None = None) -> DataFrame:
    """Dense rank of a column over the whole table, without a single-task window.

    The distinct values are dealt to ``ranges`` ranges (as many as there are shuffle partitions by
    default), sorted and numbered in each, and shifted by the ranges before.
    """
    values = df.filter(F.col(order).isNotNull()).select(order).distinct()
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranks = _numbered(values.repartitionByRange(n, order).sortWithinPartitions(order), out, "distinct_values")
    return df.join(ranks, order, "left")


def top_with_ties(df: DataFrame, measure: str, n: int) -> DataFrame:
    """Rows whose ``measure`` is among the ``n`` largest, ties at the edge included.

    The edge is found by a distributed top-n and compared as a scalar, so ties, however many,
    stay where they are.  ``df`` is an aggregate: it is written once rather than computed twice.
    """
    stored = written(df, "measured")
    edge = stored.select(measure).orderBy(F.desc(measure)).limit(n).agg(F.min(measure))
    return stored.filter(F.col(measure) >= edge.scalar())


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One full row per key: the smallest by ``order``, then by the remaining columns.

    An aggregation rather than a window, so each task keeps one row per key before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    ordered = order + [c for c in rest if c not in order]
    best = df.groupBy(*keys).agg(F.min(F.struct(*ordered)).alias("_row"))
    return best.select(*[c if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def with_row_ids(df: DataFrame, out: str) -> DataFrame:
    """Row ids 1..n."""
    return _numbered(df, out, "row_ids").select(out, *df.columns)


def ordinal_by_first_appearance(df: DataFrame, value: str, position: str, out: str) -> DataFrame:
    """Number the distinct values 1..n in the order of their smallest ``position``."""
    firsts = df.groupBy(value).agg(F.min(position).alias("_first"))
    return dense_rank_all(firsts, "_first", out).select(value, F.col(out).cast("string").alias(out))
