"""Cohorts of the form "condition 1, with or without condition 2", and what is made from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from cohortloom.functions.levels import level
from cohortloom.functions.text import item_text, label_code
from cohortloom.operators.ranks import first_per_key


@dataclass(frozen=True)
class CohortSpec:
    """Conditions are given as a code or as a "code - description" label."""

    condition_1: str
    condition_2: str
    level_1: str = "ccs2"
    level_2: str = "ccs2"
    mining_level: str = "ccs2"
    with_second: bool = True
    repeat_visits: bool = True

    def name(self) -> str:
        """Name built from every parameter, so that different cohorts never share one."""
        sign = "plus" if self.with_second else "minus"
        visits = "repeat" if self.repeat_visits else "all"
        one, two = label_code(self.condition_1), label_code(self.condition_2)
        return f"{self.level_1}={one}_{sign}_{self.level_2}={two}_{visits}_{self.mining_level}"


def _is(name: str, condition: str) -> Column:
    return F.coalesce(F.col(level(name).code).cast("string") == label_code(condition), F.lit(False))


def membership(tidy: DataFrame, mapping: DataFrame, spec: CohortSpec, on: str = "icd_code") -> DataFrame:
    """One row per subject with condition 1 or 2: ``has_1``, ``has_2``.

    Only the codes standing for either condition are joined, one row each, and both conditions
    are decided by one aggregation, so a subject leaves each task as a single row.  With
    ``repeat_visits`` the condition-1 row itself must be at visit 2 or later; condition 2 counts
    at any visit.
    """
    wanted = (
        mapping.select(on, _is(spec.level_1, spec.condition_1).alias("_1"), _is(spec.level_2, spec.condition_2).alias("_2"))
        .filter("_1 or _2")
        .groupBy(on)
        .agg(F.max("_1").alias("_1"), F.max("_2").alias("_2"))
    )
    first = F.col("_1") & (F.col("admit_id") > 1) if spec.repeat_visits else F.col("_1")
    return (
        tidy.select("subject_id", "admit_id", on)
        .join(wanted, on)
        .groupBy("subject_id")
        .agg(F.max(first).alias("has_1"), F.max("_2").alias("has_2"))
    )


def base_cohort(members: DataFrame) -> DataFrame:
    return members.filter("has_1").select("subject_id")


def cohort_plus(members: DataFrame) -> DataFrame:
    return members.filter("has_1 and has_2").select("subject_id")


def cohort_minus(members: DataFrame) -> DataFrame:
    return members.filter("has_1 and not has_2").select("subject_id")


def cohort(tidy: DataFrame, mapping: DataFrame, spec: CohortSpec, on: str = "icd_code") -> DataFrame:
    members = membership(tidy, mapping, spec, on)
    return cohort_plus(members) if spec.with_second else cohort_minus(members)


def unique_codes(coded: DataFrame, subjects: DataFrame) -> DataFrame:
    """Distinct codes of each cohort subject, reduced before the subjects are looked up."""
    return coded.select("subject_id", "icd_code").distinct().join(subjects, "subject_id", "left_semi")


def demographics(table: DataFrame, subjects: DataFrame, order: list[str]) -> DataFrame:
    """Demographics of the cohort, the first row by ``order`` where a subject has several."""
    return first_per_key(table, ["subject_id"], order).join(subjects, "subject_id", "left_semi")


def items(coded: DataFrame, subjects: DataFrame, column: str) -> DataFrame:
    """Visit rows of the cohort with one hierarchy column as the item, repeats kept.

    The input of mining, which drops repeats within a visit in its own first aggregation.
    """
    rows = coded.select("subject_id", "admit_id", item_text(F.col(column)).alias("item"))
    return rows.join(subjects, "subject_id", "left_semi")


def times(rows: DataFrame) -> Column:
    """How often each row stands for itself: its count ``n`` in counted tables, else once."""
    return F.col("n") if "n" in rows.columns else F.lit(1)


def item_counts(coded: DataFrame, subjects: DataFrame, column: str) -> DataFrame:
    """How often each item of one hierarchy column stands in each visit of the cohort.

    This is the canonical form of the baskets: counted, one row per (subject, visit, item), so that
    no visit or subject is ever gathered with its repeats.
    """
    return (
        coded.select("subject_id", "admit_id", item_text(F.col(column)).alias("item"), times(coded).alias("_times"))
        .groupBy("subject_id", "admit_id", "item")
        .agg(F.sum("_times").alias("n"))
        .join(subjects, "subject_id", "left_semi")
    )


def temporal_items(coded: DataFrame, subjects: DataFrame, mining_level: str) -> DataFrame:
    """Codes at the mining level, for sequences."""
    return item_counts(coded, subjects, level(mining_level).code)


def association_items(coded: DataFrame, subjects: DataFrame, mining_level: str) -> DataFrame:
    """Descriptions at the mining level, for rules."""
    return item_counts(coded, subjects, level(mining_level).desc)


def basket_text(items: DataFrame) -> DataFrame:
    """One comma-separated basket per visit, items sorted, repeats kept.

    What is gathered per visit is its distinct items with their counts, bounded by the number of
    codes at the level; repeats appear only in the text itself.  An item that is repeated more often than a
    line can hold (2^31 - 1 times) is an error: export such baskets with their counts (:func:`counted_text`).
    """
    baskets = items.groupBy("subject_id", "admit_id").agg(
        F.array_sort(F.collect_list(F.struct("item", "n"))).alias("_items")
    )
    too_many = F.raise_error(F.lit("an item is repeated too often for a line of text; export the baskets with counts"))

    def again(x: Column) -> Column:
        more = F.when(x["n"] >= 2**31, too_many.cast("int")).otherwise(x["n"] - 1).cast("int")
        return F.concat(x["item"], F.repeat(F.concat(F.lit(","), x["item"]), more))

    return baskets.select("subject_id", "admit_id", F.array_join(F.transform("_items", again), ",").alias("items"))


def counted_text(items: DataFrame) -> DataFrame:
    """One basket per visit as ``item,n,item,n,…``, items sorted: exact for any count, and as long as the visit has items."""
    pair = F.concat_ws(",", "item", F.col("n").cast("string"))
    return items.groupBy("subject_id", "admit_id").agg(F.array_join(F.array_sort(F.collect_list(pair)), ",").alias("items"))
