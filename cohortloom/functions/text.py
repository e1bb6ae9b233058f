"""Text handling shared by the hierarchy, the baskets and the sequence tables."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def na_text(col: Column) -> Column:
    """Missing values read as the text ``NA`` wherever text is pasted together."""
    return F.coalesce(col.cast("string"), F.lit("NA"))


def label(code: Column, desc: Column) -> Column:
    return F.concat(na_text(code), F.lit(" - "), na_text(desc))


def label_code(text: str) -> str:
    """Code part of a chosen label: everything before the first ' - '."""
    return text.split(" - ", 1)[0]


def label_code_column(col: Column) -> Column:
    return F.substring_index(col, " - ", 1)


def item_text(col: Column) -> Column:
    """An item as it stands in a comma-separated basket."""
    return na_text(F.translate(col.cast("string"), ",", " "))


def matches(col: Column, pattern: str) -> Column:
    """Regex search in which a missing value never matches."""
    return F.coalesce(col.rlike(pattern), F.lit(False))


def drop_quotes(col: Column) -> Column:
    return F.translate(col, "'", "")


def drop_dots(col: Column) -> Column:
    return F.translate(col, ".", "")


def clean_description(col: Column) -> Column:
    """Remove ``[...]`` (greedy, first bracket to last) and commas."""
    return F.translate(F.regexp_replace(col, r"\[.*\]", ""), ",", "")


def drop_first(col: Column, needle: Column) -> Column:
    """Remove the first occurrence of ``needle`` and trim what is left."""
    at = F.position(needle, col)
    return F.trim(F.when(at > 0, F.overlay(col, F.lit(""), at, F.length(needle))).otherwise(col))


def code_list(col: Column) -> Column:
    """Blank-separated codes as a comma list, with each pair of commas made one."""
    return F.replace(F.replace(col, F.lit(" "), F.lit(",")), F.lit(",,"), F.lit(","))


def years_between(later: Column, earlier: Column) -> Column:
    """Age in years, as weeks / 52.25."""
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(1e6 * 604800) / F.lit(52.25)
