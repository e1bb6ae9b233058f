"""Fixed-width records of the mortality source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortloom.sources.delimited import drop_containing

# fixed values: field widths of a mortality record, in order; "drop" fields are fillers
MORTALITY_LAYOUT = [
    ("drop1", 19), ("res_status", 1), ("drop2", 40), ("education_89", 2), ("education_03", 1),
    ("education_flag", 1), ("month", 2), ("drop3", 2), ("sex", 1), ("detail_age", 4), ("age_flag", 1),
    ("age_recode", 2), ("age_recode2", 2), ("age_group", 2), ("age_infant", 2), ("death_place", 1),
    ("marital", 1), ("day_of_week", 1), ("drop4", 16), ("data_year", 4), ("at_work", 1),
    ("death_manner", 1), ("burial", 1), ("autopsy", 1), ("drop5", 34), ("activity", 1),
    ("injury_place", 1), ("underlying_cause", 4), ("cause_recode358", 3), ("drop6", 1),
    ("cause_recode113", 3), ("cause_recode130", 3), ("cause_recode39", 2), ("drop7", 1),
    ("multiple_causes", 281), ("drop8", 1), ("race", 2), ("race_bridged", 1), ("race_flag", 1),
    ("race_recode", 1), ("race_recode2", 1), ("drop9", 33), ("hispanic", 3), ("drop10", 1),
    ("hispanic_recode", 1),
]


def offsets(layout: list[tuple[str, int]]) -> dict[str, tuple[int, int]]:
    """Field name → (1-based start, width)."""
    out, start = {}, 1
    for name, width in layout:
        out[name] = (start, width)
        start += width
    return out


def field(line: Column, start: int, width: int) -> Column:
    """One field: trimmed; blank or the text NA is missing.  Codes stay text, with leading zeros."""
    value = F.trim(F.substring(line, start, width))
    return F.when(~value.isin("", "NA"), value)


def parse_fixed_width(lines: DataFrame, layout: list[tuple[str, int]], column: str = "value") -> DataFrame:
    """Split a text column into fields and drop the fillers."""
    fields = [field(F.col(column), s, w).alias(name) for name, (s, w) in offsets(layout).items()]
    return drop_containing(lines.select(*[c for c in lines.columns if c != column], *fields), "drop")


# fixed values: fields every record has to fill, and how long a line is
MUST_FIELDS = ("data_year", "underlying_cause")
LINE_LENGTH = 488


def checked_lines(
    lines: DataFrame, layout: list[tuple[str, int]], must: tuple[str, ...] = MUST_FIELDS, column: str = "value"
) -> tuple[DataFrame, DataFrame]:
    """Records and rejects: lines of the layout's length with all ``must`` fields, parsed, and the others as they stand.

    Rejects keep the line with its ``length`` and ``reasons`` (``too short``, ``too long``, ``no <field>``, ``no line``).
    """
    width, at = sum(w for _, w in layout), offsets(layout)
    length = F.length(column)
    blank = [F.when(length.isNotNull() & field(F.col(column), *at[name]).isNull(), f"no {name}") for name in must]
    reasons = F.array_compact(F.array(
        F.when(length.isNull(), "no line"), F.when(length < width, "too short"), F.when(length > width, "too long"), *blank))
    judged = lines.withColumn("_reasons", reasons)
    records = parse_fixed_width(judged.filter(F.size("_reasons") == 0).drop("_reasons"), layout, column)
    rejects = judged.filter(F.size("_reasons") > 0).withColumn("length", length).withColumnRenamed("_reasons", "reasons")
    return records, rejects


def read_mortality_checked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Death records, and the lines that are not whole records; together they are all lines."""
    return checked_lines(spark.read.text(path), MORTALITY_LAYOUT)


def read_mortality(spark: SparkSession, path: str) -> DataFrame:
    return parse_fixed_width(spark.read.text(path), MORTALITY_LAYOUT)
