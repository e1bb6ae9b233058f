"""Building and using code hierarchies ("mappings")."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortloom.functions.levels import LEVELS, level
from cohortloom.functions.text import clean_description, drop_dots, drop_quotes, label
from cohortloom.operators.ranks import ordinal_by_first_appearance
from cohortloom.sources.codebooks import ICD10_CHAPTERS, chapter_table


def chapter_code(code: Column, documented: bool = True) -> Column:
    """ICD-10 chapter number of a code, null outside all ranges; the first matching range wins.

    ``documented`` compares the three-character category with the chapter's real bounds.
    Otherwise whole codes are compared as text with the bounds as first published, so a longer code
    falls behind an upper bound, chapter 1 has no lower bound and chapter 4 matches nothing.
    """
    probe = F.substring(code, 1, 3) if documented else code
    result = None
    for chapter in ICD10_CHAPTERS:
        low, high = (chapter.low, chapter.high) if documented else (chapter.raw_low, chapter.raw_high)
        inside = (probe >= low) & (probe <= high) if low else probe <= high
        hit = F.lit(str(chapter.number))
        result = F.when(inside, hit) if result is None else result.when(inside, hit)
    return result


def with_labels(mapping: DataFrame) -> DataFrame:
    """Add the "code - description" label of every level present; one spelling is made uniform."""
    if "ccs1_desc" in mapping.columns:
        mapping = mapping.withColumn(
            "ccs1_desc",
            F.when(F.col("ccs1_desc") == "Mental illness", "Mental Illness").otherwise(F.col("ccs1_desc")),
        )
    present = [lv for lv in LEVELS.values() if lv.code in mapping.columns and lv.desc in mapping.columns]
    return mapping.withColumns({lv.label: label(F.col(lv.code), F.col(lv.desc)) for lv in present})


def icd10_mapping(raw: DataFrame, documented_chapters: bool = True) -> DataFrame:
    """ICD-10 hierarchy from the eight positional columns of the category file."""
    spark = raw.sparkSession
    # fixed values: the column names every hierarchy has, here in the order of the file
    names = ["icd_code", "ccs_code", "icd_desc", "ccs_desc", "ccs1_code", "ccs1_desc", "ccs2_code", "ccs2_desc"]
    codes = ["icd_code", "ccs_code", "ccs1_code", "ccs2_code"]
    df = raw.toDF(*names).withColumns({c: drop_quotes(F.col(c)) for c in codes})
    df = df.withColumn("icd_chp_code", chapter_code(F.col("icd_code"), documented_chapters))
    df = df.join(F.broadcast(chapter_table(spark)), "icd_chp_code", "left")  # 22 rows
    order = ["icd_code", "icd_desc", "ccs_code", "ccs_desc", "ccs1_code", "ccs1_desc",
             "ccs2_code", "ccs2_desc", "icd_chp_code", "icd_chp_desc"]
    return with_labels(df.select(*order))


def fill_levels(multi: DataFrame, depth: int = 4) -> DataFrame:
    """Fill a missing level from the nearest filled one above, code and description apart."""

    def filled(k: int, part: str) -> Column:
        return F.coalesce(*[F.col(f"lvl{i}_{part}") for i in range(k, 0, -1)])

    return multi.withColumns(
        {f"lvl{k}_{part}": filled(k, part) for k in range(2, depth + 1) for part in ("cd", "desc")}
    )


def clean_levels(multi: DataFrame) -> DataFrame:
    """Strip brackets and commas from every text column."""
    return multi.select(
        *[clean_description(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in multi.dtypes]
    )


def number_chapters(chapters: DataFrame, position: str) -> DataFrame:
    """Add ``icd_c``, the number of each chapter in order of first appearance."""
    numbers = ordinal_by_first_appearance(chapters, "icd_chp", position, "icd_c")
    return chapters.drop(position).join(numbers, "icd_chp")


def code_bridge(one_to_one: DataFrame, one_to_many: DataFrame) -> DataFrame:
    """Union of the two secondary-code maps, with dots removed from the codes."""

    def pick(df: DataFrame) -> DataFrame:
        return df.select(
            drop_dots(F.col("ICD_CODE")).alias("icd_code"),
            F.col("ICD_NAME").alias("icd_desc"),
            F.col("SNOMED_CID").alias("snomed_code"),
            F.col("SNOMED_FSN").alias("snomed_desc"),
        )

    return pick(one_to_one).unionByName(pick(one_to_many))


def icd9_mapping(
    multi: DataFrame, single: DataFrame, titles: DataFrame, chapters: DataFrame, bridge: DataFrame
) -> DataFrame:
    """ICD-9 hierarchy: codes known to the first four inputs, with secondary codes where there are any.

    ``chapters`` carries ``icd``, ``icd_chp`` and ``icd_c`` (see :func:`number_chapters`).  A code
    with several secondary codes keeps one row for each.
    """
    levels = clean_levels(fill_levels(multi))
    df = (
        levels.join(titles.select("icd_code", "long_title"), "icd_code")
        .join(single.select("icd_code", "ccs_cat", "ccs_desc"), "icd_code")
        .join(chapters.withColumnRenamed("icd", "icd_code"), "icd_code")
        .join(bridge.select("icd_code", "snomed_code", "snomed_desc"), "icd_code", "left")
    )
    # fixed values: the column names every hierarchy has
    return with_labels(
        df.select(
            "icd_code",
            F.col("long_title").alias("icd_desc"),
            F.col("ccs_cat").cast("string").alias("ccs_code"),
            "ccs_desc",
            F.col("lvl1_cd").alias("ccs1_code"),
            F.col("lvl1_desc").alias("ccs1_desc"),
            F.col("lvl2_cd").alias("ccs2_code"),
            F.col("lvl2_desc").alias("ccs2_desc"),
            F.col("lvl3_cd").alias("ccs3_code"),
            F.col("lvl3_desc").alias("ccs3_desc"),
            F.col("icd_c").cast("string").alias("icd_chp_code"),
            F.col("icd_chp").alias("icd_chp_desc"),
            F.col("snomed_code").cast("string").alias("snomed_code"),
            "snomed_desc",
        )
    )


def unmapped_codes(tidy: DataFrame, mapping: DataFrame, on: str = "icd_code") -> DataFrame:
    """Codes in use that the hierarchy does not know, with the number of rows they stand in."""
    used = tidy.groupBy(on).agg(F.count("*").alias("n_rows"))
    return used.join(mapping.select(on).distinct(), on, "left_anti")


def multiply_mapped(mapping: DataFrame, on: str = "icd_code") -> DataFrame:
    """Codes with more than one row in the hierarchy."""
    return mapping.groupBy(on).agg(F.count("*").alias("n")).filter("n > 1")


def level_choices(mapping: DataFrame, name: str) -> DataFrame:
    """The labels to choose a condition from at one level."""
    return mapping.select(F.col(level(name).label).alias("label")).distinct()


def with_hierarchy(tidy: DataFrame, mapping: DataFrame, on: str = "icd_code") -> DataFrame:
    """Visit rows with all levels; rows of unknown codes are dropped, and a code with several rows
    in the hierarchy gives as many rows here.

    Pass a stored hierarchy rather than the plan that builds it: its size decides on broadcasting, and
    only a join of two plain shuffles can be split where one code owns a large share of the rows.
    """
    return tidy.join(mapping, on)


SENTINEL = 999999  # fixed value: stands for whatever is missing where unknown codes are kept


def with_hierarchy_or_sentinel(
    tidy: DataFrame, mapping: DataFrame, on: str = "icd_code", sentinel: int = SENTINEL
) -> DataFrame:
    """Keep rows of unknown codes, every missing value replaced by the sentinel."""
    joined = tidy.join(mapping, on, "left")
    return joined.select(
        *[F.coalesce(F.col(c), F.lit(sentinel).cast(t)).alias(c) for c, t in joined.dtypes]
    )
