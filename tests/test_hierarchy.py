from pyspark.sql import functions as F

from cohortloom.functions import text as X
from cohortloom.operators import hierarchy as H
from helpers import sorted_rows as rows


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


def test_text(spark):
    none = F.lit(None).cast("string")
    assert one(spark, X.label(none, none)) == "NA - NA"
    assert X.label_code("5.2 - Anxiety - other") == "5.2"
    assert one(spark, X.label_code_column(F.lit("5.2 - Anxiety - other"))) == "5.2"
    assert one(spark, X.clean_description(F.lit("Mood disorders [657.], other"))) == "Mood disorders  other"
    assert one(spark, X.item_text(F.lit("a,b"))) == "a b" and one(spark, X.item_text(none)) == "NA"
    assert one(spark, X.matches(none, "")) is False
    assert one(spark, X.drop_first(F.lit("I250 E119 I250"), F.lit("I250"))) == "E119 I250"
    assert one(spark, X.drop_first(none, F.lit("I250"))) is None
    assert one(spark, X.code_list(F.lit("E119  I250"))) == "E119,I250"
    assert one(spark, X.code_list(F.lit("a    b"))) == "a,,b"
    weeks = X.years_between(F.lit("2001-01-01").cast("timestamp"), F.lit("2000-01-03").cast("timestamp"))
    assert abs(one(spark, weeks) - 52 / 52.25) < 1e-12


def test_chapters(spark):
    codes = spark.createDataFrame([("E119",), ("B991",), ("B99",), ("I250",), ("U07",), ("001",)], "code string")
    got = codes.select(
        "code", H.chapter_code(F.col("code")).alias("d"), H.chapter_code(F.col("code"), documented=False).alias("raw")
    )
    assert {r["code"]: (r["d"], r["raw"]) for r in got.collect()} == {
        "E119": ("4", None), "B991": ("1", None), "B99": ("1", "1"), "I250": ("9", "9"), "U07": ("22", "22"), "001": (None, "1")}


def test_fill(spark):
    names = "icd_code lvl1_cd lvl1_desc lvl2_cd lvl2_desc lvl3_cd lvl3_desc lvl4_cd lvl4_desc".split()
    df = spark.createDataFrame([("x", "5", "Mental", None, None, None, None, "5.1.1.1", "x")], ", ".join(f"{n} string" for n in names))
    assert tuple(H.fill_levels(df).select(*names).first()) == ("x", "5", "Mental", "5", "Mental", "5", "Mental", "5.1.1.1", "x")


def test_icd10(spark):
    raw = spark.createDataFrame([("'F410'", "'651'", "Panic", "Anxiety", "'5'", "Mental illness", "'5.2'", "Anxiety disorders")],
                                ", ".join(f"c{i} string" for i in range(8)))
    row = H.icd10_mapping(raw).first()
    assert (row["icd_code"], row["ccs_code"], row["icd_chp_code"]) == ("F410", "651", "5")
    assert row["ccs1"] == "5 - Mental Illness" and row["ccs2"] == "5.2 - Anxiety disorders"
    assert row["icd_c"] == "5 - mental and behavioral disorders"


def icd9(spark):
    multi = spark.createDataFrame(
        [("30000", "5", "Mental illness", "5.2", "Anxiety [651.]", None, None, None, None),
         ("29620", "5", "Mental illness", "5.8", "Mood, all [657.]", "5.8.1", "Bipolar", None, None),
         ("99999", "9", "Other", None, None, None, None, None, None)],
        "icd_code string, lvl1_cd string, lvl1_desc string, lvl2_cd string, lvl2_desc string, lvl3_cd string, "
        "lvl3_desc string, lvl4_cd string, lvl4_desc string")
    single = spark.createDataFrame([("30000", "651", "Anxiety"), ("29620", "657", "Mood"), ("99999", "1", "x")],
                                   "icd_code string, ccs_cat string, ccs_desc string")
    titles = spark.createDataFrame([("30000", "Anxiety state"), ("29620", "Depression")], "icd_code string, long_title string")
    chapters = H.number_chapters(
        spark.createDataFrame([("29620", "Mental", 1), ("30000", "Mental", 2), ("99999", "Other", 3)],
                              "icd string, icd_chp string, row int"), "row")
    one_to_one = spark.createDataFrame([("300.00", "Anxiety", "197480006", "Anxiety (f)")],
                                       "ICD_CODE string, ICD_NAME string, SNOMED_CID string, SNOMED_FSN string")
    many = spark.createDataFrame([("300.00", "Anxiety", "48694002", "Anxious (f)")],
                                 "ICD_CODE string, ICD_NAME string, SNOMED_CID string, SNOMED_FSN string")
    return H.icd9_mapping(multi, single, titles, chapters, H.code_bridge(one_to_one, many))


def test_icd9(spark):
    mapping = icd9(spark)
    assert rows(mapping, "icd_code", "ccs2", "ccs3", "icd_c", "snomed_code") == [
        ("29620", "5.8 - Mood all ", "5.8.1 - Bipolar", "1 - Mental", None),
        ("30000", "5.2 - Anxiety ", "5.2 - Anxiety ", "1 - Mental", "197480006"),
        ("30000", "5.2 - Anxiety ", "5.2 - Anxiety ", "1 - Mental", "48694002")]
    assert rows(mapping, "icd_code", "snomed")[0] == ("29620", "NA - NA")
    assert rows(H.multiply_mapped(mapping)) == [("30000", 2)]
    assert rows(H.level_choices(mapping, "ccs1")) == [("5 - Mental Illness",)]


def test_coverage_and_sentinel(spark):
    tidy = spark.createDataFrame([(1, 1, "30000"), (1, 2, "zzz"), (2, 1, "zzz")], "subject_id long, admit_id int, icd_code string")
    mapping = icd9(spark)
    assert rows(H.unmapped_codes(tidy, mapping)) == [("zzz", 2)]
    assert H.with_hierarchy(tidy, mapping).count() == 2
    kept = H.with_hierarchy_or_sentinel(tidy, mapping)
    assert kept.count() == 4
    assert rows(kept.filter("icd_code = 'zzz'"), "subject_id", "ccs2_code", "snomed_desc") == [(1, "999999", "999999"), (2, "999999", "999999")]
