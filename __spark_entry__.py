
from __future__ import annotations

import os
import sys
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cohortloom.functions.levels import level  # noqa: E402
from cohortloom.functions.text import label_code_column  # noqa: E402
from cohortloom.operators import (  # noqa: E402
    adverse, cohort as C, explore, hierarchy as H, hospital, mortality, ranks, rules,
    sequence_table as T, sequences as Q, tidy,
)
from cohortloom.plans import load, standin as S  # noqa: E402
from cohortloom.plans.study import Study  # noqa: E402
from cohortloom.session import lineage_dir, tune, written  # noqa: E402
from cohortloom.sources import delimited, schemas, sinks  # noqa: E402
from cohortloom.sources.fixed_width import MORTALITY_LAYOUT, parse_fixed_width, read_mortality_checked  # noqa: E402
from cohortloom.sources.registry import Source, source  # noqa: E402
from oracle_queries import ORACLES  # noqa: E402

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

# condition 1 = type PROMO, condition 2 = brand 7, repeat visits only, mined by brand
PLUS = C.CohortSpec("PROMO - promo", "7 - Brand#7", "ccs1", "ccs_s", "ccs_s")
MINUS = C.CohortSpec("PROMO", "7", "ccs1", "ccs_s", "ccs_s", with_second=False)


def _query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(tune(spark), sf_dir)

    _QUERIES[fn.__name__] = run
    return run


def _tidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prepared visit table, written once where a query reads it more than once."""
    return written(S.visits(spark, sf_dir), "tidy")


def _items(spark: SparkSession, sf_dir: str, name: str, column: str = "code") -> DataFrame:
    """Items of all subjects at one level, without a cohort."""
    coded = H.with_hierarchy(S.visits(spark, sf_dir), S.mapping(spark, sf_dir))
    item = getattr(level(name), column)
    return coded.select("subject_id", "admit_id", F.col(item).alias("item"))


def _study(spark: SparkSession, sf_dir: str, spec: C.CohortSpec) -> Study:
    return Study(
        Source("standin", S.mapping(spark, sf_dir), _tidy(spark, sf_dir), S.people(spark, sf_dir)), spec
    )


def _scratch(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{lineage_dir(spark)}/cohortloom/export/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- sources and projections


@_query
def scan_project_cast(spark, sf_dir):
    """Customers written as gzipped CSV with missing-value tokens, read back with a schema."""
    path = _scratch(spark, "customers_csv")
    token = F.when(F.col("c_acctbal") < -900, "null").when(F.col("c_acctbal") < -500, "NULL").when(
        F.col("c_acctbal") < 0, "NA"
    )
    S.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("'CCS Cust Key'"),
        F.concat(F.col("c_name"), F.lit(", "), F.col("c_mktsegment")).alias("'MULTI NAME'"),
        F.coalesce(token, F.col("c_acctbal").cast("string")).alias("BALANCE"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("5th"),
    ).write.csv(path, header=True, compression="gzip", escape='"', nullValue="")
    schema = schemas.columns("custkey long, name string, balance double, 5th string")
    df = delimited.read_delimited(spark, path, schema, header=True, partitions=8)
    df = delimited.rename_position(df, 4, "segment")
    return df.select(F.col("custkey").alias("subject_id"), "name", "balance", "segment")


@_query
def admissions_by_header(spark, sf_dir):
    """Admissions picked by name from a wider CSV whose columns stand in another order."""
    path = _scratch(spark, "admissions_csv")
    S.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ROW_ID"), F.col("o_orderpriority").alias("ADMISSION_TYPE"), F.col("o_totalprice").alias("TOTAL"),
        F.col("o_orderkey").alias("HADM_ID"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("ADMITTIME"),
        F.col("o_custkey").alias("SUBJECT_ID"), F.col("o_orderstatus").alias("INSURANCE"), F.lit("NA").alias("LANGUAGE"),
        *[F.lit("x").alias(c) for c in ("RELIGION", "MARITAL_STATUS", "ETHNICITY", "ADMISSION_LOCATION")],
        F.dayofmonth("o_orderdate").alias("HOSPITAL_EXPIRE_FLAG"),
    ).write.csv(path, header=True)
    df = delimited.read_delimited(spark, path, schemas.ADMISSIONS)
    return df.select(
        "subject_id", "hadm_id", F.date_format("admittime", "yyyy-MM-dd").alias("day"), "admission_type", "insurance", "language",
        "religion", F.col("hospital_expire_flag").cast("long").alias("flag"),
    )


@_query
def tsv_with_header(spark, sf_dir):
    """Concepts from a TSV with a header, its columns in another order."""
    path = _scratch(spark, "concept_tsv")
    S.table(spark, sf_dir, "part").select(
        F.col("p_name").alias("concept_name"), F.when(F.col("p_size") > 25, F.col("p_type")).otherwise("\\N").alias("domain_id"),
        F.col("p_brand").alias("concept_code"), F.col("p_partkey").alias("CONCEPT_ID"), F.lit("extra").alias("extra"),
        *[F.lit("NA").alias(c) for c in ("vocabulary_id", "concept_class_id", "standard_concept", "valid_start_date", "valid_end_date", "invalid_reason")],
    ).write.csv(path, sep="\t", header=True, escape='"', quote="")
    return delimited.read_tsv(spark, path, schemas.CONCEPT, header=True).select("concept_id", "concept_name", "domain_id", "concept_code", "vocabulary_id")


@_query
def all_text_csv(spark, sf_dir):
    """A hierarchy file whose header is replaced; every column stays text, with its leading zeros."""
    path = _scratch(spark, "levels_csv")
    S.table(spark, sf_dir, "part").select(
        F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("'ICD-9-CM CODE'"), F.col("p_type").alias("'CCS LVL 1'"), F.col("p_name").alias("'CCS LVL 1 LABEL'"),
        F.lpad(F.col("p_size").cast("string"), 4, "0").alias("'CCS LVL 2'"), F.col("p_brand").alias("'CCS LVL 2 LABEL'"),
        *[F.lit("").alias(f"'L{k}'") for k in range(4)],
    ).write.csv(path, header=True)
    df = delimited.read_delimited(spark, path, schemas.ICD9_MULTI, by_position=True)
    return df.select("icd_code", "lvl1_cd", "lvl1_desc", "lvl2_cd", "lvl2_desc", "lvl3_cd")


@_query
def tsv_scan(spark, sf_dir):
    """Events written as headerless TSV with backslash-N tokens, read back with names and types."""
    path = _scratch(spark, "events_tsv")
    S.table(spark, sf_dir, "events").select(
        F.when(F.col("value") < 50, F.col("user_id").cast("string")).otherwise("\\N").alias("primaryid"),
        F.col("user_id").alias("isr"),
        F.col("event_id").alias("drug_seq"),
        F.when(F.col("event_type") == "error", "\\\\N").otherwise(F.col("event_type")).alias("role_cod"),
        F.length("props").alias("standard_concept_id"),
    ).write.csv(path, sep="\t", header=False, escape='"', quote="")
    return adverse.with_subject(delimited.read_tsv(spark, path, schemas.CASE_DRUG))


@_query
def quoted_line_breaks(spark, sf_dir):
    """Comments with line breaks, commas and quotes written as CSV and read back."""
    path = _scratch(spark, "comments_csv")
    note = F.concat(F.col("p_name"), F.lit("\n\n\"size\", "), F.col("p_size").cast("string"), F.lit("\n"), F.col("p_type"))
    S.table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("BRAND"), note.alias("NOTE"), F.when(F.col("p_size") > 40, "NA").otherwise(F.col("p_size").cast("string")).alias("SIZE"), F.col("p_partkey").alias("PART_KEY"),
    ).write.csv(path, header=True, escape='"')
    schema = schemas.columns("part_key long, brand string, note string, size int")
    df = delimited.read_delimited(spark, path, schema, multi_line=True)
    return df.select("part_key", "brand", F.col("size").cast("long").alias("size"), F.length("note").cast("long").alias("n"), F.md5("note").alias("digest"))


@_query
def level_choices(spark, sf_dir):
    df = H.level_choices(S.mapping(spark, sf_dir), "ccs2")
    return df.select("label", label_code_column(F.col("label")).alias("code"))


@_query
def fixed_width_parse(spark, sf_dir):
    return parse_fixed_width(S.death_lines(spark, sf_dir), MORTALITY_LAYOUT).select(
        "o_orderkey", "res_status", "education_89", "education_03", "sex", "age_group", "age_infant", "marital",
        "data_year", "underlying_cause", "multiple_causes", "race", "hispanic_recode",
    )


@_query
def fixed_width_rejects(spark, sf_dir):
    """Damaged lines apart from records: records by year, rejects by reason."""
    path, key = _scratch(spark, "deaths"), F.col("o_orderkey") % 10
    damaged = F.when(key == 1, F.substring("value", 1, 400)).when(key == 2, F.concat("value", F.lit("xx"))).when(
        key == 3, F.concat(F.substring("value", 1, 145), F.lit("    "), F.expr("substring(value, 150)"))).when(
        key == 4, F.expr("substring(value, 1, 101)")).otherwise(F.col("value"))
    S.death_lines(spark, sf_dir).select(damaged.alias("value")).write.text(path)
    records, rejects = read_mortality_checked(spark, path)
    return records.groupBy(F.lit("record").alias("kind"), F.col("data_year").alias("what")).agg(F.count("*").alias("n")).unionByName(
        rejects.groupBy(F.lit("reject").alias("kind"), F.array_join("reasons", ", ").alias("what")).agg(F.count("*").alias("n")))


# ---------------------------------------------------------------- hierarchies


def _raw_levels(spark, sf_dir):
    size, brand = F.col("p_size"), F.col("p_brand")
    return S.table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("icd_code"),
        F.col("p_type").alias("lvl1_cd"),
        F.concat(F.lower("p_type"), F.lit(" goods [ "), size.cast("string"), F.lit(".], all")).alias("lvl1_desc"),
        F.when(size > 10, brand).alias("lvl2_cd"),
        F.when(size > 15, F.concat(brand, F.lit(", [x] and [y]"))).alias("lvl2_desc"),
        F.when(size > 25, F.substring("p_name", 1, 3)).alias("lvl3_cd"),
        F.when(size > 20, F.col("p_name")).alias("lvl3_desc"),
        F.when(size > 40, size.cast("string")).alias("lvl4_cd"),
        F.when(size > 45, F.concat(F.lit("size "), size.cast("string"))).alias("lvl4_desc"),
    )


@_query
def hierarchy_fill(spark, sf_dir):
    return H.clean_levels(H.fill_levels(_raw_levels(spark, sf_dir)))


@_query
def icd9_hierarchy(spark, sf_dir):
    """The five-table hierarchy: levels, titles, single level, chapters and secondary codes."""
    part = S.table(spark, sf_dir, "part")
    code = F.col("p_partkey").cast("string").alias("icd_code")
    titles = part.select(code, F.col("p_name").alias("long_title"))
    single = part.join(S.table(spark, sf_dir, "nation"), F.col("p_size") == F.col("n_nationkey")).select(
        code, F.col("n_nationkey").alias("ccs_cat"), F.col("n_name").alias("ccs_desc")
    )
    chapters = H.number_chapters(
        part.select(F.col("p_partkey").cast("string").alias("icd"), F.col("p_type").alias("icd_chp"),
                    F.col("p_partkey").alias("_row")), "_row")
    bridge = H.code_bridge(*_code_maps(spark, sf_dir))
    return H.icd9_mapping(_raw_levels(spark, sf_dir), single, titles, chapters, bridge)


@_query
def chapter_ranges(spark, sf_dir):
    """ICD-10 style codes built from parts: chapter by the documented and by the raw comparison."""
    brand = F.replace("p_brand", F.lit("Brand#"), F.lit(""))
    letter = F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.col("p_size") % 26 + 1, F.lit(1))
    code = F.concat(letter, F.lpad((brand.cast("int") * 4 - 1).cast("string"), 2, "0"),
                    F.when(F.col("p_size") > 26, F.substring("p_partkey", -1, 1)).otherwise(""))
    quoted = F.concat(F.lit("'"), code, F.lit("'"))
    raw = S.table(spark, sf_dir, "part").select(
        quoted.alias("a"), quoted.alias("b"), F.col("p_name").alias("c"), F.col("p_brand").alias("d"),
        quoted.alias("e"), F.col("p_type").alias("f"), quoted.alias("g"), F.col("p_type").alias("h"),
    )
    columns = ["icd_code", "icd_desc", "icd_chp_code", "icd_chp_desc", "icd", "icd_c", "ccs_s", "ccs1", "ccs2"]
    return H.icd10_mapping(raw).select(*columns, F.lit("documented").alias("mode")).unionByName(
        H.icd10_mapping(raw, documented_chapters=False).select(*columns, F.lit("raw").alias("mode"))
    )


@_query
def chapter_ordinal(spark, sf_dir):
    chapters = S.table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("icd"), F.col("p_name").alias("icd_chp"), F.col("p_partkey").alias("_row")
    )
    return H.number_chapters(chapters, "_row").select("icd", "icd_chp", "icd_c")


def _code_maps(spark, sf_dir):
    part = S.table(spark, sf_dir, "part")
    dotted = F.concat(F.substring("p_partkey", 1, 1), F.lit("."), F.expr("substring(cast(p_partkey as string), 2)"))
    one = part.select(dotted.alias("ICD_CODE"), F.col("p_name").alias("ICD_NAME"),
                      F.col("p_size").cast("string").alias("SNOMED_CID"), F.col("p_brand").alias("SNOMED_FSN"))
    many = part.join(S.table(spark, sf_dir, "nation"), F.col("p_size") == F.col("n_nationkey")).select(
        F.col("p_partkey").cast("string").alias("ICD_CODE"), F.col("p_name").alias("ICD_NAME"),
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("SNOMED_CID"), F.col("n_name").alias("SNOMED_FSN"))
    return one, many


@_query
def bridge_union(spark, sf_dir):
    return H.code_bridge(*_code_maps(spark, sf_dir))


@_query
def mapping_coverage(spark, sf_dir):
    """Codes in use without an entry, and codes with several, in hierarchies made by inner joins."""
    partial = S.table(spark, sf_dir, "part").join(
        S.table(spark, sf_dir, "nation"), F.col("p_size") == F.col("n_nationkey")
    ).select(F.col("p_partkey").cast("string").alias("icd_code"))
    missing = H.unmapped_codes(S.diagnoses(spark, sf_dir), partial)
    several = H.multiply_mapped(S.fanned_mapping(spark, sf_dir))
    return missing.select(F.lit("unmapped").alias("kind"), "icd_code", F.col("n_rows").alias("n")).unionByName(
        several.select(F.lit("several").alias("kind"), "icd_code", "n")
    )


@_query
def recode_label(spark, sf_dir):
    raw = S.table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("icd_code"),
        F.when(F.col("p_size") != 7, F.col("p_name")).alias("icd_desc"),
        F.when(F.col("p_type") != "SMALL", F.col("p_type")).alias("ccs1_code"),
        F.when(F.col("p_type") == "PROMO", "Mental illness").when(F.col("p_type") != "LARGE", F.lower("p_type")).alias("ccs1_desc"),
    )
    return H.with_labels(raw)


@_query
def with_hierarchy(spark, sf_dir):
    """Visit rows with all levels; codes with several secondary codes fan out."""
    mapping = written(S.fanned_mapping(spark, sf_dir), "mapping")
    df = H.with_hierarchy(S.visits(spark, sf_dir), mapping)
    return df.select("subject_id", "admit_id", "icd_code", "ccs2_code", "ccs1_desc", "icd_chp_code", "snomed_code")


@_query
def hierarchy_browse(spark, sf_dir):
    return S.mapping(spark, sf_dir)


# ---------------------------------------------------------------- preprocessing


@_query
def visit_number(spark, sf_dir):
    return hospital.numbered_admissions(S.admissions(spark, sf_dir), S.diagnoses(spark, sf_dir)).select(
        "subject_id", "hadm_id", "admit_id"
    )


@_query
def daily_visits(spark, sf_dir):
    return S.daily_events(spark, sf_dir)


def _patients(spark, sf_dir):
    born = F.to_timestamp(F.date_add(F.lit("1940-01-01").cast("date"), F.col("c_nationkey") * 500))
    return S.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("subject_id"), F.substring("c_mktsegment", 1, 1).alias("gender"), born.alias("dob"),
        F.when(F.col("c_acctbal") < 0, F.lit("2001-06-30 12:00:00").cast("timestamp")).alias("dod"),
        F.when(F.col("c_acctbal") < 0, 1).otherwise(0).alias("expire_flag"),
    )


@_query
def age_at_first_visit(spark, sf_dir):
    ages = hospital.subject_ages(S.admissions(spark, sf_dir), _patients(spark, sf_dir))
    return ages.select("subject_id", F.round("age", 6).alias("age"), F.round("age_dod", 6).alias("age_dod"))


def _stays(spark, sf_dir):
    blank = ["insurance", "language", "religion", "marital_status", "ethnicity"]
    stays = S.admissions(spark, sf_dir).withColumns({c: F.lit("-") for c in blank})
    return stays.withColumn("hospital_expire_flag", F.lit(0))


@_query
def first_row_per_subject(spark, sf_dir):
    df = hospital.demographics(_stays(spark, sf_dir), _patients(spark, sf_dir))
    return df.select("subject_id", F.round("age", 6).alias("age"), "gender", "expire_flag", "admission_type", "admission_location")


@_query
def pack_visits(spark, sf_dir):
    return C.basket_text(tidy.count_codes(S.visits(spark, sf_dir)))


@_query
def unpack_visits(spark, sf_dir):
    packed = pack_visits(spark, sf_dir)
    return tidy.unpack(packed.withColumnRenamed("items", "icd_code"))


@_query
def global_dense_rank(spark, sf_dir):
    orders = S.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return ranks.dense_rank_all(orders, "o_totalprice", "price_rank").select("o_orderkey", "price_rank")


@_query
def surrogate_ids(spark, sf_dir):
    ids = ranks.with_row_ids(S.table(spark, sf_dir, "lineitem"), "ID")
    return ids.agg(
        F.count("*").alias("n"), F.countDistinct("ID").alias("n_ids"), F.min("ID").alias("low"), F.max("ID").alias("high")
    )


@_query
def coalesce_ids(spark, sf_dir):
    return adverse.indications(S.case_indication(spark, sf_dir))


def _adverse_parts(spark, sf_dir):
    indication = adverse.indications(S.case_indication(spark, sf_dir))
    subjects = adverse.text_cohort(indication, "AUTO|BUILD")
    return indication, subjects, adverse.drugs(S.case_drug(spark, sf_dir))


@_query
def concept_hops(spark, sf_dir):
    """Outcome → concept → secondary code → code, in counted form, visits ranked over all subjects."""
    _, subjects, drug = _adverse_parts(spark, sf_dir)
    return adverse.temporal(
        adverse.outcomes(S.drug_outcome(spark, sf_dir)), drug, S.concept(spark, sf_dir),
        S.nation_mapping(spark, sf_dir), subjects,
    )


@_query
def adverse_demographics(spark, sf_dir):
    indication, subjects, drug = _adverse_parts(spark, sf_dir)
    concepts = S.drug_concept(spark, sf_dir).withColumn("concept_code", F.col("concept_id").cast("string"))
    return adverse.demographics(drug, indication, concepts, subjects)


@_query
def text_cohort_vs_code_cohort(spark, sf_dir):
    """Documents as indications: subjects found by a text search against those found by source code."""
    documents = S.table(spark, sf_dir, "documents")
    indication = documents.select(
        F.col("doc_id").alias("subject_id"), F.col("text").alias("indi_desc"),
        F.regexp_extract("source", r"(\d+)", 1).cast("long").alias("indi_snomed_id"),
    )
    supplier = S.concept(spark, sf_dir)
    nations = S.nation_mapping(spark, sf_dir)
    return adverse.cohort_overlap(
        adverse.text_cohort(indication, "[0-9]{3}|licen[cs]e"),
        adverse.code_cohort(indication, supplier, nations, nations, "ccs_desc", "ASIA"),
    )


@_query
def usage_over_threshold(spark, sf_dir):
    _, subjects, drug = _adverse_parts(spark, sf_dir)
    return adverse.drug_usage(subjects, drug, S.drug_concept(spark, sf_dir), 50)


@_query
def condition_group_report(spark, sf_dir):
    tidy_rows, mapping = _tidy(spark, sf_dir), S.fanned_mapping(spark, sf_dir)
    rows = hospital.group_rows(tidy_rows, mapping, ["7", "12"])
    people = hospital.group_patients(tidy_rows, mapping, ["7", "12"])
    return rows.select(F.lit("rows").alias("kind"), "icd_desc", "ccs_desc", F.col("n_rows").alias("n")).unionByName(
        people.select(F.lit("patients").alias("kind"), "icd_desc", F.lit("").alias("ccs_desc"), F.col("n_subjects").alias("n"))
    )


@_query
def split_axes(spark, sf_dir):
    """Death records to packed visits: underlying cause, then the other record-axis causes."""
    records = S.death_fields(spark, sf_dir).withColumnRenamed("o_orderkey", "ID")
    return mortality.temporal(records)


@_query
def decode_dictionaries(spark, sf_dir):
    return mortality.demographics(S.death_fields(spark, sf_dir).withColumnRenamed("o_orderkey", "ID"))


@_query
def mortality_condition_rows(spark, sf_dir):
    """Fixed-width lines → records → packed visits → tidy rows → frequencies per code."""
    records = parse_fixed_width(S.death_lines(spark, sf_dir), MORTALITY_LAYOUT).withColumnRenamed("o_orderkey", "ID")
    return explore.grouped_counts(tidy.unpack(mortality.temporal(records)), ["admit_id", "icd_code"])


# ---------------------------------------------------------------- cohorts and exploration


def _members(spark, sf_dir, spec=PLUS):
    return C.membership(S.visits(spark, sf_dir), S.mapping(spark, sf_dir), spec)


@_query
def base_cohort(spark, sf_dir):
    return C.base_cohort(_members(spark, sf_dir))


@_query
def cohort_plus(spark, sf_dir):
    return C.cohort_plus(_members(spark, sf_dir))


@_query
def cohort_minus(spark, sf_dir):
    return C.cohort_minus(_members(spark, sf_dir))


@_query
def cohort_all_visits(spark, sf_dir):
    """A narrower pair of conditions, without the repeat-visit rule."""
    spec = C.CohortSpec("PROMO.13", "LARGE.7", with_second=False, repeat_visits=False)
    return C.cohort(S.visits(spark, sf_dir), S.mapping(spark, sf_dir), spec)


@_query
def unique_codes(spark, sf_dir):
    return _study(spark, sf_dir, PLUS).unique_codes()


@_query
def cohort_demographics(spark, sf_dir):
    return _study(spark, sf_dir, MINUS).demographics(["segment", "nation", "region"])


@_query
def association_baskets(spark, sf_dir):
    """One line per visit: the subject and the descriptions at the mining level."""
    return sinks.association_lines(_study(spark, sf_dir, PLUS).association_items()).withColumnRenamed("value", "line")


@_query
def sequence_baskets(spark, sf_dir):
    return sinks.temporal_lines(_study(spark, sf_dir, MINUS).temporal_items()).withColumnRenamed("value", "line")


@_query
def condition_rows_top20(spark, sf_dir):
    return explore.condition_rows(S.visits(spark, sf_dir), S.fanned_mapping(spark, sf_dir), "ccs2")


@_query
def condition_patients_top20(spark, sf_dir):
    return _study(spark, sf_dir, PLUS).condition_patients()


@_query
def hospital_files_study(spark, sf_dir):
    """Raw CSV files to a source to a study: subjects per condition, through header names and schemas."""
    admissions, patients, diagnoses = (_scratch(spark, n) for n in ("admissions", "patients", "diagnoses"))
    orders, lines = S.table(spark, sf_dir, "orders"), S.table(spark, sf_dir, "lineitem")
    moment = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    blank = F.lit("NA")
    orders.select(
        F.col("o_orderkey").alias("ROW_ID"), F.col("o_custkey").alias("SUBJECT_ID"), F.col("o_orderkey").alias("HADM_ID"), moment.alias("ADMITTIME"),
        *[blank.alias(c.upper()) for c in schemas.ADMISSIONS.names[3:]],
    ).write.csv(admissions, header=True)
    S.table(spark, sf_dir, "customer").select(
        F.lit("F").alias("GENDER"), F.col("c_custkey").alias("SUBJECT_ID"), F.lit("1950-01-01 00:00:00").alias("DOB"), blank.alias("DOD"), F.lit(0).alias("EXPIRE_FLAG")
    ).write.csv(patients, header=True)
    lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_linenumber").alias("SEQ_NUM"), F.col("l_partkey").alias("ICD_CODE"), F.col("l_orderkey").alias("ROW_ID"),
        F.col("l_orderkey").alias("HADM_ID"), F.col("o_custkey").alias("SUBJECT_ID"),
    ).write.csv(diagnoses, header=True)
    return Study(load.hospital_source(spark, admissions, patients, diagnoses, S.mapping(spark, sf_dir)), PLUS).condition_patients()


@_query
def mortality_files_study(spark, sf_dir):
    """Fixed-width files to a source to a study: rows per condition."""
    path = _scratch(spark, "deaths")
    S.death_lines(spark, sf_dir).select("value").write.text(path)
    codes = S.table(spark, sf_dir, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("n"), "n_name").select(
        F.concat(F.lit("C"), "n").alias("icd_code"), F.col("n_name").alias("icd_desc"), F.col("n").alias("ccs_code"), F.col("n_name").alias("ccs_desc"))
    return Study(load.mortality_source(spark, path, codes), C.CohortSpec("C01", "C02", "icd", "icd", "ccs_s")).condition_rows(5)


@_query
def adverse_files_study(spark, sf_dir):
    """TSV files of the adverse-event source to a source to a study: subjects per condition, unknown codes kept."""

    def saved(name, df, schema, header=False):
        path = _scratch(spark, name)
        columns = [F.coalesce(F.col(c).cast("string"), F.lit("\\N")) if c in df.columns else F.lit("\\N") for c in schema.names]
        df.select(*[c.alias(n) for c, n in zip(columns, schema.names)]).write.csv(path, sep="\t", header=header, escape='"', quote="")
        return path

    nations = written(S.nation_mapping(spark, sf_dir), "mapping")
    files = [
        saved("case_indication", S.case_indication(spark, sf_dir), schemas.CASE_INDICATION), saved("case_drug", S.case_drug(spark, sf_dir), schemas.CASE_DRUG),
        saved("drug_outcome", S.drug_outcome(spark, sf_dir), schemas.DRUG_OUTCOME), saved("concept", S.concept(spark, sf_dir), schemas.CONCEPT, True),
    ]
    adverse_events = load.adverse_source(spark, *files, nations, "AUTO|BUILD", "AUTO")
    return Study(adverse_events, C.CohortSpec("R3", "N7", "icd", "icd", "ccs_s", with_second=False)).condition_patients()


@_query
def demographic_counts(spark, sf_dir):
    people = _study(spark, sf_dir, PLUS).demographics(["segment", "nation", "region"])
    return explore.grouped_counts(people, ["region", "segment"])


@_query
def demographic_values(spark, sf_dir):
    return explore.value_counts(_study(spark, sf_dir, MINUS).demographics(["segment", "nation", "region"]), "nation")


def _adverse_study(spark, sf_dir, spec):
    """The adverse-event source: selected by secondary code, reported by outcome with unknown codes kept."""
    indication, subjects, drug = _adverse_parts(spark, sf_dir)
    nations = written(S.nation_mapping(spark, sf_dir), "mapping")
    concepts = S.concept(spark, sf_dir).withColumn("concept_code", F.col("concept_id").cast("string"))
    visits = adverse.temporal(
        adverse.outcomes(S.drug_outcome(spark, sf_dir)), drug, S.concept(spark, sf_dir), nations, subjects
    )
    # codes of one region are left out of the hierarchy here, so that some codes are unknown
    known = nations.filter("ccs_desc != 'EUROPE'")
    selection = adverse.selection(drug, indication, concepts, subjects, "AUTO")
    people = adverse.demographics(drug, indication, concepts, subjects)
    return Study(source("aeolus", {"icd9": known}, written(visits, "adverse_visits"), people, selection), spec)


@_query
def adverse_cohort_baskets(spark, sf_dir):
    spec = C.CohortSpec("R2", "N7", "icd", "icd", "ccs_s", with_second=False)
    return _adverse_study(spark, sf_dir, spec).temporal_items()


@_query
def adverse_condition_rows(spark, sf_dir):
    return _adverse_study(spark, sf_dir, C.CohortSpec("R2", "N7", "icd", "icd", "ccs_s")).condition_rows(3)


@_query
def adverse_condition_patients(spark, sf_dir):
    spec = C.CohortSpec("R2", "N7", "icd", "icd", "ccs_s", with_second=False)
    return _adverse_study(spark, sf_dir, spec).condition_patients()


@_query
def adverse_sequences(spark, sf_dir):
    """All subjects.  Visit numbers are global ranks here, and are made dense per subject before mining."""
    study = _adverse_study(spark, sf_dir, C.CohortSpec("R2", "N7", "icd", "icd", "ccs_s"))
    everyone = study.coded.select("subject_id").distinct()
    items = Q.renumber_visits(C.items(study.coded, everyone, level("ccs_s").code))
    return T.as_table(Q.frequent_sequences(items, 0.9)).select("sequence", F.round("support", 9).alias("support"))


# ---------------------------------------------------------------- sequences


def _mined_types(spark, sf_dir):
    """Sequences of part types."""
    return T.as_table(Q.frequent_sequences(_items(spark, sf_dir, "ccs1"), 0.6))


def _mined_brands(spark, sf_dir):
    """Sequences of brand numbers; '1' stands inside '10', '13', …"""
    return T.as_table(Q.frequent_sequences(_items(spark, sf_dir, "ccs_s"), 0.2))


@_query
def frequent_sequences(spark, sf_dir):
    return _study(spark, sf_dir, PLUS).mined_sequences(0.25).select("sequence", F.size("states").alias("n_states"), F.round("support", 9).alias("support"))


@_query
def frequent_event_sequences(spark, sf_dir):
    """The denser source: days of events, coded by type and size of the event."""
    days = S.daily_events(spark, sf_dir, by_value=True).withColumnRenamed("icd_code", "item")
    return T.as_table(Q.frequent_sequences(days, 0.9)).select("sequence", F.round("support", 9).alias("support"))


@_query
def frequent_itemset_sequences(spark, sf_dir):
    mined = Q.frequent_itemset_sequences(_items(spark, sf_dir, "ccs1"), 0.8)
    return T.as_table(mined).select("sequence", F.round("support", 9).alias("support"))


@_query
def sequence_states(spark, sf_dir):
    table = T.widened(T.with_length(_mined_types(spark, sf_dir)))
    return table.withColumn("support", F.round("support", 9))


@_query
def sequence_flags(spark, sf_dir):
    table = written(_mined_brands(spark, sf_dir), "mined")
    columns = ["sequence", "consec", "non_consec", "embed_consec", "embed_non_consec"]
    return T.with_flags(table).select(*columns, F.lit("documented").alias("mode")).unionByName(
        T.with_flags(table, documented=False).select(*columns, F.lit("padded").alias("mode"))
    )


@_query
def sequence_flags_four_states(spark, sf_dir):
    table = written(_mined_types(spark, sf_dir), "mined")
    columns = ["sequence", "consec", "non_consec", "embed_consec", "embed_non_consec"]
    return T.with_flags(table).select(*columns, F.lit("documented").alias("mode")).unionByName(
        T.with_flags(table, documented=False).select(*columns, F.lit("padded").alias("mode"))
    )


def _path_flags(table):
    columns = ["sequence", "consec", "non_consec", "embed_consec", "embed_non_consec"]
    return T.with_flags(table).select(*columns, F.lit("documented").alias("mode")).unionByName(
        T.with_flags(table, documented=False).select(*columns, F.lit("padded").alias("mode"))
    )


@_query
def event_path_flags(spark, sf_dir):
    """Users' whole paths, of many more than eight states; a padded row shows the first eight."""
    return _path_flags(written(S.event_paths(spark, sf_dir), "paths"))


@_query
def event_weekday_flags(spark, sf_dir):
    """A state for each day of the week; two exceptions hold in padded tables of seven states."""
    return _path_flags(written(S.event_paths(spark, sf_dir, weekdays=True), "paths"))


@_query
def event_path_described(spark, sf_dir):
    """Long paths through length, description, filter and search."""
    table = T.describe(T.with_length(S.event_paths(spark, sf_dir)), S.path_names(spark, sf_dir), "ccs1")
    table = T.search_any(T.search_first(T.drop_unclassified(table), "^[1-3] "), "^4 ")
    return table.select("sequence", "length", F.array_join("states", " / ").alias("described"))


@_query
def sequence_no_repeats(spark, sf_dir):
    table = written(_mined_types(spark, sf_dir), "mined")
    documented = T.without_repeats(T.single_item_sequences(table))
    padded = T.single_item_sequences(T.without_repeats(table, documented=False))
    return documented.select("sequence", F.lit("documented").alias("mode")).unionByName(
        padded.select("sequence", F.lit("padded").alias("mode"))
    )


def _described(spark, sf_dir):
    table = T.without_repeats(_mined_types(spark, sf_dir))
    unclassified = S.mapping(spark, sf_dir).withColumn(
        "ccs1_desc", F.when(F.col("ccs1_code") == "ECONOMY", "Unclassified goods").otherwise(F.col("ccs1_desc"))
    )
    return T.describe(table, unclassified, "ccs1")


@_query
def sequence_described(spark, sf_dir):
    return _described(spark, sf_dir).select(
        "sequence", F.round("support", 9).alias("support"), F.array_join("states", " / ").alias("described")
    )


@_query
def sequence_search(spark, sf_dir):
    table = T.drop_unclassified(_described(spark, sf_dir))
    table = T.search_any(T.search_first(table, "promo|all"), "large|standard")
    return table.select("sequence", F.array_join("states", " / ").alias("described"))


@_query
def sequence_links(spark, sf_dir):
    return T.links(_described(spark, sf_dir)).withColumn("max_support", F.round("max_support", 9))


@_query
def sequence_study(spark, sf_dir):
    """The whole chain for a cohort: baskets, mining, flags, filters, descriptions, search."""
    table = _study(spark, sf_dir, MINUS).sequences(support=0.25, contains="Brand#1")
    return table.select(
        "sequence", F.round("support", 9).alias("support"), F.array_join("states", " / ").alias("described"),
        "length", "consec", "non_consec", "embed_consec", "embed_non_consec",
    )


# ---------------------------------------------------------------- rules


@_query
def item_frequency(spark, sf_dir):
    df = _study(spark, sf_dir, PLUS).item_frequency(0.05, 10)
    return df.select("item", "count", F.round("frequency", 9).alias("frequency"))


def _mined_rules(spark, sf_dir):
    txns = rules.transactions(_items(spark, sf_dir, "ccs1", "desc"))
    return rules.association_rules(txns, 0.02, 0.3)


def _flat(df):
    return df.select(
        F.array_join("antecedent", ",").alias("antecedent"), F.array_join("consequent", ",").alias("consequent"),
        *[F.round(c, 9).alias(c) for c in ("confidence", "lift", "support")],
    )


@_query
def association_rules(spark, sf_dir):
    return _flat(_mined_rules(spark, sf_dir))


@_query
def bounded_rules(spark, sf_dir):
    """Rules of at most ten items between the kinds of goods a customer ever bought."""
    lines = S.table(spark, sf_dir, "lineitem").join(S.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    kinds = S.table(spark, sf_dir, "part").select("p_partkey", F.concat("p_type", F.when(F.col("p_size") > 25, " large").otherwise(" small")).alias("item"))
    bought = lines.join(kinds, F.col("l_partkey") == F.col("p_partkey")).groupBy("o_custkey").agg(F.collect_set("item").alias("items"))
    return _flat(rules.association_rules(bought, 0.3, 0.8, max_items=10))


@_query
def cohort_rules(spark, sf_dir):
    """Rules between brands within the visits of a cohort."""
    return _flat(_study(spark, sf_dir, PLUS).rules(support=0.005, confidence=0.17))


@_query
def top_rules(spark, sf_dir):
    return _flat(rules.top_rules(_mined_rules(spark, sf_dir), "lift", 10))


@_query
def rule_clusters(spark, sf_dir):
    df = rules.rule_clusters(_mined_rules(spark, sf_dir), k=5)
    return df.select("cluster", "consequent", "n_antecedents", *[F.round(c, 9).alias(c) for c in ("support", "confidence", "lift")])


@_query
def rule_sides(spark, sf_dir):
    df = rules.rule_sides(_mined_rules(spark, sf_dir))
    return df.select("consequent", "n_antecedents", *[F.round(c, 9).alias(c) for c in ("lift", "confidence", "support")])


@_query
def rule_lift_table(spark, sf_dir):
    """The table the left sides are clustered on."""
    return rules.lift_table(_mined_rules(spark, sf_dir)).withColumn("lift", F.round("lift", 9))


@_query
def rule_graph(spark, sf_dir):
    nodes, edges = rules.rule_graph(written(rules.top_rules(_mined_rules(spark, sf_dir), "confidence", 10), "top_rules"))
    return nodes.select("kind", F.col("node").alias("source"), F.lit("").alias("target"), F.round("lift", 9).alias("lift")).unionByName(
        edges.select(F.lit("edge").alias("kind"), "source", "target", F.lit(None).cast("double").alias("lift"))
    )


# ---------------------------------------------------------------- sinks


@_query
def basket_roundtrip(spark, sf_dir):
    """Baskets written as text and read back: visits with distinct items."""
    items = _study(spark, sf_dir, PLUS).temporal_items()
    path = sinks.write_baskets(items, _scratch(spark, "baskets"), PLUS, "standin", "temporal")
    return sinks.read_temporal_baskets(spark, path)


@_query
def baskets_rewritten(spark, sf_dir):
    """Two cohorts' baskets in one folder, one of them written twice, and counted baskets beside them."""
    root = _scratch(spark, "baskets")
    plus, minus = (_study(spark, sf_dir, spec).temporal_items() for spec in (PLUS, MINUS))
    paths = {"plus": sinks.write_baskets(minus, root, PLUS, "standin", "temporal"), "minus": sinks.write_baskets(minus, root, MINUS, "standin", "temporal")}
    sinks.write_baskets(plus, root, PLUS, "standin", "temporal")
    counted = sinks.read_counted_baskets(spark, sinks.write_baskets(plus, root, PLUS, "standin", "counted"))
    lines = [spark.read.text(path).select(F.lit(name).alias("cohort"), F.col("value").alias("line"), F.lit(None).cast("long").alias("n")) for name, path in paths.items()]
    return lines[0].unionByName(lines[1]).unionByName(
        counted.select(F.lit("counted").alias("cohort"), F.concat_ws(",", F.col("subject_id").cast("string"), F.col("admit_id").cast("string"), "item").alias("line"), "n"))


@_query
def transaction_roundtrip(spark, sf_dir):
    items = _study(spark, sf_dir, MINUS).association_items()
    path = sinks.write_baskets(items, _scratch(spark, "baskets"), MINUS, "standin", "association")
    return sinks.read_transactions(spark, path).select("txn_id", F.array_join(F.array_sort("items"), ",").alias("items"))


@_query
def delimited_roundtrip(spark, sf_dir):
    """Packed visits written quoted, demographics unquoted, both read back headerless."""
    temporal, people = _scratch(spark, "temporal"), _scratch(spark, "people")
    sinks.write_delimited(pack_visits(spark, sf_dir), temporal, quote_all=True)
    sinks.write_delimited(S.people(spark, sf_dir), people, quote_all=False)
    packed = delimited.read_delimited(spark, temporal, schemas.TEMPORAL, header=False)
    back = delimited.read_delimited(
        spark, people, schemas.columns("subject_id long, segment string, nation string, region string"), header=False
    )
    return packed.join(back, "subject_id")


@_query
def parquet_roundtrip(spark, sf_dir):
    """Parsed death records saved by year and read back."""
    path = _scratch(spark, "deaths")
    sinks.write_table(S.death_fields(spark, sf_dir), path, partition_by=["data_year"])
    saved = spark.read.parquet(path)
    return saved.select("o_orderkey", F.col("data_year").cast("string").alias("data_year"), "underlying_cause", "multiple_causes")


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: patients per condition in the cohort "PROMO with brand 7"."""
    return _QUERIES["condition_patients_top20"](spark, os.environ.get("COHORTLOOM_SF_DIR", "/root/testdata/sf0.001"))


def _training_data() -> tuple[dict[str, Query], dict[str, str]]:
    """Queries and SQL of the training-data operators, if that subpackage can be imported."""
    try:
        import corpus_pipeline
        from cohortloom.llm import queries as llm
    except ImportError as missing:
        warnings.warn(f"training-data queries are left out: {missing}", stacklevel=2)
        return {}, {}
    sql = dict(llm.ORACLES)
    if corpus_pipeline.ORACLE_SQL:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return llm.QUERIES | {"pipeline": corpus_pipeline.run}, sql


_LLM_QUERIES, _LLM_ORACLES = _training_data()


def queries() -> dict[str, Query]:
    return _QUERIES | _LLM_QUERIES


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in (ORACLES | _LLM_ORACLES).items() if name in queries()}
