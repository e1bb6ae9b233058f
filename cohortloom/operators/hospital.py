"""Hospital source: admissions, patients and diagnoses to tidy visits and demographics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortloom.functions.text import years_between
from cohortloom.operators.ranks import dense_rank_within, first_per_key, visit_bucket
from cohortloom.session import written


def subject_ages(admissions: DataFrame, patients: DataFrame) -> DataFrame:
    """Age at first admission and at death, for subjects with an admission."""
    firsts = admissions.groupBy("subject_id").agg(F.min("admittime").alias("first_admit"))
    return firsts.join(patients.select("subject_id", "dob", "dod"), "subject_id").select(
        "subject_id",
        years_between(F.col("first_admit"), F.col("dob")).alias("age"),
        years_between(F.col("dod"), F.col("dob")).alias("age_dod"),
    )


def _visit_keys(diagnoses: DataFrame) -> list[str]:
    return [k for k in ("subject_id", "hadm_id") if k in diagnoses.columns]


def numbered_admissions(admissions: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """Admissions that have a diagnosis, numbered per subject in time; equal times share a number.

    Numbering is done on admissions, not on the many diagnosis rows joined to them.
    """
    keys = _visit_keys(diagnoses)
    diagnosed = diagnoses.select(*keys).distinct()
    visits = admissions.select("subject_id", "hadm_id", "admittime").join(diagnosed, keys, "left_semi")
    visits = written(visits, "visits")  # read twice: to rank the times and to number the visits
    return dense_rank_within(visits, ["subject_id"], "admittime", "admit_id", visit_bucket("admittime"))


def tidy_visits(admissions: DataFrame, diagnoses: DataFrame, patients: DataFrame | None = None) -> DataFrame:
    """One row per (subject, visit, code), repeats kept; only known patients if given."""
    visits = numbered_admissions(admissions, diagnoses).select("subject_id", "hadm_id", "admit_id")
    if patients is not None:
        visits = visits.join(patients.select("subject_id").distinct(), "subject_id", "left_semi")
    keys = _visit_keys(diagnoses)
    return diagnoses.select(*keys, "icd_code").join(visits, keys).select("subject_id", "admit_id", "icd_code")


def demographics(admissions: DataFrame, patients: DataFrame) -> DataFrame:
    """One row per subject: ages, patient columns and the columns of the earliest admission."""
    columns = ["admission_type", "admission_location", "insurance", "language", "religion", "marital_status",
               "ethnicity", "hospital_expire_flag"]
    first = first_per_key(admissions.select("subject_id", "admittime", *columns), ["subject_id"], ["admittime"])
    ages = subject_ages(admissions, patients)
    return (
        ages.join(patients.select("subject_id", "gender", "expire_flag"), "subject_id")
        .join(first, "subject_id")
        .select("subject_id", "age", "age_dod", "gender", "expire_flag", *columns)
    )


def group_codes(mapping: DataFrame, ccs_codes: list[str]) -> DataFrame:
    """Codes of a condition group, by single-level category."""
    return mapping.filter(F.col("ccs_code").isin(ccs_codes)).select("icd_code").distinct()


def group_rows(tidy: DataFrame, mapping: DataFrame, ccs_codes: list[str]) -> DataFrame:
    """Diagnosis rows per description of one condition group, counted per code before the join;
    a code with several rows in the hierarchy counts once for each."""
    chosen = mapping.filter(F.col("ccs_code").isin(ccs_codes)).select("icd_code", "icd_desc", "ccs_desc")
    per_code = tidy.groupBy("icd_code").agg(F.count("*").alias("_n"))
    return per_code.join(chosen, "icd_code").groupBy("icd_desc", "ccs_desc").agg(F.sum("_n").alias("n_rows"))


def group_patients(tidy: DataFrame, mapping: DataFrame, ccs_codes: list[str]) -> DataFrame:
    """Subjects of one condition group, each counted under the description of its first code."""
    titles = mapping.groupBy("icd_code").agg(F.min("icd_desc").alias("icd_desc"))
    firsts = first_group_code(tidy, mapping, ccs_codes)
    per_code = firsts.groupBy("icd_code").agg(F.count("*").alias("_n"))
    return per_code.join(titles, "icd_code").groupBy("icd_desc").agg(F.sum("_n").alias("n_subjects"))


def first_group_code(tidy: DataFrame, mapping: DataFrame, ccs_codes: list[str]) -> DataFrame:
    """One row per subject with the group: the code of its earliest visit, the smallest if several."""
    chosen = group_codes(mapping, ccs_codes)
    rows = tidy.join(chosen, "icd_code", "left_semi").select("subject_id", "admit_id", "icd_code")
    return first_per_key(rows, ["subject_id"], ["admit_id", "icd_code"])
