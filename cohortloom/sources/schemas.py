"""Explicit schemas of the raw and processed inputs (fixed values: column names and order)."""

from __future__ import annotations

from pyspark.sql.types import (
    DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType,
)

from cohortloom.sources.delimited import strings

_TYPES = {
    "string": StringType(), "long": LongType(), "int": IntegerType(), "double": DoubleType(),
    "timestamp": TimestampType(),
}


def columns(text: str) -> StructType:
    """Schema from "name type, name type, …", without needing a session."""
    pairs = [field.split() for field in text.split(",")]
    return StructType([StructField(name, _TYPES[kind]) for name, kind in pairs])


DIAGNOSES = columns("row_id long, subject_id long, hadm_id long, seq_num int, icd_code string")
DIAGNOSIS_TITLES = columns("row_id long, icd_code string, short_title string, long_title string")
ADMISSIONS = columns(
    "subject_id long, hadm_id long, admittime timestamp, admission_type string, admission_location string, "
    "insurance string, language string, religion string, marital_status string, ethnicity string, "
    "hospital_expire_flag int"
)
PATIENTS = columns("subject_id long, gender string, dob timestamp, dod timestamp, expire_flag int")

CONCEPT = columns(
    "concept_id long, concept_name string, domain_id string, vocabulary_id string, concept_class_id string, "
    "standard_concept string, concept_code string, valid_start_date string, valid_end_date string, invalid_reason string"
)
CASE_INDICATION = columns(
    "primaryid long, isr long, indi_drug_seq long, indi_pt string, indication_concept_id long, "
    "snomed_indication_concept_id long"
)
DRUG_OUTCOME = columns(
    "drug_concept_id long, outcome_concept_id long, snomed_outcome_concept_id long, primaryid long, isr long"
)
CASE_DRUG = columns("primaryid long, isr long, drug_seq long, role_cod string, standard_concept_id long")

ICD9_MULTI = strings(
    "icd_code", "lvl1_cd", "lvl1_desc", "lvl2_cd", "lvl2_desc", "lvl3_cd", "lvl3_desc", "lvl4_cd", "lvl4_desc"
)
ICD9_SINGLE = strings("icd_code", "ccs_cat", "ccs_desc", "icd_desc", "ccs_opt_cat", "ccs_opt_desc")
CATEGORY_NAMES = strings("ccs_cat", "ccs_full_desc")
ICD9_CHAPTERS = strings("icd", "icd_chp")
CODE_MAP = strings("ICD_CODE", "ICD_NAME", "SNOMED_CID", "SNOMED_FSN")

TEMPORAL = columns("subject_id long, admit_id long, icd_code string")
HOSPITAL_DEMOGRAPHICS = columns(
    "subject_id long, age double, age_dod double, sex_at_birth string, expire_flag int, admit_type string, "
    "admit_location string, insurance string, language string, religion string, marital string, ethnicity string, "
    "hospital_expire_flag int"
)
MORTALITY_DEMOGRAPHICS = strings(
    "subject_id", "citizenship", "education1", "education2", "sex_at_birth", "age_group", "age_infant", "marital",
    "race", "hispanic"
)
ADVERSE_DEMOGRAPHICS = columns(
    "subject_id long, drug_seq long, drug_id long, drug_desc string, indi_desc string, indi_snomed_id long, "
    "indi_snomed_code string, indi_snomed_desc string"
)
