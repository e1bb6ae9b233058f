"""From raw files to a source: read by header, prepare, put together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortloom.operators import adverse, hospital, mortality, tidy
from cohortloom.operators.ranks import with_row_ids
from cohortloom.session import written
from cohortloom.sources import schemas
from cohortloom.sources.delimited import read_delimited, read_tsv
from cohortloom.sources.fixed_width import read_mortality
from cohortloom.sources.registry import Source, source


def hospital_source(
    spark: SparkSession, admissions: str, patients: str, diagnoses: str, icd9: DataFrame, partitions: int | None = None
) -> Source:
    """The hospital source from its three CSV files; ``partitions`` spreads gzipped ones."""
    stays = read_delimited(spark, admissions, schemas.ADMISSIONS, partitions=partitions)
    people = read_delimited(spark, patients, schemas.PATIENTS, partitions=partitions)
    codes = read_delimited(spark, diagnoses, schemas.DIAGNOSES, partitions=partitions)
    visits = written(hospital.tidy_visits(stays, codes, people), "hospital_visits")
    return source("mimic", {"icd9": icd9}, visits, hospital.demographics(stays, people))


def mortality_source(spark: SparkSession, path: str, icd10: DataFrame) -> Source:
    """The mortality source from fixed-width files; a record is a subject, numbered in file order."""
    records = with_row_ids(read_mortality(spark, path), "ID")
    visits = written(tidy.unpack(mortality.temporal(records)), "mortality_visits")
    return source("cdc_mortality", {"icd10": icd10}, visits, mortality.demographics(records))


def adverse_source(
    spark: SparkSession, case_indication: str, case_drug: str, drug_outcome: str, concept: str, icd9: DataFrame,
    text: str, select: str,
) -> Source:
    """The adverse-event source from its headerless TSV files.

    ``text`` picks the subjects by the wording of their indications, ``select`` the indications a
    condition is looked up in.
    """
    concepts = read_tsv(spark, concept, schemas.CONCEPT, header=True)
    indication = written(adverse.indications(read_tsv(spark, case_indication, schemas.CASE_INDICATION)), "indications")
    drug = written(adverse.drugs(read_tsv(spark, case_drug, schemas.CASE_DRUG)), "drugs")
    subjects = adverse.text_cohort(indication, text)
    outcome = adverse.outcomes(read_tsv(spark, drug_outcome, schemas.DRUG_OUTCOME))
    visits = written(adverse.temporal(outcome, drug, concepts, icd9, subjects), "adverse_visits")
    people = adverse.demographics(drug, indication, concepts, subjects)
    selection = adverse.selection(drug, indication, concepts, subjects, select)
    return source("aeolus", {"icd9": icd9}, visits, people, selection)
