"""Adverse-event source: cases, drugs, indications and outcomes linked through concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortloom.functions.text import matches
from cohortloom.operators.ranks import dense_rank_all
from cohortloom.session import written


def with_subject(df: DataFrame) -> DataFrame:
    """The case id, or the older report number where there is none."""
    return df.withColumn("subject_id", F.coalesce("primaryid", "isr")).drop("primaryid", "isr")


def indications(case_indication: DataFrame) -> DataFrame:
    return (
        with_subject(case_indication)
        .select(
            "subject_id",
            F.col("indi_pt").alias("indi_desc"),
            "indication_concept_id",
            F.col("snomed_indication_concept_id").alias("indi_snomed_id"),
        )
        .dropna(subset=["subject_id", "indi_snomed_id"])
    )


def drugs(case_drug: DataFrame) -> DataFrame:
    return with_subject(case_drug).select("subject_id", "drug_seq", F.col("standard_concept_id").alias("drug_id"))


def outcomes(drug_outcome: DataFrame) -> DataFrame:
    return (
        with_subject(drug_outcome)
        .select(
            "subject_id",
            F.col("drug_concept_id").alias("drug_id"),
            "outcome_concept_id",
            F.col("snomed_outcome_concept_id").alias("outcome_snomed_id"),
        )
        .dropna(subset=["subject_id", "drug_id", "outcome_concept_id"])
    )


def text_cohort(indication: DataFrame, pattern: str) -> DataFrame:
    """Subjects with an indication whose text matches."""
    return indication.filter(matches(F.col("indi_desc"), pattern)).select("subject_id").distinct()


def code_cohort(
    indication: DataFrame, concept: DataFrame, bridge: DataFrame, mapping: DataFrame, level_column: str, code: str
) -> DataFrame:
    """Subjects with an indication that leads, concept by concept, to one hierarchy code.

    The hops are reduced to the set of indication concepts that arrive, before any case is read.
    """
    arriving = (
        mapping.filter(F.col(level_column) == code)
        .select("icd_code")
        .distinct()
        .join(bridge.select("icd_code", "snomed_code"), "icd_code")
        .select(F.col("snomed_code").try_cast("double").alias("_code"))
        .distinct()
    )
    concepts = (
        concept.select("concept_id", F.col("concept_code").try_cast("double").alias("_code"))
        .join(arriving, "_code", "left_semi")
        .select(F.col("concept_id").alias("indi_snomed_id"))
        .distinct()
    )
    return indication.join(concepts, "indi_snomed_id", "left_semi").select("subject_id").distinct()


def cohort_overlap(text_subjects: DataFrame, code_subjects: DataFrame) -> DataFrame:
    """Sizes of two cohorts: each one, both, and either alone."""
    both = text_subjects.withColumn("_text", F.lit(1)).unionByName(
        code_subjects.withColumn("_code", F.lit(1)), allowMissingColumns=True
    )
    flags = both.groupBy("subject_id").agg(F.max("_text").alias("t"), F.max("_code").alias("c"))
    return flags.agg(
        F.count("t").alias("by_text"),
        F.count("c").alias("by_code"),
        F.count(F.when(F.col("t").isNotNull() & F.col("c").isNotNull(), 1)).alias("in_both"),
        F.count(F.when(F.col("c").isNull(), 1)).alias("text_only"),
        F.count(F.when(F.col("t").isNull(), 1)).alias("code_only"),
    )


def drug_usage(subjects: DataFrame, drug: DataFrame, concept: DataFrame, over: int) -> DataFrame:
    """Uses per drug name among the subjects, most used first, above a threshold.

    A subject without any drug counts under a missing name.  Uses are counted per drug id before
    names are attached; a drug with several names counts for each.
    """
    per_id = (
        subjects.join(drug.select("subject_id", "drug_id"), "subject_id", "left")
        .groupBy("drug_id")
        .agg(F.count("*").alias("_n"))
    )
    names = concept.select(F.col("concept_id").alias("drug_id"), "concept_name")
    return (
        per_id.join(names, "drug_id", "left")
        .groupBy("concept_name")
        .agg(F.sum("_n").alias("count"))
        .filter(F.col("count") > over)
        .orderBy(F.desc("count"), "concept_name")
    )


def demographics(drug: DataFrame, indication: DataFrame, concept: DataFrame, subjects: DataFrame) -> DataFrame:
    """Drugs and indications of each chosen subject, with names.

    One row per drug and indication of a subject: that is the table asked for.  Names are attached
    to each side before the two are paired, so the pairing is the last, and only, growing step.
    """
    names = concept.select("concept_id", "concept_name", "concept_code")
    named_drugs = drug.join(subjects, "subject_id", "left_semi").join(
        names.select(F.col("concept_id").alias("drug_id"), F.col("concept_name").alias("drug_desc")), "drug_id", "left"
    )
    named_indications = indication.join(subjects, "subject_id", "left_semi").join(
        names.select(
            F.col("concept_id").alias("indi_snomed_id"),
            F.col("concept_code").alias("indi_snomed_code"),
            F.col("concept_name").alias("indi_snomed_desc"),
        ),
        "indi_snomed_id",
        "left",
    )
    return named_drugs.join(named_indications, "subject_id").select(
        "subject_id", "drug_seq", "drug_id", "drug_desc", "indi_desc", "indi_snomed_id", "indi_snomed_code",
        "indi_snomed_desc",
    )


def selection(
    drug: DataFrame, indication: DataFrame, concept: DataFrame, subjects: DataFrame, pattern: str
) -> DataFrame:
    """Rows conditions are looked up in: (subject, last visit, secondary code).

    A visit is the rank of a drug sequence over all chosen subjects, and every indication of a
    subject stands in each of its visits.  Selection only asks whether a code occurs after visit 1,
    so each indication is kept once, with the subject's last visit, instead of once per visit.
    """
    described = indication.join(subjects, "subject_id", "left_semi")
    known = described.select("subject_id").distinct()
    sequences = written(
        drug.select("subject_id", "drug_seq").distinct().join(known, "subject_id", "left_semi"), "drug_sequences"
    )
    last = dense_rank_all(sequences, "drug_seq", "_rank").groupBy("subject_id").agg(F.max("_rank").alias("admit_id"))
    codes = concept.select(F.col("concept_id").alias("indi_snomed_id"), F.col("concept_code").alias("snomed_code"))
    return (
        described.filter(matches(F.col("indi_desc"), pattern))
        .select("subject_id", "indi_snomed_id")
        .distinct()
        .join(codes, "indi_snomed_id")
        .join(last, "subject_id")
        .select("subject_id", "admit_id", F.col("snomed_code").cast("string").alias("snomed_code"))
    )


def outcome_codes(concept: DataFrame, mapping: DataFrame, dedupe: bool = False) -> DataFrame:
    """Outcome concept → hierarchy code, ``weight`` times for each pair.

    Walking the hops twice, once to keep usable outcomes and once to name their codes, multiplies
    rows: an outcome with m hierarchy rows gives m of each.  ``dedupe`` counts each pair once.
    """
    hops = (
        concept.select(F.col("concept_id").alias("outcome_snomed_id"), F.col("concept_code").alias("snomed_code"))
        .join(mapping.select("snomed_code", "icd_code"), "snomed_code")
        .select("outcome_snomed_id", "icd_code")
    )
    if dedupe:
        return hops.distinct().withColumn("weight", F.lit(1).cast("long"))
    reach = hops.groupBy("outcome_snomed_id").agg(F.count("*").alias("_reach"))
    pairs = hops.groupBy("outcome_snomed_id", "icd_code").agg(F.count("*").alias("_rows"))
    return pairs.join(reach, "outcome_snomed_id").select(
        "outcome_snomed_id", "icd_code", (F.col("_rows") * F.col("_reach")).alias("weight")
    )


def temporal(
    outcome: DataFrame, drug: DataFrame, concept: DataFrame, mapping: DataFrame, subjects: DataFrame, dedupe: bool = False
) -> DataFrame:
    """Visit rows in counted form: (subject, visit, code, n).

    The visit number is the rank of the drug sequence among all rows kept, over all subjects.
    Every step is counted instead of repeated: outcomes and drugs of a subject meet as counts per
    drug, and the concept hops enter as weights.
    """
    # as a stored table it is a plain side of the join below, which adaptive execution can then split
    codes = written(outcome_codes(concept, mapping, dedupe), "outcome_codes")
    per_outcome = (
        outcome.select("subject_id", "drug_id", "outcome_snomed_id")
        .groupBy("subject_id", "drug_id", "outcome_snomed_id")
        .agg(F.count("*").alias("_outcomes"))
        .join(subjects, "subject_id", "left_semi")
        .join(codes, "outcome_snomed_id")
        .groupBy("subject_id", "drug_id", "icd_code")
        .agg(F.sum(F.col("_outcomes") * F.col("weight")).alias("_codes"))
    )
    per_drug = drug.groupBy("subject_id", "drug_id", "drug_seq").agg(F.count("*").alias("_uses"))
    rows = (
        per_outcome.join(per_drug, ["subject_id", "drug_id"])
        .groupBy("subject_id", "drug_seq", "icd_code")
        .agg(F.sum(F.col("_codes") * F.col("_uses")).alias("n"))
    )
    rows = written(rows, "adverse_rows")  # read twice below: to rank the sequences and to number the rows
    return dense_rank_all(rows, "drug_seq", "admit_id").select("subject_id", "admit_id", "icd_code", "n")
