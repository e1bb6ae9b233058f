import datetime as dt

from pyspark.sql import functions as F

from cohortloom.operators import adverse, hospital, mortality, tidy
from cohortloom.operators.cohort import basket_text
from cohortloom.sources.fixed_width import MORTALITY_LAYOUT, offsets, parse_fixed_width
from helpers import sorted_rows as rows


def day(text):
    return dt.datetime.fromisoformat(text)


def hospital_tables(spark):
    admissions = spark.createDataFrame(
        [(1, 10, day("2100-01-02"), "EMERGENCY"), (1, 11, day("2100-05-01"), "ELECTIVE"), (1, 12, day("2100-05-01"), "URGENT"),
         (1, 13, day("2100-03-01"), "NONE"), (2, 20, day("2101-01-01"), "ELECTIVE"), (3, 30, day("2102-01-01"), "ELECTIVE")],
        "subject_id long, hadm_id long, admittime timestamp, admission_type string")
    extra = ["admission_location", "insurance", "language", "religion", "marital_status", "ethnicity"]
    admissions = admissions.withColumns({c: F.lit(None).cast("string") for c in extra}).withColumn("hospital_expire_flag", F.lit(0))
    patients = spark.createDataFrame(
        [(1, "F", day("2050-01-03"), None, 0), (2, "M", day("2051-01-01"), day("2101-02-01"), 1)],
        "subject_id long, gender string, dob timestamp, dod timestamp, expire_flag int")
    diagnoses = spark.createDataFrame(
        [(1, 10, "A"), (1, 10, "A"), (1, 11, "B"), (1, 12, "C"), (2, 20, "A"), (3, 30, "Z")],
        "subject_id long, hadm_id long, icd_code string")
    return admissions, patients, diagnoses


def test_hospital(spark):
    admissions, patients, diagnoses = hospital_tables(spark)
    visits = hospital.tidy_visits(admissions, diagnoses, patients)
    # admission 13 has no diagnosis and takes no number; equal times share one; patient 3 is unknown
    assert rows(visits) == [(1, 1, "A"), (1, 1, "A"), (1, 2, "B"), (1, 2, "C"), (2, 1, "A")]
    packed = basket_text(tidy.count_codes(visits))
    assert rows(packed) == [(1, 1, "A,A"), (1, 2, "B,C"), (2, 1, "A")]
    assert rows(tidy.unpack(packed.withColumnRenamed("items", "icd_code"))) == rows(visits)
    people = hospital.demographics(admissions, patients)
    assert rows(people, "subject_id", "gender", "admission_type") == [(1, "F", "EMERGENCY"), (2, "M", "ELECTIVE")]
    ages = {r["subject_id"]: r for r in people.collect()}
    assert abs(ages[1]["age"] - (day("2100-01-02") - day("2050-01-03")).days / 7 / 52.25) < 1e-9
    assert ages[1]["age_dod"] is None and ages[2]["age_dod"] > ages[2]["age"]


def test_hospital_groups(spark):
    admissions, _, diagnoses = hospital_tables(spark)
    visits = hospital.tidy_visits(admissions, diagnoses)
    mapping = spark.createDataFrame(
        [("A", "aa", "657", "Mood"), ("A", "aa", "657", "Mood"), ("B", "bb", "657", "Mood"), ("C", "cc", "651", "x")],
        "icd_code string, icd_desc string, ccs_code string, ccs_desc string")
    assert rows(hospital.group_rows(visits, mapping, ["657"])) == [("aa", "Mood", 6), ("bb", "Mood", 1)]
    assert rows(hospital.group_patients(visits, mapping, ["657"])) == [("aa", 2)]
    assert rows(hospital.group_codes(mapping, ["657"])) == [("A",), ("B",)]


def adverse_tables(spark):
    case_drug = spark.createDataFrame(
        [(1, None, 5, "PS", 100), (1, None, 5, "PS", 100), (None, 2, 9, "SS", 100), (3, None, 7, "PS", 101), (None, None, 1, "C", 100)],
        "primaryid long, isr long, drug_seq long, role_cod string, standard_concept_id long")
    outcome = spark.createDataFrame(
        [(100, 50, 50, 1, None), (100, 50, 50, None, 2), (101, 51, 51, 3, None), (None, 50, 50, 1, None)],
        "drug_concept_id long, outcome_concept_id long, snomed_outcome_concept_id long, primaryid long, isr long")
    indication = spark.createDataFrame(
        [(1, None, 1, "ANXIETY", 60, 60), (None, 2, 1, "ANXIETY STATE", 61, 61), (3, None, 1, "PAIN", 62, 62), (4, None, 1, "ANXIETY", 1, None)],
        "primaryid long, isr long, indi_drug_seq long, indi_pt string, indication_concept_id long, snomed_indication_concept_id long")
    concept = spark.createDataFrame(
        [(100, "drug a", "1"), (101, "drug b", "2"), (50, "outcome", "777"), (51, "other", "888"), (60, "anx", "555"), (61, "anx2", "556")],
        "concept_id long, concept_name string, concept_code string")
    mapping = spark.createDataFrame(
        [("X1", "777", "5.2"), ("X2", "777", "5.8"), ("Y", "555", "5.2")], "icd_code string, snomed_code string, ccs2_code string")
    return case_drug, outcome, indication, concept, mapping


def test_adverse(spark):
    case_drug, outcome, indication, concept, mapping = adverse_tables(spark)
    indications = adverse.indications(indication)
    subjects = adverse.text_cohort(indications, "ANXIETY")
    assert rows(subjects) == [(1,), (2,)]
    drugs = adverse.drugs(case_drug)
    temporal = adverse.temporal(adverse.outcomes(outcome), drugs, concept, mapping, subjects)
    # two hierarchy rows reached twice: each code counts double; subject 1 has two drug rows
    assert rows(temporal) == [(1, 1, "X1", 4), (1, 1, "X2", 4), (2, 2, "X1", 2), (2, 2, "X2", 2)]
    once = adverse.temporal(adverse.outcomes(outcome), drugs, concept, mapping, subjects, dedupe=True)
    assert rows(once, "subject_id", "icd_code", "n") == [(1, "X1", 2), (1, "X2", 2), (2, "X1", 1), (2, "X2", 1)]
    by_code = adverse.code_cohort(indications, concept, mapping, mapping, "ccs2_code", "5.2")
    assert rows(by_code) == [(1,)]
    assert rows(adverse.cohort_overlap(subjects, by_code)) == [(2, 1, 1, 1, 0)]
    assert rows(adverse.drug_usage(subjects, drugs, concept, 0)) == [("drug a", 3)]
    assert rows(adverse.drug_usage(subjects, drugs, concept, 3)) == []


def test_adverse_selection_agrees_with_the_paired_table(spark):
    case_drug, _, indication, concept, _ = adverse_tables(spark)
    indications, drugs = adverse.indications(indication), adverse.drugs(case_drug)
    subjects = adverse.text_cohort(indications, "ANXIETY")
    people = adverse.demographics(drugs, indications, concept, subjects)
    assert rows(people, "subject_id", "drug_seq", "drug_desc", "indi_snomed_code", "indi_snomed_desc") == [
        (1, 5, "drug a", "555", "anx"), (1, 5, "drug a", "555", "anx"), (2, 9, "drug a", "556", "anx2")]
    assert rows(adverse.selection(drugs, indications, concept, subjects, "ANXIETY")) == [(1, 1, "555"), (2, 2, "556")]


def test_layout():
    at = offsets(MORTALITY_LAYOUT)
    assert sum(w for _, w in MORTALITY_LAYOUT) == 488 and len(MORTALITY_LAYOUT) == 45
    # start and width of fields named in the record's description
    assert at["res_status"] == (20, 1) and at["education_89"] == (61, 2) and at["data_year"] == (102, 4)
    assert at["underlying_cause"] == (146, 4) and at["multiple_causes"] == (163, 281) and at["hispanic_recode"] == (488, 1)


def deaths(spark):
    def line(**fields):
        text = [" "] * 488
        for name, value in fields.items():
            start, _ = offsets(MORTALITY_LAYOUT)[name]
            text[start - 1 : start - 1 + len(value)] = value
        return "".join(text)

    lines = [
        (1, line(res_status="1", education_89="12", age_group="03", underlying_cause="I250", race="01", sex="F",
                 multiple_causes="11I250 21E119 02 I250 E119 I250", hispanic_recode="6")),
        (2, line(res_status="9", age_infant="09", underlying_cause="C349", multiple_causes="11C349")),
    ]
    return parse_fixed_width(spark.createDataFrame(lines, "ID long, value string"), MORTALITY_LAYOUT)


def test_mortality(spark):
    records = deaths(spark)
    assert not [c for c in records.columns if "drop" in c]
    split = {r["ID"]: (r["entity_axis"], r["record_axis"]) for r in mortality.split_axes(records).collect()}
    assert split == {1: ("11I250 21E119", "I250 E119 I250"), 2: ("11C349", None)}
    assert rows(mortality.temporal(records)) == [(1, 1, "I250"), (1, 2, "E119,I250"), (2, 1, "C349")]
    people = {r["subject_id"]: r for r in mortality.demographics(records).collect()}
    assert (people[1]["citizenship"], people[1]["education1"], people[1]["race"], people[1]["age_infant"]) == (
        "resident", "12", "White", "NotInfantNotStated")
    assert (people[2]["citizenship"], people[2]["education1"], people[2]["age_infant"]) == (None, None, "days7-13")
