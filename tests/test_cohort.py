from cohortloom.operators import cohort as C, explore
from cohortloom.plans.study import Study
from cohortloom.sources.registry import source
from helpers import sorted_rows as rows

TIDY = [
    (1, 1, "a"), (1, 2, "a"), (1, 1, "b"),  # condition 1 again at visit 2, condition 2 at visit 1
    (2, 1, "a"), (2, 2, "c"),  # condition 1 only at visit 1
    (3, 2, "a"), (3, 2, "c"), (3, 2, "c"),  # condition 1 without condition 2
    (4, 3, "b"), (5, 2, "zzz"),
]


def tables(spark):
    tidy = spark.createDataFrame(TIDY, "subject_id long, admit_id int, icd_code string")
    mapping = spark.createDataFrame(
        [("a", "Anxiety", "5.2", "Anx, all"), ("b", "Mood", "5.8", "Mood"), ("c", "Cough", "8.1", "Cough"), ("c", "Cough", "8.1", "Cough")],
        "icd_code string, icd_desc string, ccs2_code string, ccs2_desc string")
    people = spark.createDataFrame([(1, "F"), (1, "M"), (3, "M"), (4, "F")], "subject_id long, sex string")
    return tidy, mapping, people


def test_cohorts(spark):
    tidy, mapping, _ = tables(spark)
    members = C.membership(tidy, mapping, C.CohortSpec("5.2 - Anxiety - other", "5.8"))
    base, plus, minus = (rows(f(members)) for f in (C.base_cohort, C.cohort_plus, C.cohort_minus))
    assert (base, plus, minus) == ([(1,), (3,)], [(1,)], [(3,)])
    assert sorted(plus + minus) == base
    every = C.membership(tidy, mapping, C.CohortSpec("5.2", "5.8", repeat_visits=False))
    assert rows(C.base_cohort(every)) == [(1,), (2,), (3,)]


def test_baskets_keep_fan_out_and_clean_commas(spark):
    tidy, mapping, _ = tables(spark)
    coded = tidy.join(mapping, "icd_code")
    subjects = spark.createDataFrame([(1,), (3,)], "subject_id long")
    assert rows(C.basket_text(C.temporal_items(coded, subjects, "ccs2"))) == [
        (1, 1, "5.2,5.8"), (1, 2, "5.2"), (3, 2, "5.2,8.1,8.1,8.1,8.1")]
    assert rows(C.basket_text(C.association_items(coded, subjects, "ccs2")), "items") == [
        ("Anx  all",), ("Anx  all,Cough,Cough,Cough,Cough",), ("Anx  all,Mood",)]
    assert rows(C.unique_codes(coded, subjects)) == [(1, "a"), (1, "b"), (3, "a"), (3, "c")]


def test_names_differ_with_every_parameter():
    specs = [C.CohortSpec("1", "2"), C.CohortSpec("1", "2", with_second=False), C.CohortSpec("1", "2", repeat_visits=False),
             C.CohortSpec("1", "2", "ccs1"), C.CohortSpec("1", "2", level_2="ccs1"), C.CohortSpec("1", "2", mining_level="icd")]
    assert len({s.name() for s in specs}) == len(specs)


def test_study(spark):
    tidy, mapping, people = tables(spark)
    hospital = source("mimic", {"icd9": mapping, "icd10": mapping}, tidy, people)
    study = Study(hospital, C.CohortSpec("5.2", "5.8", with_second=False))
    assert rows(study.subjects) == [(3,)]
    assert rows(study.demographics(["sex"])) == [(3, "M")]
    assert rows(study.condition_rows()) == [("Anx, all", 4), ("Cough", 6), ("Mood", 2)]
    assert rows(study.condition_patients()) == [("Anx, all", 1), ("Cough", 1)]
    assert rows(explore.value_counts(people, "sex")) == [("F", 2), ("M", 2)]
    both = Study(hospital, C.CohortSpec("5.2", "5.8"))
    assert rows(both.demographics(["sex"])) == [(1, "F")]


def test_study_sequences_and_rules(spark):
    data = [(s, v, c) for s in range(1, 6) for v, codes in enumerate(["ab", "c", "a"], 1) for c in codes]
    tidy = spark.createDataFrame(data, "subject_id long, admit_id int, icd_code string")
    _, mapping, people = tables(spark)
    study = Study(source("mimic", {"icd9": mapping}, tidy, people), C.CohortSpec("5.2", "5.8"))
    table = study.sequences(support=0.5, starts_with="Mood", contains="Anx")
    assert rows(table, "sequence", "support") == [("5.8 => 5.2", 1.0), ("5.8 => 8.1 => 5.2", 1.0)]
    found = {(tuple(r["antecedent"]), tuple(r["consequent"])): round(r["lift"], 6) for r in study.rules(0.3, 0.9).collect()}
    assert found == {(("Mood",), ("Anx  all",)): 1.5}


def test_adverse_source_keeps_unknown_codes(spark):
    tidy, mapping, people = tables(spark)
    mapping = mapping.dropDuplicates().withColumnRenamed("ccs2_desc", "d").selectExpr("icd_code", "ccs2_code", "d as ccs2_desc", "icd_code as snomed_code")
    selection = spark.createDataFrame([(5, 2, "a"), (3, 1, "a")], "subject_id long, admit_id int, snomed_code string")
    aeolus = source("aeolus", {"icd9": mapping}, tidy, people, selection)
    study = Study(aeolus, C.CohortSpec("5.2", "5.8", with_second=False))
    assert rows(study.temporal_items()) == [(5, 2, "999999", 1)]
    assert not aeolus.dense_visits and study.sequences(0.5).count() == 0
