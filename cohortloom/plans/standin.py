"""The supplied sales tables read as a coded event history.

Customers are subjects, orders are admissions, ordered parts are diagnosis codes, and the part table
is the code hierarchy.  These views only rename and derive columns; no rows are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortloom.operators import hospital
from cohortloom.operators.hierarchy import with_labels
from cohortloom.sources.fixed_width import MORTALITY_LAYOUT


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as admissions."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("subject_id"),
        F.col("o_orderkey").alias("hadm_id"),
        F.col("o_orderdate").alias("admittime"),
        F.col("o_orderpriority").alias("admission_type"),
        F.col("o_orderstatus").alias("admission_location"),
    )


def diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as diagnosis rows."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("hadm_id"), F.col("l_partkey").cast("string").alias("icd_code")
    )


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tidy rows (subject_id, admit_id, icd_code)."""
    return hospital.tidy_visits(admissions(spark, sf_dir), diagnoses(spark, sf_dir))


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a code hierarchy: size band, brand, type, and type with brand."""
    number = F.replace("p_brand", F.lit("Brand#"), F.lit(""))
    band = (F.floor((F.col("p_size") - 1) / 10) + 1).cast("string")
    return with_labels(
        table(spark, sf_dir, "part").select(
            F.col("p_partkey").cast("string").alias("icd_code"),
            F.concat("p_name", F.lit(" #"), F.col("p_partkey").cast("string")).alias("icd_desc"),
            number.alias("ccs_code"),
            F.col("p_brand").alias("ccs_desc"),
            F.col("p_type").alias("ccs1_code"),
            F.lower("p_type").alias("ccs1_desc"),
            F.concat("p_type", F.lit("."), number).alias("ccs2_code"),
            F.concat(F.lower("p_type"), F.lit(" "), F.col("p_brand")).alias("ccs2_desc"),
            band.alias("icd_chp_code"),
            F.concat(F.lit("size band "), band).alias("icd_chp_desc"),
        )
    )


def fanned_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hierarchy with a secondary code: one row per part and region, for parts whose size is the
    number of a nation, and one row without secondary code for the others."""
    nations = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("p_size"), F.col("n_regionkey").cast("string").alias("snomed_code"),
        F.col("n_name").alias("snomed_desc"),
    )
    sizes = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("icd_code"), "p_size")
    both = nations.unionByName(nations.withColumn("snomed_code", F.concat(F.lit("R"), "snomed_code")))
    secondary = sizes.join(both, "p_size").drop("p_size")
    return mapping(spark, sf_dir).join(secondary, "icd_code", "left")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demographics: customer, nation and region."""
    return (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("c_custkey").alias("subject_id"),
            F.col("c_mktsegment").alias("segment"),
            F.col("n_name").alias("nation"),
            F.col("r_name").alias("region"),
        )
    )


def daily_events(spark: SparkSession, sf_dir: str, by_value: bool = False) -> DataFrame:
    """Events as a second, denser source: a visit is a day with events, its codes the event types,
    with ``by_value`` divided by the size of the event."""
    code = F.col("event_type")
    if by_value:
        code = F.concat(code, F.lit(" "), F.floor(F.col("value") / 25).cast("string"))
    days = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("subject_id"), F.date_trunc("day", "ts").alias("hadm_id"), code.alias("icd_code"),
    )
    stays = days.select("subject_id", "hadm_id", F.col("hadm_id").alias("admittime")).distinct()
    return hospital.tidy_visits(stays, days)


def event_paths(spark: SparkSession, sf_dir: str, weekdays: bool = False) -> DataFrame:
    """A sequence table of users' paths: the number of events on each of their days with events, in order.

    A path has a state per calendar day at most, with ``weekdays`` one for each day of the week (Monday first) with events.
    """
    day = F.weekday("ts") if weekdays else F.to_date("ts")
    daily = table(spark, sf_dir, "events").groupBy("user_id", day.alias("day")).agg(F.count("*").cast("string").alias("n"))
    paths = daily.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("day", "n"))).alias("steps"))
    shares = paths.groupBy(F.transform("steps", lambda x: x["n"]).alias("states")).agg(F.count("*").alias("count"))
    users = paths.count()
    return shares.select(F.array_join("states", " => ").alias("sequence"), (F.col("count") / users).alias("support"), "states")


def path_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions of the states of :func:`event_paths`."""
    daily = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts")).agg(F.count("*").cast("string").alias("ccs1_code"))
    name = F.when(F.col("ccs1_code") == "9", "Unclassified").otherwise(F.concat("ccs1_code", F.lit(" events")))
    return daily.select("ccs1_code").distinct().withColumn("ccs1_desc", name)


# --- adverse-event source: order lines are drug uses and outcomes, customers carry an indication ---


def _report_ids(case: Column, missing: Column) -> list[Column]:
    return [F.when(~missing, case).alias("primaryid"), case.alias("isr")]


def case_drug(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    return lines.select(
        *_report_ids(F.col("o_custkey"), F.col("o_orderstatus") == "P"),
        F.datediff("o_orderdate", F.lit("1990-01-01")).cast("long").alias("drug_seq"),
        F.col("l_returnflag").alias("role_cod"),
        F.col("l_partkey").alias("standard_concept_id"),
    )


def drug_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    return lines.select(
        F.col("l_partkey").alias("drug_concept_id"),
        F.col("l_suppkey").alias("outcome_concept_id"),
        F.col("l_suppkey").alias("snomed_outcome_concept_id"),
        *_report_ids(F.col("o_custkey"), F.col("o_orderstatus") == "P"),
    )


def case_indication(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        *_report_ids(F.col("c_custkey"), F.col("c_acctbal") < 0),
        F.col("c_custkey").alias("indi_drug_seq"),
        F.col("c_mktsegment").alias("indi_pt"),
        F.col("c_nationkey").cast("long").alias("indication_concept_id"),
        F.when(F.col("c_acctbal") < 9000, F.col("c_nationkey").cast("long")).alias("snomed_indication_concept_id"),
    )


def concept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as outcome and indication concepts, coded by nation."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("concept_id"),
        F.col("s_name").alias("concept_name"),
        F.col("s_nationkey").cast("string").alias("concept_code"),
    )


def drug_concept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("concept_id"), F.col("p_name").alias("concept_name"))


def nation_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as codes with the nation number as secondary code, plus one code per region reached
    from every nation in it, so that a secondary code leads to two codes."""
    nations = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )

    def rows(code: Column, desc: Column) -> DataFrame:
        return nations.select(
            code.alias("icd_code"), desc.alias("icd_desc"), F.col("r_regionkey").cast("string").alias("ccs_code"),
            F.col("r_name").alias("ccs_desc"), F.col("n_nationkey").cast("string").alias("snomed_code"),
            F.col("n_name").alias("snomed_desc"),
        )

    return rows(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")), F.col("n_name")).unionByName(
        rows(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")), F.col("r_name"))
    )


# --- mortality source: an order is a death record, laid out as fixed-width text ---


def death_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order columns standing for the fields of a death record (null means blank)."""
    rows = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    day, month = F.dayofmonth("o_orderdate"), F.month("o_orderdate")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    status = F.col("o_orderstatus")
    nation = F.concat(F.lit("C"), two(F.col("c_nationkey")))
    urgency = F.concat(F.lit("P"), F.substring("o_orderpriority", 1, 1), F.lit("0"))
    outcome = F.concat(F.lit("S"), status, F.lit("1"))
    entity = F.concat_ws(" ", outcome, urgency)
    record = F.when(status == "F", F.concat_ws(" ", nation, urgency, outcome)).when(
        status == "P", F.concat_ws(" ", urgency, nation, nation)
    )
    causes = F.when(record.isNull(), entity).otherwise(F.concat(entity, F.lit(" 03 "), record))
    return rows.select(
        F.col("o_orderkey"),
        F.substring("o_orderpriority", 1, 1).alias("res_status"),
        two(F.col("c_nationkey")).alias("education_89"),
        F.substring("c_mktsegment", 1, 1).alias("sex"),
        F.when(status != "P", F.substring(month.cast("string"), 1, 1)).alias("education_03"),
        two(month).alias("age_group"),
        F.when(status != "O", two(day)).alias("age_infant"),
        F.substring("c_mktsegment", 2, 1).alias("marital"),
        F.year("o_orderdate").cast("string").alias("data_year"),
        nation.alias("underlying_cause"),
        causes.alias("multiple_causes"),
        two(F.col("c_nationkey")).alias("race"),
        F.substring("o_orderpriority", 1, 1).alias("hispanic_recode"),
    )


def death_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records as fixed-width lines: (o_orderkey, value)."""
    fields = death_fields(spark, sf_dir)
    cells = [
        F.rpad(F.coalesce(F.col(name), F.lit("")), width, " ") if name in fields.columns else F.repeat(F.lit(" "), F.lit(width))
        for name, width in MORTALITY_LAYOUT
    ]
    return fields.select("o_orderkey", F.concat(*cells).alias("value"))
