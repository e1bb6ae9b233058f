import gzip

import pytest
from pyspark.sql import functions as F

from cohortloom.operators import cohort as C
from cohortloom.session import forget, lineage_dir, owned, written
from cohortloom.sources import delimited as D, fixed_width as FW, jdbc, registry, schemas, sinks
from helpers import sorted_rows as rows


def test_csv_missing_tokens_and_gzip(spark, tmp_path):
    with gzip.open(tmp_path / "t.csv.gz", "wt") as f:
        f.write('"SUBJECT_ID","CODE","N"\n1,"a,b",5\n2,NULL,null\n3,NA,x\n4,,7\n')
    schema = schemas.columns("subject_id long, code string, n int")
    df = D.read_delimited(spark, str(tmp_path / "t.csv.gz"), schema, partitions=2)
    assert rows(df) == [(1, "a,b", 5), (2, None, None), (3, None, None), (4, None, 7)]


def test_tsv_backslash_tokens(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("1\t\\N\t3\tPS\t100\n\\\\N\t2\t4\tNA\t\\N\n")
    df = D.read_tsv(spark, str(tmp_path / "t.tsv"), schemas.CASE_DRUG)
    assert rows(df, "drug_seq", "primaryid", "isr", "role_cod", "standard_concept_id") == [(3, 1, None, "PS", 100), (4, None, 2, None, None)]


def test_all_text_schema_keeps_leading_zeros(spark, tmp_path):
    (tmp_path / "m.csv").write_text("a,b,c,d,e,f,g,h,i\n0030,1,x,1.1,y,,,,\n")
    row = D.read_delimited(spark, str(tmp_path / "m.csv"), schemas.ICD9_MULTI, by_position=True).first()
    assert row["icd_code"] == "0030" and row["lvl3_cd"] is None


def test_names(spark):
    assert D.clean_name("'ICD-10-CM CODE DESCRIPTION'") == "codedescription"
    assert D.clean_name("'MULTI CCS LVL 1'") == "lvl1"
    df = spark.createDataFrame([(1, 2, 3)], ["'CCS Category'", "drop1", "x"])
    assert D.clean_names(df).columns == ["category", "drop1", "x"]
    assert D.rename_position(df, 3, "icd_code").columns[2] == "icd_code"
    assert D.drop_containing(df, "drop").columns == ["'CCS Category'", "x"]


def test_jdbc_options():
    o = jdbc.jdbc_options("jdbc:mysql://h/db", "diagnoses", "subject_id", (1, 99), 8, user="u")
    assert (o["partitionColumn"], o["lowerBound"], o["upperBound"], o["numPartitions"], o["user"]) == ("subject_id", "1", "99", "8", "u")
    assert "partitionColumn" not in jdbc.jdbc_options("u", "t")
    with pytest.raises(ValueError):
        jdbc.jdbc_options("u", "t", key="k")


def test_registry(spark, tmp_path):
    df = spark.range(3)
    df.write.parquet(str(tmp_path / "t"))
    assert registry.reader("parquet")(spark, str(tmp_path / "t")).count() == 3
    for bad in (lambda: registry.reader("x"), lambda: registry.source("x", {}, df, df)):
        with pytest.raises(ValueError):
            bad()


def test_basket_files(spark, tmp_path):
    items = spark.createDataFrame([(1, 1, "a", 2), (1, 1, "b", 1), (1, 2, "c", 1)], "subject_id long, admit_id int, item string, n long")
    spec = C.CohortSpec("5.2", "5.8")
    temporal = sinks.write_baskets(items, str(tmp_path), spec, "mimic", "temporal")
    assert rows(spark.read.text(temporal)) == [("1,1,a,a,b",), ("1,2,c",)]
    assert rows(sinks.read_temporal_baskets(spark, temporal)) == [(1, 1, "a"), (1, 1, "b"), (1, 2, "c")]
    association = sinks.write_baskets(items, str(tmp_path), spec, "mimic", "association")
    assert rows(spark.read.text(association)) == [("1,a,a,b",), ("1,c",)]
    assert rows(sinks.read_transactions(spark, association)) == [("1", ["a", "b"]), ("1", ["c"])]
    other = sinks.basket_path(str(tmp_path), C.CohortSpec("5.2", "5.8", repeat_visits=False), "mimic", "temporal")
    assert other != temporal and "mimic" in temporal


def test_delimited_and_table_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'x,"y"', 2001), (2, None, 2002)], "id long, v string, year int")
    sinks.write_delimited(df, str(tmp_path / "c"), quote_all=False)
    back = D.read_delimited(spark, str(tmp_path / "c"), schemas.columns("id long, v string, year int"), header=False)
    assert rows(back) == rows(df)
    sinks.write_table(df, str(tmp_path / "p"), ["year"])
    assert sorted(p.name for p in (tmp_path / "p").iterdir() if p.is_dir()) == ["year=2001", "year=2002"]


def test_lineage_folder_comes_from_the_session(spark):
    assert lineage_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = written(spark.range(10).withColumn("x", F.col("id") * 2), "numbers")
    assert lineage_dir(spark) in df.inputFiles()[0]
    assert df.agg(F.sum("x")).first()[0] == 90


class _Context:
    """A session without spark.checkpoint.dir, as far as the lookup looks at it."""

    def __init__(self, master):
        self.master, self.folder, self.sparkContext = master, None, self
        self.conf = self

    def get(self, key, default=None):
        return default

    def getConf(self):
        return self

    def setCheckpointDir(self, folder):
        self.folder = folder

    def getCheckpointDir(self):
        return self.folder


def test_only_local_sessions_fall_back_to_a_private_folder():
    local = _Context("local[2]")
    assert lineage_dir(local) == local.folder == lineage_dir(local)
    with pytest.raises(ValueError):
        lineage_dir(_Context("yarn"))


def test_forget_deletes_only_written_tables(spark, tmp_path):
    table = written(spark.range(5), "gone")
    spark.range(3).write.parquet(str(tmp_path / "kept"))
    kept = spark.read.parquet(str(tmp_path / "kept"))
    forget(table)
    forget(kept)
    assert kept.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(table.inputFiles()[0])


def test_header_columns_are_picked_by_name(spark, tmp_path):
    (tmp_path / "p.csv").write_text("ROW_ID,SUBJECT_ID,GENDER,DOB,DOD,EXPIRE_FLAG\n7,3,F,2001-02-03 00:00:00,,1\n")
    row = D.read_delimited(spark, str(tmp_path / "p.csv"), schemas.PATIENTS).first()
    assert (row["subject_id"], row["gender"], row["dob"].year, row["dod"], row["expire_flag"]) == (3, "F", 2001, None, 1)
    with pytest.raises(ValueError, match="no column hadm_id"):
        D.read_delimited(spark, str(tmp_path / "p.csv"), schemas.ADMISSIONS)
    with pytest.raises(ValueError, match="6 columns"):
        D.read_delimited(spark, str(tmp_path / "p.csv"), schemas.PATIENTS, header=False)


def test_registry_passes_key_and_bounds(monkeypatch):
    seen = {}
    monkeypatch.setattr(jdbc, "read_table", lambda spark, url, table, **o: seen.update(url=url, table=table, **o))
    registry.reader("jdbc", key="id", bounds=(1, 9), partitions=3)(None, "jdbc:x#t")
    assert seen == {"url": "jdbc:x", "table": "t", "key": "id", "bounds": (1, 9), "partitions": 3}


def test_owned_tables_go_with_their_block(spark):
    with owned(spark):
        inner = written(spark.range(3), "inner")
        result = inner.agg(F.sum("id")).first()[0]
    assert result == 3
    with pytest.raises(Exception):
        spark.read.parquet(inner.cohortloom_path)
    outside = written(spark.range(2), "outside")
    assert spark.read.parquet(outside.cohortloom_path).count() == 2


def test_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,note\n1,"a\nb, ""c""\n\nd"\n2,NA\n3,"x"\n')
    schema = schemas.columns("id long, note string")
    assert rows(D.read_delimited(spark, str(tmp_path / "t.csv"), schema, multi_line=True)) == [(1, 'a\nb, "c"\n\nd'), (2, None), (3, "x")]
    (tmp_path / "t.tsv").write_text('1\t"a\nb"\n2\t\\N\n')
    again = D.read_delimited(spark, str(tmp_path / "t.tsv"), schema, header=False, sep="\t", na=D.NA_TOKENS_TSV, multi_line=True)
    assert rows(again) == [(1, "a\nb"), (2, None)]


def test_fixed_width_rejects(spark):
    layout = [("year", 4), ("drop1", 1), ("cause", 3)]
    lines = ["2001 A01", "2002 B1 ", "2003 A", "2004 A01x", "     A01", "2005    ", "", None]
    records, rejects = FW.checked_lines(spark.createDataFrame([(v,) for v in lines], "value string"), layout, ("year", "cause"))
    assert rows(records) == [("2001", "A01"), ("2002", "B1")]
    assert rows(rejects.select("value", "length", F.array_join("reasons", ", ").alias("r"))) == sorted([
        ("2003 A", 6, "too short"), ("2004 A01x", 9, "too long"), ("     A01", 8, "no year"), ("2005    ", 8, "no cause"),
        ("", 0, "too short, no year, no cause"), (None, None, "no line")], key=lambda t: tuple((v is not None, str(v)) for v in t))


def test_mortality_layout_is_as_long_as_a_line():
    assert sum(w for _, w in FW.MORTALITY_LAYOUT) == FW.LINE_LENGTH and set(FW.MUST_FIELDS) <= set(FW.offsets(FW.MORTALITY_LAYOUT))


def test_jdbc_ranges(monkeypatch):
    assert jdbc.range_predicates("k", ["m", "d", "m", "o'x"]) == ["k < 'd' OR k IS NULL", "k >= 'd' AND k < 'm'", "k >= 'm' AND k < 'o''x'", "k >= 'o''x'"]
    assert jdbc.range_predicates("k", []) == ["1 = 1"]
    asked = []

    class Row:
        def __init__(self, row):
            self.row = row

        def head(self):
            return self.row

    def read(spark, url, table, **o):
        asked.append((table, o))
        return Row((3, 90))

    monkeypatch.setattr(jdbc, "read_table", read)
    jdbc.read_ranges(None, "u", "t", "id", 5)
    assert asked == [(jdbc.bounds_query("t", "id"), {}), ("t", {"key": "id", "bounds": (3, 90), "partitions": 5})]
    monkeypatch.setattr(jdbc, "read_table", lambda spark, url, table, **o: asked.append((table, o)) or Row((None, None)))
    jdbc.read_ranges(None, "u", "empty", "id")
    assert asked[-1] == ("empty", {})


ITEMS = "subject_id long, admit_id int, item string, n long"


def test_baskets_are_written_again(spark, tmp_path):
    root, one, two = str(tmp_path), C.CohortSpec("5.2", "5.8"), C.CohortSpec("5.2", "5.9")
    first = spark.createDataFrame([(k, 1, "old", 1) for k in range(40)], ITEMS).repartition(8)
    path, other = (sinks.write_baskets(first, root, s, "mimic", "temporal") for s in (one, two))
    sinks.write_baskets(spark.createDataFrame([(1, 1, "new", 2)], ITEMS), root, one, "mimic", "temporal")
    assert rows(spark.read.text(path)) == [("1,1,new,new",)]
    assert spark.read.text(other).count() == 40
    sinks.write_baskets(spark.createDataFrame([], ITEMS), root, one, "mimic", "temporal")
    assert spark.read.text(path).count() == 0 and spark.read.text(other).count() == 40
    with pytest.raises(ValueError):
        sinks.write_baskets(first, root, one, "mimic", "other")


def test_baskets_with_many_repeats(spark, tmp_path):
    spec = C.CohortSpec("a", "b")
    items = spark.createDataFrame([(1, 1, "ab", 10**6), (1, 1, "c", 2)], ITEMS)
    (line,) = spark.read.text(sinks.write_baskets(items, str(tmp_path), spec, "aeolus", "temporal")).first()
    assert line == "1,1," + "ab," * 10**6 + "c,c"
    huge = spark.createDataFrame([(1, 1, "ab", 3 * 10**9), (1, 1, "c", 1), (2, 5, "d", 7)], ITEMS)
    counted = sinks.write_baskets(huge, str(tmp_path), spec, "aeolus", "counted")
    assert rows(spark.read.text(counted)) == [("1,1,ab,3000000000,c,1",), ("2,5,d,7",)]
    assert rows(sinks.read_counted_baskets(spark, counted)) == [(1, 1, "ab", 3 * 10**9), (1, 1, "c", 1), (2, 5, "d", 7)]
    with pytest.raises(Exception, match="export the baskets with counts"):
        sinks.write_baskets(huge, str(tmp_path), spec, "aeolus", "association")
