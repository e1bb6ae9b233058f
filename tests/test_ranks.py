from pyspark.sql import Window, functions as F

from cohortloom.operators import ranks
from helpers import sorted_rows as rows


def test_dense_rank_within_matches_window(spark):
    # subject 0 owns a third of the rows, spread over many buckets, with ties and gaps
    df = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("subject_id"),
        ((F.col("id") * 7919) % 2500).alias("t"), "id",
    )
    got = ranks.dense_rank_within(df, ["subject_id"], "t", "rank", F.floor(F.col("t") / 100))
    want = df.withColumn("rank", F.dense_rank().over(Window.partitionBy("subject_id").orderBy("t")))
    assert rows(got, "id", "rank") == rows(want, "id", "rank")


def test_dense_rank_within_keeps_missing(spark):
    df = spark.createDataFrame([(1, 5), (1, None), (1, 5), (1, 9)], "subject_id int, t int")
    got = ranks.dense_rank_within(df, ["subject_id"], "t", "rank", F.lit(0))
    assert rows(got, "t", "rank") == [(None, None), (5, 1), (5, 1), (9, 2)]


def test_dense_rank_all_matches_window(spark):
    df = spark.range(5000).select("id", ((F.col("id") * 104729) % 3001 - 1500).alias("v"))
    got = ranks.dense_rank_all(df, "v", "rank", ranges=16)
    want = df.withColumn("rank", F.dense_rank().over(Window.orderBy("v")))
    assert rows(got, "id", "rank") == rows(want, "id", "rank")


def test_dense_rank_all_one_value(spark):
    df = spark.createDataFrame([(4.5,), (4.5,), (None,)], "v double")
    assert rows(ranks.dense_rank_all(df, "v", "rank")) == [(None, None), (4.5, 1), (4.5, 1)]


def test_top_with_ties(spark):
    df = spark.createDataFrame([("a", 5), ("b", 4), ("c", 4), ("d", 3)], "k string, count int")
    assert rows(ranks.top_with_ties(df, "count", 2), "k") == [("a",), ("b",), ("c",)]
    assert ranks.top_with_ties(df.filter("count > 9"), "count", 2).count() == 0


def test_first_per_key(spark):
    df = spark.createDataFrame([(1, 3, "x"), (1, 2, "z"), (1, 2, "y"), (2, 9, None)], "k int, t int, v string")
    assert rows(ranks.first_per_key(df, ["k"], ["t"])) == [(1, 2, "y"), (2, 9, None)]


def test_row_ids_are_dense(spark):
    df = spark.range(1000).repartition(7).withColumnRenamed("id", "x")
    ids = [r[0] for r in ranks.with_row_ids(df, "ID").select("ID").collect()]
    assert sorted(ids) == list(range(1, 1001))


def test_ordinal_by_first_appearance(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), ("c", 4)], "icd_chp string, row int")
    assert rows(ranks.ordinal_by_first_appearance(df, "icd_chp", "row", "n")) == [("a", "2"), ("b", "1"), ("c", "3")]


def test_dense_rank_all_of_nothing(spark):
    empty = spark.createDataFrame([], "v double")
    assert ranks.dense_rank_all(empty, "v", "rank").count() == 0
    nulls = spark.createDataFrame([(None,), (None,)], "v double")
    assert rows(ranks.dense_rank_all(nulls, "v", "rank")) == [(None, None), (None, None)]
