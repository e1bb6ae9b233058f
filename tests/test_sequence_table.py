import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from cohortloom.operators import sequence_table as T
from helpers import sorted_rows as rows

FLAGS = ["consec", "non_consec", "embed_consec", "embed_non_consec"]
SEQUENCES = ["5.2", "5.2 => 5.8", "5.2 => 5.8 => 7.1", "5.2 => 5.8 => 5.2", "5.2 => 5.2 => 5.8", "5.2 => 5.2.1 => 7.1",
             "5.2 => 7.1 => 5.2.1", "10 => 7.1"]


def table(spark, sequences, support=0.5):
    df = spark.createDataFrame([(s, support) for s in sequences], "sequence string, support double")
    return df.withColumn("states", F.split("sequence", " => "))


def test_golden_flags(spark):
    expected = {
        "5.2": (0, 0, 0, 0), "5.2 => 5.8": (0, 0, 0, 0), "5.2 => 5.8 => 7.1": (0, 0, 0, 0), "5.2 => 5.8 => 5.2": (0, 1, 0, 0),
        "5.2 => 5.2 => 5.8": (1, 0, 0, 0), "5.2 => 5.2.1 => 7.1": (0, 0, 1, 0), "5.2 => 7.1 => 5.2.1": (0, 0, 0, 1),
        "10 => 7.1": (0, 0, 0, 0),
    }
    t = table(spark, SEQUENCES)
    documented = {r["sequence"]: tuple(r[f] for f in FLAGS) for r in T.with_flags(t).collect()}
    padded = {r["sequence"]: tuple(r[f] for f in FLAGS) for r in T.with_flags(t, documented=False).collect()}
    assert documented == expected
    assert padded == {**expected, "10 => 7.1": (0, 0, 0, 1)}


def padded_by_hand(states, n):
    """The padded rules written out row by row."""
    c = dict(enumerate([*states, *["0"] * (n - len(states))], 1))
    inside = lambda i, j: bool(re.search(c[j], c[i]) or re.search(c[i], c[j]))
    near = [(i, i + 1) for i in range(1, n)]
    far = [(i, j) for i, j in combinations(range(1, n + 1), 2) if j - i > 1]
    consec = any(c[i] == c[j] != "0" for i, j in near)
    non = any(c[i] == c[j] for i, j in far if not (n == 4 and (i, j) == (1, 4)))
    embed = any(inside(i, j) and c[i] != c[j] for i, j in near)

    def far_inside(i, j):
        if n == 7 and (i, j) == (3, 7):
            return bool(re.search(c[7], c[3])) and c[3] != c[7]
        if n == 7 and (i, j) == (2, 7):
            return inside(2, 7) and c[2] != c[6]
        return inside(i, j) and c[i] != c[j]

    return (int(consec), int(non and not consec), int(embed), int(any(far_inside(i, j) for i, j in far) and not embed))


@pytest.mark.parametrize("n", range(2, 9))
def test_padded_flags_for_every_width(spark, n):
    pool = ["1", "13", "7", "20", "5.2", "5x2", "8", "1"]
    sequences = [pool[:n], pool[:1], pool[: n - 1], pool[::-1][:n], [*pool[1:n], "13"], ["9"] * n, ["4", "6", "8", "4"][:n],
                 ["2", "7", "13", "4", "5", "6", "3"][:n], ["2", "71", "3", "4", "5", "6", "7"][:n], ["2", "7", "3", "4", "5", "7", "71"][:n]]
    t = table(spark, sorted({" => ".join(s) for s in sequences}))
    got = {r["sequence"]: tuple(r[f] for f in FLAGS) for r in T.with_flags(t, documented=False).collect()}
    assert got == {s: padded_by_hand(s.split(" => "), n) for s in got}


def test_golden_repeat_filter(spark):
    t = table(spark, SEQUENCES)
    kept = {"5.2 => 5.8", "5.2 => 5.8 => 7.1", "5.2 => 5.2.1 => 7.1", "5.2 => 7.1 => 5.2.1", "10 => 7.1"}
    assert {r["sequence"] for r in T.without_repeats(t).collect()} == kept
    assert {r["sequence"] for r in T.without_repeats(t, documented=False).collect()} == kept
    longer = table(spark, ["a => b", "a => b => c", "a => b => c => d"])
    assert T.without_repeats(longer).count() == 3
    assert {r["sequence"] for r in T.without_repeats(longer, documented=False).collect()} == {"a => b => c", "a => b => c => d"}
    two = table(spark, ["a", "a => b", "a => a"])
    assert {r["sequence"] for r in T.without_repeats(two, documented=False).collect()} == {"a", "a => b"}


def test_nine_states_keep_all(spark):
    t = T.with_length(table(spark, [" => ".join("abcdefghi"), "a => b"]))
    row = T.widened(t).filter("length > 2").first()
    assert row["length"] == 9 and row["c_8"] == "h" and row["c_9"] == "i"
    assert "c_9" not in T.widened(t, width=8).columns


def test_repeats_beyond_eight_states(spark):
    letters = "abcdefgh"
    t = table(spark, [" => ".join(letters + "a"), " => ".join(letters + "i"), " => ".join(letters + "hh"), " => ".join([*letters, "i", "ix"])])
    flags = {r["sequence"]: (r["consec"], r["non_consec"], r["embed_consec"], r["embed_non_consec"]) for r in T.with_flags(t).collect()}
    assert list(flags.values()) == [(0, 1, 0, 0), (0, 0, 0, 0), (1, 0, 0, 0), (0, 0, 1, 0)]
    assert T.without_repeats(t).count() == 2


def test_render_item_sets(spark):
    df = spark.createDataFrame([([["b", "a"], ["c"]], 0.5)], "states array<array<string>>, support double")
    t = T.as_table(df)
    assert t.first()["sequence"] == "a | b => c"
    assert T.single_item_sequences(t).count() == 0


def test_describe(spark):
    mapping = spark.createDataFrame(
        [("1", "x1", "Mood"), ("2", "x2", "Unclassified"), ("3", "x3", "Asthma"), ("3", "x4", "Any Mood")],
        "ccs2_code string, icd_code string, ccs2_desc string",
    )
    t = T.describe(table(spark, ["1 => 3", "1 => 9", "2 => 1"]), mapping, "ccs2")
    assert rows(t.select("sequence", F.array_join("states", "/", "?").alias("d"))) == [
        ("1 => 3", "Mood/Any Mood"), ("1 => 3", "Mood/Asthma"), ("1 => 9", "Mood/?"), ("2 => 1", "Unclassified/Mood")]
    kept = T.drop_unclassified(t)
    assert {r["sequence"] for r in kept.collect()} == {"1 => 3", "1 => 9"}


def test_describe_many_combinations(spark):
    """Twelve states of three descriptions: every combination once."""
    mapping = spark.createDataFrame([(str(k), f"d{k}{x}") for k in range(12) for x in "abc"], "ccs2_code string, ccs2_desc string")
    t = T.describe(table(spark, [" => ".join(map(str, range(12))), "3 => 3"]), mapping, "ccs2")
    found = t.groupBy("sequence").agg(F.count("*").alias("n"), F.count_distinct("states").alias("d")).orderBy("n")
    assert [(r["n"], r["d"]) for r in found.collect()] == [(9, 9), (3**12, 3**12)]


def test_search_is_unanchored_and_drops_missing(spark):
    df = spark.createDataFrame(
        [("a", 0.1, ["Any Mood", "x"]), ("b", 0.1, [None, "Mood"]), ("c", 0.1, ["x", "y"])],
        "sequence string, support double, states array<string>",
    )
    assert rows(T.search_first(df, "Mood"), "sequence") == [("a",)]
    assert rows(T.search_first(df, ""), "sequence") == [("a",), ("c",)]
    assert rows(T.search_any(df, "Mood"), "sequence") == [("a",), ("b",)]
    assert T.drop_unclassified(df).count() == 3


def test_golden_links(spark):
    df = spark.createDataFrame(
        [("1", 0.5, ["A", "B", None]), ("2", 0.3, ["A", "B", "C"]), ("3", 0.4, ["D", "B", "C"])],
        "sequence string, support double, states array<string>",
    )
    assert rows(T.links(df)) == [("A (1)", "B (2)", 0.5), ("B (2)", "C (3)", 0.4), ("D (1)", "B (2)", 0.4)]


def test_order(spark):
    df = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.9)], "sequence string, support double")
    assert [r["sequence"] for r in T.ordered(df).collect()] == ["c", "a", "b"]
