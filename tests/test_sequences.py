import random

import pytest
from pyspark.ml.fpm import PrefixSpan
from pyspark.sql import functions as F

from cohortloom.operators import lattice, sequences as Q
from helpers import sorted_rows as rows

# four subjects: visit contents in order
GOLDEN = {1: [["5.2"], ["5.8"], ["7.1"]], 2: [["5.2", "5.8"], ["7.1"]], 3: [["5.2"], ["5.2"], ["5.8"]], 4: [["5.8"], ["5.2"], ["7.1"]]}


def items_of(spark, history):
    data = [(s, v, i) for s, visits in history.items() for v, items in enumerate(visits, 1) for i in items]
    return spark.createDataFrame(data, "subject_id long, admit_id int, item string")


def found(df):
    return {tuple(tuple(s) if isinstance(s, list) else s for s in r["states"]): r["count"] for r in df.collect()}


def random_history(seed, subjects=30, letters="abcd", visits=6):
    rng = random.Random(seed)
    return {
        s: [sorted(rng.sample(letters, rng.randint(1, 3))) for _ in range(rng.randint(1, visits))]
        for s in range(subjects)
    }


def prefix_span(spark, history, support, max_items=8):
    least = Q.min_count(support, len(history))
    db = spark.createDataFrame([(v,) for v in history.values()], "sequence array<array<string>>")
    miner = PrefixSpan(minSupport=(least - 0.5) / len(history), maxPatternLength=max_items)
    return {
        tuple(tuple(sorted(e)) for e in r["sequence"]): r["freq"] for r in miner.findFrequentSequentialPatterns(db).collect()
    }


def test_golden(spark):
    got = found(Q.frequent_sequences(items_of(spark, GOLDEN), 0.5))
    assert got == {("5.2",): 4, ("5.8",): 4, ("7.1",): 3, ("5.2", "7.1"): 3, ("5.8", "7.1"): 3, ("5.2", "5.8"): 2}
    itemsets = found(Q.frequent_itemset_sequences(items_of(spark, GOLDEN), 0.5))
    assert itemsets == {tuple((s,) for s in k): n for k, n in got.items()}


@pytest.mark.parametrize("seed,support", [(1, 0.3), (2, 0.5)])
def test_same_as_prefix_span(spark, seed, support):
    history = random_history(seed)
    every = prefix_span(spark, history, support)
    items = items_of(spark, history)
    single = {tuple(e[0] for e in k): n for k, n in every.items() if all(len(e) == 1 for e in k)}
    assert found(Q.frequent_sequences(items, support, 8)) == {k: n for k, n in single.items() if len(k) <= 8}
    got = found(Q.frequent_itemset_sequences(items, support, 4, 3))
    assert got == {k: n for k, n in every.items() if len(k) <= 4 and all(len(e) <= 3 for e in k)}


def test_chunk_borders(spark, monkeypatch):
    """Positions, occurrences and gaps on both sides of chunk borders, and one very long subject."""
    history = random_history(7, subjects=12, visits=9)
    rng = random.Random(3)
    history[99] = [[rng.choice("ab")] if v % 5 else ["c", "d"] for v in range(60)]
    want = found(Q.frequent_sequences(items_of(spark, history), 0.4, 4))
    monkeypatch.setattr(lattice, "BITS", 2)
    assert found(Q.frequent_sequences(items_of(spark, history), 0.4, 4)) == want
    assert want == {
        tuple(e[0] for e in k): n
        for k, n in prefix_span(spark, history, 0.4, 4).items()
        if all(len(e) == 1 for e in k)
    }


@pytest.mark.parametrize("bits", [1, 2, 63])
def test_itemset_visits_in_several_numbers(spark, monkeypatch, bits):
    """Ends of patterns before, in and after the number that holds the next visit; one subject with a long history."""
    history = random_history(5, subjects=8, letters="abc", visits=7)
    rng = random.Random(4)
    history[99] = [sorted(rng.sample("abc", rng.randint(1, 2))) for _ in range(140)]
    history[98] = [["a", "b"]] * 64
    monkeypatch.setattr(lattice, "BITS", bits)
    got = found(Q.frequent_itemset_sequences(items_of(spark, history), 0.5, 3, 2))
    assert got == {k: n for k, n in prefix_span(spark, history, 0.5, 6).items() if len(k) <= 3 and all(len(e) <= 2 for e in k)}


def test_anti_monotone_and_prefixes(spark):
    got = found(Q.frequent_sequences(items_of(spark, random_history(11)), 0.3))
    for states, n in got.items():
        if len(states) > 1:
            assert got[states[:-1]] >= n and got[states[1:]] >= n


def test_support_rounding(spark):
    history = {s: [["x" if s < 7 else "y"]] for s in range(100)}
    assert found(Q.frequent_sequences(items_of(spark, history), 0.07)) == {("x",): 7, ("y",): 93}
    assert Q.min_count(0.07, 100) == 7 and Q.min_count(0.071, 100) == 8


def test_renumbered_visits(spark):
    sparse = items_of(spark, GOLDEN).withColumn("admit_id", F.col("admit_id") * 100_000 + F.col("subject_id"))
    dense = Q.renumber_visits(sparse)
    assert rows(dense, "subject_id", "admit_id", "item") == rows(items_of(spark, GOLDEN), "subject_id", "admit_id", "item")


def test_nothing_frequent(spark):
    history = {1: [["a"]], 2: [["b"]], 3: [["c"]]}
    assert found(Q.frequent_sequences(items_of(spark, history), 0.5)) == {}
    assert found(Q.frequent_itemset_sequences(items_of(spark, history), 0.5)) == {}


def test_nothing_is_written_for_a_subject_and_a_pattern(spark, monkeypatch):
    sizes, write = {}, lattice.written

    def noted(df, name, *rest):
        table = write(df, name, *rest)
        sizes[name] = table.count()
        return table

    monkeypatch.setattr(lattice, "written", noted)
    got = found(Q.frequent_sequences(items_of(spark, {s: [["a", "b", "c"]] * 6 for s in range(60)}), 0.5, 4))
    assert len(got) == 3 + 9 + 27 + 81 and set(got.values()) == {60}
    assert max(n for name, n in sizes.items() if name != "visit_bits") <= 81


def test_candidates_in_several_passes(spark, monkeypatch):
    history = random_history(6, letters="abc", visits=7)
    history[99] = [["a", "b"], ["c"]] * 50
    want = found(Q.frequent_itemset_sequences(items_of(spark, history), 0.5, 3, 2))
    monkeypatch.setattr(lattice, "BATCH", 4)
    assert found(Q.frequent_itemset_sequences(items_of(spark, history), 0.5, 3, 2)) == want
    assert want == {k: n for k, n in prefix_span(spark, history, 0.5, 6).items() if len(k) <= 3 and all(len(e) <= 2 for e in k)}


def test_a_subject_without_a_name_meets_nothing(spark):
    """It counts as a subject, and its items as single items; rows without a subject are nobody's history."""
    items = items_of(spark, {1: [["a"], ["b"]], 2: [["a"], ["b"]], None: [["a"], ["b"]]})
    assert found(Q.frequent_sequences(items, 0.5)) == {("a",): 3, ("b",): 3, ("a", "b"): 2}
