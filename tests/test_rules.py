import hashlib
import math
import random

from pyspark.sql import functions as F

from cohortloom.operators import itemsets as I, lattice, rules as R
from helpers import sorted_rows as rows


def txns(spark, baskets):
    return spark.createDataFrame([(b,) for b in baskets], "items array<string>")


def items(spark, baskets):
    data = [(1, v, i) for v, b in enumerate(baskets) for i in b]
    return spark.createDataFrame(data, "subject_id int, admit_id int, item string")


def test_golden(spark):
    got = R.association_rules(txns(spark, [["A", "B"]] * 4 + [["A"], ["C"]]), 0.5, 0.8)
    got = [(r["antecedent"], r["consequent"], round(r["confidence"], 6), round(r["lift"], 6), round(r["support"], 6)) for r in got.collect()]
    assert sorted(got) == [(["A"], ["B"], 0.8, 1.2, 0.666667), (["B"], ["A"], 1.0, 1.2, 0.666667)]


def test_support_rounding(spark):
    baskets = [["A", "B"]] * 7 + [["C"]] * 93
    assert R.association_rules(txns(spark, baskets), 0.07, 0.5).count() == 2
    assert R.association_rules(txns(spark, baskets), 0.08, 0.5).count() == 0


def test_measures(spark):
    baskets = [["a", "b", "c"], ["a", "b"], ["a", "c"], ["b", "c"], ["a", "b", "c"], ["d"]]
    n = len(baskets)

    def supp(s):
        return sum(set(s) <= set(b) for b in baskets) / n

    for r in R.association_rules(txns(spark, baskets), 0.1, 0.1).collect():
        left, right = r["antecedent"], r["consequent"]
        assert left == sorted(left) and len(right) == 1
        assert abs(r["support"] - supp(left + right)) < 1e-9
        assert abs(r["confidence"] - supp(left + right) / supp(left)) < 1e-9
        assert abs(r["lift"] - r["confidence"] / supp(right)) < 1e-9


def test_rule_length(spark):
    baskets = [list("abcd")] * 3
    assert max(len(r["antecedent"]) for r in R.association_rules(txns(spark, baskets), 0.5).collect()) == 3
    assert max(len(r["antecedent"]) for r in R.association_rules(txns(spark, baskets), 0.5, max_items=2).collect()) == 1


def test_bounded_rules_are_those_of_the_full_mining(spark):
    rng = random.Random(2)
    baskets = [[c for c in "abcdefg" if rng.random() < p] for p in [rng.random() for _ in range(150)]] + [[], ["a", "a", "b"]]
    df = txns(spark, [sorted(set(b)) for b in baskets]).repartition(3)

    def flat(rules):
        return sorted((",".join(r["antecedent"]), r["consequent"][0], round(r["confidence"], 9), round(r["lift"], 9), round(r["support"], 9)) for r in rules.collect())

    full = flat(R.association_rules(df, 0.15, 0.5))
    for most in (1, 2, 3, 5, 7, 20):
        assert flat(R.association_rules(df, 0.15, 0.5, max_items=most)) == [r for r in full if r[0].count(",") + 2 <= most]


def test_bounded_sets_at_any_size(spark):
    """One transaction in each of several words of bits, a hot item, nulls and repeats."""
    baskets = [["h", "x"] for _ in range(130)] + [["h", None, "h"] for _ in range(200)] + [None, []]
    sets, n = I.frequent_sets(txns(spark, baskets).repartition(5), 0.3, 4)
    assert n == 332 and rows(sets.select(F.array_join("items", ",").alias("i"), "hits")) == [("h", 330), ("h,x", 130), ("x", 130)]
    sets, n = I.frequent_sets(txns(spark, []), 0.3, 4)
    assert n == 0 and sets.count() == 0


def test_twelve_items_stop_at_ten(spark):
    sets, _ = I.frequent_sets(txns(spark, [list("abcdefghijkl")] * 3), 1.0, 10)
    sizes = {r["k"]: r["count"] for r in sets.groupBy(F.size("items").alias("k")).count().collect()}
    assert sizes == {k: math.comb(12, k) for k in range(1, 11)}


def test_empty(spark):
    assert R.association_rules(txns(spark, []), 0.5).count() == 0
    assert R.rule_clusters(R.association_rules(txns(spark, []), 0.5)).count() == 0


def test_transactions_drop_repeats(spark):
    got = R.transactions(items(spark, [["a", "a", "b"]])).select(F.array_sort("items").alias("i"))
    assert rows(got) == [(["a", "b"],)]


def test_item_frequency(spark):
    got = R.item_frequency(items(spark, [["a", "b", "b"], ["a"], ["a", "c"], ["d"]]), 0.25, 2)
    assert [tuple(r) for r in got.collect()] == [("a", 3, 0.75), ("b", 1, 0.25)]
    assert rows(R.item_frequency(items(spark, [["a"], ["b"], ["a"]]), 0.5), "item") == [("a",)]


def test_top_and_graph(spark):
    rules = R.association_rules(txns(spark, [["A", "B"]] * 4 + [["A"], ["C"]]), 0.5, 0.8)
    best = R.top_rules(rules, "confidence", 1)
    assert rows(best.select(F.array_join("antecedent", ",").alias("a"))) == [("B",)]
    nodes, edges = R.rule_graph(best)
    assert rows(nodes, "node", "kind") == [("A", "item"), ("B", "item"), ("{B} => {A}", "rule")]
    assert rows(edges) == [("B", "{B} => {A}"), ("{B} => {A}", "A")]


def test_clusters(spark):
    rules = R.association_rules(txns(spark, [["A", "B"]] * 4 + [["C", "D"]] * 3 + [["A"], ["C", "E"]]), 0.1, 0.3)
    for k in (1, 2, 50):
        got = R.rule_clusters(rules, k).collect()
        assert len({r["cluster"] for r in got}) <= k
        assert sum(r["n_antecedents"] for r in got) == rules.count()


def brute_clusters(rules, k, rounds):
    points, rights = {}, sorted({r["consequent"][0] for r in rules})
    for r in rules:
        points.setdefault(",".join(r["antecedent"]), dict.fromkeys(rights, 0))[r["consequent"][0]] = round((r["lift"] - 1) * R.LIFT_UNITS)
    first = sorted(points, key=lambda lhs: (hashlib.sha256(lhs.encode()).hexdigest(), lhs))[:k]
    centres = [dict(points[lhs]) for lhs in first]

    def near(p):
        return min((sum((p[r] - c[r]) ** 2 for r in rights), i) for i, c in enumerate(centres))[1]

    for _ in range(rounds):
        groups = {}
        for p in points.values():
            groups.setdefault(near(p), []).append(p)
        centres = [{r: sum(p[r] for p in groups[i]) // len(groups[i]) for r in rights} if i in groups else c for i, c in enumerate(centres)]
    return {lhs: near(p) for lhs, p in points.items()}


def test_clusters_do_not_follow_partitions(spark):
    rng = random.Random(6)
    baskets = [[c for c in "abcdef" if rng.random() < rng.choice((0.3, 0.8))] for _ in range(60)]
    rules = R.association_rules(txns(spark, baskets), 0.05, 0.2)
    stored = rules.collect()
    back = spark.createDataFrame(stored, rules.schema)
    for k, rounds, partitions in ((1, 2, (3,)), (4, 0, (1,)), (4, 10, (1, 7)), (1000, 1, (2,))):
        expected = {}
        for lhs, cluster in brute_clusters(stored, k, rounds).items():
            for r in stored:
                if ",".join(r["antecedent"]) == lhs:
                    expected.setdefault((cluster, r["consequent"][0]), []).append(r["lift"])
        for parts in partitions:
            got = R.rule_clusters(back.repartition(parts), k, rounds).collect()
            assert {(r["cluster"], r["consequent"]): (r["n_antecedents"], round(r["lift"], 9)) for r in got} == {key: (len(v), round(sum(v) / len(v), 9)) for key, v in expected.items()}


def test_nothing_is_written_for_a_set_and_transactions(spark, monkeypatch):
    sizes, write = {}, I.written

    def noted(df, name, *rest):
        table = write(df, name, *rest)
        sizes[name] = table.count()
        return table

    monkeypatch.setattr(I, "written", noted)
    sets, n = I.frequent_sets(txns(spark, [list("abcdef")] * 300), 0.5, 6)
    assert n == 300 and sorted(r["hits"] for r in sets.collect()) == [300] * 63
    assert max(k for name, k in sizes.items() if name not in ("transactions", "held")) <= 20


def test_sets_in_several_passes(spark, monkeypatch):
    rng = random.Random(9)
    df = txns(spark, [[c for c in "abcdefg" if rng.random() < 0.7] for _ in range(150)]).repartition(3)
    want = rows(I.frequent_sets(df, 0.1, 5)[0].select(F.array_join("items", ",").alias("i"), "hits"))
    monkeypatch.setattr(lattice, "BATCH", 4)
    assert rows(I.frequent_sets(df, 0.1, 5)[0].select(F.array_join("items", ",").alias("i"), "hits")) == want
