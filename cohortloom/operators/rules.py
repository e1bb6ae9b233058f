"""Association rules between the items of a visit."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, functions as F

from cohortloom.operators.itemsets import frequent_sets, rules_of
from cohortloom.operators.sequences import min_count
from cohortloom.session import written

DEFAULT_SUPPORT = 0.1
DEFAULT_CONFIDENCE = 0.8
STATISTICS = ("lift", "confidence", "support")
LIFT_UNITS = 1_000_000


def transactions(items: DataFrame) -> DataFrame:
    """One row per visit with its distinct items, at most as many as the level has codes."""
    return items.groupBy("subject_id", "admit_id").agg(F.collect_set("item").alias("items"))


def association_rules(
    txns: DataFrame,
    support: float = DEFAULT_SUPPORT,
    confidence: float = DEFAULT_CONFIDENCE,
    max_items: int | None = None,
) -> DataFrame:
    """Rules ``antecedent ⇒ consequent`` with one item on the right and at least one on the left.

    Thresholds are inclusive and free of rounding noise; arrays are sorted.  With ``max_items`` (both sides together) sets
    are counted level by level up to that size and never beyond; without it they are mined to the end.
    """
    if max_items is not None:
        return rules_of(*frequent_sets(txns, support, max_items), confidence)
    stored = written(txns.select("items"), "transactions")  # the miner reads them twice
    n = stored.count()
    if n == 0:
        return stored.sparkSession.createDataFrame(
            [], "antecedent array<string>, consequent array<string>, confidence double, lift double, support double"
        )
    # half a transaction below the wanted count, so that no rounding can lift the threshold above it
    model = FPGrowth(
        itemsCol="items",
        minSupport=(min_count(support, n) - 0.5) / n,
        minConfidence=max(0.0, confidence - 1e-9),
    ).fit(stored)
    return model.associationRules.select(
        F.array_sort("antecedent").alias("antecedent"), "consequent", "confidence", "lift", "support"
    )


def item_frequency(items: DataFrame, support: float = DEFAULT_SUPPORT, top: int = 10) -> DataFrame:
    """Share of visits each item occurs in, for items reaching ``support``: the ``top`` largest."""
    visits = written(transactions(items), "transactions")
    n = visits.count()
    counts = visits.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("count"))
    shares = counts.withColumn("frequency", F.col("count") / n)
    return shares.filter(F.round("frequency", 9) >= support).orderBy(F.desc("frequency"), "item").limit(top)


def top_rules(rules: DataFrame, by: str = "lift", n: int = 10) -> DataFrame:
    """The ``n`` rules with the largest statistic, ties cut in a fixed order."""
    if by not in STATISTICS:
        raise ValueError(f"choose a statistic out of {STATISTICS}")
    return rules.orderBy(F.desc(F.round(by, 9)), F.array_join("antecedent", ","), F.array_join("consequent", ",")).limit(n)


def rule_sides(rules: DataFrame) -> DataFrame:
    """What the rules of each right side come to: a check of the clusters that needs none."""
    return rules.groupBy(F.element_at("consequent", 1).alias("consequent")).agg(
        F.count("*").alias("n_antecedents"), *[F.avg(s).alias(s) for s in STATISTICS]
    )


def lift_table(rules: DataFrame) -> DataFrame:
    """(antecedent, consequent, lift) of every left and right side, 1 where there is no rule.

    The right sides are single frequent items, so the table is the rules' left sides times a few.
    """
    flat = written(
        rules.select(F.array_join("antecedent", ",").alias("antecedent"), F.element_at("consequent", 1).alias("consequent"), "lift"),
        "flat_rules",
    )
    sides = flat.agg(F.array_sort(F.collect_set("consequent")).alias("sides"))
    lefts = flat.select("antecedent").distinct().withColumn("consequent", F.explode(sides.scalar()))
    return lefts.join(flat, ["antecedent", "consequent"], "left").select("antecedent", "consequent", F.coalesce("lift", F.lit(1.0)).alias("lift"))


def rule_clusters(rules: DataFrame, k: int = 10, rounds: int = 10) -> DataFrame:
    """Left sides clustered by their lift towards every right side, then collapsed per right side.

    K-means in whole numbers: a coordinate is the lift's distance from the neutral 1 in millionths, 0 where there is no
    rule, so only the rules themselves are rows.  The k left sides whose names have the smallest SHA-256 are the first centres;
    equal distances go to the smaller cluster number; a centre becomes the mean of its members, rounded down, and stays if it has
    none.  It ends after ``rounds`` or when no centre moves.  The result does not depend on the partitioning.
    """
    flat = rules.select(F.array_join("antecedent", ",").alias("lhs"), F.element_at("consequent", 1).alias("rhs"),
                        "support", "confidence", "lift")
    flat = written(flat, "flat_rules")
    whole = F.round((F.col("lift") - 1) * LIFT_UNITS).cast("decimal(18,0)")
    points = flat.select("lhs", "rhs", whole.alias("u"))
    first = points.select("lhs").distinct().orderBy(F.sha2("lhs", 256), "lhs").limit(k).collect()  # k names
    spark = flat.sparkSession
    names = spark.createDataFrame([(r["lhs"], i) for i, r in enumerate(first)], "lhs string, cluster int")
    centres = written(points.join(names, "lhs").filter("u <> 0").select("cluster", "rhs", F.col("u").alias("c")), "rule_centres")
    state, assigned = None, None
    for turn in range(rounds + 1):
        norms = {r["cluster"]: r["s"] for r in centres.groupBy("cluster").agg(F.sum(F.col("c") * F.col("c")).alias("s")).collect()}  # k numbers
        sizes = F.array(*[F.lit(int(norms.get(i, 0))).cast("decimal(38,0)") for i in range(max(k, 1))][: max(len(first), 1)])
        dots = points.join(centres, "rhs").groupBy("lhs", "cluster").agg(F.sum(F.col("u") * F.col("c")).alias("dot"))
        near = dots.groupBy("lhs").agg(F.map_from_entries(F.collect_list(F.struct("cluster", "dot"))).alias("_dots"))  # k entries
        left = points.select("lhs").distinct().join(near, "lhs", "left")
        distances = F.transform(sizes, lambda s, i: F.struct((s - 2 * F.coalesce(F.try_element_at("_dots", i), F.lit(0).cast("decimal(38,0)"))).cast("decimal(38,0)").alias("d"), i.alias("i")))
        assigned = written(left.select("lhs", F.array_min(distances)["i"].alias("cluster")), "rule_clusters")
        if turn == rounds:
            break
        members = assigned.groupBy("cluster").agg(F.count("*").cast("decimal(18,0)").alias("n"))
        sums = points.join(assigned, "lhs").groupBy("cluster", "rhs").agg(F.sum("u").alias("s")).join(members, "cluster")
        means = sums.select("cluster", "rhs", F.floor(F.col("s") / F.col("n")).alias("_about"), "s", "n")
        # the quotient of decimals is rounded, so the whole number next to it is put right by multiplication
        exact = F.col("_about") - F.when(F.col("_about") * F.col("n") > F.col("s"), 1).otherwise(0)
        means = means.select("cluster", "rhs", exact.cast("decimal(18,0)").alias("c")).filter("c <> 0")
        centres = written(means.unionByName(centres.join(members, "cluster", "left_anti")), "rule_centres")
        now = centres.agg(F.count("*"), F.sum(F.xxhash64("cluster", "rhs", "c").cast("decimal(38,0)"))).head()
        if now == state:
            break
        state = now
    return (
        flat.join(assigned, "lhs")
        .groupBy("cluster", F.col("rhs").alias("consequent"))
        .agg(
            F.count("*").alias("n_antecedents"),
            F.avg("support").alias("support"),
            F.avg("confidence").alias("confidence"),
            F.avg("lift").alias("lift"),
        )
    )


def rule_graph(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables: items point to their rule, a rule points to its right side."""
    name = F.concat(F.lit("{"), F.array_join("antecedent", ","), F.lit("} => {"), F.array_join("consequent", ","), F.lit("}"))
    named = rules.withColumn("rule", name)
    edges = named.select(F.explode("antecedent").alias("source"), F.col("rule").alias("target")).unionByName(
        named.select(F.col("rule").alias("source"), F.explode("consequent").alias("target"))
    )
    items = named.select(F.explode(F.concat("antecedent", "consequent")).alias("node")).distinct()
    empty = F.lit(None).cast("double")
    nodes = items.select(
        "node", F.lit("item").alias("kind"), *[empty.alias(s) for s in STATISTICS]
    ).unionByName(named.select(F.col("rule").alias("node"), F.lit("rule").alias("kind"), *STATISTICS))
    return nodes, edges
