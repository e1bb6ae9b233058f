"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

Every document is repeated k times, k drawn from a Poisson distribution whose mean is the target repetition rate of
its source.  The draw inverts the distribution at a number hashed from the seed and the document id, so it needs no
random state, and a lost task draws the same again.  A large mean is the sum of several draws of a mean of at most
``MEAN_PART``, which is the same distribution and keeps ``exp(-mean)`` away from zero.

Defined results: a null source is a source of its own; a source with weight 0 or, when weights are given, without one
is left out; rows that share a doc_id share their draw; a null doc_id is drawn by its text; empty tables stay empty;
texts are never looked into; further columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortloom.session import written

MEAN_PART = 32.0
TERMS = 160  # of the cumulative distribution; beyond 160 a mean of 32 has less than 2 ** -52 left


def _uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of a hash."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def _cumulative(mean: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson variable."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k.cast("double")
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step)["c"]


def repetition_rates(docs: DataFrame, weights: dict | None = None, rows: float | None = None) -> DataFrame:
    """One row per source: its target mean, split in equal parts, and the cumulative distribution of a part.

    ``weights`` maps sources to target shares of the rows (any positive scale); without it every source gets the same.
    ``rows`` is the expected size of the mixture, by default that of the input.
    """
    spark = docs.sparkSession
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.lit(1.0))
    else:
        given = spark.createDataFrame([(s, float(w)) for s, w in weights.items()], "s string, weight double")
        sizes = sizes.join(given, F.col("source").eqNullSafe(F.col("s"))).drop("s").where("weight > 0")
    sizes = written(sizes, "mix_sizes")
    total = sizes.agg(F.sum("weight").alias("weights"), F.sum("n").alias("rows")).first()  # two numbers
    if not total["rows"]:
        total = {"weights": 1.0, "rows": 0}
    rate = F.col("weight") / F.lit(float(total["weights"])) * F.lit(float(total["rows"] if rows is None else rows)) / F.col("n")
    return (
        sizes.withColumn("rate", rate)
        .withColumn("parts", F.greatest(F.ceil(F.col("rate") / MEAN_PART), F.lit(1)).cast("int"))
        .withColumn("cdf", _cumulative(F.col("rate") / F.col("parts")))
        .select(F.col("source").alias("_source"), F.col("rate").alias("_rate"), F.col("parts").alias("_parts"), F.col("cdf").alias("_cdf"))
    )


def _drawn(docs: DataFrame, weights: dict | None, rows: float | None, seed: int) -> DataFrame:
    """``row`` (a struct of the document), ``copy`` (from 1) and ``shuffle_key`` of every copy drawn.

    The rates are one small row per source, written so that their size is known: the planner broadcasts them only when
    they are small and otherwise joins by shuffle, where adaptive execution splits a source that holds most rows.
    """
    rates = written(repetition_rates(docs, weights, rows), "mix_rates")
    who = F.coalesce(F.col("row.doc_id").cast("string"), F.md5(F.coalesce("row.text", F.lit("")).cast("binary")))
    draws = F.transform(
        F.sequence(F.lit(1), F.col("_parts")),
        lambda part: F.size(F.filter("_cdf", lambda c: c <= _uniform(seed, part, F.col("who")))),
    )
    return (
        docs.select(F.struct(*docs.columns).alias("row")).withColumn("who", who)
        .join(rates, F.col("row.source").eqNullSafe(F.col("_source")))
        .withColumn("times", F.aggregate(draws, F.lit(0), lambda a, b: a + b))
        .where("times > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
        .withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(str(seed)), "who", F.col("copy").cast("string")).cast("binary")))
        .select("row", "copy", "shuffle_key")
    )


def mix(docs: DataFrame, weights: dict | None = None, rows: float | None = None, seed: int = 17) -> DataFrame:
    """The documents, each as often as drawn, in globally shuffled order."""
    return _drawn(docs, weights, rows, seed).orderBy("shuffle_key").select("row.*")


def mixture_report(docs: DataFrame, weights: dict | None = None, rows: float | None = None, seed: int = 17) -> DataFrame:
    """The same with the number of the copy and the key of the order."""
    known = docs.select("doc_id", "text", "lang", "source", "n_chars")
    return _drawn(known, weights, rows, seed).orderBy("shuffle_key").select("row.*", "copy", "shuffle_key")


#: The same mixture with equal weights and the default seed.
ORACLE_SQL = f"""
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
total AS (SELECT sum(1.0::DOUBLE) AS weights, sum(n) AS rows FROM sizes),
rates AS (SELECT source, 1.0::DOUBLE / weights * rows / n AS rate FROM sizes, total),
means AS (SELECT source, greatest(ceil(rate / {MEAN_PART}), 1)::INT AS parts, rate / greatest(ceil(rate / {MEAN_PART}), 1) AS mean FROM rates),
cdf AS (SELECT source, parts, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM means
        UNION ALL SELECT source, parts, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM cdf WHERE k < {TERMS}),
tables AS (SELECT source, parts, list(c ORDER BY k) AS cs FROM cdf GROUP BY source, parts),
who AS (SELECT d.*, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS w, row_number() OVER () AS r FROM documents d),
draws AS (SELECT who.*, t.cs, unnest(range(1, t.parts + 1)) AS part FROM who JOIN tables t ON who.source IS NOT DISTINCT FROM t.source),
times AS (SELECT r, doc_id, text, lang, source, n_chars, w, sum(len(list_filter(cs, lambda c: c <=
            ('0x' || substr(md5('17|' || part || '|' || w), 1, 13))::BIGINT / {float(2**52)!r}::DOUBLE))) AS n FROM draws GROUP BY ALL),
copies AS (SELECT *, unnest(range(1, n::BIGINT + 1)) AS copy FROM times)
SELECT doc_id, text, lang, source, n_chars, copy::INT AS copy, md5('17|' || w || '|' || copy) AS shuffle_key FROM copies
"""
