"""From mined sequences to the table, searches and links shown to a user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortloom.functions import patterns as P
from cohortloom.functions.levels import level

UNCLASSIFIED = "[Uu]nclassified"  # fixed value: descriptions left out of the table
ELEMENT_SEP, STATE_SEP = " | ", " => "  # fixed values: rendering of a sequence

STEP = 4096  # combinations of descriptions numbered together


def as_table(mined: DataFrame) -> DataFrame:
    """``(sequence, support, states)`` with states as text.

    Items of one visit are joined by '|', visits by '=>'.  Accepts states that are single items or
    item sets.
    """
    nested = dict(mined.dtypes)["states"] == "array<array<string>>"
    states = (
        F.transform("states", lambda s: F.array_join(F.array_sort(s), ELEMENT_SEP)) if nested else F.col("states")
    )
    return mined.select(F.array_join(states, STATE_SEP).alias("sequence"), "support", states.alias("states"))


def ordered(table: DataFrame) -> DataFrame:
    return table.orderBy(F.desc("support"), "sequence")


def with_length(table: DataFrame) -> DataFrame:
    return table.withColumn("length", P.length(F.col("states")))


def n_states(table: DataFrame) -> DataFrame:
    """One row: the number of state columns of a padded table, that of the longest sequence but at most eight."""
    return table.agg(F.least(F.max(F.size("states")), F.lit(P.MAX_STATES)).alias("n_states"))


def with_flags(table: DataFrame, documented: bool = True) -> DataFrame:
    """Add the four repeat flags."""
    if documented:
        return table.withColumns(P.documented_flags(F.col("states")))
    return (
        table.withColumn("_n", n_states(table).scalar())
        .withColumns(P.padded_flags(F.col("states"), F.col("_n")))
        .drop("_n")
    )


def single_item_sequences(table: DataFrame) -> DataFrame:
    """Drop sequences with more than one item in some visit."""
    return table.filter(~F.col("sequence").contains("|"))


def without_repeats(table: DataFrame, documented: bool = True) -> DataFrame:
    """Drop sequences of one state and sequences in which a state repeats.

    Otherwise (not ``documented``) the test is made on rows padded to the longest sequence of
    ``table``, where two pads count as a repeat.
    """
    if documented:
        return table.filter(P.all_different(F.col("states")))
    return (
        table.withColumn("_n", n_states(table).scalar())
        .filter(P.all_different_padded(F.col("states"), F.col("_n")))
        .drop("_n")
    )


def describe(table: DataFrame, mapping: DataFrame, mining_level: str) -> DataFrame:
    """Replace the code of every state by its description, null where there is none.

    One join for all positions.  A code with several descriptions gives one row for each, as a join
    per position would.  The combinations of a sequence are numbered, in steps of ``STEP``, and a number's digits, in a system with
    the number of descriptions of each position as base, pick the descriptions; no cell holds all combinations.
    """
    lv = level(mining_level)
    names = mapping.groupBy(F.col(lv.code).cast("string").alias("_code")).agg(
        F.array_sort(F.collect_set(F.struct(F.col(lv.desc).alias("d")))).alias("_descs")
    )
    rest = [c for c in table.columns if c != "states"]
    rows = (
        table.select(*rest, F.posexplode("states").alias("_pos", "_code"))
        .join(names, "_code", "left")
        .groupBy(*rest)
        .agg(F.array_sort(F.collect_list(F.struct("_pos", "_descs"))).alias("_cells"))
    )
    unknown = F.array(F.struct(F.lit(None).cast("string").alias("d")))
    cells = rows.select(*rest, F.transform("_cells", lambda c: F.coalesce(c["_descs"], unknown)).alias("_cells"))
    # how many combinations the positions before each have; the last entry is the number of all
    bases = F.aggregate(
        "_cells", F.array(F.lit(1).cast("long")),
        lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) * F.size(c))),
    )
    based = cells.withColumn("_bases", bases)
    total = F.element_at("_bases", -1)
    steps = based.withColumn("_step", F.explode(F.sequence(F.lit(0).cast("long"), total - 1, F.lit(STEP).cast("long"))))
    each = steps.withColumn("_number", F.explode(F.sequence(F.col("_step"), F.least(F.col("_step") + STEP, total) - 1)))
    picked = F.transform("_cells", lambda c, i: F.get(c, F.floor(F.col("_number") / F.get("_bases", i)).cast("long") % F.size(c))["d"])
    return each.select(*rest, picked.alias("states"))


def drop_unclassified(table: DataFrame) -> DataFrame:
    return table.filter(~P.any_state_matches(F.col("states"), UNCLASSIFIED))


def search_first(table: DataFrame, pattern: str = "") -> DataFrame:
    """Sequences whose first state matches; a search, not anchored to the start."""
    return table.filter(P.first_state_matches(F.col("states"), pattern))


def search_any(table: DataFrame, pattern: str = "") -> DataFrame:
    return table.filter(P.any_state_matches(F.col("states"), pattern))


def links(table: DataFrame) -> DataFrame:
    """State-to-state links with the largest support of any sequence that makes the step.

    Labels carry the position of the state; steps from or to a missing state are left out.
    """
    steps = F.transform(
        F.sequence(F.lit(1), F.size("states") - 1),
        lambda j: F.struct(
            j.alias("pos"), F.get("states", j - 1).alias("from"), F.get("states", j).alias("to")
        ),
    )
    best = (
        table.filter(F.size("states") >= 2)
        .select("support", F.explode(steps).alias("s"))
        .select("support", "s.*")
        .dropna()
        .groupBy("pos", "from", "to")
        .agg(F.max("support").alias("max_support"))
    )

    def tagged(name: str, pos: Column) -> Column:
        return F.concat(F.col(name), F.lit(" ("), pos.cast("string"), F.lit(")")).alias(name)

    return best.select(tagged("from", F.col("pos")), tagged("to", F.col("pos") + 1), "max_support")


def widened(table: DataFrame, width: int | None = None) -> DataFrame:
    """``c_1``, ``c_2``, … instead of the state array, for display and export.

    There are ``width`` columns; without it as many as the longest sequence has states, eight at least.
    """
    if width is None:
        width = max(P.MAX_STATES, table.agg(F.max(F.size("states"))).first()[0] or 0)
    rest = [c for c in table.columns if c not in ("sequence", "support", "states")]
    cells = [F.get("states", F.lit(i)).alias(f"c_{i + 1}") for i in range(width)]
    return table.select("sequence", "support", *cells, *rest)
