"""Flags and tests on the state array of a sequence.

``documented`` behaviour follows what each flag is meant to say, for sequences of any length.  ``padded`` behaviour follows what
a table of fixed width ``n_states`` gives when the empty state cells hold the text "0": pads take
part in comparisons, states are read as regular expressions, and three exceptions for certain widths apply.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

MAX_STATES = 8  # of a padded row
PAD = "0"


def _any(conditions: list[Column]) -> Column:
    return reduce(or_, conditions)


def _pairs(gap_from: int, gap_to: int) -> list[tuple[int, int]]:
    return [
        (i, j)
        for i in range(1, MAX_STATES + 1)
        for j in range(i + 1, MAX_STATES + 1)
        if gap_from <= j - i <= gap_to
    ]


ADJACENT = _pairs(1, 1)
DISTANT = _pairs(2, MAX_STATES)


def padded(states: Column) -> Column:
    """The first eight states, filled up with pads."""
    kept = F.slice(states, 1, MAX_STATES)
    return F.concat(kept, F.array_repeat(F.lit(PAD), F.lit(MAX_STATES) - F.size(kept)))


def length(states: Column) -> Column:
    return F.size(states)


def _exists_pair(states: Column, least_gap: int, test: Callable[[Column, Column], Column], adjacent: bool = False) -> Column:
    """Does ``test`` hold for two states at least ``least_gap`` apart (exactly one apart if ``adjacent``)?"""

    def later(i: Column) -> Column:
        first = F.get(states, i)
        if adjacent:
            return F.coalesce(test(first, F.get(states, i + 1)), F.lit(False))
        rest = F.slice(states, i + F.lit(least_gap + 1), F.size(states))
        return F.exists(rest, lambda other: F.coalesce(test(first, other), F.lit(False)))

    return F.when(F.size(states) > least_gap, F.exists(F.sequence(F.lit(0), F.size(states) - F.lit(least_gap + 1)), later)).otherwise(F.lit(False))


def documented_flags(states: Column) -> dict[str, Column]:
    def same(a: Column, b: Column) -> Column:
        return a == b

    def inside(a: Column, b: Column) -> Column:
        return (a != b) & (a.contains(b) | b.contains(a))

    consec = _exists_pair(states, 1, same, adjacent=True)
    embed = _exists_pair(states, 1, inside, adjacent=True)
    return {
        "consec": consec.cast("int"),
        "non_consec": (~consec & _exists_pair(states, 2, same)).cast("int"),
        "embed_consec": embed.cast("int"),
        "embed_non_consec": (~embed & _exists_pair(states, 2, inside)).cast("int"),
    }


def padded_flags(states: Column, n_states: Column) -> dict[str, Column]:
    cells = padded(states)

    def at(i: int) -> Column:
        return F.get(cells, F.lit(i - 1))

    def found(i: int, j: int) -> Column:
        """State j, read as a pattern, occurs in state i."""
        return F.regexp_like(at(i), at(j))

    def repeat(i: int, j: int) -> Column:
        return (n_states >= j) & (at(i) == at(j)) & (at(i) != PAD)

    def same(i: int, j: int) -> Column:
        # in tables of four states, pair (1, 4) is not looked at
        skipped = (n_states == 4) & F.lit((i, j) == (1, 4))
        return (n_states >= j) & ~skipped & (at(i) == at(j))

    def inside(i: int, j: int) -> Column:
        either = found(i, j) | found(j, i)
        differ = at(i) != at(j)
        # two exceptions of tables with seven states
        if (i, j) == (3, 7):
            either = F.when(n_states == 7, found(3, 7)).otherwise(either)
        if (i, j) == (2, 7):
            differ = F.when(n_states == 7, at(2) != at(6)).otherwise(differ)
        return F.when(n_states >= j, either & differ).otherwise(F.lit(False))

    consec = _any([repeat(i, j) for i, j in ADJACENT])
    embed = _any([inside(i, j) for i, j in ADJACENT])
    return {
        "consec": consec.cast("int"),
        "non_consec": (~consec & _any([same(i, j) for i, j in DISTANT])).cast("int"),
        "embed_consec": embed.cast("int"),
        "embed_non_consec": (~embed & _any([inside(i, j) for i, j in DISTANT])).cast("int"),
    }


def all_different(states: Column) -> Column:
    """At least two states and no state twice."""
    return (F.size(states) >= 2) & (F.size(F.array_distinct(states)) == F.size(states))


def all_different_padded(states: Column, n_states: Column) -> Column:
    """No cell twice when the row is filled up to ``n_states`` cells."""
    cells = F.slice(padded(states), F.lit(1), n_states)
    return F.size(F.array_distinct(cells)) == F.size(cells)


def any_state_matches(states: Column, pattern: str) -> Column:
    return F.exists(states, lambda s: F.coalesce(s.rlike(pattern), F.lit(False)))


def first_state_matches(states: Column, pattern: str) -> Column:
    return F.coalesce(F.get(states, F.lit(0)).rlike(pattern), F.lit(False))
