"""A study: one source, one cohort, and every result that can be asked of it."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from cohortloom.functions.levels import level
from cohortloom.operators import cohort as C
from cohortloom.operators import explore, hierarchy
from cohortloom.operators import rules as R, sequence_table as T, sequences as Q
from cohortloom.session import tune, written
from cohortloom.sources import sinks
from cohortloom.sources.registry import Source


class Study:
    """Results are built on demand; choosing the cohort and mining run jobs of their own."""

    def __init__(self, source: Source, spec: C.CohortSpec):
        tune(source.visits.sparkSession)
        self.source = source
        self.spec = spec

    @cached_property
    def members(self) -> DataFrame:
        s = self.source
        return C.membership(s.selection_rows(), s.mapping, self.spec, s.selection_key)

    @cached_property
    def subjects(self) -> DataFrame:
        """The cohort, written once: every result reads it, and its known size lets Spark look it
        up at the scan when it is small and after pre-aggregation when it is not."""
        chosen = C.cohort_plus(self.members) if self.spec.with_second else C.cohort_minus(self.members)
        return written(chosen, "cohort")

    @cached_property
    def coded(self) -> DataFrame:
        s = self.source
        attach = hierarchy.with_hierarchy_or_sentinel if s.keep_unmapped else hierarchy.with_hierarchy
        return attach(s.visits, s.mapping)

    def unique_codes(self) -> DataFrame:
        return C.unique_codes(self.coded, self.subjects)

    def demographics(self, order: list[str]) -> DataFrame:
        return C.demographics(self.source.demographics, self.subjects, order)

    def temporal_items(self) -> DataFrame:
        return C.temporal_items(self.coded, self.subjects, self.spec.mining_level)

    def association_items(self) -> DataFrame:
        return C.association_items(self.coded, self.subjects, self.spec.mining_level)

    def condition_rows(self, n: int = 20) -> DataFrame:
        s = self.source
        return explore.condition_rows(s.visits, s.mapping, self.spec.mining_level, n, sentinel=self._sentinel())

    def condition_patients(self, n: int = 20) -> DataFrame:
        s = self.source
        return explore.condition_patients(
            s.visits, s.mapping, self.subjects, self.spec.mining_level, n, sentinel=self._sentinel()
        )

    def _sentinel(self) -> str | None:
        return str(hierarchy.SENTINEL) if self.source.keep_unmapped else None

    def mined_sequences(
        self, support: float = Q.DEFAULT_SUPPORT, max_elements: int | None = None
    ) -> DataFrame:
        items = C.items(self.coded, self.subjects, level(self.spec.mining_level).code)
        if not self.source.dense_visits:
            items = Q.renumber_visits(items)
        return T.as_table(Q.frequent_sequences(items, support, max_elements))

    def sequences(
        self,
        support: float = Q.DEFAULT_SUPPORT,
        starts_with: str = "",
        contains: str = "",
        max_elements: int | None = None,
        documented: bool = True,
    ) -> DataFrame:
        """The sequence table: mined, flagged, without repeats, described and searched."""
        table = T.with_length(self.mined_sequences(support, max_elements))
        table = T.with_flags(table, documented)
        table = T.without_repeats(table, documented)
        table = T.describe(table, self.source.mapping, self.spec.mining_level)
        table = T.drop_unclassified(table)
        return T.ordered(T.search_any(T.search_first(table, starts_with), contains))

    def links(self, **choices) -> DataFrame:
        """State-to-state links of the sequence table with the same choices."""
        return T.links(self.sequences(**choices))

    def export_baskets(self, root: str, kind: str = "temporal") -> str:
        """Write the cohort's baskets as text, ``temporal`` or ``association``; returns the folder."""
        items = self.temporal_items() if kind == "temporal" else self.association_items()
        return sinks.write_baskets(items, root, self.spec, self.source.name, kind)

    def rules(
        self, support: float = R.DEFAULT_SUPPORT, confidence: float = R.DEFAULT_CONFIDENCE, max_items: int | None = None
    ) -> DataFrame:
        return R.association_rules(R.transactions(self.rule_items()), support, confidence, max_items)

    def top_rules(self, by: str = "lift", n: int = 10, **thresholds) -> DataFrame:
        return R.top_rules(self.rules(**thresholds), by, n)

    def rule_clusters(self, k: int = 10, **thresholds) -> DataFrame:
        return R.rule_clusters(self.rules(**thresholds), k)

    def rule_graph(self, by: str = "lift", n: int = 10, **thresholds) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges of the best rules."""
        return R.rule_graph(written(self.top_rules(by, n, **thresholds), "top_rules"))

    def item_frequency(self, support: float = R.DEFAULT_SUPPORT, top: int = 10) -> DataFrame:
        return R.item_frequency(self.rule_items(), support, top)

    def rule_items(self) -> DataFrame:
        return C.items(self.coded, self.subjects, level(self.spec.mining_level).desc)
