"""Frequent item sets of bounded size, counted level by level over transactions (Agrawal & Srikant 1994).

Transactions are packed once into blocks.  A task spreads an item of a block over words of 64 transactions, one bit each, and counts a batch
of candidates depth first: the words of a set are those of the set without its last item and of that item, with the common bits kept (Zaki
2000).  A task sends one number for a candidate; no row stands for a set and transactions.  Pairs are counted as they come, so that only pairs that
occur are candidates.  Others are counted only if all their subsets are frequent.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from cohortloom.operators.lattice import BLOCK, CACHE_BYTES, block_of, counted, walk
from cohortloom.operators.sequences import min_count
from cohortloom.session import forget, small_batches, written


def _candidates(found: DataFrame, size: int) -> DataFrame:
    """(id, last, number, path, items): sets of one item more, of two sets (``id`` the first) of ``size`` items that share all but the last,
    if every subset with one item less is frequent."""
    left = found.select("parent", "id", F.col("items").alias("_items"), F.col("path").alias("_path"), F.col("last").alias("_own"))
    joined = left.join(found.select("parent", "last", "number"), "parent").filter("_own < last").select(
        "id", "last", "number", F.concat("_path", F.array("number")).alias("path"), F.concat("_items", F.array("last")).alias("items"))
    # without one of the first items; without one of the last two the set is a parent, which is frequent
    subsets = F.transform(F.sequence(F.lit(0), F.lit(size - 2)), lambda i: F.filter("items", lambda x, j: j != i))
    checked = joined.withColumn("_subset", F.explode(subsets)).join(found.select(F.col("items").alias("_subset")), "_subset")
    return checked.groupBy(*joined.columns).agg(F.count("*").alias("_n")).filter(F.col("_n") == size - 1).drop("_n")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block for each batch of transactions ``held array<long>``."""
    for batch in batches:
        if batch.num_rows:
            item = batch.column(0).flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(0)).to_numpy())
            yield block_of([(batch.num_rows, item, row, np.zeros((len(item), 0), np.int64))], 0)


class _Transactions:
    """A block, and the words of its items, kept as far as they fit."""

    def __init__(self, block: dict):
        self.size = -(-block["subjects"] // 64) * 64
        self.items, self.starts = np.frombuffer(block["items"], "<i8"), np.frombuffer(block["starts"], "<i8")
        self.rows = np.frombuffer(block["rows"], "<i4")
        self._spread: dict[int, np.ndarray] = {}

    def of(self, item: int) -> np.ndarray:
        if item not in self._spread:
            if len(self._spread) * self.size // 8 > CACHE_BYTES:
                self._spread.clear()
            held, k = np.zeros(self.size, bool), int(np.searchsorted(self.items, item))
            if k < len(self.items) and self.items[k] == item:
                held[self.rows[self.starts[k] : self.starts[k + 1]]] = True
            self._spread[item] = np.packbits(held).view(np.uint64)
        return self._spread[item]

    def everything(self) -> tuple[np.ndarray]:
        """The empty set, which is in every transaction."""
        return (np.full(self.size // 64, ~np.uint64(0)),)

    def grown(self, node: tuple[np.ndarray], item: int) -> tuple[np.ndarray]:
        words = node[0] & self.of(item)
        return (words if words.any() else words[:0],)

    def count(self, node: tuple[np.ndarray], item: int) -> int:
        return int(np.bitwise_count(node[0] & self.of(item)).sum(dtype=np.int64))


def _counter(block: dict, paths: np.ndarray) -> np.ndarray:
    txns = _Transactions(block)
    return walk(paths, txns.everything(), txns.grown, txns.count)


def frequent_sets(txns: DataFrame, support: float, max_items: int) -> tuple[DataFrame, int]:
    """Sets of up to ``max_items`` items in enough transactions ``items array<string>``: (items sorted, hits), and the number of transactions.

    Null items are left out, repeated ones count once, empty transactions count as transactions.
    """
    stored = written(txns.select(F.monotonically_increasing_id().alias("_txn"), F.array_compact(F.array_distinct("items")).alias("items")), "transactions")
    n = stored.count()
    least = min_count(support, n)
    single = stored.select("_txn", F.explode("items").alias("last"))
    counts = single.groupBy("last").agg(F.count("*").alias("hits")).filter(F.col("hits") >= least)
    counts = counts.withColumn("number", F.monotonically_increasing_id())
    found = written(counts.select(F.col("number").alias("id"), F.lit(-1).cast("long").alias("parent"), "last", "number", F.array("number").alias("path"), F.array("last").alias("items"), "hits"), "sets_1")
    results = [found]
    held = single.join(found.select("last", "id"), "last").groupBy("_txn").agg(F.array_sort(F.collect_list(F.struct("last", "id"))).alias("held"))
    held = written(held.select("held"), "held")
    forget(stored)
    with small_batches(stored.sparkSession):
        blocks = written(held.select("held.id").mapInArrow(_packed, BLOCK), "set_blocks")
    for size in range(1, max_items):
        if size == 1:  # the pairs of each transaction, which are few beside all pairs of items
            first = held.select("held", F.posexplode("held").alias("_at", "_one"))
            pairs = first.select("_one.id", F.explode(F.slice("held", F.col("_at") + 2, F.size("held"))).alias("_two")).select("id", F.col("_two.id").alias("number"))
            pairs = pairs.groupBy("id", "number").agg(F.count("*").alias("hits")).filter(F.col("hits") >= least)
            ones = found.select("id", F.col("items").alias("_items"), F.col("path").alias("_path"))
            grown = [pairs.join(ones, "id").join(found.select("number", "last"), "number").select(
                F.monotonically_increasing_id().alias("cand"), "id", "last", "number", F.concat("_path", F.array("number")).alias("path"),
                F.concat("_items", F.array("last")).alias("items"), "hits")]
        else:
            candidates = written(_candidates(found, size).withColumn("cand", F.monotonically_increasing_id()), "set_candidates")
            hits = counted(blocks, candidates, size + 1, _counter)
            grown = (h.withColumnRenamed("count", "hits").filter(F.col("hits") >= least).join(candidates, "cand") for h in hits)
        with small_batches(stored.sparkSession):
            sets = [written(g.withColumnRenamed("id", "parent").withColumnRenamed("cand", "id"), f"sets_{size + 1}") for g in grown]
        forget(held if size == 1 else candidates)
        sets = [g for g in sets if not g.isEmpty()]
        if not sets:
            break
        found = reduce(DataFrame.unionByName, sets)
        results.append(found)
    forget(blocks)
    return reduce(DataFrame.unionByName, [r.select("items", "hits") for r in results]), n


def rules_of(sets: DataFrame, n: int, confidence: float) -> DataFrame:
    """Rules with one item on the right from frequent sets and their hits; every subset of a set is there too."""
    sets = written(sets, "frequent_sets")
    whole = sets.filter(F.size("items") >= 2).withColumn("consequent", F.explode("items")).select(
        F.expr("array_remove(items, consequent)").alias("antecedent"), "consequent", "hits")
    lefts = sets.select(F.col("items").alias("antecedent"), F.col("hits").alias("_left"))
    rights = sets.filter(F.size("items") == 1).select(F.get("items", F.lit(0)).alias("consequent"), F.col("hits").alias("_right"))
    share = F.col("hits") / F.col("_left")
    kept = whole.join(lefts, "antecedent").filter(share >= confidence - 1e-9).join(rights, "consequent")
    return kept.select(
        F.array_sort("antecedent").alias("antecedent"), F.array("consequent").alias("consequent"), share.alias("confidence"),
        (share / (F.col("_right") / F.lit(n))).alias("lift"), (F.col("hits") / F.lit(n)).alias("support"),
    )
