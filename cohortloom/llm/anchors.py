"""Substring dedup of words by difference-cover anchors.

A window of ``WINDOW`` words is removed where its words also stand in a document with a smaller doc_id.  Anchors are
hashes of ``ANCHOR`` words at the positions whose remainder modulo ``PERIOD`` is in ``COVER``.  COVER is a difference
cover: for any two positions there is a shift below PERIOD that brings both into it, so two equal windows always hold
an anchor at the same place.  Steps:

1. every block sends its different anchors to buckets and learns which others have too;
2. windows around such an anchor are extended to their full length: their 96-bit hash goes out with the smallest
   doc_id of the block that holds it;
3. every block learns, one bit per window, whether a smaller doc_id elsewhere has it, and removes words.

Equal windows of a block are sent once, so frequent passages stay small and no pairs are formed.

Defined results: null text has no words; null doc_ids come after all others and never remove each other's words;
rows that share a doc_id don't either; texts of fewer than 13 words stay; empty tables give empty results; in
``drop_repeats`` a changed text is its kept words joined by one space, other texts and further columns stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cohortloom.llm import blocks as B
from cohortloom.llm.hashing import bucket_bounds, from_six_bytes, merged, six_bytes, window_hash, word_hashes
from cohortloom.session import written

WINDOW, PERIOD = 13, 7
COVER = (1, 2, 4)  # every remainder modulo 7 is a difference of two of these
ANCHOR = WINDOW - PERIOD + 1


class _Words:
    """Word hashes of a block with the places of windows and anchors."""

    def __init__(self, table: pa.Table):
        self.texts, self.ids = B.texts(table), B.doc_ids(table)
        self.words, self.counts = word_hashes(self.texts)
        n = len(self.words)
        ends = np.cumsum(self.counts)
        self.begins = ends - self.counts
        self.doc = np.repeat(np.arange(len(self.texts), dtype=np.int32), self.counts)
        place = np.arange(n) - np.repeat(self.begins, self.counts)
        left = np.repeat(self.counts, self.counts) - place  # words from here to the end of the text
        self.window = left >= WINDOW
        long = np.repeat(self.counts >= WINDOW, self.counts)
        self.anchor_at = np.flatnonzero((left >= ANCHOR) & long & np.isin(place % PERIOD, COVER))
        self.anchors = window_hash(self.words, ANCHOR)[self.anchor_at]
        self.different, self.which = np.unique(self.anchors, return_inverse=True)


def _smallest(groups: np.ndarray, n: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low, high = np.full(n, B.NO_ID), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(low, groups, ids)
    np.maximum.at(high, groups, ids)
    return low, high


class _Windows:
    """The different windows of a block that hold an anchor found in two documents, and where they stand."""

    def __init__(self, w: _Words, buckets: int, answers: B.Answers):
        known = B.key_bits(w.different, buckets, answers)
        low, high = _smallest(w.which, len(known), w.ids[w.doc[w.anchor_at]])
        known |= low != high
        near = np.zeros(len(w.words) + 1, np.int32)  # windows that hold a shared anchor, by differences
        at = w.anchor_at[known[w.which]]
        np.add.at(near, np.maximum(at - PERIOD + 1, w.begins[w.doc[at]]), 1)
        np.add.at(near, at + 1, -1)
        self.at = np.flatnonzero((np.cumsum(near)[:-1] > 0) & w.window)
        first = window_hash(w.words, WINDOW)[self.at]
        second = (window_hash(w.words, WINDOW, 0xD6E8FEB86659FD93)[self.at] >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
        self.which = np.empty(len(a), np.int64)
        self.which[order] = np.cumsum(new) - 1
        self.keys, self.more = a[new], b[new]
        self.ids = w.ids[w.doc[self.at]]
        self.low, _ = _smallest(self.which, len(self.keys), self.ids)


def _meet(rows: pa.Table) -> pa.Table:
    """One bit per window sent: does a smaller doc_id elsewhere have it?"""
    data = [from_six_bytes(d.as_py()) for d in rows.column("data")]
    keys = np.concatenate(data)
    more = np.concatenate([np.frombuffer(d.as_py(), "<u4") for d in rows.column("more")])
    ids = np.concatenate([np.frombuffer(d.as_py(), "<i8") for d in rows.column("ids")])
    order = np.lexsort((more, keys))
    k, m = keys[order], more[order]
    first = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (m[1:] != m[:-1])))
    low = np.minimum.reduceat(ids[order], first)
    smaller = np.empty(len(keys), bool)
    smaller[order] = np.repeat(low, np.diff(np.append(first, len(k)))) < ids[order]
    ends = np.cumsum([len(d) for d in data])
    bits = [np.packbits(smaller[e - len(d) : e]).tobytes() for d, e in zip(data, ends)]
    return pa.table({"block": rows.column("block"), "bucket": rows.column("bucket"), "data": pa.array(bits, pa.binary())})


def _removed(blocks: B.Blocks, fn, schema) -> DataFrame:
    """Run ``fn(table, words, starts, stops)`` on each block, with the removed runs of words."""
    buckets = blocks.buckets

    def ask(block: int, table: pa.Table, _) -> Iterator[pa.RecordBatch]:
        yield from B.key_rows(block, _Words(table).different, buckets)

    def extend(block: int, table: pa.Table, answers) -> Iterator[pa.RecordBatch]:
        found = _Windows(_Words(table), buckets, answers[0])
        bounds = bucket_bounds(found.keys, buckets)
        used = np.flatnonzero(np.diff(bounds))
        cut = [slice(bounds[b], bounds[b + 1]) for b in used]
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(np.full(len(used), block), pa.int64()), pa.array([six_bytes(found.keys[c]) for c in cut], pa.binary()),
             pa.array([found.more[c].astype("<u4").tobytes() for c in cut], pa.binary()), pa.array([found.low[c].astype("<i8").tobytes() for c in cut], pa.binary())],
            names=["bucket", "block", "data", "more", "ids"],
        )

    def finish(block: int, table: pa.Table, answers) -> Iterator[pa.RecordBatch]:
        w = _Words(table)
        found = _Windows(w, buckets, answers[0])
        smaller = B.key_bits(found.keys, buckets, answers[1])
        gone = found.at[smaller[found.which] | (found.ids > found.low[found.which])]
        yield from fn(table, w, *merged(gone, gone + WINDOW))

    shared = written(blocks.meet(blocks.map(ask, B.KEYS), B.shared_keys, B.BITS), "anchors_shared")
    sent = blocks.map(extend, "bucket int, block long, data binary, more binary, ids binary", shared)
    smaller = blocks.meet(sent, _meet, B.BITS)
    return blocks.map(finish, schema, shared, smaller)


def _kept_words(w: _Words, doc: int, gone: list[tuple[int, int]]) -> list[bytes]:
    words, base = w.texts[doc].split(), w.begins[doc]
    for a, b in reversed(gone):
        del words[a - base : b - base]
    return words


def _by_doc(w: _Words, starts: np.ndarray, stops: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """Removed runs of each document; a run that touches one of the next document is cut there."""
    out: dict[int, list[tuple[int, int]]] = {}
    for a, b in zip(starts.tolist(), stops.tolist()):
        while a < b:
            doc = int(w.doc[a])
            end = min(b, int(w.begins[doc] + w.counts[doc]))
            out.setdefault(doc, []).append((a, end))
            a = end
    return out


def repeat_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""

    def report(table: pa.Table, w: _Words, starts, stops) -> Iterator[pa.RecordBatch]:
        gone = _by_doc(w, starts, stops)
        kept = [b" ".join(_kept_words(w, d, gone.get(d, []))) for d in range(len(w.texts))]
        yield pa.RecordBatch.from_arrays(
            [table.column("doc_id").combine_chunks().cast(pa.int64()), pa.array(w.counts), pa.array([sum(b - a for a, b in gone.get(d, [])) for d in range(len(w.texts))], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])],
            names=["doc_id", "n_words", "n_removed", "kept_sha256"],
        )

    return _removed(B.Blocks(docs.select("doc_id", "text")), report, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def drop_repeats(docs: DataFrame) -> DataFrame:
    """The documents without the repeated windows."""

    def cut(table: pa.Table, w: _Words, starts, stops) -> Iterator[pa.RecordBatch]:
        gone = _by_doc(w, starts, stops)
        at = table.schema.get_field_index("text")
        was = table.column(at).to_pylist()
        now = [b" ".join(_kept_words(w, d, gone[d])).decode() if d in gone else was[d] for d in range(len(was))]
        yield from table.set_column(at, table.schema.field(at), pa.array(now, table.schema.field(at).type)).combine_chunks().to_batches()

    return _removed(B.Blocks(docs), cut, docs.schema)
