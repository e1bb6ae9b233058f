"""Suffix-array dedup of bytes, by two-stage sorting.

A byte is removed where a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller doc_id.
No suffix array of a whole corpus fits a task, so strings that may be equal are brought together first:

1. The least hash of the ``GRAM``-byte grams in a string (its minimizer) depends on the string alone.  Neighbouring
   strings with the same minimizer form a piece.  Every block sends its different minimizers to buckets and learns which of them
   other blocks have too; nearly all text ends here.
2. Pieces with a shared minimizer go to the minimizer's bucket as text, each different piece of a block once, with the
   smallest doc_id that holds it.  All strings that can be equal now are in one bucket.
3. A bucket builds the suffix array of its different pieces: it sorts only the suffixes smaller than their successors, induces
   the rest by bucket scans, and takes common prefixes of neighbours.  Runs of neighbours that share ``LENGTH`` bytes
   are the equal strings; their smallest doc_id decides.
4. Every block learns, one bit per string of its pieces, whether a smaller doc_id elsewhere has it, and cuts its texts.

Pieces are sent once per block, so a passage that stands in every document is one row per block.

Defined results: null text is empty; matches never cross documents; null doc_ids come after all others and remove
nothing from each other; rows that share a doc_id neither; texts shorter than ``LENGTH`` bytes stay; empty tables give
empty results.  ``drop_repeats`` returns texts: a character stays if none of its bytes is removed; other columns stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from cohortloom.llm import blocks as B
from cohortloom.llm.hashing import bucket_bounds, byte_hash, merged, mix, sliding_min, window_hash
from cohortloom.session import written

LENGTH, GRAM = 50, 24
_STEP = 1 << 18


# ---------------------------------------------------------------- suffix array


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number; zeros beyond the end."""
    x = np.append(text, np.zeros(7, np.uint8)).astype(np.uint64)
    for size in (1, 2, 4):
        x = (x[:-size] << np.uint64(8 * size)) | x[size:]
    return x


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of all suffixes of a byte string, sorted by their first ``depth`` bytes at least."""
    n = len(text)
    t = text.astype(np.int16)
    after = np.append(t[1:], np.int16(-1))
    differs = np.where(t != after, np.arange(n), n)
    decides = np.minimum.accumulate(differs[::-1])[::-1]
    greater = (t > after)[decides]  # than the next suffix

    # the suffixes smaller than their successors, by eight bytes at a time
    words = np.append(_words(text), np.zeros(depth, np.uint64))
    places = np.flatnonzero(~greater)
    places = places[np.argsort(words[places], kind="stable")]
    slots = np.arange(len(places))
    group = np.zeros(len(places), np.int64)
    for at in range(0, depth, 8):
        key = words[places[slots] + at]
        if at:
            order = np.lexsort((key, group))
            places[slots] = places[slots][order]
            key = key[order]
        new = np.append(True, (key[1:] != key[:-1]) | (group[1:] != group[:-1]))[: len(key)]
        group = np.cumsum(new)
        tied = np.bincount(group, minlength=1)[group] > 1
        slots, group = slots[tied], group[tied]
        if not len(slots):
            break

    # the others come first among the suffixes of a first byte, in the order of their successors
    sorted_, rank = np.empty(n, np.int64), np.full(n + 1, -1, np.int64)
    counts = np.bincount(text, minlength=256)
    begins = np.cumsum(counts) - counts
    small = np.bincount(text[places], minlength=256)
    small_ends = np.cumsum(small)
    for c in np.flatnonzero(small):
        to = begins[c] + counts[c]
        sorted_[to - small[c] : to] = places[small_ends[c] - small[c] : small_ends[c]]
        rank[sorted_[to - small[c] : to]] = np.arange(to - small[c], to)
    rest = np.flatnonzero(greater)
    rest = rest[np.argsort(text[rest], kind="stable")]
    large = counts - small
    large_ends = np.cumsum(large)
    for c in np.flatnonzero(large):
        bucket = rest[large_ends[c] - large[c] : large_ends[c]]
        level = bucket[after[bucket] < c]
        level = level[np.argsort(rank[level + 1])]
        at = begins[c]
        while len(level):
            sorted_[at : at + len(level)] = level
            rank[level] = np.arange(at, at + len(level))
            at += len(level)
            level = level[level > 0] - 1  # a run of one byte: each suffix puts the one before it in place
            level = level[text[level] == c]
    return sorted_


def common_prefixes(words: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Bytes, up to ``most``, that each suffix of ``order`` shares with the one before it."""
    out = np.zeros(len(order), np.int64)
    same = np.arange(1, len(order))
    for at in range(0, most, 8):
        a, b = words[order[same - 1] + at], words[order[same] + at]
        x = a ^ b
        equal = np.full(len(x), 8)
        left = x != 0
        equal[left] = sum((x[left] < np.uint64(1 << (64 - 8 * k))).astype(np.int64) for k in range(1, 8))
        out[same] += equal
        same = same[~left]
    return np.minimum(out, most)


# ---------------------------------------------------------------- pieces of a block


class _Pieces:
    """Runs of strings with one minimizer: ``starts`` to ``stops`` (first and beyond the last place of a string)."""

    def __init__(self, table: pa.Table):
        self.texts, self.ids = B.texts(table), B.doc_ids(table)
        self.data = b"".join(self.texts)
        data = np.frombuffer(self.data, np.uint8)
        self.ends = np.cumsum([len(t) for t in self.texts], dtype=np.int64)
        valid = np.ones(len(data) + 1, bool)
        for end, size in zip(self.ends.tolist(), map(len, self.texts)):
            valid[end - min(size, LENGTH - 1) : end] = False
        valid[-1] = False
        starts, stops, keys = [], [], []
        for at in range(0, max(0, len(data) - LENGTH + 1), _STEP):
            part = data[at : at + _STEP + LENGTH - 1]
            low = sliding_min(window_hash(byte_hash(part), GRAM), LENGTH - GRAM + 1)
            ok = valid[at : at + len(low)]
            change = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (ok[1:] != ok[:-1])))
            to = np.append(change[1:], len(low))
            use = ok[change]
            starts.append(at + change[use])
            stops.append(at + to[use])
            keys.append(low[change[use]])
        empty = np.empty(0, np.int64)
        self.starts, self.stops = (np.concatenate([empty, *x]) for x in (starts, stops))
        self.keys = mix(np.concatenate([np.empty(0, np.uint64), *keys]))  # least hashes are small; buckets go by size
        self.doc = np.searchsorted(self.ends, self.starts, "right")
        self.different, self.which = np.unique(self.keys, return_inverse=True)


class _Shared:
    """The different pieces of a block whose minimizer stands in two documents, ordered by bucket."""

    def __init__(self, p: _Pieces, buckets: int, answers: B.Answers):
        known = B.key_bits(p.different, buckets, answers)
        low, high = np.full(len(known), B.NO_ID), np.full(len(known), -B.NO_ID)
        ids = p.ids[p.doc]
        np.minimum.at(low, p.which, ids)
        np.maximum.at(high, p.which, ids)
        runs = np.flatnonzero((known | (low != high))[p.which])
        runs = runs[np.argsort(p.which[runs], kind="stable")]  # by minimizer, and so by bucket
        self.runs, self.ids = runs, ids[runs]
        seen: dict[bytes, int] = {}
        data = p.data
        self.which = np.array(
            [seen.setdefault(data[a : b + LENGTH - 1], len(seen)) for a, b in zip(p.starts[runs].tolist(), p.stops[runs].tolist())], np.int64
        )
        self.pieces = list(seen)
        self.sizes = np.array([len(x) - LENGTH + 1 for x in self.pieces], np.int64)
        self.low = np.full(len(seen), B.NO_ID)
        np.minimum.at(self.low, self.which, self.ids)
        first = np.full(len(seen), len(p.keys))
        np.minimum.at(first, self.which, runs)
        upper = (p.keys[first] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32) if len(seen) else np.empty(0, np.uint64)
        self.bounds = np.searchsorted(upper, np.arange(buckets + 1, dtype=np.uint64))


def _pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(3).compress(data)


def _unpack(data: pa.Scalar) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data.as_py())


def _meet(rows: pa.Table) -> pa.Table:
    """Equal strings among the pieces of a bucket: one bit per string, does a smaller doc_id elsewhere have it?"""
    lens = [np.frombuffer(_unpack(x), "<u4").astype(np.int64) for x in rows.column("lens")]
    ids = np.concatenate([np.frombuffer(_unpack(x), "<i8") for x in rows.column("ids")])
    index: dict[bytes, int] = {}
    which = []
    for data, sizes in zip((_unpack(x) for x in rows.column("data")), lens):
        ends = np.cumsum(sizes).tolist()
        which += [index.setdefault(data[e - n : e], len(index)) for e, n in zip(ends, sizes.tolist())]
    which = np.array(which, np.int64)
    low = np.full(len(index), B.NO_ID)
    np.minimum.at(low, which, ids)

    pieces = list(index)
    sizes = np.array([len(x) for x in pieces], np.int64)
    text = np.frombuffer(b"".join(pieces), np.uint8)
    begins = np.cumsum(sizes) - sizes
    strings = sizes - LENGTH + 1
    piece = np.repeat(np.arange(len(pieces)), strings)
    base = np.cumsum(strings) - strings
    place = begins[piece] + np.arange(len(piece)) - base[piece]
    number = np.full(len(text), -1, np.int64)
    number[place] = np.arange(len(place))
    order = suffix_array(text, LENGTH)
    order = order[number[order] >= 0]
    shared = common_prefixes(np.append(_words(text), np.zeros(LENGTH, np.uint64)), order, LENGTH) >= LENGTH
    first = np.flatnonzero(~shared)
    in_order = low[piece[number[order]]]
    least = np.empty(len(place), np.int64)
    least[number[order]] = np.repeat(np.minimum.reduceat(in_order, first), np.diff(np.append(first, len(order))))

    ends, bits = np.cumsum([len(x) for x in lens]), []
    for end, part in zip(ends.tolist(), lens):
        mine = which[end - len(part) : end]
        n = strings[mine]
        at = np.repeat(base[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        bits.append(np.packbits(least[at] < np.repeat(ids[end - len(part) : end], n)).tobytes())
    return pa.table({"block": rows.column("block"), "bucket": rows.column("bucket"), "data": pa.array(bits, pa.binary())})


def _removed(blocks: B.Blocks, fn, schema) -> DataFrame:
    """Run ``fn(table, pieces, runs)`` on each block; ``runs`` has the removed runs, as (start, stop), of each document."""
    buckets = blocks.buckets

    def ask(block: int, table: pa.Table, _) -> Iterator[pa.RecordBatch]:
        yield from B.key_rows(block, _Pieces(table).different, buckets)

    def send(block: int, table: pa.Table, answers) -> Iterator[pa.RecordBatch]:
        s = _Shared(_Pieces(table), buckets, answers[0])
        used = np.flatnonzero(np.diff(s.bounds))
        cut = [slice(s.bounds[b], s.bounds[b + 1]) for b in used]
        sizes = (s.sizes + LENGTH - 1).astype("<u4")
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(np.full(len(used), block), pa.int64()), pa.array([_pack(sizes[c].tobytes()) for c in cut], pa.binary()),
             pa.array([_pack(s.low[c].astype("<i8").tobytes()) for c in cut], pa.binary()), pa.array([_pack(b"".join(s.pieces[c])) for c in cut], pa.binary())],
            names=["bucket", "block", "lens", "ids", "data"],
        )

    def finish(block: int, table: pa.Table, answers) -> Iterator[pa.RecordBatch]:
        p = _Pieces(table)
        s = _Shared(p, buckets, answers[0])
        ends = np.cumsum(s.sizes)
        begins = ends - s.sizes
        smaller = np.zeros(int(ends[-1]) if len(ends) else 0, bool)
        for b, (data,) in answers[1].items():
            a, z = s.bounds[b], s.bounds[b + 1]
            if a < z:
                smaller[begins[a] : ends[z - 1]] = np.unpackbits(np.frombuffer(data, np.uint8), count=ends[z - 1] - begins[a])
        starts, stops = p.starts[s.runs], p.stops[s.runs]
        later = s.ids > s.low[s.which]
        # of the others, the strings marked
        n = np.where(later, 0, s.sizes[s.which])
        run = np.repeat(np.arange(len(n)), n)
        offset = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
        hit = smaller[begins[s.which[run]] + offset]
        single = starts[run[hit]] + offset[hit]
        a = np.concatenate([starts[later], single])
        b = np.concatenate([stops[later] + LENGTH - 1, single + LENGTH])
        doc = np.searchsorted(p.ends, a, "right")
        a, b = merged(a + doc, b + doc)  # a place more per document, so that runs never join across
        doc = np.searchsorted(p.ends + np.arange(1, len(p.ends) + 1), a, "right")
        runs: list[list[tuple[int, int]]] = [[] for _ in p.texts]
        base = p.ends - np.array([len(t) for t in p.texts], np.int64)
        for d, x, y in zip(doc.tolist(), a.tolist(), b.tolist()):
            runs[d].append((x - d - int(base[d]), y - d - int(base[d])))
        yield from fn(table, p, runs)

    shared = written(blocks.meet(blocks.map(ask, B.KEYS), B.shared_keys, B.BITS), "suffixes_shared")
    sent = blocks.map(send, "bucket int, block long, lens binary, ids binary, data binary", shared)
    smaller = blocks.meet(sent, _meet, B.BITS)
    return blocks.map(finish, schema, shared, smaller)


def _kept(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for run in runs for x in run), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def repeat_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""

    def report(table: pa.Table, p: _Pieces, runs) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays(
            [table.column("doc_id").combine_chunks().cast(pa.int64()), pa.array([len(t) for t in p.texts], pa.int64()),
             pa.array([sum(b - a for a, b in r) for r in runs], pa.int64()), pa.array([len(r) for r in runs], pa.int64()),
             pa.array([hashlib.sha256(_kept(t, r)).hexdigest() for t, r in zip(p.texts, runs)], pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return _removed(B.Blocks(docs.select("doc_id", "text")), report, schema)


def drop_repeats(docs: DataFrame) -> DataFrame:
    """The documents without the repeated strings."""

    def cut(table: pa.Table, p: _Pieces, runs) -> Iterator[pa.RecordBatch]:
        at = table.schema.get_field_index("text")
        was = table.column(at).to_pylist()
        now = [_kept(t, _whole_characters(t, r)).decode() if r else x for t, r, x in zip(p.texts, runs, was)]
        yield from table.set_column(at, table.schema.field(at), pa.array(now, table.schema.field(at).type)).combine_chunks().to_batches()

    return _removed(B.Blocks(docs), cut, docs.schema)


def _whole_characters(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs widened to whole UTF-8 characters; those that now overlap become one."""
    out: list[tuple[int, int]] = []
    for a, b in runs:
        while a > 0 and text[a] & 0xC0 == 0x80:
            a -= 1
        while b < len(text) and text[b] & 0xC0 == 0x80:
            b += 1
        if out and a <= out[-1][1]:
            a = out.pop()[0]
        out.append((a, b))
    return out
