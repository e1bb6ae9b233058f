"""N-gram Jaccard join with adaptive multi-match prefixes, and the components of its links.

Two documents link when their sets of five-word shingles have a Jaccard similarity of at least 0.75.  The shingles of
a set are ordered from rare to frequent.  If two sets of n and m shingles link, their prefixes of
``n - ceil(0.75 n) + l`` and ``m - ceil(0.75 m) + l`` shingles share at least l of them.  Every document picks its own
l: a longer prefix costs entries and excludes candidates.  A pair is verified if it shares the smaller of both l, and
more where its sizes ask for more (see ``_enough``).

The order comes from a counting table of fixed size (``SLOTS``), filled from all documents, that is sent to the tasks
(16 MB, whatever the input).  Several shingles may share a slot; the order is the same for all documents all the same.

1. Equal sets are one class, found by a 128-bit digest; only the representative goes on.
2. Blocks send their different prefix shingles to buckets and learn which of them others have too (see ``blocks``).
3. Entries (shingle, document) of shared shingles alone become rows.
4. Links are only needed as far as they connect.  So every document is first compared with ``VERIFIED`` of the ``CENTRES`` others of
   each of its shingles that have the least hashes, those it shares most with, in rounds with other hashes, which joins large groups of near
   copies without forming their pairs.  Pairs inside a component are the only ones left out from here on.
5. The rest is counted in slices.  Documents whose most frequent prefix shingle is the same, and whose sizes are alike, are
   dealt out to slices of about ``SLICE_ENTRIES`` entries or ``SLICE_DOCS`` documents; slices that have a shingle in common meet, and a task counts the common prefix
   shingles of all their pairs as a product of two matrices.  Only pairs that share enough become rows, and are verified.

Defined results: letters A-Z are lower-cased; fewer than five words are one shingle; without words, or text, the set
is empty, and nothing links; the smallest doc_id of a component names it, null ids being larger than all others (a
component of null ids only has a null name); repeated rows are copies of each other; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cohortloom.llm import blocks as B
from cohortloom.llm.hashing import mix, window_hash, word_hashes
from cohortloom.session import forget, written

WORDS = 5
PERCENT = 75
SLOT_BITS = 22
SLOTS = 1 << SLOT_BITS
_SLICE = 1 << 16
PART_BYTES = 1 << 20  # of texts whose words are held at a time
MOST_MATCHES = 32
STAR_ROUNDS, CENTRES, VERIFIED = 3, 8, 4
SLICE_ENTRIES, SLICE_DOCS = 1 << 15, 1 << 10
SIZE_CLASS = 1.4  # ratio of the sizes in a class; more than 100 / PERCENT, so sizes that link are at most one class apart
COLUMNS = 1024  # shingles of a matrix at a time
ROWS = 64  # documents of a slice whose pairs are looked at together
BATCH_BYTES = 4 << 20  # of rows sent to a Python worker together: Spark's 64 MB lie in the JVM and in the worker, for every core
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
FEW = 0.02  # share of linked pairs in a round below which no further round is made


def each_set(table: pa.Table) -> Iterator[np.ndarray]:
    """Sorted different shingle hashes of each document; only the words of a part of the texts are held at a time."""
    column = table.column("text").cast(pa.binary())  # never as Python strings
    ends = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(), dtype=np.int64)
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART_BYTES, "right")))
        words, counts = word_hashes([t or b"" for t in column.slice(at, to - at).to_pylist()], lower=True)
        all_ = window_hash(words, WORDS)
        start = 0
        for n in counts.tolist():
            if n >= WORDS:
                yield np.unique(all_[start : start + n - WORDS + 1])
            else:
                yield mix(window_hash(words[start : start + n], n) + np.uint64(n)) if n else np.empty(0, np.uint64)
            start += n
        at = to


def shingle_sets(table: pa.Table) -> list[np.ndarray]:
    """Sorted different shingle hashes of each document."""
    return list(each_set(table))


def _node(block: int, rows: np.ndarray) -> np.ndarray:
    return block * B.BLOCK_ROWS + rows


def _place(node: str) -> list[Column]:
    """Block of a node and its row there (as the bucket of an answer), in whole numbers."""
    bits = B.BLOCK_ROWS.bit_length() - 1
    return [F.shiftright(node, bits).alias("block"), F.col(node).bitwiseAND(F.lit(B.BLOCK_ROWS - 1)).cast("int").alias("bucket")]


def _slots(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SLOT_BITS)).astype(np.uint32)


def _packed_counts(shingles: np.ndarray) -> bytes:
    """Counts of the slots, compressed slice by slice, so that no dense table is held."""
    slots = np.sort(_slots(shingles))
    edges = np.searchsorted(slots, np.arange(0, SLOTS + 1, _SLICE, dtype=np.uint32))
    out = zstandard.ZstdCompressor(3).compressobj()
    found = [out.compress(np.bincount(slots[a:b] & np.uint32(_SLICE - 1), minlength=_SLICE).astype("<u4").tobytes()) for a, b in zip(edges[:-1], edges[1:])]
    return b"".join([*found, out.flush()])


def _described(blocks: B.Blocks) -> DataFrame:
    """One row per document (size and digest of its set), and one per block with its counts of the slots."""

    def run(block: int, table: pa.Table, _) -> Iterator[pa.RecordBatch]:
        n = table.num_rows
        digests, sets = np.zeros((2, n), np.uint64), shingle_sets(table)
        for k, s in enumerate(sets):
            digests[0, k] = mix(s).sum()
            digests[1, k] = mix(s ^ np.uint64(0x9E3779B97F4A7C15)).sum()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, block), pa.int64()), pa.array(np.arange(n), pa.int32()), table.column("doc_id").combine_chunks().cast(pa.int64()),
             pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[0].astype(np.int64)), pa.array(digests[1].astype(np.int64)), pa.nulls(n, pa.binary())],
            names=["block", "row", "doc_id", "n", "d1", "d2", "counts"],
        )
        packed = _packed_counts(np.concatenate([np.empty(0, np.uint64), *sets]))
        yield pa.RecordBatch.from_pydict(
            {"block": [block], "row": [-1], "doc_id": [None], "n": [0], "d1": [0], "d2": [0], "counts": [packed]},
            schema=pa.schema([("block", pa.int64()), ("row", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("counts", pa.binary())]),
        )

    return blocks.map(run, "block long, row int, doc_id long, n long, d1 long, d2 long, counts binary")


def _packed(counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(1).compress(counts.astype("<i8").tobytes())


def _unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _summed_slices(found: Iterable[bytes]) -> Iterator[pa.RecordBatch]:
    """Sums of packed counts: a row for every slice with a count, compressed, as a table mostly holds noughts."""
    total = None
    for data in found:
        total = np.zeros(SLOTS, np.int64) if total is None else total
        with zstandard.ZstdDecompressor().stream_reader(data) as reader:
            for at in range(0, SLOTS, _SLICE):
                total[at : at + _SLICE] += np.frombuffer(reader.read(4 * _SLICE), "<u4")
    for k, at in enumerate(range(0, SLOTS if total is not None else 0, _SLICE)):
        part = total[at : at + _SLICE]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_packed(part)], pa.binary())], names=["part", "counts"])


def _slot_counts(described: DataFrame) -> np.ndarray:
    """Sums of the counts, first inside each partition; the result has a fixed size."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _summed_slices(x.as_py() for batch in batches for x in batch.column(0))

    def total(rows: pa.Table) -> pa.Table:
        summed = sum(np.frombuffer(_unpacked(x.as_py()), "<i8") for x in rows.column("counts"))
        return pa.table({"part": rows.column("part")[:1], "counts": pa.array([_packed(summed)], pa.binary())})

    parts = described.where("row = -1").select("counts").mapInArrow(partial, "part int, counts binary")
    out = np.zeros(SLOTS, np.int64)
    for row in B.added_up(parts, total).collect():
        out[row["part"] * _SLICE : (row["part"] + 1) * _SLICE] = np.frombuffer(_unpacked(row["counts"]), "<i8")
    return np.minimum(out, 2**32 - 1).astype(np.uint32)


def prefix(shingles: np.ndarray, counts: np.ndarray, usual: float) -> tuple[np.ndarray, int]:
    """The shingles of a document's prefix, and how many of them a partner has to share."""
    n = len(shingles)
    known = counts[_slots(shingles)]
    base = n - -(-PERCENT * n // 100)
    most = min(MOST_MATCHES, n - base)
    order = np.argsort(known, kind="stable")[: base + most]  # rare first; equal counts by hash
    # entries others are expected to have beyond the usual filling of a slot, and what verifying them costs
    others = np.cumsum(1 + np.maximum(known[order] - usual, 0.0))
    matches = np.arange(1, most + 1)
    cost = others[base:] * (1 + n / 8 / matches)
    best = int(np.argmin(cost)) + 1
    return shingles[order[: base + best]], best


def _prefixes(table: pa.Table, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles, row of their document, sizes of the sets, matches asked for."""
    usual = float(counts.mean() + 3 * np.sqrt(counts.mean()))
    found = [(*(prefix(s, counts, usual) if len(s) else (s, 0)), len(s)) for s in each_set(table)]
    keys = np.concatenate([np.empty(0, np.uint64), *(f[0] for f in found)])
    rows = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
    return keys, rows, np.array([f[2] for f in found], np.int64), np.array([f[1] for f in found], np.int64)


def _entries(blocks: B.Blocks, counts: np.ndarray, chosen: DataFrame) -> DataFrame:
    """(shingle, node, n, rest) of the representatives, for prefix shingles that two documents have; rest follows the prefix."""
    sent = blocks.spark.sparkContext.broadcast(counts)  # SLOTS numbers of four bytes
    buckets = blocks.buckets

    def ask(block: int, table: pa.Table, _) -> Iterator[pa.RecordBatch]:
        yield from B.key_rows(block, np.unique(_prefixes(table, sent.value)[0]), buckets)

    def answer(block: int, table: pa.Table, answers) -> Iterator[pa.RecordBatch]:
        keys, rows, sizes, _ = _prefixes(table, sent.value)
        rest = sizes - np.bincount(rows, minlength=len(sizes))
        different, which = np.unique(keys, return_inverse=True)
        shared = B.key_bits(different, buckets, answers[0]) | (np.bincount(which, minlength=len(different)) > 1)
        mine = np.zeros(len(sizes), bool)
        mine[list(answers[1])] = True
        use = shared[which] & mine[rows]
        r = rows[use]
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[use].astype(np.int64)), pa.array(_node(block, r)), pa.array(sizes[r]), pa.array(rest[r])],
            names=["shingle", "node", "n", "rest"],
        )

    shared = blocks.meet(blocks.map(ask, B.KEYS), B.shared_keys, B.BITS)
    return blocks.map(answer, "shingle long, node long, n long, rest long", shared, chosen)


def _sets(blocks: B.Blocks, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of the documents wanted."""
    wanted = nodes.select(*_place("node"))

    def run(block: int, table: pa.Table, answers) -> Iterator[pa.RecordBatch]:
        rows = sorted(answers[0])
        for at in range(0, len(rows), 1000):
            part = rows[at : at + 1000]
            sets = shingle_sets(table.take(part))
            yield pa.RecordBatch.from_arrays(
                [pa.array(_node(block, np.array(part, np.int64))), pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets).astype(np.int64)))],
                names=["node", "shingles"],
            )

    return blocks.map(run, "node long, shingles array<long>", wanted)


def _enough(met: DataFrame, part: float = 1.0) -> DataFrame:
    """Pairs (a, b) that met at enough shingles, of sizes that can link.

    Of two prefixes the one that ends first has all its matches among those counted, so the sets share no more than
    these and what follows that prefix.  ``part`` of the number needed is asked for.
    """
    sizes = 100 * F.least("n", "m") >= PERCENT * F.greatest("n", "m")
    wanted = F.ceil(PERCENT * (F.col("n") + F.col("m")) / (100 + PERCENT)) - F.greatest("rest", "rest2")
    counted = met.where(sizes).groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.max(wanted).alias("wanted"))
    return counted.where(F.col("c") >= part * F.col("wanted")).select("a", "b", "c")


def _verified(pairs: DataFrame, blocks: B.Blocks, files: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    sets = written(_sets(blocks, pairs.select(F.col("a").alias("node")).distinct().union(pairs.select("b").distinct()).distinct()), "near_sets", files)
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    both = F.size("sa") + F.size("sb") - common
    links = written(pairs.join(left, "a").join(right, "b").where(100 * common >= PERCENT * both).select("a", "b"), "near_links", files)
    forget(sets)
    return links


def components(edges: DataFrame, files: int | None = None) -> DataFrame:
    """(node, root) of all nodes in ``edges`` (a, b); the root is the smallest node that can be reached.

    Every node hooks onto its smallest smaller neighbour, chains are shortened by doubling, and the edges between
    roots go into the next round, until none is left.
    """
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near_edges", files)
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    roots = written(ends.withColumn("root", F.col("node")), "near_roots", files)
    while not edges.isEmpty():
        up = written(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), "near_up", files)
        while True:
            over = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            before = up
            up = written(up.join(over, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "near_up", files)
            forget(before)
            if up.where("moved").isEmpty():
                break
            before, up = up, written(up.select("node", "root"), "near_up", files)
            forget(before)
        heads = up.select("node", "root")

        def lifted(df: DataFrame, column: str) -> DataFrame:
            to = heads.select(F.col("node").alias(column), F.col("root").alias("_to"))
            return df.join(to, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")

        before, roots = roots, written(lifted(roots, "root"), "near_roots", files)
        forget(before)
        moved = lifted(lifted(edges, "a"), "b").where("a <> b")
        before, edges = edges, written(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near_edges", files)
        forget(before)
        forget(up)
    forget(edges)
    return roots


def _rooted(entries: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The entries with the root of their document's component, its own node as long as it has no link."""
    if roots is None:
        return entries.withColumn("root", F.col("node"))
    return entries.join(roots, "node", "left").select("shingle", "node", "n", "rest", F.coalesce("root", "node").alias("root"))


def _slices(rooted: DataFrame, files: int) -> DataFrame:
    """The entries of shingles at which components meet, with the slice and the size class of their document."""
    heat = rooted.groupBy("shingle").agg(F.count(F.lit(1)).alias("heat"), F.min("root").alias("_low"), F.max("root").alias("_high"))
    met = written(rooted.join(heat.where("_low < _high").select("shingle", "heat"), "shingle"), "near_met", files)
    homes = met.groupBy("node").agg(F.max(F.struct("heat", "shingle"))["shingle"].alias("home"), F.max("n").alias("n"), F.count(F.lit(1)).alias("k"))
    homes = homes.withColumn("size", F.floor(F.log(F.col("n")) / float(np.log(SIZE_CLASS))).cast("int"))
    homes = written(homes, "near_homes", files)
    wanted = F.greatest(F.ceil(F.sum("k") / SLICE_ENTRIES), F.ceil(F.count(F.lit(1)) / SLICE_DOCS))
    parts = homes.groupBy("home", "size").agg(wanted.alias("parts"))
    dealt = homes.join(parts, ["home", "size"]).select(
        "node", "size", F.xxhash64("home", "size", F.pmod(F.xxhash64("node"), "parts")).alias("slice"))
    placed = written(met.drop("heat").join(dealt, "node"), "near_placed", files)
    forget(met)
    forget(homes)
    return placed


def _packed_slice(rows: pa.Table) -> pa.Table:
    """One row of a slice: its entries by shingle, and its documents."""
    nodes, first, which = np.unique(rows.column("node").to_numpy(), return_index=True, return_inverse=True)
    shingles = rows.column("shingle").to_numpy()
    order = np.argsort(shingles, kind="stable")
    about = np.stack([nodes, *(rows.column(c).to_numpy()[first] for c in ("root", "n", "rest"))]).astype("<i8")
    return pa.table({
        "slice": rows.column("slice")[:1].combine_chunks(), "shingles": pa.array([shingles[order].astype("<i8").tobytes()], pa.binary()),
        "which": pa.array([which.ravel()[order].astype("<i4").tobytes()], pa.binary()), "about": pa.array([about.tobytes()], pa.binary()),
    })


def matched_pairs(a: tuple, b: tuple, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Documents of two slices (or of one with itself) that share enough prefix shingles and lie in different components.

    Of two prefixes the one that ends first has all its matches among those counted, so the sets share no more than
    these and what follows that prefix.
    """
    (sa, wa, ia), (sb, wb, ib) = a, b
    common = np.intersect1d(sa, sb)
    counts = np.zeros((ia.shape[1], ib.shape[1]), np.float32)
    ca, cb = np.searchsorted(common, sa), np.searchsorted(common, sb)
    ina, inb = np.isin(sa, common), np.isin(sb, common)
    for at in range(0, len(common), COLUMNS):
        left, right = (np.zeros((about.shape[1], COLUMNS), np.float32) for about in (ia, ib))
        for matrix, column, inside, which in ((left, ca, ina, wa), (right, cb, inb, wb)):
            use = inside & (column >= at) & (column < at + COLUMNS)
            matrix[which[use], column[use] - at] = 1
        counts += left @ right.T
    found = []
    for at in range(0, len(counts), ROWS):  # most pairs share something, so only those of a few documents are rows at a time
        x, y = np.nonzero(counts[at : at + ROWS])
        x += at
        if same:
            x, y = x[x < y], y[x < y]
        n, m = ia[2][x], ib[2][y]
        wanted = -(-PERCENT * (n + m) // (100 + PERCENT)) - np.maximum(ia[3][x], ib[3][y])
        good = (ia[1][x] != ib[1][y]) & (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)) & (counts[x, y] >= wanted)
        found.append((ia[0][x[good]], ib[0][y[good]]))
    return tuple(np.concatenate([np.empty(0, np.int64), *part]) for part in ([f[k] for f in found] for k in range(2)))


def _sliced_pairs(rooted: DataFrame, files: int) -> DataFrame:
    """Pairs (a, b) of different components whose prefixes share enough: counted slice by slice."""
    placed = _slices(rooted, files)
    schema = "slice long, shingles binary, which binary, about binary"
    parts = max(1, int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = placed.select("slice", "shingle", "node", "root", "n", "rest").repartition(parts, "slice")
    packed = written(dealt.groupBy("slice").applyInArrow(_packed_slice, schema), "near_slices", files)
    at = placed.select("shingle", "slice", "size").distinct()
    other = at.select("shingle", F.col("slice").alias("slice2"), F.col("size").alias("size2"))
    meets = at.join(other, "shingle").where((F.col("slice") <= F.col("slice2")) & (F.abs(F.col("size") - F.col("size2")) <= 1)).select("slice", "slice2").distinct()
    second = packed.select(*[F.col(c).alias(f"{c}2") for c in packed.columns])
    both = written(meets, "near_meets", files).join(packed, "slice").join(second, "slice2").select(
        (F.col("slice") == F.col("slice2")).alias("same"), *packed.columns[1:], *second.columns[1:])

    def unpacked(row: pa.RecordBatch, k: int) -> tuple:
        shingles, which, about = (row.column(k + j)[0].as_buffer() for j in range(3))
        return np.frombuffer(shingles, "<i8"), np.frombuffer(which, "<i4"), np.frombuffer(about, "<i8").reshape(4, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                a, b = matched_pairs(unpacked(row, 1), unpacked(row, 4), row.column(0)[0].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long").distinct()


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Of what is written inside, a Python worker gets ``BATCH_BYTES`` at a time."""
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(_BATCH) if before is None else spark.conf.set(_BATCH, before)


def _centres(rooted: DataFrame, turn: int) -> DataFrame:
    """The ``CENTRES`` documents of each shingle with the least hashes of this turn; all rank the documents alike."""
    order = Window.partitionBy("shingle").orderBy(F.xxhash64(F.lit(turn), "node"), "node")
    first = rooted.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= CENTRES)
    return first.select("shingle", F.col("node").alias("b"), F.col("root").alias("root2"), F.col("n").alias("m"), F.col("rest").alias("rest2"))


def near_components(blocks: B.Blocks) -> DataFrame:
    """block, row, doc_id, n_shingles, component_id of every document, and ``first``: the one row that stands for it."""
    files = blocks.files()
    described = written(_described(blocks), "near_described", files)
    counts = _slot_counts(described)
    order_id = F.coalesce("doc_id", F.lit(B.NO_ID))
    rows = written(described.where("row >= 0").select(
        "block", "row", "doc_id", order_id.alias("id"), "n", "d1", "d2", (F.col("block") * B.BLOCK_ROWS + F.col("row")).alias("node")), "near_rows", files)
    forget(described)  # with the counts of every block
    classes = written(
        rows.where("n > 0").groupBy("n", "d1", "d2").agg(F.min(F.struct("id", "node")).alias("top")).select("n", "d1", "d2", F.col("top.node").alias("rep")),
        "near_classes", files,
    )
    chosen = classes.select(*_place("rep"))
    asked = written(_entries(blocks, counts, chosen), "near_entries", files)
    several = asked.groupBy("shingle").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("shingle")
    entries = written(asked.join(several, "shingle"), "near_entries", files)
    forget(asked)

    # a few other documents per shingle and round; a pair that shares too few that way is left to the second part
    links = roots = None
    for r in range(STAR_ROUNDS):
        rooted = _rooted(entries, roots)
        met = rooted.withColumnRenamed("node", "a").join(_centres(rooted, r), "shingle").where("root <> root2")
        # of the centres a document meets, those it shares most with; the rest is left to the second part as well
        best = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("c"), "b"))
        few = _enough(met, part=0.6).withColumn("_best", best).where(F.col("_best") <= VERIFIED)
        pairs = written(few.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near_pairs", files)
        found = _verified(pairs, blocks, files)
        links = found if links is None else links.unionByName(found)
        linked = found.count()
        if linked:
            roots = components(links, files)
        if linked <= FEW * pairs.count():
            break

    with small_batches(blocks.spark):  # a slice is repeated in every row of its pairs
        pairs = written(_sliced_pairs(_rooted(entries, roots), files), "near_pairs", files)
    more = _verified(pairs, blocks, files)
    forget(entries)
    roots = components(links.unionByName(more), files)

    members = rows.join(classes, ["n", "d1", "d2"], "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    members = written(members.select("block", "row", "doc_id", "id", "n", F.coalesce("root", "rep", "node").alias("root"), "node"), "near_members", files)
    named = members.groupBy("root").agg(F.min(F.struct("id", "node")).alias("top"))
    out = members.join(named, "root").select(
        "block", "row", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("top.id") < B.NO_ID, F.col("top.id")).alias("component_id"),
        (F.col("top.node") == F.col("node")).alias("first"),
    )
    return out


def keep_one(docs: DataFrame, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """The documents, one of each component: that with the smallest doc_id."""
    blocks = B.Blocks(docs, block_bytes)
    first = near_components(blocks).where("first").select("block", F.col("row").alias("bucket"))

    def run(block: int, table: pa.Table, answers) -> Iterator[pa.RecordBatch]:
        yield from table.take(pa.array(sorted(answers[0]), pa.int64())).combine_chunks().to_batches()

    return blocks.map(run, docs.schema, first)


def component_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    blocks = B.Blocks(docs.select("doc_id", "text"))
    out = near_components(blocks).select("doc_id", "n_shingles", "component_id")
    blocks.drop()  # the answer reads it no more
    return out
