import random
import string
import time

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from conftest_llm import NULL_ID, order_id
from pyspark.sql import functions as F

from cohortloom.llm import blocks as B
from cohortloom.llm import near as N

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text):
    w = (text or "").translate(LOWER).encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                up[find(i)] = find(j)
    least = {}
    for i, row in enumerate(rows):
        least[find(i)] = min(least.get(find(i), NULL_ID), order_id(row))
    names = [least[find(i)] for i in range(len(rows))]
    return [(r[0], len(s), None if n == NULL_ID else n) for r, s, n in zip(rows, sets, names)]


def test_report_equals_brute_force(docs, rows, none):
    got = [tuple(r) for r in N.component_report(docs).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)
    assert N.component_report(none).count() == 0


def test_one_of_each_group_stays(docs, rows):
    out = N.keep_one(docs, 400)  # of some blocks nothing stays
    assert out.schema == docs.schema
    got = out.collect()
    want = brute(rows)
    linked = {n for _, size, n in want if size}
    assert len([r for r in got if shingles(r["text"])]) == len(linked)
    assert {r["doc_id"] for r in got if shingles(r["text"])} == linked
    assert len([r for r in got if not shingles(r["text"])]) == len([1 for _, size, _ in want if not size])


def _around_the_line(count, seed):
    """Texts that keep 78 to 100 of 100 parts of one text: many pairs just above and just below the line, and a few passages in others."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(6)) for _ in range(120)]
    out = []
    for k in range(count):
        own = list(words)
        for _ in range(rng.choice((0, 1, 2, 3, 3, 4, 4, 5))):
            own[rng.randrange(len(own))] = f"own{k}x{rng.randrange(1000)}"
        if k % 9 == 0:
            own = own[:60] + [f"tail{k}y{j}" for j in range(rng.choice((3, 40)))]  # shares a passage, or is one size class away
        out.append((k, " ".join(own)))
    return out


@pytest.mark.parametrize("slice_docs,rounds", [(1 << 10, 3), (40, 1)])
def test_large_group_around_the_line(spark, monkeypatch, slice_docs, rounds):
    monkeypatch.setattr(N, "SLICE_DOCS", slice_docs)
    monkeypatch.setattr(N, "STAR_ROUNDS", rounds)
    monkeypatch.setattr(N, "CENTRES", 2)
    monkeypatch.setattr(N, "COLUMNS", 64)
    data = _around_the_line(500, 3)
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, N.component_report(docs).collect())) == sorted(brute(data))


def test_matched_pairs_counts_every_pair():
    rng = np.random.default_rng(4)

    def make(nodes, at):
        sets = [np.unique(rng.integers(0, 60, rng.integers(1, 30))) for _ in range(nodes)]
        which = np.repeat(np.arange(nodes), [len(s) for s in sets]).astype(np.int32)
        shingles = np.concatenate(sets).astype(np.int64)
        order = np.argsort(shingles, kind="stable")
        about = np.stack([np.arange(at, at + nodes), rng.integers(0, 4, nodes), rng.integers(20, 40, nodes), rng.integers(5, 30, nodes)])
        return sets, (shingles[order], which[order], about)

    for same in (False, True):
        sets, a = make(40, 0)
        other, b = (sets, a) if same else make(25, 100)
        want = set()
        for i in range(len(sets)):
            for j in range(i + 1 if same else 0, len(other)):
                c, n, m = len(np.intersect1d(sets[i], other[j])), int(a[2][2][i]), int(b[2][2][j])
                need = -(-75 * (n + m) // 175) - max(a[2][3][i], b[2][3][j])
                if c and c >= need and a[2][1][i] != b[2][1][j] and 100 * min(n, m) >= 75 * max(n, m):
                    want.add((int(a[2][0][i]), int(b[2][0][j])))
        x, y = N.matched_pairs(a, b, same)
        assert want and set(zip(x.tolist(), y.tolist())) == want


def test_packed_counts_of_slots():
    rng = np.random.default_rng(1)
    for shingles in (rng.integers(0, 2**64, 5000, dtype=np.uint64), np.empty(0, np.uint64), np.full(9, 2**64 - 1, np.uint64)):
        data = zstandard.ZstdDecompressor().decompress(N._packed_counts(shingles), max_output_size=4 * N.SLOTS)
        want = np.bincount((shingles >> np.uint64(64 - N.SLOT_BITS)).astype(np.int64), minlength=N.SLOTS)
        assert (np.frombuffer(data, "<u4") == want).all()


def test_nodes_of_late_blocks_keep_their_place(spark):
    """Numbers beyond 2^53, where a quotient of doubles goes wrong."""
    nodes = [((65_600 << 20) + 5) * B.BLOCK_ROWS + r for r in (0, 1, B.BLOCK_ROWS - 1)]
    got = spark.createDataFrame([(n,) for n in nodes], "node long").select(*N._place("node")).collect()
    assert [tuple(r) for r in got] == [((65_600 << 20) + 5, r) for r in (0, 1, B.BLOCK_ROWS - 1)]


def test_linked_sets_share_enough_of_their_prefixes():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 50, N.SLOTS).astype(np.uint32)
    for _ in range(400):
        n = int(rng.integers(1, 60))
        a = rng.integers(0, 2**64, n, dtype=np.uint64)
        keep = a[rng.random(n) < rng.uniform(0.8, 1)]
        b = np.unique(np.concatenate([keep, rng.integers(0, 2**64, int(rng.integers(0, 4)), dtype=np.uint64)]))
        a = np.unique(a)
        if not len(b) or 100 * len(np.intersect1d(a, b)) < 75 * len(np.union1d(a, b)):
            continue
        (pa, la), (pb, lb) = N.prefix(a, counts, 10.0), N.prefix(b, counts, 10.0)
        assert len(np.intersect1d(pa, pb)) >= min(la, lb)


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(250, 240), (240, 230), (7, 7)]
    rng = np.random.default_rng(0)
    edges = [edges[k] for k in rng.permutation(len(edges))]
    got = {r["node"]: r["root"] for r in N.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 130)} | {250: 230, 240: 230, 230: 230}
    assert N.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_blocks_keep_rows_and_order_of_answers(docs, rows):
    blocks = B.Blocks(docs, 400)
    assert blocks.spark.table(blocks.name).count() > 20
    out = blocks.map(lambda block, table, answers: iter(table.to_batches()), docs.schema)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(rows, key=str)
    blocks.drop()
    assert not blocks.spark.catalog.tableExists(blocks.name)


def test_sums_of_slots_are_sent_in_small_rows():
    rng = np.random.default_rng(3)
    blocks_of = [rng.integers(0, 2**64, n, np.uint64) for n in (5000, 300, 0)]
    sent = list(N._summed_slices(N._packed_counts(s) for s in blocks_of))
    got = np.zeros(N.SLOTS, np.int64)
    for row in sent:
        assert row.num_rows == 1 and row.nbytes < 1 << 16  # not a table of eight bytes a slot
        k = row.column(0)[0].as_py()
        got[k * N._SLICE : (k + 1) * N._SLICE] = np.frombuffer(N._unpacked(row.column(1)[0].as_py()), "<i8")
    assert (got == np.bincount(N._slots(np.concatenate(blocks_of)), minlength=N.SLOTS)).all()
    assert not list(N._summed_slices([])) and not list(N._summed_slices([N._packed_counts(blocks_of[2])]))


def test_sets_do_not_depend_on_the_parts(monkeypatch):
    texts = ["One two THREE four five six", None, "", "few words", "a b c d e f g h " * 50, "x"]
    table = pa.table({"text": pa.chunked_array([pa.array(texts[:2], pa.string()), pa.array(texts[2:], pa.string())])})
    want = N.shingle_sets(table)
    assert [len(s) for s in want] == [len(shingles(t)) for t in texts]
    monkeypatch.setattr(N, "PART_BYTES", 10)
    assert all((a == b).all() for a, b in zip(want, N.shingle_sets(table), strict=True))


def test_tables_of_small_inputs_are_few_files(spark, monkeypatch):
    """However many shuffle partitions there are: every file is two processes for an executor on a local file system."""
    found = {}

    def watched(df, name, *files):
        out = written(df, name, *files)
        found[name] = max(found.get(name, 0), len(out.inputFiles()))
        return out

    written = N.written
    monkeypatch.setattr(N, "written", watched)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    data = _around_the_line(200, 5)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "60")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        blocks = B.Blocks(spark.createDataFrame(data, "doc_id long, text string").repartition(4))
        most = blocks.files()
        got = N.near_components(blocks).select("doc_id", "n_shingles", "component_id").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, got)) == sorted(brute(data))
    assert most < 30 and len(found) >= 10 and max(found.values()) <= most
    blocks.drop()


def test_centres_of_a_shingle_are_one_row_each(spark):
    entries = spark.createDataFrame([(s, node, 10, 3, node) for s in (1, 2, 3) for node in range(40) if s < 3 or node < 2], "shingle long, node long, n long, rest long, root long")
    tops = [{s: {r["b"] for r in N._centres(entries, turn).collect() if r["shingle"] == s} for s in (1, 2, 3)} for turn in (0, 1)]
    for top in tops:
        assert top[1] == top[2] and len(top[1]) == N.CENTRES and top[3] == {0, 1}  # all shingles rank the documents alike
    assert tops[0][1] != tops[1][1]


def test_written_tables_leave_no_shuffle_files(spark):
    def held():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {x for x in (str(found.apply(k)) for k in range(found.size())) if x.startswith("shuffle_")}

    option = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = held(), spark.conf.get(option)
    out = N.written(spark.range(0, 3000, 1, 6).groupBy((F.col("id") % 50).alias("k")).count().repartition(7, "k"), "shuffled", 3)
    for _ in range(50):
        if not held() - before:
            break
        time.sleep(0.2)
    assert not held() - before
    assert len(out.inputFiles()) <= 3 and out.count() == 50 and spark.conf.get(option) == was


def test_pairs_of_slices_are_looked_at_in_parts():
    import tracemalloc

    def slice_of(first, k, base):
        shingles = np.repeat(np.arange(8), k)  # every document has all eight
        which = np.tile(np.arange(k), 8)
        nodes = np.arange(first, first + k)
        return shingles, which, np.stack([nodes, nodes, np.full(k, 8), np.zeros(k, np.int64)])

    a, b = slice_of(0, 700, 0), slice_of(1000, 700, 0)
    found = N.matched_pairs(slice_of(0, 70, 0), slice_of(0, 70, 0), True)
    assert sorted(zip(*(x.tolist() for x in found))) == [(x, y) for x in range(70) for y in range(x + 1, 70)]
    a[2][3][:] = b[2][3][:] = -100  # nothing is enough: no pair comes out
    tracemalloc.start()
    assert [len(x) for x in N.matched_pairs(a, b, False)] == [0, 0]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 24 << 20  # the matrices have 8 MB; all pairs at once are 60 MB


def test_slices_reach_the_workers_in_small_batches(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(N, "_sliced_pairs", lambda *a, f=N._sliced_pairs: seen.append(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) or f(*a))
    monkeypatch.setattr(N, "BATCH_BYTES", 1000)
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 30, 40)) for _ in range(60)]
    texts += [t + " more" for t in texts]
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    got = N.component_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {k: k % 60 for k in range(120)}
    assert seen == ["1000"] and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
