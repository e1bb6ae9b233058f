"""Documents packed in blocks, so that tasks can ask questions about their content and get answers back.

The duplicate-search operators first send hashes of what a block holds to buckets, where the blocks meet, and then need
to know in each block which of them other blocks have too.  ``pack`` writes the documents once as rows of about 8 MB,
compressed, in a table bucketed by block id.  Questions go out as one row per block and bucket, with different keys only, so a
key that every document holds is one entry per block.  An answer has one bit per key in the order sent; the block
works its keys out again and needs no ids of documents.  The bucketed table is joined with the answers without being
shuffled.  Lost tasks read their blocks again from the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from cohortloom.llm.hashing import bucket_bounds, from_six_bytes, six_bytes
from cohortloom.llm.worker import let_go
from cohortloom.session import lineage_dir

BLOCK_BYTES = 8 << 20
BLOCK_ROWS = 1 << 17
BUCKETS_PER_PARTITION = 4
FILE_BYTES = 1 << 20  # of packed documents for a file of a table made from them; far less than a partition of a large input
TURNS = 64  # groups in which the tables of all tasks are added up first
NO_ID = np.iinfo(np.int64).max  # stands for a null doc_id: after all others, and not smaller than another null

Answers = dict[int, list[bytes]]


def doc_ids(table: pa.Table) -> np.ndarray:
    column = table.column("doc_id").cast(pa.int64())
    return column.fill_null(NO_ID).to_numpy().astype(np.int64)


def texts(table: pa.Table) -> list[bytes]:
    return [t.encode() if t else b"" for t in table.column("text").to_pylist()]


class Blocks:
    def __init__(self, docs: DataFrame, block_bytes: int = BLOCK_BYTES):
        spark = docs.sparkSession
        self.spark, self.schema = spark, docs.schema
        self.partitions = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.buckets = BUCKETS_PER_PARTITION * self.partitions
        self.name = f"cohortloom_blocks_{uuid.uuid4().hex}"
        at = docs.columns.index("text")

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            let_go()
            task, k = TaskContext.get().partitionId(), 0
            kept, size, rows = [], 0, 0

            def block() -> pa.RecordBatch:
                sink = pa.BufferOutputStream()
                options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
                with pa.ipc.new_stream(sink, kept[0].schema, options=options) as out:
                    for x in kept:
                        out.write_batch(x)
                return pa.RecordBatch.from_arrays([pa.array([(task << 20) + k], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "payload"])

            for batch in batches:
                ends = np.cumsum([len(t.as_py() or "") for t in batch.column(at)])
                start = 0
                while start < batch.num_rows:
                    base = ends[start - 1] if start else 0
                    stop = max(start + 1, int(np.searchsorted(ends, base + block_bytes - size, "right")))
                    stop = min(stop, start + BLOCK_ROWS - rows)
                    kept.append(batch.slice(start, stop - start))
                    size, rows = size + int(ends[stop - 1] - base), rows + stop - start
                    start = stop
                    if start < batch.num_rows or size >= block_bytes or rows >= BLOCK_ROWS:
                        yield block()
                        kept, size, rows, k = [], 0, 0, k + 1
            if kept:
                yield block()

        (
            docs.mapInArrow(packed, "block long, payload binary").write.format("parquet").option("compression", "uncompressed")
            .option("path", f"{lineage_dir(spark)}/cohortloom/{self.name}").bucketBy(self.partitions, "block").saveAsTable(self.name)
        )

    def map(self, fn: Callable[[int, pa.Table, list[Answers]], Iterator[pa.RecordBatch]], schema, *answers: DataFrame) -> DataFrame:
        """Run ``fn(block, documents, answers)`` on every block; ``answers`` have block, bucket, data columns."""
        df, n_answers = self.spark.table(self.name), len(answers)
        for k, answer in enumerate(answers):
            fields = [c for c in answer.columns if c not in ("block", "bucket")]
            one = answer.groupBy(F.col("block").alias(f"_b{k}")).agg(F.collect_list(F.struct("bucket", *fields)).alias(f"a{k}"))
            df = df.join(one.hint("shuffle_hash"), df["block"] == one[f"_b{k}"], "left").drop(f"_b{k}")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            let_go()
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1)
                    table = pa.ipc.open_stream(row.column(1)[0].as_buffer()).read_all()
                    found = [{x["bucket"]: [v for k, v in x.items() if k != "bucket"] for x in (row.column(2 + k)[0].as_py() or [])} for k in range(n_answers)]
                    yield from fn(row.column(0)[0].as_py(), table, found)

        return df.mapInArrow(run, schema)

    def meet(self, sent: DataFrame, fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
        """Run ``fn`` on all rows of a bucket."""
        return sent.repartition(self.partitions, "bucket").groupBy("bucket").applyInArrow(fn, schema)

    def _folder(self) -> tuple:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{lineage_dir(self.spark)}/cohortloom/{self.name}")
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def files(self) -> int:
        """How many files a table made from the documents needs at most: by their packed size, and two for every core."""
        where, system = self._folder()
        return max(2 * self.spark.sparkContext.defaultParallelism, -(-system.getContentSummary(where).getLength() // FILE_BYTES))

    def drop(self) -> None:
        """Forget the table and its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        where, system = self._folder()
        system.delete(where, True)


def key_rows(block: int, keys: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Different keys, sorted, as one row per bucket."""


    bounds = bucket_bounds(keys, buckets)
    used = np.flatnonzero(np.diff(bounds))
    yield pa.RecordBatch.from_arrays(
        [pa.array(used, pa.int32()), pa.array(np.full(len(used), block), pa.int64()), pa.array([six_bytes(keys[bounds[b] : bounds[b + 1]]) for b in used], pa.binary())],
        names=["bucket", "block", "data"],
    )


def added_up(parts: DataFrame, fn: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """Sums of (part, counts) rows, one of each part from every task, in two steps: no group holds those of all tasks."""
    schema = "part int, counts binary"
    some = parts.withColumn("turn", F.spark_partition_id() % TURNS).groupBy("part", "turn").applyInArrow(fn, schema)
    return some.groupBy("part").applyInArrow(fn, schema)


KEYS = "bucket int, block long, data binary"
BITS = "block long, bucket int, data binary"


def shared_keys(rows: pa.Table) -> pa.Table:
    """For every key that the blocks sent to a bucket, one bit: does another block have it?"""


    data = [from_six_bytes(d.as_py()) for d in rows.column("data")]
    keys = np.concatenate(data)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    shared = np.zeros(len(keys), bool)
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    ends = np.cumsum([len(d) for d in data])
    bits = [np.packbits(shared[e - len(d) : e]).tobytes() for d, e in zip(data, ends)]
    return pa.table({"block": rows.column("block"), "bucket": rows.column("bucket"), "data": pa.array(bits, pa.binary())})


def key_bits(keys: np.ndarray, buckets: int, answers: Answers) -> np.ndarray:
    """The answers of ``shared_keys`` in the order of the sorted keys."""


    bounds = bucket_bounds(keys, buckets)
    out = np.zeros(len(keys), bool)
    for b, (data,) in answers.items():
        n = bounds[b + 1] - bounds[b]
        out[bounds[b] : bounds[b + 1]] = np.unpackbits(np.frombuffer(data, np.uint8), count=n)
    return out
