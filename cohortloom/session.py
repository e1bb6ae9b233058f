"""Session settings and lineage cuts shared by the whole library."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the plans are written for.  The skew rule is forced because a subject or a
# code may own a large share of the rows: without it Spark keeps a skewed join partition whole
# whenever splitting it would cost the next operator one more shuffle.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # mining joins turn small inputs into much larger outputs, so small partitions are kept apart
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a running session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def lineage_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``; only a local-mode session without that
    setting gets a private temporary folder.
    """
    context = spark.sparkContext
    root = (
        spark.conf.get("spark.checkpoint.dir", None)
        or context.getConf().get("spark.checkpoint.dir")
        or context.getCheckpointDir()
    )
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="cohortloom-"))
        root = context.getCheckpointDir()
    return root.rstrip("/")


# Files of a shuffle go when the query that made it has ended, not when the driver next collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write ``df`` as a parquet table in the lineage folder and return a read of it.

    Unlike a cache this survives the loss of any executor, and unlike an unwritten plan its size is
    known, so Spark decides on broadcasting from the real number of bytes.  Nothing else reads the shuffles of
    the write, so their files are deleted after it.  Of small tables ``files`` says in how many files at most: on a
    local file system without Hadoop's native library every file is two processes that the executor starts.
    """
    spark = df.sparkSession
    path = f"{lineage_dir(spark)}/cohortloom/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        (df if files is None else df.coalesce(files)).write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    if _OWNERS:
        _OWNERS[-1].append(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.cohortloom_path = path
    return stored


@contextmanager
def small_batches(spark: SparkSession, size: int = 4 << 20) -> Iterator[None]:
    """A Python worker gets ``size`` bytes of rows at a time in what is written inside; Spark's 64 MB lie in the JVM and in the worker, for every core."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written` once nothing will read it again."""
    name = df.__dict__.get("cohortloom_path")
    if name is not None:
        _delete(df.sparkSession, name)


_OWNERS: list[list[str]] = []  # paths written inside the open blocks of :func:`owned`


@contextmanager
def owned(spark: SparkSession) -> Iterator[None]:
    """Delete on leaving the block every table that :func:`written` made in it.

    Results are lazy and read such tables: write or collect them inside the block.
    """
    paths: list[str] = []
    _OWNERS.append(paths)
    try:
        yield
    finally:
        _OWNERS.remove(paths)
        for path in paths:
            _delete(spark, path)
