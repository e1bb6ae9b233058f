"""K-means over integer vectors, with Orchard's search for the nearest centroid.

Every centroid has a list of the others, sorted by their distance from it.  The search for a vector goes down the list of its best
centroid so far; if it meets a closer one it jumps to the list of that one; it stops at the first entry strictly farther from the
centroid than twice the vector's distance, since no entry from there on can be as close.  Centroids already compared are marked
and not compared again.  Distances are compared as squares, in integers, so results are exact on any partitioning.

Numpy searches for all vectors of a batch side by side.  A round is one pass over the written integer vectors, which sends one row per
task and centroid (count and sums); only the k sums come to the driver, and only the k centroids go out.

Defined results: vectors that are null, hold null or non-finite entries or have not ``dimensions`` entries are left
out; repeated rows count as often as they stand there; equal distances go to the smaller centroid number; rows with equal ids (equal
hashes) start in the order of their vectors, null ids after all others; with fewer than k vectors there are fewer centroids; an empty table gives an
empty result; further columns are not looked at.  Entries of 2^27 or more after scaling raise an error, as squares would not fit 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cohortloom.session import written

SCALE, DIMENSIONS, K, ROUNDS, SALT = 1024, 64, 8, 10, "3"
LARGEST = 1 << 27
BATCH_ROWS = 4096
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def integer_vectors(embeddings: DataFrame, vector: str = "embedding", dimensions: int = DIMENSIONS) -> DataFrame:
    """vec_id and x, the scaled entries rounded down, of the vectors that take part."""

    def fine(c: Column) -> Column:
        c = c.cast("double")
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))

    kept = embeddings.where(F.col(vector).isNotNull() & (F.size(vector) == dimensions) & F.forall(vector, fine))
    x = F.transform(vector, lambda c: F.floor(SCALE * c.cast("double")))
    return written(kept.select("vec_id", x.alias("x")), "orchard_vectors")


def first_centroids(vectors: DataFrame, k: int = K, salt: str = SALT) -> list[list[int]]:
    """The k vectors whose ids have the smallest hashes: k rows for the driver."""
    chosen = vectors.select(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256).alias("h"), "x")
    return [row["x"] for row in chosen.orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()]


class Orchard:
    """The lists of neighbours of a set of centroids."""

    def __init__(self, centroids: list[list[int]]):
        self.centroids = np.array(centroids, np.int64)
        k = len(centroids)
        apart = np.array([((self.centroids - c) ** 2).sum(1) for c in self.centroids]).reshape(k, k)
        apart[np.diag_indices(k)] = -1  # a centroid leads its own list, which is left out
        self.order = np.argsort(apart, axis=1, kind="stable")[:, 1:]
        self.apart = np.take_along_axis(apart, self.order, 1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid and squared distance of every row."""
        n, k = len(x), len(self.centroids)
        best = np.zeros(n, np.int64)
        distance = ((x - self.centroids[0]) ** 2).sum(1)
        visited = np.zeros((n, k), bool)
        visited[:, 0] = True
        at = np.zeros(n, np.int64)  # place in the list of the best
        rows = np.arange(n) if k > 1 else np.arange(0)
        while len(rows):
            b, d = best[rows], distance[rows]
            going = self.apart[b, at[rows]] <= 4 * d  # squares; strictly beyond ends the search
            rows, b, d = rows[going], b[going], d[going]
            other = self.order[b, at[rows]]
            new = ~visited[rows, other]
            r, o = rows[new], other[new]
            visited[r, o] = True
            found = ((x[r] - self.centroids[o]) ** 2).sum(1)
            closer = (found < d[new]) | ((found == d[new]) & (o < b[new]))
            at[rows] += 1
            jump = r[closer]
            best[jump], distance[jump], at[jump] = o[closer], found[closer], 0
            rows = rows[at[rows] < k - 1]
        return best, distance


def _matrices(batch: pa.RecordBatch, column: int, d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for start in range(0, batch.num_rows, BATCH_ROWS):
        part = batch.slice(start, BATCH_ROWS)
        x = part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        if x.size and max(int(x.max()), -int(x.min())) >= LARGEST:
            raise ValueError("an entry is too large for exact distances in 64 bits")
        yield part, x


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """One round: every centroid with vectors becomes their mean, rounded down; the others stay."""
    k, d = len(centroids), len(centroids[0])
    fields = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orchard, n, sums = Orchard(centroids), np.zeros(k, np.int64), np.zeros((k, d), np.int64)
        for batch in batches:
            for _, x in _matrices(batch, 0, d):
                cluster, _ = orchard.nearest(x)
                n += np.bincount(cluster, minlength=k)
                np.add.at(sums, cluster, x)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"cluster": used.tolist(), "n": n[used].tolist(), "sums": sums[used].tolist()}, schema=fields)

    parts = vectors.select("x").mapInArrow(run, "cluster int, n long, sums array<long>")
    entries = parts.select("cluster", "n", F.posexplode("sums").alias("i", "s"))
    out = [list(c) for c in centroids]
    for row in entries.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():  # k times d rows
        out[row["cluster"]][row["i"]] = row["s"] // row["n"]
    return out


def assigned(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vec_id, cluster, distance."""
    d = len(centroids[0])
    fields = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orchard = Orchard(centroids)
        for batch in batches:
            for part, x in _matrices(batch, 1, d):
                cluster, distance = orchard.nearest(x)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(cluster.astype(np.int32)), pa.array(distance)], schema=fields)

    return vectors.select("vec_id", "x").mapInArrow(run, "vec_id long, cluster int, distance long")


def kmeans(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, salt: str = SALT) -> tuple[list[list[int]], DataFrame | None]:
    """Centroids after the rounds, and the assignment to them (None without vectors)."""
    centroids = first_centroids(vectors, k, salt)
    if not centroids:
        return [], None
    for _ in range(rounds):
        new = moved(vectors, centroids)
        if new == centroids:  # all further rounds would repeat this one
            break
        centroids = new
    return centroids, assigned(vectors, centroids)


def cluster_report(embeddings: DataFrame, vector: str = "embedding", dimensions: int = DIMENSIONS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    spark = embeddings.sparkSession
    centroids, rows = kmeans(integer_vectors(embeddings.select("vec_id", vector), vector, dimensions))
    if rows is None:
        return spark.createDataFrame([], RESULT)
    rows = written(rows, "orchard_assigned")
    inertia = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    total = sum(inertia.values())
    table = spark.createDataFrame(
        [(c, inertia.get(c, 0), total, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids)],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return rows.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def oracle_sql(dimensions: int = DIMENSIONS, k: int = K, rounds: int = ROUNDS, salt: str = SALT) -> str:
    """The same clustering as one SQL statement, with every distance worked out."""
    squared = "CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS x
             FROM embeddings WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dimensions})""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, x) - 1 AS k, x
             FROM (SELECT sha256('{salt}:' || CAST(vec_id AS VARCHAR)) AS h, x FROM v ORDER BY h NULLS LAST, x LIMIT {k}))""",
    ]
    for t in range(rounds + 1):
        steps.append(f"""a{t} AS MATERIALIZED (SELECT r, min(k_) AS k, min(d) AS d FROM (
             SELECT r, k_, d, min(d) OVER (PARTITION BY r) AS least FROM (SELECT v.r, c.k AS k_, {squared} AS d FROM v CROSS JOIN c{t} c)) WHERE d = least GROUP BY r)""")
        if t < rounds:
            steps.append(f"""c{t + 1} AS MATERIALIZED (SELECT o.k, coalesce(m.x, o.x) AS x FROM c{t} o LEFT JOIN (
             SELECT k, list(CAST((s - ((s % n + n) % n)) // n AS BIGINT) ORDER BY i) AS x FROM (
               SELECT k, i, sum(e) AS s, count(*) AS n FROM (SELECT a.k, unnest(v.x) AS e, unnest(range({dimensions})) AS i FROM v JOIN a{t} a USING (r)) GROUP BY k, i)
             GROUP BY k) m USING (k))""")
    return f"""WITH {", ".join(steps)}
        SELECT v.vec_id, CAST(a.k AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
               CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
        FROM v JOIN a{rounds} a USING (r) JOIN c{rounds} c ON c.k = a.k"""
