"""Whitening of embeddings by an incremental eigendecomposition.

Entries become integers, so the number of different vectors n and their sums S are exact.  Every task keeps the spectrum
(eigenvalues and eigenvectors) of the scatter of the centred vectors it has seen, and takes in one vector at a time:
in the eigenbasis that is a diagonal matrix plus a rank-one matrix, whose eigenvalues are the roots of a secular
equation between the old ones.  Parts of the vector that cannot change anything are deflated first.  The eigenvectors are those of a nearby
vector recomputed from the roots (Gu and Eisenstat), so they stay orthogonal.  Spectra are combined in rounds: one takes in the eigenpairs
of the other by rank-one updates.  Last, a pass over all vectors projects their covariance on the
basis found (Rayleigh-Ritz) and rotates it to the eigenvectors to double precision; another pass measures the covariance of
the whitened vectors.

Numpy works on several independent spectra at once (``LANES``), which are combined at the end of the task.  A spectrum is
d x d numbers whatever the input; tasks send theirs, ``FAN_IN`` are combined in a group, until one is left.

Defined results: rows whose vector is null or holds null or non-finite entries are dropped, as are those of another length than most
of the remaining rows have (of equally frequent lengths the largest counts) unless ``dimensions`` names it; repeated vectors count once in the fit and
are returned each; null ids are kept; components without variance (up to rounding, 1e-12 of the trace) have
explained 0, null whitened and no part in identity_error; with fewer dimensions there are fewer components; an empty table gives an empty
result; further columns are not looked at.  A deviation beyond a 64-bit integer raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cohortloom.session import written

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
LANES = 32  # spectra of a task at most
LANE_ROWS = 256  # vectors of the first batch for each
FAN_IN = 64
ROUNDS = 40  # of the root finder at most; each at least halves the bracket
NO_VARIANCE = 1e-12
EPS = np.finfo(float).eps


# ---------------------------------------------------------------- spectra


class Spectra:
    """Eigenvalues (rising) and eigenvectors (columns) of several scatter matrices, each updated by vectors of its own."""

    def __init__(self, values: np.ndarray, vectors: np.ndarray):
        self.values, self.vectors = values, vectors

    @classmethod
    def empty(cls, lanes: int, d: int) -> Spectra:
        return cls(np.zeros((lanes, d)), np.repeat(np.eye(d)[None], lanes, axis=0))

    def update(self, y: np.ndarray) -> None:
        """Add the outer product of ``y[lane]`` with itself to the matrix of every lane."""
        d, v = self.values, self.vectors
        z = np.matmul(y[:, None, :], v)[:, 0]
        length = np.einsum("gi,gi->g", z, z)
        tol = 8 * EPS * np.maximum(d[:, -1], length)
        z, v, d = self._deflate(z, v, d, tol)
        live = z != 0
        if not live.any():
            self.values, self.vectors = d, v
            return
        delta, tau = _roots(d, z, live)  # pole j minus the origin of root i, and root i minus its origin
        gap = delta - tau[:, :, None]  # pole j minus root i
        all_live = live.all()
        both = None if all_live else live[:, :, None] & live[:, None, :]
        poles = d[:, None, :] - d[:, :, None]  # pole j minus pole i
        eye = np.eye(d.shape[1], dtype=bool)
        np.einsum("gii->gi", poles)[...] = -1.0
        if not all_live:
            poles[~both], gap[~both] = 1.0, 1.0
        # the vector of which the roots are exact: product over i of (root i - pole j) / (pole i - pole j), without i = j below
        ratio = np.divide(gap, poles, out=poles)
        if not all_live:
            ratio[~both] = 1.0
        fitted = np.sqrt(np.maximum(np.multiply.reduce(ratio, axis=1), 0.0))
        weight = np.divide(np.copysign(fitted, z)[:, None, :], gap, out=gap if all_live else np.zeros_like(gap), where=True if all_live else both)
        weight /= np.maximum(np.sqrt(np.einsum("gij,gij->gi", weight, weight)), 1e-300)[:, :, None]
        dead = ~live
        if dead.any():
            weight[dead[:, :, None] & eye] = 1.0
        root = np.where(live, d - np.einsum("gii->gi", delta) + tau, d)
        v = np.matmul(v, weight.transpose(0, 2, 1))
        if (np.diff(root, axis=1) < 0).any():
            order = np.argsort(root, axis=1, kind="stable")
            root = np.take_along_axis(root, order, 1)
            v = np.take_along_axis(v, order[:, None, :], 2)
        self.values, self.vectors = np.maximum(root, 0.0), v

    @staticmethod
    def _deflate(z, v, d, tol) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Turn the basis within equal eigenvalues so that few parts of z are left; parts too small to matter become 0."""
        n = len(z)
        norm = np.sqrt(np.einsum("gi,gi->g", z, z))
        z = np.where(np.abs(z) * norm[:, None] <= tol[:, None], 0.0, z)
        null = d <= tol[:, None]
        if ((null & (z != 0)).sum(1) > 1).any():  # one reflection for the whole null space
            d = np.where(null, 0.0, d)
            w = np.where(null, z, 0.0)
            last = np.maximum(null.sum(1) - 1, 0)
            lanes = np.arange(n)
            part = np.sqrt(np.einsum("gi,gi->g", w, w))
            new = -np.copysign(part, w[lanes, last])
            w[lanes, last] -= new
            size = np.einsum("gi,gi->g", w, w)
            factor = np.divide(2.0, size, out=np.zeros(n), where=size > 0)
            v = v - (factor[:, None] * np.matmul(v, w[:, :, None])[:, :, 0])[:, :, None] * w[:, None, :]
            z = np.where(null, 0.0, z)
            some = null.any(1) & (part > 0)
            z[lanes[some], last[some]] = new[some]
        live = z != 0
        index = np.arange(d.shape[1])
        before = np.maximum.accumulate(np.where(live, index, -1), axis=1)
        before = np.concatenate([np.full((n, 1), -1), before[:, :-1]], axis=1)
        other = np.take_along_axis(z, np.maximum(before, 0), 1)
        gap = d - np.take_along_axis(d, np.maximum(before, 0), 1)
        square = z * z + other * other
        close = live & (before >= 0) & (np.abs(gap * z * other) <= tol[:, None] * square)
        if close.any():
            z, d, v = z.copy(), d.copy(), v.copy()
            for g in np.flatnonzero(close.any(1)):  # plane rotations, rarely needed outside the null space
                i = -1
                for j in index:
                    if z[g, j] == 0:
                        continue
                    if i >= 0:
                        r = np.hypot(z[g, i], z[g, j])
                        c, s = z[g, j] / r, z[g, i] / r
                        if abs((d[g, j] - d[g, i]) * c * s) <= tol[g]:
                            z[g, i], z[g, j] = 0.0, r
                            d[g, i], d[g, j] = c * c * d[g, i] + s * s * d[g, j], s * s * d[g, i] + c * c * d[g, j]
                            a, b = v[g, :, i].copy(), v[g, :, j].copy()
                            v[g, :, i], v[g, :, j] = c * a - s * b, s * a + c * b
                    i = j
        return z, v, d

    def combined(self) -> Spectra:
        """One spectrum of all lanes: half of the lanes take in the eigenpairs of the other half, again and again."""
        values, vectors = self.values, self.vectors
        while len(values) > 1:
            half = len(values) // 2
            into = Spectra(values[:half], vectors[:half])
            for j in reversed(range(values.shape[1])):
                y = np.sqrt(values[half : 2 * half, j])[:, None] * vectors[half : 2 * half, :, j]
                if y.any():
                    into.update(y)
            values = np.concatenate([into.values, values[2 * half :]])
            vectors = np.concatenate([into.vectors, vectors[2 * half :]])
        return Spectra(values, vectors)


def _roots(d: np.ndarray, z: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum_j z_j^2 / (d_j - x), one above each live pole: distances of the poles from an origin (the nearer
    pole) and the root's distance from it.

    A step fits a constant and two poles to value and slope; a step out of the bracket is replaced by its middle.
    """
    n, k = d.shape
    z2 = z * z
    total = z2.sum(1)
    index = np.arange(k)
    after = np.minimum.accumulate(np.where(live, index, k)[:, ::-1], axis=1)[:, ::-1]
    after = np.concatenate([after[:, 1:], np.full((n, 1), k)], axis=1)
    final = after == k
    nxt = np.minimum(after, k - 1)
    width = np.where(final, total[:, None], np.take_along_axis(d, nxt, 1) - d)
    width = np.where(live, width, 1.0)
    weights = z2[:, :, None]

    space = np.empty((n, k, k))  # reused: the arrays of a step are too large to be allocated again for each

    def value(delta: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Function and slope at ``at`` beyond the origins."""
        np.subtract(delta, at[:, :, None], out=space)
        with np.errstate(divide="ignore", invalid="ignore"):
            np.divide(1.0, space, out=space)
            f = np.matmul(space, weights)[:, :, 0]
        if not np.isfinite(f).all():  # on a pole without weight
            space[~np.isfinite(space)] = 0.0
            f = np.matmul(space, weights)[:, :, 0]
        np.multiply(space, space, out=space)
        return 1.0 + f, np.matmul(space, weights)[:, :, 0]

    delta = d[:, None, :] - d[:, :, None]
    half, _ = value(delta, width / 2)
    right = live & ~final & (half < 0)  # the root is nearer to the next pole
    delta = np.where(right[:, :, None], d[:, None, :] - np.take_along_axis(d, nxt, 1)[:, :, None], delta)
    low = np.where(right, -width / 2, 0.0)
    high = np.where(right, 0.0, np.where(final, width, width / 2))
    low = np.where(final & (half < 0), width / 2, low)
    high = np.where(final & (half >= 0), width / 2, high)
    tau = (low + high) / 2
    below = np.maximum.accumulate(np.where(live, index, -1), axis=1)
    below = np.concatenate([np.full((n, 1), -1), below[:, :-1]], axis=1)
    lower = np.where(below < 0, 1.0, d - np.take_along_axis(d, np.maximum(below, 0), 1))
    p = np.where(right, -width, 0.0)
    q = np.where(right, 0.0, np.where(final, -lower, width))  # the largest root lies above both its poles
    own, following = z2, np.take_along_axis(z2, nxt, 1)
    open_ = live.copy()
    for _ in range(ROUNDS):
        f, slope = value(delta, tau)
        low, high = np.where(f < 0, tau, low), np.where(f >= 0, tau, high)
        dp, dq = p - tau, q - tau
        with np.errstate(all="ignore"):
            left = np.where(right, np.maximum(slope - following / (dq * dq), 0.0) * dp * dp, own)
            beyond = np.where(right, following, np.maximum(slope - own / (dp * dp), 0.0) * dq * dq)
            c = f - left / dp - beyond / dq
            a, b = (dp + dq) * f - dp * dq * slope, dp * dq * f
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0.0))
            root = np.where(final, -root, root)
            step = np.where((a <= 0) != final, (a - root) / (2 * c), 2 * b / (a + root))
        new = tau + step
        new = np.where(np.isfinite(new) & (new >= low) & (new <= high) & (new != 0), new, (low + high) / 2)
        moved = np.abs(new - tau) > 1e-9 * np.abs(new)
        open_ = live & moved & (high - low > 4 * EPS * np.maximum(np.abs(low), np.abs(high)))
        tau = new
        if not open_.any():
            break
    return delta, tau


def _packed(s: Spectra) -> tuple[bytes, bytes]:
    return s.values[0].tobytes(), s.vectors[0].tobytes()


# ---------------------------------------------------------------- distributed steps


def _clean(embeddings: DataFrame, vector: str) -> DataFrame:
    def fine(c: Column) -> Column:
        c = c.cast("double")
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))

    return embeddings.where(F.col(vector).isNotNull() & F.forall(vector, fine))


def integer_rows(embeddings: DataFrame, vector: str = "embedding", dimensions: int | None = None) -> tuple[DataFrame, int]:
    """vec_id and x (integers) of the rows with a whole vector, and the number of dimensions (0 without rows)."""
    clean = _clean(embeddings.select("vec_id", vector), vector)
    if dimensions is None:
        sizes = clean.where(F.size(vector) > 0).groupBy(F.size(vector).alias("d")).count()
        top = sizes.orderBy(F.desc("count"), F.desc("d")).head(1)
        dimensions = top[0]["d"] if top else 0
    x = F.transform(vector, lambda c: F.floor(SCALE * c.cast("double")) + SHIFT)
    return written(clean.where((F.size(vector) == dimensions) & (F.size(vector) > 0)).select("vec_id", x.alias("x")), "whitening_rows"), dimensions


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of every dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(d, np.int64)
        for batch in batches:
            n += batch.num_rows
            sums += _matrix(batch.column(0), d).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([sums.tolist()], pa.list_(pa.int64()))], names=["n", "sums"])

    parts = fit.mapInArrow(run, "n long, sums array<long>")
    row = parts.agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(d)]).alias("sums")).head()
    return row["n"] or 0, row["sums"]


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n: the difference is taken between integers as far as they fit, so nothing is lost before the division."""
    whole = sums // n
    return (x - whole).astype(float) - (sums - whole * n) / n


def _in_one(parts: DataFrame, schema: str, fn) -> DataFrame:
    """Rows of one kind, one from a task, brought together ``FAN_IN`` at a time by ``fn`` until one is left."""
    parts = written(parts, "whitening_parts")
    left = parts.count()
    while left > 1:
        numbered = parts.withColumn("turn", F.pmod(F.xxhash64(F.col("part")), F.lit(-(-left // FAN_IN))))
        parts = written(numbered.groupBy("turn").applyInArrow(fn, schema), "whitening_parts")
        left = parts.count()
    return parts


def incremental_basis(fit: DataFrame, d: int, n: int, sums: list[int]) -> np.ndarray:
    """Orthonormal columns, by falling eigenvalue, of the scatter of all vectors (to the accuracy of the updates)."""
    totals = np.array(sums, np.int64)
    schema = "part long, values binary, vectors binary"
    fields = pa.schema([("part", pa.int64()), ("values", pa.binary()), ("vectors", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        spectra = None
        for batch in batches:
            y = _centred(_matrix(batch.column(0), d), n, totals)
            if spectra is None:
                spectra = Spectra.empty(max(1, min(LANES, len(y) // LANE_ROWS)), d)
            lanes = len(spectra.values)
            y = np.concatenate([y, np.zeros((-len(y) % lanes, d))])  # a zero vector changes nothing
            for at in range(0, len(y), lanes):
                spectra.update(y[at : at + lanes])
        if spectra is not None:
            values, vectors = _packed(spectra.combined())
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "values": [values], "vectors": [vectors]}, schema=fields)

    def combine(rows: pa.Table) -> pa.Table:
        one = Spectra(
            np.stack([np.frombuffer(x.as_py()) for x in rows.column("values")]),
            np.stack([np.frombuffer(x.as_py()).reshape(d, d) for x in rows.column("vectors")]),
        ).combined()
        values, vectors = _packed(one)
        return pa.table({"part": rows.column("part")[:1].combine_chunks(), "values": pa.array([values], pa.binary()), "vectors": pa.array([vectors], pa.binary())}, schema=fields)

    row = _in_one(fit.mapInArrow(run, schema), schema, combine).head()
    return np.frombuffer(row["vectors"]).reshape(d, d)[:, ::-1]


def projected_covariance(fit: DataFrame, basis: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Covariance (divisor n) of the centred vectors in a basis, from one pass over all of them."""
    d, k = basis.shape
    totals = np.array(sums, np.int64)
    schema = "part long, scatter binary"
    fields = pa.schema([("part", pa.int64()), ("scatter", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((k, k))
        for batch in batches:
            y = _centred(_matrix(batch.column(0), d), n, totals) @ basis
            total += y.T @ y
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "scatter": [total.tobytes()]}, schema=fields)

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py()) for x in rows.column("scatter"))
        return pa.table({"part": rows.column("part")[:1].combine_chunks(), "scatter": pa.array([total.tobytes()], pa.binary())}, schema=fields)

    return np.frombuffer(_in_one(fit.mapInArrow(run, schema), schema, add).head()["scatter"]).reshape(k, k) / n


class Whitener:
    """n, sums, the eigenvalues e and components (columns) of the covariance, its trace, and the measured error of whitening."""

    def __init__(self, fit: DataFrame, d: int, components: int = COMPONENTS):
        self.n, self.sums = _sums(fit, d)
        rough = incremental_basis(fit, d, self.n, self.sums)
        h = projected_covariance(fit, rough, self.n, self.sums)
        values, turn = np.linalg.eigh((h + h.T) / 2)
        basis = rough @ turn[:, ::-1]
        basis *= np.where(basis[np.abs(basis).argmax(0), np.arange(d)] < 0, -1.0, 1.0)
        self.values, self.trace = np.maximum(values[::-1], 0.0), float(np.trace(h))
        self.k = min(components, d)
        self.components = np.ascontiguousarray(basis[:, : self.k])
        varied = int((self.values[: self.k] > NO_VARIANCE * self.trace).sum())
        self.varied = varied
        self.error = 0.0
        if varied:
            scaled = self.components[:, :varied] / np.sqrt(self.values[:varied])
            self.error = float(np.abs(projected_covariance(fit, scaled, self.n, self.sums) - np.eye(varied)).max())


def fitted(rows: DataFrame, d: int, components: int = COMPONENTS) -> Whitener | None:
    """The whitening of integer rows, fitted on the different vectors; None without rows."""
    fit = written(rows.select("x").distinct(), "whitening_fit")
    return None if d == 0 or fit.isEmpty() else Whitener(fit, d, components)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int] | np.ndarray:
    largest = max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
    if n * largest + int(np.abs(sums).max()) < 2**62:
        off = n * x - sums
        if x.shape[1] * int(np.abs(off).max(initial=0)) ** 2 < 2**63:
            return np.einsum("ij,ij->i", off, off)
    return [sum((n * a - s) ** 2 for a, s in zip(row, sums.tolist())) for row in x.tolist()]


def whiten(rows: DataFrame, w: Whitener) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every row and component."""
    n, totals, k, varied, error = w.n, np.array(w.sums, np.int64), w.k, w.varied, w.error
    scaled = w.components[:, :varied] / np.sqrt(w.values[:varied])
    explained = [float(e / w.trace) if i < varied else 0.0 for i, e in enumerate(w.values[:k])]
    d = len(w.sums)
    fields = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            x = _matrix(batch.column(1), d)
            y = np.full((m, k), np.nan)
            y[:, :varied] = _centred(x, n, totals) @ scaled
            yield pa.RecordBatch.from_arrays([
                batch.column(0).cast(pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, n, np.int64)), pa.array(_deviations(x, n, totals), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(y.ravel(), from_pandas=True), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
            ], schema=fields)

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whitening_report(embeddings: DataFrame, vector: str = "embedding", dimensions: int | None = None) -> DataFrame:
    rows, d = integer_rows(embeddings, vector, dimensions)
    w = fitted(rows, d)
    if w is None:
        return rows.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return whiten(rows, w)
