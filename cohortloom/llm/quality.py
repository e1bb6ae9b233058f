"""Quality rules by robust multivariate outliers: minimum-covariance-determinant estimates per language and source.

A text becomes a vector of transformed statistics.  For every (language, source) the centre and scatter of the
three quarters of its documents with the smallest covariance determinant are found by concentration steps: distances,
their quantile, moments of the nearer part, and again.  Each step is one pass over a small written table of numbers;
only one row per group goes into the next step.  A document is rejected when its squared Mahalanobis distance to its
group exceeds a far chi-square quantile, or when one of the base rules fails.

Groups with fewer than ``LEAST_ROWS`` documents that pass the base rules use the estimates of their language, and
languages with fewer those of the whole corpus; below that no document is an outlier.  All documents that pass the
base rules take part in the estimates.

Defined results: null text has no words and fails; null language or source is a group of its own; repeated rows count
as often as they stand there; equal distances fall on the same side; in a direction without spread the scale
in ``FEATURES`` holds; empty tables give empty results; further columns, also those named like a statistic, are kept.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from cohortloom.llm.worker import let_go
from cohortloom.session import written

SUPPORT = 0.75  # part of the documents whose determinant is made small
STEPS = 5
LEAST_ROWS = 100
TAIL = 1e-4  # of the chi-square distribution beyond the cut
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
#: Transformed statistics with the least spread (standard deviation) each is given.  ``repeats`` ends at 0.71 and
#: ``dup_lines`` at 1, so theirs are small enough that either alone can take a document past the cut (4.85 spreads).
FEATURES = {"word_length": 0.06, "symbols": 0.1, "repeats": 0.08, "dup_lines": 0.1}
PSEUDO_WORDS, PSEUDO_CHARS = 50.0, 5.0  # a mean word length is drawn to this where there are few words

SPACES, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"


def text_stats(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The numbers of ``STATS``, over the whole text."""
    data = (text or "").encode()
    words = data.split()  # bytes split at space and 09-0D only
    chars = len(text or "") - (len(data) - len(data.translate(None, SPACES)))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [line for line in data.split(b"\n") if line.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen = Counter(windows)
        end = 0  # of what is counted
        for i, window in enumerate(windows):
            if seen[window] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated, len(lines)


def _with_stats(docs: DataFrame) -> DataFrame:
    """``docs`` with its statistics as columns ``_q_<name>``."""
    schema = T.StructType(docs.schema.fields + [T.StructField(f"_q_{s}", T.LongType()) for s in STATS])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                found = np.array([text_stats(t.as_py()) for t in part.column(at)], np.int64).reshape(-1, len(STATS))
                yield pa.RecordBatch.from_arrays(part.columns + [pa.array(found[:, j]) for j in range(len(STATS))], names=[*part.schema.names, *(f"_q_{s}" for s in STATS)])

    return docs.mapInArrow(run, schema)


def _base_failed() -> Column:
    return (F.col("_q_n_words") < 50) | (100 * F.col("_q_n_repeat_words") > 50 * F.col("_q_n_words"))


def _features() -> list[Column]:
    n = F.greatest(F.col("_q_n_words"), F.lit(1)).cast("double")
    return [
        F.log((F.col("_q_word_chars") + PSEUDO_WORDS * PSEUDO_CHARS) / (F.col("_q_n_words") + PSEUDO_WORDS)),
        F.sqrt(F.col("_q_n_symbols") / n),
        F.sqrt(F.col("_q_n_repeat_words") / n),
        F.sqrt(F.col("_q_n_dup_lines") / F.greatest(F.col("_q_n_lines"), F.lit(1))),
    ]


# ---------------------------------------------------------------- chi-square


def _chi2_cdf(x: float, df: float) -> float:
    """Lower regularised gamma function at (df / 2, x / 2), by its series."""
    if x <= 0:
        return 0.0
    a, z = df / 2, x / 2
    term = total = 1 / a
    k = a
    while abs(term) > 1e-17 * abs(total):
        k += 1
        term *= z / k
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def chi2_quantile(p: float, df: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_cdf(mid, df) < p else (low, mid)
    return high


# ---------------------------------------------------------------- estimates


def _distance(center: Column, inverse: Column, xs: list[Column]) -> Column:
    p = len(xs)
    d = [x - center[i] for i, x in enumerate(xs)]
    total = F.lit(0.0)
    for i in range(p):
        for j in range(i, p):
            total = total + inverse[i * p + j] * d[i] * d[j] * (1.0 if i == j else 2.0)
    return total


def inverse_scatter(cov: np.ndarray, floors: np.ndarray) -> np.ndarray:
    """Inverse of a scatter that gets at least the spread of the floors in every direction, not only along the axes.

    So copies of one or two texts, or features that follow each other, leave a scatter that can be inverted, and no distance is negative.
    """
    values, turn = np.linalg.eigh(cov / np.outer(floors, floors))
    scaled = turn / floors[:, None]
    return (scaled / np.maximum(values, 1.0)) @ scaled.T


def _scatter_to_inverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Centre and inverse scatter of each group, from its count, sums and sums of products."""
    floors = np.array(list(FEATURES.values()))
    p = len(floors)
    q = chi2_quantile(SUPPORT, p)
    consistency = SUPPORT / _chi2_cdf(q, p + 2)
    upper = np.triu_indices(p)
    for batch in batches:
        out = {"_group": [], "center": [], "inverse": [], "n": []}
        for row in batch.to_pylist():
            n, sums, products = row["m"], np.array(row["sums"]), np.array(row["products"])
            mean = sums / n
            cov = np.zeros((p, p))
            cov[upper] = products / n
            cov = (cov + np.triu(cov, 1).T - np.outer(mean, mean)) * consistency
            out["_group"].append(row["_group"])
            out["center"].append(mean.tolist())
            out["inverse"].append(inverse_scatter(cov, floors).ravel().tolist())
            out["n"].append(row["n"])
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("_group", pa.string()), ("center", pa.list_(pa.float64())), ("inverse", pa.list_(pa.float64())), ("n", pa.int64())]))


def _group_keys() -> list[Column]:
    """The keys of a row's groups, from the finest to the whole corpus."""
    return [
        F.to_json(F.struct(F.lit(2).alias("k"), F.col("lang").alias("l"), F.col("source").alias("s"))),
        F.to_json(F.struct(F.lit(1).alias("k"), F.col("lang").alias("l"))),
        F.lit("all"),
    ]


def estimates(vectors: DataFrame) -> DataFrame:
    """``_group``, ``center``, ``inverse`` of the groups large enough; ``vectors`` has lang, source, x0, x1, ..."""
    p = len(FEATURES)
    names = [f"x{i}" for i in range(p)]
    rows = written(
        vectors.select(F.explode(F.array(*_group_keys())).alias("_group"), *names), "quality_vectors"
    )
    floors = list(FEATURES.values())
    spread = [F.expr(f"percentile_approx(x{i}, array(0.25, 0.5, 0.75), 10000)").alias(f"q{i}") for i in range(p)]
    start = rows.groupBy("_group").agg(F.count(F.lit(1)).alias("n"), *spread).where(F.col("n") >= LEAST_ROWS)
    scale = [F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(floors[i])) for i in range(p)]
    zero = F.lit(0.0)
    state = start.select(
        "_group", F.array(*[F.col(f"q{i}")[1] for i in range(p)]).alias("center"),
        F.array(*[1.0 / (scale[i] * scale[i]) if i == j else zero for i in range(p) for j in range(p)]).alias("inverse"), "n",
    )
    xs = [F.col(x) for x in names]
    for _ in range(STEPS):
        state = written(state, "quality_state")
        measured = rows.join(state, "_group").select("_group", "n", *names, _distance(F.col("center"), F.col("inverse"), xs).alias("d"))
        # the quantile by classes of distance, a sixteenth of a power of two wide, with the moments of each class
        classed = measured.withColumn("class", F.floor(16 * F.log2(F.col("d") + 1e-9)))
        moments = classed.groupBy("_group", "class").agg(
            F.max("n").alias("n"), F.count(F.lit(1)).alias("m"), *[F.sum(x).alias(f"s_{x}") for x in names],
            *[F.sum(xs[i] * xs[j]).alias(f"p_{i}_{j}") for i in range(p) for j in range(i, p)],
        )
        moments = written(moments, "quality_moments")  # some hundred classes a group
        before = F.sum("m").over(Window.partitionBy("_group").orderBy("class")) - F.col("m")
        near = moments.withColumn("before", before).where(F.col("before") < SUPPORT * F.col("n"))
        total = near.groupBy("_group").agg(
            F.max("n").alias("n"), F.sum("m").alias("m"), F.array(*[F.sum(f"s_{x}") for x in names]).alias("sums"),
            F.array(*[F.sum(f"p_{i}_{j}") for i in range(p) for j in range(i, p)]).alias("products"),
        )
        state = total.mapInArrow(_scatter_to_inverse, "_group string, center array<double>, inverse array<double>, n long")
    return written(state.select("_group", "center", "inverse"), "quality_estimates")


def judged(docs: DataFrame) -> DataFrame:
    """``docs`` with columns ``_q_<statistic>``, ``_q_base_failed``, ``_q_distance`` and ``_q_kept``.

    The verdict is worked out on the row itself, once the estimates are known, so rows are neither shuffled nor
    joined by id.
    """
    xs = _features()
    vectors = _with_stats(docs.select("text", "lang", "source")).where(~_base_failed()).select(
        "lang", "source", *[x.alias(f"x{i}") for i, x in enumerate(xs)]
    )
    vectors = written(vectors, "quality_stats")
    found = estimates(vectors)
    # the finest estimates of every (language, source): one row each
    keys = _group_keys()
    pairs = vectors.select("lang", "source").distinct().select(
        *[k.alias(f"k{i}") for i, k in enumerate(keys)]
    )
    known = pairs.select(F.col("k0").alias("_pair"), F.posexplode(F.array("k0", "k1", "k2")).alias("level", "_group")).join(found, "_group")
    best = written(
        known.groupBy("_pair").agg(F.min_by(F.struct("center", "inverse"), "level").alias("best")).select("_pair", F.col("best.center").alias("_center"), F.col("best.inverse").alias("_inverse")),
        "quality_best",
    )
    cut = chi2_quantile(1 - TAIL, len(xs))
    out = _with_stats(docs).withColumn("_q_key", keys[0])
    out = out.join(best, out["_q_key"] == best["_pair"], "left")
    out = out.withColumn("_q_base_failed", _base_failed()).withColumn("_q_distance", _distance(F.col("_center"), F.col("_inverse"), xs))
    kept = ~F.col("_q_base_failed") & (F.coalesce(F.col("_q_distance"), F.lit(0.0)) <= cut)
    return out.withColumn("_q_kept", kept).drop("_q_key", "_pair", "_center", "_inverse")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns."""
    return judged(docs).where("_q_kept").select(*docs.columns)


def quality_report(docs: DataFrame) -> DataFrame:
    columns = [F.col(f"_q_{s}").alias(s) for s in STATS[:5]]
    return judged(docs.select("doc_id", "text", "lang", "source")).select(
        "doc_id", *columns, F.col("_q_base_failed").alias("base_failed"), F.col("_q_kept").alias("kept"), F.col("_q_distance").alias("distance"),
    )
