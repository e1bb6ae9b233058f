"""K-means by Orchard's search against plain Python over all distances."""

import hashlib
import math
import random

import numpy as np
import pytest

from cohortloom.llm import orchard as O

SCHEMA = "vec_id long, embedding array<float>, cluster string, distance string, x string"


def brute(rows, dims=64, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(np.float32(c))) for c in v]) for i, v in rows
            if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    if not kept:
        return []
    start = sorted((i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "", x) for i, x in kept)[:k]
    cents = [x for _, _, x in start]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(cents))

    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(near(x)[1], []).append(x)
        cents = [[sum(col) // len(groups[n]) for col in zip(*groups[n])] if n in groups else c for n, c in enumerate(cents)]
    found = [(i, *near(x)) for i, x in kept]
    inertia = sum(d for _, d, _ in found)
    each = {n: sum(d for _, d, m in found if m == n) for n in range(len(cents))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, n, d, each[n], inertia, sha[n]) for i, d, n in found), key=str)


def report(spark, rows):
    df = spark.createDataFrame([(i, v, "own", "own", "own") for i, v in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in O.cluster_report(df).collect()), key=str)


def test_against_all_distances(spark):
    rng = random.Random(1)
    centres = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.3) for c in rng.choice(centres)]) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(60)]  # copies, some with one id
    rows += [(200, rows[3][1]), (None, rows[4][1]), (None, rows[5][1])]
    rows += [(300, None), (301, []), (302, [1.0] * 63), (303, [None] + [1.0] * 63), (304, [math.nan] + [1.0] * 63), (305, [math.inf] + [1.0] * 63), (306, [1.0] * 65)]
    assert report(spark, rows) == brute(rows)


def test_few_vectors_and_ties(spark):
    rows = [(1, [0.0] * 64), (2, [0.0] * 64), (3, [2.0] + [0.0] * 63)]
    assert report(spark, rows) == brute(rows)
    assert report(spark, []) == [] and report(spark, [(1, None)]) == []


@pytest.mark.parametrize("d", [1, 2, 5])
def test_search_on_grids(d):
    """Many equal distances: the smaller number wins."""
    rng = np.random.default_rng(d)
    for k in (1, 2, 7, 30):
        cents = rng.integers(-3, 4, (k, d))
        x = rng.integers(-5, 6, (300, d))
        cluster, distance = O.Orchard(cents.tolist()).nearest(x)
        all_ = ((x[:, None] - cents[None]) ** 2).sum(2)
        assert (cluster == all_.argmin(1)).all() and (distance == all_.min(1)).all()


def test_search_skips_far_centroids(monkeypatch):
    """Vectors near their centroid are compared with few others."""
    cents = np.arange(50)[:, None] * 1000
    found = O.Orchard(cents.tolist())
    x = np.repeat(cents, 3, axis=0) + 1
    assert (found.nearest(x)[0] == np.repeat(np.arange(50), 3)).all()
    assert (found.apart[:, 0] == 1000**2).all() and (np.diff(found.apart, axis=1) >= 0).all()


def test_too_large(spark):
    with pytest.raises(Exception, match="too large"):
        report(spark, [(1, [1e9] * 64), (2, [0.0] * 64)])
