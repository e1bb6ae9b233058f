"""Incremental eigendecomposition and whitening against numpy on the whole table."""

import math
from fractions import Fraction

import numpy as np
import pytest

from cohortloom.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, component string, n string, part string"


@pytest.mark.parametrize("lanes", [1, 2, 7])
@pytest.mark.parametrize("kind", ["normal", "graded", "dependent", "copies", "axes", "one", "nothing", "long"])
def test_spectra(lanes, kind):
    rng = np.random.default_rng(5)
    y = {
        "normal": lambda: rng.normal(size=(200, 12)) * np.arange(1, 13),
        "graded": lambda: rng.normal(size=(90, 14)) * 10.0 ** -np.arange(14),
        "dependent": lambda: rng.normal(size=(80, 3)) @ rng.normal(size=(3, 9)),
        "copies": lambda: np.repeat(rng.normal(size=(4, 6)), 20, axis=0),
        "axes": lambda: np.repeat(np.eye(6), 5, axis=0),
        "one": lambda: rng.normal(size=(30, 1)),
        "nothing": lambda: np.zeros((10, 4)),
        "long": lambda: rng.normal(size=(3, 5)) * 1e8,
    }[kind]()
    spectra = W.Spectra.empty(lanes, y.shape[1])
    for at in range(0, len(y), lanes):
        part = y[at : at + lanes]
        spectra.update(np.concatenate([part, np.zeros((lanes - len(part), y.shape[1]))]))
    one = spectra.combined()
    matrix, v = y.T @ y, one.vectors[0]
    size = max(np.abs(matrix).max(), 1e-300)
    assert np.abs(v.T @ v - np.eye(y.shape[1])).max() < 1e-12
    assert np.abs(one.values[0] - np.linalg.eigvalsh(matrix)).max() < 1e-12 * size * len(y)
    assert np.abs(matrix @ v - v * one.values[0]).max() < 1e-12 * size * len(y)


def report(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, "own", "own", "own") for i, v in rows], SCHEMA).repartition(4)
    return W.whitening_report(df, **kw).collect()


def integers(v):
    return [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]


def check(found, kept, components=16):
    xs = {i: integers(v) for i, v in kept}
    fit = sorted({tuple(integers(v)) for _, v in kept})
    n, d = len(fit), len(fit[0])
    sums = [sum(c) for c in zip(*fit)]
    centred = np.array([[float(Fraction(a) - Fraction(s, n)) for a, s in zip(x, sums)] for x in fit])
    cov = centred.T @ centred / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1], q[:, ::-1]
    by = {}
    for r in found:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    assert by.keys() == xs.keys()
    k = min(components, d)
    for i, x in xs.items():
        assert sorted(by[i]) == list(range(1, k + 1))
        y = np.array([float(Fraction(a) - Fraction(s, n)) for a, s in zip(x, sums)])
        for j in range(k):
            r = by[i][j + 1]
            assert r["n"] == n and r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x, sums))
            assert r["identity_error"] < 1e-9
            assert abs(r["explained"] - e[j] / e.sum()) < 1e-9 * e[j] / e.sum() + 1e-12
            if e[j] > 1e-9 * e[0]:
                assert abs(abs(r["whitened"]) - abs(y @ q[:, j]) / math.sqrt(e[j])) < 1e-7
    # one sign for all rows
    for j in range(k):
        if e[j] > 1e-9 * e[0]:
            signs = {np.sign(by[i][j + 1]["whitened"] * ((np.array(x) - np.array(sums) / n) @ q[:, j])) for i, x in xs.items() if abs(by[i][j + 1]["whitened"]) > 1e-5}
            assert len(signs) <= 1


def test_report(spark):
    rng = np.random.default_rng(8)
    kept = [(i, (rng.normal(size=24) * np.linspace(0.2, 3, 24)).tolist()) for i in range(300)]
    kept += [(400 + i, kept[7][1]) for i in range(150)]  # copies count once
    odd = [(900, None), (901, [None] + [1.0] * 23), (902, [math.nan] * 24), (903, [math.inf] * 24), (904, [1.0] * 5), (905, [])]
    check(report(spark, kept + odd), kept)


def test_few_dimensions_and_dependent_ones(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(60, 2)) * 4
    rows = [(i, [float(a), float(b), float(a), 0.5]) for i, (a, b) in enumerate(np.round(base, 1))]
    found = report(spark, rows)
    check([r for r in found], rows)
    last = [r for r in found if r["component"] == 4]
    assert all(r["whitened"] is None and r["explained"] == 0 for r in last)


def test_one_vector_and_nothing(spark):
    found = report(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])])
    assert {(r["vec_id"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in found} == {(i, 1, 0, None, 0.0, 0.0) for i in (1, 2, None)}
    assert report(spark, []) == [] and report(spark, [(1, None), (2, [])]) == []


def test_named_dimensions(spark):
    rows = [(1, [1.0]), (2, [2.0]), (3, [1.0, 2.0]), (4, [3.0, 1.0]), (5, [5.0, 1.5])]
    assert {r["vec_id"] for r in report(spark, rows, dimensions=1)} == {1, 2}
    assert {r["vec_id"] for r in report(spark, rows)} == {3, 4, 5}


def test_many_tasks_combine_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(W, "FAN_IN", 3)
    rng = np.random.default_rng(10)
    kept = [(i, (rng.normal(size=6) * [1, 2, 3, 4, 5, 6]).tolist()) for i in range(200)]
    check(report(spark, kept), kept)
