"""Whitening against exact sums and a library's eigenvectors, and on odd rows."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from curatrix.llm import whitening


def made(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string, x string, n string")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [[rng.gauss(0, 3) * (k + 1) ** -0.5 + rng.gauss(0, 0.2) for k in range(24)] for _ in range(300)]
    out = [(i, v, "c", "x", "n") for i, v in enumerate(base)]
    out += [(1000 + i, base[7], None, None, None) for i in range(200)]  # copies, a third of the rows
    out += [(2000, None, "c", "x", "n"), (2001, [], "c", "x", "n"), (2002, [1.0, None] * 12, "c", "x", "n"), (2003, [math.nan] * 24, "c", "x", "n"), (2004, [math.inf] * 24, "c", "x", "n"), (2005, [1.0] * 23, "c", "x", "n"), (2006, [1e20] * 24, "c", "x", "n"), (None, base[9], "c", "x", "n"), (3, base[3], "c", "x", "n")]
    return out


def test_rows_against_brute_force(spark, rows):
    found = whitening.whiten(made(spark, rows)).collect()
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v, *_ in rows if v and len(v) == 24 and None not in v and all(math.isfinite(c) and abs(c) < 1e19 for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(x) for x in zip(*fit)]
    centred = np.array([[(n * x - s) / n for x, s in zip(v, sums)] for v in fit])
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:16], vectors[:, ::-1][:, :16]
    assert len(found) == 16 * len(kept) and {r.n for r in found} == {n}
    deviation = {(i, sum((n * a - s) ** 2 for a, s in zip(x, sums))) for i, x in kept}
    assert {(r.vec_id, int(r.deviation)) for r in found} == deviation
    for k in range(16):
        mine = {(r.vec_id, int(r.deviation)): r.whitened for r in found if r.component == k + 1}
        theirs = {(i, sum((n * a - s) ** 2 for a, s in zip(x, sums))): float(np.array([(n * a - s) / n for a, s in zip(x, sums)]) @ vectors[:, k] / math.sqrt(values[k])) for i, x in kept}
        sign = 1 if sum(mine[key] * theirs[key] for key in mine) > 0 else -1
        assert max(abs(mine[key] - sign * theirs[key]) for key in mine) < 1e-9
        assert abs({r.explained for r in found if r.component == k + 1}.pop() - values[k] / np.trace(covariance)) < 1e-12
    assert {r.identity_error for r in found}.pop() < 1e-10


@pytest.mark.parametrize("rows", [[], [(1, None, "c", "x", "n")], [(1, [1.0, 2.0], "c", "x", "n"), (2, [1.0, 2.0], "c", "x", "n")]])
def test_no_components(spark, rows):
    assert whitening.whiten(made(spark, rows)).collect() == []


def test_large_sums_are_exact(spark):
    rows = [(i, [float(1 << 45) * (-1) ** i + i, float(i)], "c", "x", "n") for i in range(40)]
    found = {r.vec_id: int(r.deviation) for r in whitening.whiten(made(spark, rows)).collect()}
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v, *_ in rows]
    assert found == {i: sum((40 * a - s) ** 2 for a, s in zip(v, [sum(c) for c in zip(*x)])) for i, v in enumerate(x)}


@pytest.mark.parametrize("kind", ["random", "repeated", "diagonal", "lowrank", "graded", "one", "large"])
def test_principal(kind):
    rng = np.random.default_rng(3)
    n = 1 if kind == "one" else 200 if kind == "large" else 30
    a = rng.normal(size=(n, n))
    q = np.linalg.qr(a)[0]
    matrix = {"random": a @ a.T, "large": a @ a.T, "one": np.array([[2.5]]), "diagonal": np.diag(np.arange(n) + 1.0), "repeated": q @ np.diag([5.0] * 6 + [2.0] * 10 + [1.0] * (n - 16) if n > 16 else [1.0]) @ q.T, "lowrank": (x := a[:, :4]) @ x.T, "graded": q @ np.diag(10.0 ** -np.linspace(0, 10, n)) @ q.T}[kind]
    matrix = (matrix + matrix.T) / 2
    values, vectors = whitening.principal(matrix, 16)
    true = np.linalg.eigvalsh(matrix)[::-1]
    assert len(values) == (4 if kind == "lowrank" else min(16, n))
    assert np.abs(values - true[: len(values)]).max() < 1e-13 * n * true[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-9
    assert np.abs(matrix @ vectors - vectors * values).max() < 1e-12 * n * true[0]


def test_sturm_counts():
    rng = np.random.default_rng(4)
    d, e = rng.normal(size=12), rng.normal(size=11)
    true = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    at = rng.normal(size=50) * 3
    assert whitening.below(d, e, at).tolist() == [(true < x).sum() for x in at]
