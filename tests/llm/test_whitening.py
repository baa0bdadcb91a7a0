"""Whitening against a dense eigensolver, and its solver on made matrices."""

import math

import numpy as np
import pytest

from larkspur.llm import whitening
from larkspur.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, x string, part long, n long, component int"


def dense(vectors):
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    far = n * x - sums
    z = far.astype(float) / n
    values, u = np.linalg.eigh(z.T @ z / n)
    return n, (far**2).sum(axis=1), z, values[::-1], u[:, ::-1]


def check(rows, ids, vectors, k, close=1e-8):
    n, deviation, z, values, u = dense(vectors)
    want = z @ u[:, :k] / np.sqrt(values[:k])
    assert len(rows) == len(vectors) * k
    by = {(r.vec_id, r.component): r for r in rows}
    got = np.array([[by[i, c].whitened for c in range(1, k + 1)] for i in ids])
    assert np.abs(got * np.sign((got * want).sum(axis=0)) - want).max() < close
    assert [by[i, 1].deviation for i in ids] == deviation.tolist()
    assert all(r.n == n and r.identity_error < 1e-9 for r in rows)
    assert np.allclose([by[ids[0], c].explained for c in range(1, k + 1)], values[:k] / values.sum(), rtol=1e-9)


def test_whole_table(spark, sf):
    given = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    check(QUERIES["op11_whitening"](spark, sf).collect(), [r.vec_id for r in given], [r.embedding for r in given], 8)


def test_defined_cases(spark):
    rng = np.random.default_rng(1)
    fine = [[float(np.float32(c)) for c in v] for v in rng.normal(size=(40, 5)) * [9, 5, 3, 2, 1]]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [nan] * 5, [1.0, None, 0.0, 0.0, 0.0], [inf, 0.0, 0.0, 0.0, 0.0], [-inf] * 5, [1.0, 2.0]]
    rows = [(i, v, "x", 1, 2, 3) for i, v in enumerate(fine)] + [(100 + i, v, None, None, None, None) for i, v in enumerate(odd)]
    check(whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect(), range(40), fine, 5)
    twice = spark.createDataFrame([*rows, (0, fine[0], "x", 1, 2, 3), (None, fine[1], "x", 1, 2, 3)], SCHEMA)
    got = whitening.whiten(twice).collect()
    assert sum(r.vec_id == 0 for r in got) == 10 and sum(r.vec_id is None for r in got) == 5 and got[0].n == 42
    for none in ([], rows[40:46], [(1, [2.0, 3.0], None, None, None, None)] * 9):
        assert whitening.whiten(spark.createDataFrame(none, SCHEMA)).collect() == []
    flat = spark.createDataFrame([(i, [float(i), 0.0, 2.0 * i], None, None, None, None) for i in range(9)], SCHEMA)
    assert {r.component for r in whitening.whiten(flat).collect()} == {1}
    huge = spark.createDataFrame([(i, [1e30 * (-1) ** i, float(i)], None, None, None, None) for i in range(6)], SCHEMA)
    assert {r.deviation for r in whitening.whiten(huge).collect()} == {None}


@pytest.mark.parametrize("size", [1, 7, 30, 300])
def test_solver(size):
    """Ties, gaps and clusters; most of the work of a large one is outside the subspace."""
    rng = np.random.default_rng(size)
    q, _ = np.linalg.qr(rng.standard_normal((size, size)))
    values = np.sort(np.r_[[9.0, 9.0, 5.0, 4.99][: min(size, 4)], rng.random(max(0, size - 4))])[::-1]
    matrix = q * values @ q.T
    matrix = (matrix + matrix.T) / 2
    counts = []

    def product(b):
        counts.append(b.shape[1])
        return matrix @ b

    theta, pairs = whitening.eigenpairs(product, size, 3)
    k = min(3, size)
    assert np.allclose(theta, values[:k], rtol=1e-13, atol=0)
    assert np.linalg.norm(matrix @ pairs - pairs * theta) < 1e-12 * values[0]
    assert np.allclose(pairs.T @ pairs, np.eye(k), atol=1e-13)
    assert len(counts) < 250
