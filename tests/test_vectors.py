"""The block join of vectors against brute force."""

import numpy as np
import pyarrow as pa
import pytest

from larkspur.operators import vectors


def _table(spark, name, ids, m, scope=None):
    columns = {name: pa.array(ids), "embedding": pa.array(list(m), pa.list_(pa.float64()))}
    if scope is not None:
        columns["scope"] = pa.array(scope)
    return spark.createDataFrame(pa.table(columns)).repartition(4)


def _brute(q, m, k, qs=None, ms=None):
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    out = []
    for at in range(0, len(q), 2000):
        sims = np.round(unit(q[at : at + 2000]) @ unit(m).T, 6)
        if qs is not None:
            sims[qs[at : at + 2000, None] != ms[None, :]] = -np.inf
        best = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        out += [(at + i, int(j), float(sims[i, j])) for i, row in enumerate(best) for j in row if sims[i, j] > -np.inf]
    return out


def _same(got, want):
    """Equal but for products whose last digit falls on either side of a rounding."""
    a, b = (sorted((q, -s, i) for q, i, s in x) for x in (got, want))
    assert len(a) == len(b)
    assert all(x[0] == y[0] and abs(x[1] - y[1]) < 2e-6 for x, y in zip(a, b))
    assert sum(x[2] != y[2] for x, y in zip(a, b)) <= len(a) / 1000


def test_hundred_thousand_queries(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 8)) * 4
    m, q = (centres[rng.integers(0, 40, n)] + rng.standard_normal((n, 8)) * 0.2 for n in (8000, 100_000))
    pairs = []
    got = vectors.nearest(_table(spark, "query_id", range(len(q)), q), _table(spark, "id", range(len(m)), m), 3, pairs=pairs)
    _same([tuple(r) for r in got.select("query_id", "id", "similarity").toArrow().to_pandas().itertuples(index=False)], _brute(q, m, 3))
    assert pairs[0] < pairs[1] / 2, pairs


@pytest.mark.parametrize("scoped", [False, True])
def test_defined_cases(spark, monkeypatch, scoped):
    """No length, ties, copies, missing vectors, few of a scope, and several groups and streams."""
    for name, value in (("BLOCK", 16), ("GROUP", 40), ("STREAM", 2), ("SEEDS", 1), ("BATCH", 3)):
        monkeypatch.setattr(vectors, name, value)
    rng = np.random.default_rng(2)
    m = np.round(rng.standard_normal((400, 4)) * 2)
    m[:5], m[50:80] = 0, m[80]
    q = np.r_[m[::4], np.zeros((2, 4)), rng.standard_normal((30, 4))]
    qs, ms = (rng.integers(0, 3, len(x)) for x in (q, m))
    qs[7], ms[9] = 5, 6
    asked, stored = _table(spark, "query_id", range(len(q)), q, qs), _table(spark, "id", range(len(m)), m, ms)
    none = spark.createDataFrame([(9999, None, 1)], "id long, embedding array<double>, scope long")
    got = vectors.nearest(asked, stored.unionByName(none), 9, scoped)
    _same([tuple(r) for r in got.select("query_id", "id", "similarity").collect()], _brute(q, m, 9, *((qs, ms) if scoped else ())))
    assert vectors.nearest(asked.limit(0), stored, 3).collect() == [] == vectors.nearest(asked, stored.limit(0), 3).collect()
