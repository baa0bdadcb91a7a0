"""Batches against one pass in order."""

import random

import pytest

from larkspur.operators import batches


def _one_pass(sizes, most, limit):
    out, n, held, batch = [], 0, 0, 0
    for size in sizes:
        if n >= most or n and held + size > limit:
            batch, n, held = batch + 1, 0, 0
        n, held = n + 1, held + size
        out.append(batch)
    return out


@pytest.mark.parametrize("seed,block,most,limit", [(1, 4096, 64, 500), (2, 7, 5, 100), (3, 3, 8, 300), (4, 16, 1, 10), (5, 5, 40, 10**9)])
def test_like_one_pass(spark, monkeypatch, seed, block, most, limit):
    monkeypatch.setattr(batches, "BLOCK", block)
    rng = random.Random(seed)
    rows = [(f"p{i:05}", rng.choice([0, 1, 7, 60, 400, None])) for i in range(300)]
    for parts in (1, 5):
        df = spark.createDataFrame(rng.sample(rows, len(rows)), "path string, bytes long").repartition(parts)
        got = sorted((r.path, r.pos, r.batch) for r in batches.batched(df, ("path",), "bytes", most, limit).collect())
        want = _one_pass([max(0, s or 0) for _, s in rows], most, limit)
        assert got == [(p, i, b) for i, ((p, _), b) in enumerate(zip(rows, want))]


def test_empty(spark):
    assert batches.batched(spark.createDataFrame([], "path string, bytes long"), ("path",)).collect() == []
