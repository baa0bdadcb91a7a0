"""Storing in order against a one-by-one simulation."""

import hashlib

import numpy as np
import pytest

from larkspur.operators import ingest, memory

SCHEMA = "id long, text string, embedding array<double>"


def _one_by_one(stored, incoming, threshold):
    unit = lambda v: np.array(v) / max(np.linalg.norm(v), 1e-300)
    hashed = lambda t: hashlib.md5(t.strip().lower().encode()).hexdigest()
    have = [(i, hashed(t), None if v is None else unit(v)) for i, t, v in stored]
    out = []
    for i, text, v in sorted(incoming):
        if not (text or "").strip():
            out.append((i, "empty", None))
            continue
        same = min((j for j, h, _ in have if h == hashed(text)), default=None)
        near = [] if v is None else [(-round(float(unit(v) @ u), 6), j) for j, _, u in have if u is not None]
        near = min((n for n in near if -n[0] >= threshold), default=None)
        if same is not None or near is not None:
            out.append((i, "duplicate", same if same is not None else near[1]))
        else:
            have.append((i, hashed(text), None if v is None else unit(v)))
            out.append((i, "created", None))
    return sorted(out)


def _made(seed, n, groups, noise):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, 6))
    rows, texts = [], {}
    for i in range(n):
        text = f"memory {rng.integers(0, n // 2)}" if rng.random() < 0.3 else f"memory {n + i}"
        if text not in texts:
            texts[text] = (centres[rng.integers(0, groups)] + rng.standard_normal(6) * noise).tolist()
        rows.append((i, text if rng.random() < 0.5 else f" {text.upper()} ", texts[text]))
    return rows


@pytest.mark.parametrize("seed,groups,noise", [(1, 3, 0.3), (2, 40, 0.6)])
def test_like_one_by_one(spark, seed, groups, noise):
    rows = _made(seed, 300, groups, noise)
    stored, incoming = [(i - 1000, t, v) for i, t, v in rows[:30]], rows[30:]
    incoming += [(900, "", rows[0][2]), (901, None, None), (902, "no vector", None), (903, "No vector ", None), (904, "zero", [0.0] * 6)]
    have = spark.createDataFrame(stored, SCHEMA)
    have = have.withColumn("content_hash", memory.content_hash(have["text"]))
    created, status, touches = ingest.store_in_order(have, spark.createDataFrame(incoming, SCHEMA).repartition(3), 7, 0.9)
    want = _one_by_one(stored, incoming, 0.9)
    assert sorted((r.id, r.status, r.duplicate_id) for r in status.collect()) == want
    assert sorted(r.id for r in created.collect()) == [i for i, s, _ in want if s == "created"]
    assert sum(r.touches for r in touches.collect()) == sum(s == "duplicate" for _, s, _ in want)


def test_extract_and_store(spark):
    texts = [(1, "[1:56 pm on 8 May, 2023] Ann: I prefer dark mode in every editor. We decided to go with Postgres for storage."), (2, "We decided to go with Postgres for storage."), (3, "Nothing.")]
    df = spark.createDataFrame(texts, "id long, text string")
    none = spark.createDataFrame([], SCHEMA + ", content_hash string")
    created, triples, counts = ingest.extracted_and_stored(none, df, 7)
    by = {r.id: (r.stored, r.duplicates) for r in counts.collect()}
    assert by[2] == (0, 1) and by[1][0] >= 2 and 3 not in by
    assert any(r.importance == 0.4 and r.text.startswith("User mentioned") for r in created.collect())
    assert {r.id for r in triples.collect()} <= {1}
