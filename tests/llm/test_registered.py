"""The registered opN queries and the pipeline beside their SQL or brute force."""

import hashlib
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
sys.path.insert(0, str(Path(__file__).parent))
import oracle
from test_documents import WORD, _components, _fp, library
from test_models import _removed

import corpus_pipeline
from larkspur.llm import mixing
from larkspur.llm.queries import ORACLE_SQL, QUERIES


def _documents(sf):
    rows = oracle.duck(sf).sql("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id").fetchall()
    return [r[0] for r in rows], [r[1] for r in rows]


def _rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, sf, name):
    assert oracle.compare(spark, sf, QUERIES[name], ORACLE_SQL[name])


def test_op1_against_the_library(spark, sf):
    ids, texts = _documents(sf)
    start, want = 0, []
    for doc, e in zip(ids, library("word_bpe_49k.json").encode_batch(texts, add_special_tokens=False)):
        packed = np.array([*e.ids, 2], "<u4")
        want.append((doc, start, len(packed), zlib.crc32(packed.tobytes())))
        start += len(packed)
    assert _rows(QUERIES["op1_token_binary"](spark, sf), "doc_id", "start", "n_tokens", "ids_crc32") == want


def test_op4_against_the_library(spark, sf):
    tokenizer, sha = library("byte_bpe_50k.json"), lambda b: hashlib.sha256(b).hexdigest()
    ids, texts = _documents(sf)
    want = []
    for doc, e in zip(ids, tokenizer.encode_batch(texts, add_special_tokens=False)):
        want.append((doc, len(e.ids), sha(np.array(e.ids, "<u4").tobytes()), sha(tokenizer.decode(e.ids, skip_special_tokens=False).encode())))
    assert _rows(QUERIES["op4_bpe_lexicon"](spark, sf), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_op5_against_brute_force(spark, sf):
    ids, texts = _documents(sf)
    want = sorted((doc, *x) for doc, x in zip(ids, _removed([t.encode() for t in texts])))
    assert _rows(QUERIES["op5_suffix_dedup"](spark, sf), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_op6_meets_its_targets(spark, sf):
    rows = QUERIES["op6_mixing"](spark, sf).collect()
    ids, texts = _documents(sf)
    assert sorted((r.doc_id, r["size"]) for r in rows) == [(i, len(WORD.findall(t))) for i, t in zip(ids, texts)]
    assert all(0 <= r.taken <= 3 * r["size"] for r in rows)
    taken, goal = Counter(), {}
    for r in rows:
        taken[r.source_size, r.target] += r.taken
        goal[r.source_size, r.target] = r.target
    assert all(abs(taken[k] - g) <= 4 * mixing.BLOCK for k, g in goal.items())
    assert _rows(QUERIES["op6_mixing"](spark, sf), "doc_id", "taken") == sorted((r.doc_id, r.taken) for r in rows)


def test_op7_against_brute_force(spark, sf):
    ids, texts = _documents(sf)
    prints = [(i, _fp(t)) for i, t in zip(ids, texts)]
    names = _components(prints)
    assert _rows(QUERIES["op7_simhash"](spark, sf), "doc_id", "fingerprint", "component_id") == sorted((i, f"{f:016x}", names[f]) for i, f in prints)


def test_op8_and_op9_score_every_row(spark, sf):
    ids, _ = _documents(sf)
    scored = QUERIES["op8_lm_scoring"](spark, sf).collect()
    assert sorted(r.doc_id for r in scored) == ids and all((r.difference is None) == (not r.n_tokens) for r in scored)
    toxic = QUERIES["op9_toxicity"](spark, sf).collect()
    assert sorted(r.doc_id for r in toxic) == ids
    for r in toxic:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_pipeline_in_order(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, stages = zip(*corpus_pipeline.STAGES)
    assert names == ("quality", "exact", "near", "mix", "encode")
    good = stages[0](spark, docs, sf)
    kept = {r[0] for r in oracle.duck(sf).sql(f"SELECT doc_id FROM ({ORACLE_SQL['op2_quality_rules']}) WHERE kept").fetchall()}
    assert good.columns == docs.columns and sorted(r.doc_id for r in good.collect()) == sorted(kept)
    last = {}
    for r in sorted(good.collect(), key=lambda r: r.doc_id):
        last[r.text or ""] = r
    exact = stages[1](spark, good, sf)
    assert sorted(map(tuple, exact.collect())) == sorted(map(tuple, last.values()))
    near = stages[2](spark, exact, sf)
    prints = [(r.doc_id, _fp(r.text)) for r in last.values()]
    first = set(_components(prints).values())
    assert sorted(map(tuple, near.collect())) == sorted(tuple(r) for r in last.values() if r.doc_id in first)
    mixed = stages[3](spark, near, sf)
    rows = mixed.collect()
    words, texts = Counter(), {r.doc_id: r.text or "" for r in near.collect()}
    for r in rows:
        words[r.doc_id] += len(WORD.findall(r.text))
        assert all(part in texts[r.doc_id] for part in r.text.split("\n"))
    sizes = Counter()
    for r in near.collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    goal, got = mixing.targets(dict(sizes)), Counter()
    source = {r.doc_id: r.source for r in near.collect()}
    for doc, n in words.items():
        got[source[doc]] += n
    assert mixed.columns == docs.columns and all(abs(got[s] - g) <= 4 * mixing.BLOCK for s, g in goal.items())
    tokenizer = library("byte_bpe_50k.json")
    ids = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch([r.text for r in rows], add_special_tokens=False)]
    want = sorted((r.doc_id, i, len(i) // 4) for r, i in zip(rows, ids))
    out = corpus_pipeline.run(spark, sf)
    assert sorted((r.doc_id, bytes(r.ids), r.n_tokens) for r in out.collect()) == want


CLASH = ["__k1", "__k2", "passes", "rest", "row", "band", "runs", "_q_n_words", "_q_host", "_q_kept", "_text", "__text", "fp", "key", "member", "members", "best", "host", "copy", "block", "Doc"]


def test_stages_with_clashing_columns(spark, sf, tmp_path):
    plain = spark.read.parquet(f"{sf}/documents.parquet")
    odd = plain.selectExpr("*", *[f"concat('{c}', doc_id) AS `{c}`" for c in CLASH])
    for name, stage in corpus_pipeline.STAGES[:4]:
        want, got = stage(spark, plain, sf), stage(spark, odd, sf)
        assert got.columns == odd.columns
        rows = got.collect()
        assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in CLASH)
        if name != "mix":  # whose draws follow the rows' content
            assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in want.collect())
        plain, odd = want, got
    assert corpus_pipeline.STAGES[4][1](spark, odd, sf).count() == odd.count()


def test_pipeline_of_an_empty_table(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
