"""What plans do once, and what is dealt out, where it was once done many times or by one task."""

import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types

from larkspur.functions import chunking, lexicons
from larkspur.functions import text as X
from larkspur.operators import evaluation, lexical, memory, text_index
from larkspur.sources.staged import spread


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def one_file(spark, tmp_path, rows, schema):
    path = str(tmp_path / "rows.parquet")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def test_categories_are_counted_once(spark, tmp_path):
    texts = one_file(spark, tmp_path, [(i, "I prefer tea over coffee. We decided to go home now.") for i in range(50)], "id long, text string")
    assert spread(texts).rdd.getNumPartitions() >= 12 > texts.rdd.getNumPartitions()
    found = memory.extracted(texts).select("id", "n", "text", "category")
    assert optimized(found).count("growing up") == 1
    assert found.rdd.getNumPartitions() >= 12
    assert {(r.n, r.category) for r in found.collect()} == {(0, "preference"), (1, "decision")} and found.count() == 100
    scored = texts.select(X.importance(F.col("text"), X.category(F.col("text"))).alias("v"))
    assert optimized(scored).count("growing up") == 1 and optimized(scored).count("regexp_extract_all") == 1


def test_answers_are_cut_once(spark, tmp_path):
    texts = one_file(spark, tmp_path, [(1, "go go home")], "id long, text string")
    found = texts.select(evaluation.token_f1(F.col("text"), F.lit("we go home now")).alias("f"))
    assert optimized(found).count("lower(text") == 1
    assert found.first().f == pytest.approx(4 / 7)


def test_boundaries_are_ascii(spark):
    patterns = [r"\ba?b\b", r"\b[A-Z]*x\b", r"(?i)\bi prefer\b", r"\b[A-Z][a-z]+ is\b", r"\bab|c\b", r"\ba|b"]
    patterns += [p for ps in lexicons.CATEGORY_PATTERNS.values() for p in ps]
    texts = ["b", "aab", "xb", "-ab", "éab", "i prefer", "I preferé", "éi prefer", "_i prefer", "xI prefer!", "é Ann is", "XAnn is", "cab", "Xx", "9x", "x", "", "ab", "zb"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for p in patterns:
        got = [r[0] for r in rows.select(X.matches(F.col("text"), p)).collect()]
        assert got == [re.search(p, t, re.ASCII) is not None for t in texts], p


def test_texts_are_lowered_once_and_dealt_out(spark, tmp_path, monkeypatch):
    docs = one_file(spark, tmp_path, [(i, "Apples and Pears " * (i + 1)) for i in range(40)], "id long, body string")
    boost = docs.select((X.keyword_boost(F.lit("apples pears plums"), F.col("body")) * X.phrase_boost(F.lit('"and pears"'), F.col("body"))).alias("b"))
    plan = optimized(boost)
    assert all(not re.search(r"lambdafunction\([^()]*\(?lower\(body", x) for x in plan.splitlines()) and plan.count("lower(body") == 2
    assert {round(r.b, 6) for r in boost.collect()} == {1.92}
    a, b = (docs.select(F.col("id").alias(n), F.col("body").alias(n + "b")) for n in ("x", "y"))
    assert spread(a.join(b, a.x == b.y)).rdd.getNumPartitions() < 1000  # not by the product of both sizes
    seen = []
    kept = text_index._postings
    monkeypatch.setattr(text_index, "_postings", lambda d, *a: seen.append(d.rdd.getNumPartitions()) or kept(d, *a))
    monkeypatch.setattr(text_index, "_written", lambda ranged, *a: seen.append("MapInArrow" in optimized(ranged)))
    text_index.upsert(docs, str(tmp_path / "index"), weights={"body": 1.0}, key="id")
    assert seen[0] >= 12 and seen[1] is False


def test_scores_are_summed_in_many_tasks(spark, tmp_path):
    docs = one_file(spark, tmp_path, [(i, "", "", "red blue " + ("green " * (i % 3)) + f"w{i}") for i in range(60)], "doc_id long, path string, title string, body string")
    terms = spark.createDataFrame([(1, "red"), (1, "green"), (2, "w7"), (3, "blue"), (3, "w9")], "query_id long, term string")
    barred = spark.createDataFrame([(1, "green"), (3, "w8"), (3, "blue"), (2, "none")], "query_id long, term string")
    found = lexical.bm25(docs, terms, barred=barred)
    assert found.rdd.getNumPartitions() >= 12
    assert sorted((r.query_id, r.doc_id) for r in found.collect()) == [(1, i) for i in range(0, 60, 3)] + [(2, 7)]
    every = {(r.query_id, r.doc_id): r.score for r in lexical.bm25(docs, terms).collect()}
    assert len(every) == 121 and all(every[r.query_id, r.doc_id] == r.score for r in found.collect())


def test_chunks_are_cut_a_few_documents_at_a_time():
    class Docs:
        schema = types.StructType.fromDDL("id long, body string")
        select = lambda self, *_: self
        mapInArrow = lambda self, run, _: run

    batch = pa.RecordBatch.from_pydict({"id": list(range(1000)), "body": [f"{i} " * 300 for i in range(1000)]})
    parts = list(chunking.chunked(Docs(), "id", 200, 20, 50)(iter([batch])))
    assert len(parts) > 10 and max(len(set(p.column("id").to_pylist())) for p in parts) <= 64
    whole = [(i, n, p, c) for i in range(1000) for n, (p, c) in enumerate(chunking.chunks(f"{i} " * 300, 200, 20, 50))]
    assert [tuple(r.values()) for p in parts for r in p.to_pylist()] == whole
