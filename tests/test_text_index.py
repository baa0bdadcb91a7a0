"""The stored index against scans of the texts, through upserts, deletions and compaction."""

import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators import lexical, text_index
from larkspur.sources.staged import fresh

WORDS = [f"w{i}" for i in range(60)] + ["alpha", "beta", "gamma", "été"]
SCHEMA = "doc_id long, path string, title string, body string"


def _docs(seed, ids):
    rng = random.Random(seed)
    pick = lambda n: " ".join(rng.choice(WORDS[: rng.choice([6, 64])]) for _ in range(n))
    return [(i, f"{rng.choice(WORDS)}/{i}.md", rng.choice([None, "", pick(3)]), rng.choice([None, "", pick(5), pick(40), pick(300)])) for i in ids]


def _asked(spark):
    rng = random.Random(9)
    return spark.createDataFrame([(q, t) for q in range(12) for t in rng.sample(WORDS, 3)] + [(3, "nowhere"), (4, "w1")], "query_id long, term string")


def _rows(df):
    return sorted(map(tuple, df.collect()))


def _same(spark, path, docs):
    df = spark.createDataFrame(docs, SCHEMA)
    asked = _asked(spark)
    barred = spark.createDataFrame([(1, "w0"), (2, "w1"), (5, "nowhere")], "query_id long, term string")
    for more in ({}, {"match_all": True}, {"barred": barred}):
        want = lexical.top(lexical.bm25(df, asked, **more), 7)
        got = text_index.search(spark, path, asked, 7, **more)
        assert _rows(got.select(*want.columns)) == _rows(want), more
    phrases = spark.createDataFrame([(1, ["w1", "w2"]), (2, ["w3"]), (3, ["w0", "w0"]), (4, ["w1", "nowhere"]), (5, ["w1", "w2", "w1"]), (6, [])], "query_id long, tokens array<string>")
    assert _rows(text_index.phrase_hits(spark, path, phrases, 2)) == _rows(lexical.phrase_hits(df, phrases))
    begun = spark.createDataFrame([(1, "w1"), (2, "é"), (3, "zzz"), (4, "")], "query_id long, prefix string")
    want = lexical.expand_prefixes(df, begun)
    assert _rows(text_index.terms_from(spark, path, begun)) == _rows(want)


def test_upserts_deletions_and_compaction(spark, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK", 8)
    path, docs = fresh(spark, "index"), {d[0]: d for d in _docs(1, range(150))}
    text_index.upsert(spark.createDataFrame(list(docs.values()), SCHEMA).repartition(3), path)
    new = _docs(2, [*range(0, 60, 3), *range(200, 230)])
    text_index.upsert(spark.createDataFrame(new, SCHEMA), path)
    docs |= {d[0]: d for d in new}
    text_index.delete(spark.createDataFrame([(i,) for i in (3, 7, 8, 210, 999)], "doc_id long"), path)
    docs = {i: d for i, d in docs.items() if i not in (3, 7, 8, 210)}
    back = _docs(3, [7, 8])
    for _ in range(2):  # a batch that is written again under its number changes nothing
        text_index.upsert(spark.createDataFrame(back, SCHEMA), path, generation=3)
    docs |= {d[0]: d for d in back}
    _same(spark, path, list(docs.values()))
    once = fresh(spark, "index")
    text_index.compact(spark, path, once)
    _same(spark, once, list(docs.values()))


def test_a_batch_opens_its_terms_folders_only(spark, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK", 8)
    path = fresh(spark, "index")
    text_index.upsert(spark.createDataFrame(_docs(4, range(400)), SCHEMA), path)
    every = spark.read.parquet(f"{path}/postings")
    one = text_index.opened(spark, path, spark.createDataFrame([("w7",)], "term string"))
    files = {f.split("range=")[1].split("/")[0] for f in one.inputFiles()}
    assert len(files) == 1 and every.select("range").distinct().count() == text_index.LEAST
    read = text_index._read(spark, path, text_index._ranges_of(spark.createDataFrame([("w7",)], "term string"), text_index._bounds(spark, path)))
    assert read.count() < every.count() / 2 and one.agg(F.sum("n")).first()[0] == every.where("term = 'w7'").agg(F.sum("n")).first()[0]


def test_blocks_below_the_floor_are_not_scored(spark, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK", 8)
    path = fresh(spark, "index")
    docs = [(i, "a.md", "", ("common " if i % 3 else "") + ("rare " * 5 if i in (5, 77, 160) else "") + "filler " * (20 + i % 7)) for i in range(400)]
    df = spark.createDataFrame(docs, SCHEMA)
    text_index.upsert(df, path)
    asked = spark.createDataFrame([(1, "rare"), (1, "common")], "query_id long, term string")
    read = []
    got = text_index.search(spark, path, asked, 3, read=read)
    assert _rows(got.select("doc_id", "score")) == _rows(lexical.top(lexical.bm25(df, asked), 3).select("doc_id", "score"))
    assert 50 <= read[0] <= 54 and read[1] < 20


def test_empty_index_and_empty_queries(spark):
    path = fresh(spark, "index")
    text_index.upsert(spark.createDataFrame([], SCHEMA), path)
    assert text_index.search(spark, path, _asked(spark), 3).collect() == []
    assert text_index.phrase_hits(spark, path, spark.createDataFrame([(1, ["a"])], "query_id long, tokens array<string>"), 2).collect() == []
    text_index.upsert(spark.createDataFrame(_docs(1, range(9)), SCHEMA), path)
    assert text_index.search(spark, path, _asked(spark).limit(0), 3).collect() == []
    _same(spark, path, _docs(1, range(9)))


def test_positions_are_coded_by_differences(spark):
    import glob

    import pyarrow.parquet as pq

    path = fresh(spark, "index")
    text_index.upsert(spark.createDataFrame(_docs(1, range(300)), SCHEMA).coalesce(1), path)
    one = next(f for f in glob.glob(f"{path.removeprefix('file:')}/postings/**/*.parquet", recursive=True))
    group = pq.ParquetFile(one).metadata.row_group(0)
    coded = {group.column(i).path_in_schema: group.column(i).encodings for i in range(group.num_columns)}
    assert "DELTA_BINARY_PACKED" in coded["places.list.element.list.element"] and "DELTA_BYTE_ARRAY" in coded["term"]


@pytest.mark.parametrize("docs", [1, 5])
def test_table_is_written_once(spark, tmp_path, docs):
    at = str(tmp_path / "docs")
    spark.createDataFrame(_docs(1, range(docs)), SCHEMA).write.parquet(at)
    first = text_index.of_table(spark.read.parquet(at))
    assert text_index.of_table(spark.read.parquet(at)) == first
    spark.createDataFrame(_docs(2, range(9, 12)), SCHEMA).write.mode("append").parquet(at)
    assert text_index.of_table(spark.read.parquet(at)) != first
