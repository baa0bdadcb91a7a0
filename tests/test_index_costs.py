"""What the stored index hands on: blocks made at once, best rows of a task, live documents of a block."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from larkspur.operators import lexical, text_index
from larkspur.sources.staged import fresh

SCHEMA = "doc_id long, path string, title string, body string"


def test_blocks_are_made_at_once():
    rng = random.Random(4)
    types = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64())), pa.int32(), pa.float64(), pa.int64()]
    for count in (1, 2, 9, 40):
        texts = [[text_index.BETWEEN.join(rng.choice("aébcd") for _ in range(rng.choice([0, 0, 1, 30]))) for _ in range(count)] for _ in range(3)]
        texts[1] = [""] * count
        want: dict[str, list] = {}
        for doc in range(count):
            fields = [[t for t in f[doc].split(text_index.BETWEEN) if t] for f in texts]
            size, held = sum(map(len, fields)), {"": (0.0, [])}
            for n, field in enumerate(fields):
                for place, term in enumerate(field, n * text_index.FIELD):
                    tf, places = held.get(term, (0.0, []))
                    held[term] = (tf + [1.5, 4.0, 1.0][n], [*places, place])
            for term, (tf, places) in held.items():
                want.setdefault(term, []).append((doc + 7, tf, size, places))
        whole = [pa.array(["before", *f, "after"]).slice(1, count) for f in texts]
        columns = text_index._block_rows(pa.array(range(7, count + 7), pa.int64()), [text_index._tokens(f) for f in whole], [1.5, 4.0, 1.0], 3)
        assert [c.type for c in columns] == types
        rows = {r[0]: r[1:] for r in zip(*(c.to_pylist() for c in columns))}
        assert len(rows) == len(columns[0])
        assert rows == {t: (3, *map(list, zip(*d)), len(d), max(x[1] for x in d), min(x[2] for x in d)) for t, d in want.items()}


def test_a_task_hands_on_the_best_rows_alone(spark, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK", 64)
    monkeypatch.setattr(text_index, "KEPT", 40)
    docs = [(i, "a.md", "", "common " * (i % 5 + 1) + "filler " * (i % 11) + ("odd" if i % 2 else "even")) for i in range(600)]
    df, path = spark.createDataFrame(docs, SCHEMA), fresh(spark, "index")
    text_index.upsert(df, path)
    text_index.upsert(df.where("doc_id % 3 = 0").withColumn("body", F.concat("body", F.lit(" common"))), path)
    text_index.delete(df.where("doc_id % 5 = 1"), path)
    now = df.withColumn("body", F.when(F.col("doc_id") % 3 == 0, F.concat("body", F.lit(" common"))).otherwise(F.col("body"))).where("doc_id % 5 <> 1")
    asked = spark.createDataFrame([(q, t) for q in range(30) for t in ("common", "odd")[: q % 2 + 1]] + [(q, "even") for q in range(0, 30, 3)], "query_id long, term string")
    barred = spark.createDataFrame([(1, "even"), (2, "odd"), (4, "common")], "query_id long, term string")
    counts, kept = {}, text_index.staged

    def staged(rows, label):
        out = kept(rows, label)
        if label in ("seed-scores", "term-rows"):
            counts[label] = out.agg(F.sum("n")).first()[0] if label == "term-rows" else out.count()
        return out

    monkeypatch.setattr(text_index, "staged", staged)
    monkeypatch.setattr(text_index, "GROUP", 16)
    for more in ({}, {"barred": barred, "match_all": True}):
        want = lexical.top(lexical.bm25(now, asked, **more), 5)
        got = text_index.search(spark, path, asked, 5, **more).select(*want.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert counts["seed-scores"] <= 4 * 5 * 30  # tasks, rows, queries; 4 blocks a query have up to 256 documents
        assert counts["term-rows"] == 480 * 2  # every live document holds "common" and one of the others


def test_files_are_sorted_once(spark, monkeypatch):
    from pyspark.sql import DataFrameWriter

    plans, kept = [], DataFrameWriter.parquet

    def parquet(self, path, *more, **options):
        if "/postings/" in path:
            plans.append((self._df._jdf.queryExecution().optimizedPlan().toString(), spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")))
        return kept(self, path, *more, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    path = fresh(spark, "index")
    text_index.upsert(spark.createDataFrame([(i, "a.md", "", f"some words {i} and more {i % 7}") for i in range(50)], SCHEMA), path)
    plan, writers = plans[0]
    assert plan.count("Sort [") == 1 and "Sort [term" in plan and int(writers) > 0  # else the writer sorts by range besides
    assert int(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")) == 0
    stored = spark.read.parquet(f"{path}/postings/generation=0")
    for folder in {f.rsplit("/", 1)[0] for f in stored.inputFiles()}:
        files = [f for f in stored.inputFiles() if f.startswith(f"{folder}/")]
        rows = [(r.term.encode(), r.block) for r in spark.read.parquet(folder).collect()]
        assert len(files) == 1 and rows == sorted(rows)
