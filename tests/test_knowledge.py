"""As-of lookups against a join of all facts and probes of a subject."""

import random

import pytest

from larkspur.operators import knowledge

FACTS = "id long, subject string, predicate string, object string, valid_from timestamp, valid_until timestamp"


def _time(day):
    from datetime import datetime, timedelta

    return None if day is None else datetime(2024, 1, 1) + timedelta(days=day)


@pytest.mark.parametrize("piece,overlaps", [(100_000, False), (5, False), (5, True), (100_000, True)])
def test_as_of_like_a_join(spark, monkeypatch, piece, overlaps):
    monkeypatch.setattr(knowledge, "PIECE", piece)
    monkeypatch.setattr(knowledge, "MANY", 20 if piece == 5 else 0)
    rng = random.Random(piece + overlaps)
    facts = []
    for key in [("hot", "p")] * 12 + [("hot", "q"), ("cold", "p"), ("cold", None)]:
        start = rng.randrange(0, 50) if overlaps else 1000 + 400 * len(facts)
        for _ in range(rng.choice([1, 5, 8])):
            end = start + rng.randrange(1, 30)
            until = rng.choice([end, end, None, end + 90]) if overlaps else end
            facts.append((len(facts), *key, "o", _time(rng.choice([start, start, None]) if overlaps else start), _time(until)))
            start = end + rng.choice([0, 0, 3])
    span = 130 if overlaps else 1000 + 400 * len(facts)
    asked = [(q, rng.choice(["hot", "hot", "cold", "none"]), _time(rng.choice([rng.randrange(0, span), None] if q % 9 == 0 else [rng.randrange(0, span)]))) for q in range(400)]
    asked += [(1000 + i, f[1], f[4]) for i, f in enumerate(facts)] + [(2000 + i, f[1], f[5]) for i, f in enumerate(facts)]
    got = knowledge.as_of(spark.createDataFrame(facts, FACTS).repartition(3), spark.createDataFrame(asked, "query_id long, subject string, at timestamp"))
    want = [(q, f[0]) for q, s, at in asked for f in facts if at and f[1] == s and f[4] and f[4] <= at and (f[5] is None or at < f[5])]
    assert sorted((r.query_id, r.id) for r in got.collect()) == sorted(want) and want


ASSERTED = "id long, subject string, predicate string, object string, valid_from timestamp, ingested timestamp"


def _asserted(seed, n):
    rng = random.Random(seed)
    return [(i, f"S {rng.randrange(4)}", rng.choice(["p", "P", "q"]), rng.choice("abc"), _time(rng.randrange(50)), _time(rng.randrange(50))) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_late_facts_end_as_all_at_once(spark, tmp_path, seed):
    from larkspur.operators import fact_store

    rows, rng = _asserted(seed, 120), random.Random(seed)
    want = sorted(map(str, knowledge.build(spark.createDataFrame(rows, ASSERTED)).collect()))
    rng.shuffle(rows)
    path, at, number = str(tmp_path / "facts"), 0, 0
    while at < len(rows):
        size = rng.choice([1, 20, 60])
        for _ in range(rng.choice([1, 2])):  # some batches come twice
            fact_store.put(spark.createDataFrame(rows[at : at + size], ASSERTED), path, number, 8)
        at, number = at + size, number + 1
    fact_store.put(spark.createDataFrame([], ASSERTED), path, number, 8)
    got = fact_store.current(spark, path)
    assert sorted(map(str, got.select("id", "subject", "predicate", "object", "valid_from", "ingested", "valid_until").collect())) == want
    one = spark.createDataFrame([(999, "S 1", "p", "z", _time(60), _time(60))], ASSERTED)
    fact_store.put(one, path, number + 1, 8)
    assert len(list((tmp_path / "facts" / "facts" / f"version={number + 1}").glob("bucket=*"))) == 1


def test_late_facts_of_a_stream(spark, tmp_path):
    from larkspur.operators import fact_store

    rows = _asserted(3, 60)
    source, path, mark = (str(tmp_path / x) for x in ("in", "facts", "mark"))
    for part in (rows[40:], rows[:40]):
        spark.createDataFrame(part, ASSERTED).coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema(ASSERTED).option("maxFilesPerTrigger", 1).parquet(source)
        fact_store.put_stream(stream, path, mark, 4).trigger(availableNow=True).start().awaitTermination()
    want = knowledge.build(spark.createDataFrame(rows, ASSERTED)).collect()
    assert {(r.id, r.valid_until) for r in fact_store.current(spark, path).collect()} == {(r.id, r.valid_until) for r in want}


def test_consolidated_texts(spark):
    from datetime import datetime

    d = datetime
    rows = [
        (1, "ann_lee", "lives_in", "Rome", d(2023, 5, 8), None), (2, "ann_lee", "lives_in", "Paris", d(2022, 1, 31), None), (3, "ann_lee", "lives_in", "Rome", None, None),
        (4, "ann_lee", "job", "dancer", None, None), (5, "ann_lee", "job", "cook", d(2021, 1, 1), d(2022, 1, 1)),
        (6, "bob", "job", "baker", d(2020, 1, 1), None), (7, "cy", "likes", None, d(2020, 1, 1), None), (8, "cy", "likes", "tea", None, None),
    ]
    facts = spark.createDataFrame(rows, "id long, subject string, predicate string, object string, valid_from timestamp, valid_until timestamp")
    got = {(r.subject, r.kind): r.text for r in knowledge.consolidated(facts).collect()}
    assert got == {
        ("ann_lee", "profile"): "[entity-summary:ann_lee] ann lee. job: dancer. lives in: Rome, Paris.",
        ("ann_lee", "timeline"): "[entity-timeline:ann_lee] [31 January, 2022] ann lee lives in Paris. [8 May, 2023] ann lee lives in Rome.",
        ("cy", "profile"): "[entity-summary:cy] cy. likes: tea.",
    }
    assert knowledge.consolidated(facts.limit(0)).count() == 0
