"""Globs and parts of objects as tables against plain matching."""

import re

from larkspur.operators import catalog, knowledge


def test_globs_like_one_by_one(spark):
    paths = ["a/b.md", "a/c/d.md", "notes/2024/plan.md", "notes/plan (x).txt", "x[1].md", "läng/ü.md", "deep/a/b/c/d/e.md", "plain", "UPPER/File.MD", "ab"]
    docs = spark.createDataFrame([("col", p, "x" * (20 * i), i != 7) for i, p in enumerate(paths)], "collection string, path string, body string, active boolean")
    patterns = ["*.md", "**/*.md", "a/*", "a/**", "col/**/d.md", "notes/**/plan*.txt", "x[1].md", "l?ng/*.md", "?", "*", "**", "no/such/*.md", "a/?.md", "**/ü.*", "", None, "ab", "pl*"]
    asked = spark.createDataFrame(list(enumerate(patterns)), "query_id int, pattern string")
    found, near = catalog.matching_many(docs, asked, most=100)
    want = set()
    for q, pattern in enumerate(patterns):
        if pattern is not None:
            regex = re.compile(catalog.glob_regex(pattern))
            want |= {(q, "col", p, "too large" if 20 * i > 100 else "ok") for i, p in enumerate(paths) if i != 7 and (regex.search(p) or regex.search(f"col/{p}"))}
    assert {tuple(r) for r in found.collect()} == want
    assert {(r.query_id, r.path) for r in near.collect() if r["rank"] == 1} <= {(q, p) for q in range(len(patterns)) for p in paths}


def test_parts_meet_few_facts(spark):
    facts = spark.createDataFrame([(i, "s", "p", f"Common thing {i}" if i % 50 else "rare Zebra", "global", None, None) for i in range(1000)], "id long, subject string, predicate string, object string, scope string, valid_from timestamp, valid_until timestamp")
    schema = "query_id long, subject string, predicate string, part string, scope string, at timestamp"
    met = []
    asked = spark.createDataFrame([(1, None, None, "zebRA", "mine", None), (2, None, None, "thing 999", "mine", None)], schema)
    got = sorted((r.query_id, r.id) for r in knowledge.search_scoped(facts, asked, met=met).collect())
    assert got == [(1, i) for i in range(0, 1000, 50)] + [(2, 999)] and met[0] <= 25
    wide = spark.createDataFrame([(3, "S", None, None, "mine", None), (4, None, "P", "ze", "mine", None), (5, None, None, None, "global", None), (6, "S", None, "thing 1", "mine", None)], schema)
    got = {(r.query_id, r.id) for r in knowledge.search_scoped(facts, wide, limit=1000).collect()}
    assert {i for q, i in got if q == 4} == set(range(0, 1000, 50)) and sum(q == 3 for q, _ in got) == 1000 == sum(q == 5 for q, _ in got)
    assert {i for q, i in got if q == 6} == {i for i in range(1000) if i % 50 and str(i).startswith("1")}
