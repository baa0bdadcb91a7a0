"""Names within some edits, against every pair."""

from larkspur.operators import catalog


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_similar_short_names(spark):
    stored = ["xyz", "a", "abcde", "", "abcdef", "ABX", "some/longer.md", "some/longest.md"]
    asked = ["ab", "", "abc", "abcd", "some-longer.md"]
    got = catalog.similar(spark.createDataFrame([(p,) for p in stored], "path string"), spark.createDataFrame(list(enumerate(asked)), "query_id long, name string"), 3, 1000).collect()
    want = {(i, p, _edits(a, p.lower())) for i, a in enumerate(asked) for p in stored if _edits(a, p.lower()) <= 3}
    assert {(r.query_id, r.path, r.distance) for r in got} == want and len(got) == len(want)


def test_collections_made_and_set(spark):
    columns = "collection string, path string, pattern string, include_by_default boolean, update string"
    old = spark.createDataFrame([("a", "x", "*.md", True, "pull")], columns)
    incoming = spark.createDataFrame([("a", "y"), ("b-1", "z"), ("b-1", "y"), ("b_2", None), ("no/t", "q"), ("", "q"), (None, "q"), ("t\n", "q")], "collection string, path string")
    now, outcomes = catalog.created(old, incoming)
    assert sorted((str(r.collection), str(r.path), r.outcome) for r in outcomes.collect()) == sorted(
        [("a", "y", "exists"), ("b-1", "y", "created"), ("b-1", "z", "exists"), ("b_2", "None", "created"), ("no/t", "q", "bad name"), ("", "q", "bad name"), ("None", "q", "bad name"), ("t\n", "q", "bad name")]
    )
    assert {tuple(r) for r in now.collect()} == {("a", "x", "*.md", True, "pull"), ("b-1", "y", "**/*.md", True, None), ("b_2", None, "**/*.md", True, None)}
    settings = spark.createDataFrame([("a", None, ""), ("b_2", False, "git"), ("none", True, "x")], "collection string, include_by_default boolean, update string")
    assert {tuple(r) for r in catalog.configured(now, settings).collect()} == {("a", "x", "*.md", True, None), ("b-1", "y", "**/*.md", True, None), ("b_2", None, "**/*.md", False, "git")}
    docs = spark.createDataFrame([("a", True), ("b_2", True), ("b_2", False)], "collection string, active boolean")
    assert {tuple(r) for r in catalog.without_contexts(now, docs, spark.createDataFrame([("a",)], "collection string")).collect()} == {("b-1", 0), ("b_2", 1)}
