from collections import Counter, defaultdict
from math import log

from pyspark.sql import functions as F

from larkspur.functions import stems
from larkspur.functions import text as X
from larkspur.operators import catalog, lexical

# The published algorithm's own examples.
KNOWN = {"caresses": "caress", "ponies": "poni", "ties": "ti", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "vietnamization": "vietnam", "triplicate": "triplic", "formative": "form", "hopefulness": "hope", "goodness": "good", "revival": "reviv", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "a": "a", "naïve2": "naïve2"}


def test_published_examples():
    assert {w: stems.stem(w) for w in KNOWN} == KNOWN
    assert stems.folded("Élan") == "Elan" and stems.folded("ß") == "ß"


def test_stemmed_search(spark):
    texts = ["The cats were running", "a cat runs", "école running runs", "nothing here", None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, body string")
    analyse = lambda c: stems.stemmed(X.tokens(c))
    terms = spark.createDataFrame([(1, "cat"), (1, "run"), (2, "ecol")], "query_id long, term string")
    got = {(r.query_id, r.doc_id): r.score for r in lexical.bm25(docs, terms, {"body": 1.0}, analyse=analyse).collect()}
    tokens = [[stems.stem(stems.folded(w)) for w in (t or "").lower().split()] for t in texts]
    mean = sum(map(len, tokens)) / len(tokens)
    want = defaultdict(float)
    for q, term in ((1, "cat"), (1, "run"), (2, "ecol")):
        n = sum(term in t for t in tokens)
        idf = max(log((len(tokens) - n + 0.5) / (n + 0.5)), 1e-6)
        for i, t in enumerate(tokens):
            if tf := Counter(t)[term]:
                want[q, i] += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))
    assert got.keys() == want.keys() and all(abs(got[k] - w / (1 + w)) < 2e-6 for k, w in want.items())


def test_upsert_keeps_the_latest_and_find_suggests(spark):
    old = spark.createDataFrame([("c", "a/b.md", "x", 1, True)], "collection string, path string, body string, modified_at long, active boolean")
    new = spark.createDataFrame([("c", "a/b.md", "y", 5, False), ("c", "a/b.md", "z", 4, False), ("c", "d.md", "w", 1, False)], old.schema)
    assert sorted((r.path, r.body, r.active) for r in catalog.upserted(old, new).collect()) == [("a/b.md", "y", True), ("d.md", "w", True)]
    docs = catalog.addressed(spark.createDataFrame([("c", "notes/2024/plan.md", "one"), ("c", "plan.md", "two")], "collection string, path string, body string"))
    digits = docs.where("path = 'plan.md'").first().hash
    asked = spark.createDataFrame([(1, "2024/plan.md:7"), (2, "#" + digits[:12]), (3, "plam.md"), (4, "zzzzzzzz")], "query_id long, name string")
    found, near = catalog.find_all(docs, asked)
    assert sorted((r.query_id, r.path, r.how) for r in found.collect()) == [(1, "notes/2024/plan.md", 6), (2, "plan.md", 5)]
    assert [(r.query_id, r.path, r.distance) for r in near.collect()] == [(3, "plan.md", 1)]
