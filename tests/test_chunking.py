import hashlib
import re
from collections import defaultdict

from larkspur.functions import chunking
from larkspur.plans.queries import QUERIES, load


def test_token_chunks(spark):
    texts = {1: "", 2: "short", 3: "word and more\n\n" * 700, 4: "x" * 9000, 5: None}
    got = chunking.token_chunked(spark.createDataFrame(list(texts.items()), "doc_id long, body string"), "doc_id").collect()
    for key, text in texts.items():
        text, rows = text or "", sorted((r for r in got if r.doc_id == key), key=lambda r: r.seq)
        assert [r.seq for r in rows] == list(range(len(rows)))
        assert all(text[r.pos : r.pos + len(r.chunk)] == r.chunk and r.tokens == -(-len(r.chunk) // 3) <= 900 for r in rows)
        assert rows[0].pos == 0 and rows[-1].pos + len(rows[-1].chunk) == len(text)
        assert all(a.pos < b.pos <= a.pos + len(a.chunk) <= b.pos + 405 for a, b in zip(rows, rows[1:]))


def _table(spark, sf, name, *columns):
    return spark.read.parquet(f"{sf}/{name}.parquet").select(*columns).collect()


def test_chunks_are_cut_where_the_score_is_best(spark, sf):
    """Every cut of the given texts, found again by trying all break points."""
    texts = {r.doc_id: r.text for r in _table(spark, sf, "documents", "doc_id", "text")}
    rows = defaultdict(list)
    for r in QUERIES["chunk_documents"](spark, sf).collect():
        rows[r.doc_id].append((r.seq, r.pos, r.chunk_hash))
    assert rows.keys() == texts.keys()
    for doc, text in texts.items():
        got, at, end = sorted(rows[doc]), 0, 0
        assert [s for s, _, _ in got] == list(range(len(got))) and got[0][1] == 0
        for n, (_, pos, digest) in enumerate(got):
            if len(text) - pos <= chunking.SIZE:
                stop = len(text)
            else:
                target = pos + chunking.SIZE
                near = [(p, s) for p, s in chunking.break_points(text) if target - chunking.WINDOW <= p <= target and not any(a < p < b for a, b in chunking.fences(text))]
                score = lambda x: x[1] * (1 - ((target - x[0]) / chunking.WINDOW) ** 2 * 0.7)
                stop = max(near, key=score)[0] if near else target
                stop = stop if stop > pos else target
            assert hashlib.sha256(text[pos:stop].encode()).hexdigest() == digest, (doc, n)


def test_best_chunk_holds_most_terms(spark, sf):
    texts = {r.doc_id: r.text for r in _table(spark, sf, "documents", "doc_id", "text")}
    asked = {r.item_id: [w for w in re.split(r"[ \t\n\x0b\f\r]+", r.text.lower()) if len(w) > 2] for r in _table(spark, sf, "benchmark", "item_id", "text")}
    rows = QUERIES["best_chunk"](spark, sf).collect()
    assert rows
    for r in rows:
        held = [sum(w in chunk.lower() for w in asked[r.query_id]) for _, chunk in chunking.chunks(texts[r.doc_id])]
        assert r.held == max(held) and r.seq == held.index(max(held))


def test_syntax_chunks_are_cut_where_the_score_is_best(spark, sf):
    """Every cut of the made source files, found again by trying all points; those of
    declarations come from the query that is compared with SQL."""
    bodies = {r.doc_id: r.body for r in load(spark, sf, "code_files").collect()}
    points = {k: dict(chunking.break_points(t)) for k, t in bodies.items()}
    for r in QUERIES["syntax_breaks"](spark, sf).collect():
        points[r.doc_id][r.pos] = max(r.worth, points[r.doc_id].get(r.pos, 0))
    rows = defaultdict(list)
    for r in QUERIES["syntax_chunks"](spark, sf).collect():
        rows[r.doc_id].append((r.seq, r.pos, r.chunk_hash))
    assert rows.keys() == bodies.keys()
    for doc, text in bodies.items():
        at = 0
        for n, pos, digest in sorted(rows[doc]):
            target = pos + chunking.SIZE
            near = sorted((p, w) for p, w in points[doc].items() if target - chunking.WINDOW <= p <= target and not any(a < p < b for a, b in chunking.fences(text)))
            stop = max(near, key=lambda x: x[1] * (1 - ((target - x[0]) / chunking.WINDOW) ** 2 * 0.7))[0] if near else target
            stop = len(text) if len(text) - pos <= chunking.SIZE else stop
            assert pos == at and hashlib.sha256(text[pos:stop].encode()).hexdigest() == digest, (doc, n)
            at = stop - chunking.OVERLAP
        assert stop == len(text)
