"""Line dedup against a brute-force version on hand-made rows."""

from collections import defaultdict

import pytest

from larkspur.llm import line_dedup

SCHEMA = "doc_id long, text string, doc long, row string, kept string, gone long, t int, at long"
A, B, C = "An ordinary passage of over forty characters, ÄÖÜ.", "x" * 40, "short line"


def _rows():
    texts = [A, f"  {A.replace('A', 'a', 1)}\t\n{C}\n{B}", None, "", f"{A}\n\n{A}\n{B}", "\n", f"{C}\n{A.lower()}\n{A}\x0b", f"{A}\r\n{C}", "y" * 50_000 + "\n" + A, "\n".join([B, C] * 4000)]
    rows = [(i, t, 1, "r", "k", 2, 3, 4) for i, t in enumerate(texts)] + [(i, B, None, None, None, None, None, None) for i in range(20, 24)]
    return rows + [(None, A, 1, None, None, None, None, None), (4, A, 1, "again", None, None, None, None), (22, B, None, None, None, None, None, None), (22, B, None, None, None, None, None, None)]


def _key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute(rows, min_docs=5):
    found = defaultdict(set)
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(_key(line)) >= 40:
                found[_key(line)].add(doc)
    last = {k: max(d, key=lambda x: (x is not None, x or 0)) for k, d in found.items() if len(d) >= min_docs}
    out = []
    for doc, text, *rest in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if last.get(_key(x), doc) == doc]
        out.append((doc, "\n".join(stay), len(lines), len(lines) - len(stay), *rest))
    return out


def _order(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("shares", [line_dedup.SHARES, 2])
def test_keep_bitmaps(spark, monkeypatch, shares):
    if shares == 2:  # the keys of half of all lines are dealt out in pieces
        monkeypatch.setattr(line_dedup, "PIECE", 3)
    docs = spark.createDataFrame(_rows(), SCHEMA).repartition(3)
    bits = line_dedup.keep_bitmaps(docs, shares=shares)
    got = [(r.row.doc_id, r.kept.text, r.kept.n_lines, r.kept.n_dropped, *r.row[2:]) for r in line_dedup.apply_bitmaps(docs, bits).collect()]
    assert _order(got) == _order(brute(_rows()))
    lost = sorted((r[0], r[3]) for r in got if r[3] and r[0] is not None)
    assert {(r.doc, sum(x.n for x in r.gone)) for r in bits.collect() if r.doc is not None} == set(lost)
    assert max(len(r.gone) for r in bits.collect()) == 4000


def test_pieces_are_used(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "PIECE", 3)
    lines = line_dedup.staged(line_dedup.line_hashes(spark.createDataFrame(_rows(), SCHEMA)), "t")
    hot = {r.f1: r.pieces for r in line_dedup.frequent_keys(lines, 4).collect()}
    counts = {r.h1: r["count"] for r in lines.groupBy("h1").count().collect()}
    total = sum(counts.values())
    assert set(hot) == {h for h, n in counts.items() if n > total / 4} and min(hot.values()) > 1


def test_keep_lines_keeps_columns(spark):
    docs = spark.createDataFrame(_rows(), SCHEMA)
    got = line_dedup.keep_lines(docs)
    assert got.columns == docs.columns
    want = [(d, text, *rest) for d, text, _, _, *rest in brute(_rows())]
    assert _order(tuple(r) for r in got.collect()) == _order(want)


def test_empty_table(spark):
    assert line_dedup.keep_lines(spark.createDataFrame([], SCHEMA)).count() == 0
