"""Chunks of documents, cut at the best nearby break: of the text or of its syntax."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import syntax

# Fixed values. Characters of a chunk, of the overlap and of the window for cuts.
SIZE, OVERLAP, WINDOW = 3600, 540, 800
# Fixed values. Breaks, each with what a cut there is worth.
BREAKS = [
    (r"\n#{1}(?!#)", 100),
    (r"\n#{2}(?!#)", 90),
    (r"\n#{3}(?!#)", 80),
    (r"\n#{4}(?!#)", 70),
    (r"\n#{5}(?!#)", 60),
    (r"\n#{6}(?!#)", 50),
    (r"\n```", 80),
    (r"\n(?:---|\*\*\*|___)\s*\n", 60),
    (r"\n\n+", 20),
    (r"\n[-*]\s", 5),
    (r"\n\d+\.\s", 5),
    (r"\n", 1),
]
#: Documents whose text and chunks a task holds as Python's own objects.
STEP = 64
_BREAKS = [(re.compile(p), s) for p, s in BREAKS]


def break_points(text: str) -> list[tuple[int, int]]:
    """(position, worth), the best per position, in order."""
    best: dict[int, int] = {}
    for pattern, worth in _BREAKS:
        for m in pattern.finditer(text):
            best[m.start()] = max(worth, best.get(m.start(), 0))
    return sorted(best.items())


def merged(*lists: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """All points, the best worth per position, in order."""
    best: dict[int, int] = {}
    for pos, worth in (p for points in lists for p in points):
        best[pos] = max(worth, best.get(pos, 0))
    return sorted(best.items())


def fences(text: str) -> list[tuple[int, int]]:
    """Code regions between fence lines; one left open goes on to the end."""
    marks = [m.start() for m in re.finditer(r"\n```", text)]
    return [(a, b) for a, b in zip(marks[::2], [*marks[1::2], len(text)])]


def best_cut(points: list[tuple[int, int]], target: int, window: int, code: list[tuple[int, int]]) -> int:
    best, at = -1.0, target
    for pos, worth in points:
        if target - window <= pos <= target and not any(a < pos < b for a, b in code):
            value = worth * (1 - ((target - pos) / window) ** 2 * 0.7)
            if value > best:
                best, at = value, pos
    return at


def chunks(text: str, size: int = SIZE, overlap: int = OVERLAP, window: int = WINDOW, path: str | None = None) -> list[tuple[int, str]]:
    """(position, chunk); positions ascend and every character is in a chunk.  A ``path``
    of a known language adds the text's declarations to its breaks."""
    if len(text) <= size:
        return [(0, text)]
    points, code, out, start = merged(break_points(text), syntax.points(text, path)), fences(text), [], 0
    while True:
        if len(text) - start <= size:
            return [*out, (start, text[start:])]
        end = best_cut(points, start + size, window, code)
        end = end if end > start else start + size
        out.append((start, text[start:end]))
        start = end - overlap if end - overlap > start else end


def chunked(docs: DataFrame, key: str, size: int = SIZE, overlap: int = OVERLAP, window: int = WINDOW, path: str | None = None) -> DataFrame:
    """(key, seq, pos, chunk) of docs(key, body); ``path`` names a column of file names,
    for cuts at declarations too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, STEP) for whole in batches for at in range(0, whole.num_rows, STEP)):
            paths = batch.column(path).to_pylist() if path else [None] * len(batch)
            rows = [(k, i, p, c) for k, t, f in zip(batch.column(key).to_pylist(), batch.column("body").to_pylist(), paths) for i, (p, c) in enumerate(chunks(t or "", size, overlap, window, f))]
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (batch.column(key).type, pa.int32(), pa.int32(), pa.string()))], [key, "seq", "pos", "chunk"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(*dict.fromkeys([key, "body", *([path] if path else [])])).mapInArrow(run, f"{key} {kind}, seq int, pos int, chunk string")


def declarations(docs: DataFrame, key: str, path: str) -> DataFrame:
    """(key, pos, worth) of the declarations of docs(key, path, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, p, w) for k, t, f in zip(*(batch.column(c).to_pylist() for c in (key, "body", path))) for p, w in syntax.points(t, f)]
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (batch.column(key).type, pa.int32(), pa.int32()))], [key, "pos", "worth"])

    return docs.select(*dict.fromkeys([key, "body", path])).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, pos int, worth int")


def token_chunked(docs: DataFrame, key: str, size: int = 900, overlap: int = 135, window: int = 200) -> DataFrame:
    """(key, seq, pos, chunk, tokens) under a budget of tokens, three characters each."""
    return chunked(docs, key, 3 * size, 3 * overlap, 3 * window).withColumn("tokens", F.ceil(F.length("chunk") / 3).cast("int"))
