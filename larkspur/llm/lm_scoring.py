"""Cross-entropy difference under matched n-gram models.

A target model (texts of the wanted kind) and a background model (all documents) share
one vocabulary, order and smoothing.  Words are lower-cased, with common punctuation
taken off.  A token's probability is that of its bigram, interpolated with that of its
word, by the counts of every word and every bigram of the corpus.  Every document gets
its mean loss under both models and their difference: below zero is nearer to the target.

The counts are a table too large for any task, so chunks of documents ask it for what
they need:

1. a task cuts its documents into chunks of about ``CHUNK`` tokens and writes each as one
   row: ids, sizes, the hashes of its distinct words, and the tokens as places in them;
2. a chunk sends its distinct keys (words, words as contexts, bigrams), in order and with
   its own counts, to shares of the key space.  A share holds the keys of about ``SHARE``
   tokens; it sums both corpora's counts of a key and answers every chunk that sent it.
   A word or bigram of a third of all tokens is one key a chunk, so nothing is skewed;
3. a chunk meets its answers and scores its documents.

Words and bigrams are told apart by 62-bit hashes: two of n share one with a chance of
n * n / 2^63.

Defined cases: null and word-free texts have no tokens and null losses; repeated rows
are counted and scored as often as they occur; a document longer than a chunk is one of
its own; an empty target leaves its model uniform; empty tables give empty results;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.shared import staged, text_of

#: Tokens of a chunk, and tokens whose keys one share of the key space counts.
CHUNK, SHARE = 700_000, 1_000_000
#: Weight of the bigram, and the count added to every word.
MIX, ADD = 0.7, 0.5
_MARKS = b".,!?;:\"()"
_KIND = np.uint64(3)
_SCHEMA = "corpus int, chunk long, n_tokens long, ids array<long>, sizes array<long>, words binary, tokens binary"


def words(text: str) -> list[bytes]:
    return text.encode().lower().translate(None, _MARKS).split()


class _Places(dict):
    """Place of every distinct word of a chunk, from 1; 0 is the start of a text."""

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self) + 1
        return place

    def hashes(self) -> np.ndarray:
        raw = b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in self)
        return np.frombuffer(raw, "<u8") & ~_KIND


def _planes(x: np.ndarray) -> bytes:
    """The numbers' lowest bytes, then their next ones: high bytes are runs of zeros."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _from_planes(raw: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def chunks(texts: DataFrame, corpus: int, size: int) -> DataFrame:
    """The documents of ``texts(doc_id, text)`` as chunks of about ``size`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, held, ids, total, number = _Places(), [], [], 0, TaskContext.get().partitionId() << 32

        def chunk():
            tokens = np.concatenate(held)
            row = [corpus, number, len(tokens), ids, [len(h) for h in held], places.hashes().tobytes(), _planes(tokens)]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], [c.split()[0] for c in _SCHEMA.split(", ")])

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    held.append(np.fromiter(map(places.__getitem__, words(text)), np.uint32))
                    ids.append(doc)
                    total += len(held[-1])
                    if total >= size:
                        yield chunk()
                        places, held, ids, total, number = _Places(), [], [], 0, number + 1
        if held:
            yield chunk()

    return texts.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, _SCHEMA)


class Keys:
    """The keys of one chunk: its words, its words as contexts, its distinct bigrams."""

    def __init__(self, sizes: np.ndarray, hashes: np.ndarray, tokens: np.ndarray):
        self.sizes, self.tokens, self.n_words = sizes, tokens, len(hashes)
        own = np.concatenate([np.zeros(1, np.uint64), hashes])
        self.before = np.concatenate([np.zeros(1, tokens.dtype), tokens])[:-1]
        self.before[(np.cumsum(sizes) - sizes)[sizes > 0]] = 0
        mixed = own * np.uint64(0x9E3779B97F4A7C15)
        self.bigram = mixed[self.before] + own[tokens]
        self.bigram ^= self.bigram >> np.uint64(32)
        self.bigram *= np.uint64(0xBF58476D1CE4E5B9)
        self.bigram = (self.bigram ^ (self.bigram >> np.uint64(29))) & ~_KIND | np.uint64(2)
        self.of_words = [hashes, own | np.uint64(1)]

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """(keys in order, how often each occurs in the chunk)."""
        bigrams, n = np.unique(self.bigram, return_counts=True)
        n = np.concatenate([np.bincount(self.tokens, minlength=self.n_words + 1)[1:], np.bincount(self.before, minlength=self.n_words + 1), n])
        keys = np.concatenate([*self.of_words, bigrams])
        order = np.argsort(keys, kind="stable")
        return keys[order], n[order].astype(np.int64)

    def losses(self, counts: dict[str, np.ndarray], totals: dict[str, int], size: int) -> dict[str, np.ndarray]:
        """Summed loss of every document under each model; ``counts`` stand in key order."""
        bigrams, first, place = np.unique(self.bigram, return_index=True, return_inverse=True)
        order = np.argsort(np.concatenate([*self.of_words, bigrams]), kind="stable")
        document = np.repeat(np.arange(len(self.sizes)), self.sizes)
        out = {}
        for model, known in counts.items():
            n = np.empty(len(order))
            n[order] = known
            alone = (np.concatenate([np.zeros(1), n[: self.n_words]])[self.tokens[first]] + ADD) / (totals[model] + ADD * max(size, 1))
            seen = n[self.n_words : 2 * self.n_words + 1][self.before[first]]
            chance = np.where(seen > 0, MIX * n[2 * self.n_words + 1 :] / np.maximum(seen, 1) + (1 - MIX) * alone, alone)
            out[model] = np.bincount(document, -np.log(chance)[place], len(self.sizes))
        return out


def _keys_of(table, i: int) -> Keys:
    return Keys(np.array(table.column("sizes")[i].as_py(), np.int64), np.frombuffer(table.column("words")[i].as_py(), "<u8"), _from_planes(table.column("tokens")[i].as_py(), "<u4"))


def asked(cut: DataFrame, shares: int) -> DataFrame:
    """(share, chunk, corpus, keys, n): every chunk's keys, dealt to the shares in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([-(-(s << 64) // shares) for s in range(1, shares)], np.uint64)
        for batch in batches:
            for i in range(batch.num_rows):
                keys, n = _keys_of(batch, i).counted()
                at = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
                used = [s for s in range(shares) if at[s] < at[s + 1]]
                steps = [_planes(np.diff(keys[at[s] : at[s + 1]], prepend=np.uint64(0))) for s in used]
                rows = [(s, batch.column("chunk")[i].as_py(), batch.column("corpus")[i].as_py(), k, _planes(n[at[s] : at[s + 1]])) for s, k in zip(used, steps)]
                columns = zip(*rows) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["share", "chunk", "corpus", "keys", "n"])

    return cut.select("corpus", "chunk", "sizes", "words", "tokens").mapInArrow(run, "share int, chunk long, corpus int, keys binary, n binary")


def _answer(table: pa.Table) -> pa.Table:
    """One share: the counts of each key in both corpora, for each chunk that sent it."""
    keys = [np.cumsum(_from_planes(k.as_py(), "<u8")) for k in table.column("keys")]
    n = np.concatenate([_from_planes(k.as_py(), "<i8") for k in table.column("n")])
    sizes, corpus = np.array([len(k) for k in keys]), np.array(table.column("corpus"))
    keys, wanted = np.concatenate(keys), np.repeat(corpus == 1, sizes)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    first, group = np.flatnonzero(new), np.cumsum(new) - 1
    cuts, columns = np.cumsum(sizes)[:-1], []
    for mine in (n * ~wanted, n * wanted):
        total = np.empty(len(keys), np.int64)
        total[order] = np.add.reduceat(mine[order], first)[group]
        columns.append(pa.array([_planes(x) for x in np.split(total, cuts)], pa.binary()))
    vocabulary = int((ordered[first] & _KIND == 0).sum())
    distinct = pa.array([vocabulary] + [0] * (len(sizes) - 1), pa.int64())
    return pa.Table.from_arrays([table.column("share"), table.column("chunk"), table.column("corpus"), *columns, distinct], ["share", "chunk", "corpus", "b", "t", "distinct"])


def scored(docs: DataFrame, target: DataFrame, chunk: int = CHUNK, share: int = SHARE) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, difference) of every row."""
    none = F.lit(None).cast("long").alias("doc_id")
    cut = chunks(docs.select("doc_id", "text"), 0, chunk).unionByName(chunks(target.select(none, "text"), 1, chunk))
    cut = staged(cut, "lm-chunks", "zstd")
    totals = {r.corpus: r.n for r in cut.groupBy("corpus").agg(F.sum("n_tokens").alias("n")).collect()}
    totals = {"b": totals.get(0, 0), "t": totals.get(1, 0)}
    shares = max(1, -(-sum(totals.values()) // share))
    answers = asked(cut, shares).groupBy("share").applyInArrow(_answer, "share int, chunk long, corpus int, b binary, t binary, distinct long")
    answers = staged(answers, "lm-answers", "zstd")
    size = answers.agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0]

    def score(own: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        for i in range(own.num_rows):
            keys = _keys_of(own, i)
            mine = found.sort_by("share")
            counts = {m: np.concatenate([np.zeros(0, np.int64), *(_from_planes(x.as_py(), "<i8") for x in mine.column(m))]) for m in ("t", "b")}
            loss = keys.losses(counts, totals, size)
            empty = keys.sizes == 0
            means = [pa.array(loss[m] / np.maximum(keys.sizes, 1), mask=empty) for m in ("t", "b")]
            out.append(pa.Table.from_arrays([own.column("ids")[i].values, pa.array(keys.sizes), *means], ["doc_id", "n_tokens", "t", "b"]))
        return pa.concat_tables(out) if out else pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("t", pa.float64()), ("b", pa.float64())]).empty_table()

    own = cut.where("corpus = 0").select("chunk", "ids", "sizes", "words", "tokens")
    found = answers.where("corpus = 0").select("chunk", "share", "t", "b")
    out = own.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(score, "doc_id long, n_tokens long, t double, b double")
    return out.select("doc_id", "n_tokens", F.round("t", 6).alias("target_loss"), F.round("b", 6).alias("background_loss"), F.round(F.col("t") - F.col("b"), 6).alias("difference"))
