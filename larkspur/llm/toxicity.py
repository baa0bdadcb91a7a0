"""Toxicity by weak supervision.

Voters look for one thing each: lexicon voters hold words, pattern voters hold word
beginnings, shouting, or calls.  Some hold fixed lists (``LEXICONS``), the others lists
that are mined from labelled training rows, and the labels are one voter more.  A
generative label model (two classes, EM, begun from the number of votes alone) estimates
every voter's rates in both classes and, from what its votes leave unexplained, the
correlations between voters; a voter that others repeat counts for less.  A linear classifier on word and word-beginning
features is trained on the posterior labels, and scores every whole text.

Features are the 20-bit hashes of a text's distinct words and their first 3, 4, 5
and 6 letters.  Only labelled rows outside the held-out fifth are learned from, at most
``MAX_ROWS`` of them (those with the least hash of their id), so what reaches the
driver is bounded; the model is a few thousand weights.  Ids, sources, languages and
labels are never inputs of a score.

Defined cases: null and empty texts get the score of no features; rows without a label
are scored and not learned from; of repeated labels the largest counts; where no row
is labelled, or one class is missing, every score is 0; of rows that share an id the one
with the least features is learned from; empty tables give empty results.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from copy import copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.shared import text_of

#: Rows that the voters, the label model and the classifier learn from.
MAX_ROWS = 8000
BITS = 20
FOLDS = 5
#: Votes from which a text is taken for toxic before the voters' rates are known.
START = 3
#: Letters of a word's beginnings that are features.
BEGINNINGS = (3, 4, 5, 6)
#: Features that the classifier weighs, and words or beginnings per mined voter list.
FEATURES, LEXICON_VOTERS, PATTERN_VOTERS = 4096, 12, 8
#: Standard errors by which a feature's log-odds must exceed zero to be mined, and what is
#: added to the classifier's bias, toxic rows being few: the pair that does best on parts
#: of the training rows that a fit has not seen.
SURE, OFFSETS, PARTS = (3.0, 3.25, 3.5, 4.0), (0.0, 0.5, 1.0, 1.5), 3
# Fixed word lists of voters that no label has a part in.
LEXICONS = {
    "insult": "idiot moron stupid dumb fool imbecile loser clown jerk dunce coward liar",
    "contempt": "trash garbage scum filth vermin worthless pathetic disgusting useless ugly",
    "hostility": "hate kill die hurt destroy threat shut",
    "profanity": "damn crap bastard bitch ass shit fuck",
}
_WORD = re.compile(r"[^\W\d_]+")
_SHOUT, _CALL = re.compile(r"\b[^\W\d_a-zß-ÿ]{4,}\b"), re.compile(r"!!")


def features(word: str) -> tuple[int, ...]:
    """Hashes of the word and of its beginnings; the lowest bit tells words apart."""
    out = [zlib.crc32(b"w" + word.encode()) >> (32 - BITS) | 1]
    for n in BEGINNINGS:
        if len(word) > n:
            out.append((zlib.crc32(b"%d" % n + word[:n].encode()) >> (32 - BITS)) & ~1)
    return tuple(out)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


@dataclass
class Model:
    bias: float
    weights: dict[int, float]

    def word_weights(self, word: str) -> tuple[int, ...]:
        return tuple(f for f in features(word) if f in self.weights)

    def score(self, found: set[int]) -> float:
        return float(1 / (1 + np.exp(-(self.bias + sum(self.weights[f] for f in sorted(found))))))


def _training_rows(docs: DataFrame, labels: DataFrame, rows: int) -> pa.Table:
    """(doc_id, features, toxic, shouts, calls) of the sampled training rows, by doc_id.

    The ids are chosen from the small labels table alone, so only a bounded set of ids
    is sent to the scan of the texts.
    """
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            found = [sorted({f for w in set(_WORD.findall(t.lower())) for f in features(w)}) for t in texts]
            flags = [[bool(p.search(t)) for t in texts] for p in (_SHOUT, _CALL)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_toxic"), *map(pa.array, flags), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "toxic", "shouts", "calls", "features"])

    texts = docs.select("doc_id", text_of().alias("_text")).join(F.broadcast(sample), "doc_id").select("doc_id", "_toxic", "_text")
    found = texts.mapInArrow(read, "doc_id long, toxic int, shouts boolean, calls boolean, features array<int>")
    found = found.groupBy("doc_id").agg(F.min(F.struct("features", "toxic", "shouts", "calls")).alias("r")).select("doc_id", "r.*")
    return found.toArrow().sort_by("doc_id").combine_chunks()


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior, rates by class, weights) of a two-class model of the votes.

    ``start`` is a first guess of the posterior.  After each fit the correlation of two
    voters within a class is what their joint rate has over the product of their own;
    a voter's evidence is divided by one plus the sum of its correlations.
    """
    n, m = votes.shape
    post = start.astype(float)
    weight = np.ones(m)
    rates = np.zeros((2, m))
    for _ in range(rounds):
        inside = np.stack([1 - post, post])
        mass = inside.sum(axis=1)
        rates = (inside @ votes + 0.5) / (mass[:, None] + 1.0)
        linked = np.zeros((m, m))
        for c in range(2):
            off = votes - rates[c]
            cov = (off * inside[c][:, None]).T @ off / max(mass[c], 1.0)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            linked += np.abs(cov / sd[:, None] / sd[None, :]) / 2
        np.fill_diagonal(linked, 0)
        weight = 1 / (1 + np.where(linked > 0.1, linked, 0).sum(axis=1))
        prior = np.log((mass[1] + 1) / (mass[0] + 1))
        evidence = votes * np.log(rates[1] / rates[0]) + (1 - votes) * np.log((1 - rates[1]) / (1 - rates[0]))
        new = 1 / (1 + np.exp(-np.clip(prior + evidence @ weight, -50, 50)))
        done = np.abs(new - post).max() < 1e-6
        post = new
        if done:
            break
    return post, rates, weight


def _logistic(row: np.ndarray, column: np.ndarray, n: int, m: int, target: np.ndarray, rounds: int = 400, ridge: float = 1e-4) -> tuple[float, np.ndarray]:
    """Ridge logistic regression on sparse 0/1 features by accelerated gradient steps."""
    weight, bias = np.zeros(m), 0.0
    look, look_bias = weight.copy(), bias
    size = np.bincount(row, minlength=n)
    step = 4.0 / (np.mean(size) + 1 + 1e-9)
    for k in range(rounds):
        z = look_bias + np.bincount(row, look[column], minlength=n)
        gap = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - target
        new = look - step * (np.bincount(column, gap[row], minlength=m) / n + ridge * look)
        new_bias = look_bias - step * gap.mean()
        look, look_bias = new + k / (k + 3) * (new - weight), new_bias + k / (k + 3) * (new_bias - bias)
        weight, bias = new, new_bias
    return float(bias), weight


class _Sample:
    """Training rows as arrays: labels, two flags, and (row, feature) of every feature."""

    def __init__(self, table: pa.Table):
        self.label = np.asarray(table.column("toxic")).astype(np.int64)
        self.flags = np.stack([np.asarray(table.column(c)).astype(float) for c in ("shouts", "calls")], axis=1)
        lists = table.column("features")
        sizes = np.array([len(x) for c in lists.chunks for x in c], np.int64)
        self.row = np.repeat(np.arange(len(self.label), dtype=np.int32), sizes)
        self.column = np.concatenate([np.zeros(0, np.int32), *(np.asarray(c.flatten()) for c in lists.chunks)]).astype(np.int32)

    def apart(self) -> _Sample:
        """One row of each group of near copies: copies of one toxic text would make its
        chance words look like signs.  Near copies share the four least mixed hashes of
        their features."""
        mixed = (self.column.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)
        seen, use = set(), np.zeros(len(self.label), bool)
        for i, (label, own) in enumerate(zip(self.label.tolist(), np.split(mixed, np.searchsorted(self.row, np.arange(1, len(self.label)))))):
            key = (label, *np.sort(own)[:4].tolist())
            use[i] = key not in seen
            seen.add(key)
        return self.where(use)

    def where(self, use: np.ndarray) -> _Sample:
        out, place = copy(self), (np.cumsum(use) - 1).astype(np.int32)
        out.label, out.flags = self.label[use], self.flags[use]
        inside = use[self.row]
        out.row, out.column = place[self.row[inside]], self.column[inside]
        return out

    def both(self) -> bool:
        return len(self.label) > 0 and self.label.min() != self.label.max()


def _fit(sample: _Sample, least: float) -> Model:
    """Mine voters, fit the label model, train the classifier on its posteriors."""
    label, row, column, n = sample.label, sample.row, sample.column, len(sample.label)
    seen = [np.bincount(column[label[row] == c], minlength=1 << BITS) for c in (0, 1)]
    size = [int((label == c).sum()) for c in (0, 1)]
    lift = np.log((seen[1] + 0.5) / (size[1] + 1)) - np.log((seen[0] + 0.5) / (size[0] + 1))
    sure = lift / np.sqrt(1 / (seen[0] + 0.5) + 1 / (seen[1] + 0.5))
    enough = np.flatnonzero((sure > least) & (lift > 1.5))
    enough = enough[np.argsort(-sure[enough], kind="stable")]
    lists = []
    for odd, voters in ((1, LEXICON_VOTERS), (0, PATTERN_VOTERS)):
        mined = enough[enough & 1 == odd][: FEATURES // 4]
        lists += [mined[k::voters] for k in range(voters) if len(mined[k::voters])]
    lists += [np.array([features(w)[0] for w in words.split()]) for words in LEXICONS.values()]
    votes = np.zeros((n, len(lists) + 3))
    for j, members in enumerate(lists):
        votes[row[np.isin(column, members)], j] = 1
    votes[:, -3:-1] = sample.flags
    votes[:, -1] = label  # the labels are one voter among the others
    post, _, _ = label_model(votes, np.where(votes.sum(axis=1) >= START, 0.9, 0.1))
    chosen = np.argsort(-sure, kind="stable")[:FEATURES]
    chosen = chosen[sure[chosen] > least]
    place = np.full(1 << BITS, -1)
    place[chosen] = np.arange(len(chosen))
    inside = place[column] >= 0
    bias, weight = _logistic(row[inside], place[column[inside]], n, len(chosen), post)
    return Model(bias, {int(f): float(w) for f, w in zip(chosen, weight) if abs(w) > 1e-3})


def _quality(model: Model, sample: _Sample) -> np.ndarray:
    """(caught, wrong) of the rows of ``sample`` at every offset: toxic ones found, and
    errors of both kinds."""
    weight = np.zeros(1 << BITS)
    weight[list(model.weights)] = list(model.weights.values())
    sums = model.bias + np.bincount(sample.row, weight[sample.column], len(sample.label))
    found, toxic = sums + np.array(OFFSETS)[:, None] >= 0, sample.label == 1
    return np.stack([(found & toxic).sum(axis=1), (found != toxic).sum(axis=1)])


def train(docs: DataFrame, labels: DataFrame, rows: int = MAX_ROWS) -> Model:
    """The model of the training rows, at those of ``SURE`` and ``OFFSETS`` with the best F1
    over ``PARTS`` parts of the rows, each scored by a fit of the others."""
    sample = _Sample(_training_rows(docs, labels, rows))
    if not sample.both():
        return Model(-50.0, {})
    sample = sample.apart()
    part = np.arange(len(sample.label)) % PARTS
    sums = np.zeros((len(SURE), 2, len(OFFSETS)))
    for k in range(PARTS):
        mine, rest = sample.where(part != k), sample.where(part == k)
        if mine.both():
            sums += [_quality(_fit(mine, least), rest) for least in SURE]
    f1 = 2 * sums[:, 0] / np.maximum(2 * sums[:, 0] + sums[:, 1], 1)
    _, least, less = max((float(f1[i, j]), SURE[i], -OFFSETS[j]) for i in range(len(SURE)) for j in range(len(OFFSETS)))
    model = _fit(sample, least)
    return Model(model.bias - less, model.weights)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, from whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}

        class Known(dict):
            def __missing__(self, word):
                self[word] = out = model.word_weights(word)
                return out

        known = Known()
        for batch in batches:
            found = []
            for at in range(0, batch.num_rows, 500):
                for text in batch.column("_text").slice(at, 500).to_pylist():
                    if len(known) > 500_000:
                        known.clear()
                    found.append(model.score(set().union(*map(known.__getitem__, set(_WORD.findall(text.lower()))))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found, pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), text_of().alias("_text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
