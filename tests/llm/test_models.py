"""Suffix dedup, language-model scoring and toxicity against brute force."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from larkspur.llm import lm_scoring, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string, spans string, k1 long, gram string"


def _removed(texts):
    count = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                gone[i] += 1
                gone[i + 200] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        runs = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return out


def _made():
    rng = np.random.default_rng(2)
    word = lambda n: " ".join("".join(rng.choice(list("abcdefghiöß"), rng.integers(2, 9))) for _ in range(n))
    shared = [word(60) for _ in range(4)]
    texts = [word(30) + shared[i % 4][: 150 + 13 * i] + word(int(rng.integers(0, 40))) for i in range(30)]
    texts += [shared[0][5:], shared[0], word(10) + shared[1] + shared[1] + word(3), "a" * 700, "ab" * 300, "x" + "ab" * 300, "a" * 199, "a" * 200]
    texts += [texts[3], texts[3], texts[5][:250] + "!" + texts[5][251:], texts[5] + "x", "y" + texts[5], "", None, shared[2][:200], shared[2][1:201]]
    return texts


@pytest.mark.parametrize("bucket, most, common", [(8192, 65536, 64), (4, 6, 1)])
def test_suffix_dedup(spark, sf, bucket, most, common, monkeypatch):
    """Small buckets end inside grams, so that windows meet across buckets."""
    for name, value in (("BUCKET", bucket), ("MOST", most), ("COMMON", common)):
        monkeypatch.setattr(suffix_dedup, name, value)
    made = spark.createDataFrame([(None if i == 4 else i // 2, t, "s", 1, "g") for i, t in enumerate(_made())], SCHEMA)
    given = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    for df in (made, given):
        got = sorted(map(str, map(tuple, suffix_dedup.deduplicated(df).collect())))
        rows = df.collect()
        want = sorted(str((r.doc_id, *x)) for r, x in zip(rows, _removed([(r.text or "").encode() for r in rows])))
        assert got == want
    assert suffix_dedup.deduplicated(made.limit(0)).count() == 0


def test_suffixes_are_in_order():
    rng = np.random.default_rng(4)
    strings = [rng.choice(list(b"\x00ab\xff"), rng.integers(0, 30), p=[0.2, 0.5, 0.2, 0.1]).astype(np.uint8).tobytes() for _ in range(500)] + [b"ab" * 9] * 3
    length = np.array([len(x) for x in strings])
    group = rng.integers(0, 3, len(strings))
    data = np.frombuffer(b"".join(strings) + b"x", np.uint8)
    start = np.cumsum(length) - length
    order, common = suffix_dedup.multikey_order(suffix_dedup._words(data, start, 1, length, 30), length, group)
    ranked = [(group[i], strings[i]) for i in order]
    assert ranked == sorted(zip(group, strings))
    for (g, x), (h, y), n in zip(ranked, ranked[1:], common[1:]):
        shared = next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
        assert n == (shared if g == h else -1)
    back = suffix_dedup._words(data, start + length - 1, -1, length, 30)
    order, _ = suffix_dedup.multikey_order(back, length, group * 0)
    assert [strings[i][::-1] for i in order] == sorted(x[::-1] for x in strings)


def test_anchor_in_every_window():
    texts = [t.encode() for t in _made() if t]
    text, pos, right, gram, context = suffix_dedup.Anchors()(texts)
    for k, t in enumerate(texts):
        mine = sorted(pos[text == k].tolist())
        for s in range(len(t) - 199):
            assert any(s <= p <= s + suffix_dedup.BEFORE for p in mine)


@pytest.mark.parametrize("chunk, share", [(lm_scoring.CHUNK, lm_scoring.SHARE), (500, 300)])
def test_lm_keeps_every_word_and_bigram(spark, sf, chunk, share):
    made = [(None, None), (7, " "), (8, "zzq zzr zzq zzr"), (8, "zzq zzr zzq zzr"), (9, "zzs zzt, zzt")]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string"))
    target = spark.read.parquet(f"{sf}/benchmark.parquet").select("text")
    texts = {"t": [r.text or "" for r in target.collect()], "b": [r.text or "" for r in docs.collect()]}
    pair, word, before = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for name, several in texts.items():
        for t in several:
            w = lm_scoring.words(t)
            pair[name].update(zip([b"", *w], w))
            before[name].update([b"", *w][: len(w)])
            word[name].update(w)
    size = len(word["t"] | word["b"])
    tokens = {name: sum(word[name].values()) for name in texts}

    def loss(name, w):
        out = 0.0
        for v, x in zip([b"", *w], w):
            alone = (word[name][x] + lm_scoring.ADD) / (tokens[name] + lm_scoring.ADD * size)
            seen = before[name][v]
            out -= math.log(lm_scoring.MIX * pair[name][v, x] / seen + (1 - lm_scoring.MIX) * alone if seen else alone)
        return round(out / len(w), 5)

    found = lm_scoring.scored(docs, target, chunk, share).collect()
    want = [(r.doc_id, lm_scoring.words(r.text or "")) for r in docs.collect()]
    close = lambda x: None if x is None else round(x, 5)
    key = lambda r: str(r[:2])
    got = sorted(((r.doc_id, r.n_tokens, close(r.target_loss), close(r.background_loss)) for r in found), key=key)
    want = sorted(((i, len(w), loss("t", w) if w else None, loss("b", w) if w else None) for i, w in want), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:2] == b[:2] and all(x == y or abs(x - y) < 2e-5 for x, y in zip(a[2:], b[2:])), (a, b)
    assert lm_scoring.scored(docs.limit(0), target.limit(0)).count() == 0
    assert lm_scoring.scored(docs, target.limit(0)).count() == len(want)


def test_toxicity_held_out(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    out = toxicity.scores(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.predicted == r.toxic for r in out) / len(out)
    caught = sum(r.predicted for r in out if r.toxic) / sum(r.toxic for r in out)
    assert hit > 0.98 and caught >= 0.9
    assert sum(r.predicted for r in out if not r.toxic) <= 0.01 * len(out)


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None), (None, ""), (3, "you idiot"), (3, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    out = toxicity.scores(docs, toxicity.train(docs, labels)).collect()
    assert len(out) == 4 and all(0 <= r.score <= 1 for r in out)
    none = toxicity.train(docs.limit(0), labels.limit(0))
    assert toxicity.scores(docs.limit(0), none).count() == 0 and all(r.score < 1e-9 for r in toxicity.scores(docs, none).collect())


def test_label_model_discounts_copies():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.2
    noisy = lambda p, q: np.where(truth, rng.random(4000) < p, rng.random(4000) < q).astype(float)
    one = noisy(0.6, 0.1)
    votes = np.stack([one, one, one, noisy(0.7, 0.05), noisy(0.7, 0.05), noisy(0.6, 0.05)], axis=1)
    post, rates, weight = toxicity.label_model(votes, votes.mean(axis=1) > 0.5)
    assert weight[0] < 0.5 < weight[4] and ((post > 0.5) == truth).mean() > 0.9
    assert abs(rates[1][4] - 0.7) < 0.15


def test_label_model_finds_planted_rates_and_correlations():
    """Voters of known rates, two of which follow a third most of the time; no label is seen."""
    rng = np.random.default_rng(4)
    truth = rng.random(20_000) < 0.15
    planted = [(0.8, 0.05), (0.7, 0.02), (0.6, 0.1), (0.75, 0.04), (0.5, 0.03), (0.65, 0.05)]
    votes = [np.where(truth, rng.random(len(truth)) < p, rng.random(len(truth)) < q) for p, q in planted]
    follow = lambda v: np.where(rng.random(len(v)) < 0.8, v, rng.random(len(v)) < 0.2)
    votes = np.stack([*votes, follow(votes[2]), follow(votes[2])], axis=1).astype(float)
    post, rates, weight = toxicity.label_model(votes, np.where(votes.sum(axis=1) >= toxicity.START, 0.9, 0.1))
    assert abs(post.mean() - truth.mean()) < 0.02 and ((post > 0.5) == truth).mean() > 0.97
    for j, (p, q) in enumerate(planted):
        assert abs(rates[1][j] - p) < 0.08 and abs(rates[0][j] - q) < 0.04, j
    assert max(weight[[2, 6, 7]]) < 0.75 * min(weight[[0, 1, 3, 4, 5]])


def test_scores_with_long_texts_and_clashing_columns(spark):
    rng = np.random.default_rng(6)
    filler = lambda: " ".join(f"{chr(97 + j % 26)}word{chr(97 + j // 26)}" for j in rng.integers(0, 300, 15))
    rows = [(i, filler() + (" you " + " ".join(rng.choice(["stupid", "idiot", "moron", "scum"], 3)) if i % 4 == 0 else "")) for i in range(400)]
    rows += [(490, "calm words " * 200_000), (491, None), (492, "")]
    docs = spark.createDataFrame([(*r, "x", 1, True, 0.5, "t") for r in rows], "doc_id long, text string, _text string, _toxic int, held_out boolean, score double, features string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), "x") for i in range(400)], "doc_id long, toxic int, _text string")
    out = {r.doc_id: r.predicted for r in toxicity.scores(docs, toxicity.train(docs, labels)).collect()}
    assert len(out) == 403 and sum(out[i] == int(i % 4 == 0) for i in range(400)) > 390 and out[490] == 0
    scored = lm_scoring.scored(docs.withColumnsRenamed({"score": "n_tokens", "features": "difference"}), spark.createDataFrame([(1, "calm words")], "item_id long, text string")).collect()
    assert {r.doc_id: r.n_tokens for r in scored}[490] == 400_000
