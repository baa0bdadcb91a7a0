"""Operators on documents, against brute force on hand-made and given rows."""

import hashlib
import json
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import Row
from pyspark.sql import functions as F

from larkspur.llm import bpe_lexicon, chat_format, exact_dedup, mixing, quality_rules, queries, simhash, token_binary
from larkspur.llm.shared import shared_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, row string, member string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977} x{i % 89}" for i in range(20_000))


def _rows():
    texts = ["", None, "one", "One ONE  one", "a b c d e f g h i a b c d e f g h i", "same\nsame\n\nsame \x0b x", "äöü ß İ <|endoftext|>x $#|", LONG, LONG, "tab\tand nbsp em \n lead", "one", " ", "\n", "héllo wörld é combining", "<|startoftext|> it's we'll 12345 ...!!"]
    rows = [(i, t, "en", ["b", "a", None, "c"][i % 4], None, 1, "r", None) for i, t in enumerate(texts)]
    return rows + [(None, "one", None, None, 3, None, None, "m"), (3, "One ONE  one", "en", "c", None, 1, "r", None), (40, None, None, "a", None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def given(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path(name))


def test_token_blocks(spark, docs, given, empty):
    tokenizer = library("word_bpe_49k.json")
    for df in (docs, given, empty):
        path = shared_path(spark, "t")
        token_binary.write_token_file(df, path, queries.tokenizer_path("word_bpe_49k.json"), block_tokens=5000)
        got = sorted((tuple(r) for r in token_binary.read_documents(spark, path).collect()), key=lambda r: r[1])
        rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        want, start = [], 0
        for doc, text in rows:
            ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
            want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
        assert got == want
    path = shared_path(spark, "t")
    token_binary.write_token_file(given, path, queries.tokenizer_path("word_bpe_49k.json"))
    asked = spark.createDataFrame([(3, 0), (3, 5), (9, 10**6), (10**9, 1)], "doc_id long, position long")
    text = given.where("doc_id = 3").first().text
    ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
    assert sorted(map(tuple, token_binary.tokens_at(spark, path, asked).collect())) == [(3, 0, ids[0]), (3, 5, ids[5]), (9, 10**6, None)]
    twice = spark.createDataFrame([(1, "one two"), (1, "three"), (2, "x"), (1, None), (None, "y")], "doc_id long, text string")
    token_binary.write_token_file(twice, path := shared_path(spark, "t"), queries.tokenizer_path("word_bpe_49k.json"), block_docs=2)
    asked = spark.createDataFrame([(1, 0), (1, 0), (1, 1), (2, 1), (5, 0), (None, 0), (2, None)], "doc_id long, position long")
    one, two, three = (tokenizer.encode(w, add_special_tokens=False).ids[0] for w in ("one", "two", "three"))
    want = [(1, 0, one), (1, 0, three), (1, 0, 2), (1, 1, two), (1, 1, 2), (1, 1, None), (2, 1, 2), (2, None, None)]
    assert sorted(map(str, map(tuple, token_binary.tokens_at(spark, path, asked).collect()))) == sorted(map(str, want))


def test_known_chunks_are_bounded():
    """Small generations: chunks are forgotten and learnt again."""
    texts = [f"word{i % 50}, new{i} end." for i in range(400)]
    words = token_binary.ChunkEncoder(queries.tokenizer_path("word_bpe_49k.json"), keep=60)
    want = [e.ids for e in library("word_bpe_49k.json").encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(i, "<u4").tolist() for at in range(0, 400, 20) for i in words.encode(texts[at : at + 20], b"")] == want
    codec = bpe_lexicon.Codec(queries.tokenizer_path("byte_bpe_50k.json"), None, keep=60)
    want = [e.ids for e in library("byte_bpe_50k.json").encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(i, "<u4").tolist() for at in range(0, 400, 20) for i in codec.encode(texts[at : at + 20])] == want
    assert len(codec.known) + len(codec.old) < 200 and len(words.known) + len(words.old) < 300


def test_block_random_access():
    ids = np.random.default_rng(1).integers(0, 1 << 26, 3000).astype(np.uint32)
    ids[::3] %= 200
    block = token_binary.Block(token_binary.pack(ids, [5, None], np.array([0, 1000, 3000])))
    assert [block.token(i) for i in range(3000)] == ids.tolist()
    assert block.tokens(17, 2500).tolist() == ids[17:2500].tolist() and block.document(1).tolist() == ids[1000:].tolist()
    assert block.doc_ids == [5, None] and len(token_binary.Block(token_binary.pack(ids[:0], [], np.array([0])))) == 0


def _quality(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    wins = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if wins[tuple(words[i : i + 8])] > 1 for k in range(8)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_quality(docs, given, empty):
    for df in (docs, given):
        got = sorted(quality_rules.judge(df).select("doc_id", *[f"_q_{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "fails_base")]).collect(), key=str)
        assert list(map(tuple, got)) == sorted(((r.doc_id, *_quality(r.text)) for r in df.collect()), key=str)
    assert quality_rules.judge(empty).count() == 0
    assert quality_rules.keep_documents(docs).columns == docs.columns
    kept = quality_rules.keep_documents(given).count()
    assert kept == given.count() - sum(_quality(r.text)[-1] for r in given.collect())


def test_bad_host_is_rejected(spark):
    good = " ".join(f"word{i}" for i in range(30))
    rows = [(i, good + str(i), f"h{i % 10}") for i in range(400)]
    rows += [(1000 + i, "too short" if i % 10 else good, "bad") for i in range(100)] + [(2000, "short", "tiny"), (2001, good, "tiny")]
    out = {r.doc_id: r._q_kept for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(out[i] for i in range(400)) and not any(out[1000 + i] for i in range(100)) and out[2001] and not out[2000]


def test_bpe(docs, given, empty):
    tokenizer = library("byte_bpe_50k.json")
    path = queries.tokenizer_path("byte_bpe_50k.json")
    for df in (docs, given, empty):
        got = sorted(bpe_lexicon.encoded(df, path, ["doc_id"], size=300).collect(), key=str)
        want = []
        for r in df.collect():
            ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
            want.append((r.doc_id, np.array(ids, "<u4").tobytes(), tokenizer.decode(ids, skip_special_tokens=False)))
        assert [(a, bytes(b), c) for a, b, c in got] == [(a, b, c) for a, b, c in sorted(want, key=lambda r: str(Row(doc_id=r[0], ids=bytearray(r[1]), decoded=r[2])))]


def test_lexicon_is_minimal(tmp_path):
    words = {w.encode(): [i, i + 1][: 1 + i % 2] for i, w in enumerate(["tap", "taps", "top", "tops", "stop", "stops", "über", "t", ""])}
    words.pop(b"")
    lexicon = bpe_lexicon.Lexicon.compile(words)
    lexicon.save(f"{tmp_path}/x")
    again = bpe_lexicon.Lexicon.open(f"{tmp_path}/x")
    asked = [*words, b"ta", b"tapsx", b"zz", b""]
    ranks = again.ranks(asked)
    assert ranks.tolist()[-4:] == [-1] * 4
    assert all(again[r] == np.array(words[w], "<u4").tobytes() for w, r in zip(words, ranks))
    suffixes = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for word in words for p in (word[:i] for i in range(len(word) + 1))}
    assert len(again.final) == len(suffixes)


def test_bpe_plain_splits_agree():
    tokenizer = library("byte_bpe_50k.json")
    rng = np.random.default_rng(5)
    codec = bpe_lexicon.Codec(queries.tokenizer_path("byte_bpe_50k.json"), None)
    alphabet = list("ab1.' \n\té") + ["'s", "<|endoftext|>", " ", "  ", "日", "\x1c", "\x85"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 12))) for _ in range(3000)]
    assert [np.frombuffer(i, "<u4").tolist() for i in codec.encode(texts)] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    words = token_binary.ChunkEncoder(queries.tokenizer_path("word_bpe_49k.json"))
    alphabet += [".,", "A", "!", "", "́", "<|startoftext|>", "\x0b"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 12))) for _ in range(3000)]
    want = [e.ids for e in library("word_bpe_49k.json").encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(i, "<u4").tolist() for i in words.encode(texts, b"")] == want


def test_mixing(docs, given, empty):
    for df in (docs, given):
        rows = mixing.taken_words(df).collect()
        again = mixing.taken_words(df.repartition(7, "source").orderBy(F.desc("doc_id")))
        assert sorted(map(str, rows)) == sorted(map(str, again.collect())) == sorted(map(str, mixing.taken_words(df.repartition(3)).collect()))
        sizes = defaultdict(int)
        for r in df.collect():
            sizes[r.source] += len(WORD.findall(r.text or ""))
        want = mixing.targets(dict(sizes))
        assert sorted(str((r.doc_id, len(WORD.findall(r.text or "")), sizes[r.source], want[r.source])) for r in df.collect()) == sorted(str((r.doc_id, r["size"], r.source_size, r.target)) for r in rows)
        assert all(0 <= r.taken <= 3 * r["size"] for r in rows)
        taken = Counter()
        for r in rows:
            taken[r.target] += r.taken
        goal = Counter()
        for t in want.values():
            goal[t] += t
        assert all(abs(taken[t] - goal[t]) <= 2 * mixing.BLOCK * 12 for t in goal)
    assert mixing.taken_words(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    mixed = mixing.mixed_documents(given)
    words = sum(len(WORD.findall(r.text)) for r in mixed.collect())
    assert mixed.columns == given.columns and words == sum(r.taken for r in mixing.taken_words(given).collect())


def test_mixing_against_plain_draws(spark):
    """Every row's words by laying out the blocks and slots one by one; equal rows are copies."""
    rows = [(i, " ".join(f"w{j}" for j in range(i * 37 % 300)), "abcde"[i * i % 5], i) for i in range(120)] + [(5, "same words here", "a", 0)] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, other int")
    plain = df.select("doc_id", "text", "source")
    keyed = plain.withColumns(mixing.row_keys(plain)).groupBy("__k1", "__k2", "doc_id", "text", "source").count().collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[2]] += len(r[1].split())
    goal = mixing.targets(dict(sizes))
    hashes = {(r["__k1"], r["__k2"]): r.h for r in plain.withColumns(mixing.row_keys(plain)).select("__k1", "__k2", F.xxhash64("__k1", "__k2").alias("h")).collect()}
    used = Counter()
    for s in mixing.slots(spark, [sizes[s] for s in goal], list(goal.values())).collect():
        used[s.source_no, s.block] += 1
    want = []
    for no, name in enumerate(goal):
        mine = [r for r in keyed if r.source == name]
        runs = -(-sum(r["count"] for r in mine) // mixing.RUN)
        mine.sort(key=lambda r: (hashes[r["__k1"], r["__k2"]] % runs, r["__k1"], r["__k2"]))
        at = 0
        for r in mine:
            for _ in range(r["count"]):
                n = len(r.text.split())
                want.append((r.doc_id, n, sum(used[no, w // mixing.BLOCK] for w in range(at, at + n))))
                at += n
    assert sorted((r.doc_id, r["size"], r.taken) for r in mixing.taken_words(df).collect()) == sorted(want)
    words = Counter()
    for r in mixing.mixed_documents(df).collect():
        words[r.doc_id] += len(r.text.split())
        assert all(part in df_text for df_text in [next(t for i, t, _, o in rows if i == r.doc_id and o == r.other)] for part in r.text.split("\n"))
    assert sum(words.values()) == sum(w for _, _, w in want)


def test_large_draws_follow_the_distribution(monkeypatch):
    rng = np.random.default_rng(1)
    for good, bad, take in ((300, 700, 250), (900, 100, 40), (5, 4000, 2000), (7, 0, 3), (0, 7, 3), (4, 4, 8)):
        monkeypatch.setattr(mixing, "LARGE", 0)
        mine = np.array([mixing.hypergeometric(good, bad, take, rng) for _ in range(3000)])
        monkeypatch.setattr(mixing, "LARGE", 10**9)
        total = good + bad
        mean, var = take * good / total, take * good / total * bad / total * (total - take) / max(total - 1, 1)
        assert mine.min() >= max(0, take - bad) and mine.max() <= min(good, take)
        assert abs(mine.mean() - mean) < 5 * (var / 3000) ** 0.5 + 1e-9 and abs(mine.var() - var) < 0.15 * var + 1e-9
    huge = mixing.hypergeometric(3 * 10**12, 5 * 10**12, 2 * 10**12, rng)
    assert abs(huge - 75 * 10**10) < 10**7


def test_targets_and_permutations():
    assert mixing.targets({"a": 100, "b": 100, None: 100}) == {"a": 50.0, "b": 100.0, None: 150.0}
    capped = mixing.targets({"a": 1000, "b": 1, "c": 10})
    assert capped["b"] == 3 and capped["c"] == 30 and abs(capped["a"] - 978) < 1e-9
    for n in (1, 2, 3, 64, 65, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 7).tolist()) == list(range(n))
    plan = mixing._shard_plan((5000, 0, 70, 3), 5, 3)
    parts = [plan(i) for i in range(5)]
    assert sum(c for c, _ in parts).tolist() == [5000, 0, 70, 3]
    assert all((parts[i][1] + parts[i][0]).tolist() == parts[i + 1][1].tolist() for i in range(4))
    assert [int(c.sum()) for c, _ in parts] == [1024] * 4 + [5073 - 4096]


def _fp(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def _components(rows):
    """{fingerprint: smallest doc_id reachable}, all pairs compared."""
    fps = sorted({f for _, f in rows})
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    low = {}
    for doc, f in rows:
        if doc is not None:
            low[root(f)] = min(doc, low.get(root(f), doc))
    return {f: low.get(root(f)) for f in fps}


def test_simhash(docs, given, empty):
    for df in (docs, given):
        rows = [(r.doc_id, _fp(r.text)) for r in df.collect()]
        names = _components(rows)
        got = sorted(str((r.doc_id, r.fp & (1 << 64) - 1, r.component_id)) for r in simhash.near_duplicates(df).collect())
        assert got == sorted(str((d, f, names[f])) for d, f in rows)
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_documents(empty).count() == 0
    kept = simhash.keep_documents(given)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(names.values()))


def test_large_buckets_stream_past_their_planes(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 12, np.uint64)
    fps = np.unique(np.concatenate([base[rng.integers(0, 12, 3000)] ^ (np.uint64(1) << rng.integers(0, 5, 3000, np.uint64)) ^ (np.uint64(1) << rng.integers(0, 9, 3000, np.uint64)), base]))
    table = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    want = _roots(simhash.links(table))
    monkeypatch.setattr(simhash, "TILE", 5)
    monkeypatch.setattr(simhash, "STREAM", 9)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert _roots(simhash.links(table)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def _roots(links):
    return {r.node: r.root for r in simhash.components(links).collect()}


def test_sliced_links_find_every_pair(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = {int(x) for x in base} | {0, (1 << 64) - 1, 7}
    while len(fps) < 700:
        f = int(rng.choice(base))
        for b in rng.choice(64, rng.integers(1, 6), replace=False):
            f ^= 1 << int(b)
        fps.add(f)
    fps = np.array(sorted(fps), np.uint64)
    a, b = simhash.sliced_links(fps, np.zeros(len(fps), np.int64), np.ones(len(fps), bool))
    want = {(i, j) for i in range(len(fps)) for j in range(len(fps)) if i != j and (int(fps[i]) ^ int(fps[j])).bit_count() <= 3}
    assert set(zip(a.tolist(), b.tolist())) == want
    signed = fps.view(np.int64).tolist()
    names = _components([(f, f & (1 << 64) - 1) for f in signed])
    old, simhash.TILE = simhash.TILE, 5
    try:
        df = spark.createDataFrame([(f,) for f in signed], "fp long")
        roots = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    finally:
        simhash.TILE = old
    assert all(roots.get(f, f) == names[f & (1 << 64) - 1] for f in signed)


def test_exact(spark, docs, given, empty):
    for df in (docs, given, empty):
        path = shared_path(spark, "t")
        exact_dedup.build_index(df, path, capacity=20_000)
        got = exact_dedup.groups(spark, path).select("member.doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
        by = defaultdict(list)
        for r in df.collect():
            by[r.text or ""].append(r.doc_id)
        want = []
        for text, ids in by.items():
            top = max((i for i in ids if i is not None), default=None)
            for k, i in enumerate(ids):
                want.append((i, top, len(ids), i == top and i not in ids[:k], hashlib.sha256(text.encode()).hexdigest()))
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
        kept = exact_dedup.keep_documents(df)
        assert kept.columns == df.columns and sorted(r.text or "" for r in kept.collect()) == sorted(by)


def test_exact_chains_equal_keys_and_directory():
    import pyarrow as pa

    member = pa.struct([("doc_id", pa.int64())])
    batch = pa.RecordBatch.from_arrays([pa.array([5, 5, 5, 9]), pa.array(["x", "y", "x", "x"]), pa.array([[{"doc_id": 1}], [{"doc_id": 7}], [{"doc_id": 3}, {"doc_id": None}], [{"doc_id": 2}]], pa.list_(member))], ["key", "text", "members"])
    out = [r for b in exact_dedup._own(pa.list_(member), member, "doc_id")([batch]) for r in b.to_pylist()]
    heads = [(r["key"], r["chain"], r["text"], r["best"]["doc_id"], r["n"]) for r in out if r["text"] is not None]
    assert heads == [(5, 0, "x", 3, 3), (5, 1, "y", 7, 1), (9, 0, "x", 2, 1)]


def test_exact_directory_doubles_where_it_is_overfull():
    keys = {5 << 40: 60, (5 << 40) + 1: 60, (5 << 40) + (1 << 38): 3, 1 << 63: 30, (1 << 64) - 1: 90, 7: 4}
    asked = []

    def weigh(prefixes, up, depth):
        asked.append((up, depth, len(prefixes)))
        out = {}
        for key, size in keys.items():
            if key >> (64 - up) in prefixes:
                old, n = out.get(key >> (64 - depth), (0, 0))
                out[key >> (64 - depth)] = old + size, n + 1
        return {p: (size, n > 1) for p, (size, n) in out.items()}

    found = exact_dedup.directory(weigh, 50, step=6)
    starts = [p << (64 - local) for p, local in found]
    assert starts == sorted(starts) and starts[0] == 0 and sum(2.0**-local for _, local in found) == 1
    held = [sum(s for k, s in keys.items() if a <= k < b) for a, b in zip(starts, [*starts[1:], 1 << 64])]
    many = [sum(a <= k < b for k in keys) for a, b in zip(starts, [*starts[1:], 1 << 64])]
    assert sum(held) == 247 and all(h <= 50 or n == 1 for h, n in zip(held, many))
    assert max(local for _, local in found) == 64 and all(n == 1 for _, _, n in asked)
    assert exact_dedup.directory(lambda *_: {}, 10) == [(0, 0)]


@pytest.mark.parametrize("total", [1 << 40, 100 << 40])
def test_exact_directory_of_a_large_table_stays_small(total):
    """Evenly spread texts of 1 and 100 TB: how many prefixes a count brings back."""
    asked, capacity = [], max(exact_dedup.CAPACITY, total // exact_dedup.BUCKETS)

    def weigh(prefixes, up, depth):
        below = 1 << (depth - up)
        asked.append(len(prefixes) * below)
        return {p * below + i: (total >> depth, True) for p in prefixes for i in range(below)}

    found = exact_dedup.directory(weigh, capacity)
    assert max(asked) <= 1 << exact_dedup.ASKED and len(found) <= 2 * exact_dedup.BUCKETS
    assert all(total >> local <= capacity for _, local in found) and sum(2.0**-local for _, local in found) == 1


def test_chat(spark, sf):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "<|end|>\\</s>[INST] x"), (1, 1, "assistant", "b"), (2, None, None, None), (None, 3, "system<|body|>", "\\\\n"), (3, 5, "assistant", ""), (3, 4, "user", "é\n")]
    rows += [(4, i, "assistant", f"t{i}") for i in range(1000, 0, -1)] + [(5, 7, "user", f"{i:04d}") for i in range(600)]
    turns = chat_format.turns_of_table(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, segment int"))
    given = chat_format.turns_of_table(spark.read.parquet(f"{sf}/conversations.parquet"))
    for df in (turns, given, turns.limit(0)):
        segments = chat_format.formatted(df)
        got = sorted(map(str, map(tuple, chat_format.read_back(segments).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256").collect())))
        by = defaultdict(list)
        for r in df.collect():
            by[r.conv_id].append((r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
        want = []
        for conv, t in by.items():
            t.sort()
            loss = "".join(x for _, _, r, x in t if r == "assistant")
            want.append(str((conv, len(t), hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in t).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())))
        assert got == sorted(want)
        for s in segments.limit(50).collect():
            bare = re.sub("|".join(map(re.escape, (chat_format.TURN, chat_format.BODY, chat_format.END))), "", s.formatted)
            assert not any(c in bare for c in chat_format.CONTROL)


def test_chat_order_around_a_repeated_turn(spark):
    rows = [(conv, turn, role, f"{turn} {i}") for conv in (1, None) for turn, n in ((None, 1), (0, 1), (1, 300), (2, 2), (3, 300), (300, 1)) for i in range(n) for role in (["user", "assistant"][i % 2],)]
    rows += [(2, t, "assistant", f"only {t}") for t in range(600)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role, text))
    want = {}
    for conv, t in by.items():
        t.sort()
        loss = "".join(x for _, _, r, x in t if r == "assistant")
        want[conv] = (len(t), hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in t).encode()).hexdigest(), hashlib.sha256(loss.encode()).hexdigest())
    got = chat_format.read_back(chat_format.formatted(df)).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_sha256) for r in got} == want


def test_chat_layouts(spark):
    layouts = [
        {"prompt": "p", "response": "r", "extra": 1},
        {"instruction": "p", "output": "r"},
        {"instruction": "p", "input": "q", "output": "r"},
        {"messages": [{"role": "user", "content": "p"}, {"role": "assistant", "content": "r"}]},
        {"id": 3, "conversations": [{"from": "user", "value": "p"}, {"from": "assistant", "value": "r"}]},
        {"completion": "r", "prompt": "p", "messages": []},
        {"unknown": 1},
    ]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(layouts)] + [(90, None), (91, "{"), (92, "[1]")], "id long, body string")
    out = defaultdict(list)
    for r in chat_format.turns_of_json(df, "id", "body").orderBy("turn").collect():
        out[r.conv_id].append((r.role, r.text))
    assert out == {i: [("user", "p\n\nq" if i == 2 else "p"), ("assistant", "r")] for i in range(6)}
    assert {r.id for r in chat_format.unmapped(df, "id", "body").collect()} == {6, 90, 91, 92}
    nested = df.where("id = 3").select(F.col("id").alias("conv_id"), F.from_json("body", "messages array<struct<role:string,content:string>>").messages.alias("messages"))
    assert [(r.role, r.text) for r in chat_format.turns_of_table(nested).orderBy("turn").collect()] == [("user", "p"), ("assistant", "r")]
