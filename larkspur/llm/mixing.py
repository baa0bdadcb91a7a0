"""Mixing sources to target weights, by blocks of words.

The words of each source are packed into blocks of fixed length, in an order fixed by
hashes of the rows' content, so that neither the files nor the partitions matter; equal
rows are folded into one with a number of copies first.  A source's quota of blocks follows its target.  Each output shard
draws its counts per source from a multinomial conditioned on the quotas that are
left (a multivariate hypergeometric), by halving the range of shards again and again,
so every shard finds its counts and first slots alone and the totals meet the quotas.
Slot i of a source maps to block perm(i mod n) of its pass i div n, perm being a
keyed Feistel permutation of the source's n blocks, and blocks are joined by index.

No block is used more often than the cap of passes; reruns agree (all draws are keyed
by the seed).  Defined cases: null text has no words; the null source comes last;
repeated rows are separate rows; sources without words get nothing; an empty table
gives an empty mix.  Other columns are not read.  The table of sources (name, words)
is collected: at most ``MAX_SOURCES`` rows, checked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.shared import row_keys, staged, text_of, whole_rows

#: Words of a block, slots of an output shard, passes over a source.
BLOCK, SHARD, PASSES, SEED = 64, 1024, 3, 17
MAX_SOURCES = 100_000
#: Rows of one run of the packing order, and runs that are summed as one.
RUN, RUNS = 1000, 1000
#: Blocks or copies of one row that a task counts, and copies that share a row of runs.
STRETCH, BAND = 4096, 1000
#: Totals from which a hypergeometric draw is made from binomial ones (numpy's limit).
LARGE = 10**9
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (1, 2, 3), passes: int = PASSES) -> dict[str | None, float]:
    """Words wanted of each source: all words shared by weight, at most ``passes`` times
    a source's own; what is over goes to the others by weight until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), list(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > passes * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = float(passes * sizes[s])
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return out


def permuted(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """Image of ``i`` under a permutation of range(n): a 4-round Feistel network over
    the next even number of bits, walked until it lands inside."""
    half = max(1, (max(2, n) - 1).bit_length() + 1 >> 1)
    mask, half_ = np.uint64((1 << half) - 1), np.uint64(half)

    def once(x):
        left, right = x >> half_, x & mask
        for r in range(4):
            m = (right + np.uint64((key * 4 + r) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
            m = (m ^ (m >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((m >> np.uint64(31)) & mask)
        return left << half_ | right

    out = once(i.astype(np.uint64))
    while len(far := np.flatnonzero(out >= n)):
        out[far] = once(out[far])
    return out.astype(np.int64)


def _log_chance(k: int, n: int, p: float) -> float:
    """Log of the binomial chance of ``k`` of ``n``, by deviances, which stay exact to
    rounding for numbers of any size."""

    def rest(x: float) -> float:  # log x! beyond Stirling's formula
        return math.lgamma(x + 1) - (x + 0.5) * math.log(x) + x - 0.5 * math.log(2 * math.pi) if x < 16 else (1 / 12 - (1 / 360 - 1 / 1260 / x / x) / x / x) / x

    def deviance(x: float, mean: float) -> float:
        gap = (x - mean) / mean
        return mean * (gap * gap / 2 - gap**3 / 6 + gap**4 / 12) if abs(gap) < 1e-4 else x * math.log(x / mean) + mean - x

    if k in (0, n):
        return n * (math.log1p(-p) if k == 0 else math.log(p))
    near = deviance(k, n * p) + deviance(n - k, n * (1 - p))
    return rest(n) - rest(k) - rest(n - k) - near + 0.5 * math.log(n / (2 * math.pi * k * (n - k)))


def hypergeometric(good: int, bad: int, take: int, rng: np.random.Generator) -> int:
    """How many of ``take`` drawn from good and bad ones are good.

    Beyond numpy's limit: a binomial draw of the fewer kind, accepted with the chance
    that a binomial draw of the other kind makes up the rest, is such a draw exactly.
    """
    if good + bad < LARGE or take in (0, good + bad) or not good or not bad:
        return int(rng.hypergeometric(good, bad, take)) if good + bad < LARGE else take if not bad else 0 if not good or not take else good
    few, many, p = min(good, bad), max(good, bad), take / (good + bad)
    best = _log_chance(min(many, int((many + 1) * p)), many, p)
    while True:
        x = int(rng.binomial(few, p))
        if 0 <= take - x <= many and math.log(rng.random() or 1e-300) <= _log_chance(take - x, many, p) - best:
            return x if good == few else take - x


def _left_share(counts: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """Multivariate hypergeometric draw, one source after the other."""
    out, rest = np.zeros(len(counts), np.int64), int(counts.sum())
    for k, n in enumerate(counts.tolist()):
        rest -= n
        out[k] = hypergeometric(n, rest, take, rng)
        take -= int(out[k])
    return out


def _shard_plan(quota: tuple[int, ...], n_shards: int, seed: int):
    """Function from a shard to (counts, first slot per source)."""
    total = sum(quota)

    def slots(lo: int, hi: int) -> int:
        return min(hi * SHARD, total) - lo * SHARD

    @lru_cache(maxsize=4096)
    def node(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        if (lo, hi) == (0, n_shards):
            return np.array(quota, np.int64), np.zeros(len(quota), np.int64)
        depth_lo, depth_hi = 0, n_shards
        path = []
        while (depth_lo, depth_hi) != (lo, hi):
            path.append((depth_lo, depth_hi))
            mid = (depth_lo + depth_hi) // 2
            depth_lo, depth_hi = (depth_lo, mid) if hi <= mid else (mid, depth_hi)
        plo, phi = path[-1]
        counts, first = node(plo, phi)
        mid = (plo + phi) // 2
        left = _left_share(counts, slots(plo, mid), np.random.default_rng([seed, plo, phi]))
        return (left, first) if lo == plo else (counts - left, first + left)

    return lambda shard: node(shard, shard + 1)


def slots(spark, sizes: list[int], goals: list[float], seed: int = SEED, block: int = BLOCK, passes: int = PASSES) -> DataFrame:
    """(shard, slot, source_no, pass, block): what stands in every slot of the mix."""
    blocks = [-(-n // block) for n in sizes]
    quota = tuple(min(round(g / block), passes * b) for g, b in zip(goals, blocks))
    total = sum(quota)
    schema = "shard long, slot int, source_no int, pass int, block long"
    if not total:
        return spark.createDataFrame([], schema)
    n_shards = -(-total // SHARD)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = _shard_plan(quota, n_shards, seed)
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                counts, first = plan(shard)
                parts = [(s, np.arange(f, f + c)) for s, (c, f) in enumerate(zip(counts, first)) if c]
                place = permuted(np.arange(int(counts.sum())), int(counts.sum()), seed * 31 + shard)
                at = 0
                for s, i in parts:
                    turn = i // blocks[s]
                    index = np.empty(len(i), np.int64)
                    for t in np.unique(turn):
                        index[turn == t] = permuted(i[turn == t] % blocks[s], blocks[s], (seed * 1009 + s) * 16 + int(t))
                    columns = [np.full(len(i), shard), place[at : at + len(i)].astype(np.int32), np.full(len(i), s, np.int32), turn.astype(np.int32), index]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shard", "slot", "source_no", "pass", "block"])
                    at += len(i)

    return spark.range(n_shards).mapInArrow(draw, schema)


KEYS = ["__k1", "__k2"]


def _run_starts(runs: DataFrame) -> DataFrame:
    """(_source_no, _run, _base): words before each run, by sums of ``RUNS`` runs first,
    so that no task has all runs of a source."""
    runs = runs.withColumn("_many", F.expr(f"_run div {RUNS}"))
    whole = Window.partitionBy("_source_no").orderBy("_many").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_source_no", "_many").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    sums = runs.groupBy("_source_no", "_many").agg(F.sum("_words").alias("_words"))
    sums = sums.select("_source_no", "_many", F.coalesce(F.sum("_words").over(whole), F.lit(0)).alias("_far"))
    near = runs.select("_source_no", "_many", "_run", F.coalesce(F.sum("_words").over(inside), F.lit(0)).alias("_near"))
    return near.join(sums, ["_source_no", "_many"]).select("_source_no", "_run", (F.col("_far") + F.col("_near")).alias("_base"))


def _counted(rows: DataFrame, name: str, first, last) -> DataFrame:
    """``rows`` once for each number from ``first`` to ``last``.

    Stretches of ``STRETCH`` numbers are dealt out before they are counted, so that a row
    with very many blocks or copies is the work of many tasks.
    """
    far = rows.withColumns({"_first": first, "_last": last}).withColumn("_stretch", F.explode(F.sequence(F.expr(f"_first div {STRETCH}"), F.expr(f"_last div {STRETCH}"))))
    far = far.repartition(*KEYS, "_stretch")
    low, high = F.greatest("_first", F.col("_stretch") * STRETCH), F.least("_last", (F.col("_stretch") + 1) * STRETCH - 1)
    return far.withColumn(name, F.explode(F.sequence(low, high))).drop("_first", "_last", "_stretch")


def mix(docs: DataFrame, keep: list[str], seed: int = SEED, weights: tuple[int, ...] = (1, 2, 3)) -> tuple[DataFrame, DataFrame]:
    """(rows, parts) of the mix of ``docs(text, source, *keep)``.

    rows: the row's keys, the columns ``keep``, _copies (equal rows), _size,
    _source_size, _target.  parts: for every block used of a row: its keys, copy, pass,
    from_word, to_word (within the row's words).
    """
    spark = docs.sparkSession
    size = F.regexp_count(text_of(), F.lit(WORD)).cast("long")
    sized = docs.select(*[x.alias(k) for k, x in row_keys(docs).items()], *keep, F.col("source").alias("_source"), size.alias("_size"))
    sized = staged(sized.groupBy(*KEYS, *keep, "_source", "_size").agg(F.count("*").alias("_copies")), "mix-rows")
    sums = sized.groupBy("_source").agg(F.sum(F.col("_size") * F.col("_copies")), F.count("*")).limit(MAX_SOURCES + 1).collect()
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: name the sources of a mix")
    sizes = {r[0]: r[1] for r in sums}
    runs = {r[0]: -(-r[2] // RUN) for r in sums}
    goal = targets(sizes, weights)
    names = list(goal)
    listed = spark.createDataFrame([(i, s, sizes[s], goal[s], runs[s]) for i, s in enumerate(names)], "_source_no int, _name string, _source_size long, _target double, _runs long")
    rows = sized.join(F.broadcast(listed), F.col("_source").eqNullSafe(F.col("_name"))).drop("_name", "_source")
    rows = rows.withColumn("_run", F.pmod(F.xxhash64(*KEYS), F.col("_runs")))
    words = F.col("_size") * F.col("_copies")
    base = _run_starts(rows.groupBy("_source_no", "_run").agg(F.sum(words).alias("_words")))
    inside = Window.partitionBy("_source_no", "_run").orderBy(*KEYS).rowsBetween(Window.unboundedPreceding, -1)
    packed = rows.where("_size > 0").select(*KEYS, "_source_no", "_run", "_size", words.alias("_words"), F.coalesce(F.sum(words).over(inside), F.lit(0)).alias("_within"))
    packed = packed.join(base, ["_source_no", "_run"]).select(*KEYS, "_source_no", "_size", "_words", (F.col("_base") + F.col("_within")).alias("_start"))
    covers = _counted(packed, "block", F.expr(f"_start div {BLOCK}"), F.expr(f"(_start + _words - 1) div {BLOCK}"))
    used = slots(spark, [sizes[s] for s in names], [goal[s] for s in names], seed)
    # Spark can't see how many slots a range makes and would broadcast them: shuffle both sides
    parts = covers.join(used.hint("merge"), (F.col("_source_no") == F.col("source_no")) & (covers["block"] == used["block"])).select(
        *KEYS,
        "pass",
        "_size",
        F.greatest(covers["block"] * BLOCK - F.col("_start"), F.lit(0)).alias("_from"),
        F.least((covers["block"] + 1) * BLOCK - F.col("_start"), F.col("_words")).alias("_to"),
    )
    parts = parts.withColumn("copy", F.explode(F.sequence(F.expr("_from div _size"), F.expr("(_to - 1) div _size"))))
    first = F.col("copy") * F.col("_size")
    parts = parts.select(*KEYS, "copy", "pass", F.greatest(F.col("_from") - first, F.lit(0)).alias("from_word"), F.least(F.col("_to") - first, F.col("_size")).alias("to_word"))
    return rows, parts


def taken_words(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``docs``."""
    rows, parts = mix(docs.select("doc_id", "text", "source"), ["doc_id"], seed)
    taken = parts.groupBy(*KEYS, "copy").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    each = _counted(rows, "copy", F.lit(0).cast("long"), F.col("_copies") - 1)
    joined = each.join(taken, [*KEYS, "copy"], "left")
    return joined.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix as rows with the columns of ``docs``: one for each row, copy and pass that has
    words in it, its text cut to those words (runs parted by a newline where words
    between them were not taken)."""
    import re

    word = re.compile(r"[^\x20\x09-\x0D]+")
    rest = [c for c in docs.columns if c != "text"]
    _, parts = mix(docs, [], seed)
    runs = parts.groupBy(*KEYS, "copy", "pass").agg(F.array_sort(F.collect_list(F.struct("from_word", "to_word"))).alias("runs"))
    band = F.expr(f"copy div {BAND}").alias("band")
    runs = staged(runs.groupBy(*KEYS, band).agg(F.collect_list(F.struct("copy", "pass", "runs")).alias("passes")), "mix-runs")
    numbered = whole_rows(docs)
    full = numbered.join(runs, KEYS).dropDuplicates([*KEYS, "band"]).select(text_of("row.text").alias("text"), "passes", F.struct(*[F.col(f"row.`{c}`").alias(c) for c in rest]).alias("rest"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, texts = [], []
            for i, (text, passes) in enumerate(zip(batch.column("text").to_pylist(), batch.column("passes").to_pylist())):
                spans = [m.span() for m in word.finditer(text or "")]
                for one in passes:
                    merged: list[list[int]] = []
                    for r in one["runs"]:
                        if merged and merged[-1][1] >= r["from_word"]:
                            merged[-1][1] = max(merged[-1][1], r["to_word"])
                        else:
                            merged.append([r["from_word"], r["to_word"]])
                    at.append(i)
                    texts.append("\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in merged))
            kept = batch.column("rest").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), kept], ["text", "rest"])

    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("text", T.StringType()), full.schema["rest"]])
    return full.mapInArrow(cut, schema).select(*[F.col("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])
