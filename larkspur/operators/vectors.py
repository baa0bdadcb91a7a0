"""Exact cosine search as a join of blocks of vectors.

Both sides are cut into blocks of neighbours: a vector goes to its nearest pivot (pivots
are a bounded sample of the stored vectors; they shape the layout, never the results) and
blocks are runs of one pivot in order of distance.  A block's pivot and its least and
greatest distance bound, by the triangle inequality, how near any two vectors of two
blocks can be.  Every block of queries meets a few blocks of its own pivot first; what its
worst query has then found excludes most of the others, and only pairs of blocks that are
left are multiplied.  Queries are dealt in groups, stored blocks stream past a group, and
each task hands on ``k`` rows a query, so neither side is held, broadcast or collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.sources.staged import staged

#: Vectors of a block; pivots; blocks of its own pivot that a block of queries meets first.
BLOCK, PIVOTS, SEEDS = 256, 256, 4
#: Queries of a group, which a task holds, and stored blocks that stream past it there.
GROUP, STREAM = 1 << 16, 1024
#: Stands for no id.
NONE = np.iinfo(np.int64).max
#: Rows of an Arrow batch where a row is a block.
BATCH = 64


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _pivots(vectors: DataFrame) -> np.ndarray:
    """At most one stored vector a block, ``PIVOTS`` at most, as unit rows."""
    n = vectors.limit(BLOCK * PIVOTS).count()
    some = vectors.orderBy(F.xxhash64("id"), "id").limit(max(1, -(-n // BLOCK))).collect()
    if not some:
        return np.zeros((0, 1))
    found = _unit(np.array([r.v for r in some], dtype=float).reshape(len(some), -1))
    return found[np.linalg.norm(found, axis=1) > 0.5]


def _blocks(rows: DataFrame, pivots: np.ndarray, label: str, size: int) -> DataFrame:
    """rows(id, v, scope) as staged blocks (block, pivot, low, high, n, ids, scopes, raw).

    Vectors without length have pivot -1, as no distance bounds their similarity.
    """
    names = ["id", "v", "scope"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = np.asarray(batch.column("v").flatten(), dtype=float).reshape(batch.num_rows, -1)
            unit = _unit(m)
            at, far = np.full(len(m), -1, np.int32), np.zeros(len(m))
            real = np.linalg.norm(unit, axis=1) > 0.5
            if len(pivots) and real.any():
                sims = unit[real] @ pivots.T
                at[real] = sims.argmax(axis=1)
                far[real] = np.linalg.norm(unit[real] - pivots[at[real]], axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(at), pa.array(far)], [*names, "pivot", "far"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    placed = rows.select(*names).mapInArrow(assign, f"id {kinds['id']}, v {kinds['v']}, scope {kinds['scope']}, pivot int, far double")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for batch in batches:
            at = np.asarray(batch.column("pivot"))
            starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else []
            for first, last in zip(starts, [*starts[1:], len(at)]):
                for low in range(first, last, size):
                    part = batch.slice(low, min(size, last - low))
                    part = part.take(pa.array(np.argsort(np.asarray(part.column("id")), kind="stable")))
                    far, m = np.asarray(part.column("far")), np.asarray(part.column("v").flatten(), dtype=float)
                    columns = [pa.array([number]), pa.array([int(at[first])], pa.int32()), pa.array([far.min()]), pa.array([far.max()]), pa.array([part.num_rows], pa.int32())]
                    lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(c)) for c in ("id", "scope")]
                    raw = _unit(m.reshape(part.num_rows, -1)).tobytes()
                    yield pa.RecordBatch.from_arrays([*columns, *lists, pa.array([raw], pa.binary())], ["block", "pivot", "low", "high", "n", "ids", "scopes", "raw"])
                    number += 1

    schema = f"block long, pivot int, low double, high double, n int, ids array<{kinds['id']}>, scopes array<{kinds['scope']}>, raw binary"
    return staged(placed.repartitionByRange("pivot", "far").sortWithinPartitions("pivot", "far").mapInArrow(cut, schema), label)


def _best(rows: np.ndarray, sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -sims, rows))
    rows, sims, ids = rows[order], sims[order], ids[order]
    first = np.searchsorted(rows, rows)
    some = np.arange(len(rows)) - first < k
    return rows[some], sims[some], ids[some]


def _products(pairs: DataFrame, asked: DataFrame, stored: DataFrame, k: int, scoped: bool, floor: float = -np.inf, earlier: bool = False, first: bool = False) -> DataFrame:
    """Staged (block, query_id, id, similarity): the best ``k`` a query and task over
    staged pairs(q, s) of blocks, of those at or over ``floor``.

    ``earlier``: only ids below the query's.  ``first``: the least id in place of the best.
    """
    total = asked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    groups = max(1, -(-total // GROUP))
    group = F.pmod(F.xxhash64("q"), F.lit(groups)).cast("int")
    listed = staged(pairs.groupBy("s", group.alias("g")).agg(F.collect_list("q").alias("qs")), "block-pairs")
    salts = max(1, -(-listed.count() // (groups * STREAM)))
    salt = F.pmod(F.xxhash64("s"), F.lit(salts)).cast("int")
    met = stored.select(F.col("block").alias("s"), "ids", "scopes", "raw").join(listed, "s").select("g", salt.alias("t"), F.lit(1).alias("kind"), "s", "qs", "ids", "scopes", "raw")
    held = asked.select(F.col("block").alias("q"), "ids", "scopes", "raw").join(pairs.select("q").distinct(), "q", "left_semi")
    held = held.select(group.alias("g"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("t"), F.lit(0).alias("kind"), F.col("q").alias("s"), F.array().cast("array<bigint>").alias("qs"), "ids", "scopes", "raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, queries = None, {}

        def out():
            for block, (ids, _, _, found, least) in queries.items():
                rows, sims, near = found
                if first:
                    rows = np.flatnonzero(least < NONE)
                    sims, near = np.ones(len(rows)), least[rows]
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), block)), pa.array(ids[rows]), pa.array(near), pa.array(sims)], ["block", "query_id", "id", "similarity"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("g", "t", "kind", "s", "qs", "raw")]
            ids_, scopes_ = batch.column("ids"), batch.column("scopes")
            for i, (g, t, kind, s, qs, raw) in enumerate(zip(*columns)):
                if (g, t) != now:
                    yield from out()
                    now, queries = (g, t), {}
                ids = np.asarray(ids_[i].values)
                m = np.frombuffer(raw).reshape(len(ids), -1)
                scopes = np.array(scopes_[i].as_py(), object) if scoped else None
                if kind == 0:
                    queries[s] = [ids, m, scopes, (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)), np.full(len(ids), NONE) if first else np.full(len(ids), -np.inf)]
                    continue
                for q in qs:
                    state = queries[q]
                    sims = np.round(state[1] @ m.T, 6)
                    if scoped:
                        sims = np.where(state[2][:, None] == scopes[None, :], sims, -np.inf)
                    if earlier:
                        sims = np.where(ids[None, :] < state[0][:, None], sims, -np.inf)
                    if first:  # ids of a block rise
                        row = np.flatnonzero((sims >= floor).any(axis=1))
                        near = ids[(sims[row] >= floor).argmax(axis=1)]
                        better = near < state[4][row]
                        state[4][row[better]] = near[better]
                        continue
                    n = min(k, sims.shape[1])
                    edge = np.maximum(-np.partition(-sims, n - 1, axis=1)[:, n - 1], state[4])
                    row, col = np.nonzero((sims >= np.maximum(edge, floor)[:, None]) & (sims > -np.inf))
                    rows, near, held_ids = state[3]
                    state[3] = _best(np.r_[rows, row], np.r_[near, sims[row, col]], np.r_[held_ids, ids[col]], k)
                    last = np.bincount(state[3][0], minlength=len(state[0]))
                    full = np.flatnonzero(last == k)
                    state[4][full] = state[3][1][np.cumsum(last)[full] - 1]
        yield from out()

    spark = pairs.sparkSession
    conf, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(conf, BATCH)  # a row is a block here
    try:
        every = met.unionByName(held).repartition("g", "t").sortWithinPartitions("g", "t", "kind")
        return staged(every.mapInArrow(run, "block long, query_id long, id long, similarity double"), "block-products")
    finally:
        spark.conf.set(conf, before)


def _routes(ahead: DataFrame, shead: DataFrame, pivots: np.ndarray, reach: DataFrame) -> DataFrame:
    """Pairs (q, s) of blocks with vectors that may be nearer than reach(q, reach)."""
    apart = np.linalg.norm(pivots[:, None, :] - pivots[None, :, :], axis=2)
    table = ahead.sparkSession.createDataFrame([(i, j, float(d)) for i, row in enumerate(apart) for j, d in enumerate(row)], "p int, pivot int, d double")
    routes = ahead.join(F.broadcast(table), "p").join(reach, "q")
    routes = routes.select("q", "pivot", (F.col("d") - F.col("a2") - F.col("reach")).alias("from"), (F.col("d") + F.col("a2") + F.col("reach")).alias("to"))
    meets = (routes["pivot"] == shead["pivot"]) & (F.col("b2") >= F.col("from")) & (F.col("b1") <= F.col("to"))
    loose = ahead.where("p < 0").select("q", F.explode(F.array(*[F.lit(i) for i in range(-1, len(pivots))])).alias("pivot"))
    loose = loose.unionByName(ahead.where("p >= 0").select("q", F.lit(-1).alias("pivot")))
    return routes.join(shead, meets).select("q", "s").unionByName(loose.join(shead, "pivot").select("q", "s"))


def _reach(similarity):
    """Greatest distance of unit vectors at or over a similarity rounded to six digits."""
    return F.sqrt(F.greatest(2 - 2 * (similarity - 1e-6), F.lit(0.0))) + 1e-7


def _heads(ablocks: DataFrame, sblocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    ahead = ablocks.select(F.col("block").alias("q"), F.col("pivot").alias("p"), F.col("low").alias("a1"), F.col("high").alias("a2"))
    return ahead, sblocks.select(F.col("block").alias("s"), "pivot", F.col("low").alias("b1"), F.col("high").alias("b2"))


def first_within(rows: DataFrame, floor: float) -> DataFrame:
    """(id, first): for rows(id, embedding) the least id of an earlier one at or over
    ``floor``; rows without any are left out.  One row a row, however many are near."""
    given = rows.where("embedding is not null").select("id", F.col("embedding").alias("v"), F.lit(0).alias("scope"))
    pivots = _pivots(given)
    blocks = _blocks(given, pivots, "row-blocks", BLOCK)
    ahead, shead = _heads(blocks, blocks.select(*blocks.columns))
    reach = ahead.select("q", _reach(F.lit(floor)).alias("reach"))
    pairs = staged(_routes(ahead, shead, pivots, reach), "block-pairs-left")
    found = _products(pairs, blocks, blocks, 1, False, floor, True, True)
    return found.groupBy(F.col("query_id").alias("id")).agg(F.min("id").alias("first"))


def nearest(queries: DataFrame, vectors: DataFrame, k: int, scoped: bool = False, pairs: list | None = None, floor: float | None = None, earlier: bool = False) -> DataFrame:
    """(query_id, id, similarity, rank) for queries(query_id, embedding[, scope]).

    Best by the similarity rounded to six digits, then id.  ``scoped``: only vectors(id,
    embedding, scope) of the query's own scope; ``floor``: only those at or over it;
    ``earlier``: only ids below the query's.  ``pairs`` is given (pairs of blocks that were
    multiplied, all pairs).
    """
    least = -np.inf if floor is None else floor
    scope = F.col("scope") if scoped else F.lit(0)
    asked = queries.where("embedding is not null").select(F.col("query_id").alias("id"), F.col("embedding").alias("v"), scope.alias("scope"))
    stored = vectors.where("embedding is not null").select("id", F.col("embedding").alias("v"), scope.alias("scope"))
    pivots = _pivots(stored)
    ablocks, sblocks = (_blocks(x, pivots, label, BLOCK) for x, label in ((asked, "query-blocks"), (stored, "vector-blocks")))
    ahead, shead = _heads(ablocks, sblocks)
    gap = F.greatest(F.col("b1") - F.col("a2"), F.col("a1") - F.col("b2"), F.lit(0.0))
    order = Window.partitionBy("q").orderBy(gap, F.col("b2") - F.col("b1"), "s")
    near = ahead.join(shead, F.col("p") == F.col("pivot")).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= SEEDS)
    first = staged(near.select("q", "s"), "seed-pairs")
    found = _products(first, ablocks, sblocks, k, scoped, least, earlier)
    best = _ranked(found.select("query_id", "id", "similarity", "block"), k)
    kth = best.where(F.col("rank") == k).groupBy("block").agg(F.min("similarity").alias("floor"), F.count("*").alias("full"))
    # how far a vector may be that still enters: with less than k found so far, any
    reach = ablocks.select(F.col("block").alias("q"), "n").join(kth.withColumnRenamed("block", "q"), "q", "left")
    far = F.lit(3.0) if floor is None else _reach(F.lit(floor))
    reach = reach.select("q", F.when(F.col("full") == F.col("n"), F.least(_reach(F.col("floor")), far)).otherwise(far).alias("reach"))
    rest = _routes(ahead, shead, pivots, reach)
    rest = staged(rest.join(first, ["q", "s"], "left_anti"), "block-pairs-left")
    if pairs is not None:
        pairs[:] = [first.count() + rest.count(), ablocks.count() * sblocks.count()]
    if rest.limit(1).count():
        found = found.unionByName(_products(rest, ablocks, sblocks, k, scoped, least, earlier))
    return staged(_ranked(found.select("query_id", "id", "similarity"), k), "nearest")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def accepted(matches: DataFrame, floor: float = 0.05, share: float = 0.5, keep: int = 5) -> DataFrame:
    """Matches at or over max(floor, share * best), and always the first ``keep``."""
    best = F.max("similarity").over(Window.partitionBy("query_id"))
    return matches.withColumn("_best", best).where((F.col("rank") <= keep) | (F.col("similarity") >= F.greatest(F.lit(floor), share * F.col("_best")))).drop("_best")


def merged(matches: DataFrame) -> DataFrame:
    """Highest similarity of an id over the sub-queries of a query."""
    return matches.groupBy("query_id", "id").agg(F.max("similarity").alias("similarity"))


def best_files(matches: DataFrame, least: float = 0.3, k: int = 10) -> DataFrame:
    """(query_id, doc_id, similarity, rank): matches(query_id, doc_id, similarity) of all
    sub-queries of a query, one per document, ``k`` at most of those at ``least`` or over."""
    best = matches.where(F.col("similarity") >= least).groupBy("query_id", "doc_id").agg(F.max("similarity").alias("similarity"))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "doc_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def scope_normalised(matches: DataFrame) -> DataFrame:
    """1 / (60 + rank in scope), where a query's matches are from several scopes."""
    n = F.size(F.collect_set("scope").over(Window.partitionBy("query_id")))
    rank = F.row_number().over(Window.partitionBy("query_id", "scope").orderBy(F.desc("similarity"), "id")) - 1
    return matches.withColumn("similarity", F.when(n > 1, F.round(1 / (60 + rank), 6)).otherwise(F.col("similarity")))


def duplicate_probe(queries: DataFrame, vectors: DataFrame, threshold: float = 0.9, stored: bool = False) -> DataFrame:
    """For every new vector the nearest stored one at or over ``threshold``, of five.

    ``stored``: the queries are among the vectors; only a query's own id is left out."""
    near = nearest(queries, vectors, 6 if stored else 5).where(F.col("similarity") >= threshold)
    near = near.where("id <> query_id") if stored else near
    first = Window.partitionBy("query_id").orderBy("rank")
    return near.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("query_id", "id", "similarity")


def nearest_documents(queries: DataFrame, chunks: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, similarity, seq, rank): the nearest chunks(id, doc_id, seq,
    embedding), three times ``k`` of them, folded into active documents(doc_id, active)
    by their best chunk."""
    near = nearest(queries, chunks, 3 * k).select("query_id", "id", "similarity")
    kept = documents.where("active").select("doc_id")
    rows = near.join(chunks.select("id", "doc_id", "seq"), "id").join(kept, "doc_id")
    best = rows.groupBy("query_id", "doc_id").agg(F.max(F.struct("similarity", (-F.col("seq")).alias("place"))).alias("b"))
    found = best.select("query_id", "doc_id", F.col("b.similarity").alias("similarity"), (-F.col("b.place")).alias("seq"))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_shared(queries: DataFrame, vectors: DataFrame, k: int, shared) -> DataFrame:
    """(query_id, id, similarity, rank): three times ``k`` vectors of the query's own scope
    and ``k`` of the scope ``shared`` that all may see."""
    own = nearest(queries.where(F.col("scope") != F.lit(shared)), vectors, 3 * k, scoped=True)
    common = nearest(queries.withColumn("scope", F.lit(shared).cast(vectors.schema["scope"].dataType)), vectors, k, scoped=True)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return own.unionByName(common).withColumn("rank", F.row_number().over(order))


def replaced(stored: DataFrame, new: DataFrame) -> DataFrame:
    """``stored(id, embedding)`` with the rows of ``new`` in place of those with their ids;
    stored vectors of another length than the new ones (another model's) go."""
    lengths = new.select(F.size("embedding").alias("_n")).distinct()
    kept = stored.join(new.select("id"), "id", "left_anti").withColumn("_n", F.size("embedding")).join(F.broadcast(lengths), "_n", "left_semi")
    return kept.drop("_n").unionByName(new.select(*stored.columns))
