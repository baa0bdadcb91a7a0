"""A stored positional index of texts, kept as Parquet tables, and searches that read it.

Documents are packed into blocks of up to ``BLOCK``; a row of the index is one term in
one block: the documents' ids, weighted counts, lengths and positions (which the files code by their
differences), with the greatest count and the least length, which bound every score of the block for any
corpus figures.  Rows are range-partitioned by term, a folder a range, so a batch of
queries opens the folders of its own terms only.  Rows of the empty term hold all
documents' figures.

Every upsert or deletion adds a generation; a generation counts once its mark is written,
so that one which failed midway can be written again under its number.  Postings of a
document in older generations are void once a later one replaces or deletes it;
:func:`compact` writes the live ones anew.

``search`` scores the few blocks of a query with the greatest bounds first.  Their k-th
score is a floor, and blocks whose bounds stay below it are never scored: results are
those of a scan of all texts, ties included.  The files are read once, for the rows of the
asked terms less void documents; a block's documents then meet many queries in one product,
and a task hands on the best ``k`` rows of a query.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions import text as X
from larkspur.operators.lexical import BROADCAST_TERMS, FIELD_WEIGHTS, K1, B, top
from larkspur.sources.staged import UNKNOWN, fresh, spread, staged

#: Documents of a block, and tokens after which a block of fewer is closed.
BLOCK, TOKENS = 256, 1 << 21
#: Documents whose tokens a task cuts at a time, and what stands between two tokens there.
STEP, BETWEEN = 1024, "\0"
#: Positions of a field start at its number times this.
FIELD = 1 << 40
#: Bytes of input a range of terms, and ranges of a generation at least and at most.
RANGE_BYTES, LEAST, MOST = 32 << 20, 8, 20_000
POSTING = "tfs array<double>, dls array<long>, places array<array<long>>, n int, max_tf double, min_dl long"
#: Blocks of a query that are scored before the others are bounded.
SEEDS = 4
#: Queries that a block's documents meet at a time; rows that a task holds before it keeps the best.
GROUP, KEPT = 1024, 1 << 17
#: Terms of a block that are multiplied at a time.
ROWS = 2048


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def generations(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished generations, in order."""
    folder, fs = _files(spark, f"{path}/done")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(folder)) if fs.exists(folder) else []


def _finish(spark: SparkSession, path: str, generation: int) -> None:
    mark, fs = _files(spark, f"{path}/done/{generation}")
    fs.create(mark, True).close()


def _tokens(joined: pa.Array) -> pa.ListArray:
    """The tokens that stand ``BETWEEN`` apart; none of an empty string."""
    lists = pc.split_pattern(joined, BETWEEN)
    sizes, some = np.asarray(lists.value_lengths()), np.asarray(pc.binary_length(joined)) > 0
    flat = lists.flatten().filter(pa.array(np.repeat(some, sizes)))
    return pa.ListArray.from_arrays(pa.array(np.cumsum(np.r_[0, np.where(some, sizes, 0)]).astype(np.int32)), flat)


def _block_rows(ids: pa.Array, fields: list[pa.ListArray], weight: list[float], block: int) -> list[pa.Array]:
    """Columns of the index for one block: documents ``ids``, whose tokens ``fields`` hold.

    Tokens are sorted by term, document, field and place; runs of these are the postings."""
    sizes = [np.asarray(f.value_lengths()).astype(np.int64) for f in fields]
    lengths = np.sum(sizes, axis=0)
    encoded = pa.concat_arrays([f.flatten() for f in fields]).dictionary_encode()
    count = len(ids)
    doc = np.concatenate([np.repeat(np.arange(count), n) for n in sizes])
    place = np.concatenate([np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + number * FIELD for number, n in enumerate(sizes)])
    worth = np.repeat(np.array(weight, dtype=float), [n.sum() for n in sizes])
    key = np.asarray(encoded.indices).astype(np.int64) * count + doc
    order = np.argsort(key, kind="stable")
    key = key[order]
    posting = np.flatnonzero(np.diff(key, prepend=-1))  # first token of every posting
    code, doc = np.divmod(key[posting], count)
    row = np.flatnonzero(np.diff(code, prepend=-1))  # first posting of every term
    tf = np.add.reduceat(worth[order], posting) if len(posting) else np.zeros(0)
    # the row of the empty term comes last: all documents, without places
    doc, most = np.r_[doc, np.arange(count)], np.r_[np.maximum.reduceat(tf, row) if len(row) else tf, 0.0]
    starts, tf = np.r_[row, len(tf), len(doc)].astype(np.int32), np.r_[tf, np.zeros(count)]
    spots = np.r_[posting, np.full(count + 1, len(key))].astype(np.int32)
    dl = lengths[doc]
    terms = pa.concat_arrays([encoded.dictionary.take(pa.array(code[row])), pa.array([""])])
    places = pa.ListArray.from_arrays(pa.array(spots), pa.array(place[order]))
    lists = [pa.ListArray.from_arrays(pa.array(starts), x) for x in (ids.take(pa.array(doc)), pa.array(tf), pa.array(dl), places)]
    return [terms, pa.array(np.full(len(terms), block)), *lists, pa.array(np.diff(starts)), pa.array(most), pa.array(np.minimum.reduceat(dl, starts[:-1]))]


def _postings(docs: DataFrame, weights: dict[str, float], key: str, analyse) -> DataFrame:
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(kind)), *T.StructType.fromDDL(POSTING).fields])
    weight = list(weights.values())
    names = [f"_{n}" for n in range(len(weight))]

    def cut(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[pa.ListArray], np.ndarray]]:
        """Keys, tokens and lengths of a few documents at a time."""
        for at in range(0, batch.num_rows, STEP):
            part = batch.slice(at, STEP)
            fields = [_tokens(part.column(c)) for c in names]
            yield part.column(key), fields, np.sum([np.asarray(f.value_lengths()) for f in fields], axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        held: list[tuple[pa.Array, list[pa.ListArray]]] = []
        docs_, tokens = 0, 0

        def rows():
            ids, fields = pa.concat_arrays([h[0] for h in held]), [pa.concat_arrays(f) for f in zip(*(h[1] for h in held))]
            whole = pa.RecordBatch.from_arrays(_block_rows(ids, fields, weight, block), names=schema.names)
            for at in range(0, whole.num_rows, 20_000):
                yield whole.slice(at, 20_000)

        for ids, fields, sizes in (part for batch in batches for part in cut(batch)):
            first = 0
            for at, size in enumerate(sizes.tolist(), 1):
                docs_, tokens = docs_ + 1, tokens + size
                if docs_ == BLOCK or tokens > TOKENS:
                    held.append((ids[first:at], [f[first:at] for f in fields]))
                    yield from rows()
                    held, docs_, tokens, block, first = [], 0, 0, block + 1, at
            if first < len(ids):
                held.append((ids[first:], [f[first:] for f in fields]))
        if held:
            yield from rows()

    # one string a field, as lists of strings cost several times as much on the way
    return docs.select(key, *(F.array_join(analyse(F.col(f)), BETWEEN).alias(c) for f, c in zip(weights, names))).mapInArrow(run, schema)


def upsert(docs: DataFrame, path: str, generation: int | None = None, weights: dict[str, float] | None = None, key: str = "doc_id", analyse=X.tokens, ranges: int | None = None) -> int:
    """Write ``docs`` as a generation (the next one, or again one of that number) in so
    many ``ranges`` of terms (by the size of ``docs`` where Spark knows it); they replace
    stored documents with their ids.  An id stands once in ``docs``.  Returns the
    generation's number."""
    spark = docs.sparkSession
    known = generations(spark, path)
    number = (max(known, default=-1) + 1) if generation is None else generation
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    ranges = ranges or (LEAST if size >= UNKNOWN else min(MOST, max(LEAST, size // RANGE_BYTES)))
    # stored files are dealt out, as one task reads a row group; staged, as dealing by ranges makes its rows twice
    rows = staged(_postings(docs if size >= UNKNOWN else spread(docs), weights or FIELD_WEIGHTS, key, analyse), "index-blocks")
    _written(rows.repartitionByRange(ranges, "term", "block"), path, number)
    dead = docs.select(key) if [g for g in known if g < number] else docs.select(key).limit(0)
    dead.withColumn("before", F.lit(number)).write.mode("overwrite").parquet(f"{path}/dead/generation={number}")
    _finish(spark, path, number)
    return number


def _written(ranged: DataFrame, path: str, number: int) -> None:
    folder = f"{path}/postings/generation={number}"
    # version 2 codes sorted strings by shared beginnings and, without dictionaries, numbers by differences
    plain = {f"parquet.enable.dictionary#{c}": "false" for c in ("places.list.element.list.element", "ids.list.element", "term")}
    ranged = ranged.sortWithinPartitions("term", "block").withColumn("range", F.spark_partition_id())
    # a task writes one folder; with room for two open files the writer need not sort by folder before
    conf, spark = "spark.sql.maxConcurrentOutputFileWriters", ranged.sparkSession
    before = spark.conf.get(conf)
    spark.conf.set(conf, 2)
    try:
        ranged.write.mode("overwrite").options(**plain, **{"parquet.writer.version": "PARQUET_2_0"}).partitionBy("range").parquet(folder)
    finally:
        spark.conf.set(conf, before)
    stored = ranged.sparkSession.read.schema(ranged.schema).parquet(folder)
    bounds = stored.groupBy("range").agg(F.min("term").alias("low"), F.max("term").alias("high"), F.max(F.lit(number)).alias("generation"))
    bounds.coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges/generation={number}")


def delete(ids: DataFrame, path: str, key: str = "doc_id") -> int:
    """Void the stored documents with the ids of ``ids(doc_id)``."""
    number = max(generations(ids.sparkSession, path), default=-1) + 1
    ids.select(key).withColumn("before", F.lit(number)).write.mode("overwrite").parquet(f"{path}/dead/generation={number}")
    _finish(ids.sparkSession, path, number)
    return number


def compact(spark: SparkSession, path: str, to: str, key: str = "doc_id") -> None:
    """Write the live postings of the index at ``path`` as one generation at ``to``; no
    text is read.  Blocks keep their documents, less the void ones."""
    rows = postings(spark, path, key)
    again = ["block", "generation", "term"]
    one = rows.groupBy(*again).agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("id"), "tf", "dl", "places"))).alias("d"))
    known = generations(spark, path)
    numbers = one.withColumn("block", F.col("block") * (known[-1] + 1) + F.col("generation"))
    column = lambda name: F.transform("d", lambda x: x[name])
    made = numbers.select("term", "block", column("id").alias("ids"), column("tf").alias("tfs"), column("dl").alias("dls"), column("places").alias("places"), F.size("d").alias("n"), F.array_max(column("tf")).alias("max_tf"), F.array_min(column("dl")).alias("min_dl"))
    ranges = max((spark.read.parquet(f"{path}/ranges").groupBy("generation").count().agg(F.max("count")).first()[0] or LEAST), LEAST)
    _written(made.repartitionByRange(ranges, "term", "block"), to, 0)
    rows.select(key).limit(0).withColumn("before", F.lit(0)).write.mode("overwrite").parquet(f"{to}/dead/generation=0")
    _finish(spark, to, 0)


def _folders(spark: SparkSession, path: str, ranges: list[tuple[int, int]] | None) -> list[str]:
    """Folders of all finished generations, or of (generation, range) pairs."""
    if ranges is not None:
        return [f"{path}/postings/generation={g}/range={r}" for g, r in ranges]
    found = [f"{path}/postings/generation={g}" for g in generations(spark, path)]
    return [f for f in found if (x := _files(spark, f))[1].exists(x[0])]


def _bounds(spark: SparkSession, path: str) -> dict[int, list[tuple[str, str, int]]]:
    """Sorted (low, high, range) of every generation: as many rows as there are folders."""
    out: dict[int, list[tuple[str, str, int]]] = {}
    for g in generations(spark, path):
        folder, fs = _files(spark, f"{path}/ranges/generation={g}")
        if fs.exists(folder):
            out[g] = sorted((r.low, r.high, r.range) for r in spark.read.parquet(f"{path}/ranges/generation={g}").collect())
    return out


def _ranges_of(asked: DataFrame, bounds: dict[int, list[tuple[str, str, int]]], prefixes: bool = False) -> list[tuple[int, int]]:
    """(generation, range) pairs that may hold the terms, or terms that begin with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[int, int]] = set()
        for batch in batches:
            for term in batch.column("term").to_pylist():
                for g, rows in bounds.items():
                    first = bisect_left(rows, term, key=lambda r: r[1])
                    last = bisect_right(rows, term + "\U0010ffff" if prefixes else term, key=lambda r: r[0])
                    found.update((g, r[2]) for r in rows[first:last])
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32())], ["g", "r"])

    return sorted(map(tuple, asked.select("term").mapInArrow(run, "g int, r int").distinct().collect()))


def _read(spark: SparkSession, path: str, ranges: list[tuple[int, int]] | None, key: str = "doc_id") -> DataFrame:
    """Rows of the index in the named folders, with their ``generation``."""
    kind = spark.read.parquet(f"{path}/dead/generation={generations(spark, path)[0]}").schema[key].dataType
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(kind)), *T.StructType.fromDDL(f"{POSTING}, generation int, range int").fields])
    if not (folders := _folders(spark, path, ranges)):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/postings").parquet(*folders)


def _dead(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """(key, before) of voided postings, or None where there are none."""
    parts = [f"{path}/dead/generation={g}" for g in generations(spark, path)]
    rows = spark.read.parquet(*parts).groupBy(key).agg(F.max("before").alias("before"))
    return rows if rows.limit(1).count() else None


def _live(rows: DataFrame, dead: DataFrame | None, key: str, *more: str) -> DataFrame:
    """Postings of block rows, one a document, without the void ones; ``more``: places."""
    kept = ["term", "generation", "block"]
    each = rows.select(*kept, F.inline(F.arrays_zip("ids", "tfs", "dls", *more))).select(*kept, F.col("ids").alias(key), F.col("tfs").alias("tf"), F.col("dls").alias("dl"), *more)
    if dead is None:
        return each
    void = dead.select(F.col(key).alias("_void"), "before")
    return each.join(void, F.col(key).eqNullSafe(F.col("_void")) & (F.col("generation") < F.col("before")), "left_anti")


def _small(terms: DataFrame) -> DataFrame:
    return F.broadcast(terms) if terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else terms


def _figures(spark: SparkSession, path: str, bounds, dead: DataFrame | None, key: str) -> DataFrame:
    """One row (total, avgdl) of the live documents."""
    first = [(g, r[2]) for g, rows in bounds.items() for r in rows if r[0] == ""]
    rows = _read(spark, path, first, key).where("term = ''")
    return _live(rows, dead, key).agg(F.count("*").alias("total"), F.avg("dl").alias("avgdl"))


def opened(spark: SparkSession, path: str, terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of the index for ``terms(term)``, from the folders of their ranges alone."""
    rows = _read(spark, path, _ranges_of(terms, _bounds(spark, path)), key)
    return rows.join(_small(terms.select("term").distinct()), "term", "left_semi")


def postings(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(term, generation, block, key, tf, dl, places): all live postings."""
    return _live(_read(spark, path, None, key), _dead(spark, path, key), key, "places")


def _voided(spark: SparkSession, path: str, bounds, dead: DataFrame, key: str) -> DataFrame:
    """(generation, block, void): the void documents of the blocks that hold any."""
    first = [(g, r[2]) for g, rows in bounds.items() for r in rows if r[0] == ""]
    each = _read(spark, path, first, key).where("term = ''").select("generation", "block", F.explode("ids").alias("_id"))
    met = each.join(dead, F.col("_id").eqNullSafe(F.col(key)) & (F.col("generation") < F.col("before")))
    return met.groupBy("generation", "block").agg(F.collect_list(F.struct("_id")).alias("void"))


def _living(rows: DataFrame, voided: DataFrame) -> DataFrame:
    """Block rows less their void documents, rows of none left out; bounds stay as they are."""
    met = rows.join(_small(voided), ["generation", "block"], "left").sortWithinPartitions("generation", "block")
    names, lists = rows.columns, ["ids", "tfs", "dls"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns))
            offsets = np.r_[0, np.cumsum(np.asarray(columns["ids"].value_lengths()))]
            ids, void = columns["ids"].flatten(), columns["void"]
            kept = np.ones(len(ids), bool)
            for low, high in _runs(columns, "generation", "block"):
                if void[low].is_valid:
                    part = slice(offsets[low], offsets[high])
                    kept[part] = ~np.asarray(pc.is_in(ids[part], value_set=void[low].values.field(0)))
            left = np.r_[0, np.cumsum(kept)][offsets].astype(np.int32)
            for c in lists:
                columns[c] = pa.ListArray.from_arrays(pa.array(left), columns[c].flatten().filter(pa.array(kept)))
            columns["n"] = pa.array(np.diff(left))
            yield pa.RecordBatch.from_pydict({c: columns[c] for c in names}).filter(pa.array(np.diff(left) > 0))

    return met.mapInArrow(run, rows.schema)


def _runs(columns, *by: str) -> list[tuple[int, int]]:
    """First rows, and the ones after the last, of runs of equal columns ``by``."""
    size = len(columns[by[0]])
    changed = np.zeros(max(size - 1, 0), bool)
    for c in by:
        changed |= np.diff(np.asarray(columns[c])) != 0
    cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), size]
    return list(zip(cuts, cuts[1:])) if size else []


def _best(parts: list[tuple], k: int) -> tuple:
    """The best ``k`` of every query of parts(queries, keys, scores); ties by key."""
    table = pa.table([pa.chunked_array(list(c)) for c in zip(*parts)], names=["c", "key", "score"])
    table = table.take(pc.sort_indices(table, [("c", "ascending"), ("score", "descending"), ("key", "ascending")], null_placement="at_start"))
    c = np.asarray(table["c"])
    table = table.filter(pa.array(np.arange(len(c)) - np.searchsorted(c, c) < k)).combine_chunks()
    return tuple(x.chunk(0) if x.num_chunks else pa.array([], x.type) for x in table.columns)


def _scores(rows: DataFrame, asked: DataFrame, blocks: DataFrame, counts: DataFrame | None, k: int, key: str) -> DataFrame:
    """(query_id, key, score): the best ``k`` a query and task of the documents of
    blocks(query_id, generation, block), by the block rows of asked(query_id, term, idf,
    avgdl, bar); ``counts(query_id, asked)`` asks for so many terms in a document.

    A block meets ``GROUP`` queries at a time: what its documents score is a table of
    documents and queries, of which a task keeps ``k`` rows a query.
    """
    queries = blocks.select("query_id").distinct()
    groups = max(1, -(-queries.count() // GROUP))
    numbered = queries.withColumn("g", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))
    numbered = staged(numbered.withColumn("c", F.row_number().over(Window.partitionBy("g").orderBy("query_id")) - 1), "numbered-queries")
    to = _small(numbered)
    where = ["g", "generation", "block"]
    collected = lambda name: F.transform(F.array_sort(F.collect_list(F.struct("c", "w"))), lambda x: x[name]).alias(f"{name}s")
    heads = blocks.join(to, "query_id")
    heads = heads.withColumn("w", F.lit(0.0)) if counts is None else heads.join(counts.select("query_id", F.col("asked").cast("double").alias("w")), "query_id")
    heads = heads.groupBy(*where).agg(collected("c"), collected("w"))
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("ids", "tfs", "dls")]
    heads = heads.select(*where, F.lit(0).alias("kind"), "cs", "ws", F.lit(None).cast("double").alias("avgdl"), *none)
    terms = asked.join(to, "query_id").withColumn("w", F.coalesce("idf", F.lit(0.0))).groupBy("g", "term", F.when(F.col("bar"), 2).otherwise(1).alias("kind")).agg(collected("c"), collected("w"), F.max("avgdl").alias("avgdl"))
    met = rows.join(_small(terms), "term").join(_small(blocks.join(to, "query_id").select(*where).distinct()), where, "left_semi")
    met = met.select(*where, "kind", "cs", "ws", "avgdl", "ids", "tfs", "dls")
    kind = rows.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("g", T.IntegerType()), T.StructField("c", T.IntegerType()), T.StructField(key, kind), T.StructField("score", T.DoubleType())])
    every = counts is not None

    def block(pieces: list[pa.RecordBatch]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """(scores of documents and queries, below 0 where there is none; keys; queries)."""
        columns = {c: x.combine_chunks() for c, x in zip(pieces[0].schema.names, pa.Table.from_batches(pieces).columns)}
        columns = {c: x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for c, x in columns.items()}
        kinds, avgdl = np.asarray(columns["kind"]), np.nan_to_num(np.asarray(columns["avgdl"], dtype=float), nan=1.0)  # none where barred
        cs, ws = np.asarray(columns["cs"].flatten()), np.asarray(columns["ws"].flatten())
        at = np.r_[0, np.cumsum(np.asarray(columns["cs"].value_lengths()))]
        coded = columns["ids"].flatten().dictionary_encode(null_encoding="encode")
        tfs, dls, place = np.asarray(columns["tfs"].flatten()), np.asarray(columns["dls"].flatten()), np.asarray(coded.indices)
        spots = np.r_[0, np.cumsum(np.asarray(columns["ids"].value_lengths().fill_null(0)))]
        wanted = cs[at[0] : at[1]]
        column = np.full(max(int(cs.max()), 0) + 1, -1)
        column[wanted] = np.arange(len(wanted))
        raw, held, shut = (np.zeros((len(coded.dictionary), len(wanted)), kind) for kind in (float, np.float32, np.float32))
        for low in range(1, len(kinds), ROWS):  # documents by terms, times terms by queries
            high = min(low + ROWS, len(kinds))
            here, there = slice(spots[low], spots[high]), slice(at[low], at[high])
            row, term = np.repeat(np.arange(high - low), np.diff(spots[low : high + 1])), np.repeat(np.arange(high - low), np.diff(at[low : high + 1]))
            c, w = column[cs[there]], ws[there]
            term, c, w = term[c >= 0], c[c >= 0], w[c >= 0]
            tf = np.zeros((len(raw), high - low))
            tf[place[here], row] = tfs[here] * (K1 + 1) / (tfs[here] + K1 * (1 - B + B * dls[here] / avgdl[low:high][row]))
            idf = np.zeros((high - low, len(wanted)))
            idf[term, c] = w
            raw += tf @ idf
            for kind, into in ((1, held), (2, shut)):
                if (kinds[low:high] == kind).any():
                    holds, asks = np.zeros(tf.shape, np.float32), np.zeros(idf.shape, np.float32)
                    holds[place[here], row], asks[term, c] = 1, kinds[low:high][term] == kind
                    into += holds @ asks
        score = np.floor(raw / (1 + raw) * 1e6 + 0.5) / 1e6
        least = ws[at[0] : at[1]] if every else 1
        return np.where((held >= least) & (held > 0) & (shut == 0), score, -1.0), coded.dictionary, wanted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pieces, best, size, floor = None, [], [], 0, {}

        def out():
            if best and now is not None:
                c, keys, score = _best(best, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), now[0]), pa.int32()), c, keys, score], ["g", "c", key, "score"])

        def ended():
            nonlocal best, size
            scores, keys, wanted = block(pieces)
            edge = np.array([floor.get(c, 0.0) for c in wanted.tolist()])
            if len(keys) > k:
                edge = np.maximum(edge, -np.partition(-scores, k - 1, axis=0)[k - 1])
            doc, col = np.nonzero((scores >= edge) & (scores >= 0))
            if len(doc):
                best.append((pa.array(wanted[col], pa.int32()), keys.take(pa.array(doc)), pa.array(scores[doc, col])))
                size += len(doc)
            if size > KEPT:
                best = [_best(best, k)]
                size = 0
                c, score = np.asarray(best[0][0]), np.asarray(best[0][2])
                last = np.flatnonzero(np.diff(c, append=-1))
                floor.update((int(c[i]), float(score[i])) for i in last if i >= k - 1 and c[i - k + 1] == c[i])

        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns))
            for low, high in _runs(columns, *where):
                key_ = tuple(columns[c][low].as_py() for c in where)
                if key_ != now:
                    if pieces:
                        ended()
                    if now is not None and key_[0] != now[0]:
                        yield from out()
                        best, size, floor = [], 0, {}
                    now, pieces = key_, []
                pieces.append(batch.slice(low, high - low))
        if pieces:
            ended()
        yield from out()

    streams = heads.unionByName(met).repartition(*where).sortWithinPartitions(*where, "kind")
    return streams.mapInArrow(run, schema).join(to, ["g", "c"]).select("query_id", key, "score")


def search(spark: SparkSession, path: str, terms: DataFrame, k: int, key: str = "doc_id", match_all: bool = False, barred: DataFrame | None = None, read: list | None = None) -> DataFrame:
    """(query_id, key, score, rank): the best ``k`` documents of ``terms(query_id, term)``.

    As ``lexical.bm25`` of the live documents.  ``barred(query_id, term)`` takes out
    documents; ``read`` is given (blocks bounded, blocks scored).
    """
    terms = staged(terms.select("query_id", "term").distinct(), "asked-terms")
    bounds, dead = _bounds(spark, path), _dead(spark, path, key)
    every = terms if barred is None else staged(terms.unionByName(barred.select("query_id", "term")).select("term").distinct(), "terms-met")
    rows = _read(spark, path, _ranges_of(every, bounds), key).join(_small(every.select("term").distinct()), "term", "left_semi")
    rows = rows.select("term", "generation", "block", "ids", "tfs", "dls", "n", "max_tf", "min_dl")
    # staged, as the files' ranges hold many terms that are not asked for; what follows reads the rows again and again
    rows = staged(rows if dead is None else _living(rows, _voided(spark, path, bounds, dead, key)), "term-rows")
    counted = rows.groupBy("term").agg(F.sum("n").alias("n"))
    corpus = _figures(spark, path, bounds, dead, key)
    idf = F.log((F.col("total") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    weighed = counted.join(F.broadcast(corpus)).select("term", F.when(idf > 0, idf).otherwise(1e-6).alias("idf"), "avgdl")
    asked = staged(terms.join(weighed, "term").withColumn("bar", F.lit(False)), "weighed-terms")

    def part(tf, dl):
        return F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avgdl")))

    scaled = lambda raw: F.round(raw / (1 + raw), 6)
    heads = rows.select("term", "generation", "block", "max_tf", "min_dl").join(_small(asked), "term")
    bound = heads.groupBy("query_id", "generation", "block").agg(F.sum(part(F.col("max_tf"), F.col("min_dl"))).alias("raw"), F.count("*").alias("held"))
    counts = terms.groupBy("query_id").agg(F.count("*").alias("asked")) if match_all else None
    if match_all:
        bound = bound.join(counts, "query_id").where("held = asked").drop("asked")
    bound = staged(bound.select("query_id", "generation", "block", scaled(F.col("raw") * (1 + 1e-9)).alias("most")), "bounds")
    met = asked
    if barred is not None:
        none = [F.lit(None).cast("double").alias(c) for c in ("idf", "avgdl")]
        met = asked.unionByName(barred.select("query_id", "term", *none, F.lit(True).alias("bar")).distinct())
    scored = lambda blocks: _scores(rows, met, blocks, counts, k, key)

    order = Window.partitionBy("query_id").orderBy(F.desc("most"), "generation", "block")
    placed = staged(bound.withColumn("_place", F.row_number().over(order)), "placed-blocks")
    first = placed.where(F.col("_place") <= SEEDS).select("query_id", "generation", "block")
    seeds = staged(scored(first), "seed-scores")
    floor = top(seeds, k, key).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    rest = placed.where(F.col("_place") > SEEDS).join(floor, "query_id", "left").where("floor is null or most >= floor").drop("floor")
    rest = staged(rest.select("query_id", "generation", "block"), "blocks-left")
    if read is not None:
        read[:] = [bound.count(), rest.count() + first.count()]
    # staged, as the union of two such results would else be taken for partitioned by query
    return staged(top(seeds.unionByName(scored(rest)), k, key), "search-results")


def phrase_hits(spark: SparkSession, path: str, phrases: DataFrame, field: int, key: str = "doc_id") -> DataFrame:
    """(query_id, key, n): how often field number ``field`` of a live document holds the
    tokens of phrases(query_id, tokens) in a row.

    Only blocks that hold all of a phrase's terms are opened up; positions meet by
    intersecting, at each document, the starts that every token allows.
    """
    asked = phrases.where("size(tokens) > 0").select("query_id", F.size("tokens").alias("size"), F.posexplode("tokens").alias("offset", "term"))
    asked = staged(asked, "phrase-terms")
    rows = opened(spark, path, asked, key)
    terms = asked.groupBy("query_id", "term").agg(F.min("size").alias("size"), F.collect_list("offset").alias("offsets"))
    distinct = terms.groupBy("query_id").agg(F.count("*").alias("terms"))
    heads = rows.select("term", "generation", "block").join(_small(terms.select("query_id", "term")), "term")
    blocks = heads.groupBy("query_id", "generation", "block").agg(F.count("*").alias("met")).join(distinct, "query_id").where("met = terms")
    blocks = staged(blocks.select("query_id", "generation", "block", "terms"), "phrase-blocks")
    full = rows.join(_small(blocks.select("generation", "block").distinct()), ["generation", "block"], "left_semi")
    each = _live(full, _dead(spark, path, key), key, "places").join(terms, "term").join(blocks, ["query_id", "generation", "block"])
    low, high = field * FIELD, (field + 1) * FIELD
    placed = each.withColumn("places", F.filter("places", lambda p: (p >= low) & (p < high)))
    starts = placed.select("query_id", key, "terms", F.explode("offsets").alias("offset"), "size", "places").select("query_id", key, "size", F.transform("places", lambda p: p - F.col("offset")).alias("starts"))
    met = starts.groupBy("query_id", key).agg(F.collect_list("starts").alias("all"), F.min("size").alias("size")).where("size(all) = size")
    common = F.aggregate(F.slice("all", 2, F.size("all")), F.get("all", F.lit(0)), lambda s, x: F.array_intersect(s, x))
    return met.select("query_id", key, F.size(common).cast("long").alias("n")).where("n > 0")


def terms_from(spark: SparkSession, path: str, prefixes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(query_id, prefix, term): terms of live documents that begin with
    ``prefixes(query_id, prefix)``, from the folders of their ranges alone."""
    asked = staged(prefixes.where("prefix <> ''").select("query_id", "prefix").distinct(), "prefixes")
    bounds, dead = _bounds(spark, path), _dead(spark, path, key)
    rows = _read(spark, path, _ranges_of(asked.select(F.col("prefix").alias("term")), bounds, prefixes=True), key).where("term <> ''")
    vocabulary = (rows if dead is None else _live(rows, dead, key)).select("term").distinct()
    longest = asked.agg(F.max(F.length("prefix")).alias("longest"))
    begins = vocabulary.join(F.broadcast(longest)).select("term", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length("term"), "longest")))).alias("n"))
    return begins.select("term", F.expr("left(term, n)").alias("prefix")).join(asked, "prefix").select("query_id", "prefix", "term")


_WRITTEN: dict[tuple, str] = {}


def of_table(docs: DataFrame, weights: dict[str, float] | None = None, key: str = "doc_id") -> str:
    """Path of an index of ``docs`` in the shared folder, written once in an application
    for the same rows: the same plan over files of the same names, sizes and times."""
    spark, seen = docs.sparkSession, []
    for folder in sorted({f.rsplit("/", 1)[0] for f in docs.inputFiles()}):
        at, fs = _files(spark, folder)
        seen += [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(at)]
    name = (spark.sparkContext.applicationId, docs.semanticHash(), tuple((weights or FIELD_WEIGHTS).items()), tuple(seen))
    if name not in _WRITTEN:
        path = fresh(spark, "text-index")
        upsert(docs, path, weights=weights, key=key)
        _WRITTEN[name] = path
    return _WRITTEN[name]
