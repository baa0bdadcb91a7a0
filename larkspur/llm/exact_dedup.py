"""Exact dedup over an extendible-hash index on shared files.

Keys are 64-bit hashes of the whole texts.  A directory over their leading bits
doubles as long as a bucket holds more bytes than its capacity and more than one key; a
bucket's local depth says how many leading bits it owns, so buckets are key ranges.  One owner task reads
each bucket in key order, chains the texts that share a key by comparing their bytes,
and writes the bucket's part of the index: every distinct text once, with the member
that stays, and the members of its group.

Copies within a task are folded before the shuffle, so a text that a third of all rows
hold reaches its owner once per map task, not once per row.

Defined cases: null text equals the empty text; the largest ``doc_id`` stays, null
being the smallest, and of rows that share it one stays; an empty table gives an empty
index.  All other columns, whatever their names, travel with their row.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.shared import shared_path, text_of

#: Bits of the first count of the directory.  Prefixes of buckets that are still overfull
#: are counted again, by as many bits more as the fullest of them asks for.
STEP = 14
#: Prefixes that a count brings to the driver at most (as a power of two).
ASKED = 18
#: A bucket's bytes: this many, or one part in ``BUCKETS`` of all where that is more.  An
#: owner streams its bucket, so this bounds the number of tasks and no task's memory.
CAPACITY, BUCKETS = 32 << 20, 1 << 16


def directory(weigh, capacity: int, step: int = STEP) -> list[tuple[int, int]]:
    """(first key prefix, local depth) of every bucket, in key order.

    ``weigh(prefixes, up, depth)`` gives {prefix of ``depth`` bits: (bytes, several keys)}
    below the overfull ``prefixes`` of ``up`` bits.  It starts as one bucket; an overfull
    one splits in two until it fits or holds one key.
    """
    out, open_, depth, bits = [], [0], 0, step
    while open_ and depth < 64:
        bits = min(bits, 64 - depth)
        held = weigh(open_, depth, depth + bits)
        todo, open_, depth = [(p, depth) for p in reversed(open_)], [], depth + bits
        prefixes = sorted(held)
        sums = [0, *accumulate(held[p][0] for p in prefixes)]
        while todo:
            prefix, local = todo.pop()
            low, high = (bisect_left(prefixes, p << (depth - local)) for p in (prefix, prefix + 1))
            full = sums[high] - sums[low] > capacity
            if full and local < depth:
                todo += [(2 * prefix + 1, local + 1), (2 * prefix, local + 1)]
            elif full and local < 64 and held[prefix][1]:
                open_.append(prefix)
            else:
                out.append((prefix, local))
        fullest = max((held[p][0] for p in open_), default=0)
        bits = max(1, min((fullest // capacity).bit_length() + 1, ASKED - len(open_).bit_length()))
    return sorted(out, key=lambda b: b[0] << (64 - b[1]))


def _fold(members: pa.DataType, starts: list[int], budget: int = 48 << 20):
    """Map-side: rows of one text become one entry with the list of their members, in
    the bucket whose range of keys, from its ``starts`` on, holds the text's key."""
    first = np.array(starts, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[int, list]] = {}
        size = rows = 0

        def entries():
            texts = list(held)
            for i in range(0, len(texts), 1000):
                part = texts[i : i + 1000]
                keys = np.array([held[t][0] for t in part], np.int64)
                bucket = (np.searchsorted(first, keys.view(np.uint64), "right") - 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(keys), pa.array(part, pa.string()), pa.array([held[t][1] for t in part], members)], ["bucket", "key", "text", "members"])

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                for key, text, member in zip(*(piece.column(c).to_pylist() for c in ("key", "text", "member"))):
                    if (entry := held.get(text)) is None:
                        held[text] = (key, [member])
                        size += len(text)
                    else:
                        entry[1].append(member)
                rows += piece.num_rows
                if size > budget or rows > 50_000:
                    yield from entries()
                    held.clear()
                    size = rows = 0
        yield from entries()

    return run


def _own(members: pa.DataType, member: pa.DataType, order: str):
    """Owner task: chain the entries of a key by their bytes; see ``build_index``."""
    names = ["key", "chain", "text", "best", "members", "n", "list_no"]
    types = [pa.int64(), pa.int32(), pa.string(), member, members, pa.int64(), pa.int64()]
    rank = lambda m: (m[order] is not None, m[order] or 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        number = TaskContext.get().partitionId() << 32 if TaskContext.get() else 0
        now, chain, out = None, [], []  # chain: [text, best member, size] of the current key
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                piece = batch.slice(at, 200)
                for key, text, group in zip(*(piece.column(c).to_pylist() for c in ("key", "text", "members"))):
                    if key != now:
                        out += [(now, i, c[0], c[1], None, c[2], None) for i, c in enumerate(chain)]
                        now, chain = key, []
                    where = next((i for i, c in enumerate(chain) if c[0] == text), len(chain))
                    best = max(group, key=rank)
                    if where == len(chain):
                        chain.append([text, best, 0])
                    elif rank(best) > rank(chain[where][1]):
                        chain[where][1] = best
                    chain[where][2] += len(group)
                    out.append((key, where, None, None, group, len(group), number))
                    number += 1
                if out:
                    yield table(out)
                    out = []
        out += [(now, i, c[0], c[1], None, c[2], None) for i, c in enumerate(chain)]
        if out:
            yield table(out)

    return run


def build_index(docs: DataFrame, path: str, order: str = "doc_id", capacity: int = CAPACITY) -> None:
    """Write the index of ``docs`` under ``path``.

    Rows of (key, chain, text, best, members, n, list_no): those with a text are the
    distinct texts, with the member that stays and the group's size; those without
    list members of the group (key, chain) and have a number of their own.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.xxhash64(text_of()).alias("key"), text_of().alias("text"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("member"))
    spark = docs.sparkSession

    def weigh(prefixes: list[int], up: int, depth: int) -> dict[int, tuple[int, bool]]:
        below = rows.groupBy("key").agg(F.max(F.octet_length("text") + 64).alias("size"))
        if up:  # at most one prefix per capacity of bytes
            some = spark.createDataFrame([(p,) for p in prefixes], "prefix long")
            below = below.withColumn("prefix", F.shiftrightunsigned("key", 64 - up)).join(F.broadcast(some), "prefix")
        counted = below.groupBy(F.shiftrightunsigned("key", 64 - depth).alias("at")).agg(F.sum("size").alias("size"), (F.count("*") > 1).alias("several"))
        found = counted.toArrow()
        at = np.asarray(found.column("at")).view(np.uint64).tolist()
        return dict(zip(at, zip(found.column("size").to_pylist(), found.column("several").to_pylist())))

    first = weigh([0], 0, STEP)
    total = sum(size for size, _ in first.values())
    buckets = directory(lambda prefixes, up, depth: weigh(prefixes, up, depth) if up else first, max(capacity, total // BUCKETS))
    starts = [prefix << (64 - local) for prefix, local in buckets]
    member_type = T.StructType([f for f in docs.schema.fields if f.name != "text"])
    one, many = to_arrow_type(member_type), to_arrow_type(T.ArrayType(member_type))
    entry = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("text", T.StringType()), T.StructField("members", T.ArrayType(member_type))])
    entries = rows.mapInArrow(_fold(many, starts), entry)
    owned = entries.repartitionById(len(starts), F.col("bucket")).sortWithinPartitions("key")
    out = T.StructType([T.StructField("key", T.LongType()), T.StructField("chain", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("best", member_type), T.StructField("members", T.ArrayType(member_type)), T.StructField("n", T.LongType()), T.StructField("list_no", T.LongType())])
    owned.select("key", "text", "members").mapInArrow(_own(many, one, order), out).write.parquet(path)


def groups(spark: SparkSession, path: str, order: str = "doc_id") -> DataFrame:
    """Per member: (member, keep_id, group_size, kept, text_sha256), from the index."""
    index = spark.read.parquet(path)
    heads = index.where("text is not null").select("key", "chain", F.col(f"best.{order}").alias("keep_id"), F.col("n").alias("group_size"), F.sha2("text", 256).alias("text_sha256"))
    listed = index.where("text is null").select("key", "chain", "members", "list_no")
    top = lambda x: F.coalesce(x[order], F.lit(-(1 << 63)))
    listed = listed.withColumn("first", F.struct(F.array_max(F.transform("members", top)).alias("top"), (-F.col("list_no")).alias("list_no")))
    winner = listed.groupBy("key", "chain").agg(F.max("first").alias("winner"))
    joined = listed.join(winner.join(heads, ["key", "chain"]), ["key", "chain"])
    rows = joined.select("keep_id", "group_size", "text_sha256", (F.col("first") == F.col("winner")).alias("holds"), "first", F.posexplode("members").alias("at", "member"), F.transform("members", top).alias("tops"))
    kept = F.col("holds") & (F.array_position("tops", F.col("first.top")) == F.col("at") + 1)
    return rows.select("member", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def keep_documents(docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """One row per distinct text, with the columns of ``docs``."""
    path = shared_path(docs.sparkSession, "exact-index")
    build_index(docs, path, order)
    heads = docs.sparkSession.read.parquet(path).where("text is not null")
    return heads.select(*[F.col("text") if c == "text" else F.col(f"best.`{c}`").alias(c) for c in docs.columns])
