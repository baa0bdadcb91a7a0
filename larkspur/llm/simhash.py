"""SimHash near-dedup with bit-sliced comparison.

A text's fingerprint has bit b set where over half of its shingles' XXH64 values do.
Distinct fingerprints within the radius are linked.  Candidates share two of five bit
fields (three differing bits leave two fields whole), so ten tables find every pair.
Inside a bucket, 64 fingerprints at a time lie as bit planes; a query's differing bits
are added to all 64 counts at once by carry-save counters, and a block is abandoned
as soon as all of its counts have passed the radius.

A bucket hands on a spanning forest of its links, never all pairs.  A bucket of more
than ``TILE`` members is dealt out by its planes: every share holds its own part of them
and streams all members past it, so no link is lost and no task holds a large bucket.  Components are found by alternating
large-star and small-star steps over tables in the shared folder.

Defined cases: null and word-free texts have fingerprint zero, linked like any other;
fewer words than a shingle make one shingle; repeated rows share a fingerprint; a null
``doc_id`` is in its component but never names it (null if no other member can); an
empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.shared import staged, text_of, whole_rows

SEED = 42
#: First bit and width of the five fields.
FIELDS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Members of a bucket whose planes one share holds.
TILE = 8192
#: Rows of one bucket that a task holds before it streams the rest of them.
STREAM = 4 * TILE
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str, shingle: int = 3) -> int:
    """The 64-bit fingerprint of one whole text."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        hashes = [xxh64_intdigest(b" ".join(words), SEED)]
    else:
        hashes = [xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*(words[i:] for i in range(shingle))))]
    values = np.array(hashes, dtype="<u8")
    total = np.zeros(64, np.int64)
    for at in range(0, len(values), 65536):
        part = values[at : at + 65536]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(values), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3, keep: list[str] | None = None) -> DataFrame:
    """(doc_id or ``keep``, fp): the fingerprint as a signed long."""
    keep = ["doc_id"] if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for at in range(0, batch.num_rows, 500):
                found += [fingerprint(t, shingle) for t in batch.column("_text").slice(at, 500).to_pylist()]
            fp = pa.array(np.array(found, dtype=np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), fp], [*keep, "fp"])

    schema = docs.select(*keep).schema
    return docs.select(*keep, text_of().alias("_text")).mapInArrow(run, schema.add("fp", "long"))


def sliced_links(fps: np.ndarray, bucket: np.ndarray, lane: np.ndarray, radius: int = 3, asks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (query, member) within ``radius`` of each other, in the same bucket.

    ``bucket`` is sorted; members with ``lane`` set are held as planes; all are queries,
    or those with ``asks`` set.
    """
    assert radius == 3, "the counters hold two bits"
    n = len(fps)
    lanes = np.flatnonzero(lane)
    if not n or not len(lanes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lane_bucket = bucket[lanes]
    first = np.flatnonzero(np.r_[True, lane_bucket[1:] != lane_bucket[:-1]])
    within = np.arange(len(lanes)) - np.repeat(first, np.diff(np.r_[first, len(lanes)]))
    block_at = np.cumsum(np.r_[True, (lane_bucket[1:] != lane_bucket[:-1]) | (within[1:] % 64 == 0)]) - 1
    slot = within % 64
    n_blocks = int(block_at[-1]) + 1
    grid = np.zeros((n_blocks, 64), np.uint64)
    grid[block_at, slot] = fps[lanes]
    member = np.full((n_blocks, 64), -1, np.int64)
    member[block_at, slot] = lanes
    block_bucket = np.empty(n_blocks, bucket.dtype)
    block_bucket[block_at] = lane_bucket
    weight = np.uint64(1) << np.arange(64, dtype=np.uint64)
    planes = np.stack([(((grid >> np.uint64(b)) & np.uint64(1)) * weight).sum(axis=1, dtype=np.uint64) for b in range(64)])
    absent = ((member < 0) * weight).sum(axis=1, dtype=np.uint64)
    lo, hi = np.searchsorted(block_bucket, bucket, "left"), np.searchsorted(block_bucket, bucket, "right")
    per = hi - lo if asks is None else (hi - lo) * asks
    found_q, found_m = [], []
    ends = np.cumsum(per)
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 400_000, "right")))
        q = np.repeat(np.arange(at, stop), per[at:stop])
        block = np.arange(len(q)) - np.repeat(ends[at:stop] - per[at:stop] - (ends[at - 1] if at else 0), per[at:stop]) + np.repeat(lo[at:stop], per[at:stop])
        value, over = fps[q], absent[block].copy()
        ones, twos = np.zeros(len(q), np.uint64), np.zeros(len(q), np.uint64)
        for b in range(64):
            differ = planes[b][block] ^ (np.uint64(0) - ((value >> np.uint64(b)) & np.uint64(1)))
            carry = ones & differ
            ones ^= differ
            over |= twos & carry
            twos ^= carry
            if b % 8 == 7:
                alive = over != _ALL
                if not alive.all():
                    q, block, value, over, ones, twos = (x[alive] for x in (q, block, value, over, ones, twos))
                if not len(q):
                    break
        if len(q):
            hit = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
            row, col = np.nonzero(hit)
            a, b = q[row], member[block[row], col]
            found_q.append(a[a != b])
            found_m.append(b[a != b])
        at = stop
    if not found_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_q), np.concatenate(found_m)


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of the links."""
    parent: dict[int, int] = {}

    def root(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        r, s = root(x), root(y)
        if r != s:
            parent[max(r, s)] = min(r, s)
            out.append((x, y))
    return out


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, fp, lane), in order of bucket and lanes first, to links (a, b).

    Whole buckets are compared many at a time.  Of one that goes on beyond ``STREAM``
    rows only the lanes stay held, and its later rows ask them as they come.
    """
    held: list[tuple[np.ndarray, ...]] = []

    def links(part):
        name, fps, lane, asks = (np.concatenate(x) for x in zip(*part))
        _, bucket, size = np.unique(name, return_inverse=True, return_counts=True)
        use = size[bucket] > 1
        fps, bucket, lane, asks = fps[use], bucket[use], lane[use], asks[use]
        a, b = sliced_links(fps, bucket, lane, asks=asks)
        signed = fps.view(np.int64)
        pairs = _forest(signed[a], signed[b])
        if pairs:
            x, y = zip(*pairs)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    for batch in batches:
        name = np.asarray(batch.column("bucket"))
        if not len(name):
            continue
        fps, lane = np.asarray(batch.column("fp")).view(np.uint64), np.asarray(batch.column("lane").to_numpy(zero_copy_only=False))
        cut = int(np.searchsorted(name, name[-1], "left"))  # the last bucket may go on in the next batch
        asks = np.ones(len(name), bool)
        if cut:
            yield from links([*held, (name[:cut], fps[:cut], lane[:cut], asks[:cut])])
            held = []
        held.append((name[cut:], fps[cut:], lane[cut:], asks[cut:]))
        if sum(len(h[0]) for h in held) > STREAM and not held[-1][2][-1]:  # all lanes are here
            yield from links(held)
            name, fps, lane, _ = (np.concatenate(x) for x in zip(*held))
            held = [(name[lane], fps[lane], lane[lane], np.zeros(int(lane.sum()), bool))]
    if held:
        yield from links(held)


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints within the radius of 3."""
    field = [F.shiftrightunsigned("fp", at).bitwiseAND((1 << width) - 1) for at, width in FIELDS]
    keys = [F.shiftleft(F.lit(t).cast("long"), 26) + F.shiftleft(field[i], 13) + field[j] for t, (i, j) in enumerate(combinations(range(5), 2))]
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("bucket"))
    large = rows.groupBy("bucket").count().where(F.col("count") > TILE).select(F.col("bucket").alias("large"), F.ceil(F.col("count") / TILE).cast("int").alias("shares"))
    rows = rows.join(large, F.col("bucket") == F.col("large"), "left")
    rows = rows.select("fp", "bucket", F.coalesce("shares", F.lit(1)).alias("shares"), F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)).alias("share"))
    own: Column = F.pmod(F.xxhash64("fp"), F.col("shares")) == F.col("share")
    rows = rows.select((F.shiftleft("bucket", 30) + F.col("share")).alias("bucket"), "fp", own.alias("lane"))
    return rows.repartition("bucket").sortWithinPartitions("bucket", F.desc("lane")).mapInArrow(_bucket_links, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges(a, b)`` reaches.

    Alternates large-star and small-star steps until all links are stars: every node has
    one link, to a node that has none.  Each round is a table in the shared folder.  A
    node with very many links is a skewed key of inner joins, which Spark splits.
    """
    star = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _are_stars(star):
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        star = staged(small.where("a <> b").distinct(), "links")
    return star.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _are_stars(links: DataFrame) -> bool:
    """No node has two links, and none that has one is at the end of another."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = ends.unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.sum("into").alias("into"))
    return nodes.agg(F.count_if((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("into") > 0)))).first()[0] == 0


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs(doc_id, text)``."""
    prints = staged(fingerprints(docs), "fingerprints")
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp")))
    named = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of = named.join(names, "root").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")


def keep_documents(docs: DataFrame) -> DataFrame:
    """One row of each component (its smallest ``doc_id``), with the columns of ``docs``.

    Rows are told apart by hashes of all their columns, so a ``doc_id`` that repeats or
    is null loses nothing else; of wholly equal rows one stays.  The texts are shuffled
    once and not written.
    """
    keyed = whole_rows(docs, doc_id=F.col("doc_id"), text=text_of())
    prints = staged(fingerprints(keyed, keep=["doc_id", "__k1", "__k2"]), "fingerprints")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("__k1").alias("k1"), F.col("__k2").alias("k2"))
    distinct = staged(prints.groupBy("fp").agg(F.min(rank).alias("first")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp")))
    stays = distinct.join(roots, F.col("fp") == F.col("node"), "left").groupBy(F.coalesce("root", "fp")).agg(F.min("first").alias("first"))
    stays = staged(stays.select(F.col("first.k1").alias("__k1"), F.col("first.k2").alias("__k2")), "stays")
    return keyed.join(stays, ["__k1", "__k2"], "left_semi").dropDuplicates(["__k1", "__k2"]).select("row.*")
