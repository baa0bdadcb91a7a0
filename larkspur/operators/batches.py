"""Greedy batches of a sorted table, as one pass in order would make them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.sources.staged import staged

#: Rows of a block of the order.
BLOCK = 4096


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``pos``, their place from 0 on in the order of the columns ``order``:
    places within range partitions, and the sizes of the partitions before."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = staged(ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "numbered")
    sizes = ranged.groupBy("_part").count()  # a row a partition
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    return ranged.join(F.broadcast(before), "_part").withColumn("pos", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def _jumps(sizes: list[int], own: int, most: int, limit: int) -> list[int]:
    """For each of the first ``own`` rows, where the batch that begins with it ends."""
    out, stop, held = [], 0, 0
    for i in range(own):
        if stop <= i:
            stop, held = i + 1, sizes[i]
        while stop < len(sizes) and stop - i < most and held + sizes[stop] <= limit:
            held += sizes[stop]
            stop += 1
        out.append(stop)
        held -= sizes[i]
    return out


def batched(rows: DataFrame, order: tuple[str, ...], size: str = "bytes", most: int = 64, limit: int = 64 << 20) -> DataFrame:
    """``rows`` with ``pos`` and ``batch``: at most ``most`` rows and ``limit`` bytes in a
    batch (one row may have more), each filled in the order of ``order`` before the next.

    Where a batch that begins at a row ends depends on the ``most`` rows from it on.  So a
    block of the order, with the rows after it, has a map from the place of its first
    whole batch to that of the next block's, below ``most`` both; maps are joined to those
    of twice as many blocks, round by round, and every block then knows its first batch.
    Null sizes count 0; equal rows of the order stand in any order.
    """
    placed = staged(numbered(rows, *order), "batch-rows")
    at = placed.select("pos", F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long").alias("size"), F.expr(f"pos div {BLOCK}").alias("block"))
    ahead = -(-most // BLOCK)  # rows that end batches of earlier blocks are sent there too
    far = F.explode(F.sequence(F.lit(0), F.lit(ahead))).alias("back")
    sent = at.select("pos", "size", "block", far).where(F.col("pos") - (F.col("block") - F.col("back") + 1) * BLOCK < most).select("pos", "size", (F.col("block") - F.col("back")).alias("block")).where("block >= 0")
    lists = staged(sent.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("pos", "size"))).alias("rows")), "batch-blocks")

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exits, counts = [], []
            for block, listed in zip(batch.column("block").to_pylist(), batch.column("rows").to_pylist()):
                own = sum(r["pos"] < (block + 1) * BLOCK for r in listed)
                jumps = _jumps([r["size"] for r in listed], own, most, limit)
                out, n = [0] * own, [0] * own
                for i in range(own - 1, -1, -1):
                    to = jumps[i]
                    out[i], n[i] = (to - own, 1) if to >= own else (out[to], n[to] + 1)
                exits.append([out[e] if e < own else e - own for e in range(most)])
                counts.append([n[e] if e < own else 0 for e in range(most)])
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(exits, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], ["block", "exits", "counts"])

    # prefix[b]: what the blocks before and with b make of an entry at block b - span + 1
    prefix = staged(lists.mapInArrow(maps, "block long, exits array<int>, counts array<long>"), "batch-maps")
    blocks, span = prefix.count(), 1
    while span < blocks:
        left = prefix.select((F.col("block") + span).alias("block"), F.col("exits").alias("x"), F.col("counts").alias("c"))
        both = prefix.join(left, "block", "left")
        exits = F.when(F.col("x").isNull(), F.col("exits")).otherwise(F.transform("x", lambda e: F.get("exits", e)))
        counts = F.when(F.col("x").isNull(), F.col("counts")).otherwise(F.zip_with("x", "c", lambda e, c: c + F.get("counts", e)))
        prefix, span = staged(both.select("block", exits.alias("exits"), counts.alias("counts")), "batch-maps"), 2 * span
    entry = prefix.select((F.col("block") + 1).alias("block"), F.get("exits", F.lit(0)).alias("entry"), F.get("counts", F.lit(0)).alias("before"))
    known = lists.join(entry, "block", "left")

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos, number = [], []
            for block, listed, entry_, before in zip(*(batch.column(c).to_pylist() for c in ("block", "rows", "entry", "before"))):
                own = sum(r["pos"] < (block + 1) * BLOCK for r in listed)
                jumps = _jumps([r["size"] for r in listed], own, most, limit)
                now, last = (before or 0) - 1, entry_ or 0
                for i in range(own):
                    if i == last:
                        now, last = now + 1, jumps[i]
                    pos.append(listed[i]["pos"])
                    number.append(now)
            yield pa.RecordBatch.from_arrays([pa.array(pos, pa.int64()), pa.array(number, pa.int64())], ["pos", "batch"])

    return placed.join(known.select("block", "rows", "entry", "before").mapInArrow(starts, "pos long, batch long"), "pos")
