"""Rank fusion, blends and gates over (query_id, id, ...) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def fuse(lists: DataFrame) -> DataFrame:
    """Weighted reciprocal rank fusion of lists(query_id, list_no, weight, id, rank).

    Sum of weight / (60 + rank), ranks from 1, plus 0.05 for a first place in any list
    or 0.02 for a second or third.
    """
    top = F.min("rank")
    bonus = F.when(top == 1, 0.05).when(top <= 3, 0.02).otherwise(0.0)
    return lists.groupBy("query_id", "id").agg(F.sum(F.col("weight") / (RRF_K + F.col("rank"))).alias("base"), top.alias("top_rank"), bonus.alias("bonus")).withColumn("score", F.col("base") + F.col("bonus"))


def trace(lists: DataFrame) -> DataFrame:
    """As ``fuse``, with every list's contribution in list order."""
    part = F.struct("list_no", "rank", "weight", (F.col("weight") / (RRF_K + F.col("rank"))).alias("share"))
    parts = lists.groupBy("query_id", "id").agg(F.array_sort(F.collect_list(part)).alias("contributions"))
    return fuse(lists).join(parts, ["query_id", "id"])


def weigh_lists(lists: DataFrame, first: int = 2) -> DataFrame:
    """Weight 2 for a query's first ``first`` lists that hold rows, 1 for the rest."""
    place = F.dense_rank().over(Window.partitionBy("query_id").orderBy("list_no"))
    return lists.withColumn("weight", F.when(place <= first, 2.0).otherwise(1.0))


def memory_fuse(text: DataFrame, vector: DataFrame, time: DataFrame, weights=(0.8, 0.2, 0.1)) -> DataFrame:
    """0.8 / (60 + r) + 0.2 / (60 + r) + 0.1 / (60 + r) over three lists, no bonus."""
    rows = None
    for df, w in zip((text, vector, time), weights):
        part = df.select("query_id", "id", (F.lit(w) / (RRF_K + F.col("rank"))).alias("part"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("query_id", "id").agg(F.sum("part").alias("score"))


def position_blend(rank: Column, rerank: Column) -> Column:
    """w / rank + (1 - w) * rerank, w falling with the place: 0.75, 0.60, 0.40."""
    w = F.when(rank <= 3, 0.75).when(rank <= 10, 0.60).otherwise(0.40)
    return w / rank + (1 - w) * rerank


def minmax(value: Column, by: str = "query_id") -> Column:
    """Value on the query's own range; 0.5 where the range is empty."""
    every = Window.partitionBy(by)
    low, high = F.min(value).over(every), F.max(value).over(every)
    return F.when(high == low, 0.5).otherwise((value - low) / (high - low))


def strong_signal(hits: DataFrame, least: float = 0.85, gap: float = 0.15) -> DataFrame:
    """(query_id, top, gap, strong): whether the best hit stands alone."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    both = hits.withColumn("_n", F.row_number().over(order)).where("_n <= 2").groupBy("query_id").agg(F.max("score").alias("top"), F.min(F.when(F.col("_n") == 2, F.col("score"))).alias("second"))
    apart = F.col("top") - F.coalesce("second", F.lit(0.0))
    return both.select("query_id", F.round("top", 6).alias("top"), F.round(apart, 6).alias("gap"), ((F.col("top") >= least) & (apart >= gap)).alias("strong"))


def diverse(ranked: DataFrame, key: str, k: int) -> DataFrame:
    """First of every key in rank order, then the rest; a null key is always new."""
    repeat = F.when(F.col(key).isNull(), 0).otherwise((F.row_number().over(Window.partitionBy("query_id", key).orderBy("rank", "id")) > 1).cast("int"))
    order = Window.partitionBy("query_id").orderBy("_repeat", "rank", "id")
    return ranked.withColumn("_repeat", repeat).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("_repeat")


def reranked(found: DataFrame, scores: DataFrame) -> DataFrame:
    """``found`` with ``rerank``: the score of (query_id, id) in ``scores``, 0 where missing."""
    known = scores.groupBy("query_id", "id").agg(F.max("score").alias("rerank"))
    return found.join(known, ["query_id", "id"], "left").na.fill(0.0, ["rerank"])


def memory_gate(hits: DataFrame, gap: float = 0.15) -> DataFrame:
    """(query_id, strong): scores are taken as parts of the best one, so what counts is
    how far the second is below it."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    both = hits.withColumn("_n", F.row_number().over(order)).where("_n <= 2")
    first, second = F.max("score"), F.coalesce(F.min(F.when(F.col("_n") == 2, F.col("score"))), F.lit(0.0))
    return both.groupBy("query_id").agg(F.coalesce((first > 0) & ((first - second) / first >= gap), F.lit(False)).alias("strong"))


def appended(primary: DataFrame, others: list[DataFrame]) -> DataFrame:
    """(query_id, id, rank): a query's own list, then what the lists of its variants add,
    each from the place where the ones before it end; an id keeps its first place."""
    every = primary.select("query_id", F.lit(0).alias("_no"), "rank", "id")
    for n, more in enumerate(others, 1):
        every = every.unionByName(more.select("query_id", F.lit(n).alias("_no"), "rank", "id"))
    once = every.groupBy("query_id", "id").agg(F.min(F.struct("_no", "rank")).alias("_at"))
    order = Window.partitionBy("query_id").orderBy("_at", "id")
    return once.select("query_id", "id", F.row_number().over(order).alias("rank"))
