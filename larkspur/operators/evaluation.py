"""Ranking and answer metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import text as X


def ranking(results: DataFrame, gold: DataFrame, k: int, digits: int | None = 6) -> DataFrame:
    """Per query of ``gold(query_id, id)``: precision, recall, f1, rr and ndcg of
    ``results(query_id, id, rank)``; precision's base is min(k, gold size)."""
    hits = results.join(gold.select("query_id", "id").distinct(), ["query_id", "id"])
    found = hits.groupBy("query_id").agg(
        F.count_if(F.col("rank") <= k).alias("at_k"),
        F.count("*").alias("hits"),
        F.min("rank").alias("first"),
        F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1.0))).alias("dcg"),
    )
    ideal = sum((F.when(F.col("size") >= i, 1 / math.log2(i + 1)).otherwise(0.0) for i in range(1, k + 1)), F.lit(0.0))
    sizes = gold.groupBy("query_id").agg(F.countDistinct("id").alias("size"))
    df = sizes.join(found, "query_id", "left").na.fill(0, ["at_k", "hits", "dcg"])
    p, r = F.col("at_k") / F.least(F.lit(k), F.col("size")), F.col("hits") / F.col("size")
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    values = {"precision": p, "recall": r, "f1": f1, "rr": F.coalesce(1 / F.col("first"), F.lit(0.0)), "ndcg": F.col("dcg") / ideal}
    return df.select("query_id", *[(F.round(v, digits) if digits is not None else v).alias(n) for n, v in values.items()])


def means(scores: DataFrame, by: str) -> DataFrame:
    return scores.groupBy(by).agg(*[F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f1", "rr", "ndcg")], F.count("*").alias("queries"))


def session_recall(results: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(query_id, any_hit, recall): over a query's first ``k`` distinct sessions."""
    first = results.groupBy("query_id", "session").agg(F.min("rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "session"))
    top = first.withColumn("place", place).where(F.col("place") <= k)
    wanted = gold.select("query_id", "session").distinct()
    hit = wanted.join(top.select("query_id", "session", F.lit(1).alias("hit")), ["query_id", "session"], "left")
    return hit.groupBy("query_id").agg(F.coalesce(F.max("hit"), F.lit(0)).alias("any_hit"), F.round(F.count("hit") / F.count("*"), 6).alias("recall"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> Column:
    """struct(low, high) of the 95 % interval of a rate."""
    p = hits / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.struct(F.greatest(F.lit(0.0), centre - half).alias("low"), F.least(F.lit(1.0), centre + half).alias("high"))


def answer_tokens(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^A-Za-z0-9_\s]", " "), r"\s+"), lambda w: w != "")


def token_f1(answer: Column, truth: Column) -> Column:
    """F1 over the tokens of both texts, repeats counted."""
    times = lambda xs, w: F.size(F.filter(xs, lambda x: x == w))

    def scored(a: Column, t: Column) -> Column:
        shared = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, w: s + F.least(times(a, w), times(t, w)))
        return X.once(shared, lambda n: F.when(n > 0, 2.0 * n / (F.size(a) + F.size(t))).otherwise(0.0))

    # tokens are bound once, or every token would split both texts anew
    return X.once(answer_tokens(answer), lambda a: X.once(answer_tokens(truth), lambda t: scored(a, t)))


def coverage(memory: Column, truth: Column) -> Column:
    """Share of the truth's distinct tokens that the memory holds."""
    t = F.array_distinct(answer_tokens(truth))
    return F.when(F.size(t) == 0, 0.0).otherwise(F.size(F.array_intersect(t, X.tokens(memory))) / F.size(t))


def hit_rate(results: DataFrame, gold: DataFrame, k: int, by: str) -> DataFrame:
    """(by, queries, hit_rate): share of a group's queries with a gold id in the first ``k``."""
    found = results.where(F.col("rank") <= k).join(gold.select("query_id", "id"), ["query_id", "id"]).select("query_id", F.lit(1).alias("hit")).distinct()
    asked = gold.select("query_id", by).distinct().join(found, "query_id", "left")
    return asked.groupBy(by).agg(F.count("*").alias("queries"), F.round(F.count("hit") / F.count("*"), 6).alias("hit_rate"))


def answer_scores(answer: Column, truth: Column) -> Column:
    """struct(f1, exact, inside): F1 where every token of the answer that the truth holds
    counts, equality of the tokens, and whether the truth's stand in the answer's in a row."""
    a, t = answer_tokens(answer), answer_tokens(truth)
    held = F.size(F.filter(a, lambda w: F.array_contains(t, w)))
    p, r = held / F.size(a), held / F.size(t)
    f1 = F.when((F.size(a) == 0) & (F.size(t) == 0), 1.0).when(held > 0, 2 * p * r / (p + r)).otherwise(0.0)
    inside = F.contains(F.array_join(a, " "), F.array_join(t, " "))
    return F.struct(f1.alias("f1"), F.when(a == t, 1).otherwise(0).alias("exact"), F.when(inside, 1).otherwise(0).alias("inside"))


def content_ranking(results: DataFrame, truths: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, rr, ndcg) by content: results(query_id, rank, text) against
    ``truths(query_id, truth)``.  A text is right if it holds half of the truth's tokens;
    recall also counts seven tenths of them in the first ``k`` texts together."""
    asked = truths.select("query_id", answer_tokens(F.col("truth")).alias("_t"))
    top = results.where(F.col("rank") <= k).select("query_id", "rank", answer_tokens(F.col("text")).alias("_m"))
    rows = asked.join(top, "query_id", "left")
    held = F.filter("_t", lambda w: F.array_contains("_m", w))
    right = F.coalesce(F.size(held) >= 0.5 * F.size("_t"), F.lit(False)) & (F.size("_t") > 0)
    rows = rows.select("query_id", "_t", "rank", right.alias("_right"), F.coalesce(held, F.array().cast("array<string>")).alias("_held"))
    sums = rows.groupBy("query_id", "_t").agg(
        F.max("_right").alias("any"),
        F.min(F.when(F.col("_right"), F.col("rank"))).alias("first"),
        F.coalesce(F.sum(F.when(F.col("_right"), 1 / F.log2(F.col("rank") + 1.0))), F.lit(0.0)).alias("dcg"),
        F.count_if("_right").alias("n"),
        F.array_distinct(F.flatten(F.collect_list("_held"))).alias("_all"),
    )
    none = F.size("_t") == 0
    together = F.size(F.filter("_t", lambda w: F.array_contains("_all", w))) >= 0.7 * F.size("_t")
    ideal = sum((F.when(F.col("n") >= i, 1 / math.log2(i + 1)).otherwise(0.0) for i in range(1, k + 1)), F.lit(0.0))
    recall = F.when(none | F.col("any") | together, 1.0).otherwise(0.0)
    rr = F.when(none, 1.0).otherwise(F.coalesce(1 / F.col("first"), F.lit(0.0)))
    ndcg = F.when(none, 1.0).when(F.col("n") > 0, F.col("dcg") / ideal).otherwise(0.0)
    return sums.select("query_id", recall.alias("recall"), F.round(rr, 6).alias("rr"), F.round(ndcg, 6).alias("ndcg"))


def dialog_recall(results: DataFrame, evidence: DataFrame, k: int) -> DataFrame:
    """(query_id, dialogs, sessions): share of ``evidence(query_id, dialog)`` among the
    dialogs of results(query_id, rank, dialog) up to ``k``, and whether any of its sessions
    (what stands before the colon) is; queries without evidence count as 1."""
    top = results.where(F.col("rank") <= k).select("query_id", "dialog").distinct()
    session = F.substring_index("dialog", ":", 1)
    wanted = evidence.select("query_id", "dialog")
    found = wanted.join(top.select("query_id", "dialog", F.lit(1).alias("hit")), ["query_id", "dialog"], "left")
    seen = top.select("query_id", session.alias("session"), F.lit(1).alias("seen")).distinct()
    found = found.withColumn("session", session).join(seen, ["query_id", "session"], "left")
    n = F.count("dialog")
    return found.groupBy("query_id").agg(F.round(F.when(n == 0, 1.0).otherwise(F.count(F.when(F.col("dialog").isNotNull(), F.col("hit"))) / n), 6).alias("dialogs"), F.when(n == 0, 1).otherwise(F.coalesce(F.max("seen"), F.lit(0))).alias("sessions"))


def distinguishable(a: Column, na: Column, b: Column, nb: Column) -> Column:
    """``yes`` if the 95 % intervals of two rates (hits a of na, b of nb) don't overlap,
    ``marginal`` if their centres are further apart than half the wider one, else ``no``."""
    x, y = wilson(a, na), wilson(b, nb)
    apart = F.abs((x["low"] + x["high"]) / 2 - (y["low"] + y["high"]) / 2)
    wider = F.greatest(x["high"] - x["low"], y["high"] - y["low"])
    return F.when((x["high"] < y["low"]) | (y["high"] < x["low"]), "yes").when(apart > wider / 2, "marginal").otherwise("no")
