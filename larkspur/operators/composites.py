"""Whole searches: a table of queries in, ranked results out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import chunking
from larkspur.functions import text as X
from larkspur.operators import fusion, lexical, memory
from larkspur.sources.staged import spread, staged


def hybrid(lists: list[DataFrame], k: int = 10) -> DataFrame:
    """(query_id, id, score, rank): ranked lists(query_id, id, rank), in order of
    precedence, fused by weighted reciprocal ranks."""
    every = None
    for n, ranked in enumerate(lists):
        one = ranked.select("query_id", F.lit(n).alias("list_no"), "id", "rank")
        every = one if every is None else every.unionByName(one)
    fused = fusion.fuse(fusion.weigh_lists(every))
    return lexical.top(fused.select("query_id", "id", F.round("score", 6).alias("score")), k, "id")


def recalled(memories: DataFrame, words: DataFrame, near: DataFrame, timed: DataFrame, now_ms: int) -> DataFrame:
    """(query_id, id, tier, score) of all memories in the three lists(query_id, id, rank):
    their fused ranks times their decay."""
    fused = fusion.memory_fuse(words, near, timed).select("query_id", "id", F.col("score").alias("_fused"))
    aged = memories.select("id", "tier", memory.composite(F.lit(now_ms)).alias("_decay"))
    return fused.join(aged, "id").select("query_id", "id", "tier", F.round(F.col("_fused") * F.col("_decay"), 6).alias("score"))


def recall(found: DataFrame, k: int = 10) -> DataFrame:
    return lexical.top(found, k, "id")


def recall_tiered(found: DataFrame, k: int = 5) -> DataFrame:
    """The best ``k`` of every query and tier."""
    order = Window.partitionBy("query_id", "tier").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def structured(lists: list[DataFrame], most: int = 20, k: int = 10) -> DataFrame:
    """As ``hybrid`` over typed searches, word searches first: each list counts to its
    ``most``-th rank and only the first that holds rows weighs 2."""
    every = None
    for n, ranked in enumerate(lists):
        one = ranked.where(F.col("rank") <= most).select("query_id", F.lit(n).alias("list_no"), "id", "rank")
        every = one if every is None else every.unionByName(one)
    fused = fusion.fuse(fusion.weigh_lists(every, 1))
    return lexical.top(fused.select("query_id", "id", F.round("score", 6).alias("score")), k, "id")


def auto_recall(found: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, id, text, score, rank) of found(query_id, query_scope, id, scope, text,
    score): memories of the query's scope and of scope 0, which all share, one per text."""
    own = found.where((F.col("scope") == F.col("query_scope")) | (F.col("scope") == 0))
    order = Window.partitionBy("query_id", "text").orderBy(F.desc("score"), "id")
    once = own.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return lexical.top(once.select("query_id", "id", "text", "score"), k, "id")


#: What an intent term counts in a chunk, beside a query's word.
INTENT = 0.5


def best_chunks(hits: DataFrame, docs: DataFrame, asked: DataFrame, intent: str | None = None) -> DataFrame:
    """(query_id, id, seq, pos, text, held): of each hit(query_id, id) the chunk of
    docs(id, body) that holds most of the words of over two characters of asked(query_id,
    query); terms of a column ``intent`` count a half; the first chunk of equal ones.

    Documents are joined to the hits first, and each distinct one is cut once; a column
    ``path`` of the documents lets source code be cut at its declarations.
    """
    path = "path" if "path" in docs.columns else None
    some = docs.select("id", "body", *([path] if path else [])).join(hits.select("id").distinct(), "id", "left_semi")
    cut = chunking.chunked(some, "id", path=path).select("id", "seq", "pos", F.col("chunk").alias("text"))
    words = F.filter(X.words(F.col("query")), lambda w: F.length(w) > 2)
    want = asked.select("query_id", words.alias("_words"), (X.intent_terms(F.col(intent)) if intent else F.expr("cast(array() as array<string>)")).alias("_intent"))
    held = X.contains_score(F.col("_words"), F.col("text")) + INTENT * F.coalesce(X.contains_score(F.col("_intent"), F.col("text")), F.lit(0))
    rows = hits.select("query_id", "id").distinct().join(want, "query_id").join(cut, "id").withColumn("held", F.coalesce(held.cast("double"), F.lit(0.0)))
    order = Window.partitionBy("query_id", "id").orderBy(F.desc("held"), "seq")
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("query_id", "id", "seq", "pos", "text", "held")


def hybrid_search(lists: list[DataFrame], docs: DataFrame, asked: DataFrame, scores: DataFrame | None = None, k: int = 10, candidates: int = 40, least: float = 0.0, reranker=None, intent: str | None = None) -> DataFrame:
    """(query_id, id, fused, score, rank): whole documents for ``asked(query_id, query)``.

    ``lists(query_id, id, rank)``, word searches first, are fused (the first two that
    hold rows weigh 2); the keyword and phrase boosts of ``docs(id, body)`` order the
    candidates; ``scores(query_id, id, score)`` of a reranker, 0 where missing, are blended
    in by place; in their place a ``reranker`` makes them of (query_id, id, query, text),
    text being the candidate's best chunk for the query and its ``intent`` column.  Without
    either the score is one over the place.
    """
    every = None
    for n, ranked in enumerate(lists):
        one = ranked.select("query_id", F.lit(n).alias("list_no"), "id", "rank")
        every = one if every is None else every.unionByName(one)
    fused = fusion.fuse(fusion.weigh_lists(every)).select("query_id", "id", "score")
    fused = staged(fused, "fused")  # a small table of known size, that the texts need not move for
    rows = spread(fused.join(asked.select("query_id", "query"), "query_id").join(docs.select("id", "body"), "id"), "query_id", "id")
    boosted = F.col("score") * X.keyword_boost(F.col("query"), F.col("body")) * X.phrase_boost(F.col("query"), F.col("body"))
    found = lexical.top(rows.select("query_id", "id", F.round(boosted, 6).alias("fused")), candidates, "id", "fused")
    if reranker is not None:
        found = staged(found, "candidates")
        scores = reranker(best_chunks(found, docs, asked, intent).join(asked.select("query_id", "query"), "query_id"))
    if scores is None:
        out = found.withColumn("score", F.round(1 / F.col("rank"), 6))
    else:
        found = fusion.reranked(found, scores)
        out = found.withColumn("score", F.round(fusion.position_blend(F.col("rank"), F.col("rerank")), 6))
    return lexical.top(out.where(F.col("score") >= least).select("query_id", "id", "fused", "score"), k, "id")


def recall_search(memories: DataFrame, asked: DataFrame, words: DataFrame, near: DataFrame, timed: DataFrame, now_ms: int) -> DataFrame:
    """As ``recalled`` for ``asked(query_id, query, target_ms, window_days)``: the fused
    ranks of words, vectors and time, times the keyword and phrase boosts, the decay and,
    for queries with a time, how near to it the memory was made."""
    fused = fusion.memory_fuse(words, near, timed).select("query_id", "id", F.col("score").alias("_fused"))
    known = memories.select("id", "tier", "text", "created_at", memory.composite(F.lit(now_ms)).alias("_decay"))
    rows = fused.join(asked.select("query_id", "query", "target_ms", "window_days"), "query_id").join(known, "id")
    boosts = X.memory_keyword_boost(F.col("query"), F.col("text")) * X.memory_phrase_boost(F.col("query"), F.col("text"))
    when = F.coalesce(memory.time_boost(F.col("created_at"), F.col("target_ms"), F.col("window_days")), F.lit(1.0))
    return rows.select("query_id", "id", "tier", F.round(F.col("_fused") * boosts * F.col("_decay") * when, 6).alias("score"))
