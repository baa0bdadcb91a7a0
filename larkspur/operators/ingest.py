"""Storing a table of new memories as if they came one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import text as X
from larkspur.operators import memory, vectors
from larkspur.sources.staged import staged


def kept_in_order(rows: DataFrame, threshold: float) -> DataFrame:
    """The ids of rows(id, embedding) that a pass in order of id keeps: those without an
    earlier kept row at or over ``threshold``.

    This is the lexicographically first independent set, found in rounds: a row whose near
    rows still open are all later ones is kept, and what is near to a kept row goes.  A
    round hands on the first near row of each row and never their pairs; all but few rows
    go in the first rounds, and the last one ends with none open.
    """
    open_, kept = staged(rows.select("id", "embedding"), "rows-open"), None
    while True:
        first = vectors.first_within(open_, threshold)
        new = staged(open_.join(first, "id", "left_anti"), "rows-kept")
        kept = new if kept is None else kept.unionByName(new)
        later = staged(open_.join(new.select("id"), "id", "left_anti"), "rows-later")
        if not later.limit(1).count():
            return kept.select("id")
        near = vectors.nearest(later.withColumnRenamed("id", "query_id"), new, 1, floor=threshold, earlier=True)
        open_ = staged(later.join(near.select(F.col("query_id").alias("id")), "id", "left_anti"), "rows-open")
        if not open_.limit(1).count():
            return kept.select("id")


def store_in_order(memories: DataFrame, incoming: DataFrame, now_ms: int, threshold: float = 0.9) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(created rows, status(id, status, duplicate_id, similarity), touches(id, touches)) of
    incoming(id, text, embedding[, category, importance, scope]), in order of id.

    A text whose hash a stored memory(id, content_hash, embedding) or an earlier created
    row has is a duplicate of it; else one with such a row at or over ``threshold`` is a
    duplicate of the nearest (ties by id).  All others are created, each seen by the rows
    after it.  Equal texts have equal embeddings; blank texts are ``empty`` and missing
    embeddings meet by hash alone.
    """
    rows = incoming.withColumns({"text": F.trim("text"), "content_hash": memory.content_hash(F.coalesce("text", F.lit("")))})
    blank = ~F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))
    rows = staged(rows.withColumn("_blank", blank), "incoming")
    live = rows.where(~F.col("_blank"))
    known = memories.groupBy("content_hash").agg(F.min("id").alias("known_id"))
    fresh = live.join(known, "content_hash", "left_anti")
    texts = fresh.groupBy("content_hash").agg(F.min(F.struct("id", "embedding")).alias("r")).select("r.id", "r.embedding")
    texts = staged(texts, "incoming-texts")
    stored = memories.select("id", "embedding").where("embedding is not null")
    near = vectors.nearest(texts.withColumnRenamed("id", "query_id"), stored, 1, floor=threshold)
    left = texts.join(near.select(F.col("query_id").alias("id")), "id", "left_anti")
    kept = kept_in_order(left.where("embedding is not null"), threshold).unionByName(left.where("embedding is null").select("id"))
    kept = staged(kept, "incoming-kept")
    made = staged(rows.join(kept, "id"), "incoming-created")
    again = live.join(kept, "id", "left_anti").join(known, "content_hash", "left")
    again = again.join(made.select("content_hash", F.col("id").alias("made_id")), "content_hash", "left")
    again = staged(again.withColumn("exact", F.coalesce("known_id", "made_id")).select("id", "embedding", "exact"), "incoming-duplicates")
    unlike = again.where("exact is null").select(F.col("id").alias("query_id"), "embedding")
    here = vectors.nearest(unlike, made.select("id", "embedding").where("embedding is not null"), 1, floor=threshold, earlier=True)
    there = vectors.nearest(unlike, stored, 1, floor=threshold)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    best = here.unionByName(there).withColumn("_n", F.row_number().over(order)).where("_n = 1")
    like = best.select("query_id", F.col("id").alias("near_id"), "similarity")
    found = again.join(like, F.col("id") == F.col("query_id"), "left").select("id", F.lit("duplicate").alias("status"), F.coalesce("exact", "near_id").alias("duplicate_id"), F.when(F.col("exact").isNull(), F.col("similarity")).alias("similarity"))
    none = [F.lit(None).cast("long").alias("duplicate_id"), F.lit(None).cast("double").alias("similarity")]
    status = found.unionByName(made.select("id", F.lit("created").alias("status"), *none)).unionByName(rows.where("_blank").select("id", F.lit("empty").alias("status"), *none))
    status = staged(status, "store-status")
    given = lambda name, other: F.coalesce(F.col(name), other) if name in incoming.columns else other
    category = given("category", X.category(F.col("text")))
    importance = F.greatest(F.lit(0.0), F.least(F.lit(1.0), given("importance", F.lit(0.5))))
    created = made.select("id", "text", "content_hash", category.alias("category"), given("scope", F.lit("global")).alias("scope"), importance.alias("importance"), F.lit("peripheral").alias("tier"), F.lit(0).cast("long").alias("access_count"), F.lit(now_ms).cast("long").alias("created_at"), "embedding")
    touches = status.where("duplicate_id is not null").groupBy(F.col("duplicate_id").alias("id")).agg(F.count("*").alias("touches"))
    return created, status, touches


def extracted_and_stored(memories: DataFrame, texts: DataFrame, now_ms: int, threshold: float = 0.9, embed=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(created, triples, counts(id, stored, duplicates)) of texts(id, text): their sentences
    that carry the signs of a category, then their preference sentences at importance 0.4,
    stored in that order; triples come from the speaker lines of texts that had something
    new.  ``embed`` makes a vector of a text column (a hashed one by default)."""
    embed = embed or (lambda t: X.hashed_vector(X.tokens(t)))
    facts = memory.extracted(texts).select(F.col("id").alias("source"), "n", "text", "category", "importance")
    wishes = texts.select(F.col("id").alias("source"), F.posexplode(X.bridges(F.col("text"))).alias("n", "text"))
    wishes = wishes.select("source", (F.col("n") + (1 << 20)).alias("n"), "text", F.lit("preference").alias("category"), F.lit(0.4).alias("importance"))
    rows = facts.unionByName(wishes).withColumn("id", F.col("source") * (1 << 21) + F.col("n")).withColumn("embedding", embed(F.col("text")))
    rows = staged(rows, "extracted")
    created, status, _ = store_in_order(memories, rows.drop("source", "n"), now_ms, threshold)
    of = rows.select("id", "source").join(status, "id")
    counts = of.groupBy(F.col("source").alias("id")).agg(F.count_if(F.col("status") == "created").alias("stored"), F.count_if(F.col("status") == "duplicate").alias("duplicates"))
    new = counts.where("stored > 0").select("id")
    return created.join(rows.select("id", "source"), "id"), memory.rule_triples(texts.join(new, "id", "left_semi")), counts
