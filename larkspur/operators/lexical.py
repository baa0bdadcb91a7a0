"""Inverted index and BM25 for whole tables of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import text as X
from larkspur.sources.staged import spread, staged

K1, B = 1.2, 0.75
FIELD_WEIGHTS = {"path": 1.5, "title": 4.0, "body": 1.0}


def _weighed(weights: dict[str, float], analyse=X.tokens):
    """All tokens of the fields as structs (term, w)."""

    def of(field: str, w: float):
        return F.transform(analyse(F.col(field)), lambda t: F.struct(t.alias("term"), F.lit(w).alias("w")))

    return F.flatten(F.array(*[of(f, w) for f, w in weights.items()]))


def postings(docs: DataFrame, weights: dict[str, float] | None = None, key: str = "doc_id") -> DataFrame:
    """(key, term, tf): weighted counts of every term over the fields."""
    return docs.select(key, F.explode(_weighed(weights or FIELD_WEIGHTS)).alias("p")).groupBy(key, F.col("p.term").alias("term")).agg(F.sum("p.w").alias("tf"))


#: Distinct asked terms up to this many are broadcast (under 100 MB); more are shuffled.
BROADCAST_TERMS = 1_000_000


def scanned(docs: DataFrame, asked: DataFrame, weights: dict[str, float] | None = None, key: str = "doc_id", analyse=X.tokens, prefixes: bool = False) -> DataFrame:
    """(key, dl, term, tf): one pass over the texts, staged.

    ``dl`` counts all tokens of all fields, unweighted.  Rows are the postings of the
    terms of ``asked(term)``, and one of a null term for every document, from which
    the corpus figures come.  With ``prefixes`` an asked term stands for all terms that
    begin with it, which another pass over the texts finds.
    """
    weights = weights or FIELD_WEIGHTS
    docs = spread(docs, key)  # a task's documents are bounded, and their postings meet where they are made
    every = docs.select(key, _weighed(weights, analyse).alias("_all"))
    every = every.select(key, F.size("_all").alias("dl"), "_all")  # so that no exploded row carries the array
    document = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(0.0).alias("w")))
    rows = every.select(key, "dl", F.explode(F.concat("_all", document)).alias("p")).select(key, "dl", "p.term", "p.w")
    asked = asked.select("term", F.col("term").alias("_asked")).distinct()
    if prefixes:
        begun = expand_prefixes(docs, asked.select(F.lit(0).alias("query_id"), F.col("term").alias("prefix")), tuple(weights), analyse)
        asked = staged(begun.select("term", F.col("prefix").alias("_asked")), "prefix-terms")
    if asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        asked = F.broadcast(asked)
    rows = rows.join(asked, "term", "left").where("_asked is not null or term is null")
    return staged(rows.groupBy(key, "dl", F.col("_asked").alias("term")).agg(F.sum("w").alias("tf")), "postings")


def bm25(docs: DataFrame, terms: DataFrame, weights: dict[str, float] | None = None, key: str = "doc_id", match_all: bool = False, barred: DataFrame | None = None, analyse=X.tokens, prefixes: bool = False) -> DataFrame:
    """(query_id, key, score) for ``terms(query_id, term)``, which ``analyse`` has made of
    the queries as it makes the tokens of the documents.

    The texts are read once; corpus figures are one aggregate row, joined to the terms
    of the queries alone.  ``match_all`` keeps documents that hold every term; those
    that hold one of ``barred(query_id, term)`` go.  A frequent term has as many rows as
    documents and queries that hold it, which are all scored; Spark splits such a key.
    """
    terms = terms.select("query_id", "term").distinct()
    asked = terms.select("term") if barred is None else terms.select("term").unionByName(barred.select("term"))
    found = scanned(docs, asked, weights, key, analyse, prefixes)
    hits = found.where("term is not null")
    frequency = hits.groupBy("term").agg(F.count("*").alias("n"))
    corpus = found.where("term is null").agg(F.count("*").alias("total"), F.avg("dl").alias("avgdl"))
    idf = F.log((F.col("total") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    weighed = frequency.join(F.broadcast(corpus)).select("term", F.when(idf > 0, idf).otherwise(1e-6).alias("idf"), "avgdl")
    wanted = terms.join(weighed, "term").withColumn("bar", F.lit(False))
    if barred is not None:
        none = [F.lit(None).cast("double").alias(c) for c in ("idf", "avgdl")]
        wanted = wanted.unionByName(barred.select("query_id", "term", *none, F.lit(True).alias("bar")).distinct())
    if wanted.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        # a document's postings meet its queries in one of many tasks, and are summed up there
        hits, wanted = spread(hits, key, like=docs), F.broadcast(wanted)
    rows = hits.join(wanted, "term")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    out = rows.groupBy("query_id", key).agg(F.sum(part).alias("raw"), F.count_if(~F.col("bar")).alias("held"), F.max("bar").alias("bar"))
    out = out.where("not bar")
    if match_all:
        asked = terms.groupBy("query_id").agg(F.count("*").alias("asked"))
        out = out.join(asked, "query_id").where("held = asked")
    return out.select("query_id", key, F.round(F.col("raw") / (1 + F.col("raw")), 6).alias("score"))


def expand_prefixes(docs: DataFrame, prefixes: DataFrame, fields=tuple(FIELD_WEIGHTS), analyse=X.tokens) -> DataFrame:
    """(query_id, prefix, term): vocabulary terms that begin with each prefix.

    Every term meets the prefixes by its own beginnings, as long as the asked ones.
    """
    every = F.array_distinct(F.concat(*[analyse(F.col(f)) for f in fields]))
    vocabulary = spread(docs).select(F.explode(every).alias("term")).distinct()
    longest = prefixes.agg(F.coalesce(F.max(F.length("prefix")), F.lit(0)).alias("longest"))
    begins = vocabulary.join(F.broadcast(longest)).select("term", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length("term"), F.col("longest"))))).alias("n"))
    return begins.select("term", F.expr("left(term, n)").alias("prefix")).join(prefixes, "prefix").select("query_id", "prefix", "term")


def phrase_hits(docs: DataFrame, phrases: DataFrame, field: str = "body", key: str = "doc_id") -> DataFrame:
    """(query_id, key, n): how often a document holds the tokens of a phrase in a row.

    ``phrases(query_id, tokens)``.  A phrase is looked for only in documents that hold
    its rarest token.
    """
    asked = phrases.where("size(tokens) > 0").select("query_id", "tokens")
    terms = asked.select(F.explode("tokens").alias("term")).distinct()
    held = docs.select(key, F.explode(F.array_distinct(X.tokens(F.col(field)))).alias("term")).join(terms, "term", "left_semi")
    held = staged(held, "phrase-tokens")
    counts = held.groupBy("term").agg(F.count("*").alias("n"))
    rows = asked.withColumn("term", F.explode("tokens")).join(counts, "term", "left").na.fill(0, ["n"])
    rarest = rows.groupBy("query_id", "tokens").agg(F.min(F.struct("n", "term")).alias("r"))
    rarest = rarest.select("query_id", F.col("tokens").alias("_phrase"), F.col("r.term").alias("term"))
    found = held.join(rarest, "term").drop("term").join(docs.select(key, X.tokens(F.col(field)).alias("_tokens")), key)
    size = F.size("_phrase")
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_tokens") - size + 1)), lambda i: F.slice("_tokens", i, size) == F.col("_phrase"))
    return found.select("query_id", key, F.size(starts).cast("long").alias("n")).where("n > 0")


def top(rows: DataFrame, k: int, key: str = "doc_id", score: str = "score", by: str = "query_id") -> DataFrame:
    """Best ``k`` rows of every query with ``rank``; ties by key."""
    order = Window.partitionBy(by).orderBy(F.desc(score), key)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
