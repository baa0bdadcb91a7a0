"""Temporal knowledge: triples with validity intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import entity_slug, grams
from larkspur.sources.staged import staged


def build(facts: DataFrame) -> DataFrame:
    """Validity intervals from asserted facts(id, subject, predicate, object, valid_from, ingested).

    In order of ingestion a fact closes the open one of its subject and predicate with
    another object; asserting the open object again changes nothing.
    """
    df = facts.withColumns({"subject": entity_slug(F.col("subject")), "predicate": F.lower("predicate"), "object": F.trim("object")})
    order = Window.partitionBy("subject", "predicate").orderBy("ingested", "id")
    df = df.withColumn("_before", F.lag("object").over(order)).where("_before is null or _before <> object")
    return df.withColumn("valid_until", F.lead("ingested").over(order)).drop("_before")


#: Facts and probes of a key from which its time is cut into pieces of about so many.
PIECE = 100_000
#: Facts of a subject from which its probes are answered by a sweep.
MANY = 1000


def as_of(facts: DataFrame, asked: DataFrame) -> DataFrame:
    """Facts that hold at asked(query_id, subject, at): valid_from <= at < valid_until.

    Probes meet the facts of their subject, those of subjects with over ``MANY`` by a
    sweep; results are the same either way.
    """
    many = staged(facts.groupBy("subject").count().where(F.col("count") > MANY).select("subject"), "many-facts")
    probes = asked.select("query_id", "subject", "at")
    if not many.limit(1).count():
        return probes.join(facts, "subject").where(_HOLDS)
    few = probes.join(facts.join(many, "subject", "left_anti"), "subject").where(_HOLDS)
    return few.unionByName(_swept(facts.join(many, "subject", "left_semi"), probes))


_HOLDS = "valid_from <= at and (valid_until is null or at < valid_until)"


def _swept(facts: DataFrame, asked: DataFrame) -> DataFrame:
    """``as_of`` by a sweep: facts and probes of a subject and predicate are sorted by
    time, and every probe sees the last fact before it.  Frequent keys are cut into pieces
    of time, which hand the last fact on to the next; range partitions and windows share one order, so
    nothing is shuffled twice.  Facts that reach into the next one's time (none, where
    ``build`` made them in order) leave the sweep and meet their subject's probes by join;
    facts without a beginning or of no length never hold.
    """
    rest = [c for c in facts.columns if c != "subject"]
    fact = facts.select("subject", F.col("predicate").alias("_p"), F.col("valid_from").alias("_t"), F.lit(0).alias("_kind"), F.struct(*rest).alias("_fact"), F.lit(None).cast(asked.schema["query_id"].dataType).alias("_query")).where("_t is not null and (_fact.valid_until is null or _fact.valid_until > _t)")
    probes = asked.select("query_id", "subject", "at").where("at is not null")
    each = probes.join(facts.select("subject", F.col("predicate").alias("_p")).distinct(), "subject")
    probe = each.select("subject", "_p", F.col("at").alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast(fact.schema["_fact"].dataType).alias("_fact"), F.col("query_id").alias("_query"))
    rows = staged(fact.unionByName(probe), "as-of-rows")
    place = F.col("_t").cast("timestamp").cast("double")
    # at most one key in PIECE of the rows is so frequent
    hot = rows.groupBy("subject", "_p").agg(F.count("*").alias("_n"), F.min(place).alias("_low"), F.max(place).alias("_high")).where(F.col("_n") > PIECE)
    hot = hot.select(F.struct("subject", "_p").alias("_k"), F.ceil(F.col("_n") / PIECE).alias("_pieces"), "_low", "_high")
    piece = F.when(F.col("_high") > F.col("_low"), F.least(F.floor((place - F.col("_low")) / (F.col("_high") - F.col("_low")) * F.col("_pieces")), F.col("_pieces") - 1))
    cut = rows.join(hot, F.struct("subject", "_p").eqNullSafe(F.col("_k")), "left").select(*rows.columns, F.coalesce(piece, F.lit(0)).cast("long").alias("_piece"))
    keys, order = ["subject", "_p", "_piece"], ["_t", "_kind"]
    ranged = cut.repartitionByRange(*keys).sortWithinPartitions(*keys, *order)
    stream = Window.partitionBy(*keys).orderBy(*order)
    begins = F.when(F.col("_kind") == 0, F.col("_t"))
    back = Window.partitionBy(*keys).orderBy(F.desc("_t"), F.desc("_kind")).rowsBetween(Window.unboundedPreceding, -1)
    after = F.last(begins, ignorenulls=True).over(back)  # backwards, as frames that end at the last row are summed anew a row
    swept = staged(ranged.withColumn("_after", after), "as-of-swept")
    # what a piece hands to its neighbours: a row a piece
    heads = swept.groupBy(*keys).agg(F.min(begins).alias("_first"))
    following = Window.partitionBy("subject", "_p").orderBy(F.desc("_piece")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = heads.select(F.struct("subject", "_p").alias("_k"), F.col("_piece").alias("_of"), F.last("_first", ignorenulls=True).over(following).alias("_next"))
    ahead = ahead.where("_next is not null")
    met = swept.join(ahead, F.struct("subject", "_p").eqNullSafe(F.col("_k")) & (F.col("_piece") == F.col("_of")), "left").withColumn("_after", F.coalesce("_after", "_next")).drop("_k", "_of", "_next")
    until = F.col("_fact.valid_until")
    loose = (F.col("_kind") == 0) & F.col("_after").isNotNull() & (until.isNull() | (until > F.col("_after")))
    met = staged(met.withColumn("_loose", F.coalesce(loose, F.lit(False))), "as-of-marked")
    kept = met.where("not _loose")
    last = F.last("_fact", ignorenulls=True).over(stream.rowsBetween(Window.unboundedPreceding, 0))
    seen = kept.repartitionByRange(*keys).sortWithinPartitions(*keys, *order).withColumn("_seen", last).where("_kind = 1")
    ends = kept.where("_kind = 0").groupBy(*keys).agg(F.max_by("_fact", "_t").alias("_end"))
    spans = heads.select(*keys).join(ends, keys, "left")
    carried = F.last("_end", ignorenulls=True).over(Window.partitionBy("subject", "_p").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1))
    carry = spans.select(F.struct("subject", "_p").alias("_k"), F.col("_piece").alias("_of"), carried.alias("_carried")).where("_carried is not null")
    seen = seen.join(carry, F.struct("subject", "_p").eqNullSafe(F.col("_k")) & (F.col("_piece") == F.col("_of")), "left")
    found = seen.withColumn("_seen", F.coalesce("_seen", "_carried")).select(F.col("_query").alias("query_id"), "subject", F.col("_t").alias("at"), "_seen.*")
    open_ = met.where("_loose").select("subject", "_fact.*")
    return found.where(_HOLDS).unionByName(probes.join(open_, "subject").where(_HOLDS))


def search(facts: DataFrame, subject: str | None = None, predicate: str | None = None, part: str | None = None, limit: int = 50) -> DataFrame:
    """Newest facts by subject, predicate and a part of the object."""
    df = facts
    if subject:
        df = df.where(F.col("subject") == entity_slug(F.lit(subject)))
    if predicate:
        df = df.where(F.col("predicate") == predicate.lower())
    if part:
        df = df.where(F.contains(F.lower("object"), F.lit(part.lower())))
    return df.orderBy(F.desc("valid_from"), "id").limit(limit)


def invalidate(facts: DataFrame, ids: DataFrame, at) -> DataFrame:
    """Close the open facts among ``ids(id)``."""
    marked = facts.join(ids.select("id", F.lit(True).alias("_close")), "id", "left")
    return marked.withColumn("valid_until", F.when(F.col("_close") & F.col("valid_until").isNull(), at).otherwise(F.col("valid_until"))).drop("_close")


def timeline(facts: DataFrame) -> DataFrame:
    order = Window.partitionBy("subject").orderBy("valid_from", "ingested", "id")
    return facts.withColumn("place", F.row_number().over(order))


def stats(facts: DataFrame) -> DataFrame:
    return facts.agg(F.countDistinct("subject").alias("subjects"), F.count("*").alias("facts"), F.count_if(F.col("valid_until").isNull()).alias("active"), F.count_if(F.col("valid_until").isNotNull()).alias("expired"))


def profiles(facts: DataFrame) -> DataFrame:
    """(subject, n_open, profile) of subjects with two or more open facts: predicates in
    order, each with its distinct objects."""
    lists = facts.where("valid_until is null").groupBy("subject", "predicate").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("object")), ", ").alias("objects"))
    line = F.struct("predicate", F.concat_ws(": ", "predicate", "objects").alias("line"))
    out = lists.groupBy("subject").agg(F.sum("n").alias("n_open"), F.array_sort(F.collect_list(line)).alias("lines")).where("n_open >= 2")
    return out.select("subject", "n_open", F.array_join(F.transform("lines", lambda x: x["line"]), "; ").alias("profile"))


def consolidated(facts: DataFrame, least: int = 2) -> DataFrame:
    """(subject, kind, text, category, importance): memories that sum up every subject
    with ``least`` open facts or more.

    A ``profile`` names each predicate with its distinct objects, in order of the first
    fact that says so; a ``timeline`` tells the dated ones by date, where there are two or
    more.  Equal objects are folded before a subject's lines meet.  Null objects are left
    out of profiles and end the line of a timeline early.
    """
    open_ = facts.where("valid_until is null")
    shown = F.replace("subject", F.lit("_"), F.lit(" "))
    said = F.replace("predicate", F.lit("_"), F.lit(" "))
    counts = open_.groupBy("subject").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("subject")
    once = open_.groupBy("subject", "predicate", "object").agg(F.min("id").alias("id"))
    lists = once.groupBy("subject", "predicate").agg(F.array_sort(F.collect_list(F.struct("id", "object"))).alias("_objects"))
    line = F.concat(said, F.lit(": "), F.array_join(F.transform("_objects", lambda x: x["object"]), ", "))
    lines = lists.groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("predicate", line.alias("line")))).alias("_lines"))

    def told(kind: str, head: str):
        return F.concat(F.lit(f"[entity-{head}:"), "subject", F.lit("] "), kind, F.lit("."))

    profile = F.concat(shown, F.lit(". "), F.array_join(F.transform("_lines", lambda x: x["line"]), ". "))
    dated = F.concat(F.lit("["), F.date_format("valid_from", "d MMMM, yyyy"), F.lit("] "), F.concat_ws(" ", shown, said, "object"))
    times = open_.where("valid_from is not null").groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("valid_from", "predicate", "id", dated.alias("line")))).alias("_lines")).where(F.size("_lines") >= 2)
    made = lines.select("subject", F.lit("profile").alias("kind"), told(profile, "summary").alias("text"))
    made = made.unionByName(times.select("subject", F.lit("timeline").alias("kind"), told(F.array_join(F.transform("_lines", lambda x: x["line"]), ". "), "timeline").alias("text")))
    return made.join(counts, "subject", "left_semi").select("subject", "kind", "text", F.lit("entity").alias("category"), F.lit(0.85).alias("importance"))


def injected(hits: DataFrame, asked: DataFrame, facts: DataFrame, weak: float = 0.5, most: int = 5) -> DataFrame:
    """(query_id, source, id, score): hits(query_id, id, score), and for queries whose best
    score is under ``weak`` the newest open facts, ``most`` at most, about the one to three
    entities of asked(query_id, subject), at the upper median of the query's scores."""
    scores = F.array_sort(F.collect_list("score"))
    tops = hits.groupBy("query_id").agg(F.max("score").alias("best"), scores.alias("s")).where(F.col("best") < weak)
    tops = tops.select("query_id", F.get("s", F.floor(F.size("s") / 2).cast("int")).alias("score"))
    named = asked.distinct().withColumn("_n", F.count("*").over(Window.partitionBy("query_id"))).where("_n <= 3").drop("_n")
    met = named.join(tops, "query_id").join(facts.where("valid_until is null").select("subject", "id", "valid_from"), "subject")
    order = Window.partitionBy("query_id").orderBy(F.desc("valid_from"), "id")
    added = met.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    return hits.select("query_id", F.lit("memory").alias("source"), "id", "score").unionByName(added.select("query_id", F.lit("fact").alias("source"), "id", "score"))


def entities(facts: DataFrame) -> DataFrame:
    """(subject), distinct."""
    return facts.select("subject").distinct()


def about(facts: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, id, predicate, object): open facts on the subjects of asked(query_id, name)."""
    want = asked.select("query_id", entity_slug(F.col("name")).alias("subject"))
    return want.join(facts.where("valid_until is null"), "subject").select("query_id", "id", "predicate", "object")


def search_scoped(facts: DataFrame, asked: DataFrame, shared: str = "global", limit: int = 50, met: list | None = None) -> DataFrame:
    """(query_id, id, rank): facts(scope, ...) for a table asked(query_id, subject, predicate,
    part, scope, at) whose nulls don't narrow: those of the own scope and of ``shared``,
    open at ``at``, whose object holds ``part`` in any case; newest first.

    A query meets the facts of its subject; or else those whose object holds one piece of
    three characters of ``part``, the rarest of them; or else those of its predicate; and
    all of the scope only where it names nothing.  ``met`` is given the number of facts met.
    """
    want = asked.select("query_id", entity_slug(F.col("subject")).alias("_subject"), F.lower("predicate").alias("_predicate"), F.lower("part").alias("_part"), F.col("scope").alias("_scope"), F.col("at").alias("_at"))
    want = want.withColumn("scope", F.explode(F.array_distinct(F.array("_scope", F.lit(shared).cast(asked.schema["scope"].dataType)))))
    way = F.when(F.col("_subject").isNotNull(), "subject").when(F.length("_part") >= 3, "part").when(F.col("_predicate").isNotNull(), "predicate").otherwise("scope")
    want = staged(want.withColumn("_way", way), "scoped-queries")
    pieces = want.where("_way = 'part'").select("query_id", "scope", F.explode(grams(F.col("_part"))).alias("_gram"))
    held = facts.select("scope", "id", F.explode(grams(F.col("object"))).alias("_gram"))
    held = staged(held.join(pieces.select("scope", "_gram").distinct(), ["scope", "_gram"], "left_semi"), "object-grams")
    counts = held.groupBy("scope", "_gram").count()
    rarest = pieces.join(counts, ["scope", "_gram"], "left").groupBy("query_id", "scope").agg(F.min(F.struct(F.coalesce("count", F.lit(0)), "_gram")).alias("r"))
    keyed = rarest.select("query_id", "scope", "r._gram").join(held, ["scope", "_gram"]).select("query_id", "scope", "id")
    rows = want.where("_way = 'subject'").join(facts, (want["scope"] == facts["scope"]) & (F.col("_subject") == F.col("subject"))).drop(want["scope"])
    rows = rows.unionByName(want.where("_way = 'part'").join(keyed, ["query_id", "scope"]).join(facts, ["scope", "id"]))
    rows = rows.unionByName(want.where("_way = 'predicate'").join(facts, (want["scope"] == facts["scope"]) & (F.col("_predicate") == F.col("predicate"))).drop(want["scope"]))
    rows = rows.unionByName(want.where("_way = 'scope'").join(facts, "scope"))
    if met is not None:
        met[:] = [rows.count()]
    rows = rows.where(
        (F.col("_predicate").isNull() | (F.col("predicate") == F.col("_predicate")))
        & (F.col("_part").isNull() | F.contains(F.lower("object"), F.col("_part")))
        & (F.col("_at").isNull() | ((F.col("valid_from").isNull() | (F.col("valid_from") <= F.col("_at"))) & (F.col("valid_until").isNull() | (F.col("_at") < F.col("valid_until")))))
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("valid_from"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "id", "rank")
