"""Agent memories: ingestion, decay, tiers, eviction, selection."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import chunking
from larkspur.functions import text as X
from larkspur.operators import vectors
from larkspur.sources.staged import spread, staged

DAY = 86_400_000.0
# Fixed values. Half-life in days, stretch and floor of each tier, and of any other.
HALF_LIFE = {"core": 90.0, "working": 30.0, "peripheral": 14.0, "": 14.0}
BETA = {"core": 0.8, "working": 1.0, "peripheral": 1.3, "": 1.0}
FLOOR = {"core": 0.9, "working": 0.7, "peripheral": 0.5, "": 0.0}


def _by_tier(values: dict[str, float], tier: Column) -> Column:
    out = F.when(tier == "core", values["core"]).when(tier == "working", values["working"])
    return out.when(tier == "peripheral", values["peripheral"]).otherwise(values[""])


def content_hash(text: Column) -> Column:
    """md5 of the lower-cased text without outer white space."""
    space = r"[\s   -     　﻿]+"
    return F.md5(F.lower(F.regexp_replace(text, f"^{space}|{space}$", "")))


def composite(now_ms: Column, column=F.col) -> Column:
    """0.4 recency + 0.3 frequency + 0.3 importance, at least the tier's floor x importance.

    Recency is a stretched exponential of the days since the last access (or creation)
    whose half-life grows with importance; elsewhere importance counts from 0 to 1.
    """
    tier, imp = column("tier"), column("importance")
    days = F.greatest(F.lit(0.0), (now_ms - F.coalesce(column("last_accessed"), column("created_at"))) / DAY)
    recency = F.exp(-math.log(2) / (_by_tier(HALF_LIFE, tier) * F.exp(1.5 * imp)) * F.pow(days, _by_tier(BETA, tier)))
    frequency = 1 - F.exp(-column("access_count") / 5.0)
    imp = F.greatest(F.lit(0.0), F.least(F.lit(1.0), imp))
    return F.greatest(0.4 * recency + 0.3 * frequency + 0.3 * imp, _by_tier(FLOOR, tier) * imp)


def next_tier(tier: Column, score: Column, count: Column, imp: Column) -> Column:
    return (
        F.when((tier == "peripheral") & (count >= 3) & (score >= 0.4), "working")
        .when((tier == "working") & (count >= 10) & (score >= 0.7) & (imp >= 0.8), "core")
        .when((tier == "working") & (score < 0.15), "peripheral")
        .when((tier == "core") & (score < 0.15) & (count < 3), "working")
        .otherwise(tier)
    )


def decayed(memories: DataFrame, now_ms: int) -> DataFrame:
    """Memories with ``score`` and ``new_tier``."""
    df = memories.withColumn("score", composite(F.lit(now_ms)))
    return df.withColumn("new_tier", next_tier(F.col("tier"), F.col("score"), F.col("access_count"), F.col("importance")))


def decay_report(memories: DataFrame, now_ms: int) -> DataFrame:
    """One row: processed, promoted, demoted, stale (score below 0.3)."""
    level = lambda c: F.when(F.col(c) == "core", 2).when(F.col(c) == "working", 1).otherwise(0)
    return decayed(memories, now_ms).agg(
        F.count("*").alias("processed"),
        F.count_if(level("new_tier") > level("tier")).alias("promoted"),
        F.count_if(level("new_tier") < level("tier")).alias("demoted"),
        F.count_if(F.col("score") < 0.3).alias("stale"),
    )


def evictable(memories: DataFrame, now_ms: int) -> DataFrame:
    """Old, unimportant, hardly used memories, but for core, reflections and decisions,
    those used in the last week, and working ones that still score by their last use."""
    now = F.lit(now_ms)
    idle = now - F.col("last_accessed")
    old = (now - F.col("created_at") > 30 * DAY) & (F.col("importance") < 0.4) & (F.col("access_count") < 2)
    kept = (F.col("tier") == "core") | F.col("category").isin("reflection", "decision") | F.coalesce(idle <= 7 * DAY, F.lit(False))
    kept = kept | ((F.col("tier") == "working") & (composite(now) >= 0.1))
    return memories.where(old & ~kept)


def evict(memories: DataFrame, history: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """(memories left, history with EVICT rows)."""
    gone = evictable(memories, now_ms)
    log = gone.select(F.col("id").alias("memory_id"), F.lit("EVICT").alias("action"), F.col("text").alias("old_value"), F.lit(None).cast("string").alias("new_value"), F.lit(now_ms).cast("long").alias("timestamp"))
    return memories.join(gone.select("id"), "id", "left_anti"), history.unionByName(log)


def store(memories: DataFrame, incoming: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """(new rows, touched ids with counts): incoming texts not yet stored, by content hash.

    Of equal incoming texts the lowest id is new and the others touch it.
    """
    hashed = incoming.withColumn("content_hash", content_hash(F.col("text")))
    first = Window.partitionBy("content_hash").orderBy("id")
    ranked = hashed.withColumn("_n", F.row_number().over(first)).withColumn("_first", F.min("id").over(Window.partitionBy("content_hash")))
    known = memories.groupBy("content_hash").agg(F.min("id").alias("stored_id"))
    matched = ranked.join(known, "content_hash", "left")
    new = matched.where("stored_id is null and _n = 1").drop("_n", "_first", "stored_id").withColumn("created_at", F.lit(now_ms).cast("long"))
    touched = matched.where("stored_id is not null or _n > 1").groupBy(F.coalesce("stored_id", "_first").alias("id")).agg(F.count("*").alias("touches"))
    return new, touched


def touch(memories: DataFrame, log: DataFrame) -> DataFrame:
    """Fold an access log (id, accessed_at) into counters."""
    seen = log.groupBy("id").agg(F.count("*").alias("_hits"), F.max("accessed_at").alias("_last"))
    df = memories.join(seen, "id", "left")
    return df.withColumn("access_count", F.col("access_count") + F.coalesce("_hits", F.lit(0))).withColumn("last_accessed", F.greatest("last_accessed", "_last")).drop("_hits", "_last")


def stats(memories: DataFrame) -> DataFrame:
    """(kind, name, n): all, by tier, by category, by scope, in one grouping."""
    sets = memories.groupingSets([["tier"], ["category"], ["scope"], []], "tier", "category", "scope").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 3, "tier").when(F.col("g") == 5, "category").when(F.col("g") == 6, "scope").otherwise("total")
    return sets.select(kind.alias("kind"), F.coalesce("tier", "category", F.col("scope").cast("string"), F.lit("all")).alias("name"), "n")


def push_pack(memories: DataFrame, now_ms: int, limit: int = 10) -> DataFrame:
    """What to load first, per scope: core, then important and recent, then lately used."""
    now, part = F.lit(now_ms), Window.partitionBy("scope")
    recent = lambda c: F.coalesce(now - F.col(c) <= 14 * DAY, F.lit(False))
    reason = F.when(F.col("tier") == "core", 1).when((F.col("importance") >= 0.7) & recent("created_at"), 2).when(recent("last_accessed"), 3)
    order = part.orderBy("reason", F.desc("importance"), F.col("last_accessed").desc_nulls_last(), "id")
    return memories.withColumn("reason", reason).where("reason is not null").withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def time_window(memories: DataFrame, asked: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, id, rank): memories strictly inside target +- window, nearest first.

    ``asked(query_id, target_ms, window_days)``.  Days make the join keys, so each
    query meets only the days of its window.
    """
    width = F.col("window_days") * F.lit(int(DAY))
    days = asked.select("query_id", "target_ms", width.alias("width"), F.explode(F.sequence(F.floor((F.col("target_ms") - width) / DAY), F.floor((F.col("target_ms") + width) / DAY))).alias("day"))
    rows = memories.select("id", "created_at", F.floor(F.col("created_at") / DAY).alias("day")).join(days, "day")
    away = F.abs(F.col("created_at") - F.col("target_ms"))
    order = Window.partitionBy("query_id").orderBy("away", "id")
    return rows.withColumn("away", away).where("away < width").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 10 * k).select("query_id", "id", "rank")


def time_boost(created: Column, target: Column, window_days: Column) -> Column:
    return 1 + F.greatest(F.lit(0.0), 0.4 * (1 - F.abs(created - target) / DAY / window_days))


def turns_text(turns: DataFrame, roles: str = "all", first: int | None = None) -> DataFrame:
    """(conv_id, text): ``role: content`` lines of all turns, of user turns, or of the
    first ``first`` user turns."""
    df = turns if roles == "all" else turns.where(F.col("role").startswith("user"))
    if first is not None:
        df = df.withColumn("_n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).where(F.col("_n") <= first)
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))))
    return df.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))


def exchanges(turns: DataFrame) -> DataFrame:
    """(conv_id, pair, text): successive messages two by two, of 30 characters or more."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    pairs = turns.withColumn("_n", n).groupBy("conv_id", F.floor(F.col("_n") / 2).alias("pair"))
    both = pairs.agg(F.max(F.when(F.col("_n") % 2 == 0, F.col("text"))).alias("a"), F.max(F.when(F.col("_n") % 2 == 1, F.col("text"))).alias("b")).where("b is not null")
    return both.select("conv_id", "pair", F.concat("a", F.lit("\n\nAssistant: "), "b").alias("text")).where(F.length("text") >= 30)


def extracted(texts: DataFrame) -> DataFrame:
    """(id, n, text, category, importance): sentences of texts(id, text) that carry the
    signs of a category, numbered within their text."""
    # in the array, where a filter can't make every category be found twice
    found = F.transform(X.sentences(F.col("text")), lambda s, n: F.struct(n.alias("n"), s.alias("text"), X.category(s).alias("category")))
    kinds = spread(texts).select("id", F.inline(F.filter(found, lambda s: s["category"] != "other")))
    return kinds.withColumn("importance", X.importance(F.col("text"), F.col("category")))


def forgotten(memories: DataFrame, ids: DataFrame) -> DataFrame:
    return memories.join(ids.select("id"), "id", "left_anti")


def listing(memories: DataFrame, limit: int = 50, offset: int = 0, **equal) -> DataFrame:
    """Newest memories whose columns equal the given values; at most 500 at a time."""
    for name, value in equal.items():
        memories = memories.where(F.col(name) == value)
    return memories.orderBy(F.desc("created_at"), "id").offset(max(0, offset)).limit(min(500, max(1, limit)))


def updated(memories: DataFrame, edits: DataFrame, history: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """Apply edits(id, text, importance, category), nulls leaving a value; importance is
    held to 0..1, a new text gets its hash and is logged.  One edit an id."""
    new = edits.select("id", F.col("text").alias("_text"), F.col("importance").alias("_importance"), F.col("category").alias("_category"))
    both = memories.join(new, "id", "left")
    log = both.where("_text <> text").select(F.col("id").alias("memory_id"), F.lit("UPDATE").alias("action"), F.col("text").alias("old_value"), F.col("_text").alias("new_value"), F.lit(now_ms).cast("long").alias("timestamp"))
    held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_importance")))
    text = F.coalesce("_text", "text")
    kept = both.withColumns({"importance": F.when(F.col("_importance").isNull(), F.col("importance")).otherwise(held), "category": F.coalesce("_category", "category"), "content_hash": content_hash(text), "text": text})
    return kept.drop("_text", "_importance", "_category"), history.unionByName(log)


def cleaned(memories: DataFrame, now_ms: int, least: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(memories left, report): a decay pass gives new tiers; then, from ``least`` rows on,
    what may go is evicted.  The report has rows before and after and the tier moves."""
    moved = staged(decayed(memories, now_ms).withColumn("tier", F.col("new_tier")).drop("score", "new_tier"), "decayed")
    before = F.broadcast(memories.agg(F.count("*").alias("before")))
    gone = evictable(moved, now_ms).select("id", F.lit(True).alias("_gone"))
    left = moved.join(before).join(gone, "id", "left").where((F.col("before") < least) | F.col("_gone").isNull()).select(*moved.columns)
    report = decay_report(memories, now_ms).select(F.col("processed").alias("before"), "promoted", "demoted").join(left.agg(F.count("*").alias("after")))
    return left, report


def forgotten_logged(memories: DataFrame, ids: DataFrame, history: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """(memories left, history with DELETE rows)."""
    gone = memories.join(ids.select("id").distinct(), "id", "left_semi")
    log = gone.select(F.col("id").alias("memory_id"), F.lit("DELETE").alias("action"), F.col("text").alias("old_value"), F.lit(None).cast("string").alias("new_value"), F.lit(now_ms).cast("long").alias("timestamp"))
    return forgotten(memories, ids), history.unionByName(log)


def store_near(memories: DataFrame, incoming: DataFrame, threshold: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """(new rows, duplicates(id, stored_id, similarity)): incoming(id, embedding, ...) whose
    nearest stored vector is at or over ``threshold`` are duplicates of it."""
    near = vectors.duplicate_probe(incoming.select(F.col("id").alias("query_id"), "embedding"), memories.select("id", "embedding"), threshold)
    near = near.select(F.col("query_id").alias("id"), F.col("id").alias("stored_id"), "similarity")
    return incoming.join(near.select("id"), "id", "left_anti"), near


def store_chunks(memories: DataFrame, incoming: DataFrame, size: int = 1536) -> tuple[DataFrame, DataFrame]:
    """(rows to store, status) of a batch incoming(id, text), long texts in chunks.

    Rows (id, chunk_seq, chunk_pos, text, content_hash) are those whose hash no stored
    memory has; equal chunks of one batch are all kept.  A text is ``created`` if any of
    its chunks is new and ``duplicate`` if none is.
    """
    long = F.length("text") > size
    whole = incoming.where(~long).select("id", F.lit(0).alias("chunk_seq"), F.lit(0).alias("chunk_pos"), "text")
    cut = chunking.chunked(incoming.where(long).select("id", F.col("text").alias("body")), "id", size)
    rows = whole.unionByName(cut.select("id", F.col("seq").alias("chunk_seq"), F.col("pos").alias("chunk_pos"), F.col("chunk").alias("text")))
    known = memories.select("content_hash").distinct().withColumn("_known", F.lit(True))
    rows = rows.withColumn("content_hash", content_hash(F.col("text"))).join(known, "content_hash", "left")
    status = rows.groupBy("id").agg(F.when(F.count("_known") < F.count("*"), "created").otherwise("duplicate").alias("status"))
    return rows.where("_known is null").select("id", "chunk_seq", "chunk_pos", "text", "content_hash"), status


def exported(memories: DataFrame) -> DataFrame:
    """(line): one JSON object a memory, of its portable columns."""
    metadata = F.col("metadata") if "metadata" in memories.columns else F.lit(None).cast("string").alias("metadata")
    return memories.select(F.to_json(F.struct("text", "category", "scope", "importance", "created_at", metadata)).alias("line"))


def imported(lines: DataFrame) -> DataFrame:
    """Memories out of exported(line); lines that are no such object are left out."""
    read = F.from_json("line", "text string, category string, scope string, importance double, created_at long, metadata string")
    return lines.select(read.alias("m")).where("m.text is not null").select("m.*", content_hash(F.col("m.text")).alias("content_hash"))


# Fixed patterns and the predicates they stand for.
TRIPLE_PATTERNS = (
    (r"(?i)\b(?:went to|attended|visited)\s+(?:a\s+)?(.+?)(?:\.|!|$)", "attended"),
    (r"(?i)\bsigned up for\s+(?:a\s+)?(.+?)(?:\.|!|$)", "signed_up_for"),
    (r"(?i)\bjoined\s+(?:a\s+)?(.+?)(?:\.|!|$)", "joined"),
    (r"(?i)\b(?:going to|plan(?:ning)? to (?:go to|attend))\s+(?:a\s+)?(.+?)(?:\.|!|$)", "plans_to_attend"),
    (r"(?i)\bresearch(?:ed|ing)\s+(.+?)(?:\.|!|$)", "researched"),
    (r"(?i)\bmoved (?:from|to)\s+(.+?)(?:\.|!|$)", "moved"),
    (r"(?i)\bpainted\s+(?:a\s+|that\s+)?(.+?)(?:\.|!|$)", "painted"),
    (r"(?i)\b(?:love|like|enjoy)s?\s+(.+?)(?:\.|!|$)", "enjoys"),
    (r"(?i)\bfrom\s+(?:my\s+)?(?:home\s+country\s+)?([A-Z]\w+)\b.*?(?:grandma|family|heritage|roots|necklace)", "origin_country"),
    (r"(?i)\b(single|divorced|married|widowed)\s+(?:parent|mother|father|mom|dad)\b", "relationship_status"),
    (r"(?i)\b(?:stoked for|excited about|loved)\s+the\s+(.+?)(?:\.|!|$)", "kids_enjoyed"),
    (r"(?i)\bI(?:'m| am)\s+(?:a |an )?(\w[\w\s]{2,30}?)(?:\.|!|,|$)", "identity"),
    (r"(?i)\b(?:my )?(?:kids?|children)\s+(?:like|love|enjoy|are (?:into|stoked for))\s+(.+?)(?:\.|!|$)", "kids_like"),
    (r"(?s)(.{0,40}?\d+\s+years?.{0,20})", "duration_mentioned"),
)


def rule_triples(texts: DataFrame) -> DataFrame:
    """(id, subject, predicate, object, valid_from) out of texts(id, text) of the form
    ``[time on date] Speaker: what was said``: what fixed patterns find, first match each."""
    speaker = F.regexp_extract("text", r"\]\s*(\w+):\s*", 1)
    said = F.trim(F.regexp_replace("text", r"^(.*?)\[[^\]]*\]\s*\w+:\s*", "$1"))
    stamp = F.regexp_replace(F.regexp_extract("text", r"\[([^\]]+)\]", 1), r"(?i)\s+on\s+", " ")
    at = F.unix_millis(F.try_to_timestamp(F.upper(stamp), F.lit("h:mm a d MMMM, yyyy")))
    found = [F.struct(F.lit(name).alias("predicate"), F.trim(F.left(F.regexp_extract(said, pattern, 1), F.lit(100))).alias("object")) for pattern, name in TRIPLE_PATTERNS]
    rows = texts.where(speaker != "").select("id", speaker.alias("subject"), F.explode(F.array(*found)).alias("t"), at.alias("valid_from"))
    return rows.where("t.object <> ''").select("id", "subject", "t.predicate", "t.object", "valid_from")
