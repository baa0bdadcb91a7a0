"""The document catalogue: content addressing, reindexing, contexts, lookup, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import grams, title
from larkspur.sources.staged import staged


def addressed(docs: DataFrame) -> DataFrame:
    """docs(collection, path, body) with hash, docid and title."""
    hashed = docs.withColumn("hash", F.sha2("body", 256))
    return hashed.withColumns({"docid": F.substring("hash", 1, 6), "title": title(F.col("body"), F.col("path"))})


def contents(docs: DataFrame) -> DataFrame:
    """(hash, path, bytes): every content once, with the first path that has it."""
    return docs.groupBy("hash").agg(F.min("path").alias("path"), F.max(F.octet_length("body")).alias("bytes"))


def changes(current: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(collection, path, change): indexed, updated, retitled, unchanged or removed.

    Blank bodies of the snapshot are skipped, as if they weren't there.
    """
    old = current.select("collection", "path", F.col("hash").alias("old_hash"), F.col("title").alias("old_title"))
    new = snapshot.where(F.trim("body") != "").select("collection", "path", "hash", "title")
    kind = F.when(F.col("old_hash").isNull(), "indexed").when(F.col("hash").isNull(), "removed").when(F.col("hash") != F.col("old_hash"), "updated").when(F.col("title") != F.col("old_title"), "retitled").otherwise("unchanged")
    return old.join(new, ["collection", "path"], "full_outer").select("collection", "path", kind.alias("change"))


def pending(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Contents without a first vector: (hash, path, bytes)."""
    return contents(docs).join(vectors.where("seq = 0").select("hash"), "hash", "left_anti")


def orphans(content: DataFrame, docs: DataFrame) -> DataFrame:
    return content.join(docs.select("hash"), "hash", "left_anti")


def status(docs: DataFrame) -> DataFrame:
    """Per collection: documents, active ones, last change."""
    return docs.groupBy("collection").agg(F.count("*").alias("total"), F.count_if("active").alias("active"), F.max("modified_at").alias("last_modified"))


def contexts(docs: DataFrame, rules: DataFrame, every: str | None = None) -> DataFrame:
    """(collection, path, general, specific) of docs under rules(collection, prefix, context).

    general: the global text and all matching prefixes, shortest first; specific: the
    longest prefix's alone.  A document meets only rules that are prefixes of its path,
    by equality of the cut path.
    """
    cut = docs.select("collection", "path", F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.left(F.col("path"), n))).alias("prefix"))
    met = cut.join(rules, ["collection", "prefix"]).groupBy("collection", "path").agg(F.array_sort(F.collect_list(F.struct(F.length("prefix").alias("n"), "context"))).alias("found"))
    base = docs.select("collection", "path").join(met, ["collection", "path"], "left")
    texts = F.coalesce(F.transform("found", lambda x: x["context"]), F.expr("cast(array() as array<string>)"))
    texts = F.concat(F.array(F.lit(every)), texts) if every else texts
    return base.select("collection", "path", F.array_join(texts, "\n\n").alias("general"), F.element_at(F.when(F.size(texts) > 0, texts), -1).alias("specific"))


def similar(names: DataFrame, asked: DataFrame, most: int = 3, k: int = 5) -> DataFrame:
    """(query_id, path, distance, rank): stored paths within ``most`` edits.

    Two strings within d edits share one of d + 1 pieces of the asked one, cut from it
    and found within d places in the other; the pieces make the join keys.  A name of
    at most d characters has too few pieces, and meets the stored ones by length.
    """
    cut = asked.withColumn("low", F.lower("name")).withColumn("step", F.greatest(F.lit(1), F.floor(F.length("low") / (most + 1))))
    starts = F.sequence(F.lit(0), F.lit(most))
    pieces = cut.select("query_id", "low", F.explode(F.transform(starts, lambda i: F.struct((i * F.col("step")).alias("at"), F.substring(F.col("low"), (i * F.col("step") + 1).cast("int"), F.when(i == most, F.length("low")).otherwise(F.col("step")).cast("int")).alias("piece")))).alias("p"))
    pieces = pieces.select("query_id", "low", "p.at", F.col("p.piece").alias("piece"), F.length("p.piece").alias("size"))
    pieces = pieces.where(F.length("low") > most)
    stored = names.select("path", F.lower("path").alias("have")).crossJoin(F.broadcast(pieces.select("size").distinct())).where(F.length("have") >= F.col("size"))
    grams = stored.select("path", "have", "size", F.explode(F.sequence(F.lit(0), F.length("have") - F.col("size"))).alias("pos")).withColumn("piece", F.substring("have", F.col("pos") + 1, F.col("size")))
    met = grams.join(pieces, ["size", "piece"]).where(F.abs(F.col("pos") - F.col("at")) <= most).select("query_id", "low", "path", "have")
    short = cut.where(F.length("low") <= most).select("query_id", "low", F.explode(F.sequence(F.lit(0), F.length("low") + most)).alias("size"))
    banded = names.select("path", F.lower("path").alias("have")).withColumn("size", F.length("have")).join(short, "size").select("query_id", "low", "path", "have")
    met = met.unionByName(banded).distinct()
    near = met.withColumn("distance", F.levenshtein("low", "have", most)).where("distance >= 0")
    order = Window.partitionBy("query_id").orderBy("distance", "path")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "path", "distance", "rank")


def find(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, collection, path, how): by docid, ``collection/path``, path, or file name."""
    name = F.regexp_replace("name", r":\d+$", "")
    want = asked.select("query_id", name.alias("want"))
    keys = docs.select("collection", "path", F.explode(F.array(F.struct(F.lit(1).alias("how"), F.col("docid").alias("want")), F.struct(F.lit(2).alias("how"), F.concat_ws("/", "collection", "path").alias("want")), F.struct(F.lit(3).alias("how"), F.col("path").alias("want")), F.struct(F.lit(4).alias("how"), F.element_at(F.split("path", "/"), -1).alias("want")))).alias("k"))
    met = want.join(keys.select("collection", "path", "k.how", "k.want"), "want")
    order = Window.partitionBy("query_id").orderBy("how", "collection", "path")
    return met.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("query_id", "collection", "path", "how")


def find_all(docs: DataFrame, asked: DataFrame, most: int = 3, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(found, suggestions) for asked(query_id, name).

    found: as ``find``, and beyond it by the first six or more digits of the content's
    hash (5) and by the end of ``collection/path`` after a slash (6).  suggestions: paths
    within ``most`` edits of names that nothing was found for.
    """
    want = asked.select("query_id", F.regexp_replace(F.regexp_replace("name", r":\d+$", ""), "^#", "").alias("want"))
    hashes = want.where(F.col("want").rlike("^[0-9a-f]{7,64}$")).withColumn("lead", F.substring("want", 1, 6))
    by_hash = hashes.join(docs.select("collection", "path", "hash", F.substring("hash", 1, 6).alias("lead")), "lead").where(F.startswith("hash", "want"))
    parts = F.split(F.concat_ws("/", "collection", "path"), "/")
    ends = F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(parts))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    by_end = want.join(docs.select("collection", "path", F.explode(ends).alias("want")), "want")
    direct = find(docs, asked.withColumn("name", F.regexp_replace("name", "^#", "")))
    rows = direct.unionByName(by_hash.select("query_id", "collection", "path", F.lit(5).alias("how"))).unionByName(by_end.select("query_id", "collection", "path", F.lit(6).alias("how")))
    order = Window.partitionBy("query_id").orderBy("how", "collection", "path")
    found = rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    lost = asked.join(found.select("query_id"), "query_id", "left_anti")
    return found, similar(docs, lost.select("query_id", "name"), most, k)


def glob_regex(pattern: str) -> str:
    """Regular expression of a glob: ``**`` spans folders, ``*`` and ``?`` don't."""
    out, i = "^", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out += "[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if c in ".^$+{}[]()|\\" else c
            i += 1
    return out + "$"


def matching(docs: DataFrame, pattern: str) -> DataFrame:
    regex = glob_regex(pattern)
    return docs.where(F.col("path").rlike(regex) | F.concat_ws("/", "collection", "path").rlike(regex))


def glob_pattern(pattern: Column) -> Column:
    """``glob_regex`` of a column of patterns."""
    quoted = F.regexp_replace(pattern, r"([.^$+{}\[\]()|\\])", r"\\$1")
    marked = F.replace(F.replace(quoted, F.lit("**/"), F.lit("\x01")), F.lit("**"), F.lit("\x02"))
    single = F.replace(F.replace(marked, F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]"))
    return F.concat(F.lit("^"), F.replace(F.replace(single, F.lit("\x01"), F.lit("(?:.*/)?")), F.lit("\x02"), F.lit(".*")), F.lit("$"))


def matching_many(docs: DataFrame, asked: DataFrame, most: int = 10_240, near: int = 3, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """((query_id, collection, path, outcome), (query_id, path, distance, rank)) for
    asked(query_id, pattern): active documents(collection, path, body, active) that each
    glob fits, ``too large`` over ``most`` bytes, and suggestions for globs without any.

    A glob's literal parts are cut into pieces of three characters; the piece that the
    fewest paths hold makes the join key, and the glob's regular expression is tried on
    the paths that hold it alone.  Globs without such a piece meet all paths.
    """
    stored = docs.where("active").select("collection", "path", F.concat_ws("/", "collection", "path").alias("_full"), F.octet_length("body").alias("_bytes"))
    pieces = F.split("pattern", r"[*?]+")
    want = asked.where("pattern is not null").select("query_id", "pattern", glob_pattern(F.col("pattern")).alias("_regex"), F.array_distinct(F.flatten(F.transform(pieces, lambda x: grams(x)))).alias("_grams"))
    held = stored.select("collection", "path", F.explode(grams(F.col("_full"))).alias("_gram"))
    asked_grams = want.select("query_id", "pattern", F.explode("_grams").alias("_gram"))
    held = staged(held.join(asked_grams.select("_gram").distinct(), "_gram", "left_semi"), "path-grams")
    counts = held.groupBy("_gram").count()
    rarest = asked_grams.join(counts, "_gram", "left").groupBy("query_id", "pattern").agg(F.min(F.struct(F.coalesce("count", F.lit(0)), "_gram")).alias("r"))
    keyed = want.join(rarest.select("query_id", "pattern", "r._gram"), ["query_id", "pattern"]).join(held, "_gram").join(stored, ["collection", "path"])
    every = want.where(F.size("_grams") == 0).withColumn("_all", F.lit(1)).join(stored.withColumn("_all", F.lit(1)), "_all")
    columns = ["query_id", "pattern", "_regex", "collection", "path", "_full", "_bytes"]
    fits = F.expr("regexp_like(path, _regex) or regexp_like(_full, _regex)")
    found = keyed.select(*columns).unionByName(every.select(*columns)).where(fits)
    found = staged(found.select("query_id", "collection", "path", F.when(F.col("_bytes") > most, "too large").otherwise("ok").alias("outcome")), "glob-matches")
    lost = want.join(found.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.col("pattern").alias("name"))
    return found, similar(docs.where("active"), lost, near, k)


def body_lines(docs: DataFrame, first: int = 1, most: int | None = None) -> DataFrame:
    """Docs with their body cut to lines from ``first`` on, numbered."""
    lines = F.split("body", "\n")
    part = F.slice(lines, first, F.lit(most) if most is not None else F.greatest(F.size(lines), F.lit(1)))
    return docs.withColumn("body", F.array_join(F.transform(part, lambda x, i: F.concat((i + first).cast("string"), F.lit(": "), x)), "\n"))


def missing_contexts(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """Top folders of collections that no rule covers: (collection, folder)."""
    tops = docs.where(F.contains("path", F.lit("/"))).select("collection", F.split("path", "/")[0].alias("folder")).distinct()
    return tops.join(rules.select("collection", F.split(F.regexp_replace("prefix", "^/", ""), "/")[0].alias("folder")), ["collection", "folder"], "left_anti")


def without_contexts(collections: DataFrame, docs: DataFrame, rules: DataFrame) -> DataFrame:
    """(collection, docs): collections without any rule(collection, ...), each with its
    number of active documents; empty collections too."""
    bare = collections.select("collection").distinct().join(rules.select("collection"), "collection", "left_anti")
    counts = docs.where("active").groupBy("collection").agg(F.count("*").alias("docs"))
    return bare.join(counts, "collection", "left").select("collection", F.coalesce("docs", F.lit(0)).alias("docs"))


def upserted(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """``current`` with the rows of ``incoming`` in place of those with their collection
    and path; rows that come in are active.  Of several for one path the largest
    ``modified_at`` stays (if there is such a column), then the largest of all columns."""
    rest = [c for c in incoming.columns if c not in ("collection", "path")]
    order = ["modified_at", *(c for c in rest if c != "modified_at")] if "modified_at" in rest else rest
    last = incoming.groupBy("collection", "path").agg(F.max(F.struct(*order)).alias("_last"))
    incoming = last.select(*[c if c in ("collection", "path") else F.col(f"_last.{c}").alias(c) for c in incoming.columns])
    kept = current.join(incoming.select("collection", "path"), ["collection", "path"], "left_anti")
    return kept.unionByName(incoming.withColumn("active", F.lit(True)), allowMissingColumns=True)


def deactivated(current: DataFrame, seen: DataFrame) -> DataFrame:
    """``current`` with the rows whose path was not ``seen`` made inactive."""
    marked = current.join(seen.select("collection", "path", F.lit(True).alias("_seen")).distinct(), ["collection", "path"], "left")
    return marked.withColumn("active", F.col("active") & F.col("_seen").isNotNull()).drop("_seen")


def health(docs: DataFrame, vectors: DataFrame, now_ms: int) -> DataFrame:
    """One row: active documents, contents without vectors, days since the last change."""
    have = vectors.where("seq = 0").select("hash", F.lit(True).alias("_have")).distinct()
    days = F.floor((F.lit(now_ms) - F.max("modified_at")) / 86_400_000)
    lacking = F.countDistinct(F.when(F.col("_have").isNull(), F.col("hash")))
    return docs.where("active").join(have, "hash", "left").agg(F.count("*").alias("total_docs"), lacking.alias("needs_embedding"), days.alias("days_stale"))


def newest(cache: DataFrame, at: str, key: str, n: int = 1000) -> DataFrame:
    """The ``n`` newest entries of a cache; the larger key wins a tie."""
    return cache.orderBy(F.desc(at), F.desc(key)).limit(n)


def listing(docs: DataFrame, prefix: str = "") -> DataFrame:
    """(collection, path, bytes) of active documents under a prefix."""
    return docs.where(F.col("active") & F.col("path").startswith(prefix)).select("collection", "path", F.octet_length("body").cast("long").alias("bytes"))


def fetch(docs: DataFrame, asked: DataFrame, most: int = 10_240) -> DataFrame:
    """(query_id, path, outcome) for asked(query_id, name): ``ok``, ``too large`` over
    ``most`` bytes, or ``not found``."""
    sizes = docs.select("collection", "path", F.octet_length("body").alias("_bytes"))
    met = find(docs, asked).join(sizes, ["collection", "path"])
    outcome = F.when(F.col("path").isNull(), "not found").when(F.col("_bytes") > most, "too large").otherwise("ok")
    return asked.select("query_id").join(met, "query_id", "left").select("query_id", "path", outcome.alias("outcome"))


def orphan_vectors(vectors: DataFrame, docs: DataFrame) -> DataFrame:
    """Vectors(hash, seq) that no active document's content needs."""
    return vectors.join(docs.where("active").select("hash"), "hash", "left_anti")


def renamed(docs: DataFrame, old: str, new: str) -> DataFrame:
    """A collection under another name, in documents or in a table of collections."""
    return docs.withColumn("collection", F.when(F.col("collection") == old, new).otherwise(F.col("collection")))


def removed(docs: DataFrame, content: DataFrame, collection: str) -> tuple[DataFrame, DataFrame]:
    """Documents and content(hash) without a collection; content that others share stays."""
    kept = docs.where(~F.col("collection").eqNullSafe(collection))
    return kept, content.join(kept.select("hash"), "hash", "left_semi")


def created(collections: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``collections(collection, path, pattern, include_by_default, update)`` with the new
    ones of ``incoming``, and what became of each row(collection, path, outcome).

    Names are letters, digits, ``_`` and ``-`` (``bad name`` otherwise, null too); one that
    is taken stays as it is (``exists``); of several rows of one name the first by path is
    made, the others ``exist`` then.  Missing settings take their defaults.
    """
    first = Window.partitionBy("collection").orderBy(F.asc_nulls_last("path"))
    taken = collections.select("collection", F.lit(True).alias("_taken")).distinct()
    rows = incoming.withColumn("_n", F.row_number().over(first)).join(taken, "collection", "left")
    outcome = F.when(~F.coalesce(F.rlike("collection", F.lit(r"\A[A-Za-z0-9_-]+\z")), F.lit(False)), "bad name").when(F.col("_taken") | (F.col("_n") > 1), "exists").otherwise("created")
    rows = rows.withColumn("outcome", outcome)
    given = lambda c, default: F.coalesce(F.col(c), default).alias(c) if c in incoming.columns else default.alias(c)
    made = rows.where("outcome = 'created'").select("collection", "path", given("pattern", F.lit("**/*.md")), given("include_by_default", F.lit(True)), given("update", F.lit(None).cast("string")))
    return collections.unionByName(made), rows.select("collection", "path", "outcome")


def configured(collections: DataFrame, settings: DataFrame) -> DataFrame:
    """``collections`` with the settings(collection, include_by_default, update) that are not
    null; an empty ``update`` takes the command away.  Of several rows of one collection
    the largest values count; unknown collections are passed over."""
    last = settings.groupBy("collection").agg(F.max("include_by_default").alias("_include"), F.max("update").alias("_update"))
    rows = collections.join(last, "collection", "left")
    update = F.when(F.col("_update") == "", F.lit(None)).otherwise(F.coalesce("_update", "update"))
    return rows.withColumns({"include_by_default": F.coalesce("_include", "include_by_default"), "update": update}).select(*collections.columns)


def purged(docs: DataFrame) -> DataFrame:
    """Documents without the inactive ones."""
    return docs.where("active")


def in_collections(docs: DataFrame, named: list[str] | None, collections: DataFrame) -> DataFrame:
    """Documents of the ``named`` collections, or of those that
    ``collections(collection, include_by_default)`` includes where none is named."""
    if named:
        return docs.where(F.col("collection").isin(*named))
    return docs.join(collections.where("include_by_default").select("collection"), "collection", "left_semi").select(*docs.columns)


def briefing(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """(collection, docs, contexts): active documents of every collection, and its
    contexts out of rules(collection, prefix, context), shortest prefix first."""
    counts = docs.where("active").groupBy("collection").agg(F.count("*").alias("docs"))
    line = F.struct(F.length("prefix").alias("n"), "prefix", "context")
    told = rules.groupBy("collection").agg(F.array_sort(F.collect_list(line)).alias("_lines"))
    joined = counts.join(told, "collection", "left")
    return joined.select("collection", "docs", F.array_join(F.transform("_lines", lambda x: x["context"]), "\n").alias("contexts"))
