"""Text analysis as Column functions; nothing here leaves the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions import lexicons as X


def ascii_boundaries(pattern: str) -> str:
    """``\\b`` with ASCII word characters (Java's is Unicode-aware); where a word character
    stands next to it, one look to the other side tells as much."""
    pattern = re.sub(r"(?<!\\)\\b(?=(?:[A-Za-z0-9_]|\[A-Z\])(?![?*{|]))", r"(?<![A-Za-z0-9_])", pattern)
    return pattern.replace(r"\b", r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))")


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(ascii_boundaries(pattern))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def words(text: Column) -> Column:
    """White-space words of the lower-cased text."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def boost_words(query: Column) -> Column:
    return F.array_distinct(F.filter(words(query), lambda w: (F.length(w) > 2) & ~w.isin(*X.BOOST_STOP)))


def _share(terms: Column, text: Column) -> Column:
    return contains_score(terms, text) / F.size(terms)


def keyword_boost(query: Column, text: Column) -> Column:
    terms = boost_words(query)
    return once(terms, lambda t: F.when(F.size(t) == 0, 1.0).otherwise(1 + 0.3 * _share(t, text)))


def phrase_boost(query: Column, text: Column) -> Column:
    phrases = F.regexp_extract_all(F.lower(query), F.lit("[\"']([^\"']{3,})[\"']"), F.lit(1))
    return once(F.lower(text), lambda low: F.when(F.exists(phrases, lambda p: F.contains(low, p)), 1.6).otherwise(1.0))


def name_boost(query: Column, text: Column) -> Column:
    names = F.regexp_extract_all(query, F.lit(ascii_boundaries(r"\b[A-Z][a-z]{2,}\b")), F.lit(0))
    return once(F.lower(text), lambda low: F.when(F.exists(names, lambda n: F.contains(low, F.lower(n))), 1.4).otherwise(1.0))


def memory_keywords(text: Column) -> Column:
    """Words over 2 characters that are no stop words nor stand as Capitalised words."""
    names = F.transform(F.filter(F.split(text, r"\s+"), lambda w: w.rlike("^[A-Z][a-z]+$")), F.lower)
    return F.filter(words(text), lambda w: (F.length(w) > 2) & ~w.isin(*X.MEMORY_STOP) & ~F.array_contains(names, w))


def memory_keyword_boost(query: Column, text: Column) -> Column:
    terms = memory_keywords(query)
    return once(terms, lambda t: F.when(F.size(t) == 0, 1.0).otherwise(1 + 0.4 * _share(t, text)))


def memory_phrase_boost(query: Column, text: Column) -> Column:
    phrases = F.regexp_extract_all(F.lower(query), F.lit('"([^"]+)"'), F.lit(1))
    return F.pow(F.lit(1.6), once(F.lower(text), lambda low: F.size(F.filter(phrases, lambda p: F.contains(low, p)))))


def intent_terms(intent: Column) -> Column:
    bare = F.transform(words(intent), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.filter(bare, lambda w: (F.length(w) > 1) & ~w.isin(*X.INTENT_STOP))


def entities(query: Column) -> Column:
    found = F.regexp_extract_all(query, F.lit(r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda m: ~F.split(m, r"\s+")[0].isin(*X.ENTITY_STOP) & (F.length(m) >= 3)))


def category_counts(text: Column) -> dict[str, Column]:
    return {c: sum((matches(text, p).cast("int") for p in ps), F.lit(0)) for c, ps in X.CATEGORY_PATTERNS.items()}


def category(text: Column) -> Column:
    """Category with most matching patterns; the earlier wins a tie; none is ``other``.

    The counts are bound once, as every one of them is asked for several times."""
    counts = category_counts(text)

    def named(n: Column) -> Column:
        best = F.greatest(*[n[c] for c in counts])
        out = F.when(best == 0, "other")
        for c in counts:
            out = out.when(n[c] == best, c)
        return out

    return once(F.struct(*[n.alias(c) for c, n in counts.items()]), named)


def bridges(text: Column) -> Column:
    """Preference sentences for search: what follows each preference pattern."""
    found = F.array(*[F.regexp_extract(text, ascii_boundaries(p), 1) for p in X.BRIDGE_PATTERNS])
    bare = F.transform(found, lambda x: F.regexp_replace(F.trim(x), r"[.,;!?]+$", ""))
    return F.transform(F.filter(bare, lambda x: F.length(x) >= 5), lambda x: F.concat(F.lit("User mentioned: "), x))


def importance(text: Column, kind: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z0-9_'-]+"), F.lit(0))
    proper = lambda found: F.filter(F.slice(found, 2, F.greatest(F.size(found), F.lit(1))), lambda w: w.rlike("^[A-Z][a-z]+") & ~F.lower(w).isin(*X.DENSITY_STOP))
    density = once(found, lambda f: F.when(F.size(f) == 0, 0.0).otherwise(F.least(F.lit(1.0), F.size(proper(f)) / F.size(f))))
    committed = F.lit(False)
    for p in X.COMMITMENT_PATTERNS:
        committed = committed | matches(text, p)

    def total(v: Column) -> Column:
        base = F.coalesce(*[F.when(v["kind"] == c, x) for c, x in X.CATEGORY_IMPORTANCE.items()], F.lit(0.5))
        out = base + F.when(F.length(text) > 200, 0.1).otherwise(0.0) + F.when(v["density"] >= 0.1, F.least(F.lit(0.1), v["density"] * 0.5)).otherwise(0.0)
        out = out + F.when(committed & (v["kind"] != "decision"), 0.05).otherwise(0.0)
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), out))

    return once(F.struct(kind.alias("kind"), density.alias("density")), total)


def sentences(text: Column) -> Column:
    """Trimmed sentences of 20 characters or more."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n\n+"), lambda s: F.trim(s)), lambda s: F.length(s) >= 20)


def time_reference(query: Column, now_ms: Column) -> Column:
    """struct(target_ms, window_days) of the first time expression, or null."""
    low, out = F.lower(query), None
    for pattern, days, window in X.TIME_PATTERNS:
        n = F.regexp_extract(low, pattern, 1).cast("long") if "(" in pattern else F.lit(1)
        hit = F.struct((now_ms - n * F.lit(days * 86_400_000)).alias("target_ms"), F.lit(window).alias("window_days"))
        out = F.when(low.rlike(pattern), hit) if out is None else out.when(low.rlike(pattern), hit)
    return out


def entity_slug(name: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.lower(name)), "['’]", ""), "[^a-z0-9]+", "_")
    return F.regexp_replace(bare, "^_|_$", "")


def path_name(path: Column) -> Column:
    """Normalised path: lower case, every run of other characters than letters, digits
    and ``$`` made ``-``, the last part's extension kept.  Names without a letter or
    digit give null."""
    parts = F.split(F.lower(F.replace(path, F.lit("___"), F.lit("/"))), "/")
    clean = lambda x: F.regexp_replace(F.regexp_replace(x, r"[^\p{L}\p{N}$]+", "-"), "^-+|-+$", "")
    last = F.element_at(parts, -1)
    ext = F.regexp_extract(last, r"(\.[a-z0-9]+)$", 1)
    name = F.when(ext != "", F.concat(clean(F.left(last, F.length(last) - F.length(ext))), ext)).otherwise(clean(last))
    head = F.filter(F.transform(F.slice(parts, 1, F.size(parts) - 1), clean), lambda x: x != "")
    return F.when(path.rlike(r"[\p{L}\p{N}]"), F.array_join(F.concat(head, F.array(name)), "/"))


def title(body: Column, path: Column) -> Column:
    """First level 1 or 2 heading (the next level 2 one where it is just "Notes"), an
    org title or heading, else the file's stem."""
    heading = F.trim(F.regexp_extract(body, r"(?m)^##?\s+(.+)$", 1))
    second = F.trim(F.regexp_extract(body, r"(?m)^##\s+(.+)$", 1))
    noted = heading.rlike(r"^(?:[^\p{L}\p{N}\s]+\s*)?Notes$")
    markdown = F.when(noted & (second != ""), second).when(heading != "", heading)
    org = F.coalesce(F.nullif(F.trim(F.regexp_extract(body, r"(?mi)^#\+TITLE:\s*(.+)$", 1)), F.lit("")), F.nullif(F.trim(F.regexp_extract(body, r"(?m)^\*+\s+(.+)$", 1)), F.lit("")))
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]+$", "")
    return F.coalesce(F.when(path.endswith(".md"), markdown).when(path.endswith(".org"), org), stem)


def contains_score(terms: Column, text: Column) -> Column:
    """How many of ``terms`` the text holds, which is lower-cased once for all of them."""
    return once(F.lower(text), lambda low: F.size(F.filter(terms, lambda t: F.contains(low, t))))


def snippet(body: Column, query: Column, intent: Column | None = None, most: int = 500) -> Column:
    """struct(line, text, before, after): the first line with most of the query's words
    (an intent term counts 0.3), one line before it and two after, cut to ``most``
    characters."""
    lines = F.split(F.coalesce(body, F.lit("")), "\n", -1)
    worth = lambda line: contains_score(words(query), line) + (0.3 * contains_score(intent_terms(intent), line) if intent is not None else 0)
    scores = F.transform(lines, lambda line: F.coalesce(worth(line).cast("double"), F.lit(0.0)))
    best = F.array_position(scores, F.array_max(scores)).cast("int")
    start, end = F.greatest(best - 1, F.lit(1)), F.least(best + 2, F.size(lines))
    text = F.array_join(F.slice(lines, start, end - start + 1), "\n")
    cut = F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 3)), F.lit("..."))).otherwise(text)
    return F.struct(best.alias("line"), cut.alias("text"), (start - 1).alias("before"), (F.size(lines) - end).alias("after"))


def sub_queries(query: Column, mode: str = "keywords") -> Column:
    """The query and what to search beside it: its first two pairs of keywords, or its
    first six keywords with each of its first two names; ``off`` adds nothing."""
    terms, more = memory_keywords(query), F.expr("cast(array() as array<string>)")
    if mode == "keywords":
        pairs = F.transform(F.sequence(F.lit(0), F.lit(1)), lambda i: F.slice(terms, 2 * i + 1, 2))
        more = F.transform(F.filter(pairs, lambda p: F.size(p) == 2), lambda p: F.array_join(p, " "))
    elif mode == "entities":
        head = F.array_join(F.slice(terms, 1, 6), " ")
        more = F.transform(F.slice(entities(query), 1, 2), lambda e: F.trim(F.concat_ws(" ", head, e)))
    return F.array_distinct(F.concat(F.array(query), more))


def labelled_lines(reply: Column) -> Column:
    """Array of struct(category, text, subject, predicate, object) from a model's lines
    ``[category] text``, the last three null unless ``||| s|p|o`` follows; texts under
    10 characters and unknown categories go."""
    form = r"^\[(\w+)\]\s+(.+?)\s*(?:\|\|\|\s*([^|]+)\|([^|]+)\|(.+))?$"
    part = lambda line, n: F.trim(F.regexp_extract(line, form, n))
    given = lambda c: F.nullif(c, F.lit(""))
    rows = F.transform(
        F.split(reply, "\n"),
        lambda x: F.struct(
            F.lower(part(x, 1)).alias("category"), part(x, 2).alias("text"), given(F.lower(part(x, 3))).alias("subject"),
            given(F.lower(part(x, 4))).alias("predicate"), given(part(x, 5)).alias("object"),
        ),
    )
    return F.filter(rows, lambda r: r["category"].isin(*X.CATEGORY_PATTERNS) & (F.length(r["text"]) >= 10))


def fact_json(reply: Column) -> Column:
    """struct(facts, triples) from the first ``{`` to the last ``}`` of a reply; null
    where that is no JSON.  Triples that lack a part go."""
    found = F.from_json(F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit("")), "facts array<string>, triples array<struct<subject:string,predicate:string,object:string>>")
    none = F.expr("cast(array() as array<string>)")
    facts = F.filter(F.coalesce(found["facts"], none), lambda f: F.length(f) > 0)
    triples = F.filter(F.coalesce(found["triples"], F.expr("cast(array() as array<struct<subject:string,predicate:string,object:string>>)")), lambda t: t["subject"].isNotNull() & t["predicate"].isNotNull() & t["object"].isNotNull())
    whole = F.coalesce(found["facts"].isNotNull() | found["triples"].isNotNull(), F.lit(False))
    return F.when(whole, F.struct(facts.alias("facts"), triples.alias("triples")))


def grams(text: Column, size: int = 3) -> Column:
    """Distinct pieces of ``size`` characters of the lower-cased text; none of a shorter one."""
    low = F.lower(F.coalesce(text, F.lit("")))
    starts = F.when(F.length(low) >= size, F.sequence(F.lit(1), F.length(low) - size + 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(low, i, F.lit(size))))


def once(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def hashed_vector(terms: Column, size: int = 64) -> Column:
    """Counts of terms by a hash into ``size`` places, scaled to length 1 (zeros for no
    terms): an embedder without a model, for tests and as a default.

    Places, counts and length are each bound once, so the work is terms times places."""
    places = F.transform(terms, lambda t: F.conv(F.substring(F.md5(t), 1, 7), 16, 10).cast("int") % size)
    counted = lambda at: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(at, lambda p: p == i)).cast("double"))
    length = lambda counts: F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x))
    scaled = lambda counts: once(length(counts), lambda n: F.transform(counts, lambda x: F.when(n > 0, x / n).otherwise(0.0)))
    return once(places, lambda at: once(counted(at), scaled))
