"""Line dedup over range-partitioned hashes, built of DataFrame functions alone.

A line's key is the line without space and 09-0D at both ends, A-Z lower-cased.  Hashes
of the keys of at least ``MIN_CHARS`` code points are range-partitioned and sorted within
their partitions by document, the largest ``doc_id`` first, and position.  One window
streams over that order: the first document of a key keeps its lines, and all others
lose them where the key is in ``MIN_DOCS`` documents or more.  What comes back is not
text but each document's keep bitmap, compressed to the runs of its zeros
(:func:`keep_bitmaps`); :func:`apply_bitmaps` cuts texts by it.

A key that holds a large share of all lines is not left to one task.  One pass of a
frequent-items sketch over the hashes finds every key with over one part in ``SHARES`` of
the lines, at most a few times ``SHARES`` keys; their rows are split into pieces by a
hash of the document, each piece streams like a key of its own, and the pieces' sums
(documents, largest one), again at most a few thousand rows a piece number, are
broadcast back.  The sketch decides the layout alone: results are the same without it.

Keys meet by 96 bits of hash; among n distinct keys two share them with a chance of
n * n / 2^97.  Rows are told apart by ``doc_id`` and 32 bits of their text's hash.

Defined cases: a null or empty text is one empty line; rows that share a ``doc_id`` are
one document to the count and to the choice of the largest; a null ``doc_id`` is one
document, smaller than all others; repeated rows lose the same lines; an empty table
gives an empty result; a text is one row at all times (its lines are rows of hashes);
further columns, whatever their names, are not read by the bitmaps and are kept by
:func:`keep_lines`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.shared import staged, text_of

MIN_CHARS, MIN_DOCS = 40, 5
#: A key with over one part in this many of all lines is split into pieces.
SHARES = 500
#: Counters of the sketch: it misses no key with over 4 / TRACKED of all lines.
TRACKED = 16_384
#: Lines of a piece of a frequent key, at least.
PIECE = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"


def _once(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def line_key(line: Column) -> Column:
    """The stripped line with A-Z lower-cased; other letters stay as they are."""
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_ = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def line_hashes(docs: DataFrame, key: str = "doc_id", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, at, h1, h2) of every line long enough; ``at`` holds 32 bits of the text's
    hash above the line's position."""
    rows = docs.select(F.col(key).alias("doc"), F.hash(text_of()).cast("long").alias("t"), F.posexplode(F.split(text_of(), "\n")).alias("pos", "line"))
    # lines that are too short before they are stripped need no key
    rows = rows.where(F.char_length("line") >= min_chars).select("doc", "t", "pos", line_key(F.col("line")).alias("k"))
    rows = rows.where(F.char_length("k") >= min_chars)
    return rows.select("doc", F.shiftleft("t", 32).bitwiseOR(F.col("pos")).alias("at"), F.xxhash64("k").alias("h1"), F.hash("k").alias("h2"))


def frequent_keys(lines: DataFrame, shares: int = SHARES) -> DataFrame:
    """(f1, pieces): the hashes that may hold over one part in ``shares`` of the lines.

    The estimate never falls short of a hash's count, and at most 2 * ``shares`` hashes
    reach it, so the table can be broadcast.
    """
    most = min(2 * shares, 10_000)
    found = lines.agg(F.count("*").alias("total"), F.expr(f"approx_top_k(h1, {most}, {TRACKED})").alias("top"))
    each = found.select("total", F.inline("top")).where((F.col("count") > F.col("total") / shares) & (F.col("count") > PIECE))
    return each.select(F.col("item").alias("f1"), F.ceil(F.col("count") / F.greatest(F.col("total") / (4 * shares), F.lit(PIECE))).cast("int").alias("pieces"))


def dropped_lines(lines: DataFrame, min_docs: int = MIN_DOCS, shares: int = SHARES) -> DataFrame:
    """The rows (doc, at) of staged ``line_hashes`` that go."""
    hot = staged(frequent_keys(lines, shares), "frequent-lines")
    rows = lines.join(F.broadcast(hot), F.col("h1") == F.col("f1"), "left")
    piece = F.coalesce(1 + F.pmod(F.xxhash64("doc"), F.col("pieces")), F.lit(0)).cast("int")
    rows = rows.select("doc", "at", "h1", "h2", piece.alias("piece"))
    ranged = rows.repartitionByRange("h1", "h2", "piece").sortWithinPartitions("h1", "h2", "piece", F.desc_nulls_last("doc"), "at")
    # the window's partitions and order are those of the rows, so nothing is shuffled or sorted again
    keys = Window.partitionBy("h1", "h2", "piece")
    stream = keys.orderBy(F.desc_nulls_last("doc"))
    seen = ranged.withColumn("place", F.dense_rank().over(stream))
    seen = seen.withColumn("docs", F.max("place").over(keys))
    cold = seen.where(f"piece = 0 and place > 1 and docs >= {min_docs}").select("doc", "at")
    if not hot.limit(1).count():
        return cold
    parts = staged(seen.where("piece > 0").select("doc", "at", "h1", "h2", "piece", "place", "docs"), "frequent-rows")
    firsts = parts.where("place = 1").select("h1", "h2", "piece", "doc", "docs").distinct()
    sums = firsts.groupBy("h1", "h2").agg(F.sum("docs").alias("all_docs"), F.max("doc").alias("last"))
    sums = staged(sums.where(F.col("all_docs") >= min_docs).select(F.col("h1").alias("f1"), F.col("h2").alias("f2"), "last"), "frequent-sums")
    met = parts.join(F.broadcast(sums), (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2")))
    return cold.unionByName(met.where(~F.col("doc").eqNullSafe(F.col("last"))).select("doc", "at"))


def keep_bitmaps(docs: DataFrame, key: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shares: int = SHARES) -> DataFrame:
    """(doc, t, gone): per text the keep bitmap of its lines, as the runs of its zeros,
    array<struct<at, n>> in order; texts that keep all lines have no row."""
    lines = staged(line_hashes(docs, key, min_chars), "line-hashes")
    gone = dropped_lines(lines, min_docs, shares).select("doc", F.shiftright("at", 32).cast("int").alias("t"), F.col("at").bitwiseAND(0x7FFFFFFF).cast("int").alias("pos"))
    places = gone.groupBy("doc", "t").agg(F.collect_set("pos").alias("places"))

    def runs(p: Column) -> Column:
        first = F.filter(p, lambda x, i: (i == 0) | (F.get(p, i - 1) != x - 1))
        last = F.filter(p, lambda x, i: F.coalesce(F.get(p, i + 1) != x + 1, F.lit(True)))
        return F.zip_with(first, last, lambda a, b: F.struct(a.alias("at"), (b - a + 1).alias("n")))

    return places.select("doc", "t", _once(F.array_sort("places"), runs).alias("gone"))


def kept_text(text: Column, gone: Column) -> Column:
    """struct(text, n_lines, n_dropped) of a text by its bitmap (null: all lines stay)."""

    def cut(lines: Column) -> Column:
        n = F.size(lines)
        start = lambda k: F.when(k == 0, 0).otherwise(F.get(gone, k - 1)["at"] + F.get(gone, k - 1)["n"])
        stop = lambda k: F.coalesce(F.get(gone, k)["at"], n)
        stay = F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda k: F.slice(lines, start(k) + 1, stop(k) - start(k))))
        return F.struct(F.array_join(stay, "\n").alias("text"), n.cast("long").alias("n_lines"), F.aggregate(gone, F.lit(0), lambda s, r: s + r["n"]).cast("long").alias("n_dropped"))

    whole = F.struct(text.alias("text"), (1 + F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    return F.when(gone.isNull(), whole).otherwise(_once(F.split(text, "\n"), cut))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, key: str = "doc_id") -> DataFrame:
    """(row, kept): every row of ``docs`` as a struct beside ``kept_text`` of it."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same = F.col(f"row.`{key}`").eqNullSafe(F.col("doc")) & (F.hash(text_of("row.text")) == F.col("t"))
    return rows.join(bitmaps, same, "left").select("row", _once(F.struct(text_of("row.text").alias("text"), F.col("gone").alias("gone")), lambda x: kept_text(x["text"], x["gone"])).alias("kept"))


def keep_lines(docs: DataFrame, key: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The rows of ``docs`` with their own columns, their texts without the lines that go."""
    done = apply_bitmaps(docs, keep_bitmaps(docs, key, min_chars, min_docs), key)
    return done.select(*[F.col("kept.text").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
