"""Removal of long repeated byte strings, by sorted suffixes.

A byte goes if a ``LENGTH``-byte string that covers it also starts anywhere else.  Not
every suffix is shipped: content picks anchors (positions whose ``GRAM``-byte hash is
the least of some ``LENGTH``-byte window), so every window holds one and equal windows
hold it at the same place.  Then

1. anchors meet by the hash of their gram; those whose gram occurs once can't repeat.  A
   gram that a batch of texts holds over ``COMMON`` times is known to repeat and its
   anchors are dealt out by text.  Anchors with one and the same context (all windows
   around the gram) are one class; a class with two members repeats in all its windows;
2. one context per class of a gram with several classes is fetched.  Sampled splitters
   range-partition these suffixes by their leading bytes, and a task cuts its range into
   buckets.  A bucket sorts the suffixes by multikey quicksort, seven bytes a step, and
   what stands before them, backwards, in the same way.  Two windows are equal if what
   they have of the suffix and of the part before it are: both are runs in these orders;
3. a bucket ends between two grams, or, where a gram is longer than a bucket and at the
   ends of a task, inside one.  Contexts with windows whose suffix part reaches such an
   end may go on beyond it: they are range-partitioned and sorted once more, by what
   stands before the suffix, backwards.  The few windows that reach an end of a bucket
   in both orders are compared across all buckets by 128-bit digests;
4. the spans go back to the texts by a 96-bit key of the text.

Equal whole texts count as one from the start and are removed whole by their number.

Defined cases: null text is empty (nothing to remove); texts under ``LENGTH`` bytes
never lose a byte; repeated rows are copies of each other; null ids are kept; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.shared import staged, text_of

LENGTH, GRAM = 200, 60
BEFORE = LENGTH - GRAM
#: Occurrences of a gram in one batch of texts above which its anchors are dealt by text.
COMMON, DEALS = 64, 1024
#: Suffixes of a bucket, and of one that no end of a gram cuts before.
BUCKET, MOST = 8192, 65536
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for b in (_BASE, inverse):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` over x[i : i + width] for every i, by doubling."""
    done = 1
    while 2 * done <= width:
        x = best(x[: len(x) - done], x[done:])
        done *= 2
    rest = width - done
    return best(x[: len(x) - rest], x[rest:]) if rest else x


class Anchors:
    """Finds anchors of many texts at once."""

    def __init__(self):
        self.power = self.inverse = np.zeros(0, np.uint64)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """(text number, position, right clip, gram hash, context hash) of every anchor."""
        raw = np.frombuffer(b"".join(texts), np.uint8)
        n = len(raw)
        sizes = np.array([len(t) for t in texts], np.int64)
        none = np.zeros(0, np.int64)
        if n < LENGTH:
            return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
        if len(self.power) < n + 1:
            self.power, self.inverse = _powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[raw] * self.power[:n], out=total[1:])
        gram = _mixed((total[GRAM:] - total[:-GRAM]) * self.inverse[: n - GRAM + 1]) | _U(1)
        low = _slide(gram, BEFORE + 1, np.minimum)  # least gram of the window at each start
        ends = np.cumsum(sizes)
        starts = ends - sizes
        inside = np.zeros(n + 1, np.int32)  # starts of windows that lie in one text
        long = sizes >= LENGTH
        np.add.at(inside, starts[long], 1)
        np.add.at(inside, ends[long] - LENGTH + 1, -1)
        low = np.where(np.cumsum(inside[: len(low)]) > 0, low, _U(0))
        pad = np.zeros(BEFORE, np.uint64)
        high = _slide(np.concatenate([pad, low, pad]), BEFORE + 1, np.maximum)
        at = np.flatnonzero(high[: len(gram)] == gram)
        text = np.searchsorted(ends, at, "right")
        left = np.minimum(at - starts[text], BEFORE)
        right = np.minimum(ends[text] - at, LENGTH)
        context = _mixed((total[at + right] - total[at - left]) * self.inverse[at - left])
        context = _mixed(context + (left * 512 + right).astype(np.uint64) * _U(_BASE))
        return text, at - starts[text], right, gram[at], context


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    find, seen = Anchors(), set()

    def rows(gram, context, k1, k2, place, deal):
        long = lambda x: pa.array(np.asarray(x).view(np.int64))
        return pa.RecordBatch.from_arrays([long(gram), long(context), long(k1), k2, long(place), pa.array(deal)], ["gram", "context", "k1", "k2", "place", "deal"])

    for batch in batches:
        for at in range(0, batch.num_rows, 400):
            piece = batch.slice(at, 400)
            keys = list(zip(piece.column("k1").to_pylist(), piece.column("k2").to_pylist()))
            texts, mine = [], []
            for i, (key, text) in enumerate(zip(keys, piece.column("text").to_pylist())):
                if text and key not in seen:
                    seen.add(key)
                    texts.append(text.encode())
                    mine.append(i)
            if len(seen) > 500_000:
                seen.clear()
            if not texts:
                continue
            text, pos, right, gram, context = find(texts)
            of = np.array(mine, np.int64)[text]
            k1 = np.asarray(piece.column("k1").take(pa.array(of)))
            distinct, number, count = np.unique(gram, return_inverse=True, return_counts=True)
            deal = np.where(count[number] > COMMON, k1 % DEALS + 1, 0).astype(np.int32)
            yield rows(gram, context, k1, piece.column("k2").take(pa.array(of)), pos << 8 | right, deal)
            common = distinct[count > COMMON]
            if len(common):  # so that the gram's anchors of other batches know that it repeats
                none = np.zeros(len(common), np.int64)
                yield rows(common, none, none, pa.array(none.astype(np.int32)), none - 1, none.astype(np.int32))


def _words(data: np.ndarray, start: np.ndarray, step: int, length: np.ndarray, width: int) -> np.ndarray:
    """Strings as words that sort as they do: seven bytes, then how many of them are there.

    String i has the bytes of ``data`` from start[i] on, forwards or backwards.
    """
    n = -(-width // 7)
    place = np.arange(7 * n)
    have = place < length[:, None]
    raw = np.where(have, data[np.where(have, start[:, None] + step * place, 0)], 0).astype(np.uint8)
    count = np.clip(length[:, None] - 7 * np.arange(n), 0, 7).astype(np.uint8)
    return np.concatenate([raw.reshape(len(start), n, 7), count[:, :, None]], axis=2).view(">u8")[:, :, 0].astype(np.uint64)


def multikey_order(words: np.ndarray, length: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the strings of each group in order, and how many bytes each has
    in common with the one before it (-1 for the first of a group).

    Multikey quicksort, a word a step: strings equal so far are one segment, which the
    next word parts again; segments of one string are done.
    """
    m, n = words.shape
    order = np.argsort(group, kind="stable")
    edge = np.ones(m, bool)
    edge[1:] = group[order][1:] != group[order][:-1]
    common = np.full(m, -1)
    part = np.cumsum(edge) - 1
    todo = np.flatnonzero(np.bincount(part, minlength=1)[part] > 1)
    for step in range(n):
        if not len(todo):
            break
        key, of = words[order[todo], step], part[todo]
        by = np.lexsort((key, of))
        order[todo], key = order[todo[by]], key[by]
        splits = np.flatnonzero((of[1:] == of[:-1]) & (key[1:] != key[:-1])) + 1
        differ = key[splits] ^ key[splits - 1]
        common[todo[splits]] = 7 * step + sum((differ < _U(1 << 8 * k)).astype(np.int64) for k in range(1, 8))
        edge[todo[splits]] = True
        part = np.cumsum(edge) - 1
        todo = todo[np.bincount(part)[part[todo]] > 1]
    common[~edge] = 7 * n
    length = length[order]
    common[1:] = np.minimum(common[1:], np.minimum(length[1:], length[:-1]))
    return order, common


def _nearest(order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For every string the most bytes it has in common with another one of its group."""
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(common, np.r_[common[1:], -1])
    return out


def repeated_offsets(data: np.ndarray, anchor: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, tuple, tuple]:
    """(found, orders of the suffixes and of what stands before them) for contexts around the positions ``anchor`` of
    ``data``, with ``left`` bytes before it and ``right`` from it on.

    found[i, o] is over 0 where the window that starts o bytes before the anchor of
    context i is also that of another one, and 1 for one of the contexts that share it.
    """
    m = len(anchor)
    suffixes, common = multikey_order(_words(data, anchor, 1, right, LENGTH), right, np.zeros(m, np.int64))
    gram = np.empty(m, np.int64)
    gram[suffixes] = np.cumsum(common < GRAM)
    befores, before_common = multikey_order(_words(data, anchor - 1, -1, left, BEFORE), left, gram)
    least, most = LENGTH - _nearest(suffixes, common), _nearest(befores, before_common)
    out = np.zeros((m, BEFORE + 1), np.uint8)
    run, before_run = np.empty(m, np.int64), np.empty(m, np.int64)
    for o in range(BEFORE + 1):
        some = np.flatnonzero((least <= o) & (o <= most))
        if len(some) < 2:
            continue
        run[suffixes] = np.cumsum(common < LENGTH - o)
        before_run[befores] = np.cumsum(before_common < o)
        key = run[some] * (m + 1) + before_run[some]
        by = np.argsort(key)
        same = key[by][1:] == key[by][:-1]
        out[some[by[np.r_[same, False]]], o] = 1
        out[some[by[np.r_[False, same]]], o] = 2
    return out, (suffixes, common), (befores, before_common)


def _shared(order: np.ndarray, common: np.ndarray, length: np.ndarray, first: bool, last: bool) -> np.ndarray:
    """For every context the bytes that its string has in common with the bucket's first
    or last one, where that end is open; -1 for none."""
    shared = np.full(len(order), -1)
    if first:
        shared = np.maximum(shared, np.minimum.accumulate(np.r_[length[order[0]], common[1:]]))
    if last:
        shared = np.maximum(shared, np.minimum.accumulate(np.r_[length[order[-1]], common[:0:-1]])[::-1])
    out = np.empty(len(order), np.int64)
    out[order] = shared
    return out


_OPEN = "gram long, context long, spans array<struct<a:int,b:int>>, left int, bytes binary, back binary, low int"
_SPANS = "gram long, context long, spans array<struct<a:int,b:int>>, windows array<struct<o:int,h1:long,h2:long,alone:boolean>>"


def _lists(row: np.ndarray, m: int, **fields: np.ndarray) -> pa.Array:
    """Lists of structs for the rows 0 to m - 1; ``row`` ascends."""
    offsets = np.searchsorted(row, np.arange(m + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(x) for x in fields.values()], list(fields)))


class _Bucket:
    """Contexts of one bucket, with what repeats among them."""

    def __init__(self, rows: pa.Table):
        self.rows, self.m = rows, rows.num_rows
        raw = pa.concat_arrays(rows.column("bytes").chunks)
        start = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + self.m + 1].astype(np.int64)
        self.data = np.frombuffer(raw.buffers()[2], np.uint8)
        self.left = np.asarray(rows.column("left")).astype(np.int64)
        self.anchor, self.right = start[:-1] + self.left, np.diff(start) - self.left
        self.found, self.suffixes, self.befores = repeated_offsets(self.data, self.anchor, self.left, self.right)

    def spans(self) -> tuple[np.ndarray, pa.Array]:
        """Runs of repeated offsets as spans of bytes relative to the anchor."""
        edge = np.diff(np.pad(self.found > 0, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        (of, a), (_, b) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        return of, _lists(of, self.m, a=(1 - b).astype(np.int32), b=(LENGTH - a).astype(np.int32))

    def by_suffix(self, first: bool, last: bool) -> pa.Table:
        """Rows with spans, and rows of contexts with windows whose suffix part reaches an
        open end: from offset ``low`` on they may go on beyond it."""
        of, spans = self.spans()
        low = np.maximum(LENGTH - _shared(*self.suffixes, self.right, first, last), 0)
        on = np.flatnonzero(low <= self.left)
        back = []
        for at, n in zip(self.anchor[on].tolist(), self.left[on].tolist()):
            back.append(self.data[at : at + GRAM].tobytes() + self.data[at - n : at][::-1].tobytes())
        open_ = self.rows.take(pa.array(on)).append_column("back", pa.array(back, pa.binary())).append_column("low", pa.array(low[on].astype(np.int32)))
        some = pa.array(np.unique(of))
        repeats = self.rows.select(["gram", "context"]).take(some).append_column("spans", spans.take(some))
        both = pa.concat_tables([repeats, open_], promote_options="default")
        return both.select(["gram", "context", "spans", "left", "bytes", "back", "low"])

    def by_what_stands_before(self, first: bool, last: bool) -> pa.Table:
        """Spans, and digests of the windows that reach an open end with this part too."""
        of, spans = self.spans()
        low = np.asarray(self.rows.column("low")).astype(np.int64)
        high = np.minimum(_shared(*self.befores, self.left, first, last), self.left)
        number = np.maximum(high - low + 1, 0)
        whose = np.repeat(np.arange(self.m), number)
        offset = np.arange(len(whose)) - np.repeat(np.cumsum(number) - number, number) + low[whose]
        once = self.found[whose, offset] < 2  # of windows that repeat here one stands for all
        whose, offset = whose[once], offset[once]
        digests = b"".join(hashlib.md5(self.data[i : i + LENGTH]).digest() for i in self.anchor[whose] - offset)
        digests = np.frombuffer(digests, "<i8").reshape(-1, 2)
        windows = _lists(whose, self.m, o=offset.astype(np.int32), h1=digests[:, 0].copy(), h2=digests[:, 1].copy(), alone=self.found[whose, offset] == 0)
        some = np.zeros(self.m, bool)
        some[of] = some[whose] = True
        out = pa.Table.from_arrays([self.rows.column("gram"), self.rows.column("context"), spans, windows], ["gram", "context", "spans", "windows"])
        return out.filter(pa.array(some))


def _buckets(answer):
    """A task's contexts, in order, as buckets to ``answer(bucket, first end open, last)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, True
        for batch in batches:
            for at in range(0, batch.num_rows, BUCKET):
                piece = pa.Table.from_batches([batch.slice(at, BUCKET)])
                held = piece if held is None else pa.concat_tables([held, piece])
                if held.num_rows >= BUCKET:
                    gram = np.asarray(held.column("gram"))
                    ends = np.flatnonzero(gram[1:] != gram[:-1]) + 1
                    cut = int(ends[-1]) if len(ends) else held.num_rows if held.num_rows >= MOST else 0
                    if cut:
                        yield from answer(_Bucket(held.slice(0, cut)), first, not len(ends)).combine_chunks().to_batches()
                        held, first = held.slice(cut), not len(ends)
        if held is not None and held.num_rows:
            yield from answer(_Bucket(held), first, True).combine_chunks().to_batches()

    return run


def _across(open_: DataFrame) -> DataFrame:
    """(gram, context, spans): windows that reach open ends on both sides, which one context
    of a bucket holds and another bucket has too.  They are few: their parts are those of
    the ends' own strings, and of windows known to repeat one stands for all."""
    windows = open_.select("gram", "context", F.inline("windows"))
    again = windows.groupBy("o", "h1", "h2").count().where("count > 1").drop("count")
    hit = windows.where("alone").join(again, ["o", "h1", "h2"], "left_semi")
    return hit.groupBy("gram", "context").agg(F.collect_list(F.struct((-F.col("o")).alias("a"), (F.lit(LENGTH) - F.col("o")).alias("b"))).alias("spans"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, text, spans) to what is left of the text."""
    for batch in batches:
        rows = []
        for k1, k2, text, spans in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text", "spans"))):
            raw = text.encode()
            gone = np.zeros(len(raw) + 1, np.int32)
            a, b = np.array([s["a"] for s in spans]), np.array([s["b"] for s in spans])
            np.add.at(gone, a, 1)
            np.add.at(gone, b, -1)
            gone = np.cumsum(gone[:-1]) > 0
            runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            rows.append((k1, k2, int(gone.sum()), runs, np.frombuffer(raw, np.uint8)[~gone].tobytes()))
        cols = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["k1", "k2", "n_removed", "n_spans", "kept"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, wanted: [gram, context, place]) to (gram, context, left, bytes)."""
    for batch in batches:
        rows = []
        for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
            raw = text.encode()
            for w in wanted:
                pos, right = w["place"] >> 8, w["place"] & 255
                left = min(pos, BEFORE)
                rows.append((w["gram"], w["context"], left, raw[pos - left : pos + right]))
        cols = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["gram", "context", "left", "bytes"])


def removal(docs: DataFrame) -> DataFrame:
    """(k1, k2, n_removed, n_spans, kept): per distinct text that loses bytes, what is left.

    ``k1``, ``k2`` are the key that :func:`keyed` gives a text.
    """
    keys = keyed(docs.select("text"))
    rows = keys.select("k1", "k2", "text").mapInArrow(_anchor_rows, "gram long, context long, k1 long, k2 int, place long, deal int")
    anchors = live_anchors(rows)
    classes = anchors.groupBy("gram", "context").agg((F.count("*") > 1).alias("again"), F.min(F.struct("k1", "k2", "place")).alias("one"))
    classes = staged(classes, "classes")
    mixed = classes.groupBy("gram").count().where("count > 1")
    wanted = classes.join(mixed, "gram").groupBy("one.k1", "one.k2").agg(F.collect_list(F.struct("gram", "context", "one.place")).alias("wanted"))
    texts = staged(keys.select("k1", "k2", "text").join(anchors.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]), "live-texts")
    contexts = texts.join(wanted, ["k1", "k2"]).select("text", "wanted").mapInArrow(_contexts, "gram long, context long, left int, bytes binary")
    contexts = staged(contexts, "contexts")
    lead = F.expr(f"substring(bytes, left + 1, {LENGTH})")
    ranged = contexts.withColumn("lead", lead).repartitionByRange("lead", "context").sortWithinPartitions("lead", "context")
    found = staged(ranged.select("gram", "context", "left", "bytes").mapInArrow(_buckets(_Bucket.by_suffix), _OPEN), "spans")
    again = found.where("low is not null").select("gram", "context", "left", "bytes", "low", "back")
    again = again.repartitionByRange("back", "context").sortWithinPartitions("back", "context").drop("back")
    more = staged(again.mapInArrow(_buckets(_Bucket.by_what_stands_before), _SPANS), "more-spans")
    spans = found.where("low is null").select("gram", "context", "spans").unionByName(more.select("gram", "context", "spans")).where("size(spans) > 0")
    spans = spans.unionByName(_across(more.where("size(windows) > 0")))
    left, right = F.least(F.expr("place div 256"), F.lit(BEFORE)), F.expr("place % 256")
    whole = F.array(F.struct((-left).cast("int").alias("a"), (F.lit(LENGTH) - F.greatest(F.lit(0), F.lit(LENGTH) - right)).cast("int").alias("b")))
    spans = spans.groupBy("gram", "context").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    answers = classes.select("gram", "context", F.col("again").alias("class_again")).join(spans, ["gram", "context"], "left")
    answers = staged(answers.where("class_again or spans is not null"), "answers")
    members = anchors.join(answers, ["gram", "context"])  # one join, so that Spark can split a common context
    fits = left >= F.greatest(F.lit(0), F.lit(LENGTH) - right)
    members = members.select("k1", "k2", F.expr("place div 256").alias("pos"), F.when(F.col("class_again") & fits, whole).otherwise(F.col("spans")).alias("spans")).where("spans is not null")
    cuts = members.groupBy("k1", "k2").agg(F.flatten(F.collect_list(F.transform("spans", lambda s: F.struct((F.col("pos") + s["a"]).alias("a"), (F.col("pos") + s["b"]).alias("b"))))).alias("spans"))
    return texts.join(cuts, ["k1", "k2"]).mapInArrow(_cut, "k1 long, k2 int, n_removed long, n_spans long, kept binary")


def live_anchors(rows: DataFrame) -> DataFrame:
    """Anchors whose gram another anchor has, by one shuffle by gram; the anchors of a
    common gram are spread over ``DEALS`` keys, being known to repeat."""
    number = F.count("*").over(Window.partitionBy("gram", "deal"))
    live = rows.withColumn("number", number).where("(number > 1 or deal > 0) and place >= 0")
    return staged(live.select("gram", "context", "k1", "k2", "place"), "anchors")


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with null texts emptied and a 96-bit key (k1, k2) of the text."""
    text = text_of()
    rest = [c for c in docs.columns if c != "text"]
    return docs.select(*rest, text.alias("text"), F.xxhash64(text).alias("k1"), F.hash(text).alias("k2"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs``."""
    keys = keyed(docs.select("doc_id", "text"))
    base = staged(keys.select("doc_id", "k1", "k2", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole")), "text-keys")
    copies = base.groupBy("k1", "k2").agg((F.count("*") > 1).alias("copied"))
    cut = staged(removal(docs).select("k1", "k2", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")), "cut-texts")
    per_text = copies.join(cut, ["k1", "k2"], "left")
    rows = base.join(per_text, ["k1", "k2"])
    all_gone = F.col("copied") & (F.col("n_bytes") >= LENGTH)
    return rows.select(
        "doc_id",
        "n_bytes",
        F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(all_gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
    )
