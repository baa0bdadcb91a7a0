"""Host-level quality rules, built of DataFrame functions alone.

Every document gets base counts from its whole text and a flag per rule.  Failures
are summed by host; a beta prior fitted to all hosts by moments shrinks each host's
failure rate, so a host of few documents is judged mostly by what hosts are like.  A
host whose shrunken rate of a rule exceeds that rule's limit is rejected, and the
verdict is joined back to its documents.

Defined cases: a null text has no words and fails ``short``; a null host is a host of
its own; repeated rows count as often as they occur; an empty table gives an empty
result; further columns are kept by :func:`keep_documents` and not read otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.shared import spaced, staged, text_of, whole_rows

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Highest shrunken failure rate of a host that keeps its documents, by rule.
LIMITS = {"base": 0.5, "symbols": 0.5, "dup_lines": 0.5, "word_length": 0.5}
#: Hosts up to this many are broadcast (under 16 MB); more are joined by a shuffle.
BROADCAST_HOSTS = 100_000
PREFIX = "_q_"


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column) -> Column:
    """Words that lie in an 8-word window found twice or more in the array.

    Windows are compared by 64-bit hashes, joined from the word hashes by doubling
    (1, 2, 4, 8 words); only texts with an equal pair go on to sort theirs.
    """

    def joined(h: Column, step: int) -> Column:
        return F.zip_with(h, F.slice(h, step + 1, F.greatest(F.size(h), F.lit(1))), lambda a, b: F.xxhash64(a, b))

    def covered(at: Column) -> Column:
        gaps = F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda s, x: s + x)

    def marked(s: Column) -> Column:
        twice = F.transform(s, lambda x, i: F.when((F.get(s, i + 1)["h"] == x["h"]) | (F.get(s, i - 1)["h"] == x["h"]), x["i"]))
        return _let(F.array_sort(F.array_compact(twice)), covered)

    def counted(h: Column) -> Column:
        spots = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), _let(spots, marked)).otherwise(F.lit(0))

    one = F.transform(words, lambda w: F.xxhash64(w))
    eight = _let(one, lambda a: _let(joined(a, 1), lambda b: _let(joined(b, 2), lambda c: joined(c, 4))))
    whole = F.slice(eight, 1, F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))
    return F.when(F.size(words) >= WINDOW + 1, _let(whole, counted)).otherwise(F.lit(0))


def _counts(text: Column) -> Column:
    """One-element array of the counts, for ``inline``: each is computed once."""
    unmarked = text
    for c in SYMBOLS:
        unmarked = F.replace(unmarked, F.lit(c), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def body(s: Column) -> Column:
        words = F.array_remove(F.split(s, " "), "")
        return _let(
            words,
            lambda w: _let(
                lines,
                lambda ln: F.struct(
                    F.size(w).cast("long").alias(PREFIX + "n_words"),
                    F.length(F.replace(s, F.lit(" "), F.lit(""))).cast("long").alias(PREFIX + "word_chars"),
                    (F.length(text) - F.length(unmarked)).cast("long").alias(PREFIX + "n_symbols"),
                    (F.size(ln) - F.size(F.array_distinct(ln))).cast("long").alias(PREFIX + "n_dup_lines"),
                    F.size(ln).cast("long").alias(PREFIX + "n_lines"),
                    _repeated(w).cast("long").alias(PREFIX + "n_repeat_words"),
                ),
            ),
        )

    return F.transform(F.array(spaced(text)), body)


def measured(docs: DataFrame, host: str = "source", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the counts and rule flags as ``_q_`` columns."""
    df = docs.select(*(docs.columns if keep is None else keep), F.col(host).alias(PREFIX + "host"), F.inline(_counts(text_of())))
    n = F.col(PREFIX + "n_words")
    return df.withColumns(
        {
            PREFIX + "fails_base": (n < 20) | (100 * F.col(PREFIX + "n_repeat_words") > 30 * n),
            PREFIX + "fails_symbols": 10 * F.col(PREFIX + "n_symbols") > n,
            PREFIX + "fails_dup_lines": 10 * F.col(PREFIX + "n_dup_lines") > 3 * F.col(PREFIX + "n_lines"),
            PREFIX + "fails_word_length": (F.col(PREFIX + "word_chars") < 2 * n) | (F.col(PREFIX + "word_chars") > 20 * n),
        }
    )


def host_verdicts(flags: DataFrame, limits: dict[str, float] = LIMITS) -> DataFrame:
    """(_q_host, _q_rate_<rule>..., _q_host_ok): shrunken failure rates and the verdict.

    The prior of a rule has the mean rate m of the hosts and the strength
    m(1-m)/v - 1, v being the variance of the rates between hosts, kept between 1
    and 1000 (where all hosts agree, or there is one, 1000 would hide a bad host's
    many documents no more than their number allows).
    """
    sums = flags.groupBy(PREFIX + "host").agg(F.count("*").alias("n"), *[F.sum(F.col(PREFIX + "fails_" + r).cast("long")).alias("f_" + r) for r in limits])
    sums = staged(sums, "host-sums")
    rate = {r: F.col("f_" + r) / F.col("n") for r in limits}
    prior = sums.agg(*[F.avg(x).alias("m_" + r) for r, x in rate.items()], *[F.var_pop(x).alias("v_" + r) for r, x in rate.items()]).first()
    shrunk, ok = [], F.lit(True)
    for r, limit in limits.items():
        m, v = prior["m_" + r] or 0.0, prior["v_" + r] or 0.0
        strength = min(1000.0, max(1.0, m * (1 - m) / v - 1)) if v > 0 else 1000.0
        post = (F.col("f_" + r) + F.lit(m * strength)) / (F.col("n") + F.lit(strength))
        shrunk.append(post.alias(PREFIX + "rate_" + r))
        ok = ok & (post <= F.lit(limit))
    return sums.select(F.col(PREFIX + "host"), *shrunk, ok.alias(PREFIX + "host_ok"))


def with_verdict(df: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Join host verdicts to rows with ``_q_host``; broadcast only behind a count."""
    right = verdicts.withColumnRenamed(PREFIX + "host", PREFIX + "host_key")
    if verdicts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        right = F.broadcast(right)
    df = df.join(right, F.col(PREFIX + "host").eqNullSafe(F.col(PREFIX + "host_key")), "left")
    return df.withColumn(PREFIX + "kept", ~F.col(PREFIX + "fails_base") & F.col(PREFIX + "host_ok"))


def judge(docs: DataFrame, host: str = "source", key: str = "doc_id") -> DataFrame:
    """Counts, flags, host rates and ``_q_kept`` for every document (texts left out)."""
    flags = staged(measured(docs, host, [key]), "quality")
    return with_verdict(flags, host_verdicts(flags))


def keep_documents(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns.

    The counts are worked out once for the hosts and once more with the rows, which
    costs less than writing or shuffling the texts.
    """
    verdicts = host_verdicts(staged(measured(docs, host, []), "quality"))
    rows = whole_rows(docs, host=F.col(host), text=text_of())
    return with_verdict(measured(rows, "host", ["row"]), verdicts).where(PREFIX + "kept").select("row.*")
