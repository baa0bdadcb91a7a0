"""Registered queries over the given tables, each beside its SQL.

Memories, facts, corpus and ranked lists are derived from the tables by ``BASE``, SQL
that Spark and the oracle both understand; every query then applies the package's
operators to them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions import chunking, lexicons, stems
from larkspur.functions import text as X
from larkspur.operators import batches, catalog, composites, evaluation, fact_store, fusion, ingest, knowledge, lexical, memory, text_index, vectors
from larkspur.sources import formats
from larkspur.sources.staged import fresh, spread
from larkspur.streaming import access

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
NOW = 1_706_745_600_000

BASE = {
    "memories": """SELECT conv_id * 1000 + turn AS id, text, role, conv_id % 20 AS scope, (conv_id * 7 + turn * 3) % 11 / 10e0 AS importance,
      (conv_id + turn * 5) % 13 * ((conv_id + turn) % 2) AS access_count, 1704067200000 + (conv_id * 37 % 30) * 86400000 - (conv_id % 4) * 1296000000 + turn * 3600000 AS created_at,
      CASE WHEN (conv_id + turn * 5) % 13 * ((conv_id + turn) % 2) = 0 THEN NULL ELSE 1704067200000 + (conv_id * 37 % 30) * 86400000 - (conv_id % 4) * 1296000000 + turn * 3600000 + (conv_id + turn * 5) % 13 * ((conv_id + turn) % 2) * 43200000 END AS last_accessed,
      CASE conv_id % 3 WHEN 0 THEN 'core' WHEN 1 THEN 'working' ELSE 'peripheral' END AS tier,
      CASE (conv_id + turn) % 6 WHEN 0 THEN 'fact' WHEN 1 THEN 'decision' WHEN 2 THEN 'entity' WHEN 3 THEN 'preference' WHEN 4 THEN 'reflection' ELSE 'other' END AS category
      FROM {conversations}""",
    "facts": """SELECT o_orderkey AS id, c_name AS subject, 'Priority' AS predicate, o_orderpriority AS object, o_orderdate AS valid_from, o_orderdate AS ingested
      FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "corpus": """SELECT doc_id, source AS collection, concat(lang, '/', CAST(doc_id AS VARCHAR(20)), '.md') AS path, text AS body, doc_id % 7 <> 0 AS active FROM {documents}""",
    "code_files": """SELECT doc_id, concat('src/', id, CASE k WHEN 0 THEN '.ts' WHEN 1 THEN '.py' WHEN 2 THEN '.go' WHEN 3 THEN '.rs' WHEN 4 THEN '.js' ELSE '.txt' END) AS path, k, head, first, second, concat(head, first, second) AS body FROM (
      SELECT doc_id, k, id, CASE k WHEN 0 THEN concat('/* ', t, ' */', nl) WHEN 1 THEN concat(q, q, q, t, q, q, q, nl) WHEN 2 THEN concat('package main', nl, nl, 'var text = `', t, '`', nl)
        WHEN 3 THEN concat('/* /* ', t, ' */ {{ */', nl) WHEN 4 THEN concat('const text = `', t, '$', '{{ [1].map((x) => x) }}`;', nl) ELSE concat('class A {{ }} ', t, nl) END AS head,
      CASE k WHEN 0 THEN concat('export async function load', id, '(a: {{ b: string }}) {{', nl, '  return `', t, '`;', nl, '}}', nl)
        WHEN 1 THEN concat('@cached(key=(1,', nl, '  2))', nl, 'class C', id, ':', nl, '    note = ', q, q, q, t, q, q, q, nl)
        WHEN 2 THEN concat('func (c *C', id, ') Run(a int) error {{', nl, '  /* ', t, ' */', nl, '  return nil', nl, '}}', nl)
        WHEN 3 THEN concat('#[derive(Debug)] pub struct S', id, ';', nl)
        WHEN 4 THEN concat('class C', id, ' {{', nl, '  static async run(a) {{', nl, '    return 1 /* ', t, ' */', nl, '  }}', nl, '}}', nl) ELSE 'def a(): pass' END AS first,
      CASE k WHEN 0 THEN concat('interface I', id, ' {{ text: string; run(): void }}', nl) WHEN 1 THEN concat('    async def run(self): pass', nl) WHEN 2 THEN concat('type T', id, ' struct {{ A int }}', nl)
        WHEN 3 THEN concat('impl S', id, ' {{', nl, '    fn run(&self) {{ let t = r#', q, t, q, '#; }}', nl, '}}', nl) WHEN 4 THEN concat('const f', id, ' = async (a) => {{ /* ', t, ' */ }};', nl) ELSE '' END AS second
      FROM (SELECT doc_id, doc_id % 6 AS k, CAST(doc_id AS VARCHAR(20)) AS id, chr(10) AS nl, chr(34) AS q, translate(coalesce(text, ''), concat('*/`$', chr(34), chr(39), chr(92)), '') AS t FROM {documents}) raw) parts""",
    "phrases": """SELECT item_id AS query_id, text FROM {benchmark}""",
    "lists": """SELECT item_id AS query_id, list_no, (item_id * 13 + list_no * 7 + n * 5) % 40 AS id, n + 1 AS rank
      FROM {benchmark}, (SELECT CAST(o_orderkey % 3 AS INT) AS list_no, CAST(o_orderkey % 8 AS INT) AS n FROM {orders} GROUP BY 1, 2) t WHERE NOT (item_id % 5 = 0 AND list_no = 0)""",
    "said": """SELECT c_custkey AS id, concat(CASE c_custkey % 6 WHEN 0 THEN 'I prefer ' WHEN 1 THEN 'We decided to go with ' WHEN 2 THEN 'Looking back, I realized ' WHEN 3 THEN 'It turns out ' WHEN 4 THEN 'Alice Smith said ' ELSE 'Nothing about ' END,
      lower(c_mktsegment), ' products. ', c_name, ' will buy it ', CAST(c_custkey % 9 AS VARCHAR(9)), CASE c_custkey % 4 WHEN 0 THEN ' days ago' WHEN 1 THEN ' weeks ago' WHEN 2 THEN ' months ago' ELSE ', maybe yesterday' END) AS text FROM {customer}""",
}
_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in BASE:
        used = {t: load(spark, sf_dir, t) for t in _TABLES if f"{{{t}}}" in BASE[name]}
        return spark.sql(BASE[name], **used)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None, *tables: str):
    """Register a function of the named tables; ``sql`` may name derived ones too."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*(load(spark, sf_dir, t) for t in tables))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            views = ", ".join(f"{n} AS ({s.format(**{t: t for t in _TABLES})})" for n, s in BASE.items() if n in sql)
            body = sql.strip()
            if views:
                head = next((h for h in ("WITH RECURSIVE ", "WITH ") if body.upper().startswith(h)), "")
                body = f"{head or 'WITH '}{views}{',' if head else ''} {body[len(head):]}"
            ORACLE_SQL[f.__name__] = body
        return f

    return register


def _r(*columns: str):
    return [F.round(c, 6).alias(c) for c in columns]


# Lexical search --------------------------------------------------------------------

_TOKENS = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}]+')"
_STEM = r"regexp_replace(path, '^.*/|\.md$', '', 'g')"
_BM25 = rf"""
d AS (SELECT doc_id, {_TOKENS.format("path")} AS a, {_TOKENS.format(_STEM)} AS b, {_TOKENS.format("body")} AS c FROM corpus),
sizes AS (SELECT doc_id, len(a) + len(b) + len(c) AS dl FROM d),
tok AS (SELECT doc_id, unnest(a) AS term, 1.5 AS w FROM d UNION ALL SELECT doc_id, unnest(b), 4.0 FROM d UNION ALL SELECT doc_id, unnest(c), 1.0 FROM d),
post AS (SELECT doc_id, term, sum(w)::DOUBLE AS tf FROM tok GROUP BY 1, 2),
df AS (SELECT term, count(*) AS n FROM post GROUP BY 1),
st AS (SELECT count(*) AS total, avg(dl) AS avgdl FROM sizes),
idf AS (SELECT term, CASE WHEN ln((total - n + 0.5) / (n + 0.5)) > 0 THEN ln((total - n + 0.5) / (n + 0.5)) ELSE 1e-6 END AS idf, avgdl FROM df, st),
raw AS (SELECT query_id, doc_id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS raw, count(*) AS held FROM q JOIN post USING (term) JOIN idf USING (term) JOIN sizes USING (doc_id) GROUP BY 1, 2)"""
_TOP = "SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ({0})) WHERE rank <= {1}"


def _titled(corpus: DataFrame) -> DataFrame:
    return corpus.withColumn("title", X.title(F.col("body"), F.col("path")))


def _searched(docs: DataFrame, terms: DataFrame, k: int, **more) -> DataFrame:
    """Answers from the stored index of ``docs``, which is written once in an application."""
    return text_index.search(docs.sparkSession, text_index.of_table(docs), terms, k, **more).select("query_id", "doc_id", "score", "rank")


def _terms(phrases: DataFrame, n: int) -> DataFrame:
    return phrases.select("query_id", F.explode(F.slice(X.tokens(F.col("text")), 1, n)).alias("term"))


@query(f"WITH q AS (SELECT DISTINCT query_id, unnest(list_slice({_TOKENS.format('text')}, 1, 8)) AS term FROM phrases), {_BM25} " + _TOP.format("SELECT query_id, doc_id, round(raw / (1 + raw), 6) AS score FROM raw", 10), "corpus", "phrases")
def bm25_topk(corpus, phrases):
    """Ten best documents by any of a query's first eight terms."""
    return lexical.top(lexical.bm25(_titled(corpus), _terms(phrases, 8)), 10)


@query(f"WITH q AS (SELECT DISTINCT query_id, unnest(list_slice({_TOKENS.format('text')}, 1, 3)) AS term FROM phrases), {_BM25}, asked AS (SELECT query_id, count(*) AS asked FROM q GROUP BY 1) " + _TOP.format("SELECT query_id, doc_id, round(raw / (1 + raw), 6) AS score FROM raw JOIN asked USING (query_id) WHERE held = asked", 10), "corpus", "phrases")
def bm25_all_terms(corpus, phrases):
    """As bm25_topk, of the documents that hold every one of three terms."""
    return lexical.top(lexical.bm25(_titled(corpus), _terms(phrases, 3), match_all=True), 10)


@query(f"WITH q AS (SELECT DISTINCT query_id, unnest(list_slice({_TOKENS.format('text')}, 1, 4)) AS term FROM phrases), {_BM25}, neg AS (SELECT query_id, list_extract({_TOKENS.format('text')}, 5) AS term FROM phrases) " + _TOP.format("SELECT query_id, doc_id, round(raw / (1 + raw), 6) AS score FROM raw WHERE NOT EXISTS (SELECT 1 FROM neg JOIN post USING (term) WHERE neg.query_id = raw.query_id AND post.doc_id = raw.doc_id)", 10), "corpus", "phrases")
def bm25_negation(corpus, phrases):
    """Documents with any of four terms but without the fifth."""
    without = phrases.select("query_id", F.get(X.tokens(F.col("text")), 4).alias("term")).where("term is not null")
    return lexical.top(lexical.bm25(_titled(corpus), _terms(phrases, 4), barred=without), 10)


@query(rf"WITH q AS (SELECT query_id, list_slice({_TOKENS.format('text')}, 1, 4) AS t FROM phrases), d AS (SELECT doc_id, {_TOKENS.format('body')} AS c FROM corpus), s AS (SELECT query_id, doc_id, t, c, unnest(range(1, len(c) - 2)) AS i FROM q JOIN d ON list_contains(c, t[1]) AND list_contains(c, t[4])) SELECT query_id, doc_id, count(*) AS n FROM s WHERE c[i] = t[1] AND c[i + 1] = t[2] AND c[i + 2] = t[3] AND c[i + 3] = t[4] GROUP BY 1, 2", "corpus", "phrases")
def phrase_match(corpus, phrases):
    """How often a document holds a query's first four tokens in a row."""
    docs = _titled(corpus)
    asked = phrases.select("query_id", F.slice(X.tokens(F.col("text")), 1, 4).alias("tokens"))
    return text_index.phrase_hits(docs.sparkSession, text_index.of_table(docs), asked, list(lexical.FIELD_WEIGHTS).index("body"))


@query(rf"WITH q AS (SELECT DISTINCT query_id, list_extract({_TOKENS.format('text')}, 1) AS prefix FROM phrases), v AS (SELECT DISTINCT unnest({_TOKENS.format('body')}) AS term FROM corpus) SELECT query_id, prefix, count(*) AS terms FROM q JOIN v ON starts_with(term, prefix) GROUP BY 1, 2", "corpus", "phrases")
def prefix_terms(corpus, phrases):
    """Vocabulary terms that a query's first token is a prefix of."""
    first = phrases.select("query_id", F.get(X.tokens(F.col("text")), 0).alias("prefix"))
    return lexical.expand_prefixes(corpus, first, ("body",)).groupBy("query_id", "prefix").agg(F.count("*").alias("terms"))


@query(f"WITH q AS (SELECT 1 AS query_id, '' AS term), {_BM25} SELECT term, count(*) AS documents, sum(tf)::DOUBLE AS weight FROM post GROUP BY 1", "corpus")
def stored_terms(corpus):
    """Every term of a stored index, which is written for this alone."""
    docs, path = _titled(corpus), fresh(corpus.sparkSession, "text-index")
    text_index.upsert(docs, path)
    rows = text_index.postings(docs.sparkSession, path)
    return rows.where("term <> ''").groupBy("term").agg(F.count("*").alias("documents"), F.sum("tf").alias("weight"))


@query(f"WITH q AS (SELECT DISTINCT query_id, unnest({_TOKENS.format('text')}) AS term FROM phrases), corpus_now AS (SELECT doc_id, path, CASE WHEN doc_id % 3 = 0 THEN concat(body, ' ', reverse(body)) ELSE body END AS body FROM corpus WHERE doc_id % 5 <> 1), {_BM25.replace('FROM corpus)', 'FROM corpus_now)')} " + _TOP.format("SELECT query_id, doc_id, round(raw / (1 + raw), 6) AS score FROM raw", 10), "corpus", "phrases")
def search_after_upkeep(corpus, phrases):
    """The stored index after an upsert of every third document and a deletion of every fifth."""
    spark, path = corpus.sparkSession, fresh(corpus.sparkSession, "text-index")
    text_index.upsert(_titled(corpus), path)
    longer = corpus.where("doc_id % 3 = 0").withColumn("body", F.concat("body", F.lit(" "), F.reverse("body")))
    text_index.upsert(_titled(longer), path)
    text_index.delete(corpus.where("doc_id % 5 = 1"), path)
    return text_index.search(spark, path, _whole(phrases), 10).select("query_id", "doc_id", "score", "rank")


_MEM_TOKENS = _TOKENS.format("x")
_STOP = "(" + ", ".join(f"'{w}'" for w in lexicons.MEMORY_STOP) + ")"


@query(rf"""WITH q AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest(list_slice({_TOKENS.format('text')}, 1, 10)) AS term FROM phrases) WHERE length(term) >= 2 AND term NOT IN {_STOP}),
d AS (SELECT id AS doc_id, {_TOKENS.format('text')} AS a, {_TOKENS.format('category')} AS b FROM memories), sizes AS (SELECT doc_id, len(a) + len(b) AS dl FROM d),
tok AS (SELECT doc_id, unnest(a) AS term FROM d UNION ALL SELECT doc_id, unnest(b) FROM d), post AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM tok GROUP BY 1, 2),
df AS (SELECT term, count(*) AS n FROM post GROUP BY 1), st AS (SELECT count(*) AS total, avg(dl) AS avgdl FROM sizes),
idf AS (SELECT term, CASE WHEN ln((total - n + 0.5) / (n + 0.5)) > 0 THEN ln((total - n + 0.5) / (n + 0.5)) ELSE 1e-6 END AS idf, avgdl FROM df, st),
raw AS (SELECT query_id, doc_id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS raw FROM q JOIN post USING (term) JOIN idf USING (term) JOIN sizes USING (doc_id) GROUP BY 1, 2)
SELECT query_id, doc_id AS id, score, rank FROM (SELECT query_id, doc_id, round(raw / (1 + raw), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(raw / (1 + raw), 6) DESC, doc_id) AS rank FROM raw) WHERE rank <= 10""", "memories", "phrases")
def memory_or_search(memories, phrases):
    """Memories by any query term that is no stop word, over text and category."""
    terms = _terms(phrases, 10).where((F.length("term") >= 2) & ~F.col("term").isin(*lexicons.MEMORY_STOP))
    return lexical.top(lexical.bm25(memories, terms, {"text": 1.0, "category": 1.0}, "id"), 10, "id")


@query(rf"""WITH q AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest({_TOKENS.format('text')}) AS term FROM phrases) WHERE length(term) >= 2 AND term NOT IN {_STOP}),
d AS (SELECT id AS doc_id, {_TOKENS.format('text')} AS a, {_TOKENS.format('category')} AS b FROM memories), sizes AS (SELECT doc_id, len(a) + len(b) AS dl FROM d),
tok AS (SELECT doc_id, unnest(a) AS term FROM d UNION ALL SELECT doc_id, unnest(b) FROM d), post AS (SELECT doc_id, prefix AS term, count(*)::DOUBLE AS tf FROM tok JOIN (SELECT DISTINCT term AS prefix FROM q) ON starts_with(term, prefix) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS n FROM post GROUP BY 1), st AS (SELECT count(*) AS total, avg(dl) AS avgdl FROM sizes),
idf AS (SELECT term, CASE WHEN ln((total - n + 0.5) / (n + 0.5)) > 0 THEN ln((total - n + 0.5) / (n + 0.5)) ELSE 1e-6 END AS idf, avgdl FROM df, st),
raw AS (SELECT query_id, doc_id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS raw FROM q JOIN post USING (term) JOIN idf USING (term) JOIN sizes USING (doc_id) GROUP BY 1, 2),
t AS (SELECT query_id, doc_id AS id, round(raw / (1 + raw), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(raw / (1 + raw), 6) DESC, doc_id) AS n FROM raw)
SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM t JOIN memories USING (id) WHERE n <= 100 AND (scope = query_id % 20 OR scope = 0)) WHERE rank <= 10""", "memories", "phrases")
def memory_prefix_search(memories, phrases):
    """Memories of the query's scope or the shared one by words that begin with any of its
    terms, out of ten times as many over all scopes."""
    terms = _whole(phrases).where((F.length("term") >= 2) & ~F.col("term").isin(*lexicons.MEMORY_STOP))
    found = lexical.top(lexical.bm25(memories, terms, {"text": 1.0, "category": 1.0}, "id", prefixes=True), 100, "id").drop("rank")
    own = found.join(memories.select("id", "scope"), "id").where((F.col("scope") == F.col("query_id") % 20) | (F.col("scope") == 0))
    return lexical.top(own.select("query_id", "id", "score"), 10, "id")


# Vectors ---------------------------------------------------------------------------

_COS = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"
_KNN = f"SELECT a.vec_id AS query_id, b.vec_id AS id, a.label AS scope_a, b.label AS scope_b, {_COS} AS similarity FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0"
_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank"


def _asked(embeddings):
    return embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("scope"))


def _stored(embeddings):
    return embeddings.select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("scope"))


@query(f"SELECT * FROM (SELECT query_id, id, similarity, {_RANK} FROM ({_KNN})) WHERE rank <= 10", "embeddings")
def knn_cosine_topk(embeddings):
    return vectors.nearest(_asked(embeddings), _stored(embeddings), 10)


@query(f"SELECT * FROM (SELECT query_id, id, similarity, {_RANK} FROM ({_KNN}) WHERE scope_a = scope_b) WHERE rank <= 6", "embeddings")
def knn_scoped_quota(embeddings):
    """Nearest vectors of the query's own scope."""
    return vectors.nearest(_asked(embeddings), _stored(embeddings), 6, scoped=True)


@query(f"WITH n AS (SELECT * FROM (SELECT query_id, id, similarity, {_RANK} FROM ({_KNN})) WHERE rank <= 30) SELECT query_id, id, similarity, rank FROM (SELECT *, max(similarity) OVER (PARTITION BY query_id) AS best FROM n) WHERE rank <= 5 OR similarity >= greatest(0.05, 0.5 * best)", "embeddings")
def acceptance_floor(embeddings):
    return vectors.accepted(vectors.nearest(_asked(embeddings), _stored(embeddings), 30))


@query(f"SELECT (query_id // 200)::BIGINT AS query_id, id, max(similarity) AS similarity FROM (SELECT query_id, id, similarity, {_RANK} FROM ({_KNN})) WHERE rank <= 10 GROUP BY 1, 2", "embeddings")
def subquery_max_merge(embeddings):
    near = vectors.nearest(_asked(embeddings), _stored(embeddings), 10)
    return vectors.merged(near.withColumn("query_id", F.floor(F.col("query_id") / 200)))


@query(f"WITH k AS (SELECT *, {_RANK} FROM ({_KNN})), s AS (SELECT query_id, doc_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS place FROM (SELECT query_id, id // 4 AS doc_id, max(similarity) AS similarity FROM k WHERE rank <= 30 GROUP BY 1, 2)) WHERE place <= 10), f AS (SELECT (query_id // 300)::BIGINT AS query_id, doc_id, max(similarity) AS similarity FROM s WHERE similarity >= 0.3 GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS rank FROM f) WHERE rank <= 10", "embeddings")
def subquery_best_files(embeddings):
    """Three sub-queries a query, each searched by chunks; files over a floor, once each."""
    chunks = embeddings.select(F.col("vec_id").alias("id"), F.expr("vec_id div 4").alias("doc_id"), (F.col("vec_id") % 4).alias("seq"), "embedding")
    near = vectors.nearest_documents(_asked(embeddings), chunks, chunks.select("doc_id", F.lit(True).alias("active")).distinct(), 10)
    return vectors.best_files(near.withColumn("query_id", F.expr("query_id div 300")))


@query(f"WITH n AS (SELECT * FROM (SELECT query_id, id, scope_b AS scope, similarity, {_RANK} FROM ({_KNN})) WHERE rank <= 20), c AS (SELECT query_id, count(DISTINCT scope) AS n FROM n GROUP BY 1) SELECT query_id, id, scope, CASE WHEN c.n > 1 THEN round(1.0 / (59 + row_number() OVER (PARTITION BY query_id, scope ORDER BY similarity DESC, id)), 6) ELSE similarity END::DOUBLE AS similarity FROM n JOIN c USING (query_id)", "embeddings")
def scope_rank_norm(embeddings):
    near = vectors.nearest(_asked(embeddings), _stored(embeddings), 20).join(_stored(embeddings).select("id", "scope"), "id")
    return vectors.scope_normalised(near).select("query_id", "id", "scope", "similarity")


@query(f"SELECT query_id, id, similarity FROM (SELECT query_id, id, similarity, {_RANK} FROM ({_KNN}) WHERE id % 100 <> 0 AND similarity >= 0.3) WHERE rank = 1", "embeddings")
def near_dup_cosine(embeddings):
    """The nearest stored vector at or over 0.3 of every new one."""
    return vectors.duplicate_probe(_asked(embeddings), _stored(embeddings).where("id % 100 <> 0"), 0.3)


@query(f"SELECT query_id, id, similarity FROM (SELECT query_id, id, similarity, {_RANK} FROM ({_KNN}) WHERE id <> query_id AND similarity >= 0.3) WHERE rank = 1", "embeddings")
def near_dup_cosine_all(embeddings):
    """As near_dup_cosine, against all other vectors, the other queries' too."""
    return vectors.duplicate_probe(_asked(embeddings), _stored(embeddings), 0.3, stored=True)


# Fusion ----------------------------------------------------------------------------

_W = "CASE WHEN dense_rank() OVER (PARTITION BY query_id ORDER BY list_no) <= 2 THEN 2.0 ELSE 1.0 END"
_BONUS = "CASE WHEN min(rank) = 1 THEN 0.05 WHEN min(rank) <= 3 THEN 0.02 ELSE 0.0 END"
_FUSED = f"WITH w AS (SELECT *, {_W} AS weight FROM lists), f AS (SELECT query_id, id, sum(weight / (60 + rank)) AS base, min(rank) AS top_rank, {_BONUS} AS bonus, count(*) AS n, string_agg(list_no || ':' || rank, ' ' ORDER BY list_no, rank) AS parts FROM w GROUP BY 1, 2)"


@query(f"{_FUSED} SELECT query_id, id, top_rank, round(base, 6)::DOUBLE AS base, bonus::DOUBLE AS bonus, round(base + bonus, 6)::DOUBLE AS score FROM f", "lists")
def rrf_fuse(lists):
    return fusion.fuse(fusion.weigh_lists(lists)).select("query_id", "id", "top_rank", *_r("base", "bonus", "score"))


@query(f"{_FUSED} SELECT query_id, id, round(base + bonus, 6)::DOUBLE AS score, parts FROM f", "lists")
def rrf_trace(lists):
    parts = F.array_join(F.transform("contributions", lambda c: F.concat_ws(":", c["list_no"].cast("string"), c["rank"].cast("string"))), " ")
    return fusion.trace(fusion.weigh_lists(lists)).select("query_id", "id", *_r("score"), parts.alias("parts"))


@query("SELECT query_id, id, round(sum(CASE list_no WHEN 0 THEN 0.8 WHEN 1 THEN 0.2 ELSE 0.1 END / (60 + rank)), 6)::DOUBLE AS score FROM lists GROUP BY 1, 2", "lists")
def memory_rrf(lists):
    return fusion.memory_fuse(*(lists.where(F.col("list_no") == i) for i in range(3))).select("query_id", "id", *_r("score"))


@query(f"{_FUSED}, r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(base + bonus, 6) DESC, id) AS rank FROM f) SELECT query_id, id, rank, round(CASE WHEN rank <= 3 THEN 0.75 WHEN rank <= 10 THEN 0.6 ELSE 0.4 END / rank + (1 - CASE WHEN rank <= 3 THEN 0.75 WHEN rank <= 10 THEN 0.6 ELSE 0.4 END) * (id / 40.0), 6)::DOUBLE AS score FROM r", "lists")
def position_blend(lists):
    fused = fusion.fuse(fusion.weigh_lists(lists)).select("query_id", "id", *_r("score"))
    ranked = lexical.top(fused, 1 << 30, "id")
    return ranked.select("query_id", "id", "rank", F.round(fusion.position_blend(F.col("rank"), F.col("id") / 40), 6).alias("score"))


@query(f"{_FUSED}, m AS (SELECT query_id, id, base + bonus AS s, min(base + bonus) OVER (PARTITION BY query_id) AS lo, max(base + bonus) OVER (PARTITION BY query_id) AS hi FROM f) SELECT query_id, id, round(0.5 * CASE WHEN hi = lo THEN 0.5 ELSE (s - lo) / (hi - lo) END + 0.5 * (id / 40.0), 5)::DOUBLE AS score FROM m", "lists")
def minmax_rerank_blend(lists):
    fused = fusion.fuse(fusion.weigh_lists(lists))
    return fused.withColumn("s", fusion.minmax(F.col("score"))).select("query_id", "id", F.round(0.5 * F.col("s") + 0.5 * (F.col("id") / 40), 5).alias("score"))


@query("WITH s AS (SELECT query_id, id, id / 40e0 AS score, row_number() OVER (PARTITION BY query_id ORDER BY id DESC) AS n FROM (SELECT DISTINCT query_id, id FROM lists)) SELECT query_id, round(max(score), 6) AS top, round(max(score) - coalesce(max(CASE WHEN n = 2 THEN score END), 0), 6) AS gap, max(score) >= 0.85 AND max(score) - coalesce(max(CASE WHEN n = 2 THEN score END), 0) >= 0.15 AS strong FROM s GROUP BY 1", "lists")
def strong_signal(lists):
    return fusion.strong_signal(lists.select("query_id", "id").distinct().withColumn("score", F.col("id") / 40))


@query("WITH r AS (SELECT query_id, id, min(rank) AS rank, CASE WHEN id % 6 = 0 THEN NULL ELSE id % 6 END AS dialog FROM lists GROUP BY 1, 2), s AS (SELECT *, CASE WHEN dialog IS NULL THEN 0 ELSE (row_number() OVER (PARTITION BY query_id, dialog ORDER BY rank, id) > 1)::INT END AS again FROM r) SELECT query_id, id, rank, dialog, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY again, rank, id) AS place FROM s) WHERE place <= 8", "lists")
def dialog_diversity(lists):
    ranked = lists.groupBy("query_id", "id").agg(F.min("rank").alias("rank")).withColumn("dialog", F.nullif(F.col("id") % 6, F.lit(0)))
    return fusion.diverse(ranked, "dialog", 8).select("query_id", "id", "rank", "dialog", "place")


def _in(words):
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_BOOST_W = f"list_distinct(list_filter(regexp_split_to_array(lower(q.text), '\\s+'), lambda w: length(w) > 2 AND w NOT IN {_in(lexicons.BOOST_STOP)}))"


@query(f"WITH q AS (SELECT query_id, 'What did Customer say about \"' || text || '\"' AS text FROM (SELECT query_id, substr(text, 1, 40) AS text FROM phrases) WHERE query_id % 4 = 0), p AS (SELECT query_id, doc_id, body, {_BOOST_W} AS w, lower(q.text) AS low FROM q, corpus) SELECT query_id, doc_id, round(1 + 0.3 * (len(list_filter(w, lambda x: contains(lower(body), x)))::DOUBLE / len(w)), 6) AS keyword, CASE WHEN contains(lower(body), low[30:-2]) AND length(low[30:-2]) >= 3 THEN 1.6 ELSE 1.0 END::DOUBLE AS phrase FROM p WHERE doc_id % 10 = query_id % 10", "phrases", "corpus")
def search_boosts(phrases, corpus):
    """Keyword and quoted-phrase boosts of candidate documents."""
    asked = phrases.where("query_id % 4 = 0").select("query_id", F.concat(F.lit('What did Customer say about "'), F.substring("text", 1, 40), F.lit('"')).alias("q"), (F.col("query_id") % 10).alias("k"))
    rows = corpus.withColumn("k", F.col("doc_id") % 10).join(asked, "k")
    return rows.select("query_id", "doc_id", F.round(X.keyword_boost(F.col("q"), F.col("body")), 6).alias("keyword"), X.phrase_boost(F.col("q"), F.col("body")).alias("phrase"))


@query(f"WITH q AS (SELECT query_id, 'What did Customer say about \"' || text || '\"' AS text FROM phrases), p AS (SELECT query_id, doc_id, lower(body) AS low, {_BOOST_W} AS w, regexp_extract_all(lower(q.text), '[\"'']([^\"'']{{3,}})[\"'']', 1) AS ph FROM ({ORACLE_SQL['bm25_topk']}) JOIN q USING (query_id) JOIN corpus USING (doc_id)) SELECT query_id, doc_id, CASE WHEN len(w) = 0 THEN 1.0 ELSE round(1 + 0.3 * (len(list_filter(w, lambda x: contains(low, x)))::DOUBLE / len(w)), 6) END::DOUBLE AS keyword, CASE WHEN len(list_filter(ph, lambda x: contains(low, x))) > 0 THEN 1.6 ELSE 1.0 END::DOUBLE AS phrase FROM p", "corpus", "phrases")
def search_boosts_hits(corpus, phrases):
    """As search_boosts, of the hits of bm25_topk for every whole query."""
    asked = phrases.select("query_id", F.concat(F.lit('What did Customer say about "'), "text", F.lit('"')).alias("q"))
    rows = bm25_topk(corpus, phrases).join(corpus.select("doc_id", "body"), "doc_id").join(asked, "query_id")
    return rows.select("query_id", "doc_id", F.round(X.keyword_boost(F.col("q"), F.col("body")), 6).alias("keyword"), X.phrase_boost(F.col("q"), F.col("body")).alias("phrase"))


# Memory lifecycle ------------------------------------------------------------------

_DAYS = f"greatest(0, ({NOW} - coalesce(last_accessed, created_at)) / 86400000.0)"
_T = "CASE tier WHEN 'core' THEN {0} WHEN 'working' THEN {1} WHEN 'peripheral' THEN {2} ELSE {3} END"
_IMP = "greatest(0, least(1, importance))"
_REC = f"exp(-ln(2) / (({_T.format(90.0, 30.0, 14.0, 14.0)}) * exp(1.5 * importance)) * pow({_DAYS}, {_T.format(0.8, 1.0, 1.3, 1.0)}))"
_SCORE = f"greatest(0.4 * {_REC} + 0.3 * (1 - exp(-access_count / 5.0)) + 0.3 * {_IMP}, ({_T.format(0.9, 0.7, 0.5, 0.0)}) * {_IMP})"
_NEXT = "CASE WHEN tier = 'peripheral' AND access_count >= 3 AND score >= 0.4 THEN 'working' WHEN tier = 'working' AND access_count >= 10 AND score >= 0.7 AND importance >= 0.8 THEN 'core' WHEN tier = 'working' AND score < 0.15 THEN 'peripheral' WHEN tier = 'core' AND score < 0.15 AND access_count < 3 THEN 'working' ELSE tier END"
_LEVEL = "CASE {0} WHEN 'core' THEN 2 WHEN 'working' THEN 1 ELSE 0 END"


@query(f"SELECT id, tier, round(score, 6)::DOUBLE AS score, {_NEXT} AS new_tier FROM (SELECT *, {_SCORE} AS score FROM memories)", "memories")
def decay_scores(memories):
    return memory.decayed(memories, NOW).select("id", "tier", *_r("score"), "new_tier")


_ODD = "SELECT * REPLACE (CASE WHEN id % 3 = 0 THEN 'archive' ELSE tier END AS tier, importance * 2 - 0.4 AS importance) FROM memories"


@query(f"SELECT id, tier, round(score, 6)::DOUBLE AS score FROM (SELECT *, {_SCORE} AS score FROM ({_ODD}))", "memories")
def decay_scores_odd(memories):
    """Decay of tiers without fixed values and of importance outside 0 to 1."""
    odd = memories.withColumn("tier", F.when(F.col("id") % 3 == 0, "archive").otherwise(F.col("tier"))).withColumn("importance", F.col("importance") * 2 - 0.4)
    return memory.decayed(odd, NOW).select("id", "tier", *_r("score"))


@query(f"WITH s AS (SELECT *, {_SCORE} AS score FROM memories), n AS (SELECT *, {_NEXT} AS new_tier FROM s) SELECT count(*) AS processed, sum(({_LEVEL.format('new_tier')} > {_LEVEL.format('tier')})::INT)::BIGINT AS promoted, sum(({_LEVEL.format('new_tier')} < {_LEVEL.format('tier')})::INT)::BIGINT AS demoted, sum((score < 0.3)::INT)::BIGINT AS stale FROM n", "memories")
def tier_transitions(memories):
    return memory.decay_report(memories, NOW)


@query(f"SELECT id, tier, category, importance FROM (SELECT *, {_SCORE} AS score FROM memories) WHERE {NOW} - created_at > 30 * 86400000.0 AND importance < 0.4 AND access_count < 2 AND NOT (tier = 'core' OR category IN ('reflection', 'decision') OR coalesce({NOW} - last_accessed <= 7 * 86400000.0, false) OR (tier = 'working' AND score >= 0.1))", "memories")
def eviction_candidates(memories):
    return memory.evictable(memories, NOW).select("id", "tier", "category", "importance")


@query(f"WITH r AS (SELECT *, CASE WHEN tier = 'core' THEN 1 WHEN importance >= 0.7 AND {NOW} - created_at <= 14 * 86400000.0 THEN 2 WHEN coalesce({NOW} - last_accessed <= 14 * 86400000.0, false) THEN 3 END AS reason FROM memories) SELECT scope, id, reason, place FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY reason, importance DESC, last_accessed DESC NULLS LAST, id) AS place FROM r WHERE reason IS NOT NULL) WHERE place <= 10", "memories")
def push_pack(memories):
    return memory.push_pack(memories, NOW).select("scope", "id", "reason", "place")


@query("SELECT CASE grouping(tier, category, scope) WHEN 3 THEN 'tier' WHEN 5 THEN 'category' WHEN 6 THEN 'scope' ELSE 'total' END AS kind, coalesce(tier, category, scope::VARCHAR, 'all') AS name, count(*) AS n FROM memories GROUP BY GROUPING SETS ((tier), (category), (scope), ())", "memories")
def memory_stats(memories):
    return memory.stats(memories)


@query(f"WITH a AS (SELECT item_id AS query_id, {NOW} - (item_id % 40) * 86400000 AS target, 1 + item_id % 7 AS win FROM benchmark) SELECT query_id, id, rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY abs(created_at - target), id) AS rank FROM a JOIN memories ON abs(created_at - target) < win * 86400000) WHERE rank <= 50", "memories", "benchmark")
def time_window_list(memories, benchmark):
    asked = benchmark.select(F.col("item_id").alias("query_id"), (F.lit(NOW) - (F.col("item_id") % 40) * 86_400_000).alias("target_ms"), (1 + F.col("item_id") % 7).alias("window_days"))
    return memory.time_window(memories, asked, 5)


@query("WITH h AS (SELECT *, md5(lower(trim(text))) AS h FROM memories), s AS (SELECT h, min(id) AS stored FROM h WHERE id % 3 = 0 GROUP BY 1), n AS (SELECT h.*, row_number() OVER (PARTITION BY h ORDER BY id) AS n FROM h WHERE id % 3 <> 0) SELECT n.id, n.h AS content_hash FROM n LEFT JOIN s ON n.h = s.h WHERE s.stored IS NULL AND n = 1", "memories")
def memory_store(memories):
    """Which of the incoming texts are new."""
    hashed = memories.withColumn("content_hash", memory.content_hash(F.col("text")))
    new, _ = memory.store(hashed.where("id % 3 = 0"), memories.where("id % 3 <> 0"), NOW)
    return new.select("id", "content_hash")


@query("WITH l AS (SELECT user_id * 1000 AS id, count(*) AS hits, max(epoch_us(ts) // 1000) AS seen FROM events GROUP BY 1) SELECT m.id, access_count + coalesce(hits, 0) AS access_count, greatest(last_accessed, seen) AS last_accessed FROM memories m LEFT JOIN l ON m.id = l.id", "memories", "events")
def access_touch(memories, events):
    log = events.select((F.col("user_id") * 1000).alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("accessed_at"))
    return memory.touch(memories, log).select("id", "access_count", "last_accessed")


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text FROM conversations WHERE role LIKE 'user%' GROUP BY 1", "conversations")
def export_turns(conversations):
    return memory.turns_text(conversations, "user")


@query("WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations) SELECT a.conv_id, a.n // 2 AS pair, a.text || chr(10) || chr(10) || 'Assistant: ' || b.text AS text FROM n a JOIN n b ON a.conv_id = b.conv_id AND b.n = a.n + 1 WHERE a.n % 2 = 0 AND length(a.text) + length(b.text) + 13 >= 30", "conversations")
def exchange_pairs(conversations):
    return memory.exchanges(conversations)


# Text ------------------------------------------------------------------------------

_CATS = {c: " + ".join(f"regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}')::INT" for p in ps) for c, ps in lexicons.CATEGORY_PATTERNS.items()}
_CLASSIFY = "SELECT *, CASE greatest({0}) WHEN 0 THEN 'other' {1} END AS category FROM (SELECT id, text, {2} FROM said)".format(", ".join("n_" + c for c in _CATS), " ".join(f"WHEN n_{c} THEN '{c}'" for c in _CATS), ", ".join(f"{n} AS n_{c}" for c, n in _CATS.items()))


@query(f"SELECT id, category FROM ({_CLASSIFY})", "said")
def classify_text(said):
    return spread(said).select("id", X.category(F.col("text")).alias("category"))


_COMMIT = " OR ".join(f"regexp_matches(text, '{p}')" for p in lexicons.COMMITMENT_PATTERNS)
_DENS = f"(CASE WHEN len(w) = 0 THEN 0 ELSE least(1.0, len(list_filter(list_slice(w, 2, len(w)), lambda x: regexp_matches(x, '^[A-Z][a-z]+') AND lower(x) NOT IN {_in(lexicons.DENSITY_STOP)}))::DOUBLE / len(w)) END)"


@query(f"WITH c AS (SELECT *, regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_''-]+') AS w FROM ({_CLASSIFY})) SELECT id, round(greatest(0, least(1.0, CASE category WHEN 'decision' THEN 0.8 WHEN 'fact' THEN 0.7 WHEN 'entity' THEN 0.7 WHEN 'preference' THEN 0.6 WHEN 'reflection' THEN 0.6 ELSE 0.5 END + CASE WHEN length(text) > 200 THEN 0.1 ELSE 0 END + CASE WHEN {_DENS} >= 0.1 THEN least(0.1, {_DENS} * 0.5) ELSE 0 END + CASE WHEN ({_COMMIT}) AND category <> 'decision' THEN 0.05 ELSE 0 END)), 6)::DOUBLE AS importance FROM c", "said")
def importance(said):
    return spread(said).select("id", F.round(X.importance(F.col("text"), X.category(F.col("text"))), 6).alias("importance"))


@query(f"SELECT id, list_filter(list_transform(regexp_split_to_array(lower(text), '\\s+'), lambda w: regexp_replace(w, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')), lambda w: length(w) > 1 AND w NOT IN {_in(lexicons.INTENT_STOP)}) AS terms FROM said", "said")
def intent_terms(said):
    return said.select("id", X.intent_terms(F.col("text")).alias("terms"))


@query(f"SELECT id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: length(w) > 2 AND w NOT IN {_STOP} AND NOT list_contains(list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: regexp_matches(x, '^[A-Z][a-z]+$')), lambda x: lower(x)), w)) AS terms FROM said", "said")
def memory_keywords(said):
    return said.select("id", X.memory_keywords(F.col("text")).alias("terms"))


@query("SELECT id, list_filter(regexp_extract_all(text, '[A-Z][a-z]+(?:\\s+[A-Z][a-z]+){0,2}'), lambda m: length(m) >= 3 AND split_part(m, ' ', 1) NOT IN " + _in(lexicons.ENTITY_STOP) + ") AS found FROM said", "said")
def entity_phrases(said):
    return said.select("id", X.entities(F.col("text")).alias("found"))


_WHEN = " ".join(f"WHEN regexp_matches(low, '{p}') THEN {NOW} - {'regexp_extract(low, ' + chr(39) + p + chr(39) + ', 1)::BIGINT * ' if '(' in p else ''}{d * 86_400_000}" for p, d, _ in lexicons.TIME_PATTERNS)
_WIN = " ".join(f"WHEN regexp_matches(low, '{p}') THEN {w}" for p, _, w in lexicons.TIME_PATTERNS)


@query(f"SELECT id, CASE {_WHEN} END AS target_ms, CASE {_WIN} END AS window_days FROM (SELECT id, lower(text) AS low FROM said)", "said")
def time_reference(said):
    found = X.time_reference(F.col("text"), F.lit(NOW))
    return said.select("id", found["target_ms"].alias("target_ms"), found["window_days"].alias("window_days"))


@query("SELECT s_suppkey AS id, regexp_replace(regexp_replace(regexp_replace(trim(lower(s_name)), '[''’]', '', 'g'), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') AS slug FROM supplier", "supplier")
def entity_slugs(supplier):
    return supplier.select(F.col("s_suppkey").alias("id"), X.entity_slug(F.col("s_name")).alias("slug"))


@query("SELECT item_id AS id, CASE WHEN item_id % 3 = 0 THEN trim(substr(text, 1, 20)) WHEN item_id % 3 = 1 THEN 'Second ' || item_id ELSE 'n' || item_id END AS title FROM (SELECT item_id, regexp_replace(text, '\\s+', ' ', 'g') AS text FROM benchmark)", "benchmark")
def title_extract(benchmark):
    """Titles of documents made with and without headings."""
    flat = F.regexp_replace("text", r"\s+", " ")
    body = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("# "), F.substring(flat, 1, 20), F.lit("\n\n"), flat)).when(F.col("item_id") % 3 == 1, F.concat(F.lit("# Notes\n\n## Second "), F.col("item_id").cast("string"), F.lit("\n"), flat)).otherwise(flat)
    return benchmark.select(F.col("item_id").alias("id"), X.title(body, F.concat(F.lit("a/n"), F.col("item_id").cast("string"), F.lit(".md"))).alias("title"))


@query(None, "corpus")
def chunk_documents(corpus):
    return chunking.chunked(corpus, "doc_id").select("doc_id", "seq", "pos", F.sha2("chunk", 256).alias("chunk_hash"))


@query("WITH f AS (SELECT doc_id, k, length(head) AS a, length(head) + length(first) AS b, length(doc_id::VARCHAR) AS n FROM code_files), p AS (SELECT doc_id, unnest(CASE k WHEN 0 THEN [(a, 90), (a + 7, 90), (b, 100)] WHEN 1 THEN [(a, 90), (a + 22, 100), (b + 4, 90)] WHEN 2 THEN [(a, 90), (b, 80)] WHEN 3 THEN [(a + 17, 100), (b, 100), (b + n + 13, 90)] WHEN 4 THEN [(a, 100), (a + n + 12, 90), (b, 90)] ELSE [] END) AS p FROM f) SELECT doc_id, p[1]::INT AS pos, p[2]::INT AS worth FROM p", "code_files")
def syntax_breaks(code_files):
    """Declarations in source files that hold the documents in their strings and comments."""
    return chunking.declarations(code_files, "doc_id", "path")


@query(None, "code_files")
def syntax_chunks(code_files):
    """The same files cut at declarations as well as at breaks of text."""
    return chunking.chunked(code_files, "doc_id", path="path").select("doc_id", "seq", "pos", F.sha2("chunk", 256).alias("chunk_hash"))


@query(None, "corpus", "phrases")
def best_chunk(corpus, phrases):
    """The chunk of each candidate that holds most of the query's words."""
    hits = bm25_topk(corpus, phrases).select("query_id", F.col("doc_id").alias("id"), "rank")
    docs = corpus.select(F.col("doc_id").alias("id"), "body")
    found = composites.best_chunks(hits, docs, phrases.withColumnRenamed("text", "query"))
    return hits.join(found, ["query_id", "id"]).select("query_id", F.col("id").alias("doc_id"), "rank", "seq", "pos", "held")


# Knowledge -------------------------------------------------------------------------

_SLUG = "regexp_replace(regexp_replace(trim(lower(subject)), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g')"
_SCD = f"n AS (SELECT id, {_SLUG} AS subject, lower(predicate) AS predicate, trim(object) AS object, valid_from, ingested FROM facts), l AS (SELECT *, lag(object) OVER (PARTITION BY subject, predicate ORDER BY ingested, id) AS prior FROM n), kept AS (SELECT * FROM l WHERE prior IS NULL OR prior <> object), kg AS (SELECT id, subject, predicate, object, valid_from, ingested, lead(ingested) OVER (PARTITION BY subject, predicate ORDER BY ingested, id) AS valid_until FROM kept)"


@query(f"WITH {_SCD} SELECT id, subject, predicate, object, valid_from, valid_until FROM kg", "facts")
def scd2_build(facts):
    return knowledge.build(facts).select("id", "subject", "predicate", "object", "valid_from", "valid_until")


@query(f"WITH {_SCD} SELECT id, subject, predicate, object, valid_from, valid_until FROM kg", "facts")
def kg_late_facts(facts):
    """Facts that come in three batches, late ones last: intervals as of all at once."""
    spark, path = facts.sparkSession, fresh(facts.sparkSession, "fact-store")
    for number, part in enumerate((2, 0, 1)):
        fact_store.put(facts.where(F.col("id") % 3 == part), path, number, 16)
    return fact_store.current(spark, path).select("id", "subject", "predicate", "object", "valid_from", "valid_until")


@query(f"WITH {_SCD}, a AS (SELECT c_custkey AS query_id, regexp_replace(trim(lower(c_name)), '[^a-z0-9]+', '_', 'g') AS subject, TIMESTAMP '1996-01-01' + INTERVAL 1 DAY * (c_custkey % 700) AS probe FROM customer) SELECT query_id, id, object FROM a JOIN kg USING (subject) WHERE valid_from <= probe AND (valid_until IS NULL OR probe < valid_until)", "facts", "customer")
def kg_as_of(facts, customer):
    at = F.expr("timestamp_ntz '1996-01-01 00:00:00' + make_dt_interval(cast(c_custkey % 700 as int))").cast(facts.schema["valid_from"].dataType)
    asked = customer.select(F.col("c_custkey").alias("query_id"), X.entity_slug(F.col("c_name")).alias("subject"), at.alias("at"))
    return knowledge.as_of(knowledge.build(facts), asked).select("query_id", "id", "object")


@query(f"WITH {_SCD} SELECT subject, id, object, row_number() OVER (PARTITION BY subject ORDER BY valid_from, ingested, id) AS place FROM kg", "facts")
def kg_timeline(facts):
    return knowledge.timeline(knowledge.build(facts)).select("subject", "id", "object", "place")


@query(f"WITH {_SCD} SELECT count(DISTINCT subject) AS subjects, count(*) AS facts, count(*) FILTER (valid_until IS NULL) AS active, count(*) FILTER (valid_until IS NOT NULL) AS expired FROM kg", "facts")
def kg_stats(facts):
    return knowledge.stats(knowledge.build(facts))


@query(f"WITH f2 AS (SELECT * FROM facts UNION ALL SELECT c_custkey + 100000000, c_name, 'Segment', c_mktsegment, NULL, NULL FROM customer), {_SCD.replace('FROM facts', 'FROM f2')}, p AS (SELECT subject, predicate, count(*) AS n, string_agg(DISTINCT object, ', ' ORDER BY object) AS objects FROM kg WHERE valid_until IS NULL GROUP BY 1, 2) SELECT subject, sum(n)::BIGINT AS n_open, string_agg(predicate || ': ' || objects, '; ' ORDER BY predicate) AS profile FROM p GROUP BY 1 HAVING sum(n) >= 2", "facts", "customer")
def kg_consolidate(facts, customer):
    more = customer.select((F.col("c_custkey") + 100_000_000).alias("id"), F.col("c_name").alias("subject"), F.lit("Segment").alias("predicate"), F.col("c_mktsegment").alias("object"))
    return knowledge.profiles(knowledge.build(facts.unionByName(more, allowMissingColumns=True)))


@query(f"WITH f2 AS (SELECT * FROM facts UNION ALL SELECT c_custkey + 100000000, c_name, 'Market_segment', c_mktsegment, NULL, NULL FROM customer), {_SCD.replace('FROM facts', 'FROM f2')}, o AS (SELECT *, replace(subject, '_', ' ') AS shown, replace(predicate, '_', ' ') AS said FROM kg WHERE valid_until IS NULL), ob AS (SELECT subject, shown, said, predicate, object, min(id) AS id, count(*) AS n, count(valid_from) AS dated FROM o GROUP BY ALL), ln AS (SELECT subject, shown, predicate, sum(n) AS n, sum(dated) AS dated, said || ': ' || string_agg(object, ', ' ORDER BY id) AS line FROM ob GROUP BY subject, shown, said, predicate), cn AS (SELECT subject, sum(n) AS n, sum(dated) AS dated FROM ln GROUP BY 1 HAVING sum(n) >= 2), p AS (SELECT subject, 'profile' AS kind, '[entity-summary:' || subject || '] ' || any_value(shown) || '. ' || string_agg(line, '. ' ORDER BY predicate) || '.' AS text FROM ln GROUP BY 1 UNION ALL SELECT subject, 'timeline', '[entity-timeline:' || subject || '] ' || string_agg('[' || strftime(valid_from, '%-d %B, %Y') || '] ' || shown || ' ' || said || ' ' || object, '. ' ORDER BY valid_from, predicate, id) || '.' FROM o JOIN cn USING (subject) WHERE cn.dated >= 2 AND valid_from IS NOT NULL GROUP BY subject) SELECT subject, kind, text, 'entity' AS category, 0.85::DOUBLE AS importance FROM p WHERE subject IN (SELECT subject FROM cn)", "facts", "customer")
def kg_consolidate_texts(facts, customer):
    """Profiles and timelines of customers, as the memories that keep them."""
    more = customer.select((F.col("c_custkey") + 100_000_000).alias("id"), F.col("c_name").alias("subject"), F.lit("Market_segment").alias("predicate"), F.col("c_mktsegment").alias("object"))
    return knowledge.consolidated(knowledge.build(facts.unionByName(more, allowMissingColumns=True)))


@query(f"WITH o AS (SELECT o_orderkey AS id, c_name AS subject, o_orderpriority AS predicate, o_orderstatus AS object, o_orderdate AS valid_from FROM orders JOIN customer ON o_custkey = c_custkey), n AS (SELECT subject, count(*) AS n, count(valid_from) AS dated FROM o GROUP BY 1 HAVING count(*) >= 2) SELECT subject, 'timeline' AS kind, sha256('[entity-timeline:' || subject || '] ' || string_agg('[' || strftime(valid_from, '%-d %B, %Y') || '] ' || subject || ' ' || predicate || ' ' || object, '. ' ORDER BY valid_from, predicate, id) || '.') AS text_hash FROM o JOIN n USING (subject) WHERE n.dated >= 2 GROUP BY 1", "orders", "customer")
def kg_order_timelines(orders, customer):
    """All orders as open facts of their customers: many dates a subject."""
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("subject"), F.col("o_orderpriority").alias("predicate"), F.col("o_orderstatus").alias("object"), F.col("o_orderdate").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_until"))
    return knowledge.consolidated(rows).where("kind = 'timeline'").select("subject", "kind", F.sha2("text", 256).alias("text_hash"))


# Catalogue -------------------------------------------------------------------------


@query("WITH o AS (SELECT * FROM corpus WHERE doc_id % 10 <> 0), n AS (SELECT collection, path, CASE WHEN doc_id % 7 = 3 THEN body || '!' ELSE body END AS body FROM corpus WHERE doc_id % 11 <> 0) SELECT CASE WHEN o.path IS NULL THEN 'indexed' WHEN n.path IS NULL THEN 'removed' WHEN o.body <> n.body THEN 'updated' ELSE 'unchanged' END AS change, count(*) AS n FROM o FULL JOIN n ON o.collection = n.collection AND o.path = n.path GROUP BY 1", "corpus")
def reindex_diff(corpus):
    old = catalog.addressed(corpus.where("doc_id % 10 <> 0"))
    new = corpus.where("doc_id % 11 <> 0").withColumn("body", F.when(F.col("doc_id") % 7 == 3, F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    return catalog.changes(old, catalog.addressed(new)).groupBy("change").agg(F.count("*").alias("n"))


@query("SELECT sha256(body) AS hash, min(path) AS path, max(octet_length(encode(body)))::BIGINT AS bytes FROM corpus GROUP BY 1", "corpus")
def content_addressed(corpus):
    return catalog.contents(catalog.addressed(corpus)).withColumn("bytes", F.col("bytes").cast("long"))


@query("WITH h AS (SELECT *, sha256(body) AS h FROM corpus) SELECT h AS hash, min(path) AS path FROM h WHERE h NOT IN (SELECT h FROM h WHERE doc_id % 2 = 0) GROUP BY 1", "corpus")
def pending_embeddings(corpus):
    docs = catalog.addressed(corpus)
    return catalog.pending(docs, docs.where("doc_id % 2 = 0").select("hash", F.lit(0).alias("seq"))).select("hash", "path")


@query("""WITH RECURSIVE p AS (SELECT sha256(body) AS hash, min(path) AS path, max(octet_length(encode(body)))::BIGINT AS bytes FROM corpus GROUP BY 1),
n AS (SELECT *, row_number() OVER (ORDER BY path, hash) - 1 AS pos FROM p),
r AS (SELECT pos, hash, 0::BIGINT AS batch, 1 AS k, bytes AS held FROM n WHERE pos = 0
  UNION ALL SELECT n.pos, n.hash, batch + (k >= 64 OR held + bytes > 100000)::INT, CASE WHEN k >= 64 OR held + bytes > 100000 THEN 1 ELSE k + 1 END, CASE WHEN k >= 64 OR held + bytes > 100000 THEN bytes ELSE held + bytes END FROM r JOIN n ON n.pos = r.pos + 1)
SELECT hash, pos, batch FROM r""", "corpus")
def embedding_batches(corpus):
    """Contents in batches of 64 texts and 100,000 bytes for an embedder."""
    contents = catalog.contents(catalog.addressed(corpus)).withColumn("bytes", F.col("bytes").cast("long"))
    return batches.batched(contents, ("path", "hash"), "bytes", 64, 100_000).select("hash", "pos", "batch")


@query("WITH h AS (SELECT *, sha256(body) AS h FROM corpus) SELECT DISTINCT h AS hash FROM h WHERE h NOT IN (SELECT h FROM h WHERE active)", "corpus")
def orphan_content(corpus):
    docs = catalog.addressed(corpus)
    return catalog.orphans(docs.select("hash").distinct(), docs.where("active"))


@query("SELECT collection, count(*) AS total, sum(active::INT)::BIGINT AS active, max(doc_id) AS last_modified FROM corpus GROUP BY 1", "corpus")
def collection_status(corpus):
    return catalog.status(corpus.withColumn("modified_at", F.col("doc_id")))


_RULES = "SELECT DISTINCT collection, '' AS prefix, 'all of ' || collection AS context FROM corpus UNION ALL SELECT DISTINCT collection, substr(path, 1, 3), 'in ' || substr(path, 1, 2) FROM corpus WHERE substr(path, 1, 2) <> 'de'"


@query(f"WITH r AS ({_RULES}), m AS (SELECT c.collection, c.path, context, prefix FROM corpus c JOIN r ON c.collection = r.collection AND starts_with(c.path, prefix)) SELECT collection, path, 'everything' || chr(10) || chr(10) || string_agg(context, chr(10) || chr(10) ORDER BY length(prefix), context) AS general, max_by(context, length(prefix)) AS specific FROM m GROUP BY 1, 2", "corpus")
def context_resolution(corpus):
    all_of = corpus.select("collection", F.lit("").alias("prefix"), F.concat(F.lit("all of "), "collection").alias("context")).distinct()
    inside = corpus.where("substr(path, 1, 2) <> 'de'").select("collection", F.substring("path", 1, 3).alias("prefix"), F.concat(F.lit("in "), F.substring("path", 1, 2)).alias("context")).distinct()
    return catalog.contexts(corpus, all_of.unionByName(inside), "everything")


@query("WITH a AS (SELECT doc_id AS query_id, replace(path, '/', '-') AS name FROM corpus WHERE doc_id % 100 = 0) SELECT query_id, path, distance, rank FROM (SELECT query_id, path, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, path) AS rank FROM (SELECT query_id, path, levenshtein(lower(name), lower(path))::INT AS distance FROM a, corpus WHERE levenshtein(lower(name), lower(path)) <= 2)) WHERE rank <= 5", "corpus")
def similar_files(corpus):
    asked = corpus.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.replace(F.col("path"), F.lit("/"), F.lit("-")).alias("name"))
    return catalog.similar(corpus, asked, 2)


@query("WITH a AS (SELECT doc_id AS query_id, CASE doc_id % 4 WHEN 0 THEN substr(sha256(body), 1, 6) WHEN 1 THEN collection || '/' || path WHEN 2 THEN path || ':12' ELSE doc_id || '.md' END AS name FROM corpus WHERE doc_id % 50 < 4), k AS (SELECT collection, path, unnest([1, 2, 3, 4]) AS how, unnest([substr(sha256(body), 1, 6), collection || '/' || path, path, doc_id || '.md']) AS want FROM corpus) SELECT query_id, collection, path, how FROM (SELECT query_id, collection, path, how, row_number() OVER (PARTITION BY query_id ORDER BY how, collection, path) AS n FROM a JOIN k ON want = regexp_replace(name, ':\\d+$', '')) WHERE n = 1", "corpus")
def find_document(corpus):
    docs = catalog.addressed(corpus)
    kind = F.col("doc_id") % 4
    name = F.when(kind == 0, F.col("docid")).when(kind == 1, F.concat_ws("/", "collection", "path")).when(kind == 2, F.concat("path", F.lit(":12"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    return catalog.find(docs, docs.where("doc_id % 50 < 4").select(F.col("doc_id").alias("query_id"), name.alias("name")))


@query("WITH a AS (SELECT doc_id AS query_id, CASE doc_id % 4 WHEN 0 THEN '#' || substr(sha256(body), 1, 9) WHEN 1 THEN path ELSE lang || 'x' || doc_id END AS name FROM (SELECT *, split_part(path, '/', 1) AS lang FROM corpus) WHERE doc_id % 4 < 2), k AS (SELECT collection, path, unnest([3, 5]) AS how, unnest([path, substr(sha256(body), 1, 9)]) AS want FROM corpus) SELECT query_id, collection, path, how FROM (SELECT query_id, collection, path, how, row_number() OVER (PARTITION BY query_id ORDER BY how, collection, path) AS n FROM a JOIN k ON want = ltrim(name, '#')) WHERE n = 1", "corpus")
def find_by_hash(corpus):
    """Documents by path, or by nine digits of their content's hash."""
    docs = catalog.addressed(corpus)
    name = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("#"), F.substring("hash", 1, 9))).otherwise(F.col("path"))
    return catalog.find_all(docs, docs.where("doc_id % 4 < 2").select(F.col("doc_id").alias("query_id"), name.alias("name")))[0]


@query("SELECT collection, path FROM corpus WHERE regexp_matches(path, '^(?:.*/)?[^/]*1[^/]\\.md$')", "corpus")
def glob_match(corpus):
    return catalog.matching(corpus, "**/*1?.md").select("collection", "path")


@query(r"""WITH a AS (SELECT DISTINCT split_part(path, '/', 1) AS lang, doc_id % 10 AS d, collection FROM corpus),
g AS (SELECT collection || '/**/*' || d || '.md' AS pattern, '^' || collection || '/(?:.*/)?[^/]*' || d || '\.md$' AS regex FROM a UNION SELECT lang || '/?' || d || '.md', '^' || lang || '/[^/]' || d || '\.md$' FROM a UNION SELECT '*', '^[^/]*$' UNION SELECT lang || '/*.txt', '^' || lang || '/[^/]*\.txt$' FROM a)
SELECT pattern AS query_id, collection, path, CASE WHEN octet_length(encode(body)) > 10240 THEN 'too large' ELSE 'ok' END AS outcome FROM g JOIN corpus ON regexp_matches(path, regex) OR regexp_matches(collection || '/' || path, regex) WHERE active""", "corpus")
def multi_get_globs(corpus):
    """A table of globs against all active documents."""
    parts = corpus.select(F.element_at(F.split("path", "/"), 1).alias("lang"), (F.col("doc_id") % 10).cast("string").alias("d"), "collection").distinct()
    globs = F.array(F.concat("collection", F.lit("/**/*"), "d", F.lit(".md")), F.concat("lang", F.lit("/?"), "d", F.lit(".md")), F.lit("*"), F.concat("lang", F.lit("/*.txt")))
    asked = parts.select(F.explode(globs).alias("pattern")).distinct().select(F.col("pattern").alias("query_id"), "pattern")
    return catalog.matching_many(corpus, asked)[0]


@query("SELECT doc_id, '#' || substr(sha256(body), 1, 6) || ',' || printf('%.4f', (doc_id % 97) / 97.0) || ',' || path || ',' || CASE WHEN contains(substr(body, 1, 30), ',') OR contains(substr(body, 1, 30), '\"') OR contains(substr(body, 1, 30), chr(10)) THEN '\"' || replace(substr(body, 1, 30), '\"', '\"\"') || '\"' ELSE substr(body, 1, 30) END || ',' AS line FROM corpus", "corpus")
def csv_results(corpus):
    rows = catalog.addressed(corpus).withColumns({"score": (F.col("doc_id") % 97) / 97, "title": F.substring("body", 1, 30), "context": F.lit(None).cast("string")})
    return formats.csv_lines(rows).select("doc_id", "line")


# Evaluation ------------------------------------------------------------------------

_GOLD = "g AS (SELECT DISTINCT item_id AS query_id, (item_id * 3 + k) % 40 AS id FROM benchmark, range(0, 5) r(k)), res AS (SELECT query_id, id, min(rank) AS rank FROM lists GROUP BY 1, 2)"


def _gold(benchmark):
    return benchmark.select(F.col("item_id").alias("query_id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")).select("query_id", ((F.col("query_id") * 3 + F.col("k")) % 40).alias("id"))


@query(f"WITH {_GOLD}, h AS (SELECT query_id, count(*) FILTER (rank <= 5) AS at_k, count(*) AS hits, min(rank) AS first, sum(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM res JOIN g USING (query_id, id) GROUP BY 1), s AS (SELECT query_id, count(*) AS size FROM g GROUP BY 1), v AS (SELECT query_id, coalesce(at_k, 0) / least(5, size) AS p, coalesce(hits, 0) / size AS r, first, coalesce(dcg, 0) AS dcg, size FROM s LEFT JOIN h USING (query_id)) SELECT query_id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, round(coalesce(1.0 / first, 0), 6)::DOUBLE AS rr, round(dcg / (1 + 1 / log2(3) + 1 / log2(4) + 1 / log2(5) + 1 / log2(6)), 6) AS ndcg FROM v", "lists", "benchmark")
def mrr_ndcg(lists, benchmark):
    return evaluation.ranking(lists.groupBy("query_id", "id").agg(F.min("rank").alias("rank")), _gold(benchmark), 5)


@query(f"WITH {_GOLD}, s AS (SELECT query_id, id % 9 AS session, min(rank) AS rank FROM res GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, session) AS place FROM s), w AS (SELECT DISTINCT query_id, id % 9 AS session FROM g) SELECT w.query_id, max((t.place IS NOT NULL)::INT) AS any_hit, round(count(t.place) / count(*), 6) AS recall FROM w LEFT JOIN t ON w.query_id = t.query_id AND w.session = t.session AND place <= 4 GROUP BY 1", "lists", "benchmark")
def recall_at_k(lists, benchmark):
    res = lists.groupBy("query_id", "id").agg(F.min("rank").alias("rank")).withColumn("session", F.col("id") % 9)
    return evaluation.session_recall(res, _gold(benchmark).withColumn("session", F.col("id") % 9), 4)


@query("WITH c AS (SELECT source, sum(quality)::DOUBLE AS k, count(*)::DOUBLE AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1), w AS (SELECT *, (k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) AS mid, 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n) AS half FROM c) SELECT source, round(greatest(0, mid - half), 6) AS low, round(least(1, mid + half), 6) AS high FROM w", "labels", "documents")
def wilson_ci(labels, documents):
    sums = labels.join(documents.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("quality").cast("double").alias("k"), F.count("*").cast("double").alias("n"))
    ci = evaluation.wilson(F.col("k"), F.col("n"))
    return sums.select("source", F.round(ci["low"], 6).alias("low"), F.round(ci["high"], 6).alias("high"))


@query("WITH t AS (SELECT id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^A-Za-z0-9_\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '') AS a, ['we', 'decided', 'to', 'go', 'with', 'building', 'products', 'products'] AS b FROM said), s AS (SELECT id, len(a) AS na, len(b) AS nb, list_sum(list_transform(list_distinct(a), lambda w: least(len(list_filter(a, lambda x: x = w)), len(list_filter(b, lambda x: x = w))))) AS hit FROM t) SELECT id, round(CASE WHEN hit > 0 THEN 2.0 * hit / (na + nb) ELSE 0 END, 6)::DOUBLE AS f1 FROM s", "said")
def token_f1(said):
    return spread(said).select("id", F.round(evaluation.token_f1(F.col("text"), F.lit("We decided to go with building, products products")), 6).alias("f1"))


_TRUTH = ["alice", "smith", "will", "buy", "products"]


@query(f"SELECT id, round(({' + '.join(f'''list_contains({_TOKENS.format('text')}, '{w}')::INT''' for w in _TRUTH)}) / 5.0, 6)::DOUBLE AS coverage FROM said", "said")
def answer_coverage(said):
    return said.select("id", F.round(evaluation.coverage(F.col("text"), F.lit("Alice Smith will buy products")), 6).alias("coverage"))


@query(f"WITH {_GOLD}, h AS (SELECT DISTINCT query_id FROM res JOIN g USING (query_id, id) WHERE rank <= 3), a AS (SELECT DISTINCT query_id, query_id % 3 AS difficulty FROM g) SELECT difficulty, count(*) AS queries, round(count(h.query_id) / count(*), 6)::DOUBLE AS hit_rate FROM a LEFT JOIN h USING (query_id) GROUP BY 1", "lists", "benchmark")
def hit_at_k(lists, benchmark):
    gold = _gold(benchmark).withColumn("difficulty", F.col("query_id") % 3)
    return evaluation.hit_rate(lists.groupBy("query_id", "id").agg(F.min("rank").alias("rank")), gold, 3, "difficulty")


# Whole searches --------------------------------------------------------------------


@query(f"WITH r AS (SELECT query_id, 0 AS list_no, doc_id AS id, rank FROM ({ORACLE_SQL['bm25_topk']}) UNION ALL SELECT query_id, 1, doc_id, rank FROM ({ORACLE_SQL['bm25_all_terms']})), w AS (SELECT *, {_W} AS weight FROM r), f AS (SELECT query_id, id, round(sum(weight / (60 + rank)) + {_BONUS}, 6)::DOUBLE AS score FROM w GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 10", "corpus", "phrases")
def hybrid_query(corpus, phrases):
    """Documents by any and by all terms, fused."""
    lists = [f(corpus, phrases).withColumnRenamed("doc_id", "id") for f in (bm25_topk, bm25_all_terms)]
    return composites.hybrid(lists)


_RECALL = f"WITH b AS (SELECT query_id, id, 0.8 / (60 + rank) AS s FROM ({ORACLE_SQL['memory_or_search']}) UNION ALL SELECT query_id, id, 0.1 / (60 + rank) FROM ({ORACLE_SQL['time_window_list']})), f AS (SELECT query_id, id, sum(s) AS fused FROM b GROUP BY 1, 2), found AS (SELECT query_id, id, tier, round(fused * ({_SCORE}), 6)::DOUBLE AS score FROM f JOIN memories USING (id))"


def _found(memories, phrases, benchmark):
    words, timed = memory_or_search(memories, phrases), time_window_list(memories, benchmark)
    return composites.recalled(memories, words, words.where(F.lit(False)), timed, NOW)


@query(f"{_RECALL} SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM found) WHERE rank <= 10", "memories", "phrases", "benchmark")
def memory_recall(memories, phrases, benchmark):
    """Memories by words and by time, fused, times their decay."""
    return composites.recall(_found(memories, phrases, benchmark)).select("query_id", "id", "score", "rank")


@query(f"{_RECALL} SELECT * FROM (SELECT query_id, id, tier, score, row_number() OVER (PARTITION BY query_id, tier ORDER BY score DESC, id) AS rank FROM found) WHERE rank <= 5", "memories", "phrases", "benchmark")
def recall_tiered(memories, phrases, benchmark):
    return composites.recall_tiered(_found(memories, phrases, benchmark)).select("query_id", "id", "tier", "score", "rank")


_ASKED = 'Did Alice Smith buy products "days ago"'


@query("SELECT id, CASE WHEN contains(low, 'did') OR contains(low, 'alice') OR contains(low, 'smith') THEN 1.4 ELSE 1.0 END::DOUBLE AS name, CASE WHEN contains(low, 'days ago') THEN 1.6 ELSE 1.0 END::DOUBLE AS phrase, round(1 + 0.4 * (contains(low, 'products')::INT + contains(low, '\"days')::INT + contains(low, 'ago\"')::INT) / 3.0, 6)::DOUBLE AS keyword FROM (SELECT id, lower(text) AS low FROM said)", "said")
def memory_boosts(said):
    asked, text = F.lit(_ASKED), F.col("text")
    return said.select("id", X.name_boost(asked, text).alias("name"), F.round(X.memory_phrase_boost(asked, text), 6).alias("phrase"), F.round(X.memory_keyword_boost(asked, text), 6).alias("keyword"))


@query("SELECT id, text, category FROM ({0}) WHERE category <> 'other'".format(_CLASSIFY.replace("FROM said", r"FROM (SELECT id, unnest(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) >= 20)) AS text FROM said)")), "said")
def extract_memories(said):
    """Sentences worth remembering."""
    return memory.extracted(said).select("id", "text", "category")


@query("SELECT id, created_at FROM memories WHERE category = 'fact' ORDER BY created_at DESC, id LIMIT 100 OFFSET 10", "memories")
def memory_list(memories):
    return memory.listing(memories, 100, 10, category="fact").select("id", "created_at")


@query("SELECT id, tier FROM memories WHERE NOT (category = 'other' AND tier = 'peripheral')", "memories")
def memory_forget(memories):
    return memory.forgotten(memories, memories.where("category = 'other' and tier = 'peripheral'")).select("id", "tier")


@query(f"WITH {_SCD} SELECT id, subject, object FROM kg WHERE predicate = 'priority' AND contains(lower(object), 'urgent') ORDER BY valid_from DESC, id LIMIT 50", "facts")
def kg_search(facts):
    return knowledge.search(knowledge.build(facts), predicate="Priority", part="Urgent").select("id", "subject", "object")


@query(f"WITH {_SCD} SELECT id, NOT (valid_until IS NULL AND id % 5 <> 0) AS closed FROM kg", "facts")
def kg_invalidate(facts):
    kg = knowledge.build(facts)
    return knowledge.invalidate(kg, kg.where("id % 5 = 0"), F.col("ingested")).select("id", F.col("valid_until").isNotNull().alias("closed"))


@query("WITH o AS (SELECT * FROM corpus WHERE doc_id % 3 <> 0), n AS (SELECT collection, path, body || '+' AS body FROM corpus WHERE doc_id % 4 = 0) SELECT collection, path, sha256(coalesce(n.body, o.body)) AS hash, n.path IS NOT NULL OR o.active AS active FROM o FULL JOIN n USING (collection, path)", "corpus")
def doc_upsert(corpus):
    new = corpus.where("doc_id % 4 = 0").withColumn("body", F.concat("body", F.lit("+")))
    return catalog.upserted(corpus.where("doc_id % 3 <> 0"), new).select("collection", "path", F.sha2("body", 256).alias("hash"), "active")


@query("SELECT collection, path, active AND doc_id % 9 <> 0 AS active FROM corpus", "corpus")
def doc_deactivate(corpus):
    return catalog.deactivated(corpus, corpus.where("doc_id % 9 <> 0")).select("collection", "path", "active")


@query("WITH h AS (SELECT *, sha256(body) AS h FROM corpus) SELECT count(*) AS total_docs, 100000 - max(doc_id) AS days_stale, count(DISTINCT CASE WHEN h NOT IN (SELECT h FROM h WHERE doc_id % 2 = 0) THEN h END) AS needs_embedding FROM h WHERE active", "corpus")
def index_health(corpus):
    docs = catalog.addressed(corpus).withColumn("modified_at", F.col("doc_id") * 86_400_000)
    vectors = docs.where("doc_id % 2 = 0").select("hash", F.lit(0).alias("seq"))
    return catalog.health(docs, vectors, 100_000 * 86_400_000)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1000", "orders")
def cache_trim(orders):
    return catalog.newest(orders, "o_orderdate", "o_orderkey").select("o_orderkey")


@query("SELECT collection, path, octet_length(encode(body))::BIGINT AS bytes FROM corpus WHERE active AND starts_with(path, 'en/')", "corpus")
def list_prefix(corpus):
    return catalog.listing(corpus, "en/")


@query("SELECT doc_id, array_to_string(list_transform(list_slice(string_split(body, chr(10)), 1, 3), lambda x, i: i || ': ' || x), chr(10)) AS body FROM corpus", "corpus")
def numbered_lines(corpus):
    return catalog.body_lines(corpus, 1, 3).select("doc_id", "body")


@query("SELECT DISTINCT collection, 'de' AS folder FROM corpus WHERE starts_with(path, 'de/')", "corpus")
def context_audit(corpus):
    rules = corpus.where("substr(path, 1, 2) <> 'de'").select("collection", F.substring("path", 1, 3).alias("prefix")).distinct()
    return catalog.missing_contexts(corpus, rules)


@query("SELECT name AS collection, count(doc_id) FILTER (active) AS docs FROM (SELECT DISTINCT collection AS name FROM corpus UNION SELECT n_name FROM nation) c LEFT JOIN corpus ON collection = name WHERE name NOT LIKE 'src1%' AND name NOT IN (SELECT n_name FROM nation WHERE n_nationkey % 2 = 0) GROUP BY 1", "corpus", "nation")
def contextless_collections(corpus, nation):
    """Collections of documents, and empty ones named by nations, that no rule tells of."""
    known = corpus.select("collection").unionByName(nation.select(F.col("n_name").alias("collection")))
    rules = corpus.where("collection LIKE 'src1%'").select("collection").unionByName(nation.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("collection")))
    return catalog.without_contexts(known, corpus, rules)


@query("WITH i AS (SELECT s_name || CASE WHEN s_suppkey % 5 = 0 THEN ' &' ELSE '' END AS name, s_suppkey, 'a/' || s_suppkey AS path FROM supplier), m AS (SELECT replace(name, '#', '-') AS collection, s_suppkey, path, CASE WHEN s_suppkey % 5 = 0 THEN 'bad name' WHEN s_suppkey % 3 = 0 THEN 'exists' ELSE 'created' END AS outcome FROM i) SELECT collection, CASE WHEN outcome = 'exists' THEN 'old' ELSE path END AS path, outcome, CASE WHEN outcome <> 'bad name' THEN s_suppkey % 4 <> 0 END AS include_by_default, CASE WHEN outcome <> 'bad name' AND s_suppkey % 4 = 1 THEN 'pull ' || s_suppkey WHEN outcome = 'exists' AND s_suppkey % 4 <> 2 THEN 'fetch' END AS update FROM m", "supplier")
def collection_settings(supplier):
    """Collections made out of suppliers, some there before, with their settings."""
    bad = F.when(F.col("s_suppkey") % 5 == 0, " &").otherwise("")
    rows = supplier.select(F.concat(F.replace("s_name", F.lit("#"), F.lit("-")), bad).alias("collection"), F.concat(F.lit("a/"), F.col("s_suppkey").cast("string")).alias("path"), "s_suppkey")
    old = rows.where("s_suppkey % 3 = 0 and s_suppkey % 5 <> 0").select("collection", F.lit("old").alias("path"), F.lit("**/*.md").alias("pattern"), F.lit(True).alias("include_by_default"), F.lit("fetch").alias("update"))
    now, outcomes = catalog.created(old, rows.select("collection", "path"))
    command = F.when(F.col("s_suppkey") % 4 == 1, F.concat(F.lit("pull "), F.col("s_suppkey").cast("string"))).when(F.col("s_suppkey") % 4 == 2, "")
    now = catalog.configured(now, rows.select("collection", F.when(F.col("s_suppkey") % 4 == 0, False).alias("include_by_default"), command.alias("update")))
    joined = outcomes.withColumnRenamed("path", "_path").join(now, "collection", "left")
    return joined.select("collection", F.coalesce("path", "_path").alias("path"), "outcome", "include_by_default", "update")


@query("SELECT doc_id AS query_id, CASE WHEN doc_id % 2 = 0 THEN path END AS path, CASE WHEN doc_id % 2 = 1 THEN 'not found' WHEN octet_length(encode(body)) > 10240 THEN 'too large' ELSE 'ok' END AS outcome FROM corpus WHERE doc_id % 25 = 0", "corpus")
def multi_get(corpus):
    docs = catalog.addressed(corpus)
    name = F.concat_ws("/", F.when(F.col("doc_id") % 2 == 0, F.col("collection")).otherwise("no such"), "path")
    return catalog.fetch(docs, docs.where("doc_id % 25 = 0").select(F.col("doc_id").alias("query_id"), name.alias("name")))


@query(f"WITH r AS (SELECT query_id, 0 AS list_no, doc_id AS id, rank FROM ({ORACLE_SQL['bm25_topk']}) UNION ALL SELECT query_id, 1, doc_id, rank FROM ({ORACLE_SQL['bm25_negation']})), w AS (SELECT *, CASE WHEN list_no = min(list_no) OVER (PARTITION BY query_id) THEN 2.0 ELSE 1.0 END AS weight FROM r), f AS (SELECT query_id, id, round(sum(weight / (60 + rank)) + {_BONUS}, 6)::DOUBLE AS score FROM w GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 10", "corpus", "phrases")
def structured_search(corpus, phrases):
    """Two typed word searches, fused."""
    return composites.structured([f(corpus, phrases).withColumnRenamed("doc_id", "id") for f in (bm25_topk, bm25_negation)])


@query(f"{_RECALL}, own AS (SELECT query_id, id, text, score, row_number() OVER (PARTITION BY query_id, text ORDER BY score DESC, id) AS n FROM found JOIN memories USING (id) WHERE scope = query_id % 20 OR scope = 0) SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM own WHERE n = 1) WHERE rank <= 5", "memories", "phrases", "benchmark")
def auto_recall(memories, phrases, benchmark):
    found = _found(memories, phrases, benchmark).withColumn("query_scope", F.col("query_id") % 20)
    return composites.auto_recall(found.join(memories.select("id", "scope", "text"), "id")).select("query_id", "id", "score", "rank")


@query("WITH e AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'new ' || text END AS t, CASE WHEN id % 4 = 0 THEN importance * 2 END AS i FROM memories WHERE id % 3 = 0) SELECT id, sha256(coalesce(t, text)) AS hash, round(CASE WHEN i IS NULL THEN importance ELSE least(1, i) END, 6)::DOUBLE AS importance, (t IS NOT NULL)::INT AS logged FROM memories LEFT JOIN e USING (id)", "memories")
def memory_update(memories):
    edits = memories.where("id % 3 = 0").select("id", F.expr("CASE WHEN id % 2 = 0 THEN concat('new ', text) END AS text"), F.expr("CASE WHEN id % 4 = 0 THEN importance * 2 END AS importance"), F.lit(None).cast("string").alias("category"))
    history = memories.where(F.lit(False)).select(F.col("id").alias("memory_id"), F.lit("").alias("action"), F.col("text").alias("old_value"), F.col("text").alias("new_value"), F.lit(NOW).cast("long").alias("timestamp"))
    now, log = memory.updated(memories, edits, history, NOW)
    logged = log.select(F.col("memory_id").alias("id"), F.lit(1).alias("logged"))
    return now.join(logged, "id", "left").select("id", F.sha2("text", 256).alias("hash"), *_r("importance"), F.coalesce("logged", F.lit(0)).alias("logged"))


@query(f"WITH {_SCD}, hits AS (SELECT query_id, id, 1.0 / (rank + 1 + query_id % 3) AS score FROM lists), t AS (SELECT query_id, max(score) AS best, list_sort(list(score)) AS s FROM hits GROUP BY 1), a AS (SELECT DISTINCT h.query_id, k.subject FROM (SELECT DISTINCT query_id FROM lists) h JOIN kg k ON k.id % 50 = h.query_id), na AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM a), m AS (SELECT na.query_id, kg.id, s[len(s) // 2 + 1] AS score, row_number() OVER (PARTITION BY na.query_id ORDER BY kg.valid_from DESC, kg.id) AS place FROM na JOIN t USING (query_id) JOIN kg USING (subject) WHERE na.n <= 3 AND best < 0.5 AND valid_until IS NULL) SELECT query_id, 'memory' AS source, id, round(score, 6)::DOUBLE AS score FROM hits UNION ALL SELECT query_id, 'fact', id, round(score, 6)::DOUBLE FROM m WHERE place <= 5", "lists", "facts")
def kg_injection(lists, facts):
    """Ranked hits, with facts beside the weak ones."""
    kg = knowledge.build(facts)
    hits = lists.select("query_id", "id", (1 / (F.col("rank") + 1 + F.col("query_id") % 3)).alias("score"))
    asked = lists.select("query_id").distinct().join(kg.select("subject", (F.col("id") % 50).alias("query_id")), "query_id")
    return knowledge.injected(hits, asked, kg).select("query_id", "source", "id", *_r("score"))


@query("WITH h AS (SELECT *, sha256(body) AS h FROM corpus) SELECT DISTINCT h AS hash, doc_id AS seq FROM h WHERE doc_id % 2 = 0 AND h NOT IN (SELECT h FROM h WHERE active)", "corpus")
def orphan_vectors(corpus):
    docs = catalog.addressed(corpus)
    return catalog.orphan_vectors(docs.where("doc_id % 2 = 0").select("hash", F.col("doc_id").alias("seq")), docs)


@query("WITH h AS (SELECT CASE WHEN collection = 'src2' THEN 'moved' ELSE collection END AS collection, sha256(body) AS h FROM corpus) SELECT collection, count(*) AS docs, count(DISTINCT h) AS contents FROM h WHERE collection <> 'src1' GROUP BY 1", "corpus")
def collection_changes(corpus):
    """One collection renamed, another removed with the content only it held."""
    docs = catalog.addressed(corpus)
    kept, content = catalog.removed(catalog.renamed(docs, "src2", "moved"), docs.select("hash").distinct(), "src1")
    return kept.join(content, "hash").groupBy("collection").agg(F.count("*").alias("docs"), F.countDistinct("hash").alias("contents"))


_SNIP = "the und products, ist est"


@query(f"WITH l AS (SELECT doc_id, string_split(body, chr(10)) AS l FROM corpus), s AS (SELECT doc_id, l, list_transform(l, lambda x: {' + '.join(f'''contains(lower(x), '{w}')::INT''' for w in _SNIP.split())} + 0.3 * (contains(lower(x), 'keit')::INT + contains(lower(x), 'tion')::INT)) AS s FROM l), b AS (SELECT doc_id, l, list_position(s, list_max(s))::INT AS b FROM s) SELECT doc_id, b AS line, greatest(b - 1, 1) - 1 AS before, len(l) - least(b + 2, len(l)) AS after, sha256(CASE WHEN length(t) > 500 THEN left(t, 497) || '...' ELSE t END) AS text_hash FROM (SELECT *, array_to_string(list_slice(l, greatest(b - 1, 1), b + 2), chr(10)) AS t FROM b)", "corpus")
def snippet_lines(corpus):
    found = X.snippet(F.col("body"), F.lit(_SNIP), F.lit("about the -keit or tion!"))
    return corpus.select("doc_id", found.alias("s")).select("doc_id", "s.line", "s.before", "s.after", F.sha2("s.text", 256).alias("text_hash"))


_TERMS = ORACLE_SQL["memory_keywords"]


@query(f"SELECT id, mode, unnest(list_distinct(CASE mode WHEN 'keywords' THEN [text] || CASE WHEN len(terms) >= 2 THEN [terms[1] || ' ' || terms[2]] ELSE [] END || CASE WHEN len(terms) >= 4 THEN [terms[3] || ' ' || terms[4]] ELSE [] END ELSE [text] || list_transform(list_slice(found, 1, 2), lambda e: trim(array_to_string(list_slice(terms, 1, 6), ' ') || ' ' || e)) END)) AS sub FROM said JOIN ({_TERMS}) USING (id) JOIN ({ORACLE_SQL['entity_phrases']}) USING (id), (VALUES ('keywords'), ('entities')) m(mode)", "said")
def sub_queries(said):
    made = [said.select("id", F.lit(mode).alias("mode"), F.explode(X.sub_queries(F.col("text"), mode)).alias("sub")) for mode in ("keywords", "entities")]
    return made[0].unionByName(made[1])


@query("SELECT id, CASE id % 3 WHEN 0 THEN 'fact' WHEN 1 THEN 'preference' ELSE 'decision' END AS category, trim(text) AS text, CASE WHEN id % 2 = 0 THEN 'customer' END AS subject, CASE WHEN id % 2 = 0 THEN 'has id' END AS predicate, CASE WHEN id % 2 = 0 THEN id::VARCHAR END AS object FROM said", "said")
def labelled_lines(said):
    """A model's labelled lines read back: noise lines and short texts go."""
    kind = F.element_at(F.array(F.lit("FACT"), F.lit("preference"), F.lit("Decision")), (F.col("id") % 3 + 1).cast("int"))
    triple = F.when(F.col("id") % 2 == 0, F.concat(F.lit(" ||| Customer| HAS id |"), F.col("id").cast("string"))).otherwise("")
    reply = F.concat(F.lit("Here they are:\n["), kind, F.lit("] "), "text", triple, F.lit("\n[mood] not a known category\n[fact] short"))
    return said.select("id", F.explode(X.labelled_lines(reply)).alias("r")).select("id", "r.*")


@query("SELECT id, CASE WHEN id % 4 <> 3 THEN 2 END AS facts, CASE WHEN id % 4 <> 3 THEN 1 END AS triples, CASE WHEN id % 4 <> 3 THEN text END AS first FROM said", "said")
def fact_replies(said):
    """Facts and triples out of fenced JSON replies; every fourth reply is no JSON."""
    good = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.array(F.col("text"), F.lit(""), F.lit("second")).alias("facts"), F.array(F.struct(F.lit("a").alias("subject"), F.lit("b").alias("predicate"), F.lit("c").cast("string").alias("object")), F.struct(F.lit("a").alias("subject"), F.lit("b").alias("predicate"), F.lit(None).cast("string").alias("object"))).alias("triples"))), F.lit("\n```"))
    found = X.fact_json(F.when(F.col("id") % 4 == 3, F.lit("Sorry {no")).otherwise(good))
    rows = said.select("id", found.alias("r"))
    return rows.select("id", F.when(F.col("r").isNotNull(), F.size("r.facts")).alias("facts"), F.when(F.col("r").isNotNull(), F.size("r.triples")).alias("triples"), F.get("r.facts", F.lit(0)).alias("first"))


@query(f"WITH t AS (SELECT id, list_transform({_TOKENS.format('text')}, lambda w: ('0x' || substr(md5(w), 1, 7))::BIGINT % 64) AS p FROM said), c AS (SELECT id, list_transform(range(0, 64), lambda i: len(list_filter(p, lambda x: x = i))::DOUBLE) AS c FROM t) SELECT id, list_transform(c, lambda x: round(x / sqrt(list_sum(list_transform(c, lambda y: y * y))), 6)) AS vector FROM c", "said")
def hashed_vectors(said):
    vector = X.hashed_vector(X.tokens(F.col("text")))
    return said.select("id", F.transform(vector, lambda x: F.round(x, 6)).alias("vector"))


@query(None, "corpus")
def token_chunks(corpus):
    return chunking.token_chunked(corpus, "doc_id").select("doc_id", "seq", "pos", "tokens", F.sha2("chunk", 256).alias("chunk_hash"))


def _rows(corpus):
    return catalog.addressed(corpus).withColumns({"score": F.col("doc_id") % 97 / 100, "title": F.concat(F.lit("<a & b> "), F.col("doc_id").cast("string")), "context": F.when(F.col("doc_id") % 2 == 0, "it's")})


_DOCID = "substr(sha256(body), 1, 6)"


@query(f"SELECT doc_id, '<file docid=\"#' || {_DOCID} || '\" name=\"' || path || '\" title=\"&lt;a &amp; b&gt; ' || doc_id || '\"' || CASE WHEN doc_id % 2 = 0 THEN ' context=\"it&apos;s\"' ELSE '' END || '/>' AS line FROM corpus", "corpus")
def xml_results(corpus):
    return formats.xml_lines(_rows(corpus)).select("doc_id", "line")


@query(f"SELECT doc_id, '# <a & b> ' || doc_id || chr(10) || '**docid:** `#' || {_DOCID} || '`' || chr(10) || '**file:** ' || path || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '**context:** it''s' ELSE '' END AS line FROM corpus", "corpus")
def markdown_results(corpus):
    return formats.markdown_lines(_rows(corpus)).select("doc_id", "line")


@query(f"SELECT doc_id, '#' || {_DOCID} AS docid, round(doc_id % 97 / 100.0, 2)::DOUBLE AS score, path AS file, CASE WHEN doc_id % 2 = 0 THEN 'it''s' END AS context FROM corpus", "corpus")
def json_results(corpus):
    """JSON result lines, read back."""
    read = F.from_json("line", "docid string, score double, file string, context string")
    return formats.json_lines(_rows(corpus)).select("doc_id", read.alias("r")).select("doc_id", "r.*")


@query("WITH p AS (SELECT list_no, query_id, id, min(rank) AS rank FROM lists GROUP BY 1, 2, 3), g AS (SELECT DISTINCT item_id AS query_id, (item_id * 3 + k) % 40 AS id FROM benchmark, range(0, 5) r(k)), h AS (SELECT list_no, query_id, count(*) FILTER (rank <= 5) AS at_k, count(*) AS hits, min(rank) AS first FROM p JOIN g USING (query_id, id) GROUP BY 1, 2), v AS (SELECT list_no, g.query_id, count(*) AS size FROM (SELECT DISTINCT list_no FROM lists) CROSS JOIN g GROUP BY 1, 2) SELECT list_no AS backend, round(avg(coalesce(at_k, 0) / least(5, size)), 6)::DOUBLE AS precision, round(avg(coalesce(hits, 0) / size), 6)::DOUBLE AS recall, round(avg(coalesce(1e0 / first, 0)), 6)::DOUBLE AS rr, count(*) AS queries FROM v LEFT JOIN h USING (list_no, query_id) GROUP BY 1", "lists", "benchmark")
def backend_means(lists, benchmark):
    """Mean precision, recall and reciprocal rank of each ranked list."""
    every = None
    for n in range(3):
        results = lists.where(F.col("list_no") == n).groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
        one = evaluation.ranking(results, _gold(benchmark), 5, digits=None).withColumn("backend", F.lit(n))
        every = one if every is None else every.unionByName(one)
    return evaluation.means(every, "backend").select("backend", "precision", "recall", "rr", "queries")


# Whole searches with every leg ------------------------------------------------------


def _whole(phrases: DataFrame) -> DataFrame:
    return phrases.select("query_id", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term"))


_WHOLE = f"q AS (SELECT DISTINCT query_id, unnest({_TOKENS.format('text')}) AS term FROM phrases)"
_ACTIVE = _BM25.replace("FROM corpus)", "FROM corpus WHERE active)")


@query(f"WITH {_WHOLE}, {_ACTIVE} " + _TOP.format("SELECT query_id, doc_id, round(raw / (1 + raw), 6) AS score FROM raw", 20), "corpus", "phrases")
def document_search(corpus, phrases):
    """Twenty best active documents by any term of the whole query."""
    return _searched(_titled(corpus.where("active")), _whole(phrases), 20)


_PREFIX = _ACTIVE.replace("FROM tok GROUP BY 1, 2)", "FROM tok JOIN (SELECT DISTINCT term AS prefix FROM q) ON starts_with(term, prefix) GROUP BY 1, 2)").replace("SELECT doc_id, term, sum(w)", "SELECT doc_id, prefix AS term, sum(w)")


@query(f"WITH q AS (SELECT DISTINCT query_id, unnest(list_slice({_TOKENS.format('text')}, 1, 5)) AS term FROM phrases), {_PREFIX} " + _TOP.format("SELECT query_id, doc_id, round(raw / (1 + raw), 6) AS score FROM raw", 20), "corpus", "phrases")
def prefix_search(corpus, phrases):
    """Active documents by terms that begin with one of a query's first five."""
    return lexical.top(lexical.bm25(_titled(corpus.where("active")), _terms(phrases, 5), prefixes=True), 20)


def _stemmed(text):
    return stems.stemmed(X.tokens(text))


@query(None, "corpus", "phrases")
def stemmed_search(corpus, phrases):
    """Active documents by the stems of the whole query, accents folded."""
    terms = phrases.select("query_id", F.explode(_stemmed(F.col("text"))).alias("term"))
    return lexical.top(lexical.bm25(_titled(corpus.where("active")), terms, analyse=_stemmed), 20)


_VEC = f"SELECT query_id, id, similarity, rank FROM (SELECT query_id, id, similarity, {_RANK} FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, {_COS} AS similarity FROM embeddings a, embeddings b WHERE a.vec_id IN (SELECT item_id FROM benchmark) AND b.vec_id IN (SELECT doc_id FROM corpus WHERE active))) WHERE rank <= 20"


def _document_vectors(corpus, phrases, embeddings):
    """Twenty nearest active documents: vector n stands for query n and for document n."""
    asked = embeddings.join(phrases.select(F.col("query_id").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("query_id"), "embedding")
    stored = embeddings.join(corpus.where("active").select(F.col("doc_id").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("id"), "embedding")
    return vectors.nearest(asked, stored, 20)


_BOOST = f"CASE WHEN len(w) = 0 THEN 1.0 ELSE 1 + 0.3 * (len(list_filter(w, lambda x: contains(low, x)))::DOUBLE / len(w)) END * CASE WHEN len(list_filter(ph, lambda x: contains(low, x))) > 0 THEN 1.6 ELSE 1.0 END"
_HYBRID = f"""WITH r AS (SELECT query_id, 0 AS list_no, doc_id AS id, rank FROM ({ORACLE_SQL['document_search']}) UNION ALL SELECT query_id, 1, id, rank FROM ({_VEC})),
w AS (SELECT *, {_W} AS weight FROM r), f AS (SELECT query_id, id, sum(weight / (60 + rank)) + {_BONUS} AS score FROM w GROUP BY 1, 2),
p AS (SELECT query_id, id, score, lower(body) AS low, {_BOOST_W.replace('q.text', 'phrases.text')} AS w, regexp_extract_all(lower(phrases.text), '["'']([^"'']{{3,}})["'']', 1) AS ph FROM f JOIN phrases USING (query_id) JOIN corpus ON doc_id = id),
c AS (SELECT * FROM (SELECT query_id, id, fused, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, id) AS n FROM (SELECT query_id, id, round(score * {_BOOST}, 6)::DOUBLE AS fused FROM p)) WHERE n <= 40)"""


@query(f"{_HYBRID} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, fused, round(CASE WHEN n <= 3 THEN 0.75 WHEN n <= 10 THEN 0.6 ELSE 0.4 END / n + (1 - CASE WHEN n <= 3 THEN 0.75 WHEN n <= 10 THEN 0.6 ELSE 0.4 END) * CASE WHEN (id + query_id) % 4 = 0 THEN 0 ELSE (id * 13 + query_id * 7) % 100 / 100.0 END, 6)::DOUBLE AS score FROM c)) WHERE rank <= 10", "corpus", "phrases", "embeddings")
def hybrid_search(corpus, phrases, embeddings):
    """Words and vectors, fused, boosted by the whole texts, blended with a table of
    reranker scores that knows three of four candidates."""
    lists = [document_search(corpus, phrases).withColumnRenamed("doc_id", "id"), _document_vectors(corpus, phrases, embeddings)]
    docs = corpus.select(F.col("doc_id").alias("id"), "body")
    pairs = lists[0].select("query_id", "id").unionByName(lists[1].select("query_id", "id")).distinct()
    scores = pairs.where("(id + query_id) % 4 <> 0").withColumn("score", (F.col("id") * 13 + F.col("query_id") * 7) % 100 / 100)
    return composites.hybrid_search(lists, docs, phrases.withColumnRenamed("text", "query"), scores)


@query(f"{_HYBRID} SELECT query_id, id, fused, score, rank FROM (SELECT query_id, id, fused, round(1.0 / n, 6)::DOUBLE AS score, n AS rank FROM c) WHERE rank <= 10 AND score >= 0.15", "corpus", "phrases", "embeddings")
def hybrid_search_plain(corpus, phrases, embeddings):
    """As hybrid_search without a reranker, scores of 0.15 and more."""
    lists = [document_search(corpus, phrases).withColumnRenamed("doc_id", "id"), _document_vectors(corpus, phrases, embeddings)]
    docs = corpus.select(F.col("doc_id").alias("id"), "body")
    return composites.hybrid_search(lists, docs, phrases.withColumnRenamed("text", "query"), least=0.15)


@query(None, "corpus", "phrases", "embeddings")
def hybrid_search_chunks(corpus, phrases, embeddings):
    """As hybrid_search, reranked by how many of the query's words a candidate's best chunk holds."""
    lists = [document_search(corpus, phrases).withColumnRenamed("doc_id", "id"), _document_vectors(corpus, phrases, embeddings)]
    docs = corpus.select(F.col("doc_id").alias("id"), "body")

    def share(pairs: DataFrame) -> DataFrame:
        terms = F.array_distinct(X.words(F.col("query")))
        return pairs.select("query_id", "id", (X.contains_score(terms, F.col("text")) / F.greatest(F.size(terms), F.lit(1))).alias("score"))

    return composites.hybrid_search(lists, docs, phrases.withColumnRenamed("text", "query"), reranker=share)


@query(f"WITH r AS (SELECT query_id, 0 AS list_no, doc_id AS id, rank FROM ({ORACLE_SQL['document_search']}) UNION ALL SELECT query_id, 1, doc_id, rank FROM ({ORACLE_SQL['bm25_negation']}) UNION ALL SELECT query_id, 2, id, rank FROM ({_VEC})), w AS (SELECT *, CASE WHEN list_no = min(list_no) OVER (PARTITION BY query_id) THEN 2.0 ELSE 1.0 END AS weight FROM r), f AS (SELECT query_id, id, round(sum(weight / (60 + rank)) + {_BONUS}, 6)::DOUBLE AS score FROM w GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 10", "corpus", "phrases", "embeddings")
def structured_vectors(corpus, phrases, embeddings):
    """Two typed word searches and a vector search, fused."""
    words = [f(corpus, phrases).withColumnRenamed("doc_id", "id") for f in (document_search, bm25_negation)]
    return composites.structured([*words, _document_vectors(corpus, phrases, embeddings)])


_HV = "list_transform(range(0, 64), lambda i: len(list_filter(p, lambda x: x = i))::DOUBLE)"
_PLACES = f"list_transform({_TOKENS.format('text')}, lambda w: ('0x' || substr(md5(w), 1, 7))::BIGINT % 64)"
_MEM_VEC = f"SELECT * FROM (SELECT query_id, id, similarity, {_RANK} FROM (SELECT query_id, id, round(coalesce(list_cosine_similarity(a.v, b.v), 0), 6) AS similarity FROM (SELECT query_id, {_HV} AS v FROM (SELECT query_id, {_PLACES} AS p FROM phrases)) a, (SELECT id, {_HV} AS v FROM (SELECT id, {_PLACES} AS p FROM memories)) b)) WHERE rank <= 20"


@query(_MEM_VEC, "memories", "phrases")
def memory_vectors(memories, phrases):
    """Twenty nearest memories by hashed vectors of the whole texts."""
    vector = X.hashed_vector(X.tokens(F.col("text")))
    return vectors.nearest(phrases.select("query_id", vector.alias("embedding")), memories.select("id", vector.alias("embedding")), 20)


_MEM_KW = rf"list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: length(w) > 2 AND w NOT IN {_STOP} AND NOT list_contains(list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda x: regexp_matches(x, '^[A-Z][a-z]+$')), lambda x: lower(x)), w))"
_RECALL_ALL = f"""WITH b AS (SELECT query_id, id, 0.8 / (60 + rank) AS s FROM ({ORACLE_SQL['memory_or_search']}) UNION ALL SELECT query_id, id, 0.2 / (60 + rank) FROM ({ORACLE_SQL['memory_vectors']}) UNION ALL SELECT query_id, id, 0.1 / (60 + rank) FROM ({ORACLE_SQL['time_window_list']})),
f AS (SELECT query_id, id, sum(s) AS fused FROM b GROUP BY 1, 2), a AS (SELECT query_id, {_MEM_KW} AS w, regexp_extract_all(lower(text), '"([^"]+)"', 1) AS ph, CASE WHEN query_id % 3 <> 0 THEN {NOW} - (query_id % 40) * 86400000 END AS target, 1 + query_id % 7 AS win FROM phrases),
found AS (SELECT query_id, id, tier, round(fused * CASE WHEN len(w) = 0 THEN 1.0 ELSE 1 + 0.4 * (len(list_filter(w, lambda x: contains(lower(m.text), x)))::DOUBLE / len(w)) END * pow(1.6, len(list_filter(ph, lambda x: contains(lower(m.text), x)))) * ({_SCORE}) * coalesce(1 + greatest(0, 0.4 * (1 - abs(created_at - target) / 86400000.0 / win)), 1), 6)::DOUBLE AS score FROM f JOIN a USING (query_id) JOIN memories m USING (id))"""


def _recalled(memories, phrases, benchmark):
    lists = memory_or_search(memories, phrases), memory_vectors(memories, phrases), time_window_list(memories, benchmark)
    target = F.when(F.col("query_id") % 3 != 0, F.lit(NOW) - (F.col("query_id") % 40) * 86_400_000)
    asked = phrases.select("query_id", F.col("text").alias("query"), target.alias("target_ms"), (1 + F.col("query_id") % 7).alias("window_days"))
    return composites.recall_search(memories, asked, *lists, NOW)


@query(f"{_RECALL_ALL} SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM found) WHERE rank <= 10", "memories", "phrases", "benchmark")
def recall_search(memories, phrases, benchmark):
    """Memories by words, vectors and time, fused, with all boosts."""
    return composites.recall(_recalled(memories, phrases, benchmark)).select("query_id", "id", "score", "rank")


@query(f"{_RECALL_ALL} SELECT * FROM (SELECT query_id, id, tier, score, row_number() OVER (PARTITION BY query_id, tier ORDER BY score DESC, id) AS rank FROM found) WHERE rank <= 5", "memories", "phrases", "benchmark")
def recall_search_tiered(memories, phrases, benchmark):
    """As recall_search, the best five of every tier."""
    return composites.recall_tiered(_recalled(memories, phrases, benchmark)).select("query_id", "id", "tier", "score", "rank")


@query(f"{_RECALL_ALL}, own AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id, text ORDER BY score DESC, id) AS n FROM found JOIN memories USING (id) WHERE scope = query_id % 20 OR scope = 0) SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM own WHERE n = 1) WHERE rank <= 5", "memories", "phrases", "benchmark")
def recall_search_auto(memories, phrases, benchmark):
    """As recall_search, of the query's scope and the shared one, one memory a text."""
    found = _recalled(memories, phrases, benchmark).drop("tier").withColumn("query_scope", F.col("query_id") % 20)
    return composites.auto_recall(found.join(memories.select("id", "scope", "text"), "id")).select("query_id", "id", "score", "rank")


@query(f"WITH k AS (SELECT *, {_RANK} FROM ({_KNN})), n AS (SELECT * FROM k WHERE rank <= 30) SELECT query_id, doc_id, similarity, seq, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS rank FROM (SELECT query_id, id // 4 AS doc_id, max(similarity) AS similarity, min_by(id % 4, (-similarity, id % 4)) AS seq FROM n WHERE id // 4 % 5 <> 0 GROUP BY 1, 2)) WHERE rank <= 10", "embeddings")
def nearest_documents(embeddings):
    """Four vectors in a row are the chunks of a document; every fifth document is inactive."""
    chunks = embeddings.select(F.col("vec_id").alias("id"), F.expr("vec_id div 4").alias("doc_id"), (F.col("vec_id") % 4).alias("seq"), "embedding")
    documents = chunks.select("doc_id", (F.col("doc_id") % 5 != 0).alias("active")).distinct()
    return vectors.nearest_documents(_asked(embeddings), chunks, documents, 10)


@query(f"WITH k AS ({_KNN}), o AS (SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS n FROM k WHERE scope_a = scope_b AND scope_a <> 0), s AS (SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS n FROM k WHERE scope_b = 0), u AS (SELECT * FROM o WHERE n <= 9 UNION ALL SELECT * FROM s WHERE n <= 3) SELECT query_id, id, similarity, {_RANK} FROM u", "embeddings")
def knn_shared_scope(embeddings):
    """Nearest vectors of the query's own scope and, by a quota, of scope 0."""
    return vectors.nearest_shared(_asked(embeddings), _stored(embeddings), 3, 0)


@query("WITH s AS (SELECT query_id, id, 1.0 / rank AS score FROM lists WHERE list_no = 1), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM s) SELECT query_id, (max(score) - coalesce(max(CASE WHEN n = 2 THEN score END), 0)) / max(score) >= 0.15 AS strong FROM n GROUP BY 1", "lists")
def memory_gate(lists):
    return fusion.memory_gate(lists.where("list_no = 1").select("query_id", "id", (1 / F.col("rank")).alias("score")))


@query("WITH o AS (SELECT query_id, id, min((list_no, rank)) AS place FROM lists GROUP BY 1, 2) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY place, id) AS rank FROM o", "lists")
def expansion_lists(lists):
    """A query's own list, then what those of two variants add."""
    return fusion.appended(lists.where("list_no = 0"), [lists.where("list_no = 1"), lists.where("list_no = 2")])


_WHOLE_TRUTH = "['we', 'decided', 'to', 'go', 'with', 'building', 'products']"
_ANSWER = r"list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^A-Za-z0-9_\s]', ' ', 'g'), '\s+'), lambda w: w <> '')"


@query(f"WITH t AS (SELECT id, {_ANSWER} AS a, {_WHOLE_TRUTH} AS b FROM (SELECT id, CASE WHEN id % 7 = 0 THEN 'We decided to go with: building products' WHEN id % 11 = 0 THEN NULL ELSE text END AS text FROM said)), s AS (SELECT id, a, b, len(list_filter(a, lambda w: list_contains(b, w))) AS held FROM t) SELECT id, CASE WHEN held > 0 THEN round(2.0 * (held / len(a)) * (held / len(b)) / (held / len(a) + held / len(b)), 6) ELSE 0 END::DOUBLE AS f1, coalesce((a = b)::INT, 0) AS exact, coalesce(contains(array_to_string(a, ' '), array_to_string(b, ' '))::INT, 0) AS inside FROM s", "said")
def answer_scores(said):
    text = F.when(F.col("id") % 7 == 0, "We decided to go with: building products").when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.col("text"))
    found = evaluation.answer_scores(text, F.lit("we decided to go with building products."))
    return said.select("id", found.alias("s")).select("id", F.round("s.f1", 6).alias("f1"), "s.exact", "s.inside")


_COVERED = f"WITH r AS (SELECT query_id, rank, text FROM ({ORACLE_SQL['memory_or_search']}) JOIN memories USING (id) WHERE rank <= 5), q AS (SELECT query_id, {_ANSWER} AS t FROM (SELECT query_id, array_to_string(list_slice({_TOKENS.format('text')}, 1, 6), ' ') AS text FROM phrases)), m AS (SELECT q.query_id, t, rank, {_ANSWER.replace('text', 'coalesce(text, chr(32))')} AS m FROM q LEFT JOIN r ON q.query_id = r.query_id), h AS (SELECT *, list_filter(t, lambda w: list_contains(m, w)) AS held, len(t) > 0 AND len(list_filter(t, lambda w: list_contains(m, w))) >= 0.5 * len(t) AND rank IS NOT NULL AS ok FROM m), s AS (SELECT query_id, t, bool_or(ok) AS hit, min(CASE WHEN ok THEN rank END) AS first, coalesce(sum(CASE WHEN ok THEN 1 / log2(rank + 1) END), 0) AS dcg, count(*) FILTER (ok) AS n, flatten(list(held)) AS every FROM h GROUP BY 1, 2)"


@query(f"{_COVERED} SELECT query_id, CASE WHEN len(t) = 0 OR hit OR len(list_filter(t, lambda w: list_contains(every, w))) >= 0.7 * len(t) THEN 1 ELSE 0 END::DOUBLE AS recall, round(CASE WHEN len(t) = 0 THEN 1 ELSE coalesce(1.0 / first, 0) END, 6)::DOUBLE AS rr, round(CASE WHEN len(t) = 0 THEN 1 WHEN n = 0 THEN 0 ELSE dcg / list_sum(list_transform(range(1, n + 1), lambda i: 1 / log2(i + 1))) END, 6)::DOUBLE AS ndcg FROM s", "memories", "phrases")
def content_ranking(memories, phrases):
    """Hits of memory_or_search by what they hold of a truth (six tokens of the query)."""
    results = memory_or_search(memories, phrases).join(memories.select("id", "text"), "id").select("query_id", "rank", "text")
    truths = phrases.select("query_id", F.array_join(F.slice(X.tokens(F.col("text")), 1, 6), " ").alias("truth"))
    return evaluation.content_ranking(results, truths, 5)


@query("WITH r AS (SELECT DISTINCT query_id, 'D' || id % 7 || ':' || id AS d FROM lists WHERE rank <= 3), e AS (SELECT item_id AS query_id, 'D' || ((item_id * 3 + k) % 40) % 7 || ':' || (item_id * 3 + k) % 40 AS d FROM benchmark, range(0, 5) t(k) WHERE item_id % 6 <> 0 UNION ALL SELECT item_id, NULL FROM benchmark WHERE item_id % 6 = 0), j AS (SELECT e.query_id, e.d, r.d AS hit, split_part(e.d, ':', 1) IN (SELECT split_part(x.d, ':', 1) FROM r x WHERE x.query_id = e.query_id) AS seen FROM e LEFT JOIN r ON e.query_id = r.query_id AND e.d = r.d) SELECT query_id, round(CASE WHEN count(d) = 0 THEN 1 ELSE count(hit) / count(d) END, 6)::DOUBLE AS dialogs, CASE WHEN count(d) = 0 THEN 1 ELSE max(seen::INT) END AS sessions FROM j GROUP BY 1", "lists", "benchmark")
def dialog_recall(lists, benchmark):
    """Every sixth query has no evidence."""
    name = F.concat(F.lit("D"), (F.col("id") % 7).cast("string"), F.lit(":"), F.col("id").cast("string"))
    gold = _gold(benchmark).where("query_id % 6 <> 0").select("query_id", name.alias("dialog"))
    none = benchmark.where("item_id % 6 = 0").select(F.col("item_id").alias("query_id"), F.lit(None).cast("string").alias("dialog"))
    return evaluation.dialog_recall(lists.select("query_id", "rank", name.alias("dialog")), gold.unionByName(none), 3)


@query(f"WITH m AS (SELECT id, text, category, importance, access_count, created_at, last_accessed, new_tier AS tier, tier AS old FROM (SELECT *, {_NEXT} AS new_tier FROM (SELECT *, {_SCORE} AS score FROM memories))), g AS (SELECT id FROM (SELECT *, {_SCORE} AS score FROM m) WHERE {NOW} - created_at > 30 * 86400000.0 AND importance < 0.4 AND access_count < 2 AND NOT (tier = 'core' OR category IN ('reflection', 'decision') OR coalesce({NOW} - last_accessed <= 7 * 86400000.0, false) OR (tier = 'working' AND score >= 0.1))) SELECT count(*) AS before, sum(({_LEVEL.format('tier')} > {_LEVEL.format('old')})::INT)::BIGINT AS promoted, sum(({_LEVEL.format('tier')} < {_LEVEL.format('old')})::INT)::BIGINT AS demoted, count(*) - CASE WHEN count(*) >= 80 THEN (SELECT count(*) FROM g) ELSE 0 END AS after FROM m", "memories")
def memory_cleanup(memories):
    """Decay, then eviction, with the report of both."""
    return memory.cleaned(memories, NOW, 80)[1]


@query("SELECT collection, count(*) AS docs FROM corpus WHERE active AND substr(collection, length(collection), 1) IN ('1', '3', '5') GROUP BY 1", "corpus")
def default_collections(corpus):
    """Active documents of the collections that are searched by default."""
    listed = corpus.select("collection", F.substring("collection", -1, 1).isin("1", "3", "5").alias("include_by_default")).distinct()
    return catalog.in_collections(catalog.purged(corpus), None, listed).groupBy("collection").agg(F.count("*").alias("docs"))


# Further memory, knowledge and catalogue operators -----------------------------------


@query("WITH g AS (SELECT id FROM memories WHERE category = 'other' AND tier = 'peripheral') SELECT id AS memory_id, 'DELETE' AS action, sha256(text) AS hash FROM memories JOIN g USING (id)", "memories")
def memory_forget_log(memories):
    """History rows of forgotten memories."""
    history = memories.where(F.lit(False)).select(F.col("id").alias("memory_id"), F.lit("").alias("action"), F.col("text").alias("old_value"), F.col("text").alias("new_value"), F.lit(NOW).cast("long").alias("timestamp"))
    log = memory.forgotten_logged(memories, memories.where("category = 'other' and tier = 'peripheral'"), history, NOW)[1]
    return log.select("memory_id", "action", F.sha2("old_value", 256).alias("hash"))


@query(f"WITH k AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {_COS} AS similarity FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND b.vec_id % 100 <> 0), n AS (SELECT * FROM (SELECT *, {_RANK} FROM k WHERE similarity >= 0.3) WHERE rank = 1) SELECT vec_id AS id, n.id AS stored_id, similarity FROM embeddings LEFT JOIN n ON vec_id = query_id WHERE vec_id % 100 = 0", "embeddings")
def memory_store_near(embeddings):
    """New vectors, and those that are near duplicates of stored ones."""
    rows = embeddings.select(F.col("vec_id").alias("id"), "embedding")
    new, near = memory.store_near(rows.where("id % 100 <> 0"), rows.where("id % 100 = 0"), 0.3)
    return new.select("id", F.lit(None).cast("long").alias("stored_id"), F.lit(None).cast("double").alias("similarity")).unionByName(near)


@query("""WITH RECURSIVE e AS (SELECT a.vec_id AS id, a.vec_id % 350 AS t, b.embedding FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id % 350),
p AS (SELECT a.id, b.id AS other, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity, a.t = b.t AS same FROM e a, e b WHERE a.id % 7 <> 0 AND (b.id % 7 = 0 OR b.id < a.id)),
q AS (SELECT * FROM p WHERE same OR similarity >= 0.3), nb AS (SELECT id, list(other) AS near FROM q GROUP BY id),
n AS (SELECT id, row_number() OVER (ORDER BY id) AS i, coalesce(near, []) AS near FROM e LEFT JOIN nb USING (id) WHERE id % 7 <> 0),
r(i, have) AS (SELECT 0::BIGINT, (SELECT list(id) FROM e WHERE id % 7 = 0) UNION ALL SELECT r.i + 1, CASE WHEN list_has_any(r.have, n.near) THEN r.have ELSE list_append(r.have, n.id) END FROM r JOIN n ON n.i = r.i + 1),
k AS (SELECT unnest(have) AS other FROM r WHERE i = (SELECT max(i) FROM r)),
d AS (SELECT id, other, similarity, same, row_number() OVER (PARTITION BY id ORDER BY same DESC, CASE WHEN same THEN other END, similarity DESC, other) AS place FROM q JOIN k USING (other))
SELECT e.id, CASE WHEN d.id IS NULL THEN 'created' ELSE 'duplicate' END AS status, other AS duplicate_id, CASE WHEN NOT same THEN similarity END AS similarity FROM e LEFT JOIN (SELECT * FROM d WHERE place = 1) d USING (id) WHERE e.id % 7 <> 0""", "embeddings")
def memory_store_ordered(embeddings):
    """Texts with vectors come one after the other: created, or duplicates of which."""
    vector = embeddings.select(F.col("vec_id").alias("_of"), "embedding")
    rows = embeddings.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 350).alias("_of")).join(vector, "_of").select("id", F.concat(F.lit("memory "), F.col("_of").cast("string")).alias("text"), "embedding")
    stored = rows.where("id % 7 = 0").withColumn("content_hash", memory.content_hash(F.col("text")))
    return ingest.store_in_order(stored, rows.where("id % 7 <> 0"), NOW, 0.3)[1]


@query("WITH c AS (SELECT id, text, length(text) <= 120 AS short, md5(lower(trim(text))) AS h FROM memories WHERE id % 3 <> 0), k AS (SELECT DISTINCT md5(lower(trim(text))) AS h FROM memories WHERE id % 3 = 0) SELECT id, CASE WHEN c.h IN (SELECT h FROM k) THEN 'duplicate' ELSE 'created' END AS status FROM c WHERE short", "memories")
def memory_store_batch(memories):
    """A batch in chunks of 120 characters: what becomes of the texts of one chunk."""
    hashed = memories.where("id % 3 = 0").withColumn("content_hash", memory.content_hash(F.col("text")))
    incoming = memories.where("id % 3 <> 0").select("id", "text")
    status = memory.store_chunks(hashed, incoming, 120)[1]
    return status.join(incoming.where(F.length("text") <= 120).select("id"), "id")


@query("SELECT text, category, scope::VARCHAR AS scope, round(importance, 6)::DOUBLE AS importance, created_at, md5(lower(trim(text))) AS content_hash FROM memories", "memories")
def memory_transfer(memories):
    """Memories written as JSON lines and read back."""
    return memory.imported(memory.exported(memories)).select("text", "category", "scope", *_r("importance"), "created_at", "content_hash")


_SPOKEN = "SELECT c_custkey AS id, '[1:' || (10 + c_custkey % 50) || CASE c_custkey % 2 WHEN 0 THEN ' pm' ELSE ' am' END || ' on 8 May, 2023] ' || CASE c_custkey % 7 WHEN 6 THEN '' ELSE 'Alice: ' END || CASE c_custkey % 5 WHEN 0 THEN 'I joined a ' || lower(c_mktsegment) || ' group! We moved to Oslo.' WHEN 1 THEN 'I''m a ' || lower(c_mktsegment) || ' buyer, and my kids love ' || c_name || '.' WHEN 2 THEN 'We visited ' || c_name || ' ' || c_custkey % 9 || ' years ago' WHEN 3 THEN 'As a single parent I signed up for a class. I am planning to attend the fair' ELSE 'Nothing to see' END AS text FROM customer"


@query(rf"WITH s AS ({_SPOKEN}), c AS (SELECT id, regexp_extract(text, '\]\s*(\w+):\s*', 1) AS subject, trim(regexp_replace(text, '\[[^\]]*\]\s*\w+:\s*', '')) AS said, epoch_ms(strptime(upper(replace(regexp_extract(text, '\[([^\]]+)\]', 1), ' on ', ' ')), '%I:%M %p %d %B, %Y')) AS valid_from FROM s), t AS (" + " UNION ALL ".join("SELECT id, subject, '{1}' AS predicate, trim(substr(regexp_extract(said, '{0}', 1), 1, 100)) AS object, valid_from FROM c".format(p.replace("'", "''"), name) for p, name in memory.TRIPLE_PATTERNS) + ") SELECT * FROM t WHERE subject <> '' AND object <> ''", "customer")
def rule_triples(customer):
    """Triples out of dialogue lines made of customers."""
    when = F.concat(F.lit("[1:"), (10 + F.col("c_custkey") % 50).cast("string"), F.when(F.col("c_custkey") % 2 == 0, " pm").otherwise(" am"), F.lit(" on 8 May, 2023] "))
    kind, low = F.col("c_custkey") % 5, F.lower("c_mktsegment")
    said = F.when(kind == 0, F.concat(F.lit("I joined a "), low, F.lit(" group! We moved to Oslo.")))
    said = said.when(kind == 1, F.concat(F.lit("I'm a "), low, F.lit(" buyer, and my kids love "), "c_name", F.lit(".")))
    said = said.when(kind == 2, F.concat(F.lit("We visited "), "c_name", F.lit(" "), (F.col("c_custkey") % 9).cast("string"), F.lit(" years ago")))
    said = said.when(kind == 3, "As a single parent I signed up for a class. I am planning to attend the fair").otherwise("Nothing to see")
    texts = customer.select(F.col("c_custkey").alias("id"), F.concat(when, F.when(F.col("c_custkey") % 7 == 6, "").otherwise("Alice: "), said).alias("text"))
    return memory.rule_triples(texts)


@query(f"WITH {_SCD} SELECT c_custkey AS query_id, id, kg.predicate, object FROM (SELECT c_custkey, regexp_replace(trim(lower(c_name)), '[^a-z0-9]+', '_', 'g') AS subject FROM customer WHERE c_custkey % 4 = 0) JOIN kg USING (subject) WHERE valid_until IS NULL", "facts", "customer")
def kg_about(facts, customer):
    """Open facts on every fourth customer."""
    asked = customer.where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("query_id"), F.col("c_name").alias("name"))
    return knowledge.about(knowledge.build(facts), asked)


@query(f"WITH {_SCD}, s AS (SELECT *, CASE id % 4 WHEN 0 THEN 'global' ELSE 's' || id % 4 END AS scope FROM kg), a AS (SELECT r_regionkey::BIGINT AS query_id, CASE r_regionkey % 2 WHEN 0 THEN 's1' ELSE 'global' END AS own, CASE WHEN r_regionkey <> 3 THEN 'ur' END AS part, CASE WHEN r_regionkey > 1 THEN TIMESTAMP '1996-01-01' END AS probe FROM region) SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY valid_from DESC, id) AS rank FROM a JOIN s ON s.scope = own OR s.scope = 'global' WHERE (part IS NULL OR contains(lower(object), part)) AND (probe IS NULL OR ((valid_from IS NULL OR valid_from <= probe) AND (valid_until IS NULL OR probe < valid_until)))) WHERE rank <= 50", "facts", "region")
def kg_scoped(facts, region):
    """Facts of a scope and the shared one, as of a time, by a part of the object."""
    kg = knowledge.build(facts).withColumn("scope", F.when(F.col("id") % 4 == 0, "global").otherwise(F.concat(F.lit("s"), (F.col("id") % 4).cast("string"))))
    at = F.when(F.col("r_regionkey") > 1, F.lit("1996-01-01 00:00:00")).cast(facts.schema["valid_from"].dataType)
    asked = region.select(F.col("r_regionkey").cast("long").alias("query_id"), F.lit(None).cast("string").alias("subject"), F.lit("PRIORITY").alias("predicate"), F.when(F.col("r_regionkey") != 3, "Ur").alias("part"), F.when(F.col("r_regionkey") % 2 == 0, "s1").otherwise("global").alias("scope"), at.alias("at"))
    return knowledge.search_scoped(kg, asked)


@query("WITH c AS (SELECT source, sum(quality)::DOUBLE AS k, count(*)::DOUBLE AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1), w AS (SELECT source, greatest(0, (k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)) AS lo, least(1, (k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)) AS hi FROM c) SELECT a.source AS first, b.source AS second, CASE WHEN a.hi < b.lo OR b.hi < a.lo THEN 'yes' WHEN abs((a.lo + a.hi) / 2 - (b.lo + b.hi) / 2) > greatest(a.hi - a.lo, b.hi - b.lo) / 2 THEN 'marginal' ELSE 'no' END AS apart FROM w a JOIN w b ON a.source < b.source", "labels", "documents")
def wilson_compare(labels, documents):
    """Which sources differ in quality: each pair of them, out of a table of sources."""
    sums = labels.join(documents.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("quality").cast("double").alias("k"), F.count("*").cast("double").alias("n"))
    other = sums.select(F.col("source").alias("second"), F.col("k").alias("k2"), F.col("n").alias("n2"))
    pairs = sums.join(other, F.col("source") < F.col("second"))
    return pairs.select(F.col("source").alias("first"), "second", evaluation.distinguishable(F.col("k"), F.col("n"), F.col("k2"), F.col("n2")).alias("apart"))


@query(f"WITH r AS ({_RULES}) SELECT collection, docs, contexts FROM (SELECT collection, count(*) AS docs FROM corpus WHERE active GROUP BY 1) LEFT JOIN (SELECT collection, string_agg(context, chr(10) ORDER BY length(prefix), prefix) AS contexts FROM r GROUP BY 1) USING (collection)", "corpus")
def briefing(corpus):
    """Collections with their counts and contexts."""
    all_of = corpus.select("collection", F.lit("").alias("prefix"), F.concat(F.lit("all of "), "collection").alias("context")).distinct()
    inside = corpus.where("substr(path, 1, 2) <> 'de'").select("collection", F.substring("path", 1, 3).alias("prefix"), F.concat(F.lit("in "), F.substring("path", 1, 2)).alias("context")).distinct()
    return catalog.briefing(corpus, all_of.unionByName(inside))


@query("SELECT vec_id AS id, CASE WHEN vec_id % 10 = 0 THEN -embedding[1] ELSE embedding[1] END::DOUBLE AS first FROM embeddings WHERE vec_id % 7 <> 3 OR vec_id % 10 = 0", "embeddings")
def vector_upsert(embeddings):
    """A tenth of the vectors replaced; stored ones of another length go."""
    rows = embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    stored = rows.withColumn("embedding", F.when(F.col("id") % 7 == 3, F.slice("embedding", 1, 10)).otherwise(F.col("embedding")))
    new = rows.where("id % 10 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x))
    return vectors.replaced(stored, new).select("id", F.get("embedding", F.lit(0)).alias("first"))


@query("WITH k AS (SELECT conv_id, turn, role, text FROM conversations WHERE length(text) >= CASE WHEN conv_id % 4 = 0 THEN 11 ELSE 10 END) SELECT conv_id AS file, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, CASE WHEN role = 'assistant' THEN role ELSE 'user' END AS role, trim(text) AS text FROM k", "conversations")
def conversation_import(conversations):
    """Conversations written in four export formats and read back."""
    order = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    convs = conversations.select("conv_id", "turn", "role", F.trim("text").alias("text")).groupBy("conv_id").agg(order.alias("m"))
    tree = F.map_from_entries(F.transform("m", lambda m: F.struct(F.concat(F.lit("n"), m["turn"].cast("string")), F.struct(F.struct(F.struct(m["role"].alias("role")).alias("author"), F.struct(F.array(m["text"]).alias("parts")).alias("content")).alias("message")))))
    chat = F.transform("m", lambda m: F.struct(m["role"].alias("sender"), m["text"].alias("text")))
    plain = F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    lines = F.array_join(F.transform(plain, lambda m: F.to_json(m)), "\n")
    kind = F.col("conv_id") % 4
    raw = F.when(kind == 0, F.to_json(F.struct(tree.alias("mapping")))).when(kind == 1, F.to_json(F.struct(chat.alias("chat_messages"))))
    raw = raw.when((kind == 2) | (F.size("m") < 2), F.to_json(plain)).otherwise(lines)
    return formats.conversations(convs.select(F.col("conv_id").alias("file"), raw.alias("raw")))


_BRIDGED = "[" + ", ".join("regexp_extract(text, '{0}', 1)".format(p.replace("'", "''")) for p in lexicons.BRIDGE_PATTERNS) + "]"


@query(f"SELECT id, list_transform(list_filter(list_transform({_BRIDGED}, lambda x: regexp_replace(trim(x), '[.,;!?]+$', '')), lambda x: length(x) >= 5), lambda x: 'User mentioned: ' || x) AS bridges FROM said", "said")
def bridge_texts(said):
    """Sentences that stand for preferences in search."""
    return said.select("id", X.bridges(F.col("text")).alias("bridges"))


@query(r"WITH n AS (SELECT p_partkey AS id, lower(replace('Parts___' || p_brand || '/-' || p_name || CASE p_partkey % 3 WHEN 0 THEN '.md' WHEN 1 THEN ' (x).TXT' ELSE '' END, '___', '/')) AS low FROM part), s AS (SELECT id, string_split(low, '/') AS parts, regexp_extract(low, '(\.[a-z0-9]+)$', 1) AS ext FROM n), c AS (SELECT id, list_transform(parts[:-2], lambda x: regexp_replace(regexp_replace(x, '[^\p{L}\p{N}$]+', '-', 'g'), '^-+|-+$', '', 'g')) AS head, regexp_replace(regexp_replace(left(parts[-1], length(parts[-1]) - length(ext)), '[^\p{L}\p{N}$]+', '-', 'g'), '^-+|-+$', '', 'g') || ext AS name FROM s) SELECT id, array_to_string(list_append(list_filter(head, lambda x: x <> ''), name), '/') AS path FROM c", "part")
def normal_paths(part):
    """Paths made of part names, normalised."""
    end = F.when(F.col("p_partkey") % 3 == 0, ".md").when(F.col("p_partkey") % 3 == 1, " (x).TXT").otherwise("")
    path = F.concat(F.lit("Parts___"), "p_brand", F.lit("/-"), "p_name", end)
    return part.select(F.col("p_partkey").alias("id"), X.path_name(path).alias("path"))


@query(f"SELECT id AS memory_id, 'EVICT' AS action, {NOW} AS timestamp FROM ({ORACLE_SQL['eviction_candidates']})", "memories")
def memory_evict_log(memories):
    """History rows of evicted memories."""
    history = memories.where(F.lit(False)).select(F.col("id").alias("memory_id"), F.lit("").alias("action"), F.col("text").alias("old_value"), F.col("text").alias("new_value"), F.lit(NOW).cast("long").alias("timestamp"))
    return memory.evict(memories, history, NOW)[1].select("memory_id", "action", "timestamp")


# Streams, over a whole table at once -------------------------------------------------


@query("SELECT user_id, date_trunc('hour', ts) AS start, count(*) AS accesses FROM events GROUP BY 1, 2", "events")
def access_windows(events):
    return access.access_counts(events, window="1 hour").select("user_id", F.col("w.start").alias("start"), "accesses")


@query("WITH n AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE, true)::INT AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM n) SELECT user_id, min(ts) AS start, count(*) AS accesses FROM s GROUP BY user_id, session", "events")
def user_sessions(events):
    return access.sessions(events).select("user_id", F.col("w.start").alias("start"), "accesses")
