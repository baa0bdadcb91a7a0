"""The registered queries ``opN_<name>`` over the whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import bpe_lexicon, chat_format, exact_dedup, line_dedup, lm_scoring, mixing, quality_rules, simhash, suffix_dedup, token_binary, toxicity, turn_repair, whitening
from larkspur.llm.shared import shared_path, table

#: Words by the contract, in DuckDB.
WORD = r"[^\x20\x09-\x0D]+"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_binary(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    path = shared_path(spark, "token-blocks")
    token_binary.write_token_file(table(spark, sf_dir, "documents"), path, tokenizer or tokenizer_path("word_bpe_49k.json"))
    return token_binary.read_documents(spark, path)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    names = {"n_words": "n_words", "word_chars": "word_chars", "n_symbols": "n_symbols", "n_dup_lines": "n_dup_lines", "n_repeat_words": "n_repeat_words", "fails_base": "base_failed", "kept": "kept", "rate_base": "host_fail_rate"}
    return judged.select("doc_id", *[F.col("_q_" + a).alias(b) for a, b in names.items()]).withColumn("host_fail_rate", F.round("host_fail_rate", 6))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = "</s>[INST] ok [/INST]"
    turns = chat_format.turns_of_table(table(spark, sf_dir, "conversations"))
    extra = spark.createDataFrame([(-7, 0, "user", told), (-7, 1, "assistant", told)], "conv_id long, turn long, role string, text string")
    path = shared_path(spark, "chat")
    chat_format.formatted(turns.unionByName(extra)).write.parquet(path)
    return chat_format.read_back(spark.read.parquet(path))


def op4_bpe_lexicon(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe_lexicon.encoded(docs, tokenizer or tokenizer_path("byte_bpe_50k.json"), ["doc_id"], digest=True)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "exact-index")
    exact_dedup.build_index(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return exact_dedup.groups(spark, path).select("member.doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    return cut.select("row.doc_id", "kept.n_lines", "kept.n_dropped", F.sha2("kept.text", 256).alias("kept_sha256"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.digests(turn_repair.damaged(table(spark, sf_dir, "conversations")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_token_binary, op2_quality_rules, op3_chat_format, op4_bpe_lexicon, op5_suffix_dedup, op6_mixing, op7_simhash, op8_lm_scoring, op9_toxicity, op10_exact_dedup, op11_whitening, op12_line_dedup, op13_turn_repair, pipeline)}

_BREAK = r"[\x20\x09-\x0D]+"
_ESCAPED = "replace({0}, '\\', '\\\\')"
for _c in chat_format.CONTROL:
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{_c[0]}\\{_c[1:]}')"
_MARKS = sum(map(len, (chat_format.TURN, chat_format.BODY, chat_format.END)))

ORACLE_SQL = {
    "op2_quality_rules": rf"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{_BREAK}'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln
  FROM documents),
wins AS (
  SELECT doc_id, i, list_slice(w, i, i + 7) AS win FROM base, unnest(range(1, greatest(len(w) - 6, 1))) r(i)),
rep AS (SELECT doc_id, win FROM wins GROUP BY doc_id, win HAVING count(*) > 1),
hit AS (SELECT DISTINCT wins.doc_id, i + o AS at FROM wins JOIN rep USING (doc_id, win), range(0, 8) q(o)),
rw AS (SELECT doc_id, count(*) AS n FROM hit GROUP BY doc_id),
m AS (
  SELECT b.doc_id, source, len(w) AS n_words, length(regexp_replace(t, '{_BREAK}', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ln) - len(list_distinct(ln)) AS n_dup_lines, len(ln) AS n_lines, coalesce(rw.n, 0) AS n_repeat_words
  FROM base b LEFT JOIN rw USING (doc_id)),
f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS f_base, 10 * n_symbols > n_words AS f_symbols,
         10 * n_dup_lines > 3 * n_lines AS f_dup_lines, word_chars < 2 * n_words OR word_chars > 20 * n_words AS f_word_length
  FROM m),
h AS (
  SELECT source, count(*) AS n, sum(f_base::int) AS f_base, sum(f_symbols::int) AS f_symbols, sum(f_dup_lines::int) AS f_dup_lines, sum(f_word_length::int) AS f_word_length
  FROM f GROUP BY source),
r AS (SELECT source, n, unnest([struct_pack(k := 'base', f := f_base), struct_pack(k := 'symbols', f := f_symbols), struct_pack(k := 'dup_lines', f := f_dup_lines), struct_pack(k := 'word_length', f := f_word_length)], recursive := true) FROM h),
p AS (SELECT k, avg(f / n) AS mean, var_pop(f / n) AS v FROM r GROUP BY k),
s AS (SELECT k, mean, CASE WHEN v > 0 THEN least(1000.0, greatest(1.0, mean * (1 - mean) / v - 1)) ELSE 1000.0 END AS strength FROM p),
post AS (SELECT source, k, (f + mean * strength) / (n + strength) AS rate FROM r JOIN s USING (k)),
verdict AS (SELECT source, max(CASE WHEN k = 'base' THEN rate END) AS rate, bool_and(rate <= 0.5) AS ok FROM post GROUP BY source)
SELECT f.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, f_base AS base_failed, NOT f_base AND ok AS kept, round(rate, 6) AS host_fail_rate
FROM f JOIN verdict v ON f.source IS NOT DISTINCT FROM v.source""",
    "op3_chat_format": f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum({_MARKS} + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id""",
    "op10_exact_dedup": """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents""",
    "op12_line_dedup": f"""
WITH l AS (SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) r(i)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{line_dedup.UPPER}', '{line_dedup.LOWER}') AS k FROM l),
f AS (SELECT k, max(doc_id) AS last FROM k WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, sum(coalesce(doc_id <> last, false)::INT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT coalesce(doc_id <> last, false)), '')) AS kept_sha256
FROM k LEFT JOIN f USING (k) GROUP BY doc_id""",
}
