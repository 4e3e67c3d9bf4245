"""The registered queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, jaccard, langid, linededup, mixing, quality, sharding, shared, urlfilter, warc

#: Fixed by the contract of op2: (host, path, verdict).
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
PROBE = "</s>[INST] ok [/INST]"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return shared.bound_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~langid.held_out() & F.col("doc_id").isNotNull()))
    found = langid.identify(docs.select("doc_id", "text", langid.held_out().alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


def op3_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(_table(spark, sf_dir, "pages"))


def op4_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.coalesce("text", F.lit(""))
    rows = _table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    out = sharding.shard_rows(rows, 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.JaccardJoin(_table(spark, sf_dir, "documents"), k=3, num=90).components()


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.without_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    size = F.coalesce(F.length("clean_text"), F.lit(0)).cast("long")
    return out.select("doc_id", "n_lines", "n_removed_lines", size.alias("clean_chars"), F.crc32(F.coalesce("clean_text", F.lit("")).cast("binary")).alias("clean_crc32"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.clean(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost_words")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(turns.unionByName(probe))).drop("error")


QUERIES = {f.__name__: f for f in (op1_language_id, op2_url_filter, op3_warc_index, op4_shard, op5_ngram_jaccard, op6_line_dedup, op7_decontaminate, op8_mix, op9_quality, op10_chat)}

_OP2 = r"""
WITH cut AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
urls AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(rhost, rpath, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
fits AS (SELECT page_id, host, path, rhost || rpath AS rule, verdict FROM urls LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) = 1
"""

_OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages)
SELECT page_id, CASE WHEN page_id = min(page_id) OVER same THEN 'response' ELSE 'revisit' END AS record_type,
  CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  CASE WHEN page_id = min(page_id) OVER same THEN NULL ELSE min(page_id) OVER same END AS refers_to,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(('0b' || substr(list_aggregate(list_transform(range(40), lambda j: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', substr(sha1(html), CAST(j + 1 AS INTEGER), 1))]), 'string_agg', ''), CAST(5 * i + 1 AS INTEGER), 5)) AS INTEGER) + 1, 1)), 'string_agg', '') AS payload_digest
FROM p WINDOW same AS (PARTITION BY html)
"""

_OP9 = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
w AS (SELECT doc_id, body, list_filter(regexp_extract_all(body, '[^\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM t),
win AS (SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS line FROM t),
full_ AS (SELECT doc_id, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
per AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dups, coalesce(sum(n) FILTER (WHERE NOT regexp_matches(line, '[.!?;:…。！？](["'')\]”’»]*[\x20\x09-\x0D]|["'')\]”’»]*$)')
  OR regexp_matches(line, '([|»›•·→][\x20\x09-\x0D]+[^|»›•·→]{1,40}){3,}')
  OR regexp_matches(line, '^[\x20\x09-\x0D]*([^>/|]{1,30}[\x20\x09-\x0D](>|/|::)[\x20\x09-\x0D]){2,}[^>/|]{1,40}$')
  OR regexp_matches(line, '(?i)^[\x20\x09-\x0D]*(page|seite|página) [0-9]+ (of|de|von|sur) [0-9]+')
  OR length(line) <= 240 AND len(list_filter([PHRASES], lambda p: contains(lower(line), p))) > 0), 0) AS lost
  FROM full_ GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(body) - length(translate(body, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(coalesce(dups, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost, 0) AS BIGINT) AS n_lost_words
  FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN per USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_lost_words <= 50 * n_words AS kept FROM m
""".replace("PHRASES", ", ".join("'" + p + "'" for p in quality.BOILERPLATE))

_OP10 = r"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS body FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
s AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, body) AS before,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, body DESC) AS back,
  length(regexp_replace(body, '(<)(\\*)(/?s>)|(\[)(\\*)(/?(?:SYS|INST|ROLE)\]|OUT\]|/TURN\])', '\1\2\4\5\\\3\6', 'g')) AS escaped FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || body || chr(10), '' ORDER BY turn, role, body)) AS turns_sha256,
  CAST(coalesce(sum(length(body)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(body, '' ORDER BY turn, role, body) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(escaped + CASE role WHEN 'system' THEN 17 WHEN 'user' THEN 19 WHEN 'assistant' THEN 15 END) AS BIGINT) AS formatted_chars,
  bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before = 'system' OR before = 'assistant' THEN role = 'user' ELSE role = 'assistant' END
    AND (back > 1 OR role = 'assistant')) AS valid
FROM s GROUP BY conv_id
"""

ORACLE_SQL = {"op2_url_filter": _OP2, "op3_warc_index": _OP3, "op9_quality": _OP9, "op10_chat": _OP10}
