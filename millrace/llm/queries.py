"""One query for each operator, over its whole table, and DuckDB's SQL for it where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import ann, centroids, chat, classifier, html, mixing, odd_sketch, packing, repair, rules, simhash, token_files, warc
from millrace.llm.common import load, shared_folder, staged


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(load(spark, sf_dir, "conversations"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(load(spark, sf_dir, "documents")).drop("n_lines", "n_stop_words")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write_token_files(load(spark, sf_dir, "documents"), path)
    return token_files.read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op6_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages against a replica in which some records were changed, cut short or lost."""
    pages = warc.records(load(spark, sf_dir, "pages"))
    size = F.octet_length("record")
    cut, changed = F.substring("record", 1, 20), F.concat(F.substring(F.col("record"), F.lit(1), size - 1), F.lit("X").cast("binary"))
    other = F.when(F.col("page_id") % 119 == 3, cut).when(F.col("page_id") % 50 == 7, changed).otherwise(F.col("record"))
    both = pages.select("page_id", size.cast("long").alias("bytes"), F.sha2("record", 256).alias("digest"), F.octet_length(other).cast("long").alias("bytes_b"), F.sha2(other, 256).alias("digest_b"))
    rows = staged(warc.placed(both), "archives")
    there = F.coalesce(F.col("page_id") % 83 != 11, F.lit(True))
    replica = rows.where(there).select("archive", "offset", F.col("bytes_b").alias("bytes"), F.col("digest_b").alias("digest"))
    found = warc.audit(rows, replica)
    return found.join(rows.select("archive", "offset", "page_id"), ["archive", "offset"]).select("page_id", "bytes", "status", "good_digest", "other_digest")


def op7_one_bit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_digests(load(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(load(spark, sf_dir, "pages"))


def op11_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_sketch.near_duplicates(load(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = load(spark, sf_dir, "conversations")
    return repair.audits(repair.damage(conversations), conversations)


def op13_sharded_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.lloyd(load(spark, sf_dir, "embeddings"))


def _quality_sql() -> str:
    stop = ", ".join("'" + w + "'" for w in dict.fromkeys(rules.STOP_WORDS))
    flags = rules.verdicts()
    return f"""
WITH t AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT k, doc_id, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM t
), win AS (
  SELECT k, i, array_to_string(ws[i:i + 7], ' ') AS s FROM (SELECT k, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
), twice AS (
  SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, s) AS c FROM win) WHERE c > 1
), covered AS (
  SELECT k, count(DISTINCT i + j) AS n FROM twice, range(0, 8) AS r(j) GROUP BY k
), c AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(list_filter(ws, lambda x: x IN ({stop}))) AS BIGINT) AS n_stop_words
  FROM w LEFT JOIN covered USING (k)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {rules.BASE_FAILED} AS base_failed,
       NOT {rules.BASE_FAILED} AND {" AND ".join(flags.values())} AS kept, {", ".join(f"{c} AS rule_{n}" for n, c in flags.items())}
FROM c"""


_AUDIT_SQL = """
WITH r AS (
  SELECT page_id, 'WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>\r\nWARC-Target-URI: ' || coalesce(url, '')
         || '\r\nContent-Type: text/html\r\nContent-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR) || '\r\n\r\n' || coalesce(html, '') || '\r\n\r\n' AS rec FROM pages
), b AS (
  SELECT page_id, rec, CASE WHEN page_id % 83 = 11 THEN NULL WHEN page_id % 119 = 3 THEN substr(rec, 1, 20) WHEN page_id % 50 = 7 THEN substr(rec, 1, length(rec) - 1) || 'X' ELSE rec END AS other FROM r
)
SELECT page_id, CAST(strlen(rec) AS BIGINT) AS bytes, CASE WHEN other IS NULL THEN 'missing' ELSE 'corrupt' END AS status, sha256(rec) AS good_digest, sha256(other) AS other_digest
FROM b WHERE other IS DISTINCT FROM rec""".replace("\r\n", "' || chr(13) || chr(10) || '")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_chat_format, op2_quality_rules, op3_token_files, op4_mixing, op5_quality_classifier, op6_merkle_audit, op7_one_bit_search, op8_packing, op9_simhash, op10_html_text, op11_odd_sketch, op12_conversation_repair, op13_sharded_lloyd)
}

SQL: dict[str, str] = {"op1_chat_format": chat.SQL, "op2_quality_rules": _quality_sql(), "op6_merkle_audit": _AUDIT_SQL, "op11_odd_sketch": odd_sketch.SQL, "op12_conversation_repair": repair.SQL, "op13_sharded_lloyd": centroids.sql()}
