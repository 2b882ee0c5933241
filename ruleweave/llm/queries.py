"""The operators' queries over the tables of a folder, and SQL for those that it can express."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleweave.llm import decontam, line_dedup, packing, parity_join, quality, reshard, rule_ledger, secret_scan, token_count, toxicity
from ruleweave.llm.common import checkpoint_folder, table

CAPACITY, END_ID = 4096, 1


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rule_ledger.apply_policy(rule_ledger.ledger(table(spark, sf_dir, "documents")), rule_ledger.STRICT_POLICY)
    base = F.col("failed").bitwiseAND(F.lit(rule_ledger.BASE_POLICY.mask())) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed")


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secret_scan.scan(table(spark, sf_dir, "documents"))
    base, both = secret_scan.joined(F.col("base")), secret_scan.joined(F.concat("base", "added"))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(base, 256).alias("base_sha256"), both.alias("spans"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.near_duplicates(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_folder(spark)}/shards-{uuid.uuid4().hex}"
    placed = reshard.reshard_files(table(spark, sf_dir, "documents").select("doc_id", "text"), folder, shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), END_ID, CAPACITY)
    return packing.pack(cut, CAPACITY)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_benchmark_decontamination, op3_quality_rules, op4_secret_scans, op5_line_dedup, op6_token_counts, op7_ngram_jaccard_join, op8_sharding, op9_best_fit_packing, op10_toxicity)}

_WORD = r"[^\x20\x09-\x0D]+"
_GAPS = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE_SQL = {
    "op3_quality_rules": rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {_GAPS}) <> '') AS l
  FROM documents
), win AS (
  SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3
), again AS (
  SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) > 1
), covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines, len(regexp_extract_all(t, '\p{{Lu}}'))::BIGINT AS n_upper
  FROM d LEFT JOIN covered USING (r)
), f AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
         (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (word_chars < 2 * n_words)::BIGINT
         + 8 * (word_chars > 20 * n_words)::BIGINT + 16 * (10 * n_symbols > 3 * n_words)::BIGINT
         + 32 * (100 * n_dup_lines > 50 * n_lines)::BIGINT + 64 * (100 * n_upper > 50 * word_chars)::BIGINT AS failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed = 0 AS kept, failed FROM f
""",
    "op5_line_dedup": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
pages AS (SELECT DISTINCT coalesce('h' || source, 'none') AS host, coalesce(text, '') AS t FROM d),
totals AS (SELECT host, count(*) AS total FROM pages GROUP BY host),
seen AS (SELECT DISTINCT host, t, trim(unnest(string_split(t, chr(10))), {_GAPS}) AS k FROM pages),
boiler AS (
  SELECT host, k FROM (SELECT host, k, count(*) AS n FROM seen WHERE k <> '' GROUP BY host, k) JOIN totals USING (host)
  WHERE n >= 5 AND n > 0.0625 * total
),
lines AS (
  SELECT r, host, i, x, trim(x, {_GAPS}) AS k
  FROM (SELECT r, coalesce('h' || source, 'none') AS host, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d WHERE text IS NOT NULL)
),
marked AS (SELECT l.*, b.k IS NOT NULL AS bad FROM lines l LEFT JOIN boiler b ON l.host = b.host AND l.k = b.k),
cut AS (
  SELECT r, count(*) FILTER (k <> '') AS n_lines, count(*) FILTER (bad) AS n_bad, count(*) FILTER (NOT bad AND k <> '') AS n_good,
         string_agg(x, chr(10) ORDER BY i) FILTER (NOT bad) AS cleaned
  FROM marked GROUP BY r
)
SELECT doc_id, source, CASE WHEN n_bad > 0 AND n_good > 0 THEN cleaned ELSE text END AS text,
       coalesce(n_lines, 0)::BIGINT AS n_lines, CASE WHEN n_good > 0 THEN n_bad ELSE 0 END::BIGINT AS n_dropped
FROM d LEFT JOIN cut USING (r)
""",
}
