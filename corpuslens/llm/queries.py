"""The registered queries of these operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpuslens.llm import (
    decontamination, filter_audit, language_id, license_scan, mixing, near_dedup, quality_rules, sharding, substring_dedup, token_count,
    token_files, warc, whitening,
)

Query = Callable[[SparkSession, str], DataFrame]

BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _of_documents(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_near_dedup": _of_documents(near_dedup.near_duplicates),
    "op2_hilbert_shards": _of_documents(sharding.hilbert_shards),
    "op3_token_blocks": _of_documents(lambda d: token_files.token_digest(d, public_tokenizers.path(BYTE_BPE))),
    "op4_source_mix": _of_documents(mixing.mixture),
    "op5_decontamination": lambda spark, sf_dir: decontamination.matches(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    ),
    "op6_substring_dedup": _of_documents(substring_dedup.removal_digest),
    "op7_license_scan": _of_documents(license_scan.licenses),
    "op8_token_counts": _of_documents(lambda d: token_count.token_counts(d, public_tokenizers.path(PIECES))),
    "op9_quality_rules": _of_documents(quality_rules.quality),
    "op10_language_id": _of_documents(language_id.languages),
    "op11_warc": lambda spark, sf_dir: warc.archive_digest(table(spark, sf_dir, "pages")).drop("target_uri"),
    "op12_whitening": lambda spark, sf_dir: whitening.whitened(table(spark, sf_dir, "embeddings")),
    "op13_filter_audit": lambda spark, sf_dir: filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_SOURCE_MIX = rf"""
WITH d AS (
  SELECT doc_id, source, len({_WORDS}) AS size, coalesce(md5(text), '') AS digest FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w
  FROM d GROUP BY source
), r AS (
  SELECT *, sum(source_size) OVER () AS total,
         row_number() OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST) AS k,
         coalesce(sum(source_size) OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(w) OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w
  FROM s
), l AS (
  SELECT coalesce(arg_min((total - 3.0::DOUBLE * capped) / open_w, k)
                  FILTER (WHERE (total - 3.0::DOUBLE * capped) / open_w * w <= 3.0::DOUBLE * source_size), 0) AS share FROM r
), t AS (
  SELECT source, source_size, least(w * share, 3.0::DOUBLE * source_size)::DOUBLE AS target FROM s, l
), u AS (
  SELECT source, doc_id, digest, count(*) * max(size) AS unit_size,
         md5('mix:17:' || coalesce(doc_id::VARCHAR, '') || ':' || digest) AS h
  FROM d GROUP BY source, doc_id, digest
), k AS (
  SELECT u.*, source_size, target, row_number() OVER (PARTITION BY u.source ORDER BY unit_size, h) - 1 AS k,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('mix-offset:17:' || (u.source IS NULL)::VARCHAR || ':' || coalesce(u.source, '')), 1, 8))::UBIGINT
           / 4294967296.0::DOUBLE AS o
  FROM u JOIN t ON u.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, (floor(rate) + floor((k + 1) * (rate - floor(rate)) + o) - floor(k * (rate - floor(rate)) + o))::INTEGER AS copies FROM k
)
SELECT d.doc_id, size::BIGINT AS size, source_size, target, (size * copies)::BIGINT AS taken, copies
FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.doc_id IS NOT DISTINCT FROM c.doc_id AND d.digest = c.digest
"""

_SUBSTRING_DEDUP = rf"""
WITH d AS (
  SELECT doc_id, {_WORDS} AS words FROM documents
), w AS (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS run
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM d)
), f AS (
  SELECT run, min(doc_id) AS low FROM w GROUP BY run
), hit AS (
  SELECT DISTINCT w.doc_id, w.i + j AS pos FROM w JOIN f USING (run), range(0, 13) AS o(j) WHERE f.low < w.doc_id
), word AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM d
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n
  FROM word ANTI JOIN hit USING (doc_id, pos) GROUP BY doc_id
)
SELECT d.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_STOPS = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)

_QUALITY_RULES = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents
), w AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS run
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM d)
), again AS (
  SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY doc_id, run) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM again, range(0, 8) AS o(j) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(words, lambda x: lower(x) IN ({_STOPS}))) AS n_stop
  FROM d LEFT JOIN covered USING (doc_id)
), v AS (
  SELECT *, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
), b AS (
  SELECT *, concat_ws(',',
    CASE WHEN n_words < 20 OR n_words > 1000000 THEN 'n_words' END,
    CASE WHEN CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END NOT BETWEEN 2 AND 20 THEN 'mean_word_chars' END,
    CASE WHEN n_words > 0 AND n_symbols / n_words > 0.4::DOUBLE THEN 'symbols_per_word' END,
    CASE WHEN CASE WHEN n_words > 0 THEN n_stop / n_words ELSE 0 END < 0.01::DOUBLE THEN 'stop_share' END,
    CASE WHEN len(lines) > 0 AND n_dup_lines / len(lines) > 0.6::DOUBLE THEN 'dup_line_share' END,
    CASE WHEN n_words > 0 AND n_repeat_words / n_words > 0.3::DOUBLE THEN 'repeat_share' END) AS broken FROM v
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND broken = '' AS kept, broken FROM b
"""

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_FIVE_BITS = " || ".join(
    f"substr('{_BASE32}', 1 + (('0x' || substr(h, {5 * (k // 4) + 1}, 5))::INTEGER >> {15 - 5 * (k % 4)}) % 32, 1)" for k in range(32)
)

_WARC = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), n AS (
  SELECT html, max(page_id) AS newest FROM p GROUP BY html
), r AS (
  SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_FIVE_BITS} AS payload_digest,
         CASE WHEN newest > coalesce(page_id, -9223372036854775808) THEN newest END AS refers_to
  FROM p JOIN n USING (html)
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r
"""

_FAILS = " + ".join(f"(fail_{c})::INTEGER * {1 << i}" for i, c in enumerate(filter_audit.FILTERS))

_FILTER_AUDIT = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part, {_WORDS} AS words FROM documents
), firsts AS (
  SELECT text, min(doc_id) AS first_id FROM d GROUP BY text
), l AS (
  SELECT doc_id, max(coalesce(quality = 1, false)::INTEGER) AS good, max(coalesce(toxic = 1, false)::INTEGER) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         len(words) < 200 AS fail_A, 100 * len(list_distinct(words)) < 50 * len(words) AS fail_B,
         100 * len(regexp_extract_all(d.text, '[A-Z]')) > 2 * length(d.text) AS fail_C,
         regexp_matches(d.text, '[#$%&*|]') AS fail_D,
         first_id IS NOT NULL AND (d.doc_id IS NULL OR first_id < d.doc_id) AS fail_E
  FROM d JOIN firsts ON d.text = firsts.text LEFT JOIN l ON d.doc_id = l.doc_id
), m AS (
  SELECT part, {_FAILS} AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask
), c AS (
  SELECT i, substr('ABCDE', i + 1, 1) AS letter FROM range(0, 5) AS r(i)
), o AS (
  SELECT '' AS done, 0 AS used
  UNION ALL
  SELECT done || letter, used + (1 << i::INTEGER) FROM o, c WHERE (used >> i::INTEGER) % 2 = 0
), s AS (
  SELECT w.done AS filter_order, c.letter, 1 << c.i::INTEGER AS bit, instr(w.done, c.letter) AS step
  FROM o AS w, c WHERE length(w.done) = 5
), b AS (
  SELECT s.filter_order, s.step, s.letter, s.bit, o.used AS earlier
  FROM s JOIN o ON o.done = substr(s.filter_order, 1, s.step - 1)
), t AS (
  SELECT part, filter_order, step, letter,
         coalesce(sum(n) FILTER (WHERE mask & (earlier | bit) = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (WHERE mask & earlier = 0 AND mask & bit > 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (WHERE mask & earlier > 0 AND mask & bit > 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (WHERE mask = bit), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (WHERE mask & earlier = 0 AND mask & bit > 0), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (WHERE mask & earlier = 0 AND mask & bit > 0), 0)::BIGINT AS toxic_lost
  FROM m, b GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM t
"""

#: The others have no SQL: they hash or code in ways DuckDB lacks, or learn; tests/llm compares them with brute force.
ORACLE_SQL: dict[str, str] = {
    "op4_source_mix": _SOURCE_MIX, "op6_substring_dedup": _SUBSTRING_DEDUP, "op9_quality_rules": _QUALITY_RULES,
    "op11_warc": _WARC, "op13_filter_audit": _FILTER_AUDIT,
}
