"""The registered queries of this subpackage and the SQL that checks those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, exact_dedup, license_scan, line_dedup, mixing, ngram_join, packing, quality_classifier, quality_rules, warc
from .common import LOWER, UPPER


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines_digests(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup_digests(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chat(table(spark, sf_dir, "conversations"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scanned(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_line_dedup, op2_best_fit_packing, op3_exact_dedup, op4_ngram_jaccard_join, op5_quality_rules, op6_source_mixing, op7_quality_classifier, op8_chat_formatting, op9_warc, op10_license_scan)}

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_RUN = r"'[\x20\x09-\x0D]+'"


def _lower(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


OP1 = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
k AS (SELECT doc_id, line, i, {_lower(f"trim(line, {_WS})")} AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.line, k.i, c.key IS NOT NULL AND k.doc_id < c.last AS dropped FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP3 = f"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), {_RUN}, ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""

OP5 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, {_RUN}), lambda x: x <> '') AS words,
  list_filter(string_split(t, chr(10)), lambda x: trim(x, {_WS}) <> '') AS lines FROM d),
g AS (SELECT doc_id, unnest(range(1, len(words) - 3)) AS i, words FROM w WHERE len(words) >= 5),
h AS (SELECT doc_id, i, list_slice(words, i, i + 4) AS gram FROM g),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM h),
p AS (SELECT DISTINCT doc_id, i + k AS at FROM r, (SELECT unnest(range(5)) AS k) WHERE n > 1),
q AS (SELECT doc_id, count(*) AS n_repeat_words FROM p GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(regexp_extract_all(t, '!!'))::BIGINT AS n_shouts
  FROM w LEFT JOIN q ON w.doc_id = q.doc_id),
b AS (SELECT *, ({" + ".join(f"CASE WHEN {r.fails} THEN {1 << k} ELSE 0 END" for k, r in enumerate(quality_rules.RULES))})::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {quality_rules.mask("base_v1")}) <> 0 AS base_failed,
  (fail_bits & {quality_rules.mask("quality_v1")}) = 0 AS kept, fail_bits, n_shouts FROM b
"""

OP9 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
s AS (SELECT page_id, t, sha1(t) AS hex, max(page_id) OVER (PARTITION BY t) AS last FROM p)
SELECT page_id, strlen(t)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
FROM s
"""

_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _op10() -> str:
    phrases = " UNION ALL ".join(
        f"SELECT doc_id, i AS pos, '{label}' AS label FROM a WHERE " + " AND ".join(f"words[i + {k + 1}] = '{x}'" for k, x in enumerate(p)) for p, label in license_scan.PHRASES.items())
    rows = []
    for k, (label, text) in enumerate(license_scan.TEMPLATES):
        t = sorted(set(license_scan.tokens(text)))
        need = -(-8 * len(t) // 10)
        rows.append(f"({k}, '{label}', {t!r}, {need})")
    return f"""
WITH d AS (SELECT doc_id, {_lower("coalesce(text, '')")} AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, {_WORDS}) AS words FROM d),
a AS (SELECT doc_id, words, unnest(range(len(words))) AS i FROM w WHERE list_contains(words, 'license')),
p AS ({phrases}),
b AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY doc_id),
l AS (SELECT doc_id, list_distinct(regexp_extract_all(unnest(string_split(t, chr(10))), {_WORDS})) AS block FROM w),
t AS (SELECT * FROM (VALUES {", ".join(rows)}) AS v(k, label, items, need)),
h AS (SELECT doc_id, label, len(list_intersect(block, items)) AS hits, len(items) AS n, need FROM l, t WHERE len(block) >= need),
m AS (SELECT doc_id, label, hits / n AS c FROM h WHERE hits >= need),
e AS (SELECT doc_id, label, 1.0 AS c FROM p UNION ALL SELECT doc_id, label, c FROM m),
s AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(c) AS c FROM e GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  coalesce(c, 0)::DOUBLE AS score FROM w LEFT JOIN b ON w.doc_id = b.doc_id LEFT JOIN s ON w.doc_id = s.doc_id
"""


ORACLE = {"op1_line_dedup": OP1, "op3_exact_dedup": OP3, "op5_quality_rules": OP5, "op9_warc": OP9, "op10_license_scan": _op10()}
