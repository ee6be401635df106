"""op7: judge all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.quality import judge_quality
from lodestar.sources.tables import read_table


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return judge_quality(docs, keep=["doc_id"]).withColumn("quality", F.round("quality", 6))


QUERIES = {"op7_quality_rules": op7_quality_rules}

#: The order of the rules in the SQL below is that of RULES; START and PSEUDO are written out.
ORACLE_SQL = {
    "op7_quality_rules": r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
word AS (SELECT row, unnest(words) AS a, generate_subscripts(words, 1) AS n FROM w),
tri AS (SELECT row, n, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM word WINDOW o AS (PARTITION BY row ORDER BY n)),
twice AS (SELECT row, n, c IS NOT NULL AND count(*) OVER (PARTITION BY row, a, b, c) > 1 AS again FROM tri),
covered AS (SELECT row, bool_or(again) OVER (PARTITION BY row ORDER BY n ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hit FROM twice),
repeats AS (SELECT row, count(*) FILTER (hit) AS n_repeat_words FROM covered GROUP BY row),
f AS (
  SELECT w.row, doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: len(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(regexp_extract_all(t, '[A-Z]')) AS n_capitals,
         len(regexp_extract_all(t, '!')) AS n_exclamations, len(regexp_extract_all(t, '[0-9]')) AS n_digits
  FROM w LEFT JOIN repeats r ON r.row = w.row),
g AS (SELECT *, len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
v AS (
  SELECT *, CASE WHEN n_words = 0 THEN [1, 1, 1, 1, 1, 1, 1, 1, 1, 1] ELSE [
    CASE WHEN n_symbols >= 0.10::DOUBLE * n_words THEN 0 ELSE 1 END, CASE WHEN n_dup_lines >= 0.20::DOUBLE * n_lines THEN 0 ELSE 1 END,
    CASE WHEN n_repeat_words >= 0.40::DOUBLE * n_words THEN 0 ELSE 1 END, CASE WHEN n_capitals >= 0.30::DOUBLE * word_chars THEN 0 ELSE 1 END,
    CASE WHEN n_exclamations >= 0.20::DOUBLE * n_words THEN 0 ELSE 1 END, CASE WHEN n_digits >= 0.20::DOUBLE * word_chars THEN 0 ELSE 1 END,
    CASE WHEN word_chars >= 16 * n_words THEN 0 ELSE 1 END, CASE WHEN word_chars <= 2 * n_words THEN 0 ELSE 1 END,
    CASE WHEN n_symbols <= 0.02::DOUBLE * n_words AND n_capitals <= 0.12::DOUBLE * word_chars AND n_exclamations <= 0.05::DOUBLE * n_words AND n_digits <= 0.05::DOUBLE * word_chars THEN 2 ELSE 1 END,
    CASE WHEN n_symbols <= 0.05::DOUBLE * n_words AND word_chars BETWEEN 3 * n_words AND 10 * n_words AND n_repeat_words <= 0.20::DOUBLE * n_words THEN 2 ELSE 1 END] END AS v FROM g),
hist AS (SELECT list({'v': v, 'n': n} ORDER BY v) AS hist FROM (SELECT v, count(*)::DOUBLE AS n FROM v WHERE NOT base_failed GROUP BY v)),
em AS (
  SELECT 0 AS i, list_transform(range(10), lambda j: 0.8::DOUBLE) AS a
  UNION ALL
  SELECT i + 1, list_transform(range(1, 11), lambda j:
      (coalesce(list_sum(list_transform(post, lambda p: p.n * CASE p.v[j] WHEN 2 THEN p.g WHEN 0 THEN 1 - p.g ELSE 0 END)), 0) + 0.8::DOUBLE * 2)
      / (coalesce(list_sum(list_transform(post, lambda p: CASE WHEN p.v[j] = 1 THEN 0::DOUBLE ELSE p.n END)), 0) + 2))
  FROM (SELECT i, list_transform(hist, lambda p: {'v': p.v, 'n': p.n, 'g': 1 / (1 + exp(-list_sum(list_transform(range(1, 11), lambda j: (p.v[j] - 1) * ln(a[j] / (1 - a[j]))))))}) AS post FROM em, hist WHERE i < 40)),
fitted AS (SELECT a FROM em WHERE i = 40),
judged AS (SELECT v.*, 1 / (1 + exp(-list_sum(list_transform(range(1, 11), lambda j: (v.v[j] - 1) * ln(a[j] / (1 - a[j])))))) AS posterior FROM v, fitted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(posterior, 6) AS quality, NOT base_failed AND posterior >= 0.5 AS kept FROM judged
""",
}
