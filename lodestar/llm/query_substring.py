"""op5: remove repeated passages from all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm.substring import dedup_substrings
from lodestar.sources.tables import read_table


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(read_table(spark, sf_dir, "documents"))


QUERIES = {"op5_substring_dedup": op5_substring_dedup}

ORACLE_SQL = {
    "op5_substring_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT row, doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS n FROM d),
windows AS (
  SELECT row, doc_id, n, word, count(*) OVER f AS width, md5(string_agg(word, ' ') OVER f) AS key
  FROM words WINDOW f AS (PARTITION BY row ORDER BY n ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
least AS (SELECT key, min(doc_id) AS least FROM windows WHERE width = 50 GROUP BY key),
hits AS (
  SELECT x.row, x.n, x.word, x.width = 50 AND coalesce(l.least < x.doc_id, l.least IS NOT NULL AND x.doc_id IS NULL) AS hit
  FROM windows x LEFT JOIN least l ON l.key = x.key AND x.width = 50),
gone AS (SELECT row, n, word, bool_or(hit) OVER (PARTITION BY row ORDER BY n ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM hits),
kept AS (SELECT row, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY n) FILTER (NOT gone) AS kept FROM gone GROUP BY row)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON k.row = d.row
""",
}
