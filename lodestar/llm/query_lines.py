"""op12: drop the lines that many documents share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.lines import dedup_lines
from lodestar.sources.tables import read_table


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = dedup_lines(read_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return made.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op12_line_dedup": op12_line_dedup}

ORACLE_SQL = {
    "op12_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT row, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) + count(DISTINCT CASE WHEN doc_id IS NULL THEN 1 END) >= 5),
j AS (SELECT k.*, o.key IS NOT NULL AND k.doc_id IS DISTINCT FROM o.keeper AS gone FROM k LEFT JOIN often o ON o.key = k.key)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY row
""",
}
