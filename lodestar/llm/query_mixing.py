"""op1: mix all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm.mixing import mix_sources
from lodestar.sources.tables import read_table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    mixed = mix_sources(docs, keep=["doc_id", "source"])
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


QUERIES = {"op1_mix_sources": op1_mix_sources}

ORACLE_SQL = {
    "op1_mix_sources": r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS key
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
caps AS (
  SELECT source, source_size, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS weight,
         2.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM sources),
levels AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, place) AS rank,
         (1.5::DOUBLE * sum(source_size) OVER ()
           - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM caps),
water AS (SELECT rank, level FROM levels WHERE cap / weight > level ORDER BY rank LIMIT 1),
targets AS (
  SELECT l.source, l.source_size, CASE WHEN w.rank IS NULL OR l.rank < w.rank THEN l.cap ELSE w.level * l.weight END AS target
  FROM levels l LEFT JOIN water w ON true),
queued AS (
  SELECT d.*, t.source_size, t.target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS cum
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT doc_id, source, size, key, cum, epoch, (cum + epoch * source_size)::DOUBLE / target AS finish
  FROM queued, (VALUES (0), (1)) AS e(epoch) WHERE size > 0 AND target > 0),
mixed AS (
  SELECT *, sum(size) OVER (ORDER BY finish, key, source NULLS FIRST, epoch ROWS UNBOUNDED PRECEDING) AS total FROM copies),
taken AS (
  SELECT source, key, cum, count(*) AS copies FROM mixed
  WHERE total <= (SELECT 1.5::DOUBLE * sum(source_size) FROM sources) GROUP BY ALL)
SELECT q.doc_id, q.source, q.size, q.source_size::BIGINT AS source_size, q.target, coalesce(t.copies, 0)::BIGINT AS copies,
       (coalesce(t.copies, 0) * q.size)::BIGINT AS taken
FROM queued q LEFT JOIN taken t ON q.source IS NOT DISTINCT FROM t.source AND q.key = t.key AND q.cum = t.cum AND q.size > 0
""",
}
