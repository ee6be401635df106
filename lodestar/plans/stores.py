"""Queries that write versioned tables and indexes to the checkpoint folder, from the driver's tables, and read them."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.lineage import ensure_checkpoint_dir
from lodestar.operators import mutations, search
from lodestar.plans.base import Query
from lodestar.plans.texts import DIM, LISTS, SEARCH, cosine, counts, lists, prepared_questions
from lodestar.sources import keyword_index, store, vector_index, versions

#: A shard is one task's work and memory: a store of more rows has more of them, whatever they are. A graph compares all rows of a shard.
SHARDS = 4
VECTORS_A_SHARD, PASSAGES_A_SHARD, ROWS_A_SHARD = 5_000, 20_000, 500_000


def folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/store-{uuid.uuid4().hex}"


def shards(rows: DataFrame, each: int) -> int:
    """How many shards of about so many rows a new store of these rows has."""
    return max(SHARDS, -(-rows.count() // each))


def keyword_indexed(p: DataFrame, a: DataFrame, projects: Sequence[int] | None = None) -> DataFrame:
    spark, at = p.sparkSession, folder(p.sparkSession)
    chunks = p.withColumn("file_id", F.col("chunk"))
    store.swap_chunks(spark, f"{at}/chunks", chunks, chunks, buckets=shards(p, PASSAGES_A_SHARD))
    keyword_index.refresh(spark, f"{at}/chunks", f"{at}/index")
    return keyword_index.search(spark, f"{at}/index", a, projects=projects).select("question", "chunk", "score", "rank")


def graph(v: DataFrame) -> str:
    """An index over vectors (id, project, embedding)."""
    spark, at = v.sparkSession, folder(v.sparkSession)
    chunks = v.select(F.col("id").alias("file_id"), F.col("id").alias("chunk"), "project", F.col("embedding").alias("counts"))
    store.swap_chunks(spark, f"{at}/chunks", chunks, chunks, buckets=shards(v, VECTORS_A_SHARD))
    vector_index.refresh(spark, f"{at}/chunks", f"{at}/index")
    return f"{at}/index"


def graph_recall(v: DataFrame, a: DataFrame, projects: Sequence[int] | None = None) -> DataFrame:
    """(question, n_found, recall_ok): how many rows the graph finds, and whether 0.9 of the exact ones are among them."""
    asked, index = search.written(prepared_questions(a)), graph(v)
    found = vector_index.search(v.sparkSession, index, asked, projects=projects).select("question", "chunk")
    rows = v if projects is None else v.where(F.col("project").isin(*projects))
    exact = search.vector_hits(rows.select(F.col("id").alias("chunk"), F.col("embedding").alias("counts")), asked, DIM).where("score IS NOT NULL").select("question", "chunk", F.lit(1).alias("exact"))
    both = exact.join(found.withColumn("found", F.lit(1)), ["question", "chunk"], "full_outer").groupBy("question")
    return both.agg(F.count("found").alias("n_found"), (F.count_if(F.expr("exact = 1 AND found = 1")) >= 0.9 * F.count("exact")).alias("recall_ok"))


def exactly_by_index(v: DataFrame, a: DataFrame) -> DataFrame:
    return vector_index.search(v.sparkSession, graph(v), prepared_questions(a), exact=True).select("question", "chunk", "score", "rank")


def generations(chunks: DataFrame) -> DataFrame:
    """A store by two models: all files by the first; then every third file anew, and every fifth removed; every second by the
    other model, to which the search is switched while the first one stays."""
    spark, at = chunks.sparkSession, folder(chunks.sparkSession)
    rows = chunks.select("file_id", "ordinal")
    store.swap_chunks(spark, at, rows, rows, shards(rows, ROWS_A_SHARD), model="small", index_version=4)
    again = rows.where("file_id % 3 = 0 AND file_id % 5 <> 0").withColumn("ordinal", F.col("ordinal") + 100)
    store.swap_chunks(spark, at, again, rows.where("file_id % 3 = 0 OR file_id % 5 = 0"), model="small", index_version=5)
    store.swap_chunks(spark, at, rows.where("file_id % 2 = 0"), rows.where("file_id % 2 = 0"), model="large", index_version=5)
    store.switch_model(spark, at, "large", keep_old=True)
    seen = [store.searched_chunks(spark, at, m).withColumn("model", F.lit(m)) for m in ("small", "large")]
    return seen[0].unionByName(seen[1]).groupBy("model", "index_version", "file_id").agg(F.count("*").alias("n_chunks"), F.sum("ordinal").alias("sum_ordinal")).withColumn("searched", F.col("model") == versions.latest(spark, at).searched)


def changes(files: DataFrame) -> DataFrame:
    """Files as records: all are written, every tenth gets another status, and every seventeenth goes."""
    spark, at = files.sparkSession, folder(files.sparkSession)
    rows = files.select("id", "status")
    mutations.put(spark, at, [mutations.records(rows, "file")], buckets=shards(rows, ROWS_A_SHARD))
    mutations.put(spark, at, [mutations.records(rows.where("id % 10 = 0").withColumn("status", F.lit("deleted")), "file")])
    mutations.put(spark, at, [], mutations.records(rows.where("id % 17 = 0"), "file"))
    return mutations.audit(spark, at)


QUERIES: dict[str, Query] = {
    "keyword_indexed": Query(SEARCH, keyword_indexed, "WITH " + LISTS + " SELECT question, chunk, score, rank FROM keyword"),
    "keyword_indexed_by_project": Query(SEARCH, lambda p, a: keyword_indexed(p, a, [1, 3]), "WITH seen AS (SELECT * FROM passages WHERE project IN (1, 3)), " + lists("seen") + " SELECT question, chunk, score, rank FROM keyword"),
    "vector_graph": Query(("vectors", "asked"), graph_recall, "SELECT question, (SELECT least(40, count(*)) FROM vectors) AS n_found, true AS recall_ok FROM asked"),
    "vector_graph_by_project": Query(("vectors", "asked"), lambda v, a: graph_recall(v, a, [1, 4]), "SELECT question, (SELECT least(40, count(*)) FROM vectors WHERE project IN (1, 4)) AS n_found, true AS recall_ok FROM asked"),
    "vector_index_exact": Query(
        ("vectors", "asked"),
        exactly_by_index,
        "WITH " + counts("qv", "asked", "question", "text") + f", s AS (SELECT q.id AS question, v.id AS chunk, {cosine('v.e', 'q.counts')} AS score FROM (SELECT id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM vectors) v, qv q) SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC NULLS LAST, chunk) AS rank FROM s QUALIFY rank <= 40",
    ),
    "store_generations": Query(
        ("chunk_files",),
        generations,
        """WITH s AS (
          SELECT 'small' AS model, CASE WHEN file_id % 3 = 0 THEN 5 ELSE 4 END AS index_version, file_id, CASE WHEN file_id % 3 = 0 THEN ordinal + 100 ELSE ordinal END AS ordinal FROM chunk_files WHERE file_id % 5 <> 0
          UNION ALL SELECT 'large', 5, file_id, ordinal FROM chunk_files WHERE file_id % 2 = 0)
        SELECT model, index_version, file_id, count(*) AS n_chunks, sum(ordinal)::BIGINT AS sum_ordinal, model = 'large' AS searched FROM s GROUP BY ALL""",
    ),
    "change_feed": Query(
        ("files",),
        changes,
        """WITH d AS (SELECT id, id::VARCHAR AS entity_id, status, concat('{"id":', id, ',"status":"', status, '"}') AS doc, concat('{"id":', id, ',"status":"deleted"}') AS marked FROM files)
        SELECT 1 AS version, 'create' AS action, 'file' AS entity, entity_id, NULL::VARCHAR AS before, doc AS after FROM d
        UNION ALL SELECT 2, 'update', 'file', entity_id, doc, marked FROM d WHERE id % 10 = 0 AND status <> 'deleted'
        UNION ALL SELECT 3, 'delete', 'file', entity_id, CASE WHEN id % 10 = 0 THEN marked ELSE doc END, NULL FROM d WHERE id % 17 = 0""",
    ),
}
