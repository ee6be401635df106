"""Stores that grow: a task's work is bounded by a shard's size, not by a number of shards."""

from __future__ import annotations

from lodestar.operators import search
from lodestar.plans import stores
from lodestar.sources import versions


def test_generations_lie_in_shards_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(stores, "ROWS_A_SHARD", 500)
    made = []
    monkeypatch.setattr(stores, "folder", lambda s, f=stores.folder: made.append(f(s)) or made[-1])
    rows = spark.range(10_000).selectExpr("id % 3000 AS file_id", "id AS ordinal", "id AS chunk")
    assert stores.generations(rows).agg({"n_chunks": "sum"}).first()[0] == 8_000 + 5_000
    found = versions.latest(spark, made[0])
    assert found.doc["buckets"] == 20 and max(r["count"] for r in found.rows(spark, "small").groupBy(versions.bucket_of("file_id", 20)).count().collect()) < 1_000


def test_a_task_adds_up_a_bounded_text(spark, monkeypatch):
    monkeypatch.setattr(search, "TEXT_A_TASK", 2_000)
    rows = spark.range(600).selectExpr("id DIV 2 AS chunk", "IF(id % 3 = 0, NULL, 'Alpha beta') AS heading", "concat('alpha gamma g', id) AS text")
    found = search.postings(rows)
    assert found.rdd.getNumPartitions() >= 5 and max(map(len, found.rdd.glom().collect())) < 600
    direct = search.places(rows).groupBy("chunk", "lexeme").agg({"w": "sum"}).collect()
    assert sorted((r.chunk, r.lexeme, r.weight) for r in found.collect()) == sorted((r[0], r[1], r[2] / 10) for r in direct)
