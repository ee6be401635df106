"""Batch forms of the keyed streams, over the driver's events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.plans.base import Query
from lodestar.plans.views import NOW
from lodestar.streaming.schedule import scan_schedule
from lodestar.streaming.stability import ready_files

WAIT = 3_600


def rested(o: DataFrame) -> DataFrame:
    return ready_files(o.withColumn("removed", F.col("id") % 13 == 0), WAIT, F.expr(NOW))


def scheduled(e: DataFrame) -> DataFrame:
    key = F.when(F.col("file_id") % 7 > 0, F.col("file_id").cast("string"))
    return scan_schedule(e.select(key.alias("key"), F.col("happened_at").alias("at"), "id", F.when(F.col("event") == "claimed", "claimed").otherwise("event").alias("what")))


QUERIES: dict[str, Query] = {
    "files_at_rest": Query(
        ("observations",),
        rested,
        f"""WITH o AS (SELECT *, id % 13 = 0 AS removed FROM observations),
        m AS (SELECT *, NOT removed AND (coalesce(lag(removed) OVER w, true) OR lag(size_bytes) OVER w IS DISTINCT FROM size_bytes OR lag(mtime) OVER w IS DISTINCT FROM mtime) AS begins FROM o WINDOW w AS (PARTITION BY file_id ORDER BY seen_at, id)),
        r AS (SELECT *, sum(begins::INT) OVER (PARTITION BY file_id ORDER BY seen_at, id) AS rest FROM m),
        g AS (SELECT file_id, rest, min(seen_at) AS since, min(seen_at) FILTER (removed) AS removed_at, min(seen_at) FILTER (forced AND NOT removed) AS forced_at FROM r WHERE rest > 0 GROUP BY ALL),
        e AS (SELECT *, least(coalesce(lead(since) OVER (PARTITION BY file_id ORDER BY rest), {NOW}), coalesce(removed_at, {NOW})) AS ends FROM g),
        d AS (SELECT file_id, since, least(CASE WHEN since + INTERVAL {WAIT} SECONDS <= ends THEN since + INTERVAL {WAIT} SECONDS END, forced_at) AS ready_at FROM e)
        SELECT file_id, since, ready_at FROM d WHERE ready_at IS NOT NULL""",
    ),
    "scan_schedule": Query(
        ("file_events",),
        scheduled,
        """WITH k AS (SELECT CASE WHEN file_id % 7 > 0 THEN file_id::VARCHAR END AS key, happened_at, id, event = 'claimed' AS taken FROM file_events),
        e AS (SELECT *, sum(taken::INT) OVER (PARTITION BY key ORDER BY happened_at, id) AS epoch FROM k)
        SELECT key, first_at, first_at + INTERVAL 2 SECONDS AS due_at FROM (
          SELECT key, min(happened_at) AS first_at FROM e WHERE key IS NOT NULL AND NOT taken GROUP BY key, epoch UNION ALL SELECT key, happened_at FROM k WHERE key IS NULL AND NOT taken)""",
    ),
}
