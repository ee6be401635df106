"""The work queue as functions from job rows to job rows.

A queue operation changes some rows; each function returns the rows it changes (or inserts), in their new state. Times
are parameters, so that results do not depend on when they are computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.constants import LOST_WORKER, PROGRESS_SECONDS, RETRY_SECONDS, STALE_SECONDS


def seconds(n: Column | int) -> Column:
    return F.make_dt_interval(secs=n if isinstance(n, Column) else F.lit(n))


def enqueue(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` that go in: at most one queued job per dedupe key, the first by id; null keys never conflict."""
    queued = jobs.where("status = 'queued' AND dedupe_key IS NOT NULL").select("dedupe_key").distinct()
    first = F.row_number().over(Window.partitionBy("dedupe_key").orderBy("id"))
    keyed = new.where("dedupe_key IS NOT NULL").withColumn("nth", first).where("nth = 1").drop("nth").join(queued, "dedupe_key", "left_anti")
    return new.where("dedupe_key IS NULL").unionByName(keyed)


def claim(jobs: DataFrame, now: Column, widths: dict[str, int] | None = None) -> DataFrame:
    """The next job of each lane: highest priority, then lowest id, among queued ones that are due.

    ``widths`` says how many jobs of a lane run at a time (one, if it does not name the lane): that many less the running
    ones are claimed. Without it one job of each lane is claimed.
    """
    order = Window.partitionBy("lane").orderBy(F.col("priority").desc(), "id")
    due = jobs.where(F.col("status") == "queued").where(F.col("run_after") <= now)
    most = max([1, *(widths or {}).values()])
    first = due.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
    if widths is None:
        first = first.drop("nth")
    else:
        width = F.lit(1)
        for lane, n in widths.items():
            width = F.when(F.col("lane") == lane, n).otherwise(width)
        busy = jobs.where("status = 'running'").groupBy("lane").agg(F.count("*").alias("busy"))
        first = first.join(busy, "lane", "left").where(F.col("nth") <= width - F.coalesce("busy", F.lit(0))).drop("nth", "busy")
    return first.withColumn("status", F.lit("running")).withColumn("attempts", F.col("attempts") + 1)


def complete(jobs: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """Running jobs (id in ``done``) once they are through."""
    rows = jobs.where("status = 'running'").join(done.select("id"), "id", "left_semi")
    return rows.select("id", F.lit("done").alias("new_status"), F.lit(1.0).alias("progress"), now.alias("finished_at"))


def depth(jobs: DataFrame) -> DataFrame:
    """Queued and running jobs by lane."""
    return jobs.where(F.col("status").isin("queued", "running")).groupBy("lane").agg(F.count("*").alias("n"))


def fail(jobs: DataFrame, now: Column) -> DataFrame:
    """Running jobs after a failure: queued again after 30 s times their attempts, or failed when those are used up."""
    again = F.col("attempts") < F.col("max_attempts")
    running = jobs.where("status = 'running'")
    return running.select("id", F.when(again, "queued").otherwise("failed").alias("new_status"), F.when(again, now + seconds(RETRY_SECONDS * F.col("attempts"))).otherwise(F.col("run_after")).alias("new_run_after"))


def with_twin(jobs: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds ``twin``: whether another job with the same key is queued. Null keys have none."""
    queued = jobs.where("status = 'queued' AND dedupe_key IS NOT NULL").select(F.col("dedupe_key").alias("queued_key")).distinct()
    return rows.join(queued, F.col("dedupe_key") == F.col("queued_key"), "left").withColumn("twin", F.col("queued_key").isNotNull()).drop("queued_key")


def reap(jobs: DataFrame, now: Column, stale: int = STALE_SECONDS) -> DataFrame:
    """Running jobs without a sign of life: cancelled if a twin waits, else queued again or failed."""
    lost = jobs.where(F.col("status") == "running").where(F.col("heartbeat_at") < now - seconds(stale))
    status = F.when(F.col("twin"), "cancelled").when(F.col("attempts") < F.col("max_attempts"), "queued").otherwise("failed")
    return with_twin(jobs, lost).select("id", status.alias("new_status"), F.when(~F.col("twin"), LOST_WORKER).alias("error"))


def requeue(jobs: DataFrame, now: Column, delay: int) -> DataFrame:
    """Running jobs put back without counting an attempt; cancelled if a twin is queued."""
    rows = with_twin(jobs, jobs.where("status = 'running'"))
    return rows.select("id", F.when(F.col("twin"), "cancelled").otherwise("queued").alias("new_status"), F.when(F.col("twin"), F.col("attempts")).otherwise(F.col("attempts") - 1).alias("new_attempts"), F.when(F.col("twin"), F.col("run_after")).otherwise(now + seconds(delay)).alias("new_run_after"))


def release(jobs: DataFrame) -> DataFrame:
    """Running jobs at shutdown: queued with one attempt less (not below none), unless a twin is queued."""
    rows = with_twin(jobs, jobs.where("status = 'running'")).where("NOT twin")
    return rows.select("id", F.lit("queued").alias("new_status"), F.greatest(F.col("attempts") - 1, F.lit(0)).alias("new_attempts"))


def active_files(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Files that a queued or running job is about."""
    busy = jobs.where(F.col("status").isin("queued", "running")).select(F.col("file_id").alias("id"))
    return files.join(busy, "id", "left_semi").select("id")


def orphaned(files: DataFrame, jobs: DataFrame) -> DataFrame:
    """Files in processing without a running job: they wait again."""
    running = jobs.where("status = 'running'").select(F.col("file_id").alias("id"))
    return files.where("status = 'processing'").join(running, "id", "left_anti").select("id", F.lit("queued").alias("new_status"))


def progress(heartbeats: DataFrame) -> DataFrame:
    """Last sign of life and last reported value of each service: a null report keeps the one before."""
    stamp = F.struct("seen_at", "id")
    return heartbeats.groupBy("service").agg(F.max("seen_at").alias("last_seen"), F.max_by("value", F.when(F.col("value").isNotNull(), stamp)).alias("progress"))


def throttled(reports: DataFrame, every: int = PROGRESS_SECONDS) -> DataFrame:
    """Progress reports to be written: the last of each service in each span of ``every`` seconds."""
    return reports.groupBy("service", F.window("seen_at", f"{every} seconds")).agg(F.max(F.struct("seen_at", "id", "value")).alias("last")).select("service", "last.*")


def alive(heartbeats: DataFrame, now: Column, within: int) -> DataFrame:
    """Last sign of life of each service and whether it is recent."""
    seen = heartbeats.groupBy("service").agg(F.max("seen_at").alias("last_seen"))
    return seen.withColumn("alive", now - seconds(within) < F.col("last_seen"))
