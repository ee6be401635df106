"""Keyed streams against their batch forms: replays in many batches, restarts, state that goes."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lodestar.streaming.schedule import scan_jobs, scan_schedule
from lodestar.streaming.stability import at_rest, ready_files, use_rocksdb

START = dt.datetime(2024, 1, 1)
SEEN = "file_id long, size_bytes long, mtime double, seen_at timestamp, id long, forced boolean, removed boolean"
EVENTS = "key string, at timestamp, id long, what string"


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


@pytest.fixture
def feed(spark, tmp_path):
    """Rows as files, one a batch; run(plan) starts or goes on with the stream until all that is there has been read."""
    use_rocksdb(spark)
    out = []

    class Feed:
        n = 0

        def add(self, rows, schema):
            self.schema = schema
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{Feed.n:04d}"))
            Feed.n += 1

        def run(self, plan, name="a"):
            stream = spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
            query = plan(stream).writeStream.foreachBatch(lambda batch, _: out.extend(tuple(r) for r in batch.collect())).option("checkpointLocation", str(tmp_path / f"cp-{name}")).outputMode("append").trigger(availableNow=True).start()
            assert query.awaitTermination(300)
            self.progress = query.recentProgress
            return sorted(out, key=repr)

    return Feed()


def rests(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_a_file_that_is_seen_once_is_ready(feed):
    feed.add([(1, 5, 1.0, at(0), 1, False, False)], SEEN)
    assert feed.run(lambda s: at_rest(s, 10)) == []
    feed.add([(2, 5, 1.0, at(9), 2, False, False)], SEEN)  # another file: only time goes on
    assert feed.run(lambda s: at_rest(s, 10)) == []
    feed.add([(2, 6, 1.0, at(30), 3, False, False)], SEEN)
    assert feed.run(lambda s: at_rest(s, 10)) == [(1, at(0), at(10)), (2, at(9), at(19))]


def test_growing_forced_and_removed_files(feed):
    feed.add([(1, 5, 1.0, at(0), 1, False, False), (1, 5, 1.0, at(4), 2, False, False), (1, 6, 1.0, at(6), 3, False, False), (2, 1, 1.0, at(3), 4, True, False), (3, 1, 1.0, at(1), 5, False, False)], SEEN)
    feed.add([(1, 6, 1.0, at(16), 6, False, False), (3, None, None, at(8), 7, False, True), (2, 1, 1.0, at(9), 8, True, False)], SEEN)
    feed.add([(9, 1, 1.0, at(500), 9, False, False)], SEEN)
    assert feed.run(lambda s: at_rest(s, 10, keep=100)) == [(1, at(6), at(16)), (2, at(3), at(3))]
    feed.add([(8, 1, 1.0, at(1_000), 10, False, False)], SEEN)
    assert feed.run(lambda s: at_rest(s, 10, keep=100))[-1] == (9, at(500), at(510))
    assert feed.progress[-1].stateOperators[0].numRowsTotal <= 4  # state and timer of files 8 and 9; those of 1 to 3 have gone


@pytest.mark.parametrize("seed", [1, 2])
def test_replay_gives_the_batch_result(spark, feed, seed):
    rng = random.Random(seed)
    rows, now = [], 0
    for i in range(240):
        now += rng.choice([0, 1, 2, 5, 9])
        removed = rng.random() < 0.08
        rows.append((rng.randrange(8), None if removed else rng.randrange(2), None if removed else 1.0, at(now), i, not removed and rng.random() < 0.06, removed))
    a = 0
    while a < len(rows):
        b = a + rng.choice([1, 20, 60])
        feed.add(rows[a:b], SEEN)
        a = b
    got = feed.run(lambda s: at_rest(s, 12, keep=10_000))
    assert got == rests(ready_files(spark.createDataFrame(rows, SEEN), 12, F.lit(at(now)))) and len(got) > 10


def test_a_trickle_scans_whenever_the_job_is_taken(spark, feed):
    """One event a second; the waiting job is taken at 3, 4 and 9."""
    rows = [("a", at(s), 10 * s, "event") for s in range(12)] + [("a", at(s), 10 * s + 5, "claimed") for s in (3, 4, 9)]
    got = sorted(r[1] for r in (tuple(x) for x in scan_schedule(spark.createDataFrame(rows, EVENTS)).collect()))
    assert got == [at(0), at(4), at(5), at(10)]
    for s in range(12):
        feed.add([r for r in rows if r[1] == at(s)], EVENTS)
    assert feed.run(scan_jobs) == rests(scan_schedule(spark.createDataFrame(rows, EVENTS)))


def test_a_key_is_free_when_its_job_is_taken(spark, feed):
    feed.add([("a", at(0), 1, "event"), ("a", at(1), 2, "event"), (None, at(1), 3, "event"), (None, at(1), 4, "event"), ("b", at(0), 5, "claimed")], EVENTS)
    assert feed.run(scan_jobs) == sorted([("a", at(0), at(2)), (None, at(1), at(3)), (None, at(1), at(3))], key=repr)
    feed.add([("a", at(2), 6, "event")], EVENTS)
    assert len(feed.run(scan_jobs)) == 3
    feed.add([("a", at(3), 7, "claimed")], EVENTS)
    feed.add([("a", at(3), 8, "event"), ("a", at(4), 9, "event")], EVENTS)
    assert ("a", at(3), at(5)) in feed.run(scan_jobs)
    feed.add([("a", at(5), 10, "claimed")], EVENTS)
    feed.run(scan_jobs)
    assert feed.progress[-1].stateOperators[0].numRowsTotal == 2  # the two jobs without a key
