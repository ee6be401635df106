"""One waiting job a key: the first event schedules it, later ones are swallowed until it is taken.

Events and what happens to the jobs come as one stream of (key, at, id, what): ``event`` asks for a job, ``claimed`` says that
the waiting job of the key was taken. The state of a key is there while its job waits, and goes when it is taken: a key is free again
right then, whether the job is done or not, as a running job does not see what has changed since it began. Keys that are null never
wait for each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestar.constants import DEBOUNCE_SECONDS

JOBS = "key string, first_at timestamp, due_at timestamp"


def scan_schedule(events: DataFrame, delay: float = DEBOUNCE_SECONDS) -> DataFrame:
    """(key, first_at, due_at) of all jobs that these events make: the first event of a key, and the first after each claim."""
    order = Window.partitionBy("key").orderBy("at", "id")
    claims = F.sum(F.when(F.col("what") == "claimed", 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    keyed = events.where("key IS NOT NULL").withColumn("epoch", claims).where("what = 'event'").groupBy("key", "epoch").agg(F.min("at").alias("first_at"))
    free = events.where("key IS NULL AND what = 'event'").select("key", F.col("at").alias("first_at"))
    return keyed.select("key", "first_at").unionByName(free).withColumn("due_at", F.col("first_at") + F.make_interval(secs=F.lit(delay)))


class _Waiting(StatefulProcessor):
    def __init__(self, delay: float):
        self.delay = pd.Timedelta(seconds=delay)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getValueState("waiting", T.StructType([T.StructField("first_at", T.TimestampType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values(["at", "id"], kind="stable")
        waits = was = self.waiting.exists()
        first = []
        for at, what in zip(frame["at"].tolist(), frame["what"].tolist(), strict=True):
            if what == "claimed":
                waits = False
            elif not waits:
                first.append(at)
                waits = True
        if not waits:
            self.waiting.clear()
        elif first or not was:
            self.waiting.update((first[-1].to_pydatetime(),))
        if first:
            yield pd.DataFrame({"key": [key[0]] * len(first), "first_at": first, "due_at": [f + self.delay for f in first]})

    def close(self) -> None:
        pass


def scan_jobs(events: DataFrame, delay: float = DEBOUNCE_SECONDS) -> DataFrame:
    """The same as a stream. A batch's rows are taken in order of time; what comes in a later batch is later."""
    keyed = events.withColumn("own", F.coalesce("key", F.concat(F.lit("\x00"), F.col("id").cast("string")))).where("key IS NOT NULL OR what = 'event'")
    made = keyed.groupBy("own").transformWithStateInPandas(statefulProcessor=_Waiting(delay), outputStructType=T.StructType.fromDDL(JOBS), outputMode="Append", timeMode="None")
    return made.withColumn("key", F.when(~F.startswith("key", F.lit("\x00")), F.col("key")))
