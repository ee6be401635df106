"""Files that have come to rest: a file is ready once its size and time of change have stayed the same for long enough.

State per file: size, time of change, the moment since which both have not moved, and whether the file has been reported. A timer
stands at that moment plus the wait, so that a file that is seen once and never again is reported all the same; any change
sets it anew, a forced observation reports at once, and a removal takes the file's state and timer away. What has been reported is
remembered for ``keep`` seconds, so that the same content is not reported again, and then goes too: state is that of the files in
motion. Moments are data (an observation's time), so a replay gives what ``ready_files`` gives over all observations, however they
are divided into batches; observations of a file that come after later ones are passed over.

The stream needs the RocksDB state store (``use_rocksdb``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "size long, mtime double, since double"
OUTPUT = "file_id long, seen_at double, ready boolean"
READY = "file_id long, since timestamp, ready_at timestamp"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


_HELD = T.StructType([T.StructField("size", T.LongType()), T.StructField("mtime", T.DoubleType()), *[T.StructField(n, T.LongType()) for n in ("since", "seen")], T.StructField("reported", T.BooleanType())])


def use_rocksdb(spark: SparkSession) -> None:
    """Queries that are started from now on keep their state in RocksDB, which timers and several states a key need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def ready_files(observations: DataFrame, seconds: float, until: Column) -> DataFrame:
    """(file_id, since, ready_at) for every rest of a file in observations (file_id, size_bytes, mtime, seen_at, id, forced, removed).

    ``until`` is the moment up to which is known that nothing else happened. A forced observation is a rest of its own: it
    reports its file as of then, and what follows unchanged is not reported again.
    """
    order = Window.partitionBy("file_id").orderBy("seen_at", "id")
    before = lambda c: F.lag(c).over(order)
    rows = observations.withColumn("removed", F.coalesce("removed", F.lit(False)))
    same = F.col("size_bytes").eqNullSafe(before("size_bytes")) & F.col("mtime").eqNullSafe(before("mtime")) & ~F.coalesce(before("removed"), F.lit(True))
    rows = rows.withColumn("begins", F.when(~same & ~F.col("removed"), 1).otherwise(0))
    rows = rows.withColumn("rest", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rests = rows.where("rest > 0").groupBy("file_id", "rest").agg(
        F.min("seen_at").alias("since"), F.min(F.when(F.col("removed"), F.col("seen_at"))).alias("removed_at"), F.min(F.when(F.col("forced") & ~F.col("removed"), F.col("seen_at"))).alias("forced_at"),
    )
    following = F.lead("since").over(Window.partitionBy("file_id").orderBy("rest"))
    rests = rests.withColumn("ends", F.least(F.coalesce(following, until), F.coalesce("removed_at", until)))
    due = F.col("since") + F.make_interval(secs=F.lit(seconds))
    at = F.least(F.when(due <= F.col("ends"), due), F.col("forced_at"))
    return rests.select("file_id", "since", at.alias("ready_at")).where("ready_at IS NOT NULL")


def _ms(moment) -> int:
    return int(pd.Timestamp(moment).value // 1_000_000)


class _Rest(StatefulProcessor):
    def __init__(self, seconds: float, keep: float):
        self.wait, self.keep = round(seconds * 1000), round(keep * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", _HELD)

    def _timer(self, at: int | None) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if at is not None:
            self.handle.registerTimer(at)

    def _said(self, key, rows: list[tuple[int, int]]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame({"file_id": [key[0]] * len(rows), "since": pd.to_datetime([a for a, _ in rows], unit="ms"), "ready_at": pd.to_datetime([b for _, b in rows], unit="ms")})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values(["seen_at", "id"], kind="stable")
        held = self.state.get() if self.state.exists() else None
        ready = []
        columns = [frame[c].tolist() for c in ("size_bytes", "mtime", "seen_at", "forced", "removed")]
        for size, mtime, seen_at, forced, removed in zip(*columns, strict=True):
            seen = _ms(seen_at)
            if held is not None:
                if seen < held[3]:
                    continue
                if not held[4] and seen >= held[2] + self.wait:  # the timer's moment came before this
                    ready.append((held[2], held[2] + self.wait))
                    held = (*held[:4], True)
            if removed:
                held = None
                continue
            if held is None or (held[0], held[1]) != (int(size), float(mtime)):
                held = (int(size), float(mtime), seen, seen, False)
            if forced and not held[4]:
                ready.append((held[2], seen))
                held = (*held[:4], True)
            held = (held[0], held[1], held[2], seen, held[4])
        if held is None:
            self.state.clear()
            self._timer(None)
        else:
            self.state.update(held)
            self._timer(held[3] + self.keep if held[4] else held[2] + self.wait)
        yield from self._said(key, ready)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.state.exists():
            return
        held = self.state.get()
        if held[4]:
            self.state.clear()
            return
        self.state.update((*tuple(held)[:4], True))
        self.handle.registerTimer(held[2] + self.wait + self.keep)
        yield from self._said(key, [(held[2], held[2] + self.wait)])

    def close(self) -> None:
        pass


def at_rest(observations: DataFrame, seconds: float, *, keep: float = 3_600, late: str = "0 seconds") -> DataFrame:
    """The same as a stream: each rest once, when the observations' watermark has passed its end.

    Observations are those of ``ready_files``; any file's observations move the watermark on, ``late`` behind them.
    """
    rows = observations.withColumns({"forced": F.coalesce("forced", F.lit(False)), "removed": F.coalesce("removed", F.lit(False))}).withWatermark("seen_at", late)
    return rows.groupBy("file_id").transformWithStateInPandas(statefulProcessor=_Rest(seconds, keep), outputStructType=T.StructType.fromDDL(READY), outputMode="Append", timeMode="EventTime")


def gate(observations: DataFrame, seconds: float) -> DataFrame:
    """(file_id, seen_at, ready) for every observation (file_id, size, mtime, seen_at, forced) of a stream."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        for frame in frames:
            out = []
            for row in frame.sort_values("seen_at", kind="stable").itertuples():
                if held is None or (held[0], held[1]) != (row.size_bytes, row.mtime):
                    held = (int(row.size_bytes), float(row.mtime), float(row.seen_at))
                out.append((key[0], float(row.seen_at), bool(row.forced) or row.seen_at - held[2] >= seconds))
            state.update(held)
            yield pd.DataFrame(out, columns=["file_id", "seen_at", "ready"])

    return observations.groupBy("file_id").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
