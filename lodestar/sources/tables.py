"""Reading Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables below so many bytes a core are dealt out to all cores when their files make fewer tasks than that.
SMALL_BYTES_A_CORE = 8 << 20


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder. A small one of a single row group would be one task whatever the plan: it is spread.

    Anything larger is read as it lies, since its splits keep all cores busy and a shuffle would only cost.
    """
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    plan = rows._jdf.queryExecution()
    if int(str(plan.optimizedPlan().stats().sizeInBytes())) >= cores * SMALL_BYTES_A_CORE or plan.toRdd().getNumPartitions() >= cores:
        return rows
    return rows.repartition(cores)
