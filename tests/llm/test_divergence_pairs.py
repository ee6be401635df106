"""op11: a term emits each pair of its sources once."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.llm.divergence import _pairs


def test_each_pair_once(spark):
    row = spark.createDataFrame([([3, 0, 5, 1], [40, 10, 60, 20], [10, 10, 10, 10])], "wide array<long>, shares array<long>, absent array<long>")
    got = row.select(F.explode(_pairs(F.col("wide"), F.col("shares"), F.col("absent"))).alias("p")).select("p.*").collect()
    d = lambda p, q: (p - q) ** 2 // q
    one = lambda p, q: d(p, q) - d(p, 10) - d(10, q)
    assert [tuple(r) for r in got] == [(a, b, one(p, q), one(q, p)) for a, p, b, q in ((0, 40, 2, 60), (0, 40, 3, 20), (2, 60, 3, 20))]
