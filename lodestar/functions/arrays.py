"""Arrays as columns: a value computed once, running sums."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sums(numbers: Column) -> Column:
    """The sums of an int array's first 1, 2, ... elements, by runs of about the square root of its size.

    An array that grows by one element a step is copied at every step; in runs that is a small power less than in one.
    """

    def run(part: Column) -> Column:
        start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(part, start, lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.concat(s["all"], F.array(s["sum"] + x)).alias("all")))["all"]

    def by_runs(all_numbers: Column, size: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(all_numbers), size), lambda at: run(F.slice(all_numbers, at, size)))

        def joined(parts: Column) -> Column:
            past = F.concat(F.array(F.lit(0)), run(F.transform(parts, lambda p: F.element_at(p, -1))))
            return F.flatten(F.zip_with(parts, F.slice(past, F.lit(1), F.size(parts)), lambda part, before: F.transform(part, lambda x: x + before)))

        return let(runs, joined)

    return let(numbers, lambda a: F.when(F.size(a) > 0, let(F.ceil(F.sqrt(F.size(a))).cast("int"), lambda size: by_runs(a, size))).otherwise(a))
