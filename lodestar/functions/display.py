"""Numbers for people: sizes, durations, ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("KB", "MB", "GB", "TB")


def size_label(n: Column) -> Column:
    """Bytes in the largest unit that gives one or more; one decimal below ten."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in enumerate(UNITS, 1):
        v = n / F.lit(float(1024**power))
        number = F.when(v < 10, F.round(v, 1).cast("decimal(20,1)").cast("string")).otherwise(F.round(v, 0).cast("decimal(20,0)").cast("string"))
        out = F.when(n >= F.lit(1024**power), F.concat(number, F.lit(f" {unit}"))).otherwise(out)
    return out


def duration_label(seconds: Column) -> Column:
    """About how long something takes, in minutes or hours."""
    m = F.floor(seconds / 60 + 0.5)
    h, rest = F.floor(m / 60), m % 60
    minutes = F.concat(F.lit("about "), m.cast("string"), F.when(m == 1, " minute").otherwise(" minutes"))
    hours = F.concat(F.lit("about "), h.cast("string"), F.lit(" h"), F.when(rest > 0, F.concat(F.lit(" "), rest.cast("string"), F.lit(" min"))).otherwise(""))
    return F.when(seconds < 60, "under a minute").when(m < 60, minutes).otherwise(hours)


def age_label(then: Column, now: Column) -> Column:
    """How long ago something was; a date after a day, a dash for null."""
    age = now.cast("timestamp").cast("long") - then.cast("timestamp").cast("long")
    ago = lambda unit, name: F.concat(F.floor(age / unit).cast("string"), F.lit(f" {name} ago"))
    return F.when(then.isNull(), "—").when(age < 60, "just now").when(age < 3_600, ago(60, "min")).when(age < 86_400, ago(3_600, "h")).otherwise(F.date_format(then, "d MMM yyyy"))
