"""Time steps as whole numbers counted from a reference."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

FREQUENCIES = ("h", "D", "W", "M")


def time_index(time: Column, reference: dt.datetime | dt.date, freq: str = "D") -> Column:
    """Whole hours, days, weeks (of seven days from the reference) or calendar months from the
    reference; the frequency is always given, never guessed."""
    if freq not in FREQUENCIES:
        raise ValueError(f"freq must be one of {FREQUENCIES}")
    ref = F.lit(reference).cast("timestamp_ntz")
    day = F.datediff(time.cast("date"), ref.cast("date"))
    if freq == "h":
        return F.timestamp_diff("HOUR", ref, time.cast("timestamp_ntz")).cast("int")
    if freq == "D":
        return day.cast("int")
    if freq == "W":
        return F.floor(day / 7).cast("int")
    return ((F.year(time) - F.year(ref)) * 12 + F.month(time) - F.month(ref)).cast("int")


def is_uniform(axis, time: str = "time"):  # noqa: ANN001, ANN201
    """One row: whether neighbouring steps of a time axis lie equally far apart. Only aggregates: with
    the step that the ends allow, every time stands on a step of its own."""
    us = F.timestamp_diff("MICROSECOND", F.lit(dt.datetime(1970, 1, 1)).cast("timestamp_ntz"), F.col("t"))
    times = axis.select(F.col(time).cast("timestamp_ntz").alias("t")).where("t is not null").distinct().select(us.alias("us"))
    ends = times.agg(F.min("us").alias("lo"), F.max("us").alias("hi"), F.count("*").alias("n"))
    step = F.when(F.col("n") > 1, F.expr("(hi - lo) div (n - 1)")).otherwise(F.lit(1))
    on_step = (F.col("us") - F.col("lo")) % F.col("step") == 0
    even = F.bool_and(on_step) & ((F.max("hi") - F.max("lo")) == (F.count("*") - 1) * F.max("step"))
    found = times.join(F.broadcast(ends.withColumn("step", step)))  # one row
    return found.agg(F.coalesce(even | (F.count("*") < 3), F.lit(True)).alias("uniform"))


def frequency(axis, time: str = "time"):  # noqa: ANN001, ANN201
    """One row, freq: the step of FREQUENCIES by which the distinct times of an axis follow one
    another, months by their first or by their last days; null where none fits and for fewer than
    three times. Only aggregates, so that no task sorts the axis."""
    us, day = F.timestamp_diff("MICROSECOND", F.lit(dt.datetime(1970, 1, 1)).cast("timestamp_ntz"), F.col("t")), 86_400_000_000
    month = F.year("t") * 12 + F.month("t")
    times = axis.select(F.col(time).cast("timestamp_ntz").alias("t")).where("t is not null").distinct()

    def every(unit: int) -> Column:
        return (F.min(us % unit) == F.max(us % unit)) & (F.max(us) - F.min(us) == (F.count("*") - 1) * unit)

    ends = (F.max(F.dayofmonth("t")) == 1) | F.bool_and(F.to_date("t") == F.last_day("t"))
    months = ends & (F.min(us % day) == F.max(us % day)) & (F.max(month) - F.min(month) == F.count("*") - 1)
    fits = F.when(F.count("*") < 3, F.lit(None).cast("string"))
    for freq, fit in zip(FREQUENCIES, (every(day // 24), every(day), every(7 * day), months), strict=True):
        fits = fits.when(fit, freq)
    return times.agg(fits.alias("freq"))
