"""Events and coincidences on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_events(field: DataFrame, threshold: float, extreme: str = "above") -> DataFrame:
    """Rows of a stream whose value lies at or beyond the threshold; no state is kept."""
    if extreme not in ("above", "below"):
        raise ValueError("extreme is 'above' or 'below'")
    value = F.when(~F.isnan("value"), F.col("value"))
    return field.where(value >= threshold if extreme == "above" else value <= threshold)


def stream_precursors(events_a: DataFrame, events_b: DataFrame, delta: int, tau: int = 0, lateness: str = "10 minutes") -> DataFrame:
    """Pairs of an event of a and a later one of b, from tau to tau + delta seconds apart. Both
    streams have loc and time. They meet by bins of delta seconds, of which a window touches two;
    state is kept for the lateness plus the window."""
    width = max(int(delta), 1)
    a = events_a.withWatermark("time", lateness).select(F.col("loc").alias("a"), F.col("time").alias("time_a"))
    first = F.floor((F.unix_timestamp("time_a") + tau) / width)
    a = a.withColumn("bin", F.explode(F.array(first, first + 1, first + 2)))
    b = events_b.withWatermark("time", lateness).select(F.col("loc").alias("b"), F.col("time").alias("time_b"), F.floor(F.unix_timestamp("time") / width).alias("bin_b"))
    inside = F.expr(f"bin = bin_b AND time_b >= time_a + interval {int(tau)} seconds AND time_b <= time_a + interval {int(tau) + int(delta)} seconds")
    return a.join(b, inside).drop("bin", "bin_b")


def stream_counts(events: DataFrame, width: str, lateness: str = "10 minutes") -> DataFrame:
    """loc, window, n: events in tumbling windows, once the watermark has passed them."""
    return events.withWatermark("time", lateness).groupBy(F.window("time", width), "loc").agg(F.count("*").alias("n"))
