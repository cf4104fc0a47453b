"""From fields to extreme events.

Dense events are (loc, t_idx, event); sparse events, which all later operators take, are the true
cells (loc, t_idx) alone. Missing and NaN values are never events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .axis import clean

SELECTIONS = (None, "burst", "wane", "start", "end")


def _passes(value: Column, threshold: Column, extreme: str) -> Column:
    if extreme not in ("above", "below"):
        raise AssertionError("extreme is 'above' or 'below'")
    return F.coalesce(value >= threshold if extreme == "above" else value <= threshold, F.lit(False))


def threshold_events(field: DataFrame, threshold: float, extreme: str, select: str | None = None, select_period: int | None = None, event_name: str = "event") -> DataFrame:
    """loc, t_idx and whether the value lies at or beyond the threshold; then, with `select`, only
    a part of every run of events."""
    about = {"threshold": threshold, "extreme": extreme, "select": select or "", "select_period": select_period or 0}
    dense = clean(field).select("loc", "t_idx", _passes(F.col("value"), F.lit(float(threshold)), extreme).alias("event"))
    return _named(_dense_selection(dense, select, select_period), event_name, about)


def percentile_thresholds(field: DataFrame, q: float) -> DataFrame:
    """loc, threshold: the exact, linearly interpolated quantile of each place's present values."""
    assert 0 <= q <= 1, "a quantile lies between 0 and 1"
    return clean(field).groupBy("loc").agg(F.percentile("value", F.lit(float(q))).alias("threshold"))


def percentile_events(field: DataFrame, percentile: float, extreme: str = "above", select: str | None = None, select_period: int | None = None, event_name: str = "event") -> DataFrame:
    """As `threshold_events`, against each place's own quantile. A place without values has none."""
    about = {"percentile": percentile, "extreme": extreme, "select": select or "", "select_period": select_period or 0}
    joined = clean(field).join(percentile_thresholds(field, percentile), "loc")
    dense = joined.select("loc", "t_idx", _passes(F.col("value"), F.col("threshold"), extreme).alias("event"))
    return _named(_dense_selection(dense, select, select_period), event_name, about)


def _named(dense: DataFrame, name: str, about: dict) -> DataFrame:
    """Parameters travel with the column as its metadata."""
    return dense.withColumn("event", F.col("event").alias("event", metadata=about)).withColumnRenamed("event", name)


def sparse(dense: DataFrame, event: str = "event") -> DataFrame:
    return dense.where(event).select("loc", "t_idx")


def select_runs(events: DataFrame, select: str | None, period: int | None = None) -> DataFrame:
    """Of sparse events those at the start or end of their run of consecutive steps: the first
    (burst) or last (wane), or the first (start) or last (end) `period`, 1 by default. duration is
    the run's length."""
    if select not in SELECTIONS:
        raise ValueError(f"select is one of {SELECTIONS}")
    if select is None:
        return events
    n = 1 if select in ("burst", "wane") or period is None else period
    by_time = Window.partitionBy("loc").orderBy("t_idx")
    runs = events.withColumn("run", F.col("t_idx") - F.row_number().over(by_time))
    run = Window.partitionBy("loc", "run")
    nth = F.row_number().over(run.orderBy("t_idx" if select in ("burst", "start") else F.desc("t_idx")))
    return runs.withColumns({"nth": nth, "duration": F.count("*").over(run)}).where(F.col("nth") <= n).select("loc", "t_idx", "duration")


def select_dense(dense: DataFrame, select: str, period: int = 1) -> DataFrame:
    return _dense_selection(dense, select, period)


def _dense_selection(dense: DataFrame, select: str | None, period: int | None) -> DataFrame:
    """Runs are consecutive positions of the axis; a run of a dense series is told from the number
    of false cells before it."""
    if select not in SELECTIONS:
        raise ValueError(f"select is one of {SELECTIONS}")
    if select is None:
        return dense
    n = 1 if select in ("burst", "wane") or period is None else period
    by_time = Window.partitionBy("loc").orderBy("t_idx")
    numbered = dense.withColumn("run", F.sum(F.when(~F.col("event"), 1).otherwise(0)).over(by_time))
    order = "t_idx" if select in ("burst", "start") else F.desc("t_idx")
    nth = F.row_number().over(Window.partitionBy("loc", "run", "event").orderBy(order))
    return numbered.select("loc", "t_idx", (F.col("event") & (nth <= n)).alias("event"))


def event_counts(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """loc, event_count for every place, zeros included."""
    counted = events.groupBy("loc").agg(F.count("*").alias("event_count"))
    return nodes.select("loc").join(counted, "loc", "left").select("loc", F.coalesce("event_count", F.lit(0)).cast("long").alias("event_count"))


def most_events(counts: DataFrame) -> DataFrame:
    """One row, event_count: the largest of any place; null without places. counts: as event_counts
    gives them."""
    return counts.agg(F.max("event_count").alias("event_count"))
