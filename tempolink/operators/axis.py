"""Fields, time axes and places.

A field is a long table (loc, t_idx, value). Axis and places are small tables; all windows work on
t_idx, the position on the axis, and never on the calendar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows that differ in `order`, with their place in it (from 0) as one more column.

    Ranges of the order are sorted, each in a task of its own, and written; a row's place is its place
    in its range after the rows of the ranges before, of which only the counts meet the driver."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = materialise(ranged.select("*", F.spark_partition_id().alias("__range"), within.alias("__within")), "ranges")
    counts = sorted(placed.groupBy("__range").count().collect())
    starts, total = [], 0
    for r, n in counts:
        starts.append((r, total))
        total += n
    first = F.broadcast(rows.sparkSession.createDataFrame(starts, "__range int, __first long"))  # a row a range
    return placed.join(first, "__range").select(*rows.columns, (F.col("__first") + F.col("__within")).alias(name))


def time_axis(field: DataFrame, time: str = "time") -> DataFrame:
    """t_idx (from 0) and time, one row for each distinct time."""
    steps = field.select(F.col(time).alias("time")).where("time is not null").distinct()
    return numbered(steps, ["time"], "t_idx").select(F.col("t_idx").cast("int").alias("t_idx"), "time")


def places(field: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """loc (from 0, by latitude then longitude), lat, lon, one row for each distinct place."""
    spots = field.select(F.col(lat).alias("lat"), F.col(lon).alias("lon")).distinct()
    return numbered(spots, ["lat", "lon"], "loc").select("loc", "lat", "lon")


def clean(field: DataFrame, value: str = "value") -> DataFrame:
    """NaN becomes null, so that no comparison or quantile takes it for a number."""
    return field.withColumn(value, F.when(~F.isnan(value), F.col(value)))


def with_suffix(df: DataFrame, suffix: str, keep: tuple[str, ...] = ("time", "t_idx")) -> DataFrame:
    """All columns but those to keep renamed, so that two layers can meet in one row."""
    return df.withColumnsRenamed({c: f"{c}{suffix}" for c in df.columns if c not in keep})


def require_same_axis(a: DataFrame, b: DataFrame, time: str = "time") -> None:
    """Two layers are compared only over identical time axes."""
    one, two = a.select(time).distinct(), b.select(time).distinct()
    if not one.join(two, time, "left_anti").isEmpty() or not two.join(one, time, "left_anti").isEmpty():
        raise ValueError("the two layers have different time axes")


def block_of(loc, size: int):  # noqa: ANN001, ANN201
    """Number of the block of places that a place belongs to."""
    return F.floor(loc / size).cast("int")
