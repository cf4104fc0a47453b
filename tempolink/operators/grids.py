"""Grids on the sphere as tables (point_id, lon, lat), computed in parallel from the point's number."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import degrees_to_km, from_angles, spacing_to_points, to_geographic
from .axis import numbered

#: From so many points on, the offset that keeps the smallest distance largest.
MAXMIN_OFFSETS = ((24, 1.33), (177, 3.33), (890, 10.0), (11_000, 27.0), (400_000, 75.0), (600_000, 214.0))
AVERAGE_OFFSET = 0.36
SMALL_OFFSET = 0.33


def _middle(extent: float, step: float) -> tuple[int, float, float]:
    """How many coordinates lie in the middle of [-extent / 2, extent / 2], the first, and the width."""
    n = math.ceil(extent / step)
    first = -extent / 2 + (extent - (n - 1) * step) / 2
    return n, first, (-2 * first) / (n - 1) if n > 1 else 0.0


def _mesh(spark: SparkSession, lon: tuple[int, float, float], lat: tuple[int, float, float]) -> DataFrame:
    """Latitude by latitude, each point from its number."""
    (n, west, east_by), (rows, south, north_by) = lon, lat
    i, j = F.col("id") % max(n, 1), F.floor(F.col("id") / max(n, 1))
    return spark.range(n * rows).select(F.col("id").alias("point_id"), (F.lit(west) + i * F.lit(east_by)).alias("lon"), (F.lit(south) + j * F.lit(north_by)).alias("lat"))


def regular_grid(spark: SparkSession, step_lon: float, step_lat: float) -> DataFrame:
    return _mesh(spark, _middle(360, step_lon), _middle(180, step_lat))


def gaussian_grid(spark: SparkSession, step_lon: float, step_lat: float) -> DataFrame:
    """Steps from half a degree inside the map's corner."""
    line = lambda first, stop, step: (max(0, math.ceil((stop - first) / step)), first, float(step))
    return _mesh(spark, line(-179.5, 180.5, step_lon), line(-89.5, 90.5, step_lat))


def maxmin_offset(n: int) -> float:
    return next((e for least, e in reversed(MAXMIN_OFFSETS) if n >= least), SMALL_OFFSET)


def fibonacci_points(spark: SparkSession, n: int, offset: float = AVERAGE_OFFSET) -> DataFrame:
    """A spiral of n points, shifted off the poles by the offset."""
    i = F.col("id")
    azimuth = i * F.lit(2 * math.pi / ((1 + math.sqrt(5)) / 2))
    polar = F.acos(1.0 - 2.0 * (i + offset) / F.lit(n - 1 + 2 * offset))
    lon, lat = to_geographic(*from_angles(polar, azimuth))
    return spark.range(n).select(i.alias("point_id"), lon.alias("lon"), lat.alias("lat"))


def fibonacci_sphere(spark: SparkSession, n: int) -> DataFrame:
    """The older spiral, with points on both ends of the y axis."""
    i = F.col("id")
    y = 1.0 - (i / F.lit(float(n - 1))) * 2.0
    flat = F.sqrt(F.greatest(1.0 - y * y, F.lit(0.0)))
    turn = i * F.lit(math.pi * (3 - math.sqrt(5)))
    lon, lat = to_geographic(F.cos(turn) * flat, y, F.sin(turn) * flat)
    return spark.range(n).select(i.alias("point_id"), lon.alias("lon"), lat.alias("lat"))


def fibonacci_grid(spark: SparkSession, spacing_km: float, kind: str = "average", offset: float = AVERAGE_OFFSET) -> DataFrame:
    """Of about the spacing; kind: 'average', 'maxmin' or 'old'."""
    n = spacing_to_points(spacing_km)
    if kind == "old":
        return fibonacci_sphere(spark, n)
    if kind not in ("average", "maxmin"):
        raise ValueError("kind is 'average', 'maxmin' or 'old'")
    return fibonacci_points(spark, n, maxmin_offset(n) if kind == "maxmin" else offset)


def equator_spacing(step_lon: float) -> float:
    return degrees_to_km(step_lon)


def cut(grid: DataFrame, lat_range: tuple[float, float], lon_range: tuple[float, float]) -> DataFrame:
    """Points inside a closed box that doesn't cross the date line."""
    if lat_range[0] > lat_range[1] or lon_range[0] > lon_range[1]:
        raise ValueError("a range goes from its lower to its upper end")
    return grid.where(F.col("lat").between(*lat_range) & F.col("lon").between(*lon_range))


def stacked(grid: DataFrame) -> DataFrame:
    """loc: the place's number by latitude, then longitude; points in one place share it."""
    places = numbered(grid.select("lat", "lon").distinct(), ["lat", "lon"], "loc")
    return grid.join(places, ["lat", "lon"]).select(*grid.columns, "loc")


# --- grids as objects ---------------------------------------------------------------------------


class Grid:
    """Points on the sphere (point_id, lon, lat) with what all grids share. A grid is made from a rule,
    or from points given as a table or as lists."""

    def __init__(self, points: DataFrame, step_lon: float | None = None, spacing_km: float | None = None) -> None:
        missing = {"point_id", "lon", "lat"} - set(points.columns)
        if missing:
            raise ValueError(f"a grid needs the columns {sorted(missing)}")
        self.points = points.select(F.col("point_id").cast("long").alias("point_id"), F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))
        self.step_lon, self.spacing_km = step_lon, spacing_km

    @classmethod
    def of_lists(cls, spark: SparkSession, lon: list[float], lat: list[float]) -> Grid:
        if len(lon) != len(lat):
            raise ValueError("lon and lat go together")
        rows = [(k, float(x), float(y)) for k, (x, y) in enumerate(zip(lon, lat, strict=True))]
        return cls(spark.createDataFrame(rows, "point_id long, lon double, lat double"))

    @classmethod
    def regular(cls, spark: SparkSession, step_lon: float, step_lat: float) -> Grid:
        return cls(regular_grid(spark, step_lon, step_lat), step_lon)

    @classmethod
    def gaussian(cls, spark: SparkSession, step_lon: float, step_lat: float) -> Grid:
        return cls(gaussian_grid(spark, step_lon, step_lat), step_lon)

    @classmethod
    def fibonacci(cls, spark: SparkSession, spacing_km: float, kind: str = "average") -> Grid:
        return cls(fibonacci_grid(spark, spacing_km, kind), spacing_km=spacing_km)

    def num_points(self) -> int:
        """Points that a grid of the asked spacing has, or those that there are."""
        return self.points.count() if self.spacing_km is None else spacing_to_points(self.spacing_km)

    def distance_equator(self) -> float:
        """Kilometres between neighbours along the equator: of a mesh by its step, else the mean
        distance of points to their nearest neighbours."""
        if self.step_lon is not None:
            return equator_spacing(self.step_lon)
        from .regrid import neighbour_distance

        return neighbour_distance(self.points).agg(F.avg("dist")).first()[0]

    def cut(self, lat_range: tuple[float, float], lon_range: tuple[float, float]) -> Grid:
        return Grid(cut(self.points, lat_range, lon_range), self.step_lon)

    def stacked(self) -> DataFrame:
        return stacked(self.points)

    def min_dists(self, other: Grid | None = None) -> DataFrame:
        from .regrid import min_dists

        return min_dists(self.points, other.points if other else None)

    def keep_original_points(self, original: Grid) -> Grid:
        """Each point moved to the nearest corner of the original grid's cell around it."""
        from .regrid import keep_original_points

        moved = keep_original_points(self.points, original.points)
        return Grid(moved.select("point_id", F.col("c_lon").alias("lon"), F.col("c_lat").alias("lat")))
