"""Grids as table functions, for SQL and LATERAL joins: every row of a table can ask for points."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .grids import AVERAGE_OFFSET


@udtf(returnType="point_id bigint, lon double, lat double")
class SpiralPoints:
    """n points of a spiral around the sphere; none for a null or a number below 2."""

    def eval(self, n: int) -> Iterator[tuple[int, float, float]]:
        if n is None or n < 2:
            return
        golden = 2 * math.pi / ((1 + math.sqrt(5)) / 2)
        for k in range(n):
            polar = math.acos(1.0 - 2.0 * (k + AVERAGE_OFFSET) / (n - 1 + 2 * AVERAGE_OFFSET))
            turn = k * golden
            yield k, math.degrees(math.atan2(math.sin(turn) * math.sin(polar), math.cos(turn) * math.sin(polar))), math.degrees(math.asin(max(-1.0, min(1.0, math.cos(polar)))))


@udtf(returnType="point_id bigint, lon double, lat double")
class MeshPoints:
    """The points of a regular mesh of given steps inside a closed box, numbered by latitude, then
    longitude."""

    def eval(self, step: float, west: float, east: float, south: float, north: float) -> Iterator[tuple[int, float, float]]:
        if None in (step, west, east, south, north) or not step > 0:
            return
        lons = range(math.floor((east - west) / step + 1e-9) + 1)
        lats = range(math.floor((north - south) / step + 1e-9) + 1)
        for j in lats:
            for i in lons:
                yield j * len(lons) + i, west + i * step, south + j * step


def register(spark: SparkSession) -> None:
    """Makes spiral_points(n) and mesh_points(step, west, east, south, north) known to SQL."""
    spark.udtf.register("spiral_points", SpiralPoints)
    spark.udtf.register("mesh_points", MeshPoints)
