"""Spherical Voronoi cells, each from the points around it.

A cell is what all half-spaces towards its neighbours leave: x with x . (p - q) >= 0 for every other
point q. Seen from the centre of the sphere in the plane that touches it at p, these are half-planes,
so a cell is a convex polygon that neighbours clip one after the other. A point farther away than
twice the farthest corner clips nothing. So neighbours are looked up in cubes around a point, and a
cell is settled once the cubes reach so far; the others ask again with cubes twice as wide. No task
sees more than the points around some of them, and no grid stands in one row or on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM, to_cartesian
from ..storage import materialise

#: Half the side of the square that a cell starts from, in the plane that touches the sphere: a cell
#: that keeps a corner of it reaches beyond 89.9 degrees.
WIDE = 1e3
#: Cubes are at first so much smaller than an even grid of as many points would need.
DENSE = 8


def clip(polygon: np.ndarray, a: float, b: float, c: float) -> np.ndarray:
    """The part of a convex polygon where a * u + b * v <= c."""
    side = polygon @ np.array([a, b]) - c
    if (side <= 0).all():
        return polygon
    out = []
    for k in range(len(polygon)):
        p, q, s, t = polygon[k - 1], polygon[k], side[k - 1], side[k]
        if (s <= 0) != (t <= 0):
            out.append(p + (q - p) * (s / (s - t)))
        if t <= 0:
            out.append(q)
    return np.array(out).reshape(-1, 2)


def cell(p: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Corners (unit vectors, counter-clockwise seen from outside) of the cell of p among others, from
    the nearest on, until none that is left can reach the cell."""
    east = np.cross([0.0, 0.0, 1.0], p) if abs(p[2]) < 0.9 else np.cross([1.0, 0.0, 0.0], p)
    east /= np.linalg.norm(east)
    north = np.cross(p, east)
    polygon = np.array([(-WIDE, -WIDE), (WIDE, -WIDE), (WIDE, WIDE), (-WIDE, WIDE)])
    chord = np.linalg.norm(others - p, axis=1)
    order = np.argsort(chord, kind="stable")
    for k in order[chord[order] > 0].tolist():
        if chord[k] > 2 * math.sin(min(2 * _radius(polygon), math.pi) / 2):
            break
        # 1 - p . q by the chord, as the difference of the two would lose the digits of close points
        polygon = clip(polygon, others[k] @ east, others[k] @ north, chord[k] ** 2 / 2)
    corners = p + polygon[:, :1] * east + polygon[:, 1:] * north
    return corners / np.linalg.norm(corners, axis=1, keepdims=True)


def _radius(polygon: np.ndarray) -> float:
    """Angle from the cell's point to its farthest corner."""
    return math.atan(math.sqrt((polygon * polygon).sum(axis=1).max()))


def area(corners: np.ndarray) -> float:
    """Of a convex spherical polygon on the unit sphere: the angles of the triangles around its
    middle, which unlike the excess of its own angles stay exact for small cells."""
    middle = corners.sum(axis=0)
    middle /= np.linalg.norm(middle)
    total = 0.0
    for a, b in zip(corners, np.roll(corners, -1, axis=0), strict=True):
        total += 2 * math.atan2(middle @ np.cross(a, b), 1 + middle @ a + a @ b + b @ middle)
    return total


def voronoi_cells(grid: DataFrame) -> DataFrame:
    """point_id, lons, lats (arrays: the cell's corners, counter-clockwise) and area (km^2) of a grid
    point_id, lon, lat. Points in the same place share a cell. A cell has to lie within 89.9 degrees
    of its point: where points leave half of the sphere empty, that is a ValueError."""
    xyz = [c.alias(k) for c, k in zip(to_cartesian(F.col("lon"), F.col("lat")), "xyz", strict=True)]
    points = materialise(grid.select("point_id", *xyz), "points")
    n = points.count()
    size = 2 * math.sqrt(4 * math.pi / max(n, 1)) / DENSE
    open_, settled = points, []
    while True:
        last = size >= 2  # the 27 cubes hold the whole sphere
        made = materialise(_around(open_, points, size).mapInArrow(_cells(size, last), "point_id long, x double, y double, z double, lons array<double>, lats array<double>, area double"), "cells")
        settled.append(made.where("lons is not null").select("point_id", "lons", "lats", "area"))
        open_ = made.where("lons is null").select("point_id", "x", "y", "z")
        if last or open_.isEmpty():
            return reduce(DataFrame.unionByName, settled)
        size *= 2


def _around(open_: DataFrame, points: DataFrame, size: float) -> DataFrame:
    """point_id, x, y, z and near: the points of the 27 cubes around, as packed coordinates."""
    cube = [F.floor(F.col(k) / size).cast("int").alias(f"c{k}") for k in "xyz"]
    one = open_.select("point_id", "x", "y", "z", *cube)
    for c in ("cx", "cy", "cz"):
        one = one.select(*(k for k in one.columns if k != c), F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)).alias(c))
    two = points.select(*(F.col(k).alias(f"o{k}") for k in "xyz"), *cube).groupBy("cx", "cy", "cz").agg(*(F.collect_list(f"o{k}").alias(f"o{k}") for k in "xyz"))
    met = one.join(two, ["cx", "cy", "cz"])
    return met.groupBy("point_id", "x", "y", "z").agg(*(F.flatten(F.collect_list(f"o{k}")).alias(f"o{k}") for k in "xyz"))


def _cells(size: float, last: bool):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [b.column(f"o{k}") for k in "xyz"]
            ends = np.cumsum(np.asarray(lists[0].value_lengths())).tolist()
            others = np.stack([np.asarray(x.flatten()) for x in lists], axis=1) if b.num_rows else np.zeros((0, 3))
            own = np.stack([b.column(k).to_numpy() for k in "xyz"], axis=1) if b.num_rows else np.zeros((0, 3))
            lons, lats, areas = [], [], []
            for p, a, z in zip(own, [0, *ends[:-1]], ends, strict=True):
                corners = cell(p, others[a:z])
                reach = np.linalg.norm(corners - p, axis=1).max() if len(corners) else 2.0
                angle = 2 * math.asin(min(reach / 2, 1.0))
                # nothing beyond the cubes lies nearer than their side
                if not last and 2 * math.sin(min(2 * angle, math.pi) / 2) > size:
                    lons.append(None)
                    lats.append(None)
                    areas.append(None)
                    continue
                if angle > math.atan(WIDE / 2):
                    raise ValueError("a cell reaches around half of the sphere")
                lons.append(np.degrees(np.arctan2(corners[:, 1], corners[:, 0])).tolist())
                lats.append(np.degrees(np.arcsin(np.clip(corners[:, 2], -1, 1))).tolist())
                areas.append(area(corners) * EARTH_KM * EARTH_KM)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("point_id", "x", "y", "z")), pa.array(lons, pa.list_(pa.float64())), pa.array(lats, pa.list_(pa.float64())), pa.array(areas, pa.float64())], ["point_id", "x", "y", "z", "lons", "lats", "area"])

    return run


def even_corners(cells: DataFrame) -> DataFrame:
    """Cells with as many corners each as the largest has: the first one is repeated."""
    most = cells.agg(F.max(F.size("lons"))).first()[0] or 0
    padded = [F.concat(F.col(c), F.array_repeat(F.element_at(c, 1), F.lit(most) - F.size(c))).alias(c) for c in ("lons", "lats")]
    return cells.select("point_id", *padded, "area")
