"""Distances between grids, and mappings of one grid onto another."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM, great_circle, to_cartesian
from ..storage import materialise
from .grids import fibonacci_sphere

#: The distance of a point that has no other, in km.
NO_NEIGHBOUR = 9999.0


def _cells(grid: DataFrame, size: float) -> DataFrame:
    x, y, z = to_cartesian(F.col("lon"), F.col("lat"))
    return grid.select("point_id", "lon", "lat", *(F.floor(v / size).cast("int").alias(c) for v, c in ((x, "cx"), (y, "cy"), (z, "cz"))))


def _around(c: str) -> Column:
    return F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)).alias(c)


def nearest(grid: DataFrame, other: DataFrame, same: bool) -> DataFrame:
    """point_id, dist (km) of the nearest point of other; itself excluded if the grids are the same.

    Points fall into cubes about as wide as the grid's spacing, and meet only those of the 27 cubes
    around them. A neighbour closer than a cube is wide is the nearest for certain; the few points
    without one are asked again with cubes twice as wide, until all are settled."""
    n = other.count()
    if n == 0 or (same and n == 1):
        return grid.select("point_id", F.lit(NO_NEIGHBOUR).alias("dist"))
    size, open_, settled = 2 * math.sqrt(4 * math.pi / n), grid.select("point_id", "lon", "lat"), []
    while True:
        last = size >= 2  # the 27 cubes hold the whole sphere
        one = _cells(open_, size)
        for c in ("cx", "cy", "cz"):
            one = one.select(*(k for k in one.columns if k != c), _around(c))
        two = _cells(other, size).withColumnsRenamed({"point_id": "id2", "lon": "lon2", "lat": "lat2"})
        met = one.join(two, ["cx", "cy", "cz"])
        if same:
            met = met.where("point_id != id2")
        # a chord of `size` as an arc
        sure = 2 * EARTH_KM * math.asin(min(size, 2) / 2)
        best = met.groupBy("point_id").agg(F.min(great_circle(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2"))).alias("dist"))
        settled.append(best if last else best.where(F.col("dist") < sure))
        if last:
            break
        open_ = open_.join(settled[-1], "point_id", "left_anti")
        if open_.isEmpty():
            break
        size *= 2
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out


def neighbour_distance(grid: DataFrame) -> DataFrame:
    """point_id, dist: great-circle distance to the nearest other point."""
    return nearest(grid, grid, same=True)


def histogram_peaks(values: DataFrame, by: str, value: str, bins: int = 100) -> DataFrame:
    """by, peak: for each group the lower edge of the fullest of equal bins from its least to its
    largest value; of equally full ones the first. Equal values lie in the middle of a width of 1."""
    given = values.select(F.col(by).alias("group"), F.col(value).cast("double").alias("v")).where("v is not null")
    least, most = F.min("v"), F.max("v")
    ends = given.groupBy("group").agg(F.when(least < most, least).otherwise(least - 0.5).alias("lo"), F.when(least < most, most).otherwise(most + 0.5).alias("hi")).withColumnRenamed("group", "of")
    at = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    full = given.join(ends, F.col("group").eqNullSafe(F.col("of"))).drop("of").groupBy("group", "lo", "hi", at.alias("bin")).agg(F.count("*").alias("n"))
    edge = F.col("lo") + F.col("bin") * ((F.col("hi") - F.col("lo")) / bins)
    return full.groupBy("group").agg(F.max_by(edge, F.struct(F.col("n"), -F.col("bin"))).alias("peak")).withColumnRenamed("group", by)


def log_log_fit(points: DataFrame, x: str, y: str) -> DataFrame:
    """One row, slope and intercept of the least-squares line of ln(y) over ln(x)."""
    return points.agg(F.regr_slope(F.ln(y), F.ln(x)).alias("slope"), F.regr_intercept(F.ln(y), F.ln(x)).alias("intercept"))


#: 20 numbers of points, evenly from 200 to 10,000.
FIT_SIZES = tuple(200 + 9800 * k // 19 for k in range(20))


def spacing_fit(spark: SparkSession, sizes: tuple[int, ...] = FIT_SIZES, bins: int = 100) -> DataFrame:
    """One row, slope and intercept: ln(number of points) of old spirals over ln(the commonest distance
    to the nearest neighbour)."""
    each = [neighbour_distance(fibonacci_sphere(spark, n)).select(F.lit(n).alias("n"), "dist") for n in sizes]
    return log_log_fit(histogram_peaks(reduce(DataFrame.unionByName, each), "n", "dist", bins), "peak", "n")


def min_dists(grid: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """point_id, dist to the nearest point of the other grid, or of its own; never more than 9999."""
    found = nearest(grid, grid if other is None else other, same=other is None)
    return found.withColumn("dist", F.least("dist", F.lit(NO_NEIGHBOUR)))


def _brackets(grid: DataFrame, target: DataFrame, axis: str) -> DataFrame:
    """point_id and the two neighbouring lines of the target that enclose it strictly, or its first
    and last line. A range lookup on a bounded list: the distinct lines of a regular grid."""
    lines = target.select(axis).distinct().agg(F.sort_array(F.collect_list(axis)).alias("lines"))
    v, all_lines = F.col(axis), F.col("lines")
    above = F.array_min(F.filter(all_lines, lambda x: x > v))
    below = F.array_max(F.filter(all_lines, lambda x: x < v))
    on_line = F.array_contains(all_lines, v)
    outside = above.isNull() | below.isNull() | on_line
    first, last = F.element_at(all_lines, 1), F.element_at(all_lines, -1)
    return grid.join(F.broadcast(lines)).select(*grid.columns, F.when(outside, first).otherwise(below).alias(f"{axis}_lo"), F.when(outside, last).otherwise(above).alias(f"{axis}_hi"))


def corner_candidates(grid: DataFrame, target: DataFrame) -> DataFrame:
    """point_id, lon, lat, corner (0-3, by longitude then latitude), c_lon, c_lat, dist."""
    wide = _brackets(_brackets(grid.select("point_id", "lon", "lat"), target, "lon"), target, "lat")
    corners = F.array(*(F.struct(F.lit(k).alias("corner"), F.col(f"lon_{x}").alias("c_lon"), F.col(f"lat_{y}").alias("c_lat")) for k, (x, y) in enumerate((x, y) for x in ("lo", "hi") for y in ("lo", "hi"))))
    flat = wide.select("point_id", "lon", "lat", F.explode(corners).alias("c")).select("point_id", "lon", "lat", "c.*")
    return flat.withColumn("dist", great_circle(F.col("c_lon"), F.col("c_lat"), F.col("lon"), F.col("lat")))


def keep_original_points(grid: DataFrame, original: DataFrame) -> DataFrame:
    """point_id, c_lon, c_lat, dist: the nearest corner of the original grid's cell around each
    point; the first one where they tie. Several points may share a corner."""
    order = F.struct("dist", "corner")
    best = corner_candidates(grid, original).groupBy("point_id").agg(F.min_by(F.struct("c_lon", "c_lat", "dist"), order).alias("b"))
    return best.select("point_id", "b.*")


#: Points of a cell that can be served: it has four corners, and each point before takes one.
SERVED = 4
#: Lines of the target in a tile.
TILE = 32


def ranked_candidates(grid: DataFrame, target: DataFrame) -> DataFrame:
    """point_id, nearest, corner, c_lon, c_lat, dist, and tile coordinates, for the points that can get
    a corner. Of the points between the same lines only the first four can: each of them takes one of
    the same four corners, or finds that all are taken."""
    wide = corner_candidates(grid, target)
    point = wide.groupBy("point_id").agg(F.min("dist").alias("nearest"), F.min("c_lon").alias("x"), F.min("c_lat").alias("y"), F.max("c_lon").alias("x2"), F.max("c_lat").alias("y2"))
    turn = F.row_number().over(Window.partitionBy("x", "y", "x2", "y2").orderBy("nearest", "point_id"))
    first = point.withColumn("turn", turn).where(F.col("turn") <= SERVED).select("point_id", "nearest", "x", "y")
    return first.join(wide.select("point_id", "corner", "c_lon", "c_lat", "dist"), "point_id")


def _serve(pdf: pd.DataFrame) -> pd.DataFrame:
    """What a tile can settle: rows of settled points, with the corner or with none.

    `owner` says whether a point comes first among all that still want the corner, `inside` whether
    all of these stand in the tile. In the order of their turn, a point takes its best free corner if
    it comes first there, or if the corner is the tile's own and no earlier point is still unsettled
    that wants it."""
    pdf = pdf.sort_values(["nearest", "point_id", "dist", "corner"], kind="stable")
    points = [(p, list(zip(g["c_lon"], g["c_lat"], g["dist"], g["owner"], g["inside"], strict=True))) for p, g in pdf.groupby("point_id", sort=False)]
    taken, out, waiting = set(), [], set()
    for point, wants in points:
        free = [w for w in wants if w[:2] not in taken]
        best = free[0] if free else None
        # corners taken here in this turn are gone for all; others' turns at open corners are unknown
        if best is None or best[3] or (best[4] and best[:2] not in waiting):
            out.append((point, *(best[:3] if best else (np.nan, np.nan, np.nan))))
            if best:
                taken.add(best[:2])
        else:
            waiting.update(w[:2] for w in free)
    return pd.DataFrame(out, columns=["point_id", "c_lon", "c_lat", "dist"])


def map_to_regular_grid(grid: DataFrame, target: DataFrame) -> DataFrame:
    """point_id, c_lon, c_lat, dist: a corner for each point, each corner once; points are served by
    the distance of their nearest corner, ties by point_id, and null if all four are taken.

    The result is that of serving one point after the other, but a point need not wait for all before
    it: it is settled as soon as no earlier unsettled point wants its best free corner. So all such
    points are settled at once, in rounds. Within a tile of the target, whose corners only its own
    points want, a round follows the whole chain of points that wait for one another; tiles shift by
    half from round to round. A tile holds four points a cell at most, whatever the grid."""
    open_ = materialise(ranked_candidates(grid, target), "candidates")
    lines = {c: open_.agg(F.countDistinct(c), F.min(c), F.max(c)).first() for c in ("c_lon", "c_lat")}
    width = {c: TILE * (hi - lo) / max(n - 1, 1) or 1.0 for c, (n, lo, hi) in lines.items() if n}
    settled: list[DataFrame] = []
    while not open_.isEmpty():
        shift = len(settled) % 2 / 2
        tile = [F.floor(F.col(k) / F.lit(width[c]) + F.lit(shift)).alias(t) for k, c, t in (("x", "c_lon", "tx"), ("y", "c_lat", "ty"))]
        tiled = open_.select("*", *tile)
        first = F.min(F.struct("nearest", "point_id"))["point_id"].alias("first")
        corners = tiled.groupBy("c_lon", "c_lat").agg(first, *(f(t).alias(f"{t}_{n}") for t in ("tx", "ty") for n, f in (("lo", F.min), ("hi", F.max))))
        inside = (F.col("tx_lo") == F.col("tx_hi")) & (F.col("ty_lo") == F.col("ty_hi"))
        wide = tiled.join(corners, ["c_lon", "c_lat"]).select("point_id", "nearest", "corner", "c_lon", "c_lat", "dist", "tx", "ty", (F.col("first") == F.col("point_id")).alias("owner"), inside.alias("inside"))
        done = materialise(wide.groupBy("tx", "ty").applyInPandas(_serve, "point_id long, c_lon double, c_lat double, dist double"), "served")
        settled.append(done)
        left = open_.join(done.select("point_id"), "point_id", "left_anti")
        taken = done.where(~F.isnan("c_lon")).select("c_lon", "c_lat")
        # a point whose corners are all gone stays with a mark instead of candidates
        rest = left.join(taken, ["c_lon", "c_lat"], "left_anti").select(*open_.columns)
        gone = left.select("point_id").distinct().join(rest.select("point_id").distinct(), "point_id", "left_anti")
        settled.append(materialise(gone.select("point_id", *(F.lit(None).cast("double").alias(c) for c in ("c_lon", "c_lat", "dist"))), "unserved"))
        open_ = materialise(rest, "candidates")
    made = reduce(DataFrame.unionByName, settled) if settled else grid.select("point_id", *(F.lit(None).cast("double").alias(c) for c in ("c_lon", "c_lat", "dist"))).limit(0)
    every = grid.select("point_id").join(made, "point_id", "left")
    return every.select("point_id", *(F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("c_lon", "c_lat", "dist")))


# --- alignment ----------------------------------------------------------------------------------

#: Sums of distances that differ by less than this share are taken for equal; turns at most.
CLOSE_ENOUGH, TURNS = 1e-12, 200
#: Below this sine of an angle a pair weighs no more.
LEAST_SINE = 1e-9


def _pairs(grid: DataFrame, target: DataFrame) -> DataFrame:
    """x, y, z of the grid's points beside u, v, w of the target's of the same point_id."""
    one, two = (g.select("point_id", *(c.alias(n) for c, n in zip(to_cartesian(F.col("lon"), F.col("lat")), names, strict=True))) for g, names in ((grid, "xyz"), (target, "uvw")))
    return one.join(two, "point_id")


def _products(pairs: DataFrame, r: np.ndarray | None) -> tuple[np.ndarray | None, float]:
    """Sums of products of coordinates, and the sum of the great-circle distances (in radians) after
    a rotation r: with it, a pair weighs the inverse of its distance's sine, as the distance's
    derivative has it; without it, all weigh alike."""
    if r is None:
        weight, angle = F.lit(1.0), F.lit(0.0)
    else:
        turned = [sum((F.lit(float(r[i, k])) * F.col("xyz"[k]) for k in range(1, 3)), F.lit(float(r[i, 0])) * F.col("x")) for i in range(3)]
        dot = sum((turned[k] * F.col("uvw"[k]) for k in range(1, 3)), turned[0] * F.col("u"))
        cross = [turned[(k + 1) % 3] * F.col("uvw"[(k + 2) % 3]) - turned[(k + 2) % 3] * F.col("uvw"[(k + 1) % 3]) for k in range(3)]
        sine = F.sqrt(cross[0] * cross[0] + cross[1] * cross[1] + cross[2] * cross[2])
        weight, angle = F.lit(1.0) / F.greatest(sine, F.lit(LEAST_SINE)), F.atan2(sine, dot)
    row = pairs.agg(*(F.sum(weight * F.col(a) * F.col(b)).alias(a + b) for a in "xyz" for b in "uvw"), F.sum(angle).alias("angle")).first()
    return (None, 0.0) if row[0] is None else (np.array(row[:9], float).reshape(3, 3), float(row["angle"]))


def _rotation(products: np.ndarray) -> np.ndarray:
    """The rotation of the largest sum of inner products."""
    u, _, vt = np.linalg.svd(products)
    turn = np.diag([1, 1, np.sign(np.linalg.det(u) * np.linalg.det(vt))])
    return vt.T @ turn @ u.T


def chord_rotation(grid: DataFrame, target: DataFrame) -> np.ndarray:
    """The rotation matrix that brings points nearest to those of the same point_id by least squares of
    chords: sums of products over all points, then one 3 x 3 decomposition."""
    products, _ = _products(_pairs(grid, target), None)
    if products is None:
        raise ValueError("the grids have no point in common")
    return _rotation(products)


def arc_rotation(grid: DataFrame, target: DataFrame, turns: int = TURNS) -> tuple[np.ndarray, float, int]:
    """The rotation matrix with the least sum of great-circle distances to the points of the same
    point_id, that sum in radians, and the turns it took. Unlike squares of chords, a sum of distances
    follows most points and lets a few stray far.

    From the rotation by chords on, each turn weighs the products by the distance's derivative at the
    present rotation and decomposes their sums again, of which the best is a rotation where the sum of
    distances has no slope. Ten sums a turn leave Spark; a rotation that makes the sum larger is taken
    by half its way."""
    pairs = materialise(_pairs(grid, target), "aligned")
    products, _ = _products(pairs, None)
    if products is None:
        raise ValueError("the grids have no point in common")
    r = _rotation(products)
    products, best = _products(pairs, r)
    for turn in range(1, turns + 1):
        to = _rotation(products)
        for _ in range(30):
            after, total = _products(pairs, to)
            if total <= best:
                break
            to = _halfway(r, to)
        gain = best - total
        if gain > 0:
            r, products, best = to, after, total
        if gain <= CLOSE_ENOUGH * max(best, 1e-300) or best == 0:
            return r, best, turn
    return r, best, turns


def _halfway(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rotation in the middle of two, by the nearest rotation to their sum."""
    u, _, vt = np.linalg.svd(a + b)
    return u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt))]) @ vt


def turned(grid: DataFrame, r: np.ndarray) -> DataFrame:
    """point_id, lon, lat of the grid after a rotation."""
    xyz = to_cartesian(F.col("lon"), F.col("lat"))
    x, y, z = (sum((float(r[i, k]) * xyz[k] for k in range(1, 3)), float(r[i, 0]) * xyz[0]) for i in range(3))
    z = F.greatest(F.least(z, F.lit(1.0)), F.lit(-1.0))
    return grid.select("point_id", F.degrees(F.atan2(y, x)).alias("lon"), F.degrees(F.asin(z)).alias("lat"))


def align_to(grid: DataFrame, target: DataFrame, by: str = "arcs") -> DataFrame:
    """point_id, lon, lat of the grid, turned onto the target: by "arcs" with the least sum of
    great-circle distances, by "chords" with the least sum of squared chords."""
    if by not in ("arcs", "chords"):
        raise ValueError("by is 'arcs' or 'chords'")
    return turned(grid, arc_rotation(grid, target)[0] if by == "arcs" else chord_rotation(grid, target))
