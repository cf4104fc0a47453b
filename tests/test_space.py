"""Geometry, grids, regridding, storage and streams."""

from __future__ import annotations

import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempolink.functions import geo
from tempolink.functions.calendar import is_uniform, time_index
from tempolink.operators import grids, regrid, repulsion, voronoi
from tempolink.sources import blocks, synthetic
from tempolink.streaming import coincidence


def km(lon1, lat1, lon2, lat2):
    a, b, c, d = map(np.radians, (lon1, lat1, lon2, lat2))
    return 6371 * np.arccos(np.clip(np.sin(b) * np.sin(d) + np.cos(b) * np.cos(d) * np.cos(a - c), -1, 1))


@pytest.mark.parametrize("deg", [0.5, 1, 5, 10, 30])
def test_degrees_and_km(deg):
    assert geo.km_to_degrees(geo.degrees_to_km(deg)) == pytest.approx(deg)
    assert geo.degrees_to_km(5) == pytest.approx(555.97, abs=0.1)
    for bad in (0, -1, -10):
        with pytest.raises(ValueError):
            geo.degrees_to_km(bad)
        with pytest.raises(ValueError):
            geo.km_to_degrees(bad)


def test_spacing():
    assert geo.spacing_to_points(geo.points_to_spacing(5000)) in (4999, 5000)
    for bad in (0, -3, 2.5):
        with pytest.raises(ValueError):
            geo.points_to_spacing(bad)


def test_neighbours_on_a_line(spark):
    line = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 2.0, 0.0)], "point_id long, lon double, lat double")
    for r in regrid.neighbour_distance(line).collect():
        assert r["dist"] == pytest.approx(geo.degrees_to_km(1))
    assert regrid.neighbour_distance(line.limit(1)).first()["dist"] == regrid.NO_NEIGHBOUR


def test_nearest_far_apart(spark):
    """Clustered points whose neighbours lie beyond the first cubes."""
    rng = np.random.default_rng(1)
    lon = np.concatenate([rng.normal(0, 0.01, 40), [170.0, -60.0]])
    lat = np.concatenate([rng.normal(0, 0.01, 40), [10.0, -80.0]])
    grid = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lon, lat, strict=True))], "point_id long, lon double, lat double")
    d = km(lon[:, None], lat[:, None], lon[None], lat[None])
    np.fill_diagonal(d, np.inf)
    got = {r["point_id"]: r["dist"] for r in regrid.neighbour_distance(grid).collect()}
    assert all(got[i] == pytest.approx(d[i].min(), rel=1e-4, abs=1e-3) for i in range(42))


def test_grids(spark):
    g = grids.fibonacci_grid(spark, 800.0)
    assert g.count() == geo.spacing_to_points(800.0)
    got = regrid.neighbour_distance(g).agg(F.avg("dist")).first()[0]
    assert abs(got - 800) < 160
    assert grids.maxmin_offset(10) == 0.33 and grids.maxmin_offset(24) == 1.33 and grids.maxmin_offset(600_000) == 214
    r = grids.regular_grid(spark, 7.0, 11.0)
    n_lon, n_lat = int(np.ceil(360 / 7)), int(np.ceil(180 / 11))
    assert r.count() == n_lon * n_lat
    lo = r.agg(F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat")).first()
    assert lo[0] == pytest.approx(-lo[1]) and lo[2] == pytest.approx(-lo[3])
    with pytest.raises(ValueError):
        grids.cut(r, (10, -10), (0, 1))


def vectors(df):
    rows = df.orderBy("point_id").collect()
    lon, lat = np.radians([r["lon"] for r in rows]), np.radians([r["lat"] for r in rows])
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=1)


def as_grid(spark, x):
    lon, lat = np.degrees(np.arctan2(x[:, 1], x[:, 0])), np.degrees(np.arcsin(np.clip(x[:, 2], -1, 1)))
    return spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(lon, lat, strict=True))], "point_id long, lon double, lat double")


def random_directions(n, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, 3))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_repelled_grid(spark):
    g = repulsion.RepelledGrid(spark, 40)
    before = regrid.neighbour_distance(g.grid).agg(F.min("dist")).first()[0]
    g.improve(12)
    after = regrid.neighbour_distance(g.grid).agg(F.min("dist")).first()[0]
    assert after > before and g.num_iter == 12 and len(g.history[0]) == 12 and g.history[0][-1] < g.history[0][0]
    with pytest.raises(ValueError):
        repulsion.RepelledGrid(spark, 0)
    with pytest.raises(ValueError):
        repulsion.RepelledGrid(spark, 2, lon=[1.0])
    given = repulsion.RepelledGrid(spark, 3, lon=[0.0, 90.0, 180.0], lat=[0.0, 10.0, 0.0])
    assert given.num_points == 3 and repulsion.RepelledGrid.of(given.grid).num_points == 3


@pytest.mark.parametrize("block", [1000, 7])
def test_forces(spark, block):
    x = random_directions(40)
    x[5] = x[4]  # in one place
    got = {r["point_id"]: r for r in repulsion.descent(repulsion.from_degrees(as_grid(spark, x)), block).collect()}
    for k in range(40):
        diff = x[k] - np.delete(x, k, axis=0)
        dist = np.linalg.norm(diff, axis=1)
        apart = dist > 1e-9
        force = (diff[apart] / dist[apart, None] ** 3).sum(axis=0)
        want = (force - (force @ x[k]) * x[k]) / np.linalg.norm(force)
        if k not in (4, 5):
            assert np.allclose([got[k][c] for c in ("dx", "dy", "dz")], want, atol=1e-9) and got[k]["near"] == pytest.approx(dist.min())


def test_seeded_points_are_one_stream(spark):
    rng = np.random.default_rng(42)
    polar, turn = np.arccos(1 - 2 * rng.random(50)), 2 * np.pi * rng.random(50)
    want = np.stack([np.sin(polar) * np.cos(turn), np.sin(polar) * np.sin(turn), np.cos(polar)], axis=1)
    got = repulsion.seeded_points(spark, 50).orderBy("point_id").toPandas()[["x", "y", "z"]].to_numpy()
    assert np.allclose(got, want)
    one, steps = repulsion.repel(repulsion.seeded_points(spark, 1), 3)
    assert one.count() == 1 and steps == []


def test_mapping(spark):
    grid, target = grids.fibonacci_points(spark, 150), grids.regular_grid(spark, 20.0, 20.0)
    rows = regrid.map_to_regular_grid(grid, target).collect()
    used = [(r["c_lon"], r["c_lat"]) for r in rows if r["c_lon"] is not None]
    assert len(rows) == 150 and len(set(used)) == len(used)
    near = {r["point_id"]: r["dist"] for r in regrid.keep_original_points(grid, target).collect()}
    assert all(r["dist"] is None or r["dist"] >= near[r["point_id"]] - 1e-9 for r in rows)
    on_line = spark.createDataFrame([(0, 10.0, 0.0)], "point_id long, lon double, lat double")
    lines = spark.createDataFrame([(a, b) for a in (0.0, 10.0, 20.0) for b in (-5.0, 5.0)], "lon double, lat double")
    corners = {(r["c_lon"], r["c_lat"]) for r in regrid.corner_candidates(on_line, lines).collect()}
    assert corners == {(0.0, -5.0), (0.0, 5.0), (20.0, -5.0), (20.0, 5.0)}


@pytest.mark.parametrize(("n", "step", "box", "tile"), [(150, 20.0, 180, 32), (300, 10.0, 30, 2), (120, 4.0, 60, 1)])
def test_mapping_is_one_after_the_other(spark, monkeypatch, n, step, box, tile):
    monkeypatch.setattr(regrid, "TILE", tile)
    rng = np.random.default_rng(n)
    points = [(k, float(a), float(b)) for k, (a, b) in enumerate(zip(rng.uniform(-box, box, n), rng.uniform(-box / 2, box / 2, n), strict=True))]
    points += [(n, *points[3][1:]), (n + 1, *points[3][1:])]  # ties
    grid, target = spark.createDataFrame(points, "point_id long, lon double, lat double"), grids.regular_grid(spark, step, step)
    candidates = regrid.corner_candidates(grid, target).toPandas()
    candidates["nearest"] = candidates.groupby("point_id")["dist"].transform("min")
    taken, want = set(), {}
    for point, rows in candidates.sort_values(["nearest", "point_id", "dist", "corner"]).groupby("point_id", sort=False):
        want[point] = next((c for c in zip(rows["c_lon"], rows["c_lat"], strict=True) if c not in taken), (None, None))
        taken.add(want[point])
    assert {r["point_id"]: (r["c_lon"], r["c_lat"]) for r in regrid.map_to_regular_grid(grid, target).collect()} == want


def turn_of(axis, angle):
    a = np.asarray(axis, float) / np.linalg.norm(axis)
    k = np.array([[0, -a[2], a[1]], [a[2], 0, -a[0]], [-a[1], a[0], 0]])
    return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * k @ k


def test_alignment(spark):
    grid = grids.fibonacci_points(spark, 80)
    turned = grid.withColumn("lon", F.col("lon") + 25.0)
    for by in ("arcs", "chords"):
        back = regrid.align_to(turned, grid, by).withColumnsRenamed({"lon": "x", "lat": "y"}).join(grid, "point_id")
        assert back.agg(F.max(geo.great_circle(F.col("x"), F.col("y"), F.col("lon"), F.col("lat")))).first()[0] < 1e-3
    with pytest.raises(ValueError):
        regrid.align_to(turned, grid, "squares")
    with pytest.raises(ValueError):
        regrid.arc_rotation(turned, grid.limit(0))


def test_alignment_with_noise_and_outliers(spark):
    """The least sum of distances, which with a fifth of the points astray is another rotation than
    that of least squares; no small turn makes it less."""
    rng = np.random.default_rng(1)
    x, r = random_directions(150, 1), turn_of([0.3, -0.5, 0.8], 0.7)
    goal = x @ r.T + rng.normal(size=x.shape) * 0.02
    goal[:30] = random_directions(30, 2)
    goal /= np.linalg.norm(goal, axis=1, keepdims=True)
    total = lambda q: np.arccos(np.clip((x @ q.T * goal).sum(axis=1), -1, 1)).sum()
    found, said, turns = regrid.arc_rotation(as_grid(spark, x), as_grid(spark, goal))
    chords = regrid.chord_rotation(as_grid(spark, x), as_grid(spark, goal))
    assert said == pytest.approx(total(found), abs=1e-7) and 0 < turns < regrid.TURNS
    assert total(found) < total(chords) - 1e-3 and np.abs(found - r).max() < np.abs(chords - r).max()
    near = [total(turn_of(rng.normal(size=3), 10.0 ** rng.uniform(-6, -0.5)) @ found) for _ in range(1000)]
    assert min(near) >= total(found) - 1e-9


def hull_cells(x):
    """Corners of each point's cell: the circumcentres of the triangles with nothing inside."""
    out = [set() for _ in x]
    for i, j, k in itertools.combinations(range(len(x)), 3):
        centre = np.cross(x[j] - x[i], x[k] - x[i])
        centre /= np.linalg.norm(centre)
        for c in (centre, -centre):
            if (x @ c <= x[i] @ c + 1e-12).all():
                for p in (i, j, k):
                    out[p].add(tuple(np.round(c, 7)))
    return out


@pytest.mark.parametrize("kind", ["random", "uneven", "few"])
def test_voronoi(spark, kind):
    x = random_directions(26 if kind == "random" else 14, 5)
    if kind == "uneven":  # most points close together
        x = np.concatenate([x, x[0] + 0.01 * random_directions(14, 6)])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "few":
        x = np.array([[1.0, 0, 0], [-1, 0, 0], [0, 1, 0], [0, -1, 0], [0, 0, 1], [0, 0, -1]]) @ turn_of([1, 2, 3], 0.4).T
    cells = {r["point_id"]: r for r in voronoi.voronoi_cells(as_grid(spark, x)).collect()}
    assert sum(r["area"] for r in cells.values()) == pytest.approx(4 * np.pi * geo.EARTH_KM**2, rel=1e-9)
    for p, want in enumerate(hull_cells(x)):
        lon, lat = np.radians(cells[p]["lons"]), np.radians(cells[p]["lats"])
        got = {tuple(c) for c in np.round(np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=1), 7)}
        assert all(min(np.abs(np.subtract(a, b)).max() for b in want) < 1e-5 for a in got) and all(min(np.abs(np.subtract(a, b)).max() for b in got) < 1e-5 for a in want)


def test_voronoi_pads_corners_and_refuses_half_spheres(spark):
    cells = voronoi.even_corners(voronoi.voronoi_cells(grids.fibonacci_points(spark, 30)))
    assert cells.agg(F.min(F.size("lons")) == F.max(F.size("lons"))).first()[0]
    with pytest.raises(Exception, match="half of the sphere"):
        voronoi.voronoi_cells(as_grid(spark, np.array([[1.0, 0, 0], [0, 1, 0], [0, 0, 1]]))).collect()


def test_blocks(spark, tmp_path):
    pairs = spark.range(100).select((F.col("id") % 10).alias("a"), (F.col("id") / 10).cast("long").alias("b"), F.col("id").alias("k"))
    path = str(tmp_path / "blocks")
    blocks.write_blocks(pairs, path, 4)
    got = blocks.read_blocks(spark, path, 4, (3, 5), (0, 1))
    assert sorted((r["a"], r["b"], r["k"]) for r in got.collect()) == sorted((a, b, b * 10 + a) for a in (3, 4, 5) for b in (0, 1))
    with pytest.raises(FileNotFoundError):
        blocks.read_blocks(spark, str(tmp_path / "none"))
    grid = grids.regular_grid(spark, 120.0, 90.0)
    blocks.save_grid(grid, str(tmp_path / "grid"))
    assert blocks.load_grid(spark, str(tmp_path / "grid")).count() == 6
    corners = spark.createDataFrame([(k, [1.0, 2.0], [3.0, 4.0 + k]) for k in range(6)], "point_id long, lons array<double>, lats array<double>")
    text = [r["value"] for r in blocks.gridfile_lines(grid, corners, 1).orderBy("line").collect()]
    assert text[:6] == ["gridtype\t= unstructured", "gridsize\t= 6", "xsize\t= 6", "ysize\t= 6", "nvertex\t= 2", "xvals\t= -120.0   0.0   120.0   -120.0   0.0   120.0"]
    assert text[6] == "yvals\t= -45.0   -45.0   -45.0   45.0   45.0   45.0" and text[7].startswith("xbounds\t= 1.0   2.0   1.0") and text[8].endswith("3.0   8.0   3.0   9.0") and text[9:] == ["xunits\t= degrees", "yunits\t= degrees"]
    blocks.write_gridfile(grids.regular_grid(spark, 30.0, 30.0), str(tmp_path / "cdo"))
    read = "\n".join(p.read_text().rstrip("\n") for p in sorted((tmp_path / "cdo").glob("part-*")))
    assert [float(v) for v in read.split("yvals\t= ")[1].split("xunits")[0].split()] == [-75.0 + 30 * (k // 12) for k in range(72)]


def test_synthetic(spark):
    field = synthetic.seeded_field(spark, 5, 20)
    assert field.count() == 100 and field.select("loc").distinct().count() == 5
    share = synthetic.seeded_events(spark, 100, 100, 0.05).count() / 10_000
    assert 0.03 < share < 0.07


def test_time_index(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-03-02 05:30:00' AS t")
    ref = dt.datetime(2024, 1, 1)
    got = [df.select(time_index(F.col("t"), ref, f)).first()[0] for f in ("h", "D", "W", "M")]
    assert got == [61 * 24 + 5, 61, 8, 2]
    with pytest.raises(ValueError):
        time_index(F.col("t"), ref, "Y")
    days = spark.sql("SELECT explode(sequence(date'2024-01-01', date'2024-01-10')) AS time")
    assert is_uniform(days).first()["uniform"]


def test_streams(spark, tmp_path):
    rows = [(1, dt.datetime(2024, 1, 1, 0, 0, s), v) for s, v in ((0, 5.0), (10, 1.0), (20, float("nan")), (30, 9.0))]
    spark.createDataFrame(rows, "loc long, time timestamp, value double").write.parquet(str(tmp_path / "in"))
    field = spark.readStream.schema("loc long, time timestamp, value double").parquet(str(tmp_path / "in"))

    def run(df, name):
        df.writeStream.format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    assert len(run(coincidence.stream_events(field, 5.0), "s_events")) == 2
    found = run(coincidence.stream_precursors(coincidence.stream_events(field, 5.0), coincidence.stream_events(field, 5.0), 60), "s_pairs")
    assert len(found) == 3
    assert coincidence.stream_counts(field, "1 minute").isStreaming


def test_histogram_peaks_and_spacing_fit(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 2.05), ("a", 3.0), ("a", None), ("b", 5.0), ("b", 5.0), ("c", None), ("d", 0.0), ("d", 4.0)]
    got = {r["g"]: r["peak"] for r in regrid.histogram_peaks(spark.createDataFrame(rows, "g string, v double"), "g", "v", 10).collect()}
    want = {}
    for g in "abd":
        n, edges = np.histogram([v for k, v in rows if k == g and v is not None], bins=10)
        want[g] = edges[np.argmax(n)]
    assert got == pytest.approx(want)
    sizes, peaks = (60, 120, 240), []
    for size in sizes:
        p = np.array([(r["lon"], r["lat"]) for r in grids.fibonacci_sphere(spark, size).collect()])
        lon, lat = np.radians(p).T
        x = np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], 1)
        far = np.linalg.norm(x[:, None] - x[None], axis=2) + 9 * np.eye(size)
        n, edges = np.histogram(2 * np.arcsin(far.min(1) / 2), bins=5)
        peaks.append(edges[np.argmax(n)])
    slope, _ = np.polyfit(np.log(peaks), np.log(sizes), 1)
    assert regrid.spacing_fit(spark, sizes, 5).first()["slope"] == pytest.approx(slope, rel=1e-6)
