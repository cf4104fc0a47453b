"""What replaced steps on the driver or in one task: radix selection, numbering in ranges, counts of
several windows at once, merged null models, files read by ranges, table functions and streams."""

from __future__ import annotations

import datetime as dt
import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tempolink import storage
from tempolink.operators import axis, grids, links, pairs, quantile, significance, tables, windows
from tempolink.operators.windows import Coincidence
from tempolink.plans.networks import eca_joint_network, eca_network, es_network
from tempolink.sources import netcdf, synthetic
from tempolink.streaming import coincidence

# --- selection ----------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(allow_nan=False), min_size=1, max_size=30))
def test_bits_sort_as_numbers(values):
    x = np.array(values)
    bits = quantile.ordered_bits(x).view(np.uint64)
    assert np.array_equal(x[np.argsort(bits, kind="stable")], np.sort(x))
    assert all(quantile.from_ordered_bits(int(b)) == v for b, v in zip(quantile.ordered_bits(x), x, strict=True))


@pytest.mark.parametrize("q", [0.0, 0.13, 0.5, 0.95, 1.0])
def test_quantile(spark, q):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(size=300) * 10.0 ** rng.integers(-8, 8, 300), np.repeat([-1.5, 0.0, -0.0, 7.0], 40)]).tolist()
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(5)
    assert quantile.exact_quantile(rows, "v", q) == pytest.approx(np.quantile(values, q), rel=1e-12)
    pairs_ = spark.createDataFrame([(k, 0, float(v)) for k, v in enumerate(values)], "a long, b long, v double")
    assert links.by_quantile(pairs_, "v", q).where("link").count() == int((np.array(values) >= quantile.exact_quantile(rows, "v", q)).sum())


def test_quantile_without_values_and_of_infinities(spark):
    none = spark.createDataFrame([(None,)], "v double")
    assert quantile.exact_quantile(none, "v", 0.5) is None
    assert not links.by_quantile(none, "v", 0.5).where("link").count()
    ends = spark.createDataFrame([(-math.inf,), (1.0,), (math.inf,), (math.nan,)], "v double")
    assert quantile.exact_quantile(ends, "v", 0.0) == -math.inf and quantile.exact_quantile(ends, "v", 1 / 3) == 1.0 and math.isnan(quantile.exact_quantile(ends, "v", 1.0))
    with pytest.raises(ValueError):
        quantile.exact_quantile(ends, "v", 1.5)


# --- numbering ----------------------------------------------------------------------------------


def test_numbering_in_ranges(spark):
    rng = np.random.default_rng(2)
    rows = sorted({(float(a), int(b)) for a, b in zip(rng.integers(-50, 50, 2000) / 4, rng.integers(0, 99, 2000), strict=True)})
    shuffled = [rows[k] for k in rng.permutation(len(rows))]
    made = axis.numbered(spark.createDataFrame(shuffled, "lat double, k long").repartition(7), ["lat", "k"], "n")
    assert [(r["lat"], r["k"]) for r in made.orderBy("n").collect()] == rows
    assert sorted(r["n"] for r in made.collect()) == list(range(len(rows)))
    assert axis.numbered(made.limit(0).drop("n"), ["lat", "k"], "n").count() == 0
    plan = made._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_stack_of_shared_places(spark):
    grid = spark.createDataFrame([(5, 1.0, 2.0), (6, 1.0, 2.0), (7, 0.0, 2.0), (8, 9.0, -3.0)], "point_id long, lon double, lat double")
    assert {r["point_id"]: r["loc"] for r in grids.stacked(grid).collect()} == {5: 2, 6: 2, 7: 1, 8: 0}


def test_grids_of_given_points(spark):
    g = grids.Grid.of_lists(spark, [0.0, 10.0, 20.0], [0.0, 0.0, 50.0])
    assert g.num_points() == 3 and g.cut((-1, 1), (5, 15)).num_points() == 1
    assert grids.Grid.fibonacci(spark, 900.0).num_points() == grids.Grid.fibonacci(spark, 900.0).points.count()
    assert grids.Grid.regular(spark, 10.0, 10.0).distance_equator() == pytest.approx(grids.equator_spacing(10.0))
    assert g.distance_equator() > 1000 and g.min_dists().count() == 3
    assert grids.Grid.gaussian(spark, 40.0, 30.0).stacked().count() == 9 * 6
    assert {(r["lon"], r["lat"]) for r in g.keep_original_points(grids.Grid.of_lists(spark, [a for a in (-5.0, 15.0, 30.0) for _ in range(2)], [-10.0, 60.0] * 3)).points.collect()} <= {(a, b) for a in (-5.0, 15.0, 30.0) for b in (-10.0, 60.0)}
    with pytest.raises(ValueError):
        grids.Grid(spark.range(3))
    with pytest.raises(ValueError):
        grids.Grid.of_lists(spark, [1.0], [])


# --- pairs --------------------------------------------------------------------------------------


def series(spark, matrix):
    rows = [(int(i), int(t)) for i, t in zip(*np.nonzero(matrix), strict=True)]
    return spark.createDataFrame(rows, "loc long, t_idx int"), spark.createDataFrame([(i,) for i in range(len(matrix))], "loc long")


@pytest.mark.parametrize("strategy", ["bitmap", "sparse", "matmul"])
def test_two_windows_in_one_pass(spark, monkeypatch, strategy):
    monkeypatch.setattr(pairs, "BLOCK", 3)
    ev, nodes = series(spark, np.random.default_rng(3).random((8, 70)) < 0.2)
    pre, tri = windows.precursor_window(ev, 70, Coincidence(2, True, 0)), windows.trigger_window(ev, 70, Coincidence(5, False, 1))
    got = {(r["a"], r["b"]): (r["pre"], r["tri"]) for r in pairs.fused_counts({"pre": pre, "tri": tri}, ev, nodes, nodes, 70, strategy).collect()}
    one, two = ({(r["a"], r["b"]): r["k"] for r in pairs.pair_counts(w, ev, nodes, nodes, 70, "sparse").collect()} for w in (pre, tri))
    assert got == {p: (one[p], two[p]) for p in itertools.product(range(8), range(8))}


def test_joint_network_makes_pairs_once(spark):
    ev, nodes = series(spark, np.random.default_rng(4).random((9, 200)) < 0.1)
    pre, tri = Coincidence(2, True, 0), Coincidence(10, True, 0)
    joint = eca_joint_network(ev, nodes, 200, pre, tri, 0.9)
    one = eca_network(ev, ev, nodes, nodes, 200, pre, 0.9).select("a", "b", "link")
    two = eca_network(ev, ev, nodes, nodes, 200, tri, 0.9, "trigger").select("a", "b", "link")
    want = sorted(map(tuple, links.both(one, two).collect()))
    assert sorted(map(tuple, joint.collect())) == want and any(x for _, _, x in want)
    plan = joint._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin [a") == 0 and plan.count("CartesianProduct") == 0


def test_confidences_beyond_a_broadcast(spark, monkeypatch):
    ev, nodes = series(spark, np.random.default_rng(4).random((9, 200)) < 0.1)
    small = sorted(map(tuple, eca_joint_network(ev, nodes, 200, Coincidence(), Coincidence(10, True, 0), 0.9).collect()))
    monkeypatch.setattr(significance, "SMALL", 3)
    assert sorted(map(tuple, eca_joint_network(ev, nodes, 200, Coincidence(), Coincidence(10, True, 0), 0.9).collect())) == small


# --- null model ---------------------------------------------------------------------------------


def score_by_loops(x, y, tm):
    n = 0
    for i in range(1, len(x) - 1):
        for j in range(1, len(y) - 1):
            tau = min(x[i] - x[i - 1], x[i + 1] - x[i], y[j] - y[j - 1], y[j + 1] - y[j]) / 2
            n += abs(x[i] - y[j]) < tau and abs(x[i] - y[j]) < tm
    return n


@pytest.mark.parametrize("sort_draws", [False, True])
def test_network_by_chance_against_plain_loops(spark, monkeypatch, sort_draws):
    """The whole of it: draws, scores, percentiles, lookup and links."""
    monkeypatch.setattr(significance, "DRAWS", 30)
    steps, tm, samples, top = 120, 15, 100, 8
    want = {}
    for i in range(3, top + 1):
        for j in range(3, i + 1):
            scores = []
            for part, size in ((0, 30), (1, 30), (2, 30), (3, 10)):
                rng = np.random.default_rng([5, i, j, part])
                x, y = (significance._draws(rng, np.arange(steps), n, size) for n in (i, j))
                assert all(len(set(r)) == len(r) for r in x.tolist())
                scores += [score_by_loops(*(sorted(r) if sort_draws else r for r in (a, b)), tm) for a, b in zip(x.tolist(), y.tolist(), strict=True)]
            want[i, j] = want[j, i] = {s: max(1, int(np.percentile(scores, 100 * (1 - s)))) for s in (0.05, 0.3)}
    crit = storage.materialise(significance.null_model(spark, list(range(steps)), tm, top, (0.05, 0.3), samples, 1, 5, sort_draws), "null-model")
    got = {(r["noe_a"], r["noe_b"], r["significance"]): r["crit"] for r in crit.collect()}
    assert got == {(i, j, s): want.get((i, j), {0.05: 1, 0.3: 1})[s] for i in range(top + 1) for j in range(top + 1) for s in (0.05, 0.3)}
    field = np.zeros((6, steps), bool)
    rng = np.random.default_rng(1)
    for row in field:
        row[rng.choice(np.arange(0, steps, 2), rng.integers(2, top + 1), replace=False)] = True
    field[1] = field[0]
    ev, nodes = series(spark, field)
    for r in es_network(ev, nodes, crit, tm, 0.05).collect():
        n = field[r["a"]].sum(), field[r["b"]].sum()
        assert r["crit"] == got[int(n[0]), int(n[1]), 0.05] and r["link"] == (r["es"] > r["crit"])


def test_draws_are_even():
    for n in (3, 40):  # card by card, and by whole shuffles
        x = significance._draws(np.random.default_rng(1), np.arange(60), n, 4000)
        assert x.shape == (4000, n) and abs(np.bincount(x.ravel(), minlength=60) / (4000 * n / 60) - 1).max() < 0.25


# --- files --------------------------------------------------------------------------------------


def test_netcdf(spark, tmp_path):
    rng = np.random.default_rng(3)
    places = spark.createDataFrame([(k, -10.0 + k, 5.5 * k) for k in range(7)], "loc long, lat double, lon double")
    cells = [(int(a), int(t), float(v)) for a, t, v in zip(rng.integers(0, 7, 150), rng.integers(0, 40, 150), rng.normal(size=150), strict=True)]
    cells = list({(a, t): (a, t, v) for a, t, v in cells}.values()) + [(2, 55, float("nan")), (3, 57, None)]
    field = spark.createDataFrame(cells, "loc long, t_idx int, value double")
    path = str(tmp_path / "field")
    assert netcdf.write_field(field, places, path, 16) == len(cells) - 1
    assert sorted(p.name for p in (tmp_path / "field").iterdir()) == [f"steps-{k:08d}.nc" for k in range(4)]
    read = netcdf.read_field(spark, f"file://{path}")
    rows = read.collect()
    assert {(r["loc"], r["t_idx"]): r["value"] for r in rows if r["t_idx"] != 55} == {(a, t): v for a, t, v in cells if t < 55}
    assert [math.isnan(r["value"]) for r in rows if r["t_idx"] == 55] == [True]
    assert {(r["loc"], r["lat"], r["lon"]) for r in rows} <= {(k, -10.0 + k, 5.5 * k) for k in range(7)}
    assert read.where("t_idx >= 20 and t_idx < 33").count() == sum(20 <= t < 33 for _, t, _ in cells)
    header = netcdf.read_header(f"{path}/steps-00000000.nc")
    assert header.dims == [("time", 0), ("place", 7)] and header.record_size == 4 + 7 * 8
    one = netcdf.read_field(spark, f"{path}/steps-00000001.nc", range_bytes=200)
    assert one.rdd.getNumPartitions() > 1 and {r["t_idx"] for r in one.collect()} == {t for _, t, _ in cells if 16 <= t < 32}
    with pytest.raises(ValueError):
        netcdf.parse_header(b"HDF5 and so on")


def test_ranges_of_steps_are_left_out(tmp_path, spark):
    places = spark.createDataFrame([(0, 1.0, 2.0)], "loc long, lat double, lon double")
    netcdf.write_field(spark.createDataFrame([(0, t, 1.0 * t) for t in range(20)], "loc long, t_idx int, value double"), places, str(tmp_path / "f"), 10)
    reader = netcdf.FieldReader(str(tmp_path / "f"), "value", 30)
    every = len(reader.partitions())
    assert list(reader.pushFilters([netcdf.GreaterThanOrEqual(("t_idx",), 15), netcdf.LessThan(("value",), 3.0)]))
    assert 0 < len(reader.partitions()) < every / 2 and [p.path[-11:] for p in reader.partitions()] == ["00000001.nc"] * len(reader.partitions())


def test_header_of_a_file_made_elsewhere(tmp_path):
    """Attributes, a name that needs padding, 32-bit offsets, one record variable."""
    text = netcdf._text
    head = b"CDF\x01" + (2).to_bytes(4, "big") + b"\0\0\0\x0a" + (2).to_bytes(4, "big") + text("t") + (0).to_bytes(4, "big") + text("x") + (3).to_bytes(4, "big")
    head += b"\0\0\0\x0c" + (1).to_bytes(4, "big") + text("title") + (2).to_bytes(4, "big") + (5).to_bytes(4, "big") + b"hello\0\0\0"
    head += b"\0\0\0\x0b" + (1).to_bytes(4, "big") + text("tmean") + (2).to_bytes(4, "big") + (0).to_bytes(4, "big") + (1).to_bytes(4, "big") + bytes(8) + (3).to_bytes(4, "big") + (8).to_bytes(4, "big")
    begin = len(head) + 4
    head += begin.to_bytes(4, "big")
    path = tmp_path / "x.nc"
    path.write_bytes(head + np.arange(6, dtype=">i2").tobytes())
    header = netcdf.read_header(str(path))
    assert header.records == 2 and header.variables["tmean"].begin == begin and header.record_size == 6
    assert netcdf.read_records(str(path), header, "tmean", 0, 2).tolist() == [[0, 1, 2], [3, 4, 5]]


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    class Cluster:
        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"

            @staticmethod
            def getCheckpointDir():  # noqa: N802
                return None

        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError):
        storage.shared_dir(Cluster)
    monkeypatch.setattr(Cluster.conf, "get", staticmethod(lambda key, default=None: "/shared/"))
    assert storage.scratch_path(Cluster, "x").startswith("/shared/x-")


def test_seeded_cells_do_not_depend_on_partitions(spark):
    places = spark.range(20).withColumnRenamed("id", "loc")
    one, two = (sorted(map(tuple, synthetic.field_of(places.repartition(n), 9, 3).collect())) for n in (1, 6))
    assert one == two and len({v for _, _, v in one}) == 180
    assert sorted(map(tuple, synthetic.field_of(places.where("loc = 4"), 9, 3).collect())) == [r for r in one if r[0] == 4]
    values = np.array([r["value"] for r in synthetic.seeded_field(spark, 100, 100).collect()])
    assert abs(values.mean()) < 0.05 and abs(values.std() - 1) < 0.05


# --- table functions ----------------------------------------------------------------------------


def test_table_functions(spark):
    tables.register(spark)
    got = spark.sql("SELECT * FROM spiral_points(12)").orderBy("point_id").collect()
    want = grids.fibonacci_points(spark, 12).orderBy("point_id").collect()
    assert [r["point_id"] for r in got] == list(range(12)) and all(r["lon"] == pytest.approx(w["lon"]) and r["lat"] == pytest.approx(w["lat"]) for r, w in zip(got, want, strict=True))
    assert spark.sql("SELECT * FROM spiral_points(CAST(NULL AS INT))").count() == 0
    assert spark.sql("SELECT v.n, count(*) AS k FROM VALUES (1), (3), (4) AS v(n), LATERAL spiral_points(v.n) GROUP BY v.n").count() == 2
    mesh = spark.sql("SELECT * FROM mesh_points(5D, 0D, 10D, -5D, 0D)").collect()
    assert sorted((r["point_id"], r["lon"], r["lat"]) for r in mesh) == [(0, 0.0, -5.0), (1, 5.0, -5.0), (2, 10.0, -5.0), (3, 0.0, 0.0), (4, 5.0, 0.0), (5, 10.0, 0.0)]
    assert spark.sql("SELECT * FROM mesh_points(0D, 0D, 10D, -5D, 0D)").count() == 0


# --- streams ------------------------------------------------------------------------------------


def fed(spark, folder, batches, make):
    """The progress of a stream that reads one file after the other, and what it appended."""
    folder.mkdir()
    schema = "loc long, time timestamp, value double"
    for k, rows in enumerate(batches):
        made = [(loc, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), 1.0) for loc, s in rows]
        spark.createDataFrame(made, schema).coalesce(1).write.parquet(str(folder / f"{k}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(str(folder))
    name = f"s_{folder.name}"
    run = make(source).writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    return run.recentProgress, spark.table(name).collect()


def dropped(progress):
    return sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"])


def test_counts_of_a_stream_end_with_the_watermark(spark, tmp_path):
    batches = [[(1, 10), (1, 20), (2, 30)], [(1, 4300)], [(2, 4305)], [(1, 15), (2, 4310)], [(1, 9000)]]
    progress, rows = fed(spark, tmp_path / "counts", batches, lambda s: coincidence.stream_counts(s, "1 hour"))
    got = {(r["loc"], r["window"]["start"].hour): r["n"] for r in rows}
    # the fourth batch's first row is late by more than ten minutes when it comes
    assert got == {(1, 0): 2, (2, 0): 1, (1, 1): 1, (2, 1): 2}
    assert dropped(progress) == 1
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 1


def test_precursors_of_a_stream_age_out(spark, tmp_path):
    batches = [[(1, 0), (2, 30)], [(3, 3000)], [(5, 3050)], [(8, 5000)], [(6, 9000)], [(4, 10)], [(7, 9010)]]
    progress, rows = fed(spark, tmp_path / "precursors", batches, lambda s: coincidence.stream_precursors(s, s, 60))
    start = dt.datetime(2024, 1, 1)
    got = sorted(((r["time_a"] - start).total_seconds(), (r["time_b"] - start).total_seconds()) for r in rows if r["a"] != r["b"])
    # the late event at second 10 finds no other: what the watermark has passed is gone from the state
    assert got == [(0, 30), (3000, 3050), (9000, 9010)]
    assert 0 < progress[-1]["stateOperators"][0]["numRowsTotal"] <= 2 * (3 + 1)


def test_sparse_counts_move_no_pairs(spark, monkeypatch):
    """Over several blocks and turns, with a place without events, repeated cells and steps that are
    unknown: against plain loops, and nothing is shuffled after the blocks have met."""
    monkeypatch.setattr(pairs, "BLOCK", 4)
    monkeypatch.setattr(pairs, "MET", 7)
    rng = np.random.default_rng(5)
    cells = [(int(p), int(t)) for p, t in zip(rng.integers(0, 10, 90), rng.integers(0, 12, 90), strict=True)]
    events = [(int(p), int(t)) for p, t in zip(rng.integers(0, 9, 60), rng.integers(0, 12, 60), strict=True)]
    make = lambda rows: spark.createDataFrame([*rows, (0, None)], "loc long, t_idx int")
    nodes = spark.createDataFrame([(k,) for k in range(11)], "loc long")
    made = pairs.fused_counts({"k": make(cells), "m": make(cells[:5])}, make(events), nodes, nodes, 12, "sparse")
    met = lambda some, a, b: sum(t == s for p, t in some if p == a for q, s in events if q == b)
    assert {(r["a"], r["b"]): (r["k"], r["m"]) for r in made.collect()} == {(a, b): (met(cells, a, b), met(cells[:5], a, b)) for a in range(11) for b in range(11)}
    plan = made._jdf.queryExecution().sparkPlan().toString()  # noqa: SLF001
    assert "FlatMapCoGroupsInArrow" in plan
    shuffled = made._jdf.queryExecution().executedPlan().toString().split("FlatMapCoGroupsInArrow")[0]  # noqa: SLF001
    assert "Exchange" not in shuffled and "Join" not in shuffled
