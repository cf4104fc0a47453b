"""Users whose series all differ: pairs are made in tiles, judged there, and neither moved nor joined."""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from test_sql_oracles import SF, normal

from tempolink import queries
from tempolink.operators import judge, pairs, tiles

COUNTS = "eca_precursor_count eca_precursor_count_bitmap eca_precursor_count_sparse eca_precursor_count_matmul eca_cross_layer_count event_sync event_sync_of_positions window_precondition link_significance".split()
JUDGED = """eca_network_precursor eca_precursor_confidence eca_precursor_confidence_of_layers eca_trigger_confidence eca_trigger_confidence_of_layers
    link_conjunction link_confidence critical_lookup link_critical_gt link_critical_ge""".split()
SUMMED = "network_density node_degree area_weighted_connectivity".split()


@pytest.fixture(scope="module")
def differing(tmp_path_factory):
    """The smallest events four times, each time shifted by some hours and by users of other numbers."""
    path = tmp_path_factory.mktemp("differing")
    db = duckdb.connect()
    db.execute(f"COPY (SELECT event_id, ts + to_hours(CAST(k * (1 + user_id % 4) AS INTEGER)) AS ts, user_id + 15 * k AS user_id, event_type, value, props FROM '{SF}/events.parquet', range(4) r(k) WHERE ts < TIMESTAMP '2024-01-29') TO '{path}/events.parquet'")
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet'")
    return str(path), db


@pytest.mark.parametrize("name", [*COUNTS, *JUDGED, *SUMMED])
def test_in_tiles(spark, differing, monkeypatch, name):
    """Against SQL, over several tiles; nothing is shuffled or joined once two tiles have met."""
    path, db = differing
    monkeypatch.setattr(pairs, "BLOCK", 20)
    made = queries.QUERIES[name](spark, path)
    plan = made._jdf.queryExecution().executedPlan().toString().split("FlatMapCoGroupsInArrow")[0]  # noqa: SLF001
    if name not in SUMMED:
        assert "Exchange" not in plan and "Join" not in plan
    assert normal(made.toPandas()) == normal(db.execute(queries.SQL[name]).df())


@pytest.mark.parametrize("name", ["blocks_roundtrip", "blocks_roundtrip_whole"])
def test_blocks_are_written_where_they_are_made(spark, differing, monkeypatch, tmp_path, name):
    """A file for each pair of tiles at most, of neighbouring places, and no shuffle of pairs."""
    path, db = differing
    monkeypatch.setattr(pairs, "BLOCK", 20)
    monkeypatch.setattr(queries, "scratch_path", lambda _, what: str(tmp_path / what))
    written = []
    monkeypatch.setattr(queries.blocks, "write_tiles", lambda made, to, write=queries.blocks.write_tiles: (written.append(made), write(made, to)))
    got = queries.QUERIES[name](spark, path)
    assert normal(got.toPandas()) == normal(db.execute(queries.SQL[name]).df())
    plan = written[0]._jdf.queryExecution().executedPlan().toString().split("FlatMapCoGroupsInArrow")[0]  # noqa: SLF001
    assert "Exchange" not in plan and "Sort" not in plan
    assert 1 < len(list((tmp_path / "blocks").rglob("*.parquet"))) <= 9
    if name == "blocks_roundtrip":
        assert "PushedFilters: [IsNotNull(a), IsNotNull(b)" in got._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001


def test_tiles_cut_no_block(spark):
    nodes = spark.createDataFrame([(k * 3,) for k in range(5000)], "loc long")
    bounds = pairs.bounds_of(nodes, 50)
    assert len(bounds) == 9 and all(b % 50 == 0 for b in bounds)


def test_a_place_travels_to_few_tiles():
    """What is shuffled grows with the places, not with their square."""
    assert [tiles.tiles_of(n, 512) for n in (0, 1, 1500, 90_000, 540_000)] == [1, 1, 3, 32, 33]


def test_looked_up_values():
    """Truths that begin at some number, others, and counts beyond the table."""
    rng = np.random.default_rng(1)
    na, nb, top = np.array([0, 3, 9]), np.array([1, 4]), 6
    sure, odd = rng.random((2, 3, 7)), rng.random((2, 3, 7)) < 0.5
    grows = np.sort(rng.random((2, 3, 7)) < 0.4, axis=2)
    known = judge.Judgement(na, nb, top, {"sure": ("double", sure.ravel()), "odd": ("boolean", odd.ravel()), "grows": ("boolean", grows.ravel())})
    n_a, n_b, k = na[rng.integers(0, 3, 11)], nb[rng.integers(0, 2, 5)], rng.integers(0, 10, (5, 11)).astype(np.uint8)
    at = np.searchsorted(nb, n_b)[:, None], np.searchsorted(na, n_a)[None, :], np.minimum(k, top)
    got = known.of(n_a)(k, n_b)
    assert all((got[name] == want[at]).all() for name, want in (("sure", sure), ("odd", odd)))
    assert (got["grows"] == grows[at]).all()


@pytest.mark.parametrize("strategy", ["auto", "bitmap", "matmul", "dense"])
def test_turns_of_a_tile(monkeypatch, strategy):
    """Counts of parts of two tiles are those of the whole, and every pair is made once."""
    monkeypatch.setattr(tiles, "HANDED", 20)
    rng = np.random.default_rng(2)
    x, y = rng.random((17, 70)) < 0.3, rng.random((11, 70)) < (0.5 if strategy == "dense" else 0.1)
    y[4] = False
    rows = lambda m, name: pa.table({"loc": np.arange(len(m)), name: pa.array([r.tobytes() for r in np.packbits(m, axis=1)], pa.binary())})
    _, of = pairs._from_bits(rows(x, "k"), rows(y, "at"), ["k"], 70, "auto" if strategy == "dense" else strategy)  # noqa: SLF001
    got = np.full((11, 17), -1)
    for some, parts in tiles.turns(17, 11, 7):
        count = of(some)
        for part in parts:
            assert (got[part, some] == -1).all()
            got[part, some] = count(part)["k"]
    assert (got == y.astype(int) @ x.T.astype(int)).all()


def test_two_blocks_of_points_meet_once(spark, monkeypatch):
    """Forces over several blocks are those of one, and one look at two blocks gives those of both."""
    from tempolink.operators import repulsion

    x = np.random.default_rng(3).normal(size=(40, 3))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[7] = x[31]
    points = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(x)], "point_id long, x double, y double, z double")
    force, near = repulsion.pushed(x, x, np.eye(40, dtype=bool))
    got = {r["point_id"]: r for r in repulsion.forces(points, 9).collect()}
    assert len(got) == 40
    for k, r in got.items():
        assert np.allclose([r["fx"], r["fy"], r["fz"]], force[k], rtol=1e-9) and np.isclose(r["near"], near[k])
    one, near_one, two, near_two = repulsion.pushed_apart(x[:30], x[30:])
    for (own, others), made, nearest in (((x[:30], x[30:]), one, near_one), ((x[30:], x[:30]), two, near_two)):
        want, near = repulsion.pushed(own, others, np.zeros((len(own), len(others)), bool))
        assert np.allclose(made, want, rtol=1e-9) and np.allclose(nearest, near)
