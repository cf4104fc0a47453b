"""Places with the same events: queries over tables with copies against their SQL."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_sql_oracles import SF, normal

from tempolink import queries
from tempolink.operators import classes, links, pairs, repulsion

NAMES = """eca_precursor_count eca_precursor_count_sparse eca_trigger_count eca_cross_layer_count eca_precursor_confidence
    eca_precursor_confidence_of_layers eca_trigger_confidence eca_trigger_confidence_of_layers eca_network_precursor link_conjunction
    network_density node_degree area_weighted_connectivity link_quantile link_quantile_confidence link_confidence event_sync
    event_sync_of_positions critical_lookup link_critical_gt window_precondition block_function""".split()


@pytest.fixture(scope="module")
def copied(tmp_path_factory):
    """The smallest events eight times, by users of other numbers; every eighth user has no copy's like."""
    path = tmp_path_factory.mktemp("copied")
    db = duckdb.connect()
    db.execute(f"COPY (SELECT event_id, CASE WHEN k = 7 THEN ts + INTERVAL 3 HOUR ELSE ts END AS ts, user_id + 15 * k AS user_id, event_type, value, props FROM '{SF}/events.parquet', range(8) r(k)) TO '{path}/events.parquet'")
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet'")
    return str(path), db


@pytest.mark.parametrize("name", NAMES)
def test_with_copies(spark, copied, name):
    path, db = copied
    a, b = normal(queries.QUERIES[name](spark, path).toPandas()), normal(db.execute(queries.SQL[name]).df())
    assert a == b


def test_leaders_alone_are_counted(spark, copied):
    """The pairs that are computed are those of leaders, and what is dealt out moves no pairs."""
    asked = []

    def make(members, nodes, ev):  # noqa: ANN001, ANN202
        asked.append(nodes.count())
        return pairs.precursor_counts(ev, ev, nodes, nodes, queries.STEPS, queries.RULE)

    made = queries.by_series(spark, copied[0], make)
    assert asked == [30]
    assert made.count() == 120**2


def test_without_copies_nothing_is_dealt_out(spark):
    seen = []
    classes.over_classes(queries.users(spark, SF), (queries.extremes(spark, SF),), lambda members, nodes, ev: seen.append(members) or nodes)
    assert seen == [None]


def test_blocks_that_travel_together(spark, monkeypatch):
    """Rows are sent to groups of blocks; the function sees the same blocks, empty ones included."""
    left = spark.createDataFrame([(k, k % 3) for k in range(60) if k // 5 != 2], "loc long, t_idx int")
    right = spark.createDataFrame([(k, k % 4) for k in range(35)], "loc long, t_idx int")
    look = lambda a, b: pd.DataFrame({"n": [len(a)], "m": [len(b)], "sum": [int(a["loc"].sum() + b["loc"].sum())]})
    found = []
    for tile in (1, 20, 1 << 15):
        monkeypatch.setattr(pairs, "TILE", tile)
        made = pairs.over_blocks(look, left, right, 5, "n long, m long, sum long")
        found.append(sorted(tuple(r) for r in made.collect()))
    assert found[0] == found[1] == found[2]
    assert len(found[0]) == 12 * 7


def test_forces_of_points_in_one_place(spark):
    """Against plain loops; points in one place don't push each other."""
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 3))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[3] = x[4]
    force, near = repulsion.pushed(x, x, np.eye(90, dtype=bool))
    for i in range(90):
        want = sum(((x[i] - x[j]) / np.linalg.norm(x[i] - x[j]) ** 3 for j in range(90) if j != i and (x[i] != x[j]).any()), np.zeros(3))
        assert np.allclose(force[i], want, rtol=1e-9)
        assert np.isclose(near[i], min(np.linalg.norm(x[i] - x[j]) for j in range(90) if j != i))


def test_quantile_by_weights(spark):
    rows = spark.createDataFrame([(1.0, 3), (5.0, 1), (9.0, 4)], "v double, n long")
    every = rows.select("v", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    from tempolink.operators.quantile import exact_quantile

    for q in (0.0, 0.4, 0.47, 0.5, 1.0):
        assert exact_quantile(rows, "v", q, "n") == exact_quantile(every, "v", q)
    assert links.by_quantile(rows, "v", 0.5).where("link").count() == 2


@pytest.mark.parametrize("name", ["blocks_roundtrip", "blocks_roundtrip_whole"])
def test_blocks_hold_leaders_alone(spark, copied, tmp_path, monkeypatch, name):
    """Written are the 30 leaders' pairs and whom they stand for; read are the pairs of all 120."""
    path, db = copied
    monkeypatch.setattr(queries, "scratch_path", lambda _, what: str(tmp_path / what))
    got = normal(queries.QUERIES[name](spark, path).toPandas())
    assert got == normal(db.execute(queries.SQL[name]).df())
    assert spark.read.parquet(str(tmp_path / "blocks/pairs")).count() == 30**2
    assert spark.read.parquet(str(tmp_path / "blocks/members")).count() == 120


def test_blocks_of_classes_that_are_missing(spark, tmp_path):
    from tempolink.sources import blocks

    with pytest.raises(FileNotFoundError):
        blocks.read_blocks_of_classes(spark, str(tmp_path / "none"))


def test_large_classes_are_dealt_out_in_lists(spark, monkeypatch):
    """No row that moves stands for more pairs than two lists have."""
    monkeypatch.setattr(classes, "TOGETHER", 10)
    members = spark.createDataFrame([(k, 0 if k < 300 else k) for k in range(305)], "loc long, rep long")
    made = classes.lists(members)
    assert max(len(r["places"]) for r in made.collect()) < 40
    led = spark.createDataFrame([(a, b, a * 1000 + b) for a in (0, *range(300, 305)) for b in (0, *range(300, 305))], "a long, b long, k long")
    got = classes.dealt_out(led, members)
    assert got.columns == ["a", "b", "k"]
    rows = {(r["a"], r["b"]): r["k"] for r in got.collect()}
    of = {r["loc"]: r["rep"] for r in members.collect()}
    assert got.count() == 305**2 and rows == {(a, b): of[a] * 1000 + of[b] for a in of for b in of}
    some = classes.dealt_out(led, members.where("loc < 7"), members.where("loc >= 299"))
    assert {(r["a"], r["b"]) for r in some.collect()} == {(a, b) for a in range(7) for b in range(299, 305)}


def test_leaders_events_are_read_from_where_they_were_written(spark, copied):
    """Steps after the classes don't go through the input again."""
    ev = queries.extremes(spark, copied[0])
    members = classes.classes(queries.users(spark, copied[0]), ev)
    (led,) = classes.of_leaders(members, ev)
    assert led.inputFiles() and not any("events.parquet" in f for f in led.inputFiles())
    assert led.select("loc").distinct().count() == 30


def test_pairs_are_made_from_pieces_of_lists(spark, monkeypatch):
    """No row from which pairs are made has more places than a piece, and no place is lost or doubled."""
    sizes = (1, 3, 4, 5, 8, 11)
    rows = spark.createDataFrame([(n, list(range(n))) for n in sizes], "n long, places array<long>")
    monkeypatch.setattr(classes, "PIECE", 4)
    cut = {r["n"]: r["cut"] for r in rows.select("n", classes.pieces("places").alias("cut")).collect()}
    for n in sizes:
        assert all(1 <= len(piece) <= 4 for piece in cut[n])
        assert sum(cut[n], []) == list(range(n))
    members = spark.createDataFrame([(k, 0 if k < 11 else k) for k in range(14)], "loc long, rep long")
    led = spark.createDataFrame([(a, b, 100 * a + b) for a in (0, 11, 12, 13) for b in (0, 11, 12, 13)], "a long, b long, k long")
    of = {r["loc"]: r["rep"] for r in members.collect()}
    dealt = classes.dealt_out(led, members)
    assert sorted(map(tuple, dealt.collect())) == [(a, b, 100 * of[a] + of[b]) for a in range(14) for b in range(14)]
