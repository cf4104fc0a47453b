"""Events, runs, windows and counts against loops written from their definitions."""

from __future__ import annotations

import datetime as dt
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tempolink import queries
from tempolink.operators import axis, events, links, pairs, significance, sync, windows
from tempolink.functions.stats import binomial_cdf


def series(spark, matrix):
    rows = [(int(i), int(t)) for i, t in zip(*np.nonzero(matrix), strict=True)]
    return spark.createDataFrame(rows, "loc long, t_idx int"), spark.createDataFrame([(i,) for i in range(len(matrix))], "loc long")


def cells(df, n, steps):
    out = np.zeros((n, steps), bool)
    for r in df.collect():
        out[r["loc"], r["t_idx"]] = True
    return out


@pytest.fixture(scope="module")
def noise():
    return np.random.default_rng(3).random((6, 40)) < 0.3


def test_threshold_treats_missing_as_no_event(spark):
    field = spark.createDataFrame([(0, 0, 5.0), (0, 1, float("nan")), (0, 2, None), (0, 3, 4.0)], "loc long, t_idx int, value double")
    above = {r["t_idx"]: r["event"] for r in events.threshold_events(field, 5.0, "above").collect()}
    below = {r["t_idx"]: r["event"] for r in events.threshold_events(field, 4.0, "below").collect()}
    assert above == {0: True, 1: False, 2: False, 3: False}
    assert below == {0: False, 1: False, 2: False, 3: True}
    with pytest.raises(AssertionError):
        events.threshold_events(field, 1.0, "beside")
    with pytest.raises(ValueError):
        events.threshold_events(field, 1.0, "above", select="middle")


def test_percentile_is_per_place_and_skips_missing(spark):
    rows = [(p, t, float(t * (p + 1))) for p in range(2) for t in range(10)] + [(2, t, None) for t in range(3)] + [(1, 10, float("nan"))]
    field = spark.createDataFrame(rows, "loc long, t_idx int, value double")
    got = events.percentile_events(field, 0.8, "above").where("event").groupBy("loc").count().collect()
    assert {r["loc"]: r["count"] for r in got} == {0: 2, 1: 2}
    with pytest.raises(AssertionError):
        events.percentile_events(field, 1.2)


@pytest.mark.parametrize("select,n", [("burst", None), ("wane", None), ("start", 1), ("start", 3), ("end", 1), ("end", 2)])
def test_runs(spark, noise, select, n):
    ev, nodes = series(spark, noise)
    got = cells(events.select_runs(ev, select, n), *noise.shape)
    want = np.zeros_like(noise)
    for i, row in enumerate(noise):
        t = 0
        while t < len(row):
            if row[t]:
                e = t
                while e < len(row) and row[e]:
                    e += 1
                k = min(n or 1, e - t)
                want[i, slice(t, t + k) if select in ("burst", "start") else slice(e - k, e)] = True
                t = e
            t += 1
    assert (got == want).all()
    dense = windows.dense_window(ev, nodes, noise.shape[1])
    assert (cells(events.select_dense(dense, select, n or 1).where("event"), *noise.shape) == want).all()


RULES = [windows.Coincidence(d, s, t) for d in (0, 2, 3) for s in (True, False) for t in (0, 2)]


def brute_window(row, rule, kind):
    n, out = len(row), np.zeros(len(row), bool)
    for t in range(n):
        if kind == "precursor":
            span, ok = range(t - rule.tau - rule.delta, t - rule.tau + rule.delta * rule.symmetric + 1), t >= rule.tau
        elif rule.symmetric:
            span, ok = range(t - rule.delta, t + rule.delta + 1), t <= n - 1 - rule.tau
        else:
            span, ok = range(t + rule.tau, t + rule.tau + rule.delta + 1), t <= n - 1 - rule.tau
        out[t] = ok and any(row[s] for s in span if 0 <= s < n)
    return out


@pytest.mark.parametrize("kind", ["precursor", "trigger"])
def test_windows(spark, noise, kind):
    ev, _ = series(spark, noise)
    make = windows.precursor_window if kind == "precursor" else windows.trigger_window
    for rule in RULES:
        got = make(ev, noise.shape[1], rule)
        assert got.count() == got.distinct().count()
        assert (cells(got, *noise.shape) == np.array([brute_window(r, rule, kind) for r in noise])).all(), rule
    assert windows.window_kind(make(ev, 40, RULES[1])) == (kind, RULES[1])
    with pytest.raises(ValueError):
        windows.window_kind(ev)
    with pytest.raises(ValueError):
        windows.Coincidence(-1)


def test_counts_agree_and_include_zeros(spark, noise):
    noise = noise.copy()
    noise[2] = False
    ev, nodes = series(spark, noise)
    rule = windows.Coincidence(1, True, 2)
    w = np.array([brute_window(r, rule, "precursor") for r in noise])
    want = w.astype(int) @ noise.T.astype(int)
    for strategy in pairs.STRATEGIES:
        got = {(r["a"], r["b"]): r["k"] for r in pairs.precursor_counts(ev, ev, nodes, nodes, 40, rule, strategy).collect()}
        assert got == {(a, b): want[a, b] for a in range(6) for b in range(6)}, strategy
    with pytest.raises(ValueError):
        pairs.from_window("trigger", windows.precursor_window(ev, 40, rule), ev, nodes, nodes, 40)
    with pytest.raises(ValueError):
        pairs.pair_counts(ev, ev, nodes, nodes, 40, "guess")


def test_blocks_and_long_series(spark, monkeypatch):
    """Several blocks, and more words than are kept as columns."""
    monkeypatch.setattr(pairs, "BLOCK", 3)
    m = np.random.default_rng(5).random((7, 64 * 70)) < 0.02
    ev, nodes = series(spark, m)
    want = m.astype(int) @ m.T.astype(int)
    for strategy in pairs.STRATEGIES:
        got = {(r["a"], r["b"]): r["k"] for r in pairs.pair_counts(ev, ev, nodes, nodes, m.shape[1], strategy).collect()}
        assert got == {(a, b): want[a, b] for a in range(7) for b in range(7)}, strategy
    swapped = pairs.over_blocks(lambda a, b: a.merge(b, how="cross", suffixes=("_a", "_b")).rename(columns={"loc_a": "a", "loc_b": "b"}), nodes, nodes, 3, "a long, b long")
    assert swapped.count() == 49 and swapped.select("bi", "bj").distinct().count() == 9


def test_symmetric_windows_without_lag_coincide(spark, noise):
    ev, nodes = series(spark, noise)
    rule = windows.Coincidence(3, True, 0)
    a = pairs.precursor_counts(ev, ev, nodes, nodes, 40, rule).collect()
    b = pairs.trigger_counts(ev, ev, nodes, nodes, 40, rule).collect()
    assert sorted(a) == sorted(b)


def brute_sync(x, y, tm):
    def local(p):
        return [(p[e], min(p[e] - p[e - 1], p[e + 1] - p[e]) if e + 1 < len(p) else None) for e in range(1, len(p))]

    if len(x) <= 2 or len(y) <= 2:
        return 0
    n = 0
    for p, tp in local(x):
        for q, tq in local(y):
            if tp is not None:
                tau = tp if tq is None else min(tp, tq)
                n += abs(p - q) < tau / 2 and abs(p - q) < tm
    return n


@pytest.mark.parametrize("tm", [0, 1, 4, 30])
def test_event_sync(spark, tm):
    m = np.random.default_rng(8).random((7, 120)) < 0.1
    m[3] = False
    m[4, 2:] = False
    ev, nodes = series(spark, m)
    got = {(r["a"], r["b"]): r["es"] for r in sync.event_sync(ev, ev, nodes, nodes, tm).collect()}
    at = [np.flatnonzero(r).tolist() for r in m]
    assert got == {(a, b): brute_sync(at[a], at[b], tm) for a in range(7) for b in range(7)}


def test_positions_and_gaps(spark):
    ev = spark.createDataFrame([(0, 3), (0, 9), (0, 5)], "loc long, t_idx int")
    nodes = spark.createDataFrame([(0,), (1,)], "loc long")
    got = {r["loc"]: (r["positions"], r["event_count"]) for r in sync.event_positions(ev, nodes).collect()}
    assert got == {0: ([3, 5, 9], 3), 1: ([], 0)}
    assert [(r["p"], r["gap"]) for r in sync.event_gaps(ev).orderBy("e").collect()] == [(3, 2), (5, 4), (9, None)]


def test_binomial_cdf(spark):
    cases = [(k, n, p) for n in (1, 5, 40, 700) for k in (-1, 0, 1, n // 2, n - 1, n, n + 3) for p in (0.0, 0.01, 0.3, 0.97, 1.0)]
    df = spark.createDataFrame(cases, "k long, n long, p double")
    for r in df.withColumn("c", binomial_cdf(F.col("k"), F.col("n"), F.col("p"))).collect():
        k, n, p = r["k"], r["n"], r["p"]
        want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)) for i in range(min(k, n) + 1)) if 0 < p < 1 else float(k >= n or (p == 0 and k >= 0))
        assert r["c"] == pytest.approx(min(want, 1), abs=1e-9), (k, n, p)


def test_confidence_masks_few_events_and_uses_float(spark):
    counts = spark.createDataFrame([(0, 0, 1), (0, 1, 1)], "a long, b long, k long")
    n = spark.createDataFrame([(0, 4), (1, 1)], "loc long, event_count long")
    got = {r["b"]: r["confidence"] for r in significance.precursor_confidence(counts, n, n, windows.Coincidence(2, True, 0), 100).collect()}
    p = 1 - (1 - 3 / 100) ** 4
    assert got[0] == pytest.approx((1 - p) ** 4 + 4 * p * (1 - p) ** 3, abs=1e-6)
    assert got[1] == 0.0
    exact = spark.sql("SELECT 0L AS a, 1L AS b, CAST(0.95 AS FLOAT) AS confidence")
    assert links.by_confidence(exact, 0.95).first()["link"]


def test_null_model(spark):
    a = significance.null_model(spark, list(range(60)), 10, 6, (0.05, 0.5), samples=200, seed=2)
    got = {(r["noe_a"], r["noe_b"], r["significance"]): r["crit"] for r in a.collect()}
    assert len(got) == 7 * 7 * 2
    assert all(got[i, j, s] == got[j, i, s] for i, j, s in got)
    assert all(got[i, j, 0.05] >= got[i, j, 0.5] for i, j, _ in got)
    assert all(got[i, j, 0.05] == 0 for i in range(3) for j in range(7))
    again = {(r["noe_a"], r["noe_b"], r["significance"]): r["crit"] for r in significance.null_model(spark, list(range(60)), 10, 6, (0.05, 0.5), samples=200, seed=2).repartition(3).collect()}
    assert got == again
    floor = significance.null_model(spark, list(range(60)), 10, (4, 6), (0.05,), samples=50, min_es=2)
    assert floor.count() == 5 * 7 and floor.agg(F.min("crit")).first()[0] >= 2
    sorted_ = significance.null_scores(np.arange(300), 30, 30, 10, 200, 1, True).mean()
    assert sorted_ > significance.null_scores(np.arange(300), 30, 30, 10, 200, 1, False).mean()
    with pytest.raises(ValueError):
        significance.null_model(spark, [1], 10, (1, 2, 3))


def test_critical_lookup(spark):
    crit = spark.createDataFrame([(i, j, s, i * 10 + j) for i in range(4) for j in range(4) for s in (0.05, 0.01)], "noe_a long, noe_b long, significance double, crit long")
    pair = spark.createDataFrame([(0, 1, 5)], "a long, b long, es long")
    n = spark.createDataFrame([(0, 3), (1, 2)], "loc long, event_count long")
    got = significance.critical_for_pairs(crit, pair, n, n, 0.01)
    assert got.columns == ["a", "b", "es", "crit"] and got.first()["crit"] == 32
    with pytest.raises(ValueError):
        significance.critical_for_pairs(crit, pair, n, n)
    with pytest.raises(KeyError):
        significance.critical_for_pairs(crit, pair, n.withColumn("event_count", F.lit(9)), n, 0.01)
    assert not links.by_critical_values(got.withColumn("es", F.col("crit")), "es").first()["link"]
    assert links.by_critical_values(got.withColumn("es", F.col("crit")), "es", rule="greater_equal").first()["link"]
    with pytest.raises(ValueError):
        links.by_critical_values(got, "es", rule="less")


def test_network_measures(spark):
    net = spark.createDataFrame([(0, 0, True), (0, 1, True), (1, 0, False), (1, 1, True)], "a long, b long, link boolean")
    spots = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.0, 60.0)], "loc long, lon double, lat double")
    assert links.density(net).first()[0] == 75.0
    assert {r["a"]: r["degree"] for r in links.degree(net).collect()} == {0: 1, 1: 0}
    assert {r["a"]: round(r["awc"], 6) for r in links.area_weighted_connectivity(net, spots).collect()} == {0: 1.0, 1: round(0.5 / 1.5, 6)}
    assert [(r["bin"], r["n"]) for r in links.link_distances(net, spots, 1000.0).collect()] == [(6, 1)]


def test_axes(spark):
    a = spark.createDataFrame([("2024-01-01",), ("2024-01-03",)], "time string")
    assert [r["t_idx"] for r in axis.time_axis(a).orderBy("time").collect()] == [0, 1]
    axis.require_same_axis(a, a)
    with pytest.raises(ValueError):
        axis.require_same_axis(a, a.limit(1))
    spots = spark.createDataFrame([(10.0, 5.0), (-10.0, 7.0), (-10.0, 5.0)], "lat double, lon double")
    assert [(r["lat"], r["lon"]) for r in axis.places(spots).orderBy("loc").collect()] == [(-10.0, 5.0), (-10.0, 7.0), (10.0, 5.0)]
    assert axis.with_suffix(spots, "A").columns == ["latA", "lonA"]


def burst_tables(spark, path, hours):
    """events of users with a burst in each of the given hours."""
    rows = [(u, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), 60.0) for u, hs in hours.items() for h in hs]
    rows.append((99, dt.datetime(2024, 1, 1), 1.0))  # no burst
    spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, value double").withColumn("event_type", F.lit("error")).write.parquet(f"{path}/events.parquet")
    return str(path)


def test_null_model_queries_reach_the_largest_count(spark, tmp_path):
    hours = {1: range(0, 700, 40), 2: range(3, 703, 40), 3: range(17, 717, 100), 4: [5, 300]}
    sf = burst_tables(spark, tmp_path, hours)
    crit = {(r["noe_a"], r["noe_b"], r["significance"]): r["crit"] for r in queries.null_model(spark, sf).collect()}
    assert set(crit) == {(a, b, s) for a in range(19) for b in range(19) for s in (0.05, 0.01)}
    # the draws of the rule, range by range
    scores = np.concatenate([significance.null_scores(np.arange(720), 18, 7, 30, significance.DRAWS, 1, False, k) for k in range(2000 // significance.DRAWS)])
    assert crit[18, 7, 0.05] == crit[7, 18, 0.05] == max(2, int(np.percentile(scores, 95)))
    n = {1: 18, 2: 18, 3: 7, 4: 2, 99: 0}
    got = {(r["a"], r["b"]): r for r in queries.es_network_null_model(spark, sf).collect()}
    assert set(got) == {(a, b) for a in n for b in n}
    assert all(r["crit"] == crit[n[a], n[b], 0.05] and r["link"] == (r["es"] > r["crit"]) for (a, b), r in got.items())
    es = {(r["a"], r["b"]): r["es"] for r in queries.event_sync(spark, sf).collect()}
    assert all(r["es"] == es[p] for p, r in got.items())
    assert got[1, 2]["link"] and got[2, 1]["link"] and not got[1, 4]["link"] and not got[1, 99]["link"]


def test_critical_values_of_many_bursts(spark, tmp_path):
    """240 bursts of one user, against the SQL."""
    sf = burst_tables(spark, tmp_path, {1: range(0, 720, 3), 2: range(0, 720, 4), 3: [7, 90, 300]})
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet/*.parquet'")
    for name in ("critical_lookup", "link_critical_gt", "link_critical_ge"):
        got = queries.QUERIES[name](spark, sf)
        want = con.execute(queries.SQL[name]).df()
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.itertuples(index=False, name=None))


def test_frequency_of_an_axis(spark):
    from tempolink.functions.calendar import frequency

    def found(times):
        return frequency(spark.createDataFrame([(t,) for t in times], "time timestamp_ntz")).first()["freq"]

    start = dt.datetime(2023, 1, 1, 6)
    for freq, step in {"h": dt.timedelta(hours=1), "D": dt.timedelta(days=1), "W": dt.timedelta(days=7)}.items():
        times = [start + k * step for k in range(5)]
        assert found(times[::-1] + times[:2] + [None]) == freq
        assert found(times[:2] + times[3:]) is None  # a gap
        assert found(times[:2]) is None
    assert found([dt.datetime(2023, m, 1) for m in range(1, 13)]) == "M"
    assert found([dt.datetime(2024, 1, 31), dt.datetime(2024, 2, 29), dt.datetime(2024, 3, 31)]) == "M"
    assert found([dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1), dt.datetime(2024, 4, 1)]) is None
    assert found([dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1, 5), dt.datetime(2024, 3, 1)]) is None
    assert found([]) is None


def test_positions_with_padding(spark, noise):
    ev, nodes = series(spark, noise)
    listed = sync.event_positions(ev, nodes)
    want = sorted(sync.event_sync(ev, ev, nodes, nodes, 9).collect())
    assert sorted(sync.event_sync_of_positions(listed, listed, 9).collect()) == want
    padded = listed.withColumn("positions", F.concat("positions", F.array(F.lit(-1), F.lit(-1))))
    assert sorted(sync.event_sync_of_positions(padded, padded.drop("event_count"), 9).collect()) == want
    odd = spark.createDataFrame([(0, None, 3), (1, [], None), (2, [4, 9], None), (3, [4, 9], 1), (4, [4], -1)], "loc long, positions array<int>, event_count long")
    assert sorted(map(tuple, sync.events_of_positions(odd).collect())) == [(2, 4), (2, 9), (3, 4)]
