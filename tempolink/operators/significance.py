"""Which coincidence counts are more than chance: binomial confidence and Monte-Carlo values."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import binomial_cdf
from ..storage import sized
from .judge import SMALL, Judgement, tally, with_counts
from .pairs import over_counts, pair_counts
from .sync import event_sync, over_synchronised
from .tiles import Named
from .windows import Coincidence


def _rate(n: Column, rule: Coincidence, steps: int) -> Column:
    """Chance that at least one of n events falls into the tolerance around a step."""
    share = rule.tolerance / (steps - rule.tau) if steps > rule.tau else float("nan")
    return F.lit(1.0) - F.pow(F.lit(1.0 - share), n)


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL else df


def _value(kind: str, rule: Coincidence, steps: int, least_events: int) -> Callable[[str], Column]:
    """The confidence (float) of a column of counts, beside columns na and nb."""
    trials, other = ("nb", "na") if kind == "precursor" else ("na", "nb")

    def value(k: str) -> Column:
        sure = binomial_cdf(F.col(k), F.col(trials), _rate(F.col(other), rule, steps))
        if least_events > 0:
            sure = F.when((F.col("na") >= least_events) & (F.col("nb") >= least_events), sure).otherwise(0.0)
        return sure.cast("float")

    return value


Kinds = dict[str, tuple[DataFrame, str, Coincidence]]


def judgements(kinds: Kinds, tally_a: dict[int, int], tally_b: dict[int, int], steps: int, then: Callable[[DataFrame], DataFrame], least_events: int = 2) -> dict[str, Judgement] | None:
    """For each name the confidence, and what `then` makes of it, by event counts and coincidences; None where
    that isn't small."""
    spark = next(iter(kinds.values()))[0].sparkSession
    top = max(tally_b, default=0)  # no pair has more coincidences than b has events
    if not tally_a or not tally_b or len(tally_a) * len(tally_b) * (top + 1) > SMALL:
        return None
    table = spark.createDataFrame([(n,) for n in sorted(tally_a)], "na long").withColumn("nb", F.explode(F.array(*map(F.lit, sorted(tally_b))).cast("array<long>")))
    table = table.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(top).cast("long"))))
    found = {}
    for name, (_, kind, rule) in kinds.items():
        made = then(table.withColumn("k", F.col("at")).withColumn("confidence", _value(kind, rule, steps, least_events)("k"))).drop("k")
        found[name] = Judgement.read(made, list(tally_a), list(tally_b), top)
    return None if None in found.values() else found


def judged_counts(window_a: DataFrame, kind: str, events_b: DataFrame, nodes_a: DataFrame, nodes_b: DataFrame, n_a: DataFrame, n_b: DataFrame, rule: Coincidence, steps: int, then: Callable[[DataFrame], DataFrame] = lambda sure: sure, strategy: str = "auto", least_events: int = 2) -> DataFrame:
    """a, b, k, and what `then` makes of rows with a confidence. Counts are judged where they are made, by a
    table, unless that is too large; `then` is a function of the columns k and confidence of a row."""
    tally_a = tally(n_a)
    tally_b = tally_a if n_b is n_a else tally(n_b)
    known = judgements({"k": (window_a, kind, rule)}, tally_a, tally_b, steps, then, least_events)
    if known is None:
        counts = pair_counts(window_a, events_b, nodes_a, nodes_b, steps, strategy)
        return then(_confidence(counts, n_a, n_b, rule, steps, least_events, kind))
    by = known["k"]
    one = with_counts(nodes_a, n_a)
    two = one if nodes_b is nodes_a and n_b is n_a else with_counts(nodes_b, n_b)

    def make(named: Named, some: slice, counted: Iterator[tuple[slice, dict[str, np.ndarray]]], a: pa.Table, b: pa.Table) -> Iterator[pa.RecordBatch]:
        judge, n = by.of(a["n"].to_numpy()[some]), b["n"].to_numpy()
        for at, counts in counted:
            yield named.rows(some, at, {"k": counts["k"].astype(np.int32), **judge(counts["k"], n[at])})

    types = [df.schema["loc"].dataType.simpleString() for df in (one, two)]
    made = over_counts({"k": window_a}, events_b, one, two, steps, make, f"a {types[0]}, b {types[1]}, k int{by.schema}", strategy)
    return made.withColumn("k", F.col("k").cast("long"))


def joint_links(windows: Kinds, events_b: DataFrame, nodes: DataFrame, n: DataFrame, steps: int, then: Callable[[DataFrame], DataFrame], make: Callable[..., Iterator[pa.RecordBatch]], schema: str, weights: DataFrame | None = None) -> DataFrame | None:
    """make(named, some, linked, a, b): as in `pairs.over_counts`, with whether all kinds link two places by the
    column link of `then`, in place of counts. weights: loc and what make needs to know of a place. None where
    the tables are not small."""
    tallied = tally(n)
    known = judgements(windows, tallied, tallied, steps, lambda sure: then(sure).select("na", "nb", "at", "link"))
    if known is None:
        return None
    places = with_counts(nodes, n)
    if weights is not None:
        places = places.join(weights, "loc")

    def judged(named: Named, some: slice, counted: Iterator[tuple[slice, dict[str, np.ndarray]]], a: pa.Table, b: pa.Table) -> Iterator[pa.RecordBatch]:
        by, of_b = {k: j.of(a["n"].to_numpy()[some]) for k, j in known.items()}, b["n"].to_numpy()
        linked = ((at, reduce(np.logical_and, (by[k](v, of_b[at])["link"] for k, v in counts.items()))) for at, counts in counted)
        return make(named, some, linked, a, b)

    return over_counts({k: w for k, (w, _, _) in windows.items()}, events_b, places, places, steps, judged, schema)


def with_confidences(counts: DataFrame, kinds: dict[str, tuple[str, str, Coincidence]], n_a: DataFrame, n_b: DataFrame, steps: int, least_events: int = 2) -> DataFrame:
    """The columns of counts (a, b, counts) and for each name in kinds a confidence (float) of a count;
    kinds has for it the count's column, "precursor" or "trigger", and the rule.

    The distribution function is evaluated for each pair of event counts that places have, up to as
    many coincidences as there are trials, and that table meets the pairs by broadcast: they are made
    once and don't move. Beyond SMALL rows it is evaluated for each distinct (k, na, nb)."""
    spark = counts.sparkSession
    tally_a = tally(n_a)
    tally_b = tally_a if n_b is n_a else tally(n_b)
    one = _sized(n_a.select(F.col("loc").alias("a"), F.col("event_count").cast("long").alias("na")), sum(tally_a.values()))
    two = _sized(n_b.select(F.col("loc").alias("b"), F.col("event_count").cast("long").alias("nb")), sum(tally_b.values()))
    made = counts.join(one, "a").join(two, "b")
    for name, (column, kind, rule) in kinds.items():
        trials = "nb" if kind == "precursor" else "na"
        value = _value(kind, rule, steps, least_events)
        tried, others = (tally_b, tally_a) if kind == "precursor" else (tally_a, tally_b)
        if len(others) * sum(n + 2 for n in tried) > SMALL:
            known = made.select(column, "na", "nb").distinct().withColumn(name, value(column))
            made = made.join(known, [column, "na", "nb"])
            continue
        table = spark.createDataFrame([(n,) for n in sorted(tally_a)], "na long").withColumn("nb", F.explode(F.array(*map(F.lit, sorted(tally_b))).cast("array<long>")))
        # -1 stands for all below 0, and the trials for all from there on
        table = table.withColumn("at", F.explode(F.sequence(F.lit(-1).cast("long"), F.col(trials)))).withColumn(name, value("at"))
        clipped = made.withColumn("at", F.greatest(F.lit(-1).cast("long"), F.least(F.col(column).cast("long"), F.col(trials))))
        made = clipped.join(F.broadcast(table), ["na", "nb", "at"]).drop("at")
    return made.select(*counts.columns, *kinds)


def _confidence(counts: DataFrame, n_a: DataFrame, n_b: DataFrame, rule: Coincidence, steps: int, least_events: int, kind: str) -> DataFrame:
    return with_confidences(counts.select("a", "b", "k"), {"confidence": ("k", kind, rule)}, n_a, n_b, steps, least_events)


def precursor_confidence(counts: DataFrame, n_a: DataFrame, n_b: DataFrame, rule: Coincidence, steps: int, least_events: int = 2) -> DataFrame:
    """a, b, k, confidence (float): how much of the chance distribution lies at or below k, with
    b's events as trials. n_a, n_b: loc, event_count. Pairs with fewer events have 0."""
    return _confidence(counts, n_a, n_b, rule, steps, least_events, "precursor")


def trigger_confidence(counts: DataFrame, n_a: DataFrame, n_b: DataFrame, rule: Coincidence, steps: int, least_events: int = 2) -> DataFrame:
    """The same with a's events as trials."""
    return _confidence(counts, n_a, n_b, rule, steps, least_events, "trigger")


def _of_layers(layer_a: DataFrame, layer_b: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    n_a = layer_a.groupBy("loc").agg(F.count_if("event").alias("event_count"))
    n_b = n_a if layer_b is layer_a else layer_b.groupBy("loc").agg(F.count_if("event").alias("event_count"))
    return n_a, n_b, layer_a.select("t_idx").distinct().count()


def precursor_confidence_of_layers(counts: DataFrame, layer_a: DataFrame, layer_b: DataFrame, rule: Coincidence, least_events: int = 2) -> DataFrame:
    """precursor_confidence with event counts and the number of steps taken from dense layers
    (loc, t_idx, event)."""
    n_a, n_b, steps = _of_layers(layer_a, layer_b)
    return precursor_confidence(counts, n_a, n_b, rule, steps, least_events)


def trigger_confidence_of_layers(counts: DataFrame, layer_a: DataFrame, layer_b: DataFrame, rule: Coincidence, least_events: int = 2) -> DataFrame:
    """The same with a's events as trials."""
    n_a, n_b, steps = _of_layers(layer_a, layer_b)
    return trigger_confidence(counts, n_a, n_b, rule, steps, least_events)


def judged_counts_of_layers(window_a: DataFrame, kind: str, events_b: DataFrame, nodes_a: DataFrame, nodes_b: DataFrame, layer_a: DataFrame, layer_b: DataFrame, rule: Coincidence, then: Callable[[DataFrame], DataFrame] = lambda sure: sure, least_events: int = 2) -> DataFrame:
    """judged_counts with event counts and the number of steps taken from dense layers (loc, t_idx, event)."""
    n_a, n_b, steps = _of_layers(layer_a, layer_b)
    return judged_counts(window_a, kind, events_b, nodes_a, nodes_b, n_a, n_b, rule, steps, then, least_events=least_events)


# --- Monte-Carlo critical values of event synchronisation ---------------------------------------

#: Draws of a work item: seeded on their own, and scored together.
DRAWS = 500


def synchronised(x: np.ndarray, y: np.ndarray, tau_x: np.ndarray, tau_y: np.ndarray, tm: float) -> np.ndarray:
    """Of each draw (a row) the pairs closer than half the smaller of their gaps, and than tm."""
    apart = np.abs(x[:, :, None] - y[:, None, :])
    return ((apart < np.minimum(tau_x[:, :, None], tau_y[:, None, :]) / 2) & (apart < tm)).sum(axis=(1, 2))


def _interior(draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gap = np.diff(draws, axis=1)
    return draws[:, 1:-1], np.minimum(gap[:, :-1], gap[:, 1:])


def _draws(rng: np.random.Generator, times: np.ndarray, n: int, samples: int) -> np.ndarray:
    """A row a draw: n different times in random order."""
    deck = np.tile(times, (samples, 1))
    if 8 * n > len(times):
        return rng.permuted(deck, axis=1)[:, :n]
    rows = np.arange(samples)
    for k in range(n):  # the first n cards of a shuffle, for all draws at once
        at = rng.integers(k, len(times), samples)
        deck[rows, k], deck[rows, at] = deck[rows, at], deck[rows, k].copy()
    return deck[:, :n]


def null_scores(times: np.ndarray, n_a: int, n_b: int, tm: float, samples: int, seed: int, sort_draws: bool, part: int = 0) -> np.ndarray:
    """Scores of random draws without replacement, of which a range (`part`) has a seed of its own;
    draws keep their order unless sorted."""
    if min(n_a, n_b) < 3:
        return np.zeros(samples, np.int64)
    rng = np.random.default_rng([seed, n_a, n_b, part])
    x, y = (_draws(rng, times, n, samples) for n in (n_a, n_b))
    if sort_draws:
        x, y = np.sort(x, axis=1), np.sort(y, axis=1)
    (px, tx), (py, ty) = _interior(x), _interior(y)
    some = max(1, (1 << 22) // (n_a * n_b))  # draws at once, by the memory that their pairs take
    return np.concatenate([synchronised(px[k : k + some], py[k : k + some], tx[k : k + some], ty[k : k + some], tm) for k in range(0, samples, some)])


def _limits(max_events) -> tuple[int, int]:  # noqa: ANN001
    given = np.atleast_1d(np.asarray(max_events))
    if given.ndim != 1 or given.size not in (1, 2) or (given.dtype.kind not in "iu"):
        raise ValueError("max_events is a whole number or two")
    return int(given[0]), int(given[-1])


def null_model(spark: SparkSession, times: list[int], tm: float, max_events, significances: tuple[float, ...] = (0.05,), samples: int = 2000, min_es: int | None = None, seed: int = 0, sort_draws: bool = False) -> DataFrame:  # noqa: ANN001
    """noe_a, noe_b, significance, crit for all event counts up to max_events (one limit, or one for
    a and one for b): the score that chance exceeds with the given probability. Work items (i, j)
    are dealt out over the cluster, and each has its own seed."""
    top_a, top_b = _limits(max_events)
    levels = [float(s) for s in significances]
    top = max(top_a, top_b)
    grid = spark.range(3, top + 1).select(F.col("id").alias("i")).withColumn("j", F.explode(F.sequence(F.lit(3).cast("long"), F.col("i")))) if top >= 3 else spark.createDataFrame([], "i long, j long")
    crit = _percentiles(null_histogram(grid, times, tm, samples, seed, sort_draws), samples, levels)
    both = crit.select(F.col("i").alias("noe_a"), F.col("j").alias("noe_b"), "significance", "crit")
    both = both.unionByName(crit.where("i <> j").select(F.col("j").alias("noe_a"), F.col("i").alias("noe_b"), "significance", "crit"))
    every = spark.range(top_a + 1).select(F.col("id").alias("noe_a")).withColumn("noe_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(top_b).cast("long"))))
    every = every.withColumn("significance", F.explode(F.array(*map(F.lit, levels))))
    found = F.coalesce("crit", F.lit(0).cast("long"))
    return every.join(both, ["noe_a", "noe_b", "significance"], "left").withColumn("crit", F.greatest(found, F.lit(min_es).cast("long")) if min_es is not None else found)


def null_histogram(grid: DataFrame, times: list[int], tm: float, samples: int, seed: int, sort_draws: bool) -> DataFrame:
    """i, j, score, n: how many of the draws for a pair of event counts have each score. The draws of a
    pair are cut into ranges, each a work item of its own, so that pairs of many events spread over
    the tasks; their histograms add up."""
    axis = np.asarray(times, np.int64)

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            rows = []
            for i, j, part in zip(pdf["i"].tolist(), pdf["j"].tolist(), pdf["part"].tolist(), strict=True):
                scores = null_scores(axis, i, j, tm, min(DRAWS, samples - part * DRAWS), seed, sort_draws, part)
                rows += [(i, j, s, n) for s, n in zip(*(x.tolist() for x in np.unique(scores, return_counts=True)), strict=True)]
            yield pd.DataFrame(rows, columns=["i", "j", "score", "n"])

    items = grid.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(-(-samples // DRAWS) - 1))))
    # a number of parts, as the few bytes would else be coalesced into one task
    dealt = items.repartition(4 * int(grid.sparkSession.conf.get("spark.sql.shuffle.partitions")), "i", "j", "part")
    return dealt.mapInPandas(run, "i long, j long, score long, n long").groupBy("i", "j", "score").agg(F.sum("n").alias("n"))


def _percentiles(histogram: DataFrame, samples: int, levels: list[float]) -> DataFrame:
    """i, j, significance, crit: the percentile of 1 - significance, linear between ranks, cut to a
    whole number. Sums run over the scores of one pair of counts alone, no more than it has pairs of
    events."""
    upto = F.sum("n").over(Window.partitionBy("i", "j").orderBy("score"))
    summed = histogram.withColumn("upto", upto)
    ranks = [(k, s, (samples - 1) * (100 * (1 - s) / 100)) for k, s in enumerate(levels)]
    ends = [F.min(F.when(F.col("upto") > int(at) + more, F.col("score"))).alias(f"v{k}_{more}") for k, _, at in ranks for more in (0, 1)]
    one = summed.groupBy("i", "j").agg(*ends)
    between = lambda k, at: F.floor(F.col(f"v{k}_0") + (F.coalesce(f"v{k}_1", f"v{k}_0") - F.col(f"v{k}_0")) * F.lit(at - int(at)))
    values = F.array(*(F.struct(F.lit(s).alias("significance"), between(k, at).cast("long").alias("crit")) for k, s, at in ranks))
    return one.select("i", "j", F.explode(values).alias("v")).select("i", "j", "v.*")


def critical_for_pairs(crit: DataFrame, pairs: DataFrame, n_a: DataFrame, n_b: DataFrame, significance: float | None = None) -> DataFrame:
    """The columns of pairs, and crit looked up by the event counts of both places. A count that the
    table doesn't have is a KeyError."""
    wide = pairs.join(sized(n_a.select(F.col("loc").alias("a"), F.col("event_count").alias("noe_a"))), "a").join(sized(n_b.select(F.col("loc").alias("b"), F.col("event_count").alias("noe_b"))), "b")
    return wide.join(sized(_of_level(crit, n_a, n_b, significance)), ["noe_a", "noe_b"]).select(*pairs.columns, "crit")


def _of_level(crit: DataFrame, n_a: DataFrame, n_b: DataFrame, significance: float | None) -> DataFrame:
    """noe_a, noe_b, crit of one significance; the errors of critical_for_pairs."""
    levels = [r[0] for r in crit.select("significance").distinct().limit(2).collect()]
    if significance is None:
        if len(levels) != 1:
            raise ValueError("the table has several significances: name one")
        significance = levels[0]
    table = crit.where(F.col("significance") == significance).select("noe_a", "noe_b", "crit")
    largest = table.agg(F.max("noe_a"), F.max("noe_b")).first()
    for counts, top in ((n_a, largest[0]), (n_b, largest[1])):
        if top is None or not counts.where(F.col("event_count") > top).isEmpty():
            raise KeyError("an event count lies beyond the table of critical values")
    return table


def critical_event_sync(crit: DataFrame, events_a: DataFrame, events_b: DataFrame, nodes_a: DataFrame, nodes_b: DataFrame, tm: int, n_a: DataFrame, n_b: DataFrame, significance: float | None = None) -> DataFrame:
    """a, b, es, crit: critical_for_pairs of event_sync, looked up where pairs are made unless the table is too
    large or lacks a pair of counts."""
    table = _of_level(crit, n_a, n_b, significance)
    tally_a = tally(n_a)
    tally_b = tally_a if n_b is n_a else tally(n_b)
    by = None
    if tally_a and tally_b and tm >= 1 and len(tally_a) * len(tally_b) <= SMALL:
        asked = table.where(F.col("noe_a").isin(*tally_a) & F.col("noe_b").isin(*tally_b))
        by = Judgement.read(asked.select(F.col("noe_a").alias("na"), F.col("noe_b").alias("nb"), F.lit(0).alias("at"), "crit"), list(tally_a), list(tally_b), 0)
    if by is None:
        return critical_for_pairs(crit, event_sync(events_a, events_b, nodes_a, nodes_b, tm), n_a, n_b, significance)
    one = with_counts(nodes_a, n_a)
    two = one if nodes_b is nodes_a and n_b is n_a else with_counts(nodes_b, n_b)

    def make(named: Named, some: slice, counted: Iterator[tuple[slice, np.ndarray]], a: pa.Table, b: pa.Table) -> Iterator[pa.RecordBatch]:
        judge, n = by.of(a["n"].to_numpy()[some]), b["n"].to_numpy()
        for at, es in counted:
            yield named.rows(some, at, {"es": es.astype(np.int32), **judge(es, n[at])})

    types = [df.schema["loc"].dataType.simpleString() for df in (one, two)]
    made = over_synchronised(events_a, events_b, one, two, tm, make, f"a {types[0]}, b {types[1]}, es int{by.schema}")
    return made.withColumn("es", F.col("es").cast("long"))
