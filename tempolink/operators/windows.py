"""Coincidence windows of event series, as sparse cells (loc, t_idx).

An event opens an interval of steps. Intervals of a place all have the same length, so their
union is had by cutting each where the next begins: no step is made twice, and none is removed.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Coincidence:
    """Tolerance in steps, whether it reaches to both sides, and lag."""

    delta: int = 2
    symmetric: bool = True
    tau: int = 0

    def __post_init__(self) -> None:
        if self.delta < 0 or self.tau < 0:
            raise ValueError("tolerance and lag are not negative")

    @property
    def tolerance(self) -> int:
        """As the confidence takes it: delta + 1 if symmetric, else 1."""
        return self.delta * self.symmetric + 1


def _union(events: DataFrame, before: int, after: int, first: int, last: int, rule: Coincidence, name: str) -> DataFrame:
    """Cells within [t - before, t + after] of an event, clipped to [first, last]."""
    cut = F.lead("t_idx").over(Window.partitionBy("loc").orderBy("t_idx")) - before - 1
    lo = F.greatest(F.col("t_idx") - before, F.lit(first))
    hi = F.least(F.col("t_idx") + after, F.lit(last), cut)  # no next event: null, which is skipped
    spans = events.select("loc", "t_idx").distinct().select("loc", lo.alias("lo"), hi.alias("hi")).where("lo <= hi")
    about = {"long_name": name, "eca_params": json.dumps(asdict(rule))}
    return spans.select("loc", F.explode(F.sequence("lo", "hi")).alias("t_idx")).withColumn("t_idx", F.col("t_idx").cast("int").alias("t_idx", metadata=about))


def precursor_window(events: DataFrame, steps: int, rule: Coincidence = Coincidence()) -> DataFrame:  # noqa: B008
    """t is in the window if an event lies in [t - tau - delta, t - tau + delta if symmetric]; no t
    below tau is."""
    ahead = rule.delta if rule.symmetric else 0
    return _union(events, ahead - rule.tau, rule.tau + rule.delta, rule.tau, steps - 1, rule, "precursor")


def trigger_window(events: DataFrame, steps: int, rule: Coincidence = Coincidence()) -> DataFrame:  # noqa: B008
    """t is in the window if an event lies in [t + tau, t + tau + delta], or, if symmetric, in
    [t - delta, t + delta], where the lag only blanks the last tau steps."""
    if rule.symmetric:
        return _union(events, rule.delta, rule.delta, 0, steps - 1 - rule.tau, rule, "trigger")
    return _union(events, rule.tau + rule.delta, -rule.tau, 0, steps - 1 - rule.tau, rule, "trigger")


def both_windows(events: DataFrame, steps: int, rule: Coincidence = Coincidence()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """The precursor and the trigger window of the same events."""
    return precursor_window(events, steps, rule), trigger_window(events, steps, rule)


def window_kind(window: DataFrame) -> tuple[str, Coincidence]:
    """What a window was made by; ValueError for any other table."""
    about = window.schema["t_idx"].metadata
    if "eca_params" not in about:
        raise ValueError("not a coincidence window")
    return about["long_name"], Coincidence(**json.loads(about["eca_params"]))


def dense_window(window: DataFrame, nodes: DataFrame, steps: int) -> DataFrame:
    """loc, t_idx, event for every cell of the axis."""
    cells = nodes.select("loc", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("t_idx"))
    return cells.join(window.select("loc", "t_idx", F.lit(True).alias("event")), ["loc", "t_idx"], "left").withColumn("event", F.coalesce("event", F.lit(False)))
