"""What the event counts of two places and the coincidences of the pair say, looked up while pairs are made.

A table has a value for each two event counts that places have, and for each number of coincidences up
to a top. It is made by Spark, and small (`SMALL`); tiles of pairs (`operators.tiles`) read it as an array,
so that no pair is joined with it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a table is broadcast, or read as an array.
SMALL = 1 << 20


def tally(counts: DataFrame) -> dict[int, int]:
    """Places by their event count: no more entries than a series has steps."""
    return {int(r["event_count"]): r["count"] for r in counts.groupBy("event_count").count().collect()}


def with_counts(nodes: DataFrame, counts: DataFrame) -> DataFrame:
    """The places that have a count (loc, event_count), and it as n."""
    return nodes.select("loc").join(counts.select("loc", F.col("event_count").cast("long").alias("n")), "loc")


@dataclass(frozen=True)
class Judgement:
    """columns: for each name its type and values, by nb, na and coincidences from 0 to top."""

    na: np.ndarray
    nb: np.ndarray
    top: int
    columns: dict[str, tuple[str, np.ndarray]]

    @property
    def schema(self) -> str:
        return "".join(f", `{name}` {kind}" for name, (kind, _) in self.columns.items())

    @classmethod
    def read(cls, table: DataFrame, na: list[int], nb: list[int], top: int) -> Judgement | None:
        """From rows na, nb, at and what else is to be looked up; None where a row or a value is missing."""
        known = table.toArrow().sort_by([(c, "ascending") for c in ("nb", "na", "at")])
        names = [f.name for f in table.schema.fields if f.name not in ("na", "nb", "at")]
        if len(known) != len(na) * len(nb) * (top + 1) or any(known[c].null_count for c in names):
            return None
        types = {f.name: f.dataType.simpleString() for f in table.schema.fields}
        return cls(np.array(sorted(na)), np.array(sorted(nb)), top, {c: (types[c], known[c].to_numpy()) for c in names})

    def of(self, n_a: np.ndarray) -> Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]]:
        """For places with these event counts a function of coincidences, b's places by a's, and b's event counts."""
        width = self.top + 1
        ia = np.searchsorted(self.na, n_a)
        start = (ia * width).astype(np.int32)
        shape = (len(self.nb), len(self.na), width)
        least = {}
        for name, (kind, values) in self.columns.items():
            made = values.reshape(shape)
            if kind == "boolean" and (made[:, :, 1:] >= made[:, :, :-1]).all():  # true from some number on
                from_here = np.where(made.any(axis=2), made.argmax(axis=2), np.iinfo(np.int32).max)
                least[name] = from_here[:, ia]
        of_type = {}

        def judge(k: np.ndarray, n_b: np.ndarray) -> dict[str, np.ndarray]:
            ib = np.searchsorted(self.nb, n_b)
            found, at = {}, None
            for name, (_, values) in self.columns.items():
                if name in least:
                    if (name, k.dtype) not in of_type:  # counts are below the largest number of their type
                        of_type[name, k.dtype] = np.minimum(least[name], np.iinfo(k.dtype).max).astype(k.dtype)
                    found[name] = k >= of_type[name, k.dtype][ib]
                    continue
                if at is None:
                    at = np.minimum(k, min(self.top, np.iinfo(k.dtype).max)) + start
                    at += (ib * (len(self.na) * width)).astype(np.int32)[:, None]
                found[name] = values.take(at)
            return found

        return judge
