"""Pairs of places, a tile with a tile.

Places are put into tiles, and each pair of tiles is one key and one work item: the rows of both meet in
a task, are handed on there as two Arrow tables, and the pairs are made from these some at a time. So
a row travels once for each tile of the other side, of which there are about `SIDE`, memory is bound
by two tiles and some pairs, and what is made of the pairs never moves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tiles that places are put into, about, and places that a tile has at most.
SIDE = 32
MOST = 1 << 14
#: Pairs of places that are handed on at once, about.
HANDED = 1 << 16
#: Entries of a table of steps by places that pairs are counted from, about.
CELLS = 1 << 22


def tiles_of(n: int, least: int) -> int:
    """How many tiles so many places are put into, if one has no fewer than `least`."""
    return max(1, -(-n // max(least, min(-(-n // SIDE), MOST))))


def key(loc: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(loc), F.lit(n)).cast("int")


def every(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def unpacked(packed: pa.Scalar) -> pa.Table:
    with pa.ipc.open_stream(packed.as_buffer()) as stream:
        return stream.read_all().combine_chunks()


def met(one: DataFrame, two: DataFrame, n_a: int, n_b: int) -> DataFrame:
    """i, j, a, b: a row for each pair of tiles, with the rows of one (i, j, ...) and of two (i, j, ...)
    as Arrow tables. Both have their rows once for each tile that they meet."""
    names = [c for c in two.columns if c not in ("i", "j")]

    def pack(k: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        kept = a.drop_columns(["i", "j"]), b.select([f"{c}__b" for c in names]).rename_columns(names)
        return pa.table({**{c: pa.array([v.as_py()], pa.int32()) for c, v in zip("ij", k, strict=True)}, **{c: pa.array([_packed(rows)], pa.binary()) for c, rows in zip("ab", kept, strict=True)}})

    # a number of parts, as the few bytes would else be coalesced into few tasks
    left = one.repartition(n_a * n_b, "i", "j").groupBy("i", "j")
    right = two.select(*(F.col(c).alias(f"{c}__b") for c in two.columns)).repartition(n_a * n_b, "i__b", "j__b").groupBy("i__b", "j__b")
    return left.cogroup(right).applyInArrow(pack, "i int, j int, a binary, b binary")


def over_tiles(one: DataFrame, two: DataFrame, n_a: int, n_b: int, make: Callable[[pa.Table, pa.Table], Iterator[pa.RecordBatch]], schema: str, bounds: list[int] | None = None) -> DataFrame:
    """make(a, b) for every pair of tiles of the places (loc, ...) of one and of two. bounds: where tiles, instead
    of being dealt out, begin; then their places are sorted."""
    of_a, of_b = (key(F.col("loc"), n) for n in (n_a, n_b))
    if bounds is not None:
        of_a = of_b = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<long>"), lambda first: first <= F.col("loc")))
        n_a = n_b = len(bounds) + 1
    left = one.select("*", of_a.alias("i"), every(n_b).alias("j"))
    right = two.select("*", every(n_a).alias("i"), of_b.alias("j"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = (unpacked(batch.column(side)[k]) for side in ("a", "b"))
                if bounds is not None:
                    a, b = a.sort_by("loc"), b.sort_by("loc")
                if len(a) and len(b):
                    yield from make(a, b)

    return met(left, right, n_a, n_b).mapInArrow(run, schema)


def turns(n_a: int, n_b: int, width: int) -> Iterator[tuple[slice, Iterator[slice]]]:
    """Ranges of a's places of so many, and for each the ranges of b's places that are handed on with it."""
    for lo in range(0, n_a, width):
        some = slice(lo, min(lo + width, n_a))
        rows = max(1, HANDED // (some.stop - some.start))
        yield some, (slice(k, min(k + rows, n_b)) for k in range(0, n_b, rows))


def width_of(entries: int) -> int:
    """Places whose table of so many entries each stays in the cache."""
    return max(64, CELLS // max(entries, 1))


class Named:
    """Rows of pairs from arrays of b's places by a's."""

    def __init__(self, a: pa.Table, b: pa.Table) -> None:
        self.a, self.b = (t["loc"].combine_chunks() for t in (a, b))
        self.some, self.left, self.right = None, {}, {}

    def rows(self, some: slice, at: slice, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
        m, n = some.stop - some.start, at.stop - at.start
        if self.some != some:
            self.some, self.left, self.right = some, {}, {}
        if n not in self.left:
            self.left[n] = self.a.slice(some.start, m).take(pa.array(np.tile(np.arange(m), n)))
            self.right[n] = pa.array(np.repeat(np.arange(n), m))
        made = [self.left[n], self.b.slice(at.start, n).take(self.right[n]), *(pa.array(v.ravel()) for v in columns.values())]
        return pa.RecordBatch.from_arrays(made, ["a", "b", *columns])


def smallest(bound: int) -> type:
    """The smallest whole numbers that hold all up to a bound, and one more."""
    return next(t for t in (np.uint8, np.uint16, np.int32, np.int64) if bound < np.iinfo(t).max)
