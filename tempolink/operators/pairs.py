"""Coincidence counts of all pairs of places.

Ways to the same counts, all inside pairs of tiles of places (`operators.tiles`):
- "sparse" has window cells and events meet on their step, from lists of steps that may be repeated.
- "bitmap" packs each series into 64-bit words and counts common bits.
- "matmul" multiplies 0/1 matrices.
- "auto", the default, adds for each place b the rows of a table of steps by places a that b's events
  choose, and multiplies matrices in tiles where events aren't rare.

Several windows of a (precursor and trigger, say) are counted against the same events of b at once,
side by side in a row, so that no table of pairs has to be joined with another.

The full grid of pairs is the result, so its size is the square of the number of places. Memory is
bound by a pair of tiles, and the pairs of tiles spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .tiles import HANDED, SIDE, Named, every, key, met, over_tiles, smallest, tiles_of, turns, unpacked, width_of
from .windows import Coincidence, precursor_window, trigger_window, window_kind

#: Places in a tile, at least.
BLOCK = 512
#: Steps for one event of b from which on sums of rows are cheaper than a product of matrices.
RARE = 6
#: Rows of blocks that travel together, at least, about.
TILE = 1 << 15
#: Cells of a window that are looked up in one turn, about.
MET = 1 << 21
STRATEGIES = ("auto", "bitmap", "sparse", "matmul")


def _n_blocks(nodes: DataFrame) -> int:
    return tiles_of(nodes.count(), BLOCK)


def blocks_of(nodes_a: DataFrame, nodes_b: DataFrame) -> tuple[int, int]:
    n = _n_blocks(nodes_a)
    return n, n if nodes_b is nodes_a else _n_blocks(nodes_b)


def _grid(left: DataFrame, right: DataFrame, blocks_a: int, blocks_b: int) -> DataFrame:
    """Every row of left with every row of right, dealt out by pairs of blocks."""
    one = left.withColumnRenamed("loc", "a").withColumn("i", key(F.col("a"), blocks_a)).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(blocks_b - 1))))
    two = right.withColumnRenamed("loc", "b").withColumn("j", key(F.col("b"), blocks_b)).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(blocks_a - 1))))
    return one.join(two.hint("shuffle_hash") if blocks_b > 1 else two, ["i", "j"])


def all_pairs(nodes_a: DataFrame, nodes_b: DataFrame) -> DataFrame:
    """a, b for every pair of places, a place with itself included."""
    return _grid(nodes_a.select("loc"), nodes_b.select("loc"), *blocks_of(nodes_a, nodes_b)).select("a", "b")


def pair_counts(window_a: DataFrame, events_b: DataFrame, nodes_a: DataFrame, nodes_b: DataFrame, steps: int, strategy: str = "auto") -> DataFrame:
    """a, b, k: steps at which b has an event inside a's window, for every pair, zeros included."""
    return fused_counts({"k": window_a}, events_b, nodes_a, nodes_b, steps, strategy)


def fused_counts(windows: dict[str, DataFrame], events_b: DataFrame, nodes_a: DataFrame, nodes_b: DataFrame, steps: int, strategy: str = "auto", bounds: list[int] | None = None) -> DataFrame:
    """a, b, and for each window of a, under its name, the steps at which b has an event inside it, for
    every pair, zeros included. The pairs are made once for all windows. bounds: as in `tiles.over_tiles`."""
    names = list(windows)
    one = nodes_a.select("loc")
    two = one if nodes_b is nodes_a else nodes_b.select("loc")
    kinds = [nodes.schema["loc"].dataType.simpleString() for nodes in (one, two)]

    def make(named: Named, some: slice, counted: Iterator[tuple[slice, dict[str, np.ndarray]]], a: pa.Table, b: pa.Table) -> Iterator[pa.RecordBatch]:
        for at, k in counted:
            yield named.rows(some, at, {c: v.astype(np.int32) for c, v in k.items()})

    made = over_counts(windows, events_b, one, two, steps, make, ", ".join([f"a {kinds[0]}, b {kinds[1]}", *(f"`{k}` int" for k in names)]), strategy, bounds)
    return made.select("a", "b", *(F.col(k).cast("long").alias(k) for k in names))


def over_counts(windows: dict[str, DataFrame], events_b: DataFrame, nodes_a: DataFrame, nodes_b: DataFrame, steps: int, make, schema: str, strategy: str = "auto", bounds: list[int] | None = None) -> DataFrame:  # noqa: ANN001
    """make(named, some, counted, a, b) for ranges of places of a, which gives batches of the schema. nodes
    are loc and what else is to be known of a place; a and b are the places of two tiles, some is a range of
    a's, and counted gives ranges of b's with the counts of each window, b's places by a's."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {STRATEGIES}")
    windows, events_b = {k: w.select("loc", "t_idx") for k, w in windows.items()}, events_b.select("loc", "t_idx")
    names = list(windows)
    if strategy == "sparse":
        one, two, prepared = _listed(windows, nodes_a), _listed({"at": events_b}, nodes_b), _from_lists
    else:
        one, two, prepared = packed_series(windows, nodes_a, steps), packed_series({"at": events_b}, nodes_b, steps), _from_bits

    def run(a: pa.Table, b: pa.Table) -> Iterator[pa.RecordBatch]:
        named = Named(a, b)
        width, of = prepared(a, b, names, steps, strategy)
        for some, parts in turns(len(a), len(b), width):
            count = of(some)
            yield from make(named, some, ((at, count(at)) for at in parts), a, b)

    return over_tiles(one, two, *blocks_of(nodes_a, nodes_b), run, schema, bounds)


def bounds_of(nodes: DataFrame, size: int) -> list[int]:
    """Where tiles of neighbouring places begin, of about as many places each, so that none cuts a block of `size`."""
    n = _n_blocks(nodes)
    at = nodes.approxQuantile("loc", [k / n for k in range(1, n)], 0.1 / n) if n > 1 else []
    return sorted({int(x // size) * size for x in at})


def _listed(cells: dict[str, DataFrame], nodes: DataFrame) -> DataFrame:
    """The nodes, and for each set of cells the place's steps."""
    tagged = reduce(DataFrame.unionByName, (c.select("loc", F.col("t_idx").cast("int").alias("t_idx"), F.lit(k).alias("which")) for k, c in cells.items()))
    lists = tagged.groupBy("loc").agg(*(F.collect_list(F.when(F.col("which") == k, F.col("t_idx"))).alias(k) for k in cells))
    return nodes.join(lists, "loc", "left")


def packed_series(cells: dict[str, DataFrame], nodes: DataFrame, steps: int) -> DataFrame:
    """The nodes, and for each set of cells the place's series as packed bits, an eighth of a byte a step."""
    names = list(cells)
    known = [f for f in nodes.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for k in names:
                at = b.column(k)
                bits = np.zeros((b.num_rows, steps), np.uint8)
                bits[np.repeat(np.arange(b.num_rows), np.asarray(at.value_lengths().fill_null(0))), np.asarray(at.flatten())] = 1
                made.append(pa.array([row.tobytes() for row in np.packbits(bits, axis=1)], pa.binary()))
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in known), *made], [*(f.name for f in known), *names])

    return _listed(cells, nodes).mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in known), *(f"`{k}` binary" for k in names)]))


def _sums(table: np.ndarray, at: np.ndarray, ends: np.ndarray, part: slice, dtype: type) -> np.ndarray:
    """For each of b's places the sum of the table's rows at its steps."""
    made = np.empty((part.stop - part.start, table.shape[1]), dtype)
    for row, k in zip(made, range(part.start, part.stop), strict=True):
        np.add.reduce(table[at[ends[k] : ends[k + 1]]], axis=0, dtype=dtype, out=row)
    return made


def _from_bits(a: pa.Table, b: pa.Table, names: list[str], steps: int, strategy: str):  # noqa: ANN202
    """How many places of a are taken at once, and a function that gives, for a range of these, one that
    counts for a range of b's places."""
    size = -(-steps // 8)
    packed = lambda rows: np.frombuffer(b"".join(rows.to_pylist()), np.uint8).reshape(len(rows), size)
    series, events = {k: packed(a[k]) for k in names}, packed(b["at"])
    if strategy == "bitmap":
        words = lambda bits: np.ascontiguousarray(np.pad(bits, ((0, 0), (0, -size % 8))).view(np.uint64).T)
        of_b = words(events)

        def by_words(some: slice):  # noqa: ANN202
            of_a = {k: words(v[some]) for k, v in series.items()}

            def count(part: slice) -> dict[str, np.ndarray]:
                made = {k: np.zeros((part.stop - part.start, some.stop - some.start), np.int32) for k in names}
                for k, total in made.items():
                    for x, y in zip(of_a[k], of_b, strict=True):
                        total += np.bitwise_count(y[part, None] & x)
                return made

            return count

        return width_of(size), by_words

    unpacked = lambda bits: np.unpackbits(bits, axis=1, count=steps)
    row, at = np.nonzero(unpacked(events))
    ends = np.searchsorted(row, np.arange(len(b) + 1))
    most = int(np.diff(ends).max(initial=0))
    if strategy == "auto" and len(at) * RARE <= len(b) * steps:
        dtype = smallest(most)

        def by_sums(some: slice):  # noqa: ANN202
            of_a = {k: np.ascontiguousarray(unpacked(v[some]).T) for k, v in series.items()}
            return lambda part: {k: _sums(of_a[k], at, ends, part, dtype) for k in names}

        return width_of(steps), by_sums

    number = np.float32 if steps < 1 << 24 else np.float64  # counts stay whole

    def by_product(some: slice):  # noqa: ANN202
        of_a = {k: unpacked(v[some]).T.astype(number) for k, v in series.items()}

        def count(part: slice) -> dict[str, np.ndarray]:
            of_b = unpacked(events[part]).astype(number)
            return {k: (of_b @ of_a[k]).astype(np.int32) for k in names}

        return count

    return width_of(4 * steps), by_product


def _from_lists(a: pa.Table, b: pa.Table, names: list[str], steps: int, strategy: str):  # noqa: ANN202, ARG001
    """The same from lists of steps, in which a step may be repeated: cells of a's windows meet b's events
    of their step."""

    def flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        one_list = lists.combine_chunks()
        return np.append(0, np.cumsum(np.asarray(one_list.value_lengths().fill_null(0)))), np.asarray(one_list.flatten())

    ends, y = flat(b["at"])
    known, at = np.unique(y, return_inverse=True)
    cells = {k: flat(a[k]) for k in names}
    most = int(np.diff(ends).max(initial=0))

    def of(some: slice):  # noqa: ANN202
        tables = {}
        for k, (starts, x) in cells.items():
            n = some.stop - some.start
            who = np.repeat(np.arange(n), np.diff(starts[some.start : some.stop + 1]))
            x = x[starts[some.start] : starts[some.stop]]
            table = np.zeros(len(known) * n, np.int64)
            for turn in range(0, len(x) if len(known) else 0, MET):
                where = np.minimum(np.searchsorted(known, x[turn : turn + MET]), len(known) - 1)
                met = known[where] == x[turn : turn + MET]
                table += np.bincount(where[met] * n + who[turn : turn + MET][met], minlength=len(table))
            table = table.reshape(len(known), n)
            tables[k] = table.astype(smallest(max(most, 1) * int(table.max(initial=0))))
        return lambda part: {k: _sums(table, at, ends, part, table.dtype.type) for k, table in tables.items()}

    return width_of(8 * len(known)), of


def precursor_counts(events_a: DataFrame, events_b: DataFrame, nodes_a: DataFrame, nodes_b: DataFrame, steps: int, rule: Coincidence = Coincidence(), strategy: str = "auto") -> DataFrame:  # noqa: B008
    return from_window("precursor", precursor_window(events_a, steps, rule), events_b, nodes_a, nodes_b, steps, strategy)


def trigger_counts(events_a: DataFrame, events_b: DataFrame, nodes_a: DataFrame, nodes_b: DataFrame, steps: int, rule: Coincidence = Coincidence(), strategy: str = "auto") -> DataFrame:  # noqa: B008
    return from_window("trigger", trigger_window(events_a, steps, rule), events_b, nodes_a, nodes_b, steps, strategy)


def from_window(kind: str, window: DataFrame, events_b: DataFrame, nodes_a: DataFrame, nodes_b: DataFrame, steps: int, strategy: str = "auto") -> DataFrame:
    """Counts from a window made before; ValueError for a window of the other kind."""
    if window_kind(window)[0] != kind:
        raise ValueError(f"not a {kind} window")
    return pair_counts(window, events_b, nodes_a, nodes_b, steps, strategy)


def over_blocks(func, left: DataFrame, right: DataFrame, size: int, schema: str) -> DataFrame:  # noqa: ANN001
    """Any function of two blocks of places (pandas in, pandas out) over every pair of blocks. Neighbouring
    blocks travel together, so that a row is sent to each such group, of which there are `SIDE` at most, about."""
    from .axis import block_of

    (n_a, rows_a), (n_b, rows_b) = (df.agg(F.coalesce(F.max(block_of(F.col("loc"), size)), F.lit(0)) + 1, F.count("*")).first() for df in (left, right))
    each_a, each_b = (max(1, max(TILE, rows // SIDE) * n // max(rows, 1)) for n, rows in ((n_a, rows_a), (n_b, rows_b)))
    groups = lambda n, each: (n - 1) // each + 1
    kept_a, kept_b = left.columns, right.columns
    at = block_of(F.col("loc"), size)
    one = left.select(*kept_a, at.alias("__block"), block_of(at, each_a).alias("i"), every(groups(n_b, each_b)).alias("j"))
    two = right.select(*kept_b, at.alias("__block"), every(groups(n_a, each_a)).alias("i"), block_of(at, each_b).alias("j"))
    whole = StructType.fromDDL(f"{schema}, bi int, bj int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, a, b in zip(*(batch.column(c) for c in "ijab"), strict=True):
                left, right = unpacked(a).to_pandas(), unpacked(b).to_pandas()
                yield from pairs(i.as_py(), j.as_py(), left, right)

    def pairs(i: int, j: int, left: pd.DataFrame, right: pd.DataFrame) -> Iterator[pa.RecordBatch]:
        blocks = lambda rows, kept: {k: of[kept].reset_index(drop=True) for k, of in rows.groupby("__block")}
        of_a, of_b = blocks(left, kept_a), blocks(right, kept_b)
        no_a, no_b = left[:0][kept_a], right[:0][kept_b]
        made, keys, rows = [], [], 0
        for bi in range(i * each_a, min((i + 1) * each_a, n_a)):
            for bj in range(j * each_b, min((j + 1) * each_b, n_b)):
                if bi in of_a or bj in of_b:
                    made.append(func(of_a.get(bi, no_a), of_b.get(bj, no_b)))
                    keys.append((bi, bj, len(made[-1])))
                    rows += len(made[-1])
                    if rows >= HANDED:
                        yield put_together(made, keys)
                        made, keys, rows = [], [], 0
        if made:
            yield put_together(made, keys)

    def put_together(made: list[pd.DataFrame], keys: list[tuple[int, int, int]]) -> pa.RecordBatch:
        bi, bj, n = np.array(keys).T
        found = {c: np.concatenate([m[c].to_numpy() for m in made]) for c in whole.names if c not in ("bi", "bj")} | {"bi": np.repeat(bi, n), "bj": np.repeat(bj, n)}
        return pa.RecordBatch.from_pandas(pd.DataFrame(found), to_arrow_schema(whole), preserve_index=False)

    return met(one, two, groups(n_a, each_a), groups(n_b, each_b)).mapInArrow(run, whole)
