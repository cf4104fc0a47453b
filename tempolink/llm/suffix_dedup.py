"""Repeated byte strings by suffix sorting.

A byte goes if some string of `length` bytes that covers it also starts elsewhere. The work is:

1. Contexts. Each window of `length` bytes has a smallest hash among its GRAM-byte grams. Equal
   windows have equal smallest hashes, so a run of neighbouring windows with the same one, a
   context, need only be held against contexts of the same hash. One shuffle of (hash, place)
   finds hashes that occur again; all other bytes are settled without being moved.
2. Suffix arrays. The texts of repeated contexts are dealt out by hash. Equal contexts settle each
   other; the distinct ones are joined into one string, and their windows' suffixes are sorted in
   two stages: suffixes smaller than their successors are sorted directly, the others are induced
   by a scan of the buckets. Common prefixes of neighbours in the array show the repeats.
3. Hot hashes. A hash with more than `group` contexts is dealt out in several parts, each with a
   suffix array of its own. Of the windows that are equal within a part one stands for all; where
   such windows of several parts have equal hashes, their bytes go through a suffix array again.
   Each turn leaves one window for `group` of them, so a few turns do.

Hashes only name what is compared: what repeats is always decided by bytes in a suffix array (or
by equality of whole contexts).

Cases: a null text is empty; texts shorter than `length` lose nothing; rows that repeat are
occurrences of their own, and rows equal in id and text lose all without a search; an empty table gives no rows; columns other than
the id and the text are ignored; a very long text is taken alone by a task, whole.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, bounded, by_key, id_and_text, materialise, parts_for, prefix_hash, row_chunks, runs_of, span_hash, text_buffer

LENGTH = 200
GRAM = 40
#: Bytes of text for each partition of the work, about.
PART_BYTES = 1 << 25


@dataclass(frozen=True)
class Limits:
    """Contexts of a hash that are handled together; bytes of contexts in a suffix array, about;
    places that a task holds before it settles hashes that already repeat very often."""

    group: int = 2048
    pool: int = 1 << 21
    held: int = 1 << 21


PLACE = np.dtype([("key", np.uint64), ("doc", np.int64), ("txt", np.int64), ("lo", np.int32), ("hi", np.int32), ("twice", np.int8)])


# --- contexts -----------------------------------------------------------------------------------


def contexts(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of the texts in a buffer: row, hash, first and last window start within its text, and
    whether its hash occurs twice inside it, for every context."""
    n = len(data)
    span = length - gram + 1  # grams in a window
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, bool))
    at = np.arange(n - gram + 1)
    h = span_hash(prefix_hash(data), at, at + gram)
    low = _sliding(h, span, np.minimum)  # of the window that starts here
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(low)]
    valid = np.arange(len(low)) + length <= offsets[owner + 1]
    start = np.flatnonzero(valid)
    if not len(start):
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, bool))
    value, row = low[start], owner[start]
    new = np.ones(len(start), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    lo, hi = start[first], start[np.append(first[1:], len(start)) - 1]
    value, row = value[first], row[first]
    # grams that are the smallest of some window, by the context they belong to
    masked = np.where(valid, low, np.uint64(0))
    back = _sliding(np.concatenate((np.zeros(span - 1, np.uint64), masked, np.zeros(span - 1, np.uint64))), span, np.maximum)[: len(h)]
    picked = np.flatnonzero(h == back)
    names, ids = np.unique(np.concatenate((value, h[picked])), return_inverse=True)
    mine, theirs = ids[: len(value)] << 32 | lo, ids[len(value) :] << 32 | picked
    order = np.argsort(mine)
    where = order[np.maximum(np.searchsorted(mine[order], theirs, side="right") - 1, 0)]
    inside = (value[where] == h[picked]) & (lo[where] <= picked) & (picked <= hi[where] + span - 1)
    twice = np.bincount(where[inside], minlength=len(lo)) > 1
    return row, value, lo - offsets[row], hi - offsets[row], twice


def _sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best over x[i : i + width] for every i, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = best(out[:-step], out[step:])
        have += step
    return out


def packed(places: np.ndarray, n_parts: int) -> pa.RecordBatch:
    """Places by the part of the key space."""
    part = (places["key"] % np.uint64(n_parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    places = places[order]
    runs = runs_of(part[order])
    return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in runs], pa.int32()), pa.array([places[a:z].tobytes() for _, a, z in runs], pa.binary())], ["part", "places"])


def context_places(docs: DataFrame, n_parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_buffer(b.column("text"))
            doc, txt = np.asarray(b.column("doc")), np.asarray(b.column("txt"))
            made = [np.zeros(0, PLACE)]
            for i, j in row_chunks(offsets):
                row, value, lo, hi, twice = contexts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                p = np.zeros(len(row), PLACE)
                p["key"], p["doc"], p["txt"], p["lo"], p["hi"], p["twice"] = value, doc[i + row], txt[i + row], lo, hi, twice
                made.append(p)
            yield packed(np.concatenate(made), n_parts)

    return docs.mapInArrow(run, "part int, places binary")


class Repeats:
    """Places whose key occurs again (or twice in one place); keys that already repeat very often
    are settled while the others still stream in."""

    def __init__(self, limits: Limits) -> None:
        self.limits = limits
        self.cold: list[np.ndarray] = []
        self.hot: list[np.ndarray] = []
        self.n_cold = self.n_hot = self.turn = 0
        self.most = limits.held
        self.hot_keys = np.zeros(0, np.uint64)

    def add(self, places: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        if len(self.hot_keys):
            at = np.minimum(np.searchsorted(self.hot_keys, places["key"]), len(self.hot_keys) - 1)
            hot = self.hot_keys[at] == places["key"]
            self.hot.append(places[hot])
            self.n_hot += int(hot.sum())
            places = places[~hot]
            if self.n_hot > self.limits.held // 4:
                out.append(self.settle_hot())
        self.cold.append(places)
        self.n_cold += len(places)
        if self.n_cold > self.most:
            out.append(self.settle(max(3, self.limits.held // 16)))
            self.most = max(self.limits.held, 2 * self.n_cold)  # what is cold is not sorted again at every turn
        return out

    def _shares(self, nth: np.ndarray) -> np.ndarray:
        """Shares of a key's places, apart from those of other turns."""
        return 1 + self.turn * 4096 + nth // self.limits.group

    def settle_hot(self) -> tuple[np.ndarray, np.ndarray]:
        places = np.concatenate([*self.hot, np.zeros(0, PLACE)])
        places = places[np.argsort(places["key"], kind="stable")]
        start = np.flatnonzero(np.concatenate((places["key"][:1] == places["key"][:1], places["key"][1:] != places["key"][:-1])))
        share = self._shares(np.arange(len(places)) - np.repeat(start, np.diff(np.append(start, len(places)))))
        self.hot, self.n_hot = [], 0
        self.turn += 1
        return places, share

    def settle(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of keys with so many, and the share of the key's group that each belongs to: 0 of
        a group that is whole."""
        places = np.concatenate([*self.cold, np.zeros(0, PLACE)])
        places = places[np.argsort(places["key"], kind="stable")]
        start = np.flatnonzero(np.concatenate((places["key"][:1] == places["key"][:1], places["key"][1:] != places["key"][:-1])))
        count = np.diff(np.append(start, len(places)))
        weight = np.add.reduceat(1 + places["twice"].astype(np.int64), start) if len(start) else count
        early = least > 2
        big = (count if early else weight) >= least
        taken = np.repeat(big, count)
        share = self._shares(np.arange(len(places)) - np.repeat(start, count))
        if early:
            self.hot_keys = np.unique(np.append(self.hot_keys, places["key"][start][big]))
        else:
            share = np.where(np.repeat(count, count) > self.limits.group, share, 0)
        self.turn += 1
        self.cold = [places[~taken]]
        self.n_cold = int((~taken).sum())
        return places[taken], share[taken]

    def end(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return [self.settle_hot(), self.settle(2)]


def repeated(places: DataFrame, n_parts: int, limits: Limits) -> DataFrame:
    """doc, txt, lo, hi, key, share of places whose keys occur again."""

    def batch(p: np.ndarray, share: np.ndarray) -> pa.RecordBatch:
        cols = [p["doc"], p["txt"], p["lo"], p["hi"], np.ascontiguousarray(p["key"]).view(np.int64), share.astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], ["doc", "txt", "lo", "hi", "key", "share"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Repeats(limits)
        for b in batches:
            for x in b.column("places"):
                for p, share in found.add(np.frombuffer(x.as_buffer(), PLACE)):
                    yield batch(p, share)
        for p, share in found.end():
            yield batch(p, share)

    return places.repartition(n_parts, "part").mapInArrow(run, "doc long, txt long, lo int, hi int, key long, share int")


# --- suffix arrays ------------------------------------------------------------------------------


def two_stage(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes, right to `depth` bytes at least. text: ends with
    a 0, and 0 occurs as an end mark only. wanted: positions to be sorted; others may be added so
    that every run of them ends at a suffix that is smaller than its successor."""
    n = len(text)
    # smaller than the successor: the next byte that differs is larger; an end mark always is
    differs = np.append(text[1:] != text[:-1], True)
    smaller = np.append(text[:-1] < text[1:], True) | (text == 0)
    nxt = np.where(differs | (text == 0), np.arange(n), n)
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]
    direct = smaller[nxt]
    # from a wanted suffix the successors are needed up to the first one that is sorted directly
    last_direct = np.where(direct, np.arange(n), n)
    last_direct = np.minimum.accumulate(last_direct[::-1])[::-1]
    reach = np.zeros(n + 1, np.int64)
    np.add.at(reach, np.flatnonzero(wanted), 1)
    np.add.at(reach, last_direct[wanted] + 1, -1)
    need = np.cumsum(reach[:-1]) > 0
    raw = text.tobytes()
    seeds = np.array(sorted(np.flatnonzero(need & direct).tolist(), key=lambda i: raw[i : i + depth]), np.int64)
    bucket = text[seeds]
    bounds = np.searchsorted(bucket, np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        rounds = induced[c]
        new = np.concatenate(rounds) if rounds else np.zeros(0, np.int64)
        while len(new):  # predecessors with the same byte follow in the same bucket
            before = new[new > 0] - 1
            new = before[need[before] & ~direct[before] & (text[before] == c)]
            if len(new):
                rounds.append(new)
        whole = np.concatenate([*rounds, seeds[bounds[c] : bounds[c + 1]]])
        if not len(whole):
            continue
        out.append(whole)
        before = whole[whole > 0] - 1
        before = before[need[before] & ~direct[before] & (text[before] > c)]
        if len(before):
            of = text[before]
            order = np.argsort(of, kind="stable")
            before, of = before[order], of[order]
            for b, a, z in runs_of(of):
                induced[b].append(before[a:z])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def same_as_next(text: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Whether the common prefix of neighbours in a suffix array has `length` bytes."""
    same = np.ones(max(len(at) - 1, 0), bool)
    raw = np.concatenate((text, np.zeros(8, np.uint8)))
    words = np.ndarray((len(text) + 1,), "<u8", raw, strides=(1,))
    steps = [*range(0, length - 7, 8)]
    if steps[-1] + 8 < length:
        steps.append(length - 8)
    open_ = np.arange(len(same))
    for k in steps:
        hold = words[at[open_] + k] == words[at[open_ + 1] + k]
        same[open_[~hold]] = False
        open_ = open_[hold]
    return same


def window_classes(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts: text, start, and class; equal windows have the same class."""
    size = np.array([len(t) for t in texts])
    base = np.concatenate(([0], np.cumsum(size + 1)))
    text = np.zeros(base[-1], np.uint8)
    mark = np.zeros(base[-1], bool)
    mark[base[1:] - 1] = True
    text[~mark] = np.frombuffer(b"".join(texts), np.uint8) + 1  # UTF-8 has no byte 255
    wanted = np.zeros(base[-1], bool)
    reach = np.zeros(base[-1] + 1, np.int64)
    reach[base[:-1]] += 1
    reach[base[1:] - 1 - length + 1] -= 1
    wanted[np.cumsum(reach[:-1]) > 0] = True
    order = two_stage(text, wanted, length)
    order = order[wanted[order]]
    classes = np.concatenate(([0], np.cumsum(~same_as_next(text, order, length)))) if len(order) else np.zeros(0, np.int64)
    owner = np.searchsorted(base, order, side="right") - 1
    return owner, order - base[owner], classes


# --- groups -------------------------------------------------------------------------------------

LOCATION = np.dtype([("doc", np.int64), ("txt", np.int64), ("lo", np.int32)])


def context_texts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """key, share, context (binary), locations (binary): the bytes of repeated contexts; contexts
    that are equal within a batch are sent once. docs: doc, txt, text, and base, where in its
    document a text begins; windows of a document belong to one text of it at most."""
    lists = found.groupBy("doc", "txt").agg(F.collect_list(F.struct("lo", "hi", "key", "share")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_buffer(b.column("text"))
            raw = data.tobytes()
            doc, txt = b.column("doc").to_pylist(), b.column("txt").to_pylist()
            lists = b.column("found")
            parts = lists.flatten()
            lo, hi, key, share = (parts.field(k).to_numpy(zero_copy_only=False).tolist() for k in range(4))
            ends = np.cumsum(np.asarray(lists.value_lengths())).tolist()
            base = b.column("base").to_pylist()
            seen: dict[tuple, list] = defaultdict(list)
            at = 0
            for row, end in enumerate(ends):
                begin, last = int(offsets[row]) - base[row], base[row] + int(offsets[row + 1] - offsets[row]) - LENGTH
                for k in range(at, end):
                    if not base[row] <= lo[k] <= last:
                        continue
                    seen[key[k], share[k], raw[begin + lo[k] : begin + hi[k] + LENGTH]].append((doc[row], txt[row], lo[k]))
                at = end
            names = list(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in names], pa.int64()), pa.array([x[1] for x in names], pa.int32()), pa.array([x[2] for x in names], pa.binary()), pa.array([np.array(v, LOCATION).tobytes() for v in seen.values()], pa.binary())],
                ["key", "share", "context", "locations"],
            )

    joined = docs.join(lists.hint("shuffle_hash"), ["doc", "txt"])
    return joined.select("doc", "txt", "base", "text", "found").mapInArrow(run, "key long, share int, context binary, locations binary")


def _intervals(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Covered ranges of windows with ascending starts."""
    gap = np.flatnonzero(np.diff(starts) > length)
    first, last = np.append(starts[:1], starts[gap + 1]), np.append(starts[gap], starts[-1:])
    return list(zip(first.tolist(), (last + length).tolist(), strict=True))


class Groups:
    """Settles groups of contexts; distinct contexts of several groups share a suffix array."""

    def __init__(self, limits: Limits) -> None:
        self.limits = limits
        self.pool: list[tuple[bytes, np.ndarray, int]] = []
        self.size = 0
        self.gone: list[tuple] = []  # ranges (doc, txt, from, to)
        self.open: list[np.ndarray] = []  # places of windows that stand for their part of a group
        self.texts: list[tuple] = []  # (doc, txt, base, bytes) of runs of such windows

    def add(self, share: int, contexts_: dict[bytes, list[bytes]]) -> None:
        """The distinct contexts of one group, or part of one, with their locations."""
        merged = [(c, np.frombuffer(b"".join(x), LOCATION)) for c, x in contexts_.items()]
        for c, places in merged:
            if len(places) > 1:
                self.gone.extend((int(p["doc"]), int(p["txt"]), int(p["lo"]), int(p["lo"]) + len(c)) for p in places)
        if share or any(len(x) == 1 for _, x in merged):
            self.pool.extend((c, x, share) for c, x in merged)
            self.size += sum(len(c) for c, _ in merged)
            if self.size > self.limits.pool:
                self.flush()

    def flush(self) -> None:
        if not self.pool:
            return
        owner, start, cls = window_classes([c for c, _, _ in self.pool])
        alone = np.array([len(x) == 1 for _, x, _ in self.pool])
        shared = np.array([s > 0 for _, _, s in self.pool])
        # a class repeats if it has two windows, or one of a context that occurs twice
        again = np.bincount(cls, np.where(alone[owner], 1, 2))[cls] > 1
        hit = again & alone[owner]
        order = np.lexsort((start[hit], owner[hit]))
        o, s = owner[hit][order], start[hit][order]
        for k, a, z in runs_of(o):
            where = self.pool[k][1][0]
            self.gone.extend((int(where["doc"]), int(where["txt"]), int(where["lo"]) + x, int(where["lo"]) + y) for x, y in _intervals(s[a:z], LENGTH))
        if shared.any():
            lead = np.concatenate(([True], cls[1:] != cls[:-1])) & shared[owner]
            order = np.lexsort((start[lead], owner[lead]))
            o, s = owner[lead][order], start[lead][order]
            for k, a, z in runs_of(o):
                where, p = self.pool[k][1][0], np.zeros(z - a, PLACE)
                p["key"] = span_hash(prefix_hash(np.frombuffer(self.pool[k][0], np.uint8)), s[a:z], s[a:z] + LENGTH)
                p["doc"], p["txt"] = where["doc"], where["txt"]
                p["lo"] = p["hi"] = where["lo"] + s[a:z]
                self.open.append(p)
                for x, y in _intervals(s[a:z], 1):  # neighbouring windows
                    self.texts.append((int(where["doc"]), int(where["txt"]), int(where["lo"]) + x, self.pool[k][0][x : y - 1 + LENGTH]))
        self.pool.clear()
        self.size = 0

    def taken(self) -> tuple[list[tuple], np.ndarray, list[tuple]]:
        """What has been found since the last call."""
        out = self.gone, np.concatenate([*self.open, np.zeros(0, PLACE)]), self.texts
        self.gone, self.open, self.texts = [], [], []
        return out


def group_results(texts: DataFrame, n_parts: int, limits: Limits) -> DataFrame:
    """doc, txt, begin, end of ranges that go; or, of windows that stand for a part of a hot group,
    part and places, and doc, txt, begin and text of runs of them. Groups stream in one after the
    other."""
    schema = "doc long, txt long, begin long, end long, part int, places binary, text binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def found(groups: Groups) -> Iterator[pa.RecordBatch]:
        gone, open_, texts_ = groups.taken()
        if gone:
            cols = zip(*gone, strict=True)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.nulls(len(gone), pa.int32()), *[pa.nulls(len(gone), pa.binary())] * 2], names)
        if len(open_):
            b, n = packed(open_, n_parts), len(texts_)
            yield pa.RecordBatch.from_arrays([*[pa.nulls(b.num_rows, pa.int64())] * 4, *b.columns, pa.nulls(b.num_rows, pa.binary())], names)
            doc, txt, base, raw = zip(*texts_, strict=True)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (doc, txt, base)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(raw, pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = Groups(limits)
        for held in by_key(batches, "key", "share"):
            contexts_: dict[bytes, list[bytes]] = defaultdict(list)
            for context, where in zip(held["context"].to_pylist(), held["locations"].to_pylist(), strict=True):
                contexts_[context].append(where)
            groups.add(held["share"][0].as_py(), contexts_)
            if len(groups.gone) + sum(map(len, groups.open)) > 1 << 16:
                yield from found(groups)
        groups.flush()
        yield from found(groups)

    return texts.repartition(n_parts, "key", "share").sortWithinPartitions("key", "share").mapInArrow(run, schema)


# --- documents ----------------------------------------------------------------------------------


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows by id and a hash of the text, which equal rows share."""
    return docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), F.xxhash64(F.col("doc_id").isNull(), "text").alias("txt"), "doc_id", "text")


def _equal_rows(read: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Rows that no other row equals in id and text; these and one row of each set of equal ones, as
    others' strings may occur there; and all equal ones, or None, which need no search themselves."""
    again = materialise(read.groupBy("doc", "txt").agg(F.count("*").alias("n")).where("n > 1").select("doc", "txt"), "equal-rows")
    if again.isEmpty():
        return read, read, None
    equal, every = (read.join(bounded(again), ["doc", "txt"], how) for how in ("left_semi", "left_anti"))
    one = equal.groupBy("doc", "txt").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    return every, every.unionByName(one), equal


RESULT_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """doc_id, n_bytes, n_removed, n_spans, kept (binary: the bytes that stay) for every row."""
    read = _keyed(id_and_text(docs, id_col, text_col))
    size = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = parts_for(docs.sparkSession, size, PART_BYTES)
    every, single, equal = _equal_rows(read)
    places, settled, source = context_places(single, n_parts), [], single.withColumn("base", F.lit(0).cast("long"))
    while True:
        results = materialise(group_results(context_texts(source, repeated(places, n_parts, limits)), n_parts, limits), "ranges")
        settled.append(results.where("end is not null").select("doc", "txt", "begin", "end"))
        places = results.where("places is not null").select("part", "places")
        source = results.where("text is not null").select("doc", "txt", F.col("begin").alias("base"), "text")
        if places.isEmpty():
            break
    ranges = reduce(DataFrame.unionByName, settled)
    lists = ranges.groupBy("doc", "txt").agg(F.collect_list(F.struct("begin", "end")).alias("ranges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_buffer(b.column("text"))
            lists = b.column("ranges")
            parts = lists.flatten()
            begin, end = (parts.field(k).to_numpy(zero_copy_only=False) for k in range(2))
            n = np.asarray(lists.value_lengths().fill_null(0))
            stop = np.cumsum(n)
            for i, j in row_chunks(offsets, 4 * CHUNK_BYTES):
                size, removed, spans, kept = [], [], [], []
                for row in range(i, j):
                    own = data[offsets[row] : offsets[row + 1]]
                    size.append(len(own))
                    if not n[row]:
                        removed.append(0)
                        spans.append(0)
                        kept.append(own.tobytes())
                        continue
                    depth = np.zeros(len(own) + 1, np.int32)
                    np.add.at(depth, begin[stop[row] - n[row] : stop[row]], 1)
                    np.add.at(depth, end[stop[row] - n[row] : stop[row]], -1)
                    out = np.cumsum(depth[:-1]) > 0
                    removed.append(int(out.sum()))
                    spans.append(int(out[0]) + int(np.count_nonzero(out[1:] & ~out[:-1])))
                    kept.append(own[~out].tobytes())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), *(pa.array(x, pa.int64()) for x in (size, removed, spans)), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    out = every.join(lists.hint("shuffle_hash"), ["doc", "txt"], "left").select("doc_id", "text", "ranges").mapInArrow(run, RESULT_SCHEMA)
    if equal is None:
        return out
    # each byte of such a row is covered by a string of another row, or it has no string at all
    n = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    goes = n >= LENGTH
    gone = equal.select("doc_id", n.alias("n_bytes"), F.when(goes, n).otherwise(0).alias("n_removed"), F.when(goes, 1).otherwise(0).cast("long").alias("n_spans"), F.when(goes, F.lit(b"")).otherwise(F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("kept"))
    return out.unionByName(gone)


def repeat_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """`remove_repeats` with the kept bytes as a digest."""
    kept: Column = F.sha2("kept", 256).alias("kept_sha256")
    return remove_repeats(docs, id_col, text_col, limits).select("doc_id", "n_bytes", "n_removed", "n_spans", kept)
