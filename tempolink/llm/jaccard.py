"""Exact Jaccard join of shingle sets in a metric space, and its components.

Two sets are linked when their Jaccard distance is at most r. The join has three steps:

1. Projections. A hash splits the shingles into m classes, and a set into m parts. Linked sets
   differ in at most T shingles, so with m > T parts at least one part agrees wholly (pigeonhole).
   All sets with the same part are a cell; the smallest of them leads it. T follows from the size
   of the smaller set, so sets are treated in bands of size, and a set joins every band in which a
   smaller partner may stand (the window of sizes). What a leader's cells hold is a region, and a
   region whose leader stands in another one is merged into it: a linked pair shares a cell, hence
   a region. In a region that fits into a leaf, sets are first compared by how many of their
   shingles fall into each of some buckets. These counts differ by no more than the sets do, so a
   set whose counts differ too much from all others has no link there and leaves, before the
   shingles of the rest are fetched.
2. Voronoi regions. A region with more sets than a leaf may hold draws some of them as pivots. Each
   set goes to the region of its nearest pivot. By the triangle inequality a set x can have links
   into the region of another pivot q only if d(x, q) - d(x, p) <= 2r: there it is replicated, to
   pivots of a lower number only, so that each pair meets once. The regions are joined in the same
   way, down a recursion, until they fit into a leaf.
3. Leaves. Distances to one set of the leaf split it into the ball within r, linked by that set
   alone, and the rest, which finds candidates by a prefix index of its rarest shingles, filtered by
   the triangle inequality; sets already connected are not compared.

Two entries of a region need no comparison if both are replicas there, or both stand within r of
the pivot, as links to it connect them. Bits say so, two for each level; a region where one bit
is set for all has no pair left and goes, and one where it is set for all but a few is dealt out
in parts, each with these few. Pivots don't divide a region whose sets all lie in one another's
windows. Links to some dozens of pivots connect most of a family of near copies, and what is so
connected needs no comparison. For the rest, sets that share one of their rarest shingles (by the
pivots' counts) form cells and new regions, as at first, and go on down the recursion. What even
that doesn't divide is compared in blocks: the unconnected sets with each other and with all.

Only true links leave a region. Equal sets are one point from the start. Sets are held as 64-bit
hashes of their shingles, points by 128-bit digests of the sets.

Cases: a null or empty text has no words, an empty set, no link, and is its own component (a row
without an id has none, but its links count); fewer words than a shingle takes make one shingle;
ties and repeated rows are equal sets; an empty table gives no rows; columns other than the id and
the text are ignored; a very long text is one set, and a leaf of its own size.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GOLDEN, bounded, by_key, free_names, id_and_text, materialise, mix64, parts_for, row_chunks, runs_of, text_buffer, word_hashes
from .components import components

#: Times that regions are merged.
MERGES = 2
#: Entries of a cell beyond which its leader is settled while the others still stream in.
HOT_CELL = 1 << 16
#: Entries that a task holds before it settles its hot cells.
HELD = 1 << 22
#: Levels of the recursion at most; each has two bits of an entry's 64.
ROUNDS = 24
#: Bits of what is dealt out last: the sides of two blocks.
DEALT, OTHER = 1 << 60, 1 << 61
#: Tasks over which the entries of a cell of rarest shingles are dealt.
SALTS = 16
#: Buckets in which the shingles of a set are counted, at least and at most.
BUCKETS = (32, 1 << 16)
#: Pivots, as bits, of a region that pivots don't divide.
PIVOT_BITS = 48


@dataclass(frozen=True)
class Limits:
    """Sets and shingles in a leaf; pivots that divide a larger region, about; how many copies of
    its sets that may make, and what share of them a single new region may hold (more, and pivots
    don't divide it)."""

    sets: int = 512
    shingles: int = 1 << 21
    pivots: int = 8
    copies: float = 3.0
    shrink: float = 0.8


@dataclass(frozen=True)
class Rule:
    """Shingles of `words` words; linked when den * |x & y| >= num * |x | y|."""

    words: int = 3
    num: int = 90
    den: int = 100

    def linked(self, inter: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.den * inter >= self.num * (a + b - inter)

    def most_apart(self, smaller: int) -> int:
        """Shingles in which linked sets differ, at most, by the smaller one's size."""
        return (self.den - self.num) * smaller // self.num

    def least_partner(self, n: np.ndarray) -> np.ndarray:
        return -(-self.num * n // self.den)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the texts in a buffer, sorted within each, and their bounds."""
    w, rows = word_hashes(data, offsets)
    texts = len(offsets) - 1
    count = np.bincount(rows, minlength=texts)[:texts]
    first = np.concatenate(([0], np.cumsum(count)))
    h, n = np.zeros(len(w), np.uint64), len(w)
    for k in range(min(words, n)):  # no shingle begins beyond
        h[: n - k] = mix64(h[: n - k] * GOLDEN + w[k:])
    at = np.arange(n)
    full = at + words <= first[rows + 1]
    short = np.flatnonzero((count > 0) & (count < words))
    for r in short:  # all of its words as one, told apart by their number
        v = np.zeros(1, np.uint64)
        for x in range(first[r], first[r + 1]):
            v = mix64(v * GOLDEN + w[x : x + 1])
        h[first[r]] = mix64(v + np.uint64(count[r]))[0]
        full[first[r]] = True
    h, rows = h[full], rows[full]
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    h, rows = h[new], rows[new]
    return h, np.searchsorted(rows, np.arange(texts + 1))


def set_id(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def short_id(digest: bytes) -> int:
    """By this cells and regions know a set. Sets that share it go everywhere together, and are told
    apart where their hashes are fetched."""
    return int.from_bytes(digest[:8], "little", signed=True)


def edges_of_bands(limit: int) -> np.ndarray:
    """Sizes at which bands begin: every size up to 12, then a third more each."""
    out = list(range(1, 13))
    while out[-1] <= limit:
        out.append(max(out[-1] + 1, out[-1] * 4 // 3))
    return np.array([*out, out[-1] * 2])


@dataclass(frozen=True)
class Band:
    """Classes of a band, and how many empty parts a set may leave out."""

    classes: int
    spare: int


def band_plan(rule: Rule, starts: np.ndarray) -> list[Band | None]:
    """None where linked sets of the band are equal sets. With m = T + 1 + spare classes at least
    1 + spare parts agree, so a set with at most `spare` empty parts needs none of them."""
    out: list[Band | None] = []
    for low, high in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        apart = rule.most_apart(high - 1)
        empty = (apart + 1) * math.exp(-low / (apart + 1))
        spare = math.ceil(1.5 * empty + 3 * math.sqrt(empty)) + 1
        out.append(Band(apart + 1 + spare, spare) if apart else None)
    return out


def cell_keys(h: np.ndarray, bounds: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the cells of every set, and the sets' numbers."""
    size = np.diff(bounds)
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    starts = edges_of_bands(int(size.max()))
    plan = band_plan(rule, starts)
    classes = np.array([b.classes if b else 0 for b in plan])
    spare = np.array([b.spare if b else 0 for b in plan])
    top = np.searchsorted(starts, size, side="right") - 1
    bottom = np.searchsorted(starts, rule.least_partner(size), side="right") - 1
    part, weight = mix64(h ^ GOLDEN), mix64(h + GOLDEN)
    owner = np.repeat(np.arange(len(size)), size)
    keys, sets = [], []
    for step in range(int((top - bottom).max()) + 1):
        band = top - step
        here = (size > 0) & (band >= bottom) & (band >= 0)
        here &= classes[np.maximum(band, 0)] > 0
        m = np.where(here, classes[np.maximum(band, 0)], 0)
        if not m.any():
            continue
        base = np.concatenate(([0], np.cumsum(m)))
        used = here[owner]
        who = owner[used]
        at = base[who] + (part[used] % m[who].astype(np.uint64)).astype(np.int64)
        total = np.zeros(base[-1], np.uint64)
        np.add.at(total, at, weight[used])
        filled = np.bincount(at, minlength=base[-1]) > 0
        of = np.repeat(np.arange(len(size)), m)
        empty = m - np.bincount(of[filled], minlength=len(size))
        emit = filled | (empty > spare[np.maximum(band, 0)])[of]
        cls = np.arange(base[-1]) - base[of]
        name = (band[of].astype(np.uint64) << np.uint64(32)) + cls.astype(np.uint64)
        keys.append(mix64(total + mix64(name * GOLDEN + np.uint64(1)))[emit])
        sets.append(of[emit])
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(sets)


def bucket_counts(h: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """For every set, how many of its shingles fall into each of about an eighth as many buckets, a
    byte each, the highest standing for more."""
    size = np.diff(bounds)
    buckets = np.clip(1 << np.ceil(np.log2(np.maximum(size, 1) / 8)).clip(0).astype(np.int64), *BUCKETS)
    base = np.concatenate(([0], np.cumsum(buckets)))
    at = np.repeat(base[:-1], size) + (h & np.repeat(buckets - 1, size).astype(np.uint64)).astype(np.int64)
    counts = np.minimum(np.bincount(at, minlength=base[-1]), 255).astype(np.uint8)
    return [counts[a:z].tobytes() for a, z in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]


def may_link(size: np.ndarray, counts: list[bytes], rule: Rule) -> np.ndarray:
    """Which of some sets may have a link among them: linked sets of a and b shingles differ in at most
    (a + b) * (den - num) / (den + num), and counts of buckets don't differ more. Of two numbers of
    buckets, both powers of two, the larger is folded to the smaller."""
    out = np.zeros(len(size), bool)
    width = np.array([len(c) for c in counts])
    for w in np.unique(width).tolist():
        among = np.flatnonzero(width >= w)
        folded = np.stack([np.minimum(np.frombuffer(counts[k], np.uint8).reshape(-1, w).sum(axis=0, dtype=np.int64), 255) for k in among.tolist()]).astype(np.int16)
        for k in np.flatnonzero(width[among] == w).tolist():
            apart = np.abs(folded - folded[k]).sum(axis=1, dtype=np.int64)
            near = apart * (rule.den + rule.num) <= (size[among] + size[among[k]]) * (rule.den - rule.num)
            near[k] = False
            if near.any():
                out[among[k]] = True
                out[among[near]] = True
    return out


def sets_of(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, txt, n_shingles, set_id and set_key, its first half (null for an empty set), and the
    counts of its buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_buffer(b.column("text"))
            n, ids, counts = [], [], []
            for i, j in row_chunks(offsets):
                h, bounds = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], rule.words)
                n += np.diff(bounds).tolist()
                counts += bucket_counts(h, bounds)
                ids += [set_id(h[a:z]) if z > a else None for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            keys = [x if x is None else short_id(x) for x in ids]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("txt"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(keys, pa.int64()), pa.array(counts, pa.binary())], ["doc_id", "txt", "n_shingles", "set_id", "set_key", "counts"])

    return docs.mapInArrow(run, "doc_id long, txt long, n_shingles long, set_id binary, set_key long, counts binary")


def packed_cells(docs: DataFrame, rule: Rule, n_parts: int) -> DataFrame:
    """part, keys, sets: the cells of all sets, packed by the part of the key space. A task sends
    an equal set once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            data, offsets = text_buffer(b.column("text"))
            every_key, every_set = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for i, j in row_chunks(offsets):
                h, bounds = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], rule.words)
                ids = np.array([short_id(set_id(h[a:z])) for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], np.int64)
                fresh = np.zeros(len(ids), bool)
                for k, x in enumerate(ids.tolist()):
                    if x not in seen:
                        seen.add(x)
                        fresh[k] = True
                keys, who = cell_keys(h, bounds, rule)
                keep = fresh[who]
                every_key.append(keys[keep])
                every_set.append(ids[who[keep]])
            if len(seen) > 1 << 20:
                seen.clear()
            keys, ids = np.concatenate(every_key), np.concatenate(every_set)
            part = (keys % np.uint64(n_parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            keys, ids = keys[order], ids[order]
            runs = runs_of(part[order])
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in runs], pa.int32()), pa.array([keys[a:z].tobytes() for _, a, z in runs], pa.binary()), pa.array([ids[a:z].tobytes() for _, a, z in runs], pa.binary())], ["part", "keys", "sets"])

    return docs.mapInArrow(run, "part int, keys binary, sets binary")


class Cells:
    """The cells of one part of the key space; hot ones are settled while they stream in."""

    def __init__(self, limit: int = HELD, hot: int = HOT_CELL) -> None:
        self.keys: list[np.ndarray] = []
        self.sets: list[np.ndarray] = []
        self.held, self.least, self.limit, self.hot = 0, limit, limit, hot
        self.hot_keys, self.hot_leads = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Members (set, leader) of settled cells."""
        out_s, out_p = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(self.hot_keys):
            at = np.minimum(np.searchsorted(self.hot_keys, keys), len(self.hot_keys) - 1)
            hot = self.hot_keys[at] == keys
            out_s, out_p = sets[hot], self.hot_leads[at[hot]]
            keys, sets = keys[~hot], sets[~hot]
        self.keys.append(keys)
        self.sets.append(sets)
        self.held += len(keys)
        if self.held > self.limit:
            s, p = self.settle(self.hot)
            out_s, out_p = np.concatenate((out_s, s)), np.concatenate((out_p, p))
            self.limit = max(self.least, 2 * self.held)  # what is cold is not sorted again at every turn
        return out_s, out_p

    def settle(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Members of cells with at least so many sets; the rest are held on."""
        if not self.keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, sets = np.concatenate(self.keys), np.concatenate(self.sets)
        order = np.lexsort((sets, keys))
        keys, sets = keys[order], sets[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (sets[1:] != sets[:-1])
        keys, sets = keys[new], sets[new]
        start = np.flatnonzero(np.concatenate((keys[:1] == keys[:1], keys[1:] != keys[:-1])))
        count = np.diff(np.append(start, len(keys)))
        big = count >= least
        taken = np.repeat(big, count)
        lead = np.repeat(sets[start], count)
        if least > 2:
            k, p = np.append(self.hot_keys, keys[start][big]), np.concatenate((self.hot_leads, sets[start][big]))
            order = np.argsort(k)
            self.hot_keys, self.hot_leads = k[order], p[order]
        self.keys, self.sets = [keys[~taken]], [sets[~taken]]
        self.held = int((~taken).sum())
        return sets[taken], lead[taken]


def region_members(cells: DataFrame, n_parts: int) -> DataFrame:
    """set_key, region: every set of every cell with two sets or more, leaders included."""

    def batch(sets: np.ndarray, leads: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((sets, leads))
        sets, leads = sets[order], leads[order]
        new = np.ones(len(sets), bool)
        new[1:] = (sets[1:] != sets[:-1]) | (leads[1:] != leads[:-1])
        return pa.RecordBatch.from_arrays([pa.array(sets[new], pa.int64()), pa.array(leads[new], pa.int64())], ["set_key", "region"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Cells()
        for b in batches:
            for keys, sets in zip(b.column("keys"), b.column("sets"), strict=True):
                s, p = held.add(np.frombuffer(keys.as_buffer(), np.uint64), np.frombuffer(sets.as_buffer(), np.int64))
                if len(s):
                    yield batch(s, p)
        yield batch(*held.settle(2))

    return cells.repartition(n_parts, "part").mapInArrow(run, "set_key long, region long")


def known_id() -> Column:
    """Ids for joins: rows without one have the least."""
    return F.coalesce("doc_id", F.lit(-(1 << 63)))


def fetch_sets(docs: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """set_key, set_id, hashes (binary) for wanted (set_key, set_id, doc, txt)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_buffer(b.column("text"))
            asked = b.column("set_id").to_pylist()
            ids, found = [], []
            for i, j in row_chunks(offsets):
                h, bounds = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], rule.words)
                for k in range(j - i):
                    own = h[bounds[k] : bounds[k + 1]]
                    if len(own) and set_id(own) == asked[i + k]:
                        ids.append(asked[i + k])
                        found.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(map(short_id, ids), pa.int64()), pa.array(ids, pa.binary()), pa.array(found, pa.binary())], ["set_key", "set_id", "hashes"])

    asked = docs.withColumn("doc", known_id()).join(wanted.hint("shuffle_hash"), ["doc", "txt"]).select("set_id", "text")
    return asked.mapInArrow(run, "set_key long, set_id binary, hashes binary").dropDuplicates(["set_id"])


# --- regions ------------------------------------------------------------------------------------


class Links:
    """Union-find over the sets of a region; keeps the links that joined something."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)
        self.members: dict[int, list[int]] = {i: [i] for i in range(n)}
        self.made: list[tuple[int, int]] = []

    def join(self, a: int, b: int, known: bool = False) -> None:
        x, y = int(self.label[a]), int(self.label[b])
        if x == y:
            return
        if len(self.members[x]) < len(self.members[y]):
            x, y = y, x
        moved = self.members.pop(y)
        self.members[x] += moved
        self.label[moved] = x
        if not known:
            self.made.append((a, b))


def distance_of(inter: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - inter / (a + b - inter)


def link_leaf(sets: list[np.ndarray], rule: Rule, mask: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links by which the leaf's connected sets are connected. mask: two entries with a bit in
    common need no comparison; the even ones of the levels' bits say that links made before connect
    them."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    start = np.concatenate(([0], np.cumsum(size)))
    _, token, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    flag = np.zeros(len(often), np.int32)
    links = Links(n)
    if mask is None:
        mask = np.zeros(n, np.int64)
    for bit in range(0, 2 * ROUNDS, 2):
        ball = np.flatnonzero(mask >> bit & 1).tolist()
        for k in ball[1:]:
            links.join(ball[0], k, known=True)

    def shared(with_: int, among: np.ndarray) -> np.ndarray:
        """Shingles that each of `among` shares with one set."""
        flag[token[start[with_] : start[with_ + 1]]] = 1
        m = size[among]
        run = np.concatenate(([0], np.cumsum(m)))
        at = np.arange(run[-1]) + np.repeat(start[among] - run[:-1], m)
        out = np.add.reduceat(flag[token[at]], run[:-1])
        flag[token[start[with_] : start[with_ + 1]]] = 0
        return out

    lead = 0
    inter = shared(lead, np.arange(n))
    distance = distance_of(inter, size, size[lead])
    ball = rule.linked(inter, size, size[lead])
    for k in np.flatnonzero(ball):
        links.join(lead, int(k))
    outside = np.flatnonzero(~ball)
    if not len(outside):
        return links.made
    # rarest shingles first: linked sets share one of the first |x| - least + 1
    prefix = size - rule.least_partner(size) + 1
    owner = np.repeat(np.arange(n), size)
    order = np.lexsort((token, often[token], owner))
    keep = np.arange(len(token)) - np.repeat(start[:-1], size) < np.repeat(prefix, size)
    t, o = token[order][keep], owner[order][keep]
    first = np.concatenate(([0], np.cumsum(prefix)))
    by = np.argsort(t, kind="stable")
    post, post_start = o[by], np.searchsorted(t[by], np.arange(len(often) + 1))
    window = 1 - rule.num / rule.den + 1e-9
    is_out = ~ball
    for y in outside[np.argsort(distance[outside], kind="stable")].tolist():
        mine = t[first[y] : first[y + 1]]
        mine = mine[post_start[mine + 1] - post_start[mine] > 1]
        if not len(mine):
            is_out[y] = False
            continue
        near = np.unique(np.concatenate([post[post_start[k] : post_start[k + 1]] for k in mine.tolist()]))
        near = near[(np.abs(distance[near] - distance[y]) <= window) & (links.label[near] != links.label[y]) & (mask[near] & mask[y] == 0)]
        near = near[(size[near] >= rule.least_partner(size[y])) & (size[y] >= rule.least_partner(size[near]))]
        near = near[ball[near] | is_out[near]]  # pairs of two outside the ball once
        is_out[y] = False
        near = near[np.argsort(np.abs(distance[near] - distance[y]), kind="stable")]
        while len(near):
            some, near = near[:256], near[256:]
            for x in some[rule.linked(shared(y, some), size[some], size[y])].tolist():
                links.join(y, x)
            near = near[links.label[near] != links.label[y]]
    return links.made


def merged(members: DataFrame) -> DataFrame:
    """members with each region merged into the first one that holds its leader; the first set of a
    region then leads it. Any renaming of regions keeps pairs together, so a few steps do."""
    for _ in range(MERGES):
        first = members.groupBy("set_key").agg(F.min("region").alias("to")).select(F.col("set_key").alias("region"), "to")
        members = members.join(first, "region").select("set_key", F.col("to").alias("region")).distinct()
    return members


def with_partners(members: DataFrame, points: DataFrame, rule: Rule, limits: Limits) -> DataFrame:
    """members (set_key, region) without the sets that can have no link in their region, by the counts
    of buckets; regions beyond a leaf stay as they are. points: set_key, n_shingles, counts."""
    wide = materialise(members.join(points.select("set_key", F.col("n_shingles").alias("size"), "counts"), "set_key").select("set_key", "region", "size", "counts"), "counted")
    sizes = wide.groupBy("region").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    large = bounded(materialise(sizes.where(~fits(limits)).select("region"), "large"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in by_key(batches, "region"):
            keep = may_link(held["size"].to_numpy(), held["counts"].to_pylist(), rule)
            if keep.any():
                sets = np.unique(held["set_key"].to_numpy()[keep])  # sets that share a key are one row
                yield pa.RecordBatch.from_arrays([pa.array(sets), held["region"].combine_chunks().slice(0, 1).take(pa.array(np.zeros(len(sets), np.int64)))], ["set_key", "region"])

    parts = parts_for(members.sparkSession, 0)
    small = wide.join(large, "region", "left_anti").repartition(parts, "region").sortWithinPartitions("region").select("set_key", "region", "size", "counts").mapInArrow(run, "set_key long, region long")
    return small.unionByName(members.join(large, "region", "left_semi").select("set_key", "region"))


ENTRY = ("region", "set_id", "mask", "hashes")
STEP = "parent binary, parent_n long, region binary, set_id binary, mask long, size long, u binary, v binary"
STEP_TYPES = [pa.int64() if x.endswith("long") else pa.binary() for x in STEP.split(", ")]


def divide(rule: Rule, level: int):  # noqa: ANN201
    """The work on a part of a region, held against the region's pivots: entries of the pivots'
    regions, and links to pivots. A region that drew no pivot stays as it is for another level."""
    reach = 2 * (1 - rule.num / rule.den) + 1e-9
    in_ball, replica = 1 << 2 * level, 1 << 2 * level + 1

    def run(_: tuple, entries: pa.Table, drawn: pa.Table) -> pa.Table:
        out: dict[str, list] = {c.split()[0]: [] for c in STEP.split(", ")}

        def put(*row: object) -> None:
            for c, x in zip(out.values(), row, strict=True):
                c.append(x)

        ids, masks, raw = (entries[c].to_pylist() for c in ("set_id", "mask", "hashes"))
        parent, n = (entries["region"][0].as_py(), entries["n"][0].as_py()) if ids else (b"", 0)
        pivots = sorted(zip(drawn["pivot"].to_pylist(), drawn["pivot_hashes"].to_pylist(), strict=True)) if ids else []
        if not pivots:
            for k, mask, h in zip(ids, masks, raw, strict=True):
                put(parent, n, parent, k, mask, len(h) // 8, None, None)
        else:
            size = np.array([len(h) // 8 for h in raw])
            flat = np.frombuffer(b"".join(raw), np.uint64)
            start = np.concatenate(([0], np.cumsum(size)))[:-1]
            distance, linked = np.empty((len(pivots), len(ids))), np.empty((len(pivots), len(ids)), bool)
            for j, (_, h) in enumerate(pivots):
                own = np.frombuffer(h, np.uint64)
                inter = shared_with(own, flat, start)
                distance[j], linked[j] = distance_of(inter, size, np.int64(len(own))), rule.linked(inter, size, np.int64(len(own)))
            nearest, least = distance.argmin(axis=0), distance.min(axis=0)
            for j, (pivot, _) in enumerate(pivots):
                child, own = hashlib.blake2b(parent + pivot, digest_size=16).digest(), nearest == j
                for k in np.flatnonzero(own | ((j < nearest) & (distance[j] - least <= reach))).tolist():
                    put(parent, n, child, ids[k], masks[k] | in_ball * bool(linked[j, k]) | replica * (not own[k]), len(raw[k]) // 8, None, None)
                for k in np.flatnonzero(linked[j]).tolist():
                    if ids[k] != pivot:
                        put(None, None, None, None, None, None, ids[k], pivot)
        return pa.table({c: pa.array(x, t) for (c, x), t in zip(out.items(), STEP_TYPES, strict=True)})

    return run


def block_of(n_blocks: Column) -> Column:
    return F.pmod(F.xxhash64("set_id"), n_blocks).cast("int")


def named(part: Column) -> Column:
    return F.concat("region", F.encode(part.cast("string"), "utf-8")).alias("region")


def in_parts(entries: DataFrame, limits: Limits) -> DataFrame:
    """Entries of regions in which all but a few share a bit: these few with every part of the rest.
    entries: also bit, and together (how many have it)."""
    parts = F.ceil(2 * F.col("together") / limits.sets).cast("int")
    wide = entries.withColumn("parts", parts).withColumn("has", F.expr("shiftright(mask, bit) & 1") == 1)
    at = F.when(F.col("has"), F.array(block_of(F.col("parts")))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    mask = F.when(~F.col("has") & (F.col("part") > 0), F.col("mask").bitwiseOR(F.lit(DEALT))).otherwise(F.col("mask"))
    return wide.withColumn("part", F.explode(at)).select(named(F.col("part")), "set_id", mask.alias("mask"), "hashes")


COVER = "region binary, set_id binary, balls long, keys array<long>, u binary, v binary, together long"
COVER_TYPES = [pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64()]


def joined_bits(found: list[int]) -> list[int]:
    """Bit sets, those that have a bit in common made one."""
    out: list[int] = []
    for x in found:
        apart = []
        for y in out:
            if x & y:
                x |= y
            else:
                apart.append(y)
        out = [*apart, x]
    return out


def rarest(flat: np.ndarray, size: np.ndarray, often: np.ndarray, times: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Of several sets, of which `flat` is the concatenation, the first |x| - least + 1 shingles by
    how many times the pivots have them, then by hash, and their sets: linked sets share one, as they
    do under any order. often, times: the pivots' shingles, sorted, and how many have each."""
    count = np.zeros(len(flat), np.int64)
    if len(often):
        at = np.minimum(np.searchsorted(often, flat), len(often) - 1)
        count = np.where(often[at] == flat, times[at], 0)
    owner = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((flat, np.where(count > 1, count, 0), owner))
    start = np.concatenate(([0], np.cumsum(size)))[:-1]
    keep = np.arange(len(flat)) - np.repeat(start, size) < np.repeat(size - rule.least_partner(size) + 1, size)
    return flat[order][keep], owner[keep]


def cover(rule: Rule):  # noqa: ANN201
    """The work on a part of a region that pivots don't divide: links to all pivots within r, the
    entries with the pivots they are linked to as bits and with their rarest shingles, and which
    pivots are connected."""

    def run(_: tuple, entries: pa.Table, drawn: pa.Table) -> pa.Table:
        out: dict[str, list] = {c.split()[0]: [] for c in COVER.split(", ")}

        def put(*row: object) -> None:
            for c, x in zip(out.values(), row, strict=True):
                c.append(x)

        rows = list(zip(*(entries[c].to_pylist() for c in ("region", "set_id", "hashes")), strict=True))
        pivots = sorted(zip(drawn["pivot"].to_pylist(), drawn["pivot_hashes"].to_pylist(), strict=True))[:PIVOT_BITS] if rows else []
        balls = np.zeros(len(rows), np.int64)
        size = np.array([len(h) // 8 for _, _, h in rows], np.int64)
        flat = np.frombuffer(b"".join(h for _, _, h in rows), np.uint64)
        often, times = np.unique(np.frombuffer(b"".join(h for _, h in pivots), np.uint64), return_counts=True)
        keys, owner = rarest(flat, size, often, times, rule)
        ends = np.searchsorted(owner, np.arange(len(rows) + 1)).tolist()
        keys = keys.view(np.int64)
        if pivots:
            start = np.concatenate(([0], np.cumsum(size)))[:-1]
            for j, (pivot, h) in enumerate(pivots):
                linked = rule.linked(shared_with(np.frombuffer(h, np.uint64), flat, start), size, np.int64(len(h) // 8))
                balls |= linked.astype(np.int64) << j
                for k in np.flatnonzero(linked).tolist():
                    if rows[k][1] != pivot:
                        put(None, None, None, None, rows[k][1], pivot, None)
        for k, ((region, own, _), x) in enumerate(zip(rows, balls.tolist(), strict=True)):
            put(region, own, x, keys[ends[k] : ends[k + 1]], None, None, None)
        for x in joined_bits(np.unique(balls[balls > 0]).tolist()):
            put(rows[0][0], None, None, None, None, None, x)
        return pa.table({c: pa.array(x, t) for (c, x), t in zip(out.items(), COVER_TYPES, strict=True)})

    return run


def main_bits(_: tuple, found: pa.Table) -> pa.Table:
    """Of a region the connected pivots with the most of them."""
    best = max(joined_bits(found["together"].to_pylist()), key=lambda x: (x.bit_count(), -x))
    return pa.table({"region": found["region"].slice(0, 1), "main": pa.array([best], pa.int64())})


def undivided(entries: DataFrame, rule: Rule, limits: Limits, level: int) -> tuple[DataFrame, DataFrame, set[str]]:
    """Regions that pivots don't divide: smaller ones in their place by fate, links, and the fates
    there are. Links to some dozens of pivots connect most of a family; sets so connected get a bit.
    Then sets that share one of their rarest shingles form cells, and cells regions, as documents did
    at first; cells of connected sets alone go. entries: also n and shingles."""
    made = materialise(with_pivots(entries, cover(rule), limits, PIVOT_BITS * 2 // 3, ROUNDS + level, COVER), "cover")
    main = made.where("together is not null").select("region", "together").distinct().groupBy("region").applyInArrow(main_bits, "region binary, main long")
    covered = (F.col("balls").bitwiseAND(F.coalesce("main", F.lit(0).cast("long"))) != 0).alias("covered")
    key = F.xxhash64("region", "set_id").alias("set_key")
    known = made.where("set_id is not null").join(bounded(materialise(main, "main")), "region", "left").select("region", "set_id", key, covered, "keys")
    cells = known.select("region", "set_key", "covered", F.explode("keys").alias("cell"))
    led = cells.groupBy("region", "cell").agg(F.min("set_key").alias("lead"), F.count("*").alias("n"), F.bool_and("covered").alias("all")).where("n > 1 and not all")
    salt = F.pmod(F.col("set_key"), F.lit(SALTS)).cast("int").alias("salt")
    leads = led.select("region", "cell", "lead", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    members = materialise(cells.select("region", "cell", "set_key", salt).join(leads, ["region", "cell", "salt"]).select("set_key", F.col("lead").alias("region")).distinct(), "members")
    members = members if members.isEmpty() else materialise(merged(members), "merged")
    mask = F.when(F.col("covered"), F.col("mask").bitwiseOR(F.lit(1 << 2 * level))).otherwise(F.col("mask")).alias("mask")
    wide = entries.select(*ENTRY, F.col("n").alias("parent_n")).join(known.select("region", "set_id", "set_key", "covered"), ["region", "set_id"])
    wide = wide.drop("region").join(members.select("set_key", F.encode(F.col("region").cast("string"), "utf-8").alias("region")), "set_key")
    counts = members.withColumn("region", F.encode(F.col("region").cast("string"), "utf-8")).join(entries.select(key, F.col("n").alias("parent_n"), (F.length("hashes") / 8).cast("long").alias("size")), "set_key")
    counts = counts.groupBy("region").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"), F.max("parent_n").alias("parent_n"))
    fate = F.when(fits(limits), "leaf").when((F.col("n") > limits.shrink * F.col("parent_n")) | (F.lit(level) >= ROUNDS - 1), "last").otherwise("open")
    counts = materialise(counts.select("region", "n", "shingles", fate.alias("fate")), "counts")
    there = fates_in(counts)
    after = materialise(wide.select("region", "set_id", mask, "hashes").join(bounded(counts), "region"), "entries", by="fate")
    return after, made.where("u is not null").select("u", "v"), there


def in_blocks(entries: DataFrame, limits: Limits, level: int) -> DataFrame:
    """Leaves of a region that nothing divides: sets that links connect (by the level's bit) in
    blocks, each with every block of the others, and these in pairs of blocks."""
    covered = F.expr(f"shiftright(mask, {2 * level}) & 1") == 1
    known = entries.select("region", "set_id", "mask", "n", "shingles", covered.alias("covered"))
    # as many sets in a block as make half a leaf
    each = F.greatest(F.lit(1), F.least(F.lit(limits.sets // 2), F.floor(F.lit(limits.shingles / 2) * F.max("n") / F.max("shingles"))))
    blocks = lambda of: F.ceil(F.sum(F.when(of, 1).otherwise(0)) / each).cast("int")
    counts = known.groupBy("region").agg(blocks(F.col("covered")).alias("n_c"), blocks(~F.col("covered")).alias("n_u"))
    wide = known.join(bounded(materialise(counts, "blocks")), "region").where("n_u > 0")
    wide = wide.withColumn("own", F.when(F.col("covered"), block_of(F.col("n_c"))).otherwise(block_of(F.col("n_u"))))
    numbers = lambda n: F.sequence(F.lit(0), n - 1)
    first = wide.where("not covered").withColumn("other", F.explode(numbers(F.col("n_u"))))
    side = F.when(F.col("own") < F.col("other"), F.lit(DEALT)).when(F.col("own") > F.col("other"), F.lit(OTHER)).otherwise(F.lit(0).cast("long"))
    pair = F.concat_ws("-", F.least("own", "other").cast("string"), F.greatest("own", "other").cast("string"))
    rest = first.select("region", named(pair).alias("to"), "set_id", F.col("mask").bitwiseOR(side).alias("mask"))
    across = wide.where("n_c > 0").withColumn("other", F.explode(numbers(F.when(F.col("covered"), F.col("n_u")).otherwise(F.col("n_c")))))
    pair = F.concat_ws("+", *(F.when(F.col("covered"), x).otherwise(y).cast("string") for x, y in ((F.col("other"), F.col("own")), (F.col("own"), F.col("other")))))
    side = F.when(F.col("covered"), F.lit(0).cast("long")).otherwise(F.lit(DEALT))
    rest = rest.unionByName(across.select("region", named(pair).alias("to"), "set_id", F.col("mask").bitwiseOR(side).alias("mask")))
    return rest.join(entries.select("region", "set_id", "hashes"), ["region", "set_id"]).select(F.col("to").alias("region"), "set_id", "mask", "hashes")


def with_pivots(entries: DataFrame, work, limits: Limits, pivots: int, seed: int, schema: str) -> DataFrame:  # noqa: ANN001
    """Some work on the parts of regions, each held against about so many pivots of its region,
    drawn by a hash. entries: also n and shingles."""
    chunks = F.least("n", F.greatest(F.ceil(F.col("n") / (4 * limits.sets)), F.ceil(F.col("shingles") / (4 * limits.shingles)))).cast("int")
    rank = F.xxhash64("set_id", F.lit(seed)).bitwiseAND(F.lit((1 << 40) - 1))
    drawn = entries.where(rank < F.lit(pivots * float(1 << 40)) / F.col("n"))
    drawn = drawn.select(F.col("region").alias("of"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("part"), F.col("set_id").alias("pivot"), F.col("hashes").alias("pivot_hashes"))
    dealt = entries.select(*ENTRY, "n", "shingles", block_of(chunks).alias("chunk"))
    return dealt.groupBy("region", "chunk").cogroup(drawn.groupBy("of", "part")).applyInArrow(work, schema)


def shared_with(own: np.ndarray, flat: np.ndarray, start: np.ndarray) -> np.ndarray:
    """How many of `own`, sorted, each of several sets has, of which `flat` is the concatenation."""
    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    return np.add.reduceat((own[at] == flat).astype(np.int64), start)


def fates(children: DataFrame, level: int, limits: Limits) -> DataFrame:
    """What becomes of every new region: parent, region, n, shingles, bit, together, fate. A region
    where all have a bit is over; one that fits is a leaf; one where all but a few have a bit is
    dealt out in parts; others are divided again, unless their parent made too many copies or one
    child about as large as itself: then that parent is stuck."""
    bits = range(2 * level + 2)
    counted = children.groupBy("parent", "region").agg(
        F.max("parent_n").alias("parent_n"),
        F.count("*").alias("n"),
        F.sum("size").alias("shingles"),
        F.bit_and("mask").alias("all"),
        *(F.sum(F.expr(f"shiftright(mask, {b}) & 1")).alias(f"b{b}") for b in bits),
    )
    best = F.greatest(*(F.struct(F.col(f"b{b}").alias("together"), F.lit(b).alias("bit")) for b in bits))
    counted = counted.withColumn("best", best).select("parent", "parent_n", "region", "n", "shingles", "all", "best.together", "best.bit")
    few_apart = (F.col("together") > 0) & (F.col("n") > limits.sets) & (F.col("n") - F.col("together") <= limits.sets // 2)
    kind = F.when((F.col("all") != 0) | (F.col("n") < 2), "over").when(fits(limits), "leaf").when(few_apart, "parts").otherwise("open")
    siblings = Window.partitionBy("parent")
    copies = F.sum(F.when(F.col("kind") != "over", F.col("n"))).over(siblings)
    largest = F.max(F.when(F.col("kind") == "open", F.col("n"))).over(siblings)
    redrawn = (F.col("region") == F.col("parent")) & (F.lit(level) < ROUNDS - 1)  # it had no pivot
    stuck = ~redrawn & (F.coalesce(copies > limits.copies * F.col("parent_n"), F.lit(False)) | F.coalesce(largest > (limits.shrink if level < ROUNDS - 1 else 0) * F.col("parent_n"), F.lit(False)))
    return counted.withColumn("kind", kind).withColumn("fate", F.when(stuck, "stuck").otherwise(F.col("kind"))).select("parent", "region", "n", "shingles", "bit", "together", "fate")


def fates_in(known: DataFrame) -> set[str]:
    return set(known.agg(F.collect_set("fate")).first()[0])  # of half a dozen words


def fits(limits: Limits) -> Column:
    return (F.col("n") <= 2) | ((F.col("n") <= limits.sets) & (F.col("shingles") <= limits.shingles))


def divided(entries: DataFrame, rule: Rule, limits: Limits) -> tuple[list[DataFrame], list[DataFrame]]:
    """Leaves and links of large regions, by levels. entries: also n and shingles of the region."""
    leaves, links = [], []
    for level in range(ROUNDS):
        made = materialise(with_pivots(entries, divide(rule, level), limits, limits.pivots, level, STEP), "voronoi")
        links.append(made.where("u is not null").select("u", "v"))
        children = made.where("u is null")
        known = materialise(fates(children, level, limits), "fates")
        there, open_ = fates_in(known), []
        if "stuck" in there:
            again = known.where("fate = 'stuck'").select(F.col("parent").alias("region")).distinct()
            after, made_links, fates_ = undivided(entries.join(bounded(again), "region", "left_semi"), rule, limits, level)
            links.append(made_links)
            leaves.append(after.where("fate = 'leaf'").select(*ENTRY))
            if "last" in fates_:
                leaves.append(in_blocks(after.where("fate = 'last'"), limits, level))
            if "open" in fates_:
                open_.append(after.where("fate = 'open'").select(*ENTRY, "n", "shingles"))
        # by fate on disk, so that a later step reads its own alone
        alive = known.where("fate in ('leaf', 'parts', 'open')").drop("parent")
        if there & {"leaf", "parts", "open"}:
            stay = children.select("parent", "region", "set_id", "mask").join(bounded(alive), "region")
            held = entries.select(F.col("region").alias("parent"), "set_id", "hashes")
            after = materialise(stay.join(held, ["parent", "set_id"]).select(*ENTRY, "n", "shingles", "bit", "together", "fate"), "entries", by="fate")
            leaves.append(after.where("fate = 'leaf'").select(*ENTRY))
            if "parts" in there:
                leaves.append(in_parts(after.where("fate = 'parts'"), limits))
            if "open" in there:
                open_.append(after.where("fate = 'open'").select(*ENTRY, "n", "shingles"))
        if not open_:
            break
        entries = reduce(DataFrame.unionByName, open_)
    return leaves, links


def region_links(members: DataFrame, sets: DataFrame, rule: Rule, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """u, v: links between sets that connect all connected sets. members: set_key, region; sets:
    set_key, set_id, hashes."""
    size = sets.select("set_key", (F.length("hashes") / 8).cast("long").alias("size"))
    members = members.withColumn("region", F.encode(F.col("region").cast("string"), "utf-8"))
    sized = materialise(members.join(size, "set_key").groupBy("region").agg(F.count("*").alias("n"), F.sum("size").alias("shingles")), "regions")
    with_sets = members.withColumn("mask", F.lit(0).cast("long")).join(sets, "set_key")
    large, leaves, links = sized.where(~fits(limits)), [], []
    if large.isEmpty():
        leaves = [with_sets.select(*ENTRY)]
    else:
        large = bounded(large)
        leaves, links = divided(materialise(with_sets.join(large, "region").select(*ENTRY, "n", "shingles"), "entries"), rule, limits)
        leaves.append(with_sets.join(large, "region", "left_anti").select(*ENTRY))
    total = sized.agg(F.sum(F.col("shingles") * 8)).first()[0] or 0
    rows = reduce(DataFrame.unionByName, leaves).repartition(parts_for(members.sparkSession, total), "region").sortWithinPartitions("region", "set_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in by_key(batches, "region"):
            ids, found = held["set_id"].to_pylist(), held["hashes"].to_pylist()
            if len(ids) < 2:
                continue
            made = link_leaf([np.frombuffer(h, np.uint64) for h in found], rule, held["mask"].to_numpy())
            if made:
                yield pa.RecordBatch.from_arrays([pa.array([ids[a] for a, _ in made], pa.binary()), pa.array([ids[z] for _, z in made], pa.binary())], ["u", "v"])

    return reduce(DataFrame.unionByName, [rows.mapInArrow(run, "u binary, v binary"), *links])


def row_key() -> Column:
    """Rows are told apart by id and text, as ids may repeat or be missing; those without come last."""
    return F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "txt")


def rows_and_firsts(docs: DataFrame, rule: Rule, id_col: str, text_col: str, limits: Limits) -> tuple[DataFrame, DataFrame]:
    """Every row's doc_id, txt, n_shingles, set_id, and every set's set_id and `first`, the key of
    the first row that links reach."""
    read = id_and_text(docs, id_col, text_col).withColumn("txt", F.xxhash64("text"))
    known = materialise(sets_of(read, rule), "sets")
    shingles = known.agg(F.sum("n_shingles")).first()[0] or 0
    n_parts = parts_for(docs.sparkSession, 8 * shingles)
    members = materialise(merged(materialise(region_members(packed_cells(read, rule, n_parts), n_parts), "cells").distinct()), "members")
    points = known.where("set_id is not null").groupBy("set_id", "set_key").agg(F.min(row_key()).alias("first"))
    counted = known.where("set_id is not null").join(members.select("set_key").distinct(), "set_key", "left_semi").dropDuplicates(["set_id"])
    members = materialise(with_partners(members, counted, rule, limits), "partners")
    one = points.select("set_id", "set_key", "first.doc_id", "first.txt")
    wanted = one.select("set_key", "set_id", known_id().alias("doc"), "txt").join(members.select("set_key").distinct(), "set_key", "left_semi")
    sets = materialise(fetch_sets(read, wanted, rule), "shingles")
    links = region_links(members, sets, rule, limits)
    roots = components(links).withColumnsRenamed({"node": "set_id"})
    named = points.join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    lowest = named.join(roots.select("root").distinct(), "root", "left_semi").groupBy("root").agg(F.min("first").alias("low"))
    return known, named.join(lowest, "root", "left").select("set_id", F.coalesce("low", "first").alias("first"))


def jaccard_components(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """doc_id, n_shingles, component_id (the smallest id that links reach) for every row."""
    known, firsts = rows_and_firsts(docs, rule, id_col, text_col, limits)
    return known.join(firsts, "set_id", "left").select("doc_id", "n_shingles", F.coalesce("first.doc_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """The first row of each component, with all its columns: the one with the smallest id, and of
    several with that id, or of rows without ids alone, the one with the smallest hash of its text.
    Rows without words all stay."""
    known, firsts = rows_and_firsts(docs, rule, id_col, text_col, limits)
    lost = ~row_key().eqNullSafe(F.col("first"))
    keys = known.join(firsts, "set_id").groupBy(F.col("doc_id").alias("__doc"), F.col("txt").alias("__hash")).agg(F.bool_or(lost).alias("lost"), F.count("*").alias("n"))
    keys = materialise(keys.where("lost or n > 1"), "drop")
    own_id, own_text = free_names(docs, "__id", "__txt")
    keyed = docs.withColumns({own_id: F.col(id_col).cast("long"), own_text: F.xxhash64(F.col(text_col).cast("string"))})
    keys = keys.toDF(*free_names(keyed, *keys.columns))
    doc, txt, lost, _ = (keys[c] for c in keys.columns)
    same = keyed[own_id].eqNullSafe(doc) & (keyed[own_text] == txt)
    kept = keyed.join(keys.hint("shuffle_hash"), same, "left_anti")
    again = keys.where(~lost)
    if not again.isEmpty():  # rows alike in id and text, of which one stays
        kept = kept.unionByName(keyed.join(again.hint("shuffle_hash"), same, "left_semi").dropDuplicates([own_id, own_text]))
    return kept.select(*docs.columns)
