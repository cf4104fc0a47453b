"""Near-duplicates by a chosen-path similarity join of minwise tokens, and their components.

A text's set of shingles has minwise tokens, each the least of the set under another hash: two sets
agree in one with the probability of their Jaccard similarity. The root of every tree selects one
token, and documents that agree in it go to the same child. A small node is compared exhaustively; a
large one selects `branch` more tokens of the pool by a hash of its path, and documents go on to the
children of these, where unrelated ones part. A pair linked at the threshold stays together in one
tree, however deep, with a probability of about 0.82 (a branching process with `branch` children,
each lost with 0.15), so twelve independent trees miss it with one of about 10^-9, and any pair more
alike with less.

Small nodes: sizes and two bits of each token of the pool are held against each other for all pairs
of the node (linked sets differ in more than `apart` bits with a probability below 10^-9). What so
resembles each other, however indirectly, is a group; trees mostly find the same groups, and each is
kept once. A group's full sets are then intersected, all pairs at once, and only links that connect
something leave the task.

Large nodes: documents go down to the children. Before that, where many resemble one document of the
node, links to it connect most copies; a node whose documents are all connected is over, and one with
few documents apart is cut into parts, each with these few. What is still large after the deepest level is cut into
blocks, and all pairs of blocks are nodes. So no pair of a node is left out.

Equal sets are one point from the start; rows are joined to their set at the end.

Cases: a null or empty text has no words, an empty set, no link, and is its own component; fewer
words than a shingle takes make one shingle. A row without an id has the smallest id that its links
reach, else none, and is kept only then. Ties and repeated rows are equal sets, an empty table gives
no rows, columns other than the id and the text are ignored; a very long text is one set.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, bounded, by_key, id_and_text, materialise, mix64, parts_for, row_chunks, text_buffer
from .components import components
from .jaccard import Rule, fetch_sets, known_id, row_key, set_id, shingle_sets, short_id


@dataclass(frozen=True)
class Search:
    """Trees; tokens that a large node selects; documents and shingles of a small node; levels of a
    tree; bits of 256 in which linked sets may differ."""

    trees: int = 12
    branch: int = 2
    small: int = 4096
    shingles: int = 1 << 22
    depth: int = 8
    apart: int = 52


POOL = 128
SKETCH = ["b0", "b1", "b2", "b3"]
NODE = "node long, set_id binary, n int, b0 long, b1 long, b2 long, b3 long"


def hash_seeds(count: int) -> tuple[np.ndarray, np.ndarray]:
    """A shift and an odd factor for each of so many orders of the shingles."""
    x = mix64(np.arange(1, 2 * count + 1, dtype=np.uint64) * GOLDEN)
    return x[:count], x[count:] | np.uint64(1)


def minwise(hashes: np.ndarray, bounds: np.ndarray, seeds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least hash of every non-empty set in every order: a row an order."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.zeros((len(seeds[0]), len(starts)), np.uint64)
    for row, shift, factor in zip(out, *seeds, strict=True):
        if len(starts):
            row[:] = np.minimum.reduceat((hashes + shift) * factor, starts)
    return mix64(out)


def sketches(docs: DataFrame, rule: Rule, search: Search) -> DataFrame:
    """doc_id, txt, n, set_id, set_key, roots (of the trees), the sketch's bits, and tokens of the pool,
    16 bits each; nulls for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = hash_seeds(search.trees + POOL)
        for b in batches:
            data, offsets = text_buffer(b.column("text"))
            for i, j in row_chunks(offsets):
                h, bounds = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], rule.words)
                least = minwise(h, bounds, seeds)
                size = np.diff(bounds)
                full = size > 0
                at = np.where(full, np.cumsum(full) - 1, 0)
                ids = [set_id(h[a:z]) if z > a else None for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                pool = np.ascontiguousarray(least[search.trees :].T)
                low = np.packbits(((pool[:, :, None] >> np.arange(2, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).reshape(len(pool), 2 * POOL), axis=1)
                words = np.ascontiguousarray(low).view(np.int64)
                tokens = (pool >> np.uint64(48)).astype(np.uint16)
                roots = np.ascontiguousarray(least[: search.trees].T).view(np.int64)
                pick = lambda rows, kind: pa.array([r if f else None for r, f in zip((rows[k] for k in at), full, strict=True)] if len(rows) else [None] * len(at), kind)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(i, j - i),
                        b.column("txt").slice(i, j - i),
                        pa.array(size.astype(np.int32)),
                        pa.array(ids, pa.binary()),
                        pa.array([None if x is None else short_id(x) for x in ids], pa.int64()),
                        pick(roots.tolist(), pa.list_(pa.int64())),
                        *(pick(words[:, k].tolist() if len(words) else [], pa.int64()) for k in range(4)),
                        pick([t.tobytes() for t in tokens], pa.binary()),
                    ],
                    ["doc_id", "txt", "n", "set_id", "set_key", "roots", *SKETCH, "tokens"],
                )

    return docs.mapInArrow(run, "doc_id long, txt long, n int, set_id binary, set_key long, roots array<long>, b0 long, b1 long, b2 long, b3 long, tokens binary")


def alike(size: np.ndarray, bits: np.ndarray, k: int, others: np.ndarray | slice, rule: Rule, search: Search) -> np.ndarray:
    """Which of the others one document may be linked with."""
    least = np.minimum(size[others], size[k]).astype(np.int64)
    most = np.maximum(size[others], size[k]).astype(np.int64)
    differ = np.bitwise_count(bits[others] ^ bits[k]).sum(axis=1, dtype=np.int64)
    return (rule.den * least >= rule.num * most) & (differ <= search.apart)


def numbers_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return t["n"].to_numpy(), np.stack([t[c].to_numpy() for c in SKETCH], axis=1).view(np.uint64)


def nodes_of(batches: Iterator[pa.RecordBatch], search: Search) -> Iterator[tuple[pa.Table, bool]]:
    """Rows sorted by node: some whole small nodes together, or a part of a large one, which is True."""
    held: pa.Table | None = None
    large: int | None = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([held, t]) if held is not None else t
        held = None
        node = t["node"].to_numpy()
        if large is not None:
            more = int(np.searchsorted(node, large, side="right"))
            if more:
                yield t.slice(0, more), True
                t, node = t.slice(more), node[more:]
            if not len(node):
                continue
            large = None
        cut = int(np.searchsorted(node, node[-1], side="left"))
        yield from _split(t.slice(0, cut), search)
        held = t.slice(cut)
        if _is_large(np.array([held.num_rows]), np.array([held["n"].to_numpy().sum()]), search)[0]:
            yield held, True
            held, large = None, int(node[-1])
    if held is not None:
        yield from _split(held, search)


def _is_large(rows: np.ndarray, shingles: np.ndarray, search: Search) -> np.ndarray:
    return (rows > 2) & ((rows > search.small) | (shingles > search.shingles))


def _split(t: pa.Table, search: Search) -> Iterator[tuple[pa.Table, bool]]:
    """Whole nodes: those of one row go, large ones alone, the others together."""
    node = t["node"].to_numpy()
    if not len(node):
        return
    start = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
    count = np.diff(np.append(start, len(node)))
    large = _is_large(count, np.add.reduceat(t["n"].to_numpy().astype(np.int64), start), search)
    several = np.repeat((count > 1) & ~large, count)
    if several.any():
        yield t.filter(pa.array(several)), False
    for a, n in zip(start[large].tolist(), count[large].tolist(), strict=True):
        yield t.slice(a, n), True


def bounds_of(node: np.ndarray) -> list[tuple[int, int]]:
    start = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
    return list(zip(start.tolist(), np.append(start[1:], len(node)).tolist(), strict=True))


def reached(a: int, z: int, near) -> list[list[int]]:  # noqa: ANN001
    """Groups of two or more of the rows a to z that `near` (which of a to z a row is near) connects."""
    free, groups = np.ones(z - a, bool), []
    while free.any():
        queue = [int(free.argmax())]
        free[queue[0]] = False
        for k in queue:
            if not free.any():
                break
            new = np.flatnonzero(near(a + k) & free)
            free[new] = False
            queue += new.tolist()
        if len(queue) > 1:
            groups.append(sorted(a + k for k in queue))
    return groups


def compared(entries: DataFrame, rule: Rule, search: Search, n_parts: int) -> DataFrame:
    """Rows of small nodes in groups that resemble each other, node being the group's name, and all
    rows of large nodes; hub is the document of a large node that a row resembles."""

    def ended(t: pa.Table, node: pa.Array, hub: list[bytes | None], large: bool) -> list[pa.RecordBatch]:
        kept = ["set_id", "n", *SKETCH]
        return pa.table([node, *(t[c] for c in kept), pa.array(hub, pa.binary()), pa.array(np.full(len(hub), large))], ["node", *kept, "hub", "large"]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: tuple | None = None
        for t, large in nodes_of(batches, search):
            size, bits = numbers_of(t)
            ids = t["set_id"].to_pylist()
            if large:
                # the first row of the node leads all of it, also parts that come later
                node = t["node"][0].as_py()
                if first is None or first[0] != node:
                    first = (node, ids[0], size[0], bits[0])
                near = alike(np.append(size, first[2]), np.append(bits, first[3][None], axis=0), len(ids), slice(0, len(ids)), rule, search)
                hub = [first[1] if x and i != first[1] else None for i, x in zip(ids, near.tolist(), strict=True)]
                yield from ended(t, t["node"], hub, True)
                continue
            rows, names = [], []
            for a, z in bounds_of(t["node"].to_numpy()):
                for group in reached(a, z, lambda k, a=a, z=z: alike(size, bits, k, slice(a, z), rule, search)):
                    rows += group
                    names += [short_id(hashlib.blake2b(b"".join(ids[k] for k in group), digest_size=8).digest())] * len(group)
            if rows:
                yield from ended(t.take(pa.array(rows)), pa.array(names, pa.int64()), [None] * len(rows), False)

    rows = entries.repartition(n_parts, "node").sortWithinPartitions("node", "set_id")
    return rows.mapInArrow(run, NODE + ", hub binary, large boolean")


def common_shingles(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets share. Shingles of many sets are multiplied as columns of a
    matrix, those of few sets are met pair by pair."""
    m = len(sets)
    own = np.repeat(np.arange(m), [len(x) for x in sets])
    names, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros((m, m), np.float32)
    dense = often > max(m // 16, 8)
    place = np.cumsum(dense) - 1
    many = dense[column]
    if many.any():
        for lo in range(0, int(dense.sum()), 1024):
            at = many & (place[column] >= lo) & (place[column] < lo + 1024)
            x = np.zeros((m, min(1024, int(dense.sum()) - lo)), np.float32)
            x[own[at], place[column[at]] - lo] = 1
            out += x @ x.T
    few = ~many & (often[column] > 1)
    order = np.lexsort((own[few], column[few]))
    who, what = own[few][order], column[few][order]
    flat = out.ravel()
    for step in range(1, len(who)):
        same = np.flatnonzero(what[step:] == what[:-step])
        if not len(same):
            break
        x, y = who[same], who[same + step]
        np.add.at(flat, x * m + y, 1)
        np.add.at(flat, y * m + x, 1)
    out[np.arange(m), np.arange(m)] = [len(x) for x in sets]
    return out  # whole numbers, of which single precision holds as many as a node has shingles


def group_links(groups: DataFrame, sets: DataFrame, rule: Rule, n_parts: int) -> DataFrame:
    """u, v: links inside groups (node, set_id), by the full sets, enough to connect what they connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_key(batches, "node"):
            ids = t["set_id"].to_pylist()
            found = [np.frombuffer(h, np.uint64) for h in t["hashes"].to_pylist()]
            if len(ids) < 2:
                continue
            size = np.array([len(x) for x in found])
            common = common_shingles(found)
            made, free = [], np.ones(len(ids), bool)
            while free.any():
                queue = [int(free.argmax())]
                free[queue[0]] = False
                for k in queue:
                    new = np.flatnonzero(rule.linked(common[k].astype(np.int64), size[k], size) & free).tolist()
                    free[new] = False
                    queue += new
                    made += [(ids[k], ids[x]) for x in new]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*made, strict=True)], ["u", "v"])

    rows = groups.join(sets, "set_id").select("node", "set_id", "hashes").repartition(n_parts, "node").sortWithinPartitions("node")
    return rows.mapInArrow(run, "u binary, v binary").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs that are linked, by their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [np.frombuffer(h, np.uint64) for h in b.column("hu").to_pylist()]
            y = [np.frombuffer(h, np.uint64) for h in b.column("hv").to_pylist()]
            both = np.array([len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(x, y, strict=True)], np.int64)
            linked = rule.linked(both, np.array([len(p) for p in x], np.int64), np.array([len(q) for q in y], np.int64))
            yield from pa.Table.from_batches([b.select(["u", "v"])]).filter(pa.array(linked)).to_batches()

    found = pairs.join(sets.select(F.col("set_id").alias("u"), F.col("hashes").alias("hu")), "u")
    return found.join(sets.select(F.col("set_id").alias("v"), F.col("hashes").alias("hv")), "v").mapInArrow(run, "u binary, v binary")


def children(entries: DataFrame, points: DataFrame, search: Search) -> DataFrame:
    """Documents of large nodes in the children of the tokens that the node selects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            node = b.column("node").to_numpy().view(np.uint64)
            tokens = np.frombuffer(b"".join(b.column("tokens").to_pylist()), np.uint16).reshape(-1, POOL)
            drawn = mix64(node ^ GOLDEN)
            start, step = drawn % np.uint64(POOL), (drawn >> np.uint64(32)) % np.uint64(POOL // 2) * np.uint64(2) + np.uint64(1)
            for k in range(search.branch):
                at = ((start + np.uint64(k) * step) % np.uint64(POOL)).astype(np.int64)
                token = tokens[np.arange(len(tokens)), at].astype(np.uint64)
                child = mix64(node * GOLDEN + (at.astype(np.uint64) << np.uint64(16)) + token + np.uint64(1))
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), *(b.column(c) for c in ("set_id", "n", *SKETCH))], NODE.replace(" long", "").replace(" binary", "").replace(" int", "").split(", "))

    return entries.join(points.select("set_id", "tokens"), "set_id").select("node", "set_id", "n", *SKETCH, "tokens").mapInArrow(run, NODE)


def _cut(of: Column, share: int, search: Search) -> Column:
    """Parts of the rows that `of` says, so that each is such a share of a small node."""
    rows, shingles = F.sum(of.cast("int")), F.sum(F.when(of, F.col("n")).otherwise(0).cast("long"))
    return F.greatest(F.ceil(rows * share / search.small), F.ceil(shingles * share / search.shingles), F.lit(1)).cast("int")


def by_blocks(entries: DataFrame, search: Search) -> DataFrame:
    """Large nodes as nodes of two blocks each, all pairs of them."""
    blocks = entries.groupBy("node").agg(_cut(F.lit(True), 3, search).alias("blocks"))
    own = F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")
    dealt = entries.join(blocks, "node").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("node", F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other"))).select("node", "set_id", "n", *SKETCH)


def in_parts(entries: DataFrame, search: Search) -> DataFrame:
    """Large nodes in which few documents stand apart from the connected ones: parts of these, each
    with all of the few. entries: also main, whether a document is one of the connected."""
    parts = entries.groupBy("node").agg(_cut(F.col("main"), 3, search).alias("parts"))
    own = F.array(F.pmod(F.xxhash64("set_id"), F.col("parts")).cast("int"))
    dealt = entries.join(parts, "node").withColumn("part", F.explode(F.when(F.col("main"), own).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    return dealt.withColumn("node", F.xxhash64("node", "part")).select("node", "set_id", "n", *SKETCH)


def unconnected(alive: DataFrame, links: list[DataFrame], search: Search) -> DataFrame:
    """Rows of nodes that links have not connected: also main, whether the row is of the node's largest
    connected part, and few, whether no more than a third of a small node is not."""
    roots = components(reduce(DataFrame.unionByName, links)).withColumnsRenamed({"node": "set_id"}).select("set_id", F.xxhash64("root").alias("root"))
    named = materialise(alive.join(roots, "set_id", "left").select("node", "set_id", "n", *SKETCH, F.coalesce("root", F.xxhash64("set_id")).alias("label")), "labels")
    counts = named.groupBy("node", "label").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"))
    largest = F.max(F.struct("rows", "shingles", "label"))
    nodes = counts.groupBy("node").agg(largest.alias("top"), (F.sum("rows") - F.max("rows")).alias("apart"), (F.sum("shingles") - largest["shingles"]).alias("apart_shingles")).where("apart > 0")
    few = (F.col("apart") <= search.small // 3) & (F.col("apart_shingles") <= search.shingles // 3)
    nodes = nodes.select("node", F.col("top.label").alias("main_label"), few.alias("few"))
    return materialise(named.join(nodes, "node").select("node", "set_id", "n", *SKETCH, (F.col("label") == F.col("main_label")).alias("main"), "few"), "open")


def near_links(read: DataFrame, points: DataFrame, rule: Rule, search: Search) -> list[DataFrame]:
    """u, v: links between sets, enough to connect all that the trees find. read: doc_id, txt, text."""
    spark = read.sparkSession
    one = points.select("set_id", "set_key", "first.doc_id", "first.txt").select("set_id", "set_key", known_id().alias("doc"), "txt")
    entries = points.select("set_id", "n", *SKETCH, F.posexplode("roots").alias("tree", "root")).select(F.xxhash64("tree", "root").alias("node"), "set_id", "n", *SKETCH)
    rows, shingles = points.agg(F.count("*"), F.sum("n")).first()
    n_parts, n_leaves = parts_for(spark, rows * search.trees * 64), parts_for(spark, 8 * (shingles or 0))
    sets: list[DataFrame] = []
    links: list[DataFrame] = []
    for level in range(search.depth + 2):
        whole = replace(search, small=1 << 62, shingles=1 << 62) if level > search.depth else search
        alive = materialise(compared(entries, rule, whole, n_parts), "alive")
        groups = alive.where("not large").select("node", "set_id").distinct()
        large = alive.where("large")
        # a node is tight where a quarter of it resembles one document; only there links are looked for
        # before it is divided, as elsewhere few are connected
        tight = large.groupBy("node").agg((4 * F.count("hub") >= F.count("*")).alias("tight"))
        large = materialise(large.join(tight, "node"), "large")
        kinds = {r["tight"] for r in large.select("tight").distinct().collect()}
        hubs = large.where("tight and hub is not null").select(F.least("set_id", "hub").alias("u"), F.greatest("set_id", "hub").alias("v")).distinct()
        wanted = groups.select("set_id").union(hubs.select("u")).union(hubs.select("v")).distinct()
        if sets:
            wanted = wanted.join(reduce(DataFrame.unionByName, sets).select("set_id"), "set_id", "left_anti")
        asked = materialise(one.join(wanted, "set_id", "left_semi"), "asked")
        # deeper levels ask for few texts, which the others need not move to meet
        near = read.withColumn("doc", known_id()).join(bounded(asked.select("doc", "txt").distinct()), ["doc", "txt"], "left_semi").drop("doc") if level else read
        sets.append(materialise(fetch_sets(near, asked, rule).select("set_id", "hashes"), "shingles"))
        every = reduce(DataFrame.unionByName, sets)
        links.append(materialise(group_links(groups, every, rule, n_leaves), "links"))
        if not kinds:
            break
        deeper, parts = large.where("not tight"), None
        if True in kinds:
            links.append(materialise(confirmed(hubs, every, rule), "links"))
            open_ = unconnected(large.where("tight"), links, search)
            deeper, parts = deeper.select("node", "set_id", "n", *SKETCH).unionByName(open_.where("not few").select("node", "set_id", "n", *SKETCH)), in_parts(open_.where("few"), search)
        entries = children(deeper, points, search) if level < search.depth else by_blocks(deeper, search)
        entries = entries if parts is None else entries.unionByName(parts)
    return links


def near_duplicates(docs: DataFrame, rule: Rule = Rule(words=5, num=85, den=100), search: Search = Search(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """doc_id, n_shingles, component_id (the smallest id that links reach), kept, for every row."""
    read = id_and_text(docs, id_col, text_col).withColumn("txt", F.xxhash64("text"))
    known = materialise(sketches(read, rule, search), "sketches")
    one = F.min(row_key()).alias("first")
    points = known.where("set_id is not null").groupBy("set_id").agg(one, *(F.first(c).alias(c) for c in ("set_key", "n", "roots", *SKETCH, "tokens")))
    points = materialise(points, "points")
    roots = components(reduce(DataFrame.unionByName, near_links(read, points, rule, search))).withColumnsRenamed({"node": "set_id"})
    named = points.select("set_id", "first").join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    lowest = named.groupBy("root").agg(F.min("first").alias("low"))
    firsts = named.join(lowest, "root").select("set_id", F.col("low.doc_id").alias("low"))
    found = known.select("doc_id", "n", "set_id").join(firsts, "set_id", "left").withColumn("component_id", F.coalesce("low", "doc_id"))
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
