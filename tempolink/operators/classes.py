"""Places with the same events, treated once.

Whatever is asked of a pair of places and follows from their events alone is the same for all places
with these events. Such places are a class, led by the smallest of them: pairs of leaders are
computed, and then either weighed by how many places they stand for, or dealt out to these places.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialise, sized

#: Places that a class has to have on average for pairs of leaders to be dealt out.
WORTH = 4
#: Pairs of places that a task deals out, about.
DEALT = 1 << 24
#: Places of a class that are dealt out together, about.
TOGETHER = 256
#: Places of a list that a row has when the pairs are made.
PIECE = 64
#: Places up to which their lists are broadcast.
NEAR = 1 << 20


def classes(nodes: DataFrame, *events: DataFrame) -> DataFrame:
    """loc, rep: for every place the smallest one that has the same events in all layers."""
    layers = reduce(DataFrame.unionByName, (e.select("loc", F.struct(F.lit(k).alias("layer"), F.col("t_idx").cast("int").alias("t_idx")).alias("at")) for k, e in enumerate(events)))
    listed = layers.groupBy("loc").agg(F.sha2(F.to_json(F.sort_array(F.collect_set("at"))), 256).alias("series"))
    known = materialise(nodes.select("loc").join(listed, "loc", "left").select("loc", F.coalesce("series", F.lit("")).alias("series")), "series")
    first = known.groupBy("series").agg(F.min("loc").alias("rep"))
    return materialise(known.join(first, "series").select("loc", "rep"), "classes")


def leaders(members: DataFrame) -> DataFrame:
    return members.where("loc = rep").select("loc")


def sizes(members: DataFrame) -> DataFrame:
    """loc, n: the leaders and how many places each stands for."""
    return members.groupBy(F.col("rep").alias("loc")).agg(F.count("*").alias("n"))


def of_leaders(members: DataFrame, *events: DataFrame) -> tuple[DataFrame, ...]:
    """The leaders' events. They are written, as several steps read them and what they are made from is
    the whole input."""
    led = sized(leaders(members))
    return tuple(materialise(e.join(led, "loc", "left_semi"), "leaders") for e in events)


def weighed(pairs: DataFrame, members: DataFrame | None, name: str) -> DataFrame:
    """Pairs of leaders with the number of pairs of places that they stand for; 1 without classes."""
    if members is None:
        return pairs.withColumn(name, F.lit(1).cast("long"))
    n = sized(sizes(members))
    of_a = pairs.join(n.select(F.col("loc").alias("a"), F.col("n").alias("__na")), "a")
    return of_a.join(n.select(F.col("loc").alias("b"), F.col("n").alias("__nb")), "b").select(*pairs.columns, (F.col("__na") * F.col("__nb")).alias(name))


def dealt_out(pairs: DataFrame, members: DataFrame, members_b: DataFrame | None = None) -> DataFrame:
    """Pairs of leaders to all pairs of places that they stand for; members_b, where the second places
    are others than the first. What moves are the leaders' pairs alone, one for each two lists of some
    places of their classes, so that no task holds the pairs of a large class; the pairs of places are
    made from the lists where they are used."""
    one = lists(members)
    two = one if members_b is None else lists(members_b)
    n_a = members.count()
    n_b = n_a if members_b is None else members_b.count()
    parts = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_a * n_b // DEALT))
    near = F.broadcast if max(n_a, n_b) <= NEAR else lambda df: df
    wide = pairs.withColumnsRenamed({"a": "__a", "b": "__b"})
    for x, listed in (("a", one), ("b", two)):
        wide = wide.join(near(listed.select(F.col("rep").alias(f"__{x}"), F.col("part").alias(f"__part_{x}"))), f"__{x}")
    wide = wide.repartition(parts, "__a", "__part_a", "__b", "__part_b")
    for x, listed in (("a", one), ("b", two)):
        wide = wide.join(near(listed.select(F.col("rep").alias(f"__{x}"), F.col("part").alias(f"__part_{x}"), F.col("places").alias(f"__of_{x}"))), [f"__{x}", f"__part_{x}"])
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    some = wide.select(F.explode(pieces("__of_a")).alias("__of_a"), "__of_b", *rest).select("__of_a", F.explode(pieces("__of_b")).alias("__of_b"), *rest)
    return some.select(F.explode("__of_a").alias("a"), "__of_b", *rest).select("a", F.explode("__of_b").alias("b"), *rest).select(*pairs.columns)


def pieces(places: str) -> Column:
    """A list in pieces of PIECE. Generated code makes all rows of an input row before it hands on the
    first: pairs of two pieces stay in the cache, those of two whole lists don't."""
    last = F.floor((F.size(places) - 1) / PIECE).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(places, k * PIECE + 1, F.lit(PIECE)))


def lists(members: DataFrame) -> DataFrame:
    """rep, part, places: the places of every class, in lists of TOGETHER, about."""
    n = sized(sizes(members).select(F.col("loc").alias("rep"), F.ceil(F.col("n") / TOGETHER).alias("parts")))
    part = F.pmod(F.xxhash64("loc"), F.col("parts")).cast("int")
    return materialise(members.join(n, "rep").groupBy("rep", part.alias("part")).agg(F.collect_list("loc").alias("places")), "lists")


def shared(nodes: DataFrame, *events: DataFrame) -> DataFrame | None:
    """The classes; None where few places share their events."""
    members = classes(nodes, *events)
    return None if leaders(members).count() * WORTH > members.count() else members


def over_classes(nodes: DataFrame, events: tuple[DataFrame, ...], make: Callable[..., DataFrame]) -> DataFrame:
    """make(members, nodes, *events), which gives a row for each pair of places, by way of the pairs of
    leaders; without it (and members None) where few places share their events."""
    members = shared(nodes, *events)
    if members is None:
        return make(None, nodes, *events)
    return dealt_out(make(members, leaders(members), *of_leaders(members, *events)), members)
