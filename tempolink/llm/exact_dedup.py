"""Exact duplicates by a minimal perfect hash over the digests of earlier documents.

The history (documents that arrived first) becomes an index: its distinct digests, sharded, each
shard with a minimal perfect hash whose slots hold the full digest and the locator of the winner.
The batch (documents that came later) is aggregated by digest, and each of its distinct digests is
looked up once: equal bytes in the slot make it a repeat of the winner, everything else is a
nonmember and forms a group of its own. Aggregation before every shuffle bounds what a hot text
sends; groups with a thousandth of all rows or more, a thousand at most, are broadcast at the end.

Cases: a null text counts as empty, and empty texts are equal; of rows with the same smallest id
one stays; a null id stands after all others; a very long text is its
digest like any other; an empty table gives no rows; columns other than the id and the text are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, id_and_text, materialise, mix64

#: Digests in a shard of the index, about.
SHARD_KEYS = 1 << 13
#: Groups with at least one in so many rows are broadcast.
HOT_SHARE = 1000
GAMMA = 2.0
LEVELS = 40


class PerfectHash:
    """A minimal perfect hash of n distinct 32-byte digests onto 0..n-1, level by level: a key
    that is alone at its place in a level's bit array stays there, the others go down a level.
    The slot is the number of bits set before the key's."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels
        self.ranks = []
        before = 0
        for bits in levels:
            self.ranks.append(before + np.cumsum(bits) - bits)
            before += int(bits.sum())
        self.n = before

    @staticmethod
    def _place(words: np.ndarray, level: int, size: int) -> np.ndarray:
        k = words[:, level % 4] + np.uint64(level) * words[:, (level + 1) % 4]
        return (mix64(k) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, digests: np.ndarray) -> PerfectHash:
        words, levels = as_words(digests), []
        while len(words):
            if len(levels) == LEVELS:
                raise ValueError("digests are not distinct")
            size = max(1, int(GAMMA * len(words)))
            at = cls._place(words, len(levels), size)
            bits = np.bincount(at, minlength=size) == 1
            levels.append(bits)
            words = words[~bits[at]]
        return cls(levels)

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """Of members their slot; of others any slot, or -1."""
        words = as_words(digests)
        out, open_ = np.full(len(words), -1, np.int64), np.arange(len(words))
        for level, (bits, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = self._place(words[open_], level, len(bits))
            hit = bits[at]
            out[open_[hit]] = rank[at[hit]]
            open_ = open_[~hit]
        return out

    def to_bytes(self) -> bytes:
        return pa.serialize_pandas(pd.DataFrame({"size": [len(b) for b in self.levels], "bits": [np.packbits(b).tobytes() for b in self.levels]})).to_pybytes()

    @classmethod
    def from_bytes(cls, stored: bytes) -> PerfectHash:
        kept = pa.deserialize_pandas(stored)
        return cls([np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for n, b in zip(kept["size"], kept["bits"], strict=True)])


def as_words(digests: np.ndarray) -> np.ndarray:
    """Digests (n, 32) as (n, 4) integers."""
    return np.ascontiguousarray(digests).view("<u8").reshape(-1, 4)


def as_rows(col: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.uint8).reshape(-1, 32)


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def group_columns() -> list[Column]:
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    return [F.min(order).alias("winner"), F.count("*").alias("n")]


def shard_of(n_shards: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(n_shards)).cast("int").alias("shard")


def build_index(groups: DataFrame, n_shards: int) -> DataFrame:
    """One row a shard: the perfect hash, and in slot order digests, winners and counts.
    groups: distinct digests with winner (no_id, doc_id, row) and n."""
    flat = groups.select(shard_of(n_shards), "digest", "winner.doc_id", "winner.row", "n")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        digests = as_rows(pdf["digest"])
        hashed = PerfectHash.build(digests)
        order = np.argsort(hashed.slots(digests))
        pdf = pdf.iloc[order]
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "hash": [hashed.to_bytes()], "digests": [b"".join(pdf["digest"])], "ids": [pdf["doc_id"].astype("Int64").to_list()], "rows": [pdf["row"].to_list()], "counts": [pdf["n"].to_list()]})

    return flat.groupBy("shard").applyInPandas(build, "shard int, hash binary, digests binary, ids array<long>, rows array<long>, counts array<long>")


GROUP_SCHEMA = "digest binary, keep_id long, keep_row long, group_size long, in_history boolean"


def look_up(index: DataFrame, batch: DataFrame, n_shards: int) -> DataFrame:
    """Every group of history and batch: digest, keep_id, keep_row, group_size, in_history.
    batch: distinct digests with winner and n. Slots' digests are compared byte by byte."""
    flat = batch.select(shard_of(n_shards), "digest", "winner.doc_id", "winner.row", "n")

    def check(_: tuple, indexed: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        made = []
        rest = asked
        if len(indexed):
            kept = indexed.iloc[0]
            slots_hold = np.frombuffer(kept["digests"], np.uint8).reshape(-1, 32)
            size = np.array(kept["counts"], np.int64)
            if len(asked):
                digests = as_rows(asked["digest"])
                slot = PerfectHash.from_bytes(kept["hash"]).slots(digests)
                member = slot >= 0
                member[member] = (slots_hold[slot[member]] == digests[member]).all(axis=1)
                np.add.at(size, slot[member], asked["n"].to_numpy()[member])
                rest = asked[~member]
            made.append(pd.DataFrame({"digest": [x.tobytes() for x in slots_hold], "keep_id": pd.array(list(kept["ids"]), "Int64"), "keep_row": list(kept["rows"]), "group_size": size, "in_history": True}))
        if len(rest):
            made.append(pd.DataFrame({"digest": rest["digest"].to_list(), "keep_id": rest["doc_id"].astype("Int64").array, "keep_row": rest["row"].to_list(), "group_size": rest["n"].to_list(), "in_history": False}))
        return pd.concat(made, ignore_index=True)

    return index.groupBy("shard").cogroup(flat.groupBy("shard")).applyInPandas(check, GROUP_SCHEMA)


def duplicate_groups(hashed: DataFrame, history: Column) -> DataFrame:
    """hashed: doc_id, row, digest. Rows where `history` is true came first. A winner of the
    history is the winner of its group, so ids of the history must not exceed the batch's."""
    old = hashed.where(history).groupBy("digest").agg(*group_columns())
    new = hashed.where(~history).groupBy("digest").agg(*group_columns())
    n_shards = max(1, -(-hashed.count() // SHARD_KEYS))
    index = materialise(build_index(old, n_shards), "digest-index")
    return look_up(index, new, n_shards)


def dedup_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and in_history for every row. The history is
    the rows up to the middle of the ids' range."""
    read = id_and_text(docs, id_col, text_col)
    hashed = materialise(read.select("doc_id", F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest")), "digests")
    lo, hi, total = hashed.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    middle = 0 if lo is None else (lo + hi) // 2
    groups = materialise(duplicate_groups(hashed, F.coalesce(F.col("doc_id") <= middle, F.lit(False))), "digest-groups")
    hot = F.col("group_size") * HOT_SHARE >= total
    few, rest = groups.where(hot & (F.col("group_size") > 1)), groups.where(~(hot & (F.col("group_size") > 1)))
    few = F.broadcast(few.select(F.col("digest"), F.struct("keep_id", "keep_row", "group_size", "in_history").alias("hot")))  # at most HOT_SHARE rows
    at_hot = hashed.join(few, "digest", "left")
    cold = at_hot.where(F.col("hot").isNull()).drop("hot").join(rest, "digest")
    out = cold.unionByName(at_hot.where(F.col("hot").isNotNull()).select("doc_id", "row", "digest", "hot.*"))
    return out.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "in_history")


def digest_of(text: str | None) -> bytes:
    """The digest of one text, for tests and tools outside Spark."""
    import re

    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).digest()


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    every = materialise(dedup_exact(docs, id_col, text_col), "duplicates")
    own_id, own_digest, sha = free_names(docs, "__id", "__digest", "__sha")
    stay = every.where("kept").select(F.col("doc_id").alias(own_id), F.col("text_sha256").alias(own_digest))
    digest = F.sha2(normalised(F.col(text_col)), 256)
    out = docs.join(stay.hint("shuffle_hash"), F.col(id_col).cast("long").eqNullSafe(F.col(own_id)) & (digest == F.col(own_digest)), "left_semi")
    repeats = every.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("doc_id", "text_sha256").count().where("count > 1")
    if repeats.isEmpty():
        return out
    return out.withColumn(sha, digest).dropDuplicates([id_col, sha]).select(*docs.columns)  # whole rows that repeat
