"""What the two classifiers share: the labelled sample they learn from, and the held-out fold."""

from __future__ import annotations

import ctypes
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Labelled documents to learn from, at most: those whose ids hash lowest.
SAMPLE_ROWS = 6000
#: Characters of text to learn from, at most: documents are taken whole, in the order of that hash;
#: one that doesn't fit any more is passed over for shorter ones.
SAMPLE_CHARS = 1 << 27
#: Lines of a text to learn from, at most: a longer text is passed over.
TEXT_LINES = 2000
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Every fifth document by the crc32 of its id; none without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == 0


def training_sample(docs: DataFrame, labels: DataFrame, target: str, rows: int = SAMPLE_ROWS, max_chars: int = SAMPLE_CHARS) -> list[tuple[str, int]]:
    """(text, label) of at most `rows` labelled documents outside the held-out fold, and of at most
    `SAMPLE_CHARS` characters in all; texts of more than `TEXT_LINES` lines stand aside. The bounded list of labels is
    broadcast, and only texts of the sample move. An id with several labels has the smallest, one
    with several texts the smallest of them, so that repeated rows count once."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & ~held_out(F.col("doc_id")))
    one = known.groupBy(F.col("doc_id").alias("__id")).agg(F.min(F.col(target).cast("int")).alias("__label"))
    some = one.withColumn("__hash", F.xxhash64("__id")).orderBy("__hash", "__id").limit(rows)
    read = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = read.join(F.broadcast(some), read["doc_id"] == some["__id"])
    sample = materialise(found.groupBy("__id", "__hash", "__label").agg(F.min("text").alias("text")), "sample")
    # sizes first, at most `rows` short lines, so that the driver never sees more than the bound
    lines = F.length("text") - F.length(F.translate("text", "\n", "")) + 1
    taken, total = [], 0
    for _, i, n in sorted(sample.where(lines <= TEXT_LINES).select("__hash", "__id", F.length("text")).collect()):
        if total + n <= max_chars:
            taken.append(i)
            total += n
    sample = sample.where(F.col("__id").isin(taken))
    return [(r["text"], r["__label"]) for r in sorted(sample.collect(), key=lambda r: r["__id"])]


def release() -> None:
    """Give the memory that learning took back to the system, as the driver lives on; only where its C
    library can."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
