"""Vector best-fit packing of tokenised documents into sequences.

A bin has three capacities: tokens, documents, and attention cost (the sum of squared piece
lengths). Pieces go in descending length; each goes to the bin that meets every constraint and
scores best, by the norm of what is left after placing (smallest) or by the weighted dot product
of the piece and what is left before (largest). The rule that needs fewer bins is used.

A piece's three demands follow from its length alone, so best-fit runs over the histogram of
lengths: bins in the same state are one entry with a count, and thousands of pieces of a length
move in one step. The driver sees at most `capacity` counts, whatever the size of the corpus.
Pieces then find their place by their rank among the pieces of their length, which is a rank
within their input partition plus the count of earlier partitions: no group is ever collected.

Cases: a null or empty text is the end id alone (one piece of length 1); repeated rows are packed
each; pieces of equal length stand in the order of their rows; a very long text is cut into pieces,
whole; a table without rows gives no pieces; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, materialise, texts_of
from .token_count import SPLIT, byte_symbols, plain_bpe

#: Runs of white space beyond which a text is read by the tokenizers library alone: the faster one
#: goes back over such a run step by step, and gives up on one of about a million.
LONG_SPACE = re.compile(r"\s{64}")


@dataclass(frozen=True)
class Capacity:
    """Of a sequence. The two optional limits bind only where they are set."""

    tokens: int = 1024
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)

    def vector(self) -> np.ndarray:
        # a bin of whole tokens holds at most as many documents as tokens, and their squared
        # lengths sum to the square of its length at most
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], np.int64)


@lru_cache(maxsize=2)
def encoder_for(path: str):  # noqa: ANN201
    """Ids as the tokenizers library gives them, its added tokens' strings inside texts included;
    for plain byte-level BPE files by the faster of the two libraries that read such merges."""
    import tiktoken
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()

    def slow(text: str) -> np.ndarray:
        return np.array(library.encode(text, add_special_tokens=False).ids, np.uint32)

    try:
        spec = plain_bpe(path)
        ranks, added = merge_ranks(spec), {x["content"]: x["id"] for x in spec["added_tokens"]}
    except ValueError:
        return slow
    coder = tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=added)
    every = set(added)

    def encode(text: str) -> np.ndarray:
        return slow(text) if LONG_SPACE.search(text) else coder.encode_to_numpy(text, allowed_special=every)

    return encode


def merge_ranks(spec: dict) -> dict[bytes, int]:
    """Bytes to ids of a plain byte-level BPE. ValueError unless ids rank the merges as their list
    does and all bytes have ids."""
    byte = {s: b for b, s in enumerate(byte_symbols())}
    vocab, added = spec["model"]["vocab"], {x["content"] for x in spec["added_tokens"]}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    made = [vocab["".join(p)] for p in pairs]
    ranks = {bytes(byte[c] for c in s): i for s, i in vocab.items() if s not in added}
    alone = sum(len(b) == 1 for b in ranks)
    if made != sorted(set(made)) or alone != 256 or len(ranks) != alone + len(made):
        raise ValueError("ids are no ranks of merges")
    return ranks


def cut(length: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all of `size` but the first, which may be shorter."""
    first = (length - 1) % size + 1
    return [(0, first), *((at, size) for at in range(first, length, size))]


def tokenised_pieces(docs: DataFrame, path: str, end_id: int, size: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, with the partition that made it and its rank
    among that partition's pieces of the same length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder_for(path), TaskContext.get().partitionId(), [0] * (size + 1)
        for b in batches:
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), texts_of(b.column("text")), strict=True):
                ids = np.append(encode(text), end_id).astype("<u4")
                for k, (start, n) in enumerate(cut(len(ids), size)):
                    rows.append((doc, k, start, n, zlib.crc32(ids[start : start + n]), part, seen[n]))
                    seen[n] += 1
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long")


class Bins:
    """Best-fit over a histogram. `segments` has, for runs of ranks of a length, their first bin,
    how many bins the run covers before it starts over in them, and the tokens before it."""

    def __init__(self, capacity: Capacity, rule: str) -> None:
        self.full = capacity.vector()
        self.scale = np.array(capacity.weights) / self.full
        self.rule = rule
        self.left = np.zeros((0, 3), np.int64)  # what a bin of the state has left
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.n_bins = 0
        self.segments: list[tuple[int, int, int, int, int, int]] = []  # length, rank, n, bin, per bin, tokens before

    def fits(self, item: np.ndarray, left: np.ndarray) -> np.ndarray:
        """How many of the item a bin takes under every constraint."""
        return (left // item).min(axis=-1)

    def _put(self, item: np.ndarray, rank: int, n: int, first: int, per: int, left: np.ndarray) -> list[tuple[np.ndarray, int, int]]:
        """Fill bins from `first` with `per` of the item each; the states that come of it."""
        whole, rest = divmod(n, per)
        self.segments.append((int(item[0]), rank, n, first, per, int(self.full[0] - left[0])))
        states = [(left - per * item, first, whole)] if whole else []
        return states + ([(left - rest * item, first + whole, 1)] if rest else [])

    def add(self, length: int, n: int) -> None:
        item, rank = np.array([length, 1, length * length], np.int64), 0
        if self.fits(item, self.full) < 1:
            raise ValueError(f"a piece of {length} tokens exceeds a sequence's capacities")
        while n:
            per = self.fits(item, self.left) if len(self.left) else np.zeros(0, np.int64)
            ok = np.flatnonzero(per > 0)
            if not len(ok):
                each = int(self.fits(item, self.full))
                bins = -(-n // each)
                new = self._put(item, rank, n, self.n_bins, each, self.full)
                self.n_bins += bins
                self._keep(new)
                return
            if self.rule == "norm":
                score = (((self.left[ok] - item) * self.scale) ** 2).sum(axis=1)
            else:
                score = -((self.left[ok] * self.scale) @ (item * self.scale))
            at = ok[np.lexsort((self.first[ok], score))[0]]
            each, first, count, left = int(per[at]), int(self.first[at]), int(self.count[at]), self.left[at].copy()
            take = min(n, each * count)
            used = -(-take // each)
            new = self._put(item, rank, take, first, each, left)
            if used < count:
                self.first[at], self.count[at] = first + used, count - used
            else:
                self._drop(at)
            self._keep(new)
            rank, n = rank + take, n - take

    def _drop(self, at: int) -> None:
        self.left, self.first, self.count = (np.delete(x, at, axis=0) for x in (self.left, self.first, self.count))

    def _keep(self, states: list[tuple[np.ndarray, int, int]]) -> None:
        states = [s for s in states if s[0].min() > 0 and s[2]]
        if states:
            self.left = np.vstack([self.left, *(s[0] for s in states)])
            self.first = np.append(self.first, [s[1] for s in states])
            self.count = np.append(self.count, [s[2] for s in states])


def pack_histogram(counts: dict[int, int], capacity: Capacity) -> Bins:
    """The better of the two rules; the norm where they tie."""
    made = []
    for rule in ("norm", "dot"):
        bins = Bins(capacity, rule)
        for length in sorted(counts, reverse=True):
            bins.add(length, counts[length])
        made.append(bins)
    return min(made, key=lambda b: b.n_bins)


def place(segments: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset for pieces of given lengths and ranks; segments are sorted by both."""
    key = segments[:, 0] << 44 | segments[:, 1]
    s = segments[np.searchsorted(key, length << 44 | rank, side="right") - 1]
    within = rank - s[:, 1]
    return s[:, 3] + within // s[:, 4], s[:, 5] + within % s[:, 4] * length


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, capacity: Capacity = Capacity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    pieces = materialise(tokenised_pieces(id_and_text(docs, id_col, text_col), path, end_id, capacity.tokens), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity.tokens rows
    segments = np.array(sorted(pack_histogram(histogram, capacity).segments), np.int64).reshape(-1, 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank, start = (np.asarray(b.column(c)) for c in ("length", "rank", "base"))
            seq, offset = place(segments, length, rank + start) if b.num_rows else (length, length)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq, pa.int64()), pa.array(offset, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(base, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", "rank", "base")
    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
