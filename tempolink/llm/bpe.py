"""Byte-level BPE as a monoid: encodings of two halves join into the encoding of the whole.

A sequence of tokens is the BPE encoding of its bytes exactly if every two neighbours are the
encoding of their own concatenation. So two encodings join by encoding a window around the
boundary anew and growing it until the tokens outside hold against its edge: from there on no
merge can reach across, and everything outside is proven unchanged. Decoding is plain
concatenation up the same tree.

Cases: a null text is empty; an empty text has no tokens (hash of nothing); repeated rows give
repeated results, and an empty table no rows; a very long text is one tree, whole; columns other
than the id and the text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import id_and_text, texts_of

#: Pieces of at most so many bytes are merged directly: the tree's leaves.
LEAF_BYTES = 4
#: Pre-tokens kept with their ids, a worker; the cache starts anew beyond that. Longer ones than
#: `CACHE_CHARS` are not kept.
CACHE_WORDS = 1 << 19
CACHE_CHARS = 64
#: Subtrees of at most so many bytes are kept too: the halves of words recur.
NODE_BYTES = 8
#: Pre-tokens, or ids, in a leaf of a document's tree.
LEAF_WORDS = 4096


class MergeTree:
    """Encoder and decoder for one rank file."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.token[rank] = piece
        self.pattern = regex.compile(pattern)
        self._holds: dict[tuple[int, int], bool] = {}
        self._words: dict[str, bytes] = {}
        self._nodes: dict[bytes, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The plain merges: the lowest rank first, from the left."""
        if len(piece) > 64:
            return self._merge_long(piece)
        ranks = self.ranks
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same merges off a heap, for windows of many bytes."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # of the part that begins here; 0: merged away
        before = list(range(-1, n - 1))

        def offer(i: int) -> None:
            if i >= 0 and end[i] < n:
                r = ranks.get(piece[i : end[end[i]]])
                if r is not None:
                    heapq.heappush(heap, (r, i, end[i], end[end[i]]))

        heap: list[tuple[int, int, int, int]] = []
        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, mid, stop = heapq.heappop(heap)
            if end[i] != mid or mid >= n or end[mid] != stop:
                continue
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
            offer(before[i])
            offer(i)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def holds(self, a: int, b: int) -> bool:
        """Whether b may follow a in an encoding."""
        got = self._holds.get((a, b))
        if got is None:
            if len(self._holds) >= 1 << 20:
                self._holds.clear()
            got = self._holds[a, b] = self.merge(self.token[a] + self.token[b]) == [a, b]
        return got

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self.holds(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            window = self.merge(b"".join(map(self.token.__getitem__, left[-i:] + right[:j])))
            ok_left = i >= len(left) or self.holds(left[-i - 1], window[0])
            ok_right = j >= len(right) or self.holds(window[-1], right[j])
            if ok_left and ok_right:
                return left[: len(left) - i] + window + right[j:]
            i = i if ok_left else min(len(left), 2 * i)
            j = j if ok_right else min(len(right), 2 * j)

    def reduce(self, piece: bytes) -> list[int]:
        got = self._nodes.get(piece)
        if got is not None:
            return got
        if len(piece) <= LEAF_BYTES:
            out = self.merge(piece)
        else:
            mid = len(piece) // 2
            out = self.join(self.reduce(piece[:mid]), self.reduce(piece[mid:]))
        if len(piece) <= NODE_BYTES:
            if len(self._nodes) >= CACHE_WORDS:
                self._nodes.clear()
            self._nodes[piece] = out
        return out

    def encode_word(self, word: str) -> list[int]:
        """A pre-token; one that is itself in the vocabulary is that token."""
        piece = word.encode("utf-8")
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.reduce(piece)

    def _word(self, word: str) -> bytes:
        got = self._words.get(word)
        if got is None:
            if len(word) > CACHE_CHARS:
                return np.array(self.encode_word(word), "<u4").tobytes()
            if len(self._words) >= CACHE_WORDS:
                self._words.clear()
            got = self._words[word] = np.array(self.encode_word(word), "<u4").tobytes()
        return got

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers; no merge crosses pre-tokens, so
        their join is concatenation."""
        words = self.pattern.findall(text)

        def up(lo: int, hi: int) -> bytes:
            if hi - lo <= LEAF_WORDS:
                return b"".join(map(self._word, words[lo:hi]))
            mid = (lo + hi) // 2
            return up(lo, mid) + up(mid, hi)

        return up(0, len(words))

    def decode(self, ids: bytes) -> bytes:
        every = np.frombuffer(ids, "<u4").tolist()

        def up(lo: int, hi: int) -> bytes:
            if hi - lo <= LEAF_WORDS:
                return b"".join(map(self.token.__getitem__, every[lo:hi]))
            mid = (lo + hi) // 2
            return up(lo, mid) + up(mid, hi)

        return up(0, len(every))


@lru_cache(maxsize=2)
def tree_for(path: str, pattern: str) -> MergeTree:
    """One a worker process; the vocabulary file has the same place on every machine."""
    return MergeTree(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), decoded (binary) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = tree_for(path, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                ids = [tree.encode(t) for t in texts_of(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary()), pa.array([tree.decode(x) for x in ids], pa.binary())], ["doc_id", "ids", "decoded"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary, decoded binary")


def encoding_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: `encode_documents` without its bulk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = tree_for(path, pattern)
        for b in batches:
            ids = map(tree.encode, texts_of(b.column("text")))
            rows = [(len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(tree.decode(x)).hexdigest()) for x in ids]
            n, a, d = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
