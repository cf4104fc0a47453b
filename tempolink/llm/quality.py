"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line's features come from its own bytes and words and from those of
the lines before and after it; neighbouring labels have a transition weight. Training lines take
their document's label. Forward-backward gives each line its marginal; the mean of the marginals,
weighted by the lines' lengths, is the document's raw quality, and a two-parameter logistic fit on
the sample turns that into a probability.

Cases: a null or empty text is one line without content; without labels of both kinds every score
is the share of good labels (1 without labels); repeated rows score alike; a very long text is one chain of
lines (texts beyond `learn.TEXT_LINES` lines are scored, not learned from); an empty table gives no
rows; columns other than the id and the text are ignored by a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, row_chunks, text_buffer, word_hashes
from .learn import is_held_out, release, sigmoid, training_sample

#: Labelled documents to learn from, at most.
SAMPLE_ROWS = 6000
THRESHOLD = 0.3
RATE, PASSES, RIDGE = 0.05, 150, 1e-4

NEWLINE = ord("\n")


def _class(chars: str, high: bool = False) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    out[128:] = high
    return out


#: Classes of bytes that a line's features count.
CLASSES = [
    _class("abcdefghijklmnopqrstuvwxyz", high=True),
    _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    _class("0123456789"),
    _class(" \t"),
    _class(".,;:'\"-()"),
    _class("!?"),
    _class("#$%&*+=@^_~<>/\\"),
    _class("|[]{}"),
]
TERMINAL = _class(".!?:\"')")
N_OWN = 22
N_FEATURES = 3 * N_OWN + 1


@dataclass
class Lines:
    """Lines of the texts in a buffer: own features, bytes, and where each text's lines begin."""

    own: np.ndarray
    size: np.ndarray
    first: np.ndarray  # (texts + 1,)


def lines_of(data: np.ndarray, offsets: np.ndarray) -> Lines:
    """Texts split at line feeds; a text has one more line than line feeds."""
    breaks = np.flatnonzero(data == NEWLINE)
    texts = len(offsets) - 1
    # a line begins with its text and after every line feed of it
    start = np.sort(np.concatenate((offsets[:-1], breaks + 1)), kind="stable")
    first = np.searchsorted(breaks, offsets) + np.arange(texts + 1)
    end = np.append(start[1:], len(data))
    is_last = np.zeros(len(start), bool)
    is_last[first[1:] - 1] = True
    end = np.where(is_last, end, end - 1)
    end[is_last] = offsets[1:]
    size = np.maximum(end - start, 0)
    n = np.maximum(size, 1)

    def total(of: np.ndarray) -> np.ndarray:
        """Sum over each line of a value for each byte."""
        run = np.concatenate(([0], np.cumsum(of)))
        return run[end] - run[start]

    own = np.zeros((len(start), N_OWN))
    for k, kind in enumerate(CLASSES):
        own[:, k] = total(kind[data]) / n
    own[:, 8] = np.log1p(size) / 5
    own[:, 9] = size == 0
    words, line = word_hashes(data, np.append(start, len(data)))  # line feeds are white space
    count = np.bincount(line, minlength=len(start))[: len(start)]
    m = np.maximum(count, 1)
    own[:, 10] = np.log1p(count) / 4
    own[:, 11] = np.minimum(size / m, 40) / 10
    same = (words[1:] == words[:-1]) & (line[1:] == line[:-1]) if len(words) else np.zeros(0, bool)
    own[:, 12] = np.bincount(line[1:][same], minlength=len(start))[: len(start)] / m
    _, ids = np.unique(words, return_inverse=True)
    pairs = np.unique(line * (len(words) + 1) + ids) if len(words) else np.zeros(0, np.int64)
    distinct = np.bincount(pairs // (len(words) + 1), minlength=len(start))[: len(start)]
    own[:, 13] = np.where(count > 0, distinct / m, 1)
    own[:, 14] = (count > 0) & (own[:, 13] < 0.5)
    filled = size > 0
    own[filled, 15] = TERMINAL[data[end[filled] - 1]]
    own[filled, 16] = CLASSES[1][data[start[filled]]]
    own[:, 17] = count == 1
    # symbols at the ends of words (before a space, or at the end of the text), and bars between them
    symbol = CLASSES[6] | CLASSES[5]
    closing = np.append(data[1:] == 32, True)[: len(data)]
    closing[offsets[1:][offsets[1:] > 0] - 1] = True
    tail = symbol[data] & closing
    own[:, 18] = np.minimum(total(tail) / m, 2)
    own[:, 19] = np.minimum(total(CLASSES[7][data]) / m, 2)
    # a line that its text has more than once
    whole = np.zeros(len(start), np.uint64)
    np.add.at(whole, line, words * (np.uint64(2) * np.arange(len(words), dtype=np.uint64) - np.uint64(2) * np.concatenate(([0], np.cumsum(count)))[line].astype(np.uint64) + np.uint64(1)))
    text = np.repeat(np.arange(texts), np.diff(first))
    keys = np.empty(len(start), [("t", np.int64), ("w", np.uint64)])
    keys["t"], keys["w"] = text, whole
    _, back, times = np.unique(keys, return_inverse=True, return_counts=True)
    own[:, 20] = (times[back] > 1) & (count > 0)
    own[:, 21] = own[:, 1] > 0.5
    return Lines(own, size, first)


def with_neighbours(lines: Lines) -> np.ndarray:
    """Own features, those of the line before and after (zeros at a text's ends), and a constant."""
    n = len(lines.own)
    x = np.zeros((n, N_FEATURES), np.float32)
    x[:, :N_OWN] = lines.own
    inner = np.ones(n, bool)
    inner[lines.first[:-1]] = False
    at = np.flatnonzero(inner)
    x[at, N_OWN : 2 * N_OWN] = lines.own[at - 1]
    x[at - 1, 2 * N_OWN : 3 * N_OWN] = lines.own[at]
    x[:, -1] = 1
    return x


def onward(x: np.ndarray, e: np.ndarray) -> np.ndarray:
    """x @ e for pairs, written out: a product's rounding depends on how many rows it has."""
    return x[:, :1] * e[0] + x[:, 1:] * e[1]


def marginals(unary: np.ndarray, trans: np.ndarray, first: np.ndarray, labels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line, and the expected transitions (2, 2), over all chains at once: a step
    takes the k-th line of every chain that has one. unary: weight of good over bad."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    start, length = first[:-1][order], length[order]
    longest = int(length[0]) if len(length) else 0
    alive = np.searchsorted(-length, -np.arange(longest), side="left")  # chains with more than k lines
    n = len(unary)
    alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
    emit = np.stack([np.zeros(n), unary], axis=1)
    top = emit.max(axis=1, keepdims=True)
    emit = np.exp(emit - top)
    e = np.exp(trans)
    for k in range(longest):
        at = start[: alive[k]] + k
        a = emit[at] if k == 0 else onward(alpha[at - 1], e) * emit[at]
        alpha[at] = a / a.sum(axis=1, keepdims=True)
    expected = np.zeros((2, 2))
    for k in range(longest - 1, -1, -1):
        at = start[: alive[k]] + k
        beta[at] = 1.0
        more = alive[k + 1] if k + 1 < longest else 0
        if more:
            on = at[:more]
            nxt = emit[on + 1] * beta[on + 1]
            b = onward(nxt, e.T)
            beta[on] = b / b.sum(axis=1, keepdims=True)
            joint = alpha[on][:, :, None] * e[None] * nxt[:, None, :]
            expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    p = alpha * beta
    return p[:, 1] / p.sum(axis=1), expected


@dataclass(frozen=True)
class Field:
    """The trained weights; a few hundred numbers."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    trans: np.ndarray
    slope: float
    shift: float

    def raw(self, lines: Lines) -> np.ndarray:
        """Mean marginal of each text, weighted by the lines' bytes."""
        x = with_neighbours(lines)
        weight = self.weight.astype(np.float64) / self.scale
        unary = np.full(len(x), -float((self.mean * weight).sum()))
        for k in range(N_FEATURES):  # in a fixed order, so that a text's score doesn't depend on its batch
            unary += x[:, k] * weight[k]
        p, _ = marginals(unary, self.trans, lines.first)
        weight = lines.size + 1.0
        top = np.add.reduceat(p * weight, lines.first[:-1]) if len(p) else p
        return top / np.add.reduceat(weight, lines.first[:-1]) if len(p) else p

    def score(self, lines: Lines) -> np.ndarray:
        return sigmoid(self.slope * logit(self.raw(lines)) + self.shift)

    def score_texts(self, col: pa.Array) -> np.ndarray:
        """Scores of a column of texts; features are held for a chunk of them at a time."""
        data, offsets = text_buffer(col)
        parts = [self.score(lines_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])) for i, j in row_chunks(offsets)]
        return np.concatenate(parts) if parts else np.zeros(0)


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def joined(parts: list[Lines]) -> Lines:
    if not parts:
        return Lines(np.zeros((0, N_OWN)), np.zeros(0, np.int64), np.zeros(1, np.int64))
    shift = np.cumsum([0, *(len(p.own) for p in parts)])
    first = np.concatenate([p.first[:-1] + s for p, s in zip(parts, shift[:-1], strict=True)] + [shift[-1:]])
    return Lines(np.concatenate([p.own.astype(np.float32) for p in parts]), np.concatenate([p.size for p in parts]), first)


def all_lines(col: pa.Array) -> Lines:
    data, offsets = text_buffer(col)
    return joined([lines_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in row_chunks(offsets)])


def train(sample: list[tuple[str, int]]) -> Field:
    y = np.array([v for _, v in sample], float)
    share = y.mean() if len(y) else 1.0
    zero, one = np.zeros(N_FEATURES, np.float32), np.ones(N_FEATURES, np.float32)
    if share in (0.0, 1.0):
        return Field(zero, one, zero, np.zeros((2, 2)), 0.0, 40.0 if share else -40.0)
    lines = all_lines(pa.array([t for t, _ in sample], pa.string()))
    x = with_neighbours(lines)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    mean[-1], scale[-1] = 0, 1
    x = (x - mean) / scale
    chains = len(sample)
    label = np.repeat(y, np.diff(lines.first))
    # every chain counts alike, whatever its number of lines
    share_of = np.repeat(1 / np.diff(lines.first), np.diff(lines.first))
    same = np.diff(lines.first) - 1
    seen = np.array([[((1 - y) * same).sum(), 0], [0, (y * same).sum()]])
    w, trans = np.zeros(N_FEATURES), np.zeros((2, 2))
    moments = [np.zeros(N_FEATURES), np.zeros(N_FEATURES), np.zeros((2, 2)), np.zeros((2, 2))]
    links = max(same.sum(), 1)
    for step in range(1, PASSES + 1):
        p, expected = marginals(x @ w, trans, lines.first)
        gw = x.T @ ((p - label) * share_of) / chains + RIDGE * w
        gt = (expected - seen) / links * 0.1 + RIDGE * trans
        for m, g, at in ((0, gw, w), (2, gt, trans)):
            moments[m] = 0.9 * moments[m] + 0.1 * g
            moments[m + 1] = 0.999 * moments[m + 1] + 0.001 * g * g
            at -= RATE * (moments[m] / (1 - 0.9**step)) / (np.sqrt(moments[m + 1] / (1 - 0.999**step)) + 1e-8)
    field = Field(mean, scale, w.astype(np.float32), trans, 1.0, 0.0)
    raw = logit(field.raw(lines))
    a, b = 1.0, 0.0
    for _ in range(25):  # Newton steps of the two-parameter fit, with a little ridge
        p = sigmoid(a * raw + b)
        v = p * (1 - p) + 1e-6
        g = np.array([((p - y) * raw).sum() + 0.01 * a, (p - y).sum()])
        h = np.array([[(v * raw * raw).sum() + 0.01, (v * raw).sum()], [(v * raw).sum(), v.sum()]])
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    return Field(mean, scale, w.astype(np.float32), trans, float(a), float(b))


SCORE_SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def fit_quality(docs: DataFrame, labels: DataFrame, target: str = "quality") -> Field:
    field = train(training_sample(id_and_text(docs), labels, target, SAMPLE_ROWS))
    release()
    return field


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    field = fit_quality(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = field.score_texts(b.column("text"))
            ids = b.column("doc_id")
            yield pa.RecordBatch.from_arrays([ids, pa.array(map(is_held_out, ids.to_pylist()), pa.bool_()), pa.array(score, pa.float64()), pa.array(score >= threshold, pa.bool_()).cast(pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return id_and_text(docs).mapInArrow(run, SCORE_SCHEMA)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that score at least the threshold. docs: doc_id and
    text, and any others; labels: doc_id and quality."""
    field = fit_quality(docs, labels)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(field.score_texts(b.column(at)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
