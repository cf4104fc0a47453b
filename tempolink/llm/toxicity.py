"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are single words, pairs of neighbours, and pairs with one word between, hashed into 2**20
buckets; each counts once a document. FTRL-proximal gives every coordinate its own learning rate
and, through L1, leaves most weights at zero: what is sent to the workers is a list of a few
thousand (bucket, weight) pairs, never more than `BUCKETS`.

Cases: a null or empty text has no features and scores by the intercept; without labels of both
kinds every score is the share of toxic labels (0 without labels); repeated rows score alike; a
very long text is read whole, chunk by chunk; an empty table gives no rows; columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import GOLDEN, LETTERS, id_and_text, mix64, row_chunks, text_buffer, word_hashes
from .learn import is_held_out, sigmoid, training_sample

BUCKETS = 1 << 20
#: FTRL-proximal: rate, smoothing of the rates, L1 and L2; passes over the sample.
ALPHA, BETA, L1, L2, PASSES = 1.0, 1.0, 5.0, 0.1, 3
#: A feature takes part once so many documents of the sample have it.
LEAST_DOCS = 4
#: A toxic document counts so many times, as there are few.
TOXIC_WEIGHT = 1.5
#: Labelled documents to learn from, at most.
SAMPLE_ROWS = 10_000
THRESHOLD = 0.5


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and rows of all n-grams and skip-grams of the texts in a buffer, repeats included."""
    words, rows = word_hashes(data, offsets, LETTERS)
    grams, where = [words], [rows]
    for gap in (1, 2):
        same = rows[gap:] == rows[:-gap]
        grams.append(mix64(words[:-gap][same] * GOLDEN + words[gap:][same] + np.uint64(gap)))
        where.append(rows[gap:][same])
    return (np.concatenate(grams) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(where)


def distinct_features(texts: list[str]) -> Iterator[np.ndarray]:
    """The buckets of each text, once each; a chunk of texts at a time."""
    data, offsets = text_buffer(pa.array(texts, pa.string()))
    for i, j in row_chunks(offsets):
        buckets, rows = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        pair = np.unique(rows * BUCKETS + buckets)
        bounds = np.searchsorted(pair, np.arange(j - i + 1) * BUCKETS)
        found = (pair % BUCKETS).astype(np.int32)
        for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield found[a:z]


@dataclass(frozen=True)
class Weights:
    """The non-zero weights and the intercept."""

    buckets: np.ndarray
    values: np.ndarray
    intercept: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        dense = np.zeros(BUCKETS, np.float32)
        dense[self.buckets] = self.values
        used = dense != 0
        total = np.full(len(offsets) - 1, self.intercept)
        for i, j in row_chunks(offsets):
            buckets, rows = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            keep = used[buckets]
            pair = np.unique(rows[keep] * BUCKETS + buckets[keep])
            total[i:j] += np.bincount(pair // BUCKETS, dense[pair % BUCKETS].astype(np.float64), j - i)
        return sigmoid(total)


def train(sample: list[tuple[str, int]], seed: int = 7) -> Weights:
    share = sum(y for _, y in sample) / len(sample) if sample else 0.0
    if share in (0.0, 1.0):
        return Weights(np.zeros(0, np.int64), np.zeros(0, np.float32), 40.0 if share else -40.0)
    texts = [t for t, _ in sample]
    seen = np.zeros(BUCKETS, np.int32)
    for r in distinct_features(texts):
        seen[r] += 1
    # made again rather than held: most features are too rare to take part
    rows = [np.append(r[seen[r] >= LEAST_DOCS], np.int32(BUCKETS)) for r in distinct_features(texts)]
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)  # the last is the intercept, which has no L1
    l1 = np.append(np.full(BUCKETS, L1), 0.0)

    def weights(at: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - l1[at], 0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    order = np.random.default_rng(seed)
    for _ in range(PASSES):
        for k in order.permutation(len(rows)):
            at = rows[k]
            w = weights(at)
            y = sample[k][1]
            g = (sigmoid(w.sum()) - y) * (TOXIC_WEIGHT if y else 1)
            rate = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - rate * w
            n[at] += g * g
    w = weights(np.arange(BUCKETS + 1))
    keep = np.flatnonzero(w[:-1])
    return Weights(keep, w[keep].astype(np.float32), float(w[-1]))


SCORE_SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def score_toxicity(docs: DataFrame, labels: DataFrame, target: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    read = id_and_text(docs)
    model = train(training_sample(read, labels, target, SAMPLE_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = model.score(*text_buffer(b.column("text")))
            ids = b.column("doc_id")
            yield pa.RecordBatch.from_arrays([ids, pa.array(map(is_held_out, ids.to_pylist()), pa.bool_()), pa.array(score, pa.float64()), pa.array(score >= threshold, pa.bool_()).cast(pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return read.mapInArrow(run, SCORE_SCHEMA)
