"""Classifiers: held-out accuracy, gradients, and odd inputs."""

from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tempolink.llm import learn, quality, toxicity

SF = "/root/testdata/sf0.01"


def auc(score, y):
    rank = np.argsort(np.argsort(score, kind="stable"))
    return (rank[y == 1].mean() - (y.sum() - 1) / 2) / (y == 0).sum()


def scored(spark, f, target):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = f(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    truth = {r["doc_id"]: r[target] for r in labels.collect()}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    return np.array([r["score"] for r in held]), np.array([truth[r["doc_id"]] for r in held]), np.array([r["predicted"] for r in held])


def test_quality_on_held_out(spark):
    score, y, predicted = scored(spark, quality.score_quality, "quality")
    assert auc(score, y) > 0.97 and (predicted == y).mean() > 0.95
    assert ((score >= 0.3) == predicted).all()


def test_toxicity_on_held_out(spark):
    """300 labelled documents hold few toxic words, so the order is tested more than the cut."""
    score, y, predicted = scored(spark, toxicity.score_toxicity, "toxic")
    assert auc(score, y) > 0.7 and predicted[y == 0].mean() < 0.05
    assert ((score >= 0.5) == predicted).all()


@pytest.mark.parametrize("f,target", [(quality.score_quality, "quality"), (toxicity.score_toxicity, "toxic")])
def test_odd_rows(spark, f, target):
    texts = [None, "", "\n\n", "word", "word", "x" * 20_000, "a b\n" * 4000]
    docs = spark.createDataFrame([(i, t, 0.5, 1) for i, t in enumerate(texts)] + [(None, "z", 0.1, 0)], "doc_id long, text string, score double, predicted int")
    some = spark.createDataFrame([(i, i % 2, "z") for i in range(7)] + [(None, 1, "z"), (3, None, "z")], f"doc_id long, {target} int, text string")
    rows = f(docs, some).collect()
    assert len(rows) == 8 and all(0 <= r["score"] <= 1 for r in rows)
    same = {r["doc_id"]: r["score"] for r in rows}
    assert same[3] == same[4] and same[0] == same[1]
    assert all(0 <= r["score"] <= 1 for r in f(docs, some.limit(0)).collect())
    assert f(docs.limit(0), some).count() == 0


def test_filter_keeps_columns(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    kept = quality.keep_good(docs, labels)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    good = [i for i, q in truth.items() if q]
    assert kept.columns == docs.columns
    assert np.mean([i in ids for i in good]) > 0.97 and np.mean([i in ids for i, q in truth.items() if not q]) < 0.1


def test_marginals_against_enumeration():
    rng = random.Random(2)
    lengths = [1, 4, 2, 3]
    first = np.concatenate(([0], np.cumsum(lengths)))
    unary = np.array([rng.gauss(0, 1) for _ in range(first[-1])])
    trans = np.array([[0.3, -0.2], [0.1, 0.7]])
    got, expected = quality.marginals(unary, trans, first)
    want_t = np.zeros((2, 2))
    for k, n in enumerate(lengths):
        u = unary[first[k] : first[k + 1]]
        weight = {}
        for path in itertools.product((0, 1), repeat=n):
            weight[path] = np.exp(sum(u[i] * path[i] for i in range(n)) + sum(trans[path[i], path[i + 1]] for i in range(n - 1)))
        z = sum(weight.values())
        for i in range(n):
            assert got[first[k] + i] == pytest.approx(sum(w for p, w in weight.items() if p[i]) / z)
        for p, w in weight.items():
            for i in range(n - 1):
                want_t[p[i], p[i + 1]] += w / z
    assert np.allclose(expected, want_t)


def test_lines_do_not_depend_on_the_batch():
    texts = ["a b c.\nD e\n", "", "For For For\nFor For For", "x*** y### z$$$\n\nTail"]
    from tempolink.llm.common import text_buffer

    together = quality.lines_of(*text_buffer(pa.array(texts)))
    assert np.diff(together.first).tolist() == [3, 1, 2, 3]
    for k, t in enumerate(texts):
        alone = quality.lines_of(*text_buffer(pa.array([t])))
        assert np.allclose(alone.own, together.own[together.first[k] : together.first[k + 1]])
    assert together.own[4, 20] == 1 and together.own[0, 20] == 0


def test_sparse_weights():
    rng = random.Random(0)
    words = ["alpha", "beta", "gamma", "delta", "eps"] * 3 + [f"w{i}" for i in range(200)]
    sample = []
    for i in range(600):
        w = [rng.choice(words) for _ in range(30)]
        if i % 4 == 0:
            w[rng.randrange(30)] = "vile"
        sample.append((" ".join(w), int(i % 4 == 0)))
    model = toxicity.train(sample)
    assert 0 < len(model.buckets) < 200
    from tempolink.llm.common import text_buffer

    score = model.score(*text_buffer(pa.array(["alpha Vile, beta", "alpha beta gamma", ""])))
    assert score[0] > 0.5 > score[1] and score[2] < 0.5


def test_folds():
    assert learn.is_held_out(None) is False
    assert all(learn.is_held_out(i) == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(50))


def test_sample_of_repeated_ids(spark):
    """One text and one label for an id, whatever the order of rows, and both bounds."""
    rows = [(1, "b"), (1, "a"), (1, "a"), (2, None), (3, "ccc"), (4, "x"), (None, "z")]
    some = [(1, 1), (1, 0), (2, 1), (3, 0), (3, 0), (4, None), (None, 1), (7, 1)]
    for seed in range(3):
        rng = random.Random(seed)
        rng.shuffle(rows)
        rng.shuffle(some)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        labels = spark.createDataFrame(some, "doc_id long, quality int")
        held = {i for i in (1, 2, 3) if learn.is_held_out(i)}
        want = [x for i, x in ((1, ("a", 0)), (2, ("", 1)), (3, ("ccc", 0))) if i not in held]
        assert learn.training_sample(docs, labels, "quality") == want
        assert len(learn.training_sample(docs, labels, "quality", rows=1)) <= 1
        assert sum(len(t) for t, _ in learn.training_sample(docs, labels, "quality", max_chars=2)) <= 2


def plain_ftrl(rows, labels, seed):
    """The update written out for one coordinate at a time; the bias has no L1."""
    z, n = {}, {}

    def weight(i):
        if i not in z:
            return 0.0
        l1 = 0.0 if i == toxicity.BUCKETS else toxicity.L1
        if abs(z[i]) <= l1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return -(z[i] - sign * l1) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    order = np.random.default_rng(seed)
    for _ in range(toxicity.PASSES):
        for k in order.permutation(len(rows)):
            w = {i: weight(i) for i in rows[k]}
            p = 1 / (1 + np.exp(-sum(w.values())))
            g = (p - labels[k]) * (toxicity.TOXIC_WEIGHT if labels[k] else 1)
            for i in rows[k]:
                before = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - ((before + g * g) ** 0.5 - before**0.5) / toxicity.ALPHA * w[i]
                n[i] = before + g * g
    return {i: weight(i) for i in z}


def test_ftrl_against_plain_updates():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(25)]
    sample = []
    for i in range(250):
        w = [rng.choice(words) for _ in range(12)]
        if i % 3 == 0:
            w[rng.randrange(12)] = "vile"
        sample.append((" ".join(w), int(i % 3 == 0)))
    found = [set(r.tolist()) for r in toxicity.distinct_features([t for t, _ in sample])]
    often = {}
    for r in found:
        for i in r:
            often[i] = often.get(i, 0) + 1
    rows = [[*(i for i in sorted(r) if often[i] >= toxicity.LEAST_DOCS), toxicity.BUCKETS] for r in found]
    want = plain_ftrl(rows, [y for _, y in sample], 7)
    model = toxicity.train(sample, 7)
    assert model.intercept == pytest.approx(want.pop(toxicity.BUCKETS), rel=1e-9)
    want = {i: w for i, w in want.items() if w}
    assert model.buckets.tolist() == sorted(want) and len(want) > 5
    assert np.allclose(model.values, [want[i] for i in sorted(want)], rtol=1e-5)


def test_crf_training_follows_the_gradient():
    """The step that training takes is the gradient of the likelihood: against differences."""
    rng = np.random.default_rng(4)
    first = np.array([0, 3, 4, 8])
    label = np.repeat([1, 0, 1], np.diff(first))
    unary, trans = rng.normal(size=8), rng.normal(size=(2, 2))

    def likelihood(u, t):
        total = 0.0
        for a, z in zip(first[:-1], first[1:], strict=True):
            def score(path, a=a, z=z):
                return sum(u[a + k] * path[k] for k in range(z - a)) + sum(t[path[k], path[k + 1]] for k in range(z - a - 1))
            every = [score(p) for p in itertools.product((0, 1), repeat=z - a)]
            total += score(label[a:z].tolist()) - np.log(np.sum(np.exp(every)))
        return total

    p, expected = quality.marginals(unary, trans, first)
    seen = np.zeros((2, 2))
    for a, z in zip(first[:-1], first[1:], strict=True):
        for k in range(a, z - 1):
            seen[label[k], label[k + 1]] += 1
    for k in range(8):
        up = unary + 1e-5 * (np.arange(8) == k)
        assert (likelihood(up, trans) - likelihood(unary, trans)) / 1e-5 == pytest.approx(label[k] - p[k], abs=1e-3)
    for i, j in itertools.product((0, 1), repeat=2):
        up = trans.copy()
        up[i, j] += 1e-5
        assert (likelihood(unary, up) - likelihood(unary, trans)) / 1e-5 == pytest.approx((seen - expected)[i, j], abs=1e-3)


def test_scores_do_not_depend_on_the_chunk(monkeypatch):
    rng = random.Random(1)
    texts = [None, "", *("\n".join(" ".join(rng.choice(["good", "word.", "###", "A"]) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 30))) for _ in range(60))]
    model = quality.train([(t or "", i % 2) for i, t in enumerate(texts)])
    whole = model.score_texts(pa.array(texts, pa.string()))
    alone = np.concatenate([model.score_texts(pa.array([t], pa.string())) for t in texts])
    assert np.array_equal(whole, alone) and len(model.score_texts(pa.array([], pa.string()))) == 0
