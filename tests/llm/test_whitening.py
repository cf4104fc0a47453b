"""Embedding whitening against plain exact arithmetic."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from tempolink.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, dims int, x string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "clash") for i, v in rows], SCHEMA)


def floors(v):
    return [math.floor(256.0 * float(np.float32(c))) for c in v]


@pytest.mark.parametrize("scale", [1, 2**20, 2**62])
def test_residues_are_the_products(scale):
    rng = random.Random(scale)
    x = [[rng.randint(-scale, scale) for _ in range(3)] for _ in range(50)]
    moduli = whitening.primes(2 * 50 * scale * scale)
    parts = {p: whitening.residue_products(np.array(x, np.int64), p) for p in moduli}
    for i in range(3):
        for j in range(3):
            assert whitening.from_residues([int(parts[p][i, j]) for p in moduli], moduli) == sum(r[i] * r[j] for r in x)


def test_primes():
    found = whitening.primes(1 << 100)
    assert math.prod(found) > 1 << 100 and len(set(found)) == len(found) and all(p < whitening.PRIME_TOP for p in found)
    assert all(p % q for p in found for q in range(2, math.isqrt(p) + 1))


def test_packing_is_one_form():
    for v in ([0, -1, 127], [128], [-(2**31), 5], [2**63 - 1, -(2**63)]):
        x = np.array(v, np.int64)
        assert whitening.unpack(whitening.pa.array([whitening.pack(x)]))[0].tolist() == v


def test_whitening(spark):
    rng = random.Random(4)
    vectors = [[rng.gauss(0, 1 + k) + (0.5 if k else 0) for k in range(6)] for _ in range(400)]
    vectors += [vectors[0]] * 200  # a hot vector counts once
    rows = list(enumerate(vectors)) + [(None, vectors[1]), (7, vectors[2]), (900, None), (901, [1.0, None] * 3), (902, [math.nan] * 6), (903, [math.inf] * 6), (904, []), (905, [1.0])]
    got = whitening.whiten(table(spark, rows)).collect()
    fit = sorted({tuple(floors(v)) for v in vectors})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    assert len(got) == 4 * 602 and {r["n"] for r in got} == {n}
    cov = [[Fraction(sum(r[i] * r[j] for r in fit), n) - Fraction(sums[i] * sums[j], n * n) for j in range(6)] for i in range(6)]
    values, axes = np.linalg.eigh(np.array(cov, float))
    mean = np.array(sums) / n
    sign = {}
    for r in got:
        x = floors(vectors[1] if r["vec_id"] is None else vectors[r["vec_id"]])
        k = r["component"] - 1
        if r["vec_id"] != 7:
            assert r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
            want = (np.array(x) - mean) @ axes[:, -1 - k] / math.sqrt(values[-1 - k])
            assert abs(abs(want) - abs(r["whitened"])) < 1e-9
            if abs(want) > 1e-3:
                assert sign.setdefault(k, want * r["whitened"] > 0) == (want * r["whitened"] > 0)
        assert math.isclose(r["explained"], values[-1 - k] / values.sum(), rel_tol=1e-9)
        assert r["identity_error"] < 1e-9
    assert sum(r["vec_id"] is None for r in got) == 4 and sum(r["vec_id"] == 7 for r in got) == 8


def test_cases(spark):
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, [(1, None), (2, [math.nan])])).collect() == []
    same = whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(same) == 4 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same} == {(1, 0, None, None, None)}
    # one direction only, and entries beyond a long
    line = whitening.whiten(table(spark, [(k, [float(k), 2.0 * k, 0.0]) for k in range(5)])).collect()
    assert {(r["component"], r["whitened"] is None) for r in line} == {(1, False), (2, True), (3, True)}
    huge = whitening.whiten(table(spark, [(1, [3e38, 0.0]), (2, [-3e38, 0.0])])).collect()
    assert {(r["component"], r["deviation"]) for r in huge} == {(1, None), (2, None)} and {abs(r["whitened"]) for r in huge if r["component"] == 1} == {1.0}
    # an empty task among full ones, and vectors that are already doubles
    few = spark.createDataFrame([(k, [k / 3, k * k / 7]) for k in range(3)], "vec_id long, embedding array<double>").repartition(6)
    assert whitening.whiten(few).count() == 6
