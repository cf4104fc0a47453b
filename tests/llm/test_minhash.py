"""The chosen-path join against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from tempolink.llm import minhash
from tempolink.llm.jaccard import Rule
from tempolink.llm.minhash import Search

SCHEMA = "doc_id long, text string, set_id string, node int, kept string"
RULE = Rule(words=5, num=85, den=100)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1, "x") for i, t in rows], SCHEMA)


def by_all_pairs(rows, rule):
    sets = []
    for _, text in rows:
        words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(words[i : i + rule.words]) for i in range(max(1, len(words) - rule.words + 1))} if words else set())
    leader = list(range(len(rows)))

    def find(x):
        while leader[x] != x:
            x = leader[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and rule.den * len(x & y) >= rule.num * len(x | y):
                leader[find(i)] = find(j)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted(((i, len(sets[k]), low.get(find(k)), i == low.get(find(k))) for k, (i, _) in enumerate(rows)), key=str)


def families(seed, copies=(1, 2, 3, 30), families=9):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(500)]
    texts = []
    for _ in range(families):
        base = rng.choices(vocab, k=rng.randint(3, 150))
        for _ in range(rng.choice(copies)):
            words = base[:]
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("search", [Search(), Search(small=6, depth=2), Search(small=9, depth=0), Search(shingles=900, depth=1)])
def test_components(spark, search):
    texts = families(5)
    rows = [(k if k % 17 else None, t) for k, t in enumerate(texts)]
    rows += [(900, None), (901, ""), (902, " \t "), (903, "a"), (904, "A"), (905, "b c"), (5, texts[5]), (5, texts[6]), (None, None), (None, "b c")]
    got = minhash.near_duplicates(table(spark, rows), RULE, search)
    assert sorted((tuple(r) for r in got.collect()), key=str) == by_all_pairs(rows, RULE)


def test_cases(spark):
    assert minhash.near_duplicates(table(spark, []), RULE).collect() == []
    assert [tuple(r) for r in minhash.near_duplicates(table(spark, [(1, None), (2, "")]), RULE).orderBy("doc_id").collect()] == [(1, 0, 1, True), (2, 0, 2, True)]
    # equal rows in number, and one very long text with a near copy of it
    giant = " ".join(f"v{k % 70_000}" for k in range(200_000))
    rows = [(7, "one two three four five six seven")] * 3000 + [(1, giant), (2, giant + " end")]
    got = minhash.near_duplicates(table(spark, rows), RULE)
    assert {tuple(r) for r in got.collect()} == {(7, 3, 7, True), (1, 70_000, 1, True), (2, 70_001, 1, False)}


def test_a_tree_keeps_linked_pairs():
    """Minwise tokens agree with the probability of the similarity, and two bits of each tell sets
    that are linked from sets that are not."""
    rng = np.random.default_rng(1)
    seeds = minhash.hash_seeds(140)
    agree, differ = [], []
    for _ in range(200):
        h = rng.integers(0, 1 << 63, 230, dtype=np.uint64)
        x, y = np.sort(h[:215]), np.sort(np.concatenate((h[:200], h[215:])))  # 200 of 230
        least = minhash.minwise(np.concatenate((x, y)), np.array([0, 215, 430]), seeds)
        agree.append((least[:, 0] == least[:, 1]).mean())
        differ.append(int(np.bitwise_count((least[12:, 0] ^ least[12:, 1]) & np.uint64(3)).sum()))
    assert abs(np.mean(agree) - 200 / 230) < 0.01 and max(differ) <= Search().apart
    assert np.mean(differ) < 20


def test_large_nodes_are_read_in_parts():
    """A node that spans batches is one node."""
    t = minhash.pa.table({"node": [1, 2, 2, 3, 3, 3, 3, 3, 4, 5, 5], "k": list(range(11)), "n": [1] * 11})
    for size in (1, 2, 3, 11):
        seen = [(p["k"].to_pylist(), large) for p, large in minhash.nodes_of(iter(t.to_batches(size)), Search(small=3))]
        assert [k for p, large in seen if large for k in p] == [3, 4, 5, 6, 7]
        assert [k for p, large in seen if not large for k in p] == [1, 2, 9, 10]


def test_common_shingles():
    rng = np.random.default_rng(3)
    sets = [np.unique(np.concatenate((rng.integers(0, 40, 12), rng.integers(0, 10_000, k % 90)))).astype(np.uint64) for k in range(300)]
    got = minhash.common_shingles(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(0, 300, 7) for j in range(300))
