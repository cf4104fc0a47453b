"""Exact, suffix and near duplicates against brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempolink.llm import components, exact_dedup, jaccard, suffix_dedup

SCHEMA = "doc_id long, text string, digest string, set_id int, kept string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1, "x") for i, t in rows], SCHEMA)


# --- exact --------------------------------------------------------------------------------------


def test_perfect_hash():
    digests = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(5000)), np.uint8).reshape(-1, 32)
    h = exact_dedup.PerfectHash.from_bytes(exact_dedup.PerfectHash.build(digests).to_bytes())
    assert sorted(h.slots(digests).tolist()) == list(range(5000))
    assert h.slots(digests[:0]).tolist() == []
    with pytest.raises(ValueError):
        exact_dedup.PerfectHash.build(digests[[0, 0]])


def test_exact(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARD_KEYS", 16)
    rng = random.Random(1)
    texts = [None, "", "a  b", "a b", "a\tb", " a b"] + [rng.choice("xyz") * rng.randint(0, 9) + " " * rng.randint(0, 3) + "q" for _ in range(300)] + ["hot  text"] * 200
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = table(spark, rows).repartition(5)
    got = {r["doc_id"]: r for r in exact_dedup.dedup_exact(docs).collect()}
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    assert len(got) == len(rows)
    for text, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (min(ids), len(ids), i == min(ids))
            assert r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(min(v) for v in groups.values())


def test_exact_with_repeated_and_missing_ids(spark):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (2, "b"), (1, "c")]
    docs = table(spark, rows)
    got = exact_dedup.dedup_exact(docs).collect()
    assert sum(r["kept"] for r in got) == 3 and {(r["doc_id"], r["keep_id"]) for r in got} == {(1, 1), (None, 1), (None, 2), (2, 2)}
    assert sorted((r["doc_id"], r["text"]) for r in exact_dedup.keep_first(docs).collect()) == [(1, "a"), (1, "c"), (2, "b")]
    assert exact_dedup.dedup_exact(docs.limit(0)).count() == 0


# --- suffix arrays ------------------------------------------------------------------------------


@pytest.mark.parametrize("alphabet", ["ab", "a", "abc", "\x00a", "abcdefgh"])
def test_window_classes(alphabet):
    rng = random.Random(alphabet)
    for _ in range(60):
        n = rng.choice([8, 9, 16, 20])
        base = "".join(rng.choice(alphabet) for _ in range(60)).encode()
        texts = [base[a : a + rng.randint(n, 30)] for a in (rng.randint(0, 30) for _ in range(rng.randint(1, 6)))]
        texts = [t for t in texts if len(t) >= n]
        if not texts:
            continue
        owner, start, cls = suffix_dedup.window_classes(texts, n)
        want = {(i, k): t[k : k + n] for i, t in enumerate(texts) for k in range(len(t) - n + 1)}
        assert set(zip(owner.tolist(), start.tolist(), strict=True)) == set(want)
        held = collections.defaultdict(set)
        for i, k, c in zip(owner.tolist(), start.tolist(), cls.tolist(), strict=True):
            held[c].add(want[i, k])
        assert all(len(v) == 1 for v in held.values()) and len(held) == len(set(want.values()))


def brute_repeats(texts, n=200):
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(b[k : k + n] for b in raw for k in range(len(b) - n + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - n + 1):
            if count[b[k : k + n]] > 1:
                gone[k : k + n] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(int)))) == 1))
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeiouxyzé") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, period = prose(70), prose(3)
    texts = [None, "", "short", "ab" * 400, "ab" * 90 + "c" + "ab" * 140, period * 20, passage, passage]
    for _ in range(40):
        t = prose(rng.randint(5, 120))
        if rng.random() < 0.5:
            a = rng.randint(0, 100)
            t = t + passage[a : a + rng.randint(150, 400)] + prose(10)
        texts.append(t)
    copies = [rng.choice(texts[8:]) for _ in range(6)]
    return texts + copies + [c[: len(c) // 2] + "Q" + c[len(c) // 2 :] for c in copies]


@pytest.mark.parametrize("limits", [suffix_dedup.Limits(), suffix_dedup.Limits(group=3, pool=2000), suffix_dedup.Limits(group=2, pool=700, held=16), suffix_dedup.Limits(group=4, held=48)])
def test_suffix_dedup(spark, limits):
    """Whole groups, groups in parts down several turns, and hashes settled while they stream in."""
    texts = corpus(limits.group)
    docs = table(spark, list(enumerate(texts)))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.repeat_digests(docs, limits=limits).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts)


def test_hot_places_settle_early():
    found = suffix_dedup.Repeats(suffix_dedup.Limits(group=2, held=16))
    keys = [7] * 30 + [1, 2, 2, 3] + [7] * 9 + [5] * 3
    out = []
    for at, k in enumerate(keys):
        p = np.zeros(1, suffix_dedup.PLACE)
        p["key"], p["lo"] = k, at
        out += found.add(p)
    out += found.end()
    place, share = (np.concatenate(x) for x in zip(*out, strict=True))
    assert sorted(place["lo"].tolist()) == [k for k, x in enumerate(keys) if x not in (1, 3)]
    parts = collections.Counter((int(k), int(s)) for k, s in zip(place["key"], share, strict=True))
    assert all(n <= 2 for (_, s), n in parts.items() if s) and parts[2, 0] == 2


def test_suffix_dedup_cases(spark):
    texts = ["x" * 250, "x" * 250]
    twice = suffix_dedup.repeat_digests(spark.createDataFrame([(5, texts[0]), (5, texts[0]), (None, "y z " * 60)], "doc_id long, text string"))
    assert sorted((r["doc_id"] or -1, r["n_removed"]) for r in twice.collect()) == [(-1, 240), (5, 250), (5, 250)]
    assert suffix_dedup.repeat_digests(table(spark, [(1, "a")]).limit(0)).count() == 0


# --- near ---------------------------------------------------------------------------------------


def brute_components(texts, rule):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + rule.words]) for k in range(max(1, len(w) - rule.words + 1))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and rule.den * i >= rule.num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [(len(s), find(k)) for k, s in enumerate(sets)]


def near_copies(seed, n_families=12, per=12):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioubcdf") for _ in range(rng.randint(2, 5)))
    texts = [None, "", "  \t", "one", "one", "One two", "one  TWO", "a b c", "a b c d", "É é x", "é é x"]
    for _ in range(n_families):
        base = [word() for _ in range(rng.choice([8, 12, 30, 60, 150, 400]))]
        for _ in range(per):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 20))):
                w[rng.randrange(len(w))] = word()
            if rng.random() < 0.3:
                w = w[: len(w) - rng.randint(0, len(w) // 8)]
            texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("rule", [jaccard.Rule(3, 90, 100), jaccard.Rule(5, 80, 100), jaccard.Rule(1, 50, 100)])
def test_jaccard(spark, rule):
    texts = near_copies(rule.words)
    order = list(enumerate(texts))
    random.Random(2).shuffle(order)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(table(spark, order).repartition(3), rule).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts, rule)


def test_cells_miss_no_link():
    """Every linked pair of different sets shares a cell, at all sizes and with few or many classes."""
    rng = np.random.default_rng(0)
    for rule in (jaccard.Rule(3, 90, 100), jaccard.Rule(3, 80, 100), jaccard.Rule(3, 50, 100)):
        for n in (2, 5, 9, 10, 13, 17, 40, 99, 300, 1100):
            for _ in range(20):
                x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
                most = rule.most_apart(len(x))
                cut_ = int(rng.integers(0, most + 1))
                add = int(rng.integers(0, most - cut_ + 1))
                y = np.unique(np.concatenate((x[cut_:], rng.integers(0, 2**63, add).astype(np.uint64))))
                inter = len(np.intersect1d(x, y))
                if not rule.linked(inter, len(x), len(y)) or (len(x) == len(y) == inter):
                    continue
                keys, who = jaccard.cell_keys(np.concatenate((x, y)), np.array([0, len(x), len(x) + len(y)]), rule)
                assert set(keys[who == 0].tolist()) & set(keys[who == 1].tolist())


def test_leaf_links_are_exact():
    """A leaf, whole and in blocks, against all pairs."""
    rng, rule = np.random.default_rng(1), jaccard.Rule(3, 80, 100)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    sets = [base]
    for _ in range(120):
        s = sets[rng.integers(0, len(sets))].copy()
        s[rng.integers(0, len(s), int(rng.integers(0, 6)))] = rng.integers(0, 2**63, dtype=np.uint64)
        sets.append(np.unique(s))

    def roots(links):
        r = list(range(len(sets)))
        for a, b in links:
            x, y = _top(r, a), _top(r, b)
            r[max(x, y)] = min(x, y)
        return [_top(r, k) for k in range(len(r))]

    every = [(a, b) for a in range(len(sets)) for b in range(a) if rule.linked(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]))]
    assert roots(jaccard.link_leaf(sets, rule)) == roots(every)
    found = []
    for i in range(3):
        for j in range(i, 3):
            ids = [0, *(k for k in range(1, len(sets)) if k % 3 in (i, j))]
            side = np.array([0, *((jaccard.DEALT if k % 3 == i else jaccard.OTHER) for k in ids[1:])]) if i != j else None
            found += [(ids[a], ids[b]) for a, b in jaccard.link_leaf([sets[k] for k in ids], rule, side)]
    assert roots(found) == roots(every)


def _top(r, k):
    while r[k] != k:
        k = r[k]
    return k


@pytest.mark.parametrize("limits", [jaccard.Limits(sets=4, pivots=3), jaccard.Limits(sets=6, pivots=2, copies=100.0), jaccard.Limits(sets=3, pivots=2, copies=0.1), jaccard.Limits(shingles=40)])
@pytest.mark.parametrize("rule", [jaccard.Rule(3, 90, 100), jaccard.Rule(2, 60, 100)])
def test_jaccard_down_the_recursion(spark, rule, limits):
    """Regions of more sets than a leaf holds, divided by pivots, in parts and in blocks."""
    rng = random.Random(5)
    base = [f"b{k}" for k in range(60)]
    texts = []
    for n in range(90):  # one family: near and far variants, and chains of them
        w = list(base if n % 3 else (texts[-1].split() if texts else base))
        for _ in range(rng.randint(0, 2 if n % 5 else 9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(400)}"
        texts.append(" ".join(w))
    texts += near_copies(3, 3, 8)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(table(spark, list(enumerate(texts))), rule, limits=limits).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts, rule)


def test_sets_that_share_a_key(spark):
    """Two sets whose short ids are equal stay apart: one is linked, the other isn't."""
    rule = jaccard.Rule(1, 50, 100)
    sets = {b"a": [1, 2, 3, 4], b"b": [1, 2, 3, 5], b"c": [90, 91, 92]}
    rows = [(7 if k in b"ac" else 8, k, np.array(v, np.uint64).tobytes()) for k, v in sets.items()]
    members = spark.createDataFrame([(7, 7), (8, 7)], "set_key long, region long")
    found = jaccard.region_links(members, spark.createDataFrame(rows, "set_key long, set_id binary, hashes binary"), rule).collect()
    assert [{bytes(r["u"]), bytes(r["v"])} for r in found] == [{b"a", b"b"}]


def test_hot_cells_settle_early():
    cells, out = jaccard.Cells(10, 4), []
    keys = np.array([1] * 12 + [2, 2, 3], np.uint64)
    sets = np.array([*range(12), 5, 6, 7])
    for at in range(0, 15, 3):
        out.append(cells.add(keys[at : at + 3], sets[at : at + 3]))
    out.append(cells.settle(2))
    members = {(int(s), int(p)) for a, b in out for s, p in zip(a, b, strict=True)}
    assert members == {(s, 0) for s in range(12)} | {(5, 5), (6, 5)}


def test_keep_one(spark):
    texts = [" ".join(f"w{k}" for k in range(100)), " ".join(f"w{k}" for k in range(97)), "other words here now and then", None, ""]
    docs = table(spark, list(enumerate(texts)))
    kept = jaccard.keep_one(docs, jaccard.Rule(5, 80, 100))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3, 4] and kept.columns == docs.columns
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0


def test_keep_one_with_repeated_and_missing_ids(spark):
    words = [f"w{k}" for k in range(120)]
    near = lambda lead, n: " ".join([*(f"{lead}{w}" for w in words[:n])])
    rows = [
        *[(1, near("a", 100)), (2, near("a", 97)), (2, "a clean text of its own")],  # the id of a near copy
        *[(5, near("b", 100)), (5, near("b", 97))],  # near copies with one id
        *[(7, near("c", 100)), (None, near("c", 97))],  # one without an id
        *[(None, near("d", 100)), (None, near("d", 97))],  # both without
        *[(9, near("e", 100)), (9, near("e", 100)), (9, near("e", 97))],  # the same row twice
        *[(None, None), (None, ""), (3, None)],
    ]
    kept = jaccard.keep_one(table(spark, rows).repartition(3), jaccard.Rule(5, 80, 100))
    assert kept.columns == table(spark, rows).columns
    got = collections.Counter((r["doc_id"], r["text"][0] if r["text"] else r["text"], len((r["text"] or "").split()) < 9) for r in kept.collect())
    assert got == {(1, "a", False): 1, (2, "a", True): 1, (5, "b", False): 1, (7, "c", False): 1, (None, "d", False): 1, (9, "e", False): 1, (None, None, True): 1, (None, "", True): 1, (3, None, True): 1}


@pytest.mark.parametrize("words", [3, 5, 8])
def test_short_texts_alone_in_a_chunk(words):
    texts = [" ".join("abcdefghij"[:n]).encode() for n in range(10)]
    ends = np.cumsum([0, *map(len, texts)])
    h, bounds = jaccard.shingle_sets(np.frombuffer(b"".join(texts), np.uint8), ends, words)
    for k, t in enumerate(texts):
        alone, own = jaccard.shingle_sets(np.frombuffer(t, np.uint8), np.array([0, len(t)]), words)
        assert own.tolist() == [0, len(alone)] and alone.tolist() == h[bounds[k] : bounds[k + 1]].tolist()


def test_jaccard_of_short_texts_alone_in_a_batch(spark):
    docs = table(spark, [(3, "One two"), (1, "one two three"), (2, "one  two")])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        got = sorted(tuple(r) for r in jaccard.jaccard_components(docs, jaccard.Rule(5, 80, 100)).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [(1, 1, 1), (2, 1, 2), (3, 1, 2)]


def test_rows_without_ids_connect_others(spark):
    words = [f"w{k}" for k in range(120)]
    a, b, c = " ".join(words[:112]), " ".join(words[4:116]), " ".join(words[8:120])
    rule = jaccard.Rule(3, 92, 100)
    rows = [(4, a), (None, b), (2, c), (9, "x y z"), (None, "lone one"), (2, c)]
    got = sorted(((r["doc_id"] or -1, r["component_id"]) for r in jaccard.jaccard_components(table(spark, rows), rule).collect()), key=str)
    assert got == sorted([(4, 2), (-1, 2), (2, 2), (9, 9), (-1, None), (2, 2)], key=str)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 205), (205, 203)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200, 205: 200, 203: 200}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("rule", [jaccard.Rule(3, 90, 100), jaccard.Rule(5, 80, 100), jaccard.Rule(1, 50, 100)])
def test_bucket_counts_lose_no_link(rule):
    """Sets with a linked partner stay, also of other bucket numbers and with full bytes; unrelated ones go."""
    rng = np.random.default_rng(7)
    draw = lambda n: rng.integers(0, 1 << 63, n).astype(np.uint64)
    sets = [np.unique(draw(n)) for n in (1, 3, 9, 40, 250, 257, 400, 515, 3000)]
    crowded = np.unique(draw(5000) << np.uint64(12))  # all in one bucket
    sets += [crowded, crowded[:4600]]
    for x in [s for s in sets if len(s) > 30]:
        for drop in (0.02, 0.09, 0.18, 0.4):
            sets.append(x[rng.random(len(x)) > drop])
            sets.append(np.unique(np.concatenate((x[rng.random(len(x)) > drop / 2], draw(int(len(x) * drop / 2))))))
    size = np.array([len(x) for x in sets])
    bounds = np.concatenate(([0], np.cumsum(size)))
    got = jaccard.may_link(size, jaccard.bucket_counts(np.concatenate(sets), bounds), rule)
    linked = [any(i != j and rule.linked(np.int64(len(np.intersect1d(x, y))), len(x), len(y)) for j, y in enumerate(sets)) for i, x in enumerate(sets)]
    assert sum(linked) > 20
    assert all(got[k] for k in range(len(sets)) if linked[k])
    alone = [np.unique(draw(n)) for n in (30, 200, 210, 220, 900, 1000)]
    if rule.num >= 80:
        assert not jaccard.may_link(np.array([len(x) for x in alone]), jaccard.bucket_counts(np.concatenate(alone), np.concatenate(([0], np.cumsum([len(x) for x in alone])))), rule).any()


def test_sets_without_partner_leave_before_they_are_fetched(spark):
    """Texts that share a passage share a region; only those that may be linked go on."""
    rng, rule = np.random.default_rng(3), jaccard.Rule(5, 80, 100)
    words = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 10**6, n))
    texts = [words(200) for _ in range(20)]
    texts.append(texts[4] + " more")
    known = jaccard.sets_of(table(spark, list(enumerate(texts))).withColumn("txt", F.xxhash64("text")), rule)
    members = known.select("set_key", F.lit(1).cast("long").alias("region"))
    kept = jaccard.with_partners(members, known, rule, jaccard.Limits()).join(known, "set_key")
    assert sorted(r["doc_id"] for r in kept.collect()) == [4, 20]
    whole = jaccard.with_partners(members, known, rule, jaccard.Limits(sets=5))
    assert whole.count() == 21  # beyond a leaf: left to the recursion


def test_stars_take_no_round(spark, monkeypatch):
    """Edges that are stars are done; a chain takes rounds until it is one, and none to see that."""
    made = []
    turn = components._large_star
    monkeypatch.setattr(components, "_large_star", lambda edges: made.append(1) or turn(edges))
    stars = spark.createDataFrame([(1, 5), (7, 1), (9, 8), (8, 9)], "u long, v long")
    assert {r["node"]: r["root"] for r in components.components(stars).collect()} == {1: 1, 5: 1, 7: 1, 8: 8, 9: 8}
    assert not made
    chain = spark.createDataFrame([(1, 2), (2, 3)], "u long, v long")
    assert {r["node"]: r["root"] for r in components.components(chain).collect()} == {1: 1, 2: 1, 3: 1}
    assert len(made) == 1
