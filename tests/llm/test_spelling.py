"""Spelling variants against all possible edits."""

from __future__ import annotations

import collections
import random
import re
import zlib

import pytest

from tempolink.llm import spelling
from tempolink.llm.spelling import Limits, Rule

SCHEMA = "doc_id long, text string, word string, n int, key long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in rows], SCHEMA)


def brute(rows, rule):
    counts = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= rule.length:
                counts[word] += 1
    counts = {w: n for w, n in counts.items() if n >= rule.times}
    letters = sorted({c for w in counts for c in w})
    found = {}
    for w in counts:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[j:] for i in range(len(w) + 1) for j in (i, i + 1) for c in letters}
        near = [x for x in edits if x != w and x in counts]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        follows = best is not None and counts[best] >= rule.ratio * counts[w]
        found[w] = (best if follows else None, counts[w], len(near), counts[best] if follows else None)
    out = []
    for w, (form, *rest) in found.items():
        root = w
        while found[root][0] is not None:
            root = found[root][0]
        out.append((w, form, root, *rest))
    return sorted(out, key=lambda r: r[0])


def rows_of(found):
    return sorted(((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found.collect()), key=lambda r: r[0])


@pytest.mark.parametrize(("alphabet", "limits"), [("ab", Limits()), ("abé", Limits()), ("ab", Limits(group=20, automaton=10)), ("abÿ", Limits(group=3, automaton=1))])
def test_variants(spark, alphabet, limits):
    rng = random.Random(len(alphabet))
    rows = [(i if i % 9 else None, " ".join("".join(rng.choices(alphabet, [20, 20, 1][: len(alphabet)], k=rng.randint(6, 10))) for _ in range(120)) + " ABABABAB, ABABABA" * rng.randint(0, 20)) for i in range(12)]
    rule = Rule(ratio=2)
    want = brute(rows, rule)
    assert len(want) > 100 and any(r[2] not in (r[0], r[1]) for r in want)
    assert rows_of(spelling.spelling_variants(table(spark, rows), rule, limits=limits)) == want


def test_automaton_numbers_words():
    rng = random.Random(2)
    words = sorted({"".join(rng.choices("abc", k=rng.randint(1, 7))) for _ in range(400)})
    a = spelling.Automaton(words)
    assert [a.rest(a.start, 0, w, 0) for w in words] == list(range(len(words)))
    assert a.rest(a.start, 0, "zz", 0) == -1 and len(a.arcs) < sum(map(len, words)) / 4
    # minimal: no two states accept the same endings
    assert len({(f, *x.items()) for f, x in zip(a.final, a.arcs, strict=True)}) == len(a.arcs)
    for w in words[:60]:
        want = {k for k, x in enumerate(words) if x != w and (len(x) == len(w) and sum(p != q for p, q in zip(x, w, strict=True)) == 1 or len(x) == len(w) + 1 and any(x[:i] + x[i + 1 :] == w for i in range(len(x))))}
        assert a.near(w, 0) == want
        assert a.near(w, 2) <= {k for k in want if words[k][:2] == w[:2]}
    assert spelling.Automaton([]).near("abc", 0) == set() and spelling.Automaton([]).rest(0, 0, "a", 0) == -1


def test_cases(spark):
    assert rows_of(spelling.spelling_variants(table(spark, []))) == []
    rows = [(1, None), (2, ""), (3, "short words only"), (4, "1234567 ×÷×÷×÷× " * 2), (None, "Straßenbahn STRASSENBAHN strassenbahn strassenbahnÉ Éstrassenbahn")]
    rows += [(5, "repeated rows of equal texts"), (5, "repeated rows of equal texts")]
    rows += [(6, "giantwo" * 3000 + " giantword" * 30000 + " giantwort giantwort"), (7, "giantwo" * 3000)]
    assert rows_of(spelling.spelling_variants(table(spark, rows))) == brute(rows, Rule())


def test_chains_of_forms(spark):
    """Each form is in turn a variant: followed to the end."""
    words = ["abcdefgh" + "xyz"[:k] for k in range(4)]
    rows = [(0, " ".join(w for w, n in zip(words, (2, 20, 200, 2000), strict=True) for _ in range(n)))]
    got = {r[0]: r[2] for r in rows_of(spelling.spelling_variants(table(spark, rows)))}
    assert got == {r[0]: r[2] for r in brute(rows, Rule())} and len(set(got.values())) == 1 and len(got) >= 3
