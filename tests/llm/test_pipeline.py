"""The pipeline's stages against the operators, and the two queries that SQL can express."""

from __future__ import annotations

import collections
import re

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from tempolink.llm import exact_dedup, jaccard, pii, quality
from tempolink.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    cell = lambda v: "" if pd.isna(v) else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)
    rows = lambda df: sorted(tuple(map(cell, r)) for r in df[cols].astype(object).itertuples(index=False))
    assert rows(got) == rows(want)


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "exact dedup", "n-gram Jaccard join", "PII", "best-fit packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    states, now = [], docs
    for _, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.materialise(stage(spark, now, SF), "test")
        states.append(now)
    assert all(s.columns == docs.columns for s in states[:-1])
    rows = [{r["doc_id"]: r for r in s.collect()} for s in states[:-1]]
    # quality: what its scores say
    field = quality.score_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert set(rows[0]) == {r["doc_id"] for r in field.where("predicted = 1").collect()}
    # exact: the smallest id of each normal text
    groups = collections.defaultdict(list)
    for i, r in rows[0].items():
        groups[exact_dedup.digest_of(r["text"])].append(i)
    assert set(rows[1]) == {min(v) for v in groups.values()}
    # near: the smallest id of each component, by all pairs
    ids = sorted(rows[1])
    sets = {i: shingles(rows[1][i]["text"] or "", 5) for i in ids}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert set(rows[2]) == {i for i in ids if find(i) == i}
    # personal data: every text redacted, nothing dropped
    assert set(rows[3]) == set(rows[2])
    for i, r in rows[3].items():
        before = rows[2][i]["text"]
        assert r["text"] == pii.redact(before, [x for x in pii.find_spans(before) if x[2] != "url"]) and r["n_chars"] == len(r["text"])
    # packing: every document, whole
    packed = states[-1].collect()
    assert {r["doc_id"] for r in packed} == set(rows[3])
    assert max(collections.Counter(r["sequence_id"] for r in packed for _ in range(r["length"])).values()) <= 1024
    assert jaccard.Rule(5, 80, 100).words == 5


@pytest.mark.parametrize("number", range(5))
def test_stages_of_an_empty_table(spark, number):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    made = corpus_pipeline.STAGES[number][1](spark, docs, SF)
    assert made.count() == 0 and (number == 4 or made.columns == docs.columns)


def test_registered():
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert set(QUERIES) <= set(__spark_entry__.queries())


def test_shuffles_of_written_tables_go(spark):
    """What was shuffled for a written table is gone with it, not when the driver collects its garbage."""
    import time

    from tempolink import storage
    from tempolink.llm import common

    known = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses()  # noqa: SLF001
    for write in (storage.materialise, common.materialise):
        before = known.size()
        made = [write(spark.range(1000).repartition(7, "id"), "some") for _ in range(5)]
        for _ in range(50):
            if known.size() <= before:
                break
            time.sleep(0.1)
        assert known.size() <= before
        assert all(m.count() == 1000 for m in made)
    assert spark.conf.get(storage.REMOVED) == "false"
