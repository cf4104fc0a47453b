"""Inputs that are out of proportion: equal rows in number, very long texts, names that clash."""

from __future__ import annotations

import hashlib
import re
import time

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import tiktoken.load
from tokenizers import Tokenizer

from tempolink.llm import bpe, exact_dedup, jaccard, learn, media, minhash, packing, quality, suffix_dedup, token_count, toxicity
from tempolink.llm.jaccard import Rule


@pytest.mark.parametrize("same", [5, None])
def test_suffix_dedup_of_equal_rows(spark, same):
    """5,000 rows alike in id and text lose all; another text that shares a part with them loses that."""
    rng = np.random.default_rng(1)
    text = "".join(rng.choice(list("abcdefgh "), 2000))
    rows = [(same, text)] * 5000 + [(9, "q" * 300 + text[100:700] + "z"), (10, "short"), (10, "short"), (11, None), (11, None), (12, text[:150])]
    began = time.time()
    got = suffix_dedup.repeat_digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    assert time.time() - began < 120
    empty, digest = hashlib.sha256(b"").hexdigest(), lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == sorted(
        [(same or -1, 2000, 2000, 1, empty)] * 5000 + [(9, 901, 900, 1, digest("z")), (10, 5, 0, 0, digest("short")), (10, 5, 0, 0, digest("short")), (11, 0, 0, 0, empty), (11, 0, 0, 0, empty), (12, 150, 0, 0, digest(text[:150]))]
    )


def test_dedups_keep_columns_of_any_name(spark):
    schema = "doc_id long, text string, __sha string, __id int, __txt string, __DOC int, lost boolean, n int, __digest string"
    rows = [(k, t, "a", 1, "b", 2, True, 3, "c") for k, t in ((1, "one two three four"), (1, "one two three four"), (2, "one two  three four"), (3, "other words in this"), (None, None), (None, None))]
    docs = spark.createDataFrame(rows, schema)
    first, one = exact_dedup.keep_first(docs), jaccard.keep_one(docs, Rule(3, 90, 100))
    assert first.columns == one.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in first.collect()) == [0, 1, 3] and sorted(r["doc_id"] or 0 for r in one.collect()) == [0, 0, 1, 3]
    assert all(tuple(r)[2:] == rows[0][2:] for r in [*first.collect(), *one.collect()])


def test_sample_passes_over_what_has_no_room(spark):
    texts = {k: "word " * 10 for k in range(30)} | {30: "x" * 5000, 31: "line\n" * (learn.TEXT_LINES + 5)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in texts], "doc_id long, quality int")
    open_ = [k for k in texts if not learn.is_held_out(k)]
    every = learn.training_sample(docs, labels, "quality")
    assert sorted(t for t, _ in every) == sorted(texts[k] for k in open_ if k != 31)
    some = learn.training_sample(docs, labels, "quality", max_chars=200)
    assert len(some) == 4 and all(len(t) == 50 for t, _ in some)


def test_classifiers_learn_beside_a_text_of_many_lines(spark):
    rows = [(k, "good words stand here.\nAnd more." if k % 2 else "##|| $$ %% 88\n|| 77 ^^") for k in range(60)] + [(60, "a\n" * 200_000), (61, "word " * 300_000), (62, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(62)], "doc_id long, quality int, toxic int")
    began = time.time()
    for made in (quality.score_quality(docs, labels), toxicity.score_toxicity(docs, labels)):
        got = {r["doc_id"]: r for r in made.collect()}
        assert len(got) == 63 and all(0 <= r["score"] <= 1 for r in got.values())
        assert np.mean([got[k]["predicted"] == k % 2 for k in range(60)]) > 0.9
    assert time.time() - began < 200


def test_white_space_of_any_length():
    path = P.path("byte_bpe_50k.json")
    encode, library = packing.encoder_for(path), Tokenizer.from_file(path)
    for n in (60, 63, 64, 4000):
        text = ("x" + " " * n) * (800_000 // n)
        began = time.time()
        ids = encode(text)
        assert time.time() - began < 8
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


LONG = ["word" * 500_000, "a b c " * 300_000, " " * 1_500_000 + "x", "é1 \n" * 300_000]


def test_very_long_texts_of_the_others(spark):
    docs = spark.createDataFrame([*enumerate(LONG), (4, None), (5, "")], "doc_id long, text string").repartition(3)
    path = P.path("byte_bpe_multi_50k.tiktoken")
    coder = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=tiktoken.load.load_tiktoken_bpe(path), special_tokens={})
    got = {r["doc_id"]: r for r in bpe.encoding_digests(docs, path, P.PATTERN).collect()}
    for k in (0, 1, 3):
        ids = np.array(coder.encode_ordinary(LONG[k]), "<u4")
        assert got[k]["n_tokens"] == len(ids) and got[k]["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
    assert all(got[k]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest() for k, t in enumerate(LONG))
    exact = {r["doc_id"]: r["text_sha256"] for r in exact_dedup.dedup_exact(docs).collect()}
    assert all(exact[k] == hashlib.sha256(re.sub("[ \t-\r]+", " ", t).encode()).hexdigest() for k, t in enumerate(LONG))
    sound = {r["doc_id"]: r for r in media.media_digests(docs).collect()}
    for k, t in enumerate(LONG):
        raw = t.encode()
        raw += b"\0" * (-len(raw) % 64)
        assert (sound[k]["n_bytes"], sound[k]["payload_sha256"]) == (len(t.encode()), hashlib.sha256(raw).hexdigest())
    gone = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.repeat_digests(docs).collect()}
    assert [gone[k] for k in range(6)] == [2_000_000, 1_800_000, 1_500_000, 1_500_000, 0, 0]
    near = {r["doc_id"]: r for r in jaccard.jaccard_components(docs).collect()}
    assert [near[k]["n_shingles"] for k in range(6)] == [1, 3, 1, 1, 0, 0] and all(r["component_id"] == k for k, r in near.items())
    assert all(r["kept"] for r in minhash.near_duplicates(docs).collect())


def test_counts_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_count.count_tokens(docs, P.path("byte_bpe_50k.json")).count() == 0
