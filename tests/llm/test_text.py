"""PII, tokens, packing, media: against regexes, the libraries, and exact round trips."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tempolink.llm import bpe, media, packing, pii, token_count
from tempolink.llm.queries import QUERIES

ODD = [None, "", " ", "a", "a", "déjà vu 日本 \x1c\x85", "x" * 5000, "word " * 3000, "\n\n\t", "<|endoftext|> and <|endoftext|>", "mail a.b@c.org, +1 (555) 010-9999, 10.0.0.1"]


def table(spark, texts=ODD):
    """Ids, texts, and columns whose names an operator might use itself."""
    rows = [(i, t, "clash", 7, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string, n_tokens int, ids string")


# --- personal data ------------------------------------------------------------------------------


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def by_regex(x):
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        s = re.sub("[ -]", "", m[0])
        if 12 <= len(s) <= 19 and luhn(s):
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return [(a, z, k) for a, _, z, k in sorted(out)]


@settings(max_examples=400, deadline=None)
@given(st.one_of(*(st.text(alphabet=a, max_size=60) for a in ("a@.b-", "12.", "0123456789 -", "+1() .-9", "a@.b-12.+ (", "1٢. é"))))
def test_base_spans(text):
    assert [s for s in pii.find_spans(text) if s[2] in pii.BASE_KINDS] == by_regex(text)


def test_added_spans():
    t = 'see https://x.org/a?b=1). IBAN DE89 3704 0044 0532 0130 00, DE88370400440532013000 account no: 12345678 accounts 99999999 token = "3fdf5a35c7b8d733c0b5c7d364"'
    got = [(t[a:z], k) for a, z, k in pii.find_spans(t)]
    assert ("https://x.org/a?b=1", "url") in got and ("DE89 3704 0044 0532 0130 00", "account") in got
    assert ("12345678", "account") in got and ("3fdf5a35c7b8d733c0b5c7d364", "secret") in got
    assert not any("DE88" in x or "99999999" in x for x, _ in got)


def test_span_query(spark):
    got = {r["doc_id"]: r for r in pii.span_digests(table(spark)).collect()}
    assert len(got) == len(ODD)
    for i, t in enumerate(ODD):
        base = by_regex(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{z}" for a, z, k in base).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.BASE_KINDS] == [sum(s[2] == k for s in base) for k in pii.BASE_KINDS]
    assert pii.span_digests(table(spark).limit(0)).count() == 0


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "mail a.b@c.org now", 18, "en"), (2, None, None, None)], "doc_id long, text string, n_chars long, lang string")
    rows = {r["doc_id"]: r for r in pii.redact_documents(docs).collect()}
    assert rows[1]["text"] == "mail [EMAIL] now" and rows[1]["n_chars"] == len(rows[1]["text"]) and rows[2]["text"] is None
    assert pii.redact_documents(docs).columns == docs.columns


# --- tokens -------------------------------------------------------------------------------------

MULTI = P.path("byte_bpe_multi_50k.tiktoken")
JSON = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_every_token_is_its_own_encoding():
    """What makes neighbours decide: holds for the whole vocabulary."""
    tree = bpe.tree_for(MULTI, P.PATTERN)
    assert all(tree.reduce(piece) == [rank] for piece, rank in tree.ranks.items())


@pytest.mark.parametrize("alphabet", ["ab", "a", "aA \n", "0123", "the ", "é¹ß", "  \t", "\x1c\x1f \x85a", "日本語の", "=-*#", "for ing tion"])
def test_tree_is_the_encoding(reference_encoding, alphabet):
    tree, rng = bpe.tree_for(MULTI, P.PATTERN), random.Random(alphabet)
    for n in [0, 1, 2, 3, 7, 65, 400, 3000] + [rng.randint(0, 300) for _ in range(60)]:
        text = "".join(rng.choice(alphabet) for _ in range(n))
        ids = tree.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == reference_encoding.encode_ordinary(text)
        assert tree.decode(ids) == text.encode()


def test_join_is_associative():
    tree, rng = bpe.tree_for(MULTI, P.PATTERN), random.Random(4)
    for _ in range(200):
        parts = ["".join(rng.choice("theringao") for _ in range(rng.randint(1, 12))).encode() for _ in range(3)]
        a, b, c = map(tree.reduce, parts)
        assert tree.join(tree.join(a, b), c) == tree.join(a, tree.join(b, c)) == tree.merge(b"".join(parts))


def test_encoding_query(spark, reference_encoding):
    got = {r["doc_id"]: r for r in bpe.encoding_digests(table(spark), MULTI, P.PATTERN).collect()}
    full = {r["doc_id"]: r for r in bpe.encode_documents(table(spark), MULTI, P.PATTERN).collect()}
    for i, t in enumerate(ODD):
        ids = np.array(reference_encoding.encode_ordinary(t or ""), "<u4").tobytes()
        assert got[i]["n_tokens"] == len(ids) // 4 and got[i]["ids_sha256"] == hashlib.sha256(ids).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
        assert bytes(full[i]["ids"]) == ids and bytes(full[i]["decoded"]).decode() == (t or "")
    assert bpe.encoding_digests(table(spark).limit(0), MULTI, P.PATTERN).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts(spark, name):
    path = P.path(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        want = [len(model.encode(t or "")) for t in ODD]
    else:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        want = [len(model.encode(t or "", add_special_tokens=False).ids) for t in ODD]
    rows = sorted(token_count.count_tokens(table(spark), path, 512).collect())
    assert [r["n_tokens"] for r in rows] == want
    assert [r["n_bytes"] for r in rows] == [len((t or "").encode()) for t in ODD]
    assert [r["over_limit"] for r in rows] == [n > 512 for n in want]


def test_whole_tokens_are_proven():
    c = token_count.counter_for(JSON)
    assert len(c.whole) > 45_000 and " the" in c.whole and "<|endoftext|>" not in c.whole


# --- packing ------------------------------------------------------------------------------------


def first_fit(lengths, size):
    bins = []
    for n in sorted(lengths, reverse=True):
        at = min((k for k in range(len(bins)) if bins[k] >= n), key=lambda k: bins[k], default=None)
        if at is None:
            bins.append(size - n)
        else:
            bins[at] -= n
    return len(bins)


@pytest.mark.parametrize("seed", range(6))
def test_histogram_packing(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 65, 700) if seed % 2 else np.minimum(64, rng.geometric(0.05, 700))
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    for capacity in (packing.Capacity(64), packing.Capacity(64, documents=3), packing.Capacity(64, attention=64 * 64), packing.Capacity(80, 4, 70 * 70)):
        bins = packing.pack_histogram(counts, capacity)
        used: dict[int, list] = {}
        segments = np.array(sorted(bins.segments), np.int64)
        for n, many in counts.items():
            seq, offset = packing.place(segments, np.full(many, n), np.arange(many))
            for s, o in zip(seq.tolist(), offset.tolist(), strict=True):
                used.setdefault(s, []).append((o, n))
        assert sorted(used) == list(range(bins.n_bins))
        full = capacity.vector()
        for pieces in used.values():
            at = 0
            for o, n in sorted(pieces):
                assert o == at
                at += n
            assert at <= full[0] and len(pieces) <= full[1] and sum(n * n for _, n in pieces) <= full[2]
        if capacity == packing.Capacity(64):
            assert bins.n_bins <= first_fit(lengths.tolist(), 64)
    with pytest.raises(ValueError):
        packing.pack_histogram({65: 1}, packing.Capacity(64))


def test_packing_query(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(JSON)
    texts = ODD + [f"row {i} " * (i % 50) for i in range(200)]
    rows = packing.pack_documents(table(spark, texts).repartition(3), JSON, 2, packing.Capacity(256)).collect()
    by_doc: dict[int, list] = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(texts):
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at)
            assert r["length"] == 256 or k == 0
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    seqs: dict[int, list] = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in seqs.values():
        assert [o for o, _ in sorted(pieces)] == np.cumsum([0, *(n for _, n in sorted(pieces))])[:-1].tolist()
        assert sum(n for _, n in pieces) <= 256
    assert packing.pack_documents(table(spark).limit(0), JSON).count() == 0


# --- audio --------------------------------------------------------------------------------------


def test_companding():
    assert media.MULAW_PCM[[0x00, 0x80, 0x7F, 0xFF]].tolist() == [-32124, 32124, 0, 0]
    assert media.ALAW_PCM[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    assert len(set(media.ALAW_PCM.tolist())) == 256 and len(set(media.MULAW_PCM.tolist())) == 255


def adpcm_by_sample(block):
    sample, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [sample]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(media.STEPS[index])
            diff = step >> 3
            diff += step if code & 4 else 0
            diff += step >> 1 if code & 2 else 0
            diff += step >> 2 if code & 1 else 0
            sample = max(-32768, min(32767, sample - diff if code & 8 else sample + diff))
            index = max(0, min(88, index + int(media.INDEX_STEP[code & 7])))
            out.append(sample)
    return out


def test_adpcm_across_blocks():
    blocks = np.random.default_rng(0).integers(0, 256, (50, 64), dtype=np.uint8)
    got = media.decode_adpcm(blocks)
    assert got.tolist() == [adpcm_by_sample(b.tobytes()) for b in blocks]


def test_resampling_keeps_samples():
    pcm = np.array([0, 100, -100, 32767, -32768], np.int16)
    assert media.resample(pcm, 1, 2)[::2].tolist() == pcm.tolist()
    assert media.resample(pcm, 1, 2)[1::2].tolist() == [50, 0, 16333, -1, -32768]


def test_media_query(spark):
    got = {r["doc_id"]: r for r in media.media_digests(table(spark)).collect()}
    stored = {r["doc_id"]: r for r in media.media_column(table(spark)).collect()}
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        want = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        tag, rate, chunks = media.read_wave(bytes(stored[i]["media"]))
        assert (tag, rate, chunks[b"data"]) == (media.MULAW, 8000, want)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(want))
        assert r["payload_sha256"] == hashlib.sha256(want).hexdigest() and r["tail_crc32"] == zlib.crc32(want[-64:])
        assert r["media_bytes"] == len(stored[i]["media"]) and r["media_sha256"] == hashlib.sha256(bytes(stored[i]["media"])).hexdigest()
        assert r["feature"].endswith("ok=1")
        tag, rate, chunks = media.read_wave(bytes(stored[i]["pcm"]))
        assert (tag, rate) == (media.PCM, 16000) and np.frombuffer(chunks[b"data"], "<i2")[::2].tolist() == media.MULAW_PCM[np.frombuffer(want, np.uint8)].tolist()
    assert got[3]["feature"] == got[4]["feature"]
    assert media.media_digests(table(spark).limit(0)).count() == 0


def test_media_query_stores_pcm(spark):
    got = {r["doc_id"]: r for r in media.media_digests(table(spark)).collect()}
    for i, t in enumerate(ODD):
        payload = media.payload_of((t or "").encode())
        file = media.store(payload)
        rate, pcm = media.read_pcm(media.read_wave(file)[2][b"pcm2"])
        mu = media.expand(payload, media.MULAW)
        assert rate == 16000 and pcm.tolist() == media.resample(mu, 8000, 16000).tolist() and pcm[::2].tolist() == mu.tolist()
        # 16 bits at twice the rate are four bytes for one of the payload
        assert got[i]["media_bytes"] == len(file) >= 5 * len(payload)
        assert got[i]["media_sha256"] == hashlib.sha256(file).hexdigest() and f"pcm={zlib.crc32(pcm.tobytes()):08x}" in got[i]["feature"]
    file = bytearray(media.store(payload))
    file[-1] ^= 1  # of the last sample
    chunks = media.read_wave(bytes(file))[2]
    assert media.feature_of(chunks[b"data"], chunks[b"pcm2"], np.zeros((1, 1), np.int16)).endswith("ok=0")


def test_all_are_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))


# --- very long texts, repeated rows, rates ------------------------------------------------------


@pytest.mark.parametrize("rate", [1, 4000, 8000, 11025, 16000, 44100])
def test_pcm_at_any_rate(rate):
    payload = bytes(range(256))
    tag, at, chunks = media.read_wave(media.store_pcm(payload, media.ALAW, rate))
    got = np.frombuffer(chunks[b"data"], "<i2").astype(int)
    a = media.ALAW_PCM.astype(int)
    want = []
    for k in range(-(-256 * rate // 8000)):
        i, rest = divmod(k * 8000, rate)
        want.append(a[i] + (a[min(i + 1, 255)] - a[i]) * rest // rate)
    assert (tag, at) == (media.PCM, rate) and got.tolist() == want
    with pytest.raises(ValueError):
        media.store_pcm(payload, rate=0)


def test_mulaw_file_says_its_length():
    stored = media.store(media.payload_of(b"abc"))
    assert media.read_wave(stored)[2][b"fact"] == (64).to_bytes(4, "little")
    assert stored[16:20] == (18).to_bytes(4, "little") and int.from_bytes(stored[4:8], "little") == len(stored) - 8


LONG = ["x" + " " * 1_000_000 + "y", " " * 3_000_000, "q" * 3_000_000, "\n" * 2_000_000 + "a <|endoftext|> b", "token=" * 400_000, "ACCOUNT-" * 300_000, "é1 " * 500_000]


def test_very_long_texts(spark):
    """Whole texts of some megabytes, in every operator that reads a text at a time."""
    import time

    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*LONG, None, "", "same", "same"])], "doc_id long, text string").repartition(4)
    docs = docs.unionByName(docs.where("doc_id = 9"))
    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in enumerate(LONG)}
    began = time.time()
    pieces = packing.pack_documents(docs, path).toPandas()
    for i, ids in want.items():
        ids = np.array([*ids, 2], "<u4")
        own = pieces[pieces.doc_id == i].sort_values("piece")
        assert own.length.sum() == len(ids)
        assert [zlib.crc32(ids[s : s + n]) for s, n in zip(own.start, own.length, strict=True)] == own.ids_crc32.tolist()
    at = pieces.sort_values(["sequence_id", "offset"])
    assert (at.groupby("sequence_id").length.sum() <= 1024).all()
    assert (at.offset == at.groupby("sequence_id").length.cumsum() - at.length).all()
    counts = token_count.count_tokens(docs, path).toPandas()
    assert all(counts[counts.doc_id == i].n_tokens.tolist() == [len(ids)] for i, ids in want.items())
    assert len(counts) == 12 and counts[counts.doc_id == 9].n_tokens.tolist() == [1, 1]
    assert pii.span_digests(docs).count() == 12
    assert time.time() - began < 300


def test_only_plain_files_take_the_short_way(tmp_path):
    import json

    path = P.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["ignore_merges"] = True
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec), encoding="utf-8")
    assert isinstance(token_count.counter_for(path), token_count.WholeTokens)
    assert isinstance(token_count.counter_for(str(other)), token_count.Library)
    encode = packing.encoder_for(str(other))
    assert encode("Hello there").tolist() == Tokenizer.from_file(str(other)).encode("Hello there", add_special_tokens=False).ids
    spec = token_count.plain_bpe(path)
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    with pytest.raises(ValueError):
        packing.merge_ranks(spec)


def test_merges_by_bytes_are_the_listed_merges():
    """The faster library joins any neighbours whose bytes are a token; that gives the same ids as
    the listed merges where each token's bytes, merged by lower ranks alone, end as its listed pair."""
    path = P.path("byte_bpe_50k.json")
    spec = token_count.plain_bpe(path)
    ranks = packing.merge_ranks(spec)
    byte = {s: b for b, s in enumerate(token_count.byte_symbols())}
    for pair in spec["model"]["merges"]:
        a, b = (bytes(byte[c] for c in s) for s in (pair if isinstance(pair, list) else pair.split(" ")))
        own, parts = ranks[a + b], [bytes([x]) for x in a + b]
        while True:
            best = min(((ranks.get(x + y, own), k) for k, (x, y) in enumerate(zip(parts, parts[1:], strict=False))), default=(own, 0))
            if best[0] >= own:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        assert parts == [a, b]


def test_redaction_by_kind(spark):
    text = "see HTTP://x.org/a and Https://y.org, mail a@b.org or +49 30 1234567"
    assert [k for _, _, k in pii.find_spans(text)] == ["url", "url", "email", "phone"]
    docs = spark.createDataFrame([(1, text, len(text))], "doc_id long, text string, n_chars int")
    got = pii.redact_documents(docs).first()
    assert got["text"] == "see HTTP://x.org/a and Https://y.org, mail [EMAIL] or [PHONE]" and got["n_chars"] == len(got["text"])
    assert pii.redact_documents(docs, kinds=("url",)).first()["text"] == "see [URL] and [URL], mail a@b.org or +49 30 1234567"
