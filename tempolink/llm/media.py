"""Telephony audio columns: G.711 companding, IMA ADPCM blocks, resampling, WAVE containers.

Bytes are 8-bit companded samples. Expansion is a table lookup; ADPCM blocks are decoded for all
blocks of a batch at once, one numpy step a sample position; PCM is resampled to any rate with
straight lines between samples.

The stored form of a payload is a WAVE file with two data chunks: `data` has the payload as 8-bit
mu-law samples, losslessly, and `pcm2` has the target rate and the 16-bit PCM resampled to it.
`store_pcm` gives that PCM as a file of its own.

Cases: a null text is empty; an empty payload is one block of 64 zero bytes; equal texts give
equal values, and an empty table no rows; a very long text is one file, of up to 858 MB of text, as
a WAVE file counts its bytes in 32 bits (struct.error beyond); columns other than the id and the
text are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, row_chunks, text_buffer

BLOCK = 64
RATE, TARGET_RATE = 8000, 16000
#: WAVE format tags, and IMA ADPCM's index steps by the low three bits of a code.
PCM, ALAW, MULAW = 1, 6, 7
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int64)
#: The 89 quantiser steps of IMA ADPCM.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88,
     97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658,
     724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660,
     4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818,
     18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int64,
)


def mulaw_table() -> np.ndarray:
    """16-bit samples of the 256 mu-law codes."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << (code >> 4 & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit samples of the 256 A-law codes."""
    code = np.arange(256) ^ 0x55
    part, low = code >> 4 & 7, (code & 0x0F) << 4
    size = np.where(part == 0, low + 8, low + 0x108 << np.maximum(part - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MULAW_PCM, ALAW_PCM = mulaw_table(), alaw_table()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples (n, 1 + 2 * (size - 4)) of IMA ADPCM blocks (n, size): a little-endian first sample,
    a step index, a spare byte, then two codes a byte, the low one first."""
    n, size = blocks.shape
    out = np.empty((n, 1 + 2 * (size - 4)), np.int16)
    sample = (blocks[:, 0].astype(np.int64) | blocks[:, 1].astype(np.int64) << 8) ^ 0x8000
    sample -= 0x8000
    index = np.minimum(blocks[:, 2].astype(np.int64), 88)
    out[:, 0] = sample
    codes = np.empty((n, 2 * (size - 4)), np.uint8)
    codes[:, 0::2], codes[:, 1::2] = blocks[:, 4:] & 15, blocks[:, 4:] >> 4
    # columns side by side in memory, as each step reads one
    codes = np.ascontiguousarray(codes.T)
    for k in range(codes.shape[0]):
        code, step = codes[k], STEPS[index]
        size_ = step >> 3
        size_ += np.where(code & 4, step, 0)
        size_ += np.where(code & 2, step >> 1, 0)
        size_ += np.where(code & 1, step >> 2, 0)
        sample = np.clip(np.where(code & 8, sample - size_, sample + size_), -32768, 32767)
        index = np.clip(index + INDEX_STEP[code & 7], 0, 88)
        out[:, k + 1] = sample
    return out


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Samples at another rate, on straight lines between neighbours, rounded down; beyond the last
    one its value stays. As many as last as long: ceil(len * to / rate)."""
    if rate < 1 or to < 1:
        raise ValueError("rates are positive")
    if rate == to or not len(pcm):
        return pcm
    a = pcm.astype(np.int64)
    step = np.append(np.diff(a), 0)
    if to % rate == 0:
        k = np.arange(to // rate)
        return (a[:, None] + step[:, None] * k // len(k)).astype(np.int16).reshape(-1)
    at = np.arange(-(-len(a) * to // rate)) * rate
    k = at // to
    return (a[k] + step[k] * (at - k * to) // to).astype(np.int16)


def wave(tag: int, rate: int, bits: int, *chunks: tuple[bytes, bytes]) -> bytes:
    """A mono WAVE file."""
    form = struct.pack("<HHIIHH", tag, 1, rate, rate * bits // 8, bits // 8, bits)
    if tag != PCM:  # other formats say how much follows, and how many samples there are
        form += struct.pack("<H", 0)
        chunks = ((b"fact", struct.pack("<I", len(dict(chunks)[b"data"]))), *chunks)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(form)) + form
    body += b"".join(name + struct.pack("<I", len(x)) + x + b"\0" * (len(x) % 2) for name, x in chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wave(stored: bytes) -> tuple[int, int, dict[bytes, bytes]]:
    """Format tag, rate and the other chunks."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    tag, rate, found, at = 0, 0, {}, 12
    while at + 8 <= len(stored):
        name, n = stored[at : at + 4], struct.unpack_from("<I", stored, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", stored, at + 8)
        else:
            found[name] = stored[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    return tag, rate, found


def payload_of(text: bytes) -> bytes:
    """Zero bytes up to a positive multiple of the block."""
    return text + b"\0" * (-len(text) % BLOCK or BLOCK * (not text))


def expand(payload: bytes, tag: int) -> np.ndarray:
    return {MULAW: MULAW_PCM, ALAW: ALAW_PCM}[tag][np.frombuffer(payload, np.uint8)]


def store(payload: bytes) -> bytes:
    """The payload as a mu-law WAVE file with its resampled PCM."""
    pcm = resample(expand(payload, MULAW), RATE, TARGET_RATE)
    return wave(MULAW, RATE, 8, (b"data", payload), (b"pcm2", struct.pack("<I", TARGET_RATE) + pcm.astype("<i2").tobytes()))


def read_pcm(chunk: bytes) -> tuple[int, np.ndarray]:
    """Rate and samples of a `pcm2` chunk."""
    return struct.unpack_from("<I", chunk)[0], np.frombuffer(chunk, "<i2", offset=4)


def store_pcm(payload: bytes, tag: int = MULAW, rate: int = TARGET_RATE) -> bytes:
    """The payload expanded, resampled to the rate and stored as 16-bit PCM."""
    return wave(PCM, rate, 16, (b"data", resample(expand(payload, tag), RATE, rate).astype("<i2").tobytes()))


def feature_of(payload: bytes, stored_pcm: bytes, adpcm: np.ndarray) -> str:
    """Of what was read back: mean size and crossings of both expansions, the crc32 of the ADPCM
    decoding and of the stored PCM, and whether that PCM is the payload's."""
    mu, a = expand(payload, MULAW), expand(payload, ALAW)
    rate, up = read_pcm(stored_pcm)
    sound = rate == TARGET_RATE and np.array_equal(up, resample(mu, RATE, TARGET_RATE))
    energy = [int(np.abs(x.astype(np.int32)).sum()) // len(x) for x in (mu, a)]
    turns = [int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0))) for x in (mu, a)]
    return f"mu={energy[0]},{turns[0]};a={energy[1]},{turns[1]};adpcm={zlib.crc32(np.ascontiguousarray(adpcm)):08x};pcm={zlib.crc32(up):08x};ok={int(sound)}"


def media_rows(data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
    """For texts in a buffer: n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature."""
    raw = data.tobytes()
    files = [store(payload_of(raw[i:j])) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    back = [read_wave(f)[2] for f in files]
    joined = np.frombuffer(b"".join(x[b"data"] for x in back), np.uint8).reshape(-1, BLOCK)
    adpcm = decode_adpcm(joined) if len(joined) else np.zeros((0, 1), np.int16)
    out, at = [], 0
    for n, f, x in zip(np.diff(offsets).tolist(), files, back, strict=True):
        payload = x[b"data"]
        blocks = len(payload) // BLOCK
        out.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(f), hashlib.sha256(f).hexdigest(), feature_of(payload, x[b"pcm2"], adpcm[at : at + blocks])))
        at += blocks
    return out


MEDIA_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What `media_column` stores for every row, as sizes and digests, with features of what is
    read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [x.split()[0] for x in MEDIA_SCHEMA.split(", ")]
        for b in batches:
            data, offsets = text_buffer(b.column("text"))
            for i, j in row_chunks(offsets):
                rows = media_rows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, MEDIA_SCHEMA)


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, media (binary, the stored form), pcm (binary, the resampled PCM's WAVE file)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_buffer(b.column("text"))
            for i, j in row_chunks(offsets):
                payloads = [payload_of(data[a:z].tobytes()) for a, z in zip(offsets[i:j].tolist(), offsets[i + 1 : j + 1].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array([store(p) for p in payloads], pa.binary()), pa.array([store_pcm(p) for p in payloads], pa.binary())], ["doc_id", "media", "pcm"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, media binary, pcm binary")
