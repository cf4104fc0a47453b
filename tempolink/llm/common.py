"""What several corpus operators share: shared storage, Arrow text buffers, hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shuffles_removed

#: Bytes of text that the numpy kernels take at a time; a longer text is taken alone.
CHUNK_BYTES = 1 << 20

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, so that no other column can clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and both
    are one process (tests)."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tempolink-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def materialise(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write to the shared folder, in a folder for each value of `by` if given, and read again: cuts
    the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int = 1 << 16) -> DataFrame:
    """To be broadcast only if it has few rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for columns beside those of a table, none of which they take, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def parts_for(spark: SparkSession, size: int, each: int = 1 << 26) -> int:
    """Partitions for so many bytes, so that a task's share doesn't grow with the data; never fewer
    than the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // each))


def by_key(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """The rows of each key of a stream that is sorted by them, one key at a time."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        ends = [*sorted({x for k in keys for x in key_bounds(b.column(k))}), b.num_rows]
        for a, z in zip([0, *ends[:-1]], ends, strict=True):
            part = b.slice(a, z - a)
            if held and any(held[0].column(k)[0] != part.column(k)[0] for k in keys):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def key_bounds(col: pa.Array) -> list[int]:
    """Rows at which a sorted column's value changes."""
    return [] if len(col) < 2 else (np.flatnonzero(pc.not_equal(col.slice(1), col.slice(0, len(col) - 1)).to_numpy(zero_copy_only=False)) + 1).tolist()


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, or those of a binary one, and the rows' offsets into them;
    nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    raw = pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type)
    col = pc.fill_null(col.cast(pa.large_binary() if raw else pa.large_string()), b"" if raw else "")
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def texts_of(col: pa.Array) -> list[str]:
    return pc.fill_null(col, "").to_pylist()


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or of one longer row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that sums and remainders of hashes spread evenly."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: An odd multiplier for polynomial hashes modulo 2**64 and its inverse.
BASE = np.uint64(0x5851F42D4C957F2D)
BASE_INV = np.uint64(pow(int(BASE), -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


_POWERS: dict[int, np.ndarray] = {}


def cached_powers(base: np.uint64, n: int) -> np.ndarray:
    got = _POWERS.get(int(base))
    if got is None or len(got) < n:
        got = _POWERS[int(base)] = powers(base, max(n, CHUNK_BYTES + 4096))
    return got[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """p with (p[j] - p[i]) * BASE_INV**i the polynomial hash of data[i:j], modulo 2**64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * cached_powers(BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    inv = cached_powers(BASE_INV, len(prefix))
    return mix64((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(np.uint64) * GOLDEN)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


#: Bytes of letters and digits, and all of characters beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray = ~_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of `letters`, by default of all but white space; A-Z lower-cased)
    of the texts in `data`, in order, and the row of each. Words never cross texts."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    solid = letters[data]
    first = np.zeros(n, bool)  # of a text
    first[offsets[:-1][offsets[:-1] < n]] = True
    begins = solid & (first | ~np.concatenate(([False], solid[:-1])))
    last = np.concatenate((first[1:], [True]))
    ends = solid & (last | ~np.concatenate((solid[1:], [False])))
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    rows = np.searchsorted(offsets, start, side="right") - 1
    return span_hash(prefix_hash(_LOWER[data]), start, end), rows


def runs_of(x: np.ndarray) -> list[tuple[int, int, int]]:
    """Value, begin and end of every run of equal integers; none of an empty array."""
    if not len(x):
        return []
    start = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    return list(zip(x[start].tolist(), start.tolist(), np.append(start[1:], len(x)).tolist(), strict=True))
