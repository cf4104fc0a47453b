"""Embedding whitening from an exact scatter matrix in residue numbers.

Vectors become whole numbers, x = floor(256 * c). Every partition of the distinct ones multiplies
its matrix with itself modulo several primes: residues lie below 2^21 in size, so 2,048 rows of
products stay below 2^53 and the double-precision product is exact. Spark adds up the residues of
each entry; the Chinese remainder theorem gives the sums themselves, of a column of ones too, so
counts, sums and scatter come out together and exactly. As many primes are taken as the count of
vectors and the largest entry need. The covariance, exact up to here, is rounded once to double and
decomposed by eigh; eigenvalues are then taken from the exact matrix by its eigenvectors.

Cases: a null vector, one with a null or non-finite entry, and an empty one are dropped; so are
vectors of another length than most have (ties: the longest). Entries beyond a long take the
nearest long. A null id stays, repeated rows have a row each and count once in the fit; an empty
table gives no rows. A component without variance (equal vectors, dependent dimensions) has a null
`whitened`, and stands out of `identity_error`; fewer dimensions than components give as many. A
`deviation` beyond a long is null. Columns other than the id and the vector are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts_for

#: Primes lie below it, residues below its half in size.
PRIME_TOP = 1 << 22
#: Rows of a product: 2^11 times (2^21)^2 is 2^53.
BLOCK = 1 << 11
SCALE = 256.0
#: Bits behind the point when the exact matrix is taken between eigenvectors.
POINT = 80
WIDTHS = (np.int8, np.int16, np.int32, np.int64)


def primes(bound: int) -> list[int]:
    """The largest primes below `PRIME_TOP`, as many as have a product above `bound`."""
    out, product, x = [], 1, PRIME_TOP - 1
    while product <= bound:
        if all(x % q for q in range(3, math.isqrt(x) + 1, 2)):
            out.append(x)
            product *= x
        x -= 2
    return out


def from_residues(residues: list[int], moduli: list[int]) -> int:
    """The number of smallest size with these residues."""
    whole = math.prod(moduli)
    x = sum(r * (whole // p) * pow(whole // p, -1, p) for r, p in zip(residues, moduli, strict=True)) % whole
    return x - whole if x > whole // 2 else x


def whole_numbers(vectors: pa.Array) -> Iterator[np.ndarray | None]:
    """Of each vector its entries as long; None for one that isn't whole and finite."""
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().cast(pa.float64())
    c = pc.fill_null(flat, math.nan).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(c))))
    with np.errstate(over="ignore", invalid="ignore"):
        low = np.floor(c * SCALE)
        x = np.where(low >= 2.0**63, np.int64(2**63 - 1), np.where(low < -(2.0**63), np.int64(-(2**63)), low.astype(np.int64)))
    for a, z in zip((ends - lengths).tolist(), ends.tolist(), strict=True):
        yield x[a:z] if z > a and bad[a] == bad[z] else None


def pack(x: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes each, so that equal vectors are equal bytes."""
    kind = next(k for k in WIDTHS if np.iinfo(k).min <= x.min() and x.max() <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def unpack(rows: pa.Array) -> np.ndarray:
    return np.array([np.frombuffer(b, f"<i{b[0]}", offset=1) for b in rows.to_pylist()], np.int64)


def packed_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, dims, bits (of the largest entry), x (packed) of every valid vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, x) for i, x in enumerate(whole_numbers(b.column("vector"))) if x is not None]
            ids = b.column("id").take(pa.array([i for i, _ in found], pa.int64()))
            bits = [max(int(x.max()).bit_length(), int(x.min()).bit_length()) for _, x in found]
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(x) for _, x in found], pa.int32()), pa.array(bits, pa.int32()), pa.array([pack(x) for _, x in found], pa.binary())], ["id", "dims", "bits", "x"])

    read = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return read.mapInArrow(run, "id long, dims int, bits int, x binary")


def residue_products(x: np.ndarray, p: int) -> np.ndarray:
    """The matrix's product with itself modulo p, exactly."""
    r = np.remainder(x, p)
    r = np.where(r > p // 2, r - p, r).astype(np.float64)
    return np.remainder(r.T @ r, p).astype(np.int64)


def scatter(fit: DataFrame, dims: int, moduli: list[int]) -> tuple[int, list[int], list[list[int]]]:
    """Count, sums and scatter matrix of packed vectors. Only sums of residues leave a partition."""
    upper = np.triu_indices(dims + 1)
    places = (upper[0] * (dims + 1) + upper[1]).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {p: np.zeros((dims + 1, dims + 1), np.int64) for p in moduli}
        for b in batches:
            for start in range(0, b.num_rows, BLOCK):
                x = unpack(b.column("x").slice(start, BLOCK))
                x = np.concatenate((np.ones((len(x), 1), np.int64), x), axis=1)
                for p, s in sums.items():
                    s += residue_products(x, p)
                    s %= p
        for p, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(places), p, np.int32)), pa.array(places), pa.array(s[upper])], ["prime", "place", "part"])

    made = fit.select("x").mapInArrow(run, "prime int, place long, part long")
    rows = made.groupBy("prime", "place").agg(F.sum("part").alias("part")).collect()  # no more than primes times entries
    found = {(r["place"], r["prime"]): r["part"] for r in rows}
    exact = [[0] * (dims + 1) for _ in range(dims + 1)]
    for i, j, at in zip(*(u.tolist() for u in upper), places.tolist(), strict=True):
        exact[i][j] = exact[j][i] = from_residues([found.get((at, p), 0) % p for p in moduli], moduli)
    return exact[0][0], exact[0][1:], [row[1:] for row in exact[1:]]


@dataclass(frozen=True)
class Whitening:
    """Count and exact sums of the fit list, unit components by falling eigenvalue, eigenvalues, the
    shares of the trace, and the largest entry of the whitened covariance less the identity."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: list[float]
    explained: list[float | None]
    identity_error: float | None


def whitening(n: int, sums: list[int], products: list[list[int]], top: int) -> Whitening:
    s = np.array(sums, object)
    exact = n * np.array(products, object) - s[:, None] * s[None, :]  # n^2 times the covariance
    _, vectors = np.linalg.eigh((exact / (n * n)).astype(np.float64))
    w = np.ascontiguousarray(vectors.T[::-1][:top])
    scaled = np.array([[int(v) for v in row] for row in np.rint(np.ldexp(w, 52)).astype(np.int64).tolist()], object) * (1 << (POINT - 52))
    between = scaled @ exact @ scaled.T
    unit = n * n << 2 * POINT
    values = [int(between[i, i]) / unit for i in range(len(w))]
    order = sorted(range(len(w)), key=lambda i: -values[i])
    trace = int(np.trace(exact))
    # what eigh can't tell from nothing is no variance
    floor = max(values, default=0.0) * len(sums) * np.finfo(float).eps
    alive = [i for i in order if values[i] > floor]
    errors = [abs(int(between[i, j]) / unit / math.sqrt(values[i] * values[j]) - (i == j)) for i in alive for j in alive]
    return Whitening(n, sums, w[order], [values[i] if i in alive else 0.0 for i in order], [max(values[i], 0.0) / (trace / (n * n)) if trace else None for i in order], max(errors, default=None))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int | None]]:
    """n * x - S as double, and the exact sums of its squares."""
    most = n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, sums))
    if most * most * x.shape[1] < 1 << 63:
        d = n * x - np.array(sums, np.int64)
        return d.astype(np.float64), (d * d).sum(axis=1).tolist()
    d = n * x.astype(object) - np.array(sums, object)
    return d.astype(np.float64), [v if v < 1 << 63 else None for v in (d * d).sum(axis=1).tolist()]


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, top: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each valid vector and each of the first `top` components."""
    spark = vectors.sparkSession
    rows = packed_vectors(vectors, id_col, vector_col)
    sizes = rows.groupBy("dims").agg(F.count("*").alias("n"), F.max("bits").alias("bits"), F.sum(F.length("x")).alias("size"))
    most = sizes.orderBy(F.desc("n"), F.desc("dims")).first()
    if most is None:
        return spark.createDataFrame([], SCHEMA)
    dims = most["dims"]
    valid = rows.where(F.col("dims") == dims)
    moduli = primes(2 * most["n"] << 2 * most["bits"] + 1)
    fit = valid.groupBy("x").agg(F.lit(1)).repartition(parts_for(spark, most["size"]), "x")
    found = whitening(*scatter(fit, dims, moduli), top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(found.components)
        for b in batches:
            for start in range(0, b.num_rows, BLOCK):
                part = b.slice(start, BLOCK)
                d, squares = deviations(unpack(part.column("x")), found.n, found.sums)
                d /= found.n
                columns = [(d * w).sum(axis=1) / math.sqrt(e) if e > 0 else np.full(len(d), math.nan) for w, e in zip(found.components, found.values, strict=True)]
                white = np.stack(columns, axis=1).ravel()
                times = np.repeat(np.arange(part.num_rows), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(pa.array(times)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), part.num_rows)),
                        pa.array(np.full(len(times), found.n)),
                        pa.array(squares, pa.int64()).take(pa.array(times)),
                        pa.array(white, mask=np.isnan(white)),
                        pa.array(list(found.explained) * part.num_rows, pa.float64()),
                        pa.array([found.identity_error] * len(times), pa.float64()),
                    ],
                    SCHEMA.replace(" long", "").replace(" int", "").replace(" double", "").split(", "),
                )

    return valid.select("id", "x").mapInArrow(run, SCHEMA)
