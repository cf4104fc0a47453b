"""Fields in files of the classic NetCDF format, as a data source of Spark.

A file holds the values of some steps at all places: dimensions time (the record dimension, so that
steps follow one another in the file) and place, coordinates of both, and one variable of doubles.
The reader knows from the header where each step begins, and so reads ranges of steps in tasks of
their own, each only its bytes; a filter on t_idx leaves out ranges that can't match. The writer
writes a file for each range of steps.

    write_field(field, places, path, steps_per_file=1000)
    spark.read.format("netcdf_field").option("path", path).load()       # loc, lat, lon, t_idx, value

Files are opened by their path, which driver and executors have to share (a mounted file system).
A cell without a value is not stored as a row; NaN is kept.
"""

from __future__ import annotations

import math
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from glob import glob

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, EqualTo

from ..storage import materialise

#: Tags and types of the classic format, its versions with 32-bit and 64-bit offsets,
#: and the bytes that mark a double that was never written.
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12
TYPES = {1: ("i1", 1), 2: ("S1", 1), 3: (">i2", 2), 4: (">i4", 4), 5: (">f4", 4), 6: (">f8", 8)}
INT, DOUBLE = 4, 6
FILL = float.fromhex("0x1.ep+122")

SCHEMA = "loc bigint, lat double, lon double, t_idx int, value double"
#: Bytes of steps that a task reads, about.
RANGE_BYTES = 1 << 25


# --- the format ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Variable:
    name: str
    dims: tuple[int, ...]
    type: int
    size: int
    begin: int


@dataclass(frozen=True)
class Header:
    records: int
    dims: list[tuple[str, int]]
    variables: dict[str, Variable]

    @property
    def record_size(self) -> int:
        """Bytes from one record to the next; a single record variable is not padded."""
        own = [v for v in self.variables.values() if v.dims and self.dims[v.dims[0]][1] == 0]
        if len(own) == 1:
            return math.prod(self.dims[d][1] for d in own[0].dims[1:]) * TYPES[own[0].type][1]
        return sum(v.size for v in own)


class _Bytes:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def number(self, kind: str = ">i") -> int:
        value = struct.unpack_from(kind, self.data, self.at)[0]
        self.at += struct.calcsize(kind)
        return value

    def name(self) -> str:
        n = self.number()
        value = self.data[self.at : self.at + n].decode()
        self.at += n + -n % 4
        return value

    def attributes(self) -> None:
        self.number()
        for _ in range(self.number()):
            self.name()
            size = TYPES[self.number()][1] * self.number()
            self.at += size + -size % 4


def parse_header(data: bytes) -> Header:
    """From the first bytes of a file; struct.error where they do not suffice."""
    if data[:3] != b"CDF" or data[3] not in (1, 2):
        raise ValueError("not a file of the classic format")
    b = _Bytes(data)
    b.at = 4
    records = b.number()
    b.number()
    dims = [(b.name(), b.number()) for _ in range(b.number())]
    b.attributes()
    b.number()
    variables = {}
    for _ in range(b.number()):
        name = b.name()
        ids = tuple(b.number() for _ in range(b.number()))
        b.attributes()
        kind, size = b.number(), b.number()
        variables[name] = Variable(name, ids, kind, size, b.number(">i" if data[3] == 1 else ">q"))
    return Header(records, dims, variables)


def read_header(path: str) -> Header:
    size = 1 << 12
    while True:
        with open(path, "rb") as f:
            data = f.read(size)
        try:
            return parse_header(data)
        except (struct.error, IndexError):
            if len(data) < size:
                raise
            size *= 4


def read_fixed(path: str, header: Header, name: str) -> np.ndarray:
    """A variable without the record dimension."""
    v = header.variables[name]
    kind, width = TYPES[v.type]
    n = math.prod(header.dims[d][1] for d in v.dims)
    with open(path, "rb") as f:
        f.seek(v.begin)
        return np.frombuffer(f.read(n * width), kind)


def read_records(path: str, header: Header, name: str, first: int, last: int) -> np.ndarray:
    """The values of some records of a variable, a row a record: only their bytes are read."""
    v = header.variables[name]
    kind, width = TYPES[v.type]
    n, step = math.prod(header.dims[d][1] for d in v.dims[1:]), header.record_size
    out = np.empty((last - first, n), kind)
    with open(path, "rb") as f:
        for k in range(first, last):
            f.seek(v.begin + k * step)
            out[k - first] = np.frombuffer(f.read(n * width), kind)
    return out


def _text(name: str) -> bytes:
    raw = name.encode()
    return struct.pack(">i", len(raw)) + raw + b"\0" * (-len(raw) % 4)


def file_head(lat: np.ndarray, lon: np.ndarray, name: str = "value") -> bytes:
    """All before the first record of a file of no records yet; a place's number is its loc."""
    n = len(lat)
    row = 8 * n
    variables = [("lat", (1,), DOUBLE, row), ("lon", (1,), DOUBLE, row), ("time", (0,), INT, 4), (name, (0, 1), DOUBLE, row)]
    head = b"CDF\x02" + struct.pack(">i", 0) + struct.pack(">ii", DIMENSION, 2) + _text("time") + struct.pack(">i", 0) + _text("place") + struct.pack(">i", n) + struct.pack(">ii", 0, 0)
    head += struct.pack(">ii", VARIABLE, len(variables))
    size = len(head) + sum(len(_text(v)) + 4 + 4 * len(d) + 8 + 4 + 4 + 8 for v, d, _, _ in variables)
    begins = [size, size + row, size + 2 * row, size + 2 * row + 4]
    for (v, dims, kind, width), begin in zip(variables, begins, strict=True):
        head += _text(v) + struct.pack(f">i{len(dims)}i", len(dims), *dims) + struct.pack(">ii", 0, 0) + struct.pack(">iiq", kind, width, begin)
    return head + lat.astype(">f8").tobytes() + lon.astype(">f8").tobytes()


class FileWriter:
    """Writes steps that come in order, of which it holds one, to a file for each range of steps."""

    def __init__(self, where: str, lat: np.ndarray, lon: np.ndarray, attempt: int) -> None:
        self.where, self.attempt, self.n = where, attempt, len(lat)
        self.head = file_head(lat, lon)
        self.file, self.number, self.t, self.steps = None, -1, None, 0
        self.row = np.full(self.n, FILL)

    def step(self, number: int, t: int, loc: np.ndarray, value: np.ndarray) -> None:
        """Some values of a step."""
        if (number, t) != (self.number, self.t):
            self._flush()
            if number != self.number:
                self._end()
                self.number = number
                self.file = open(f"{self._name()}.{self.attempt}", "wb")  # noqa: SIM115
                self.file.write(self.head)
            self.t = t
        self.row[loc] = value

    def _name(self) -> str:
        return os.path.join(self.where, f"steps-{self.number:08d}.nc")

    def _flush(self) -> None:
        if self.t is not None:
            self.file.write(struct.pack(">i", self.t) + self.row.astype(">f8").tobytes())
            self.row[:] = FILL
            self.steps, self.t = self.steps + 1, None

    def _end(self) -> None:
        if self.file:
            self.file.seek(4)
            self.file.write(struct.pack(">i", self.steps))
            self.file.close()
            os.replace(self.file.name, self._name())  # a task that runs twice leaves one file
            self.file, self.steps = None, 0

    def close(self) -> None:
        self._flush()
        self._end()


# --- reading ------------------------------------------------------------------------------------


def local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


@dataclass
class StepRange(InputPartition):
    path: str
    first: int
    last: int


class FieldReader(DataSourceReader):
    def __init__(self, path: str, variable: str, range_bytes: int = RANGE_BYTES) -> None:
        found = sorted(glob(os.path.join(local(path), "*.nc"))) if os.path.isdir(local(path)) else [local(path)]
        if not all(map(os.path.exists, found)):
            raise FileNotFoundError(path)
        self.paths, self.variable, self.range_bytes, self.low, self.high = found, variable, range_bytes, -math.inf, math.inf

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Bounds of t_idx leave out ranges; all filters are applied to the rows again."""
        for f in filters:
            if getattr(f, "attribute", None) == ("t_idx",):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.low = max(self.low, f.value)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.high = min(self.high, f.value)
            yield f

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.paths:
            header = read_header(path)
            each = max(1, self.range_bytes // max(1, header.record_size))
            for first in range(0, header.records, each):
                last = min(first + each, header.records)
                ends = read_records(path, header, "time", first, first + 1)[0, 0], read_records(path, header, "time", last - 1, last)[0, 0]
                if ends[1] >= self.low and ends[0] <= self.high:
                    out.append(StepRange(path, first, last))
        return out or [StepRange("", 0, 0)]

    def read(self, partition: StepRange) -> Iterator[pa.RecordBatch]:
        if partition.first == partition.last:
            return
        header = read_header(partition.path)
        lat, lon = (read_fixed(partition.path, header, k).astype(float) for k in ("lat", "lon"))
        loc = np.arange(len(lat))
        for k in range(partition.first, partition.last):
            t = int(read_records(partition.path, header, "time", k, k + 1)[0, 0])
            value = read_records(partition.path, header, self.variable, k, k + 1)[0].astype(float)
            there = value != FILL
            yield pa.RecordBatch.from_arrays([pa.array(loc[there]), pa.array(lat[there]), pa.array(lon[there]), pa.array(np.full(int(there.sum()), t, np.int32)), pa.array(value[there])], ["loc", "lat", "lon", "t_idx", "value"])


class FieldSource(DataSource):
    """spark.read.format("netcdf_field"): options path (a file, or a folder of .nc files),
    variable, and range_bytes, how much a task reads about."""

    @classmethod
    def name(cls) -> str:
        return "netcdf_field"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return FieldReader(self.options["path"], self.options.get("variable", "value"), int(self.options.get("range_bytes", RANGE_BYTES)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FieldSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # Spark asks for it of sources that take filters


def read_field(spark: SparkSession, path: str, variable: str = "value", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """loc, lat, lon, t_idx, value of all files of a folder, or of one file."""
    register(spark)
    return spark.read.format("netcdf_field").option("path", path).option("variable", variable).option("range_bytes", range_bytes).load()


# --- writing ------------------------------------------------------------------------------------


def write_field(field: DataFrame, places: DataFrame, path: str, steps_per_file: int = 1000) -> int:
    """A field (loc, t_idx, value) as a file for each range of steps, and how many rows lie in them.
    places: loc (0 to n - 1), lat, lon, all of them in each file. Rows stream through a task in the
    order of steps, one step of all places at a time."""
    where = local(path)
    os.makedirs(where, exist_ok=True)
    n = places.count()
    spark = field.sparkSession
    known = materialise(places.select("loc", "lat", "lon"), "places")
    lat, lon = _coordinates(known, n)
    at = spark.sparkContext.broadcast((lat, lon))  # a coordinate pair a place, as each file has

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, rows = FileWriter(where, *at.value, TaskContext.get().taskAttemptId()), 0
        for b in batches:
            file, loc, t, value = (b.column(c).to_numpy() for c in ("file", "loc", "t_idx", "value"))
            ends = np.append(np.flatnonzero((t[1:] != t[:-1]) | (file[1:] != file[:-1])) + 1, len(t))
            for a, z in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                if z > a:
                    out.step(int(file[a]), int(t[a]), loc[a:z], value[a:z])
            rows += b.num_rows
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], ["rows"])

    filed = field.where("value is not null").select(F.floor(F.col("t_idx") / steps_per_file).cast("int").alias("file"), "loc", "t_idx", F.col("value").cast("double").alias("value"))
    return filed.repartition("file").sortWithinPartitions("file", "t_idx", "loc").mapInArrow(run, "rows long").agg(F.sum("rows")).first()[0] or 0


def _coordinates(places: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    lat, lon = np.full(n, np.nan), np.full(n, np.nan)
    for r in places.toLocalIterator():
        lat[r["loc"]], lon[r["loc"]] = r["lat"], r["lon"]
    return lat, lon
