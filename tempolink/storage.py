"""Tables on the storage that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where none is
    set and driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="tempolink-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Whether Spark removes the shuffle files of an execution at its end.
REMOVED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is shuffled for a table that is written here goes with the end of the writing. Else it stays
    until the driver happens to collect its garbage, and with much memory that is after many tables."""
    before = spark.conf.get(REMOVED, "false")
    spark.conf.set(REMOVED, "true")
    try:
        yield
    finally:
        spark.conf.set(REMOVED, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write and read again: cuts the lineage, and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int = 1 << 20) -> DataFrame:
    """To be broadcast only if it has no more than so many rows, which is counted before."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
