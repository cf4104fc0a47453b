"""Synthetic fields and events, from seeds.

Every cell's number is drawn from a digest of the seed, the place and the step, so it is the same in
every engine, at every number of partitions, and for every subset of the places.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hexadecimal digits of a digest that make a number, and how many numbers they make.
DIGITS = 12
NUMBERS = 16.0**DIGITS


def _drawn(seed: int) -> tuple[Column, Column]:
    """Two numbers of a cell, in (0, 1)."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("loc").cast("string"), F.col("t_idx").cast("string")))
    first, second = (F.conv(F.substring(digest, at, DIGITS), 16, 10).cast("double") for at in (1, 1 + DIGITS))
    return (first + 0.5) / NUMBERS, (second + 0.5) / NUMBERS


def cells_of(places: DataFrame, steps: int) -> DataFrame:
    """loc, t_idx of all steps of places."""
    return places.select(F.col("loc").cast("long").alias("loc"), F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("t_idx"))


def field_of(places: DataFrame, steps: int, seed: int = 42) -> DataFrame:
    """Standard normal noise at the given places: loc, t_idx, value."""
    u, v = _drawn(seed)
    return cells_of(places, steps).select("loc", "t_idx", (F.sqrt(-2.0 * F.ln(u)) * F.cos(F.lit(2 * math.pi) * v)).alias("value"))


def events_of(places: DataFrame, steps: int, p: float = 0.05, seed: int = 42) -> DataFrame:
    """Events of probability p at every cell of the given places: loc, t_idx."""
    return cells_of(places, steps).where(_drawn(seed)[0] < p)


def seeded_field(spark: SparkSession, n_loc: int, steps: int, seed: int = 42) -> DataFrame:
    return field_of(spark.range(n_loc).withColumnRenamed("id", "loc"), steps, seed)


def seeded_events(spark: SparkSession, n_loc: int, steps: int, p: float = 0.05, seed: int = 42) -> DataFrame:
    return events_of(spark.range(n_loc).withColumnRenamed("id", "loc"), steps, p, seed)
