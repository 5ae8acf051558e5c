"""Uniform random points as a pure function of (id, seed)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxstats.box import Box
from boxstats.functions.periodic import AXES


def randoms(spark: SparkSession, n: int, box: Box, seed: int = 0) -> DataFrame:
    """``n`` points (pid, x0..x2) in [0, L)^3; a recomputed task gives the same points again."""
    if n < 1:
        raise ValueError("n must be at least 1")
    ids = spark.range(n).withColumnRenamed("id", "pid")
    size = F.lit(float(box.boxsize))
    columns = []
    for i in AXES:
        bits = F.shiftrightunsigned(F.xxhash64("pid", F.lit(int(seed)), F.lit(i)), 11)
        columns.append((bits.cast("double") * F.lit(2.0**-53) * size).alias(f"x{i}"))
    return ids.select("pid", *columns)


def n_randoms(box: Box, shot_noise: float) -> int:
    """Number of randoms whose shot noise V / n is ``shot_noise``."""
    return math.floor(box.volume / shot_noise)
