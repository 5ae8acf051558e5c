"""Particle tables derived from the star-schema test tables.

Positions are multiples of 1/16 (randoms: of 1/32) in a box of 256 and velocities are whole
numbers, so weights, squared distances and velocity sums are exact in double precision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxstats.box import Box
from boxstats.functions.periodic import AXES

BOX = Box(256.0, 0.3, 1.0)

# Fixed multipliers per axis: square, linear and second-key terms of the positions; first-
# and second-key terms of the velocities.
POSITION = ((7919, 104729, 12289), (6151, 31337, 40961), (3571, 75773, 65537))
VELOCITY = ((5659, 577), (4409, 1009), (7577, 911))
LATTICE = 4096


def _lattice(a: Column, b: Column, m: tuple[int, int, int]) -> Column:
    # Reducing first keeps the products small for any table size.
    a, b = a % LATTICE, b % LATTICE
    return ((a * a * m[0] + a * m[1] + b * m[2]) % LATTICE).cast("double") / F.lit(16.0)


def _particles(df: DataFrame, key: str, second: str, *extra: Column) -> DataFrame:
    a, b = F.col(key), F.col(second)
    x = [_lattice(a, b, POSITION[i]).alias(f"x{i}") for i in AXES]
    v = [((a * m[0] + b * m[1]) % 2001 - 1000).cast("double").alias(f"v{i}") for i, m in enumerate(VELOCITY)]
    return df.select(a.alias("pid"), *extra, *x, *v)


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _particles(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id", "user_id")


def halos(spark: SparkSession, sf_dir: str) -> DataFrame:
    nfof = (F.lit(1) + F.col("o_custkey") % 500).cast("int").alias("nfof")
    return _particles(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey", "o_custkey", nfof)


def random_points(spark: SparkSession, sf_dir: str, seed: int = 7) -> DataFrame:
    """One point per customer, off the lattice of the particles."""
    key = F.col("c_custkey")
    x = [(_lattice(key, F.lit(seed), POSITION[i]) + F.lit(1.0 / 32.0)).alias(f"x{i}") for i in AXES]
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(key.alias("pid"), *x)
