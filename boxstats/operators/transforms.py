"""Row transforms, cuts and exact subsampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxstats.box import Box
from boxstats.functions.periodic import AXES, V, X, wrap

# Prime modulus and multiplier of the sampling order (fixed values, so that a seed names
# the same subsample everywhere).
SAMPLE_MODULUS = 2147483647
SAMPLE_MULTIPLIER = 48271


def redshift_space(points: DataFrame, box: Box, lam: float | Column = 1.0, axis: int = 2) -> DataFrame:
    """Shift along the line of sight by ``lam * v / (aH)``; positions are not wrapped."""
    lam = F.lit(float(lam)) if not isinstance(lam, Column) else lam
    x, v = f"x{axis}", f"v{axis}"
    return points.withColumn(x, F.col(x) + lam * F.col(v) / F.lit(box.aH))


def with_lambdas(points: DataFrame, lambdas: list[float]) -> DataFrame:
    """One copy of every row per distortion strength, so that all strengths share a job."""
    return points.withColumn("lam", F.explode(F.array(*[F.lit(float(v)) for v in lambdas])))


def wrap_positions(points: DataFrame, box: Box) -> DataFrame:
    return points.withColumns({c: wrap(F.col(c), box.boxsize) for c in X})


def velocity_to_kms(points: DataFrame, a: float) -> DataFrame:
    """Snapshot velocity units -> km/s."""
    return points.withColumns({c: F.col(c) * math.sqrt(a) for c in V})


def to_physical(points: DataFrame, a: float) -> DataFrame:
    """Comoving -> physical coordinates."""
    return points.withColumns({c: F.col(c) * a for c in X})


def displacement(points: DataFrame, box: Box, name: str = "u") -> DataFrame:
    """Line-of-sight velocity as a comoving displacement."""
    return points.withColumn(name, F.col("v2") / F.lit(box.aH))


def mass_cut(halos: DataFrame, log_m_min: float, log_m_max: float, particle_mass: float) -> DataFrame:
    """Keep 10^log_m_min <= particle_mass * nfof < 10^log_m_max."""
    mass = F.lit(float(particle_mass)) * F.col("nfof")
    return halos.filter((mass >= 10.0**log_m_min) & (mass < 10.0**log_m_max))


def bounding_box(points: DataFrame) -> DataFrame:
    aggs = []
    for i in AXES:
        aggs += [F.min(f"x{i}").alias(f"lo{i}"), F.max(f"x{i}").alias(f"hi{i}")]
    return points.agg(*aggs)


def sample_order(pid: Column, seed: int) -> Column:
    """Pseudo-random rank key in [0, 2^31): x -> x^5 permutes the residues of the modulus."""
    p = F.lit(SAMPLE_MODULUS)

    def fifth_power(h: Column) -> Column:
        square = (h * h) % p
        return (((square * square) % p) * h) % p

    h = fifth_power((pid.cast("bigint") % p + F.lit(int(seed))) % p)
    return fifth_power((h * F.lit(SAMPLE_MULTIPLIER) + F.lit(int(seed))) % p)


def subsample(points: DataFrame, n: int, seed: int = 0, pid: str = "pid") -> DataFrame:
    """Exactly the ``n`` first rows in the seeded order, without a global sort.

    Two counting passes over at most 2^16 buckets each find the key of the n-th row; the
    rows below it are a plain filter and only rows that share that very key are sorted.
    """
    if n < 0:
        raise ValueError("n must not be negative")
    keyed = points.withColumn("_h", sample_order(F.col(pid), seed))

    def crossing(df: DataFrame, bucket: Column, need: int) -> tuple[int | None, int]:
        counts = df.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy("b").collect()
        for row in counts:
            if need <= row["n"]:
                return row["b"], need
            need -= row["n"]
        return None, need

    if n == 0:
        return points.limit(0)
    coarse, need = crossing(keyed, F.expr("_h div 65536"), n)
    if coarse is None:
        return points
    last, need = crossing(keyed.filter(F.expr("_h div 65536") == coarse), F.col("_h"), need)
    below = keyed.filter(F.col("_h") < last)
    ties = keyed.filter(F.col("_h") == last).orderBy(pid).limit(need)
    return below.unionByName(ties).drop("_h")


def subsample_fraction(points: DataFrame, fraction: float, seed: int = 0, pid: str = "pid") -> DataFrame:
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be in (0, 1]")
    return subsample(points, math.floor(fraction * points.count()), seed, pid)
