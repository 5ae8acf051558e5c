"""Velocity dispersion and the characteristic function of the line-of-sight displacement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxstats.box import Box
from boxstats.functions.periodic import finite
from boxstats.operators.transforms import displacement
from boxstats.sizing import tasks_for


def velocity_dispersion(points: DataFrame, box: Box) -> DataFrame:
    """Mean of u^2 with u = v2 / (aH), and the row count."""
    u = F.col("u")
    u = finite(u, "v2")
    return displacement(points, box).agg(F.avg(u * u).alias("sigma2"), F.count(F.lit(1)).alias("n"))


def characteristic_function(
    points: DataFrame, box: Box, lambda_max: float = 10.0, steps: int = 1000, n_points: int | None = None
) -> DataFrame:
    """phi(lambda) = <cos(lambda u)> at ``steps + 1`` even values of lambda.

    Every task folds its rows into one partial mean per lambda, so the shuffle carries
    ``steps + 1`` rows per task however long the catalogue is. A row costs ``steps``
    cosines, so spreading the rows by their number first is cheap next to that.
    """
    n_points = points.count() if n_points is None else n_points
    tasks = tasks_for(points.sparkSession, float(n_points) * steps)
    step = F.explode(F.sequence(F.lit(0), F.lit(int(steps)))).alias("i")
    lam = F.lit(float(lambda_max)) * F.col("i") / F.lit(float(steps))
    return (
        displacement(points, box)
        .select(finite(F.col("u"), "v2").alias("u"))
        .repartition(tasks)
        .select("u", step)
        .groupBy("i")
        .agg(F.avg(F.cos(lam * F.col("u"))).alias("phi"))
        .select(F.col("i"), lam.alias("lam"), "phi")
    )
