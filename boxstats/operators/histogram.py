"""Fixed-width histograms: row counts and bin means."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bin_index(x: Column, xmin: float, dx: float) -> Column:
    return F.floor((x - F.lit(float(xmin))) / F.lit(float(dx))).cast("int")


def n_bins(xmin: float, xmax: float, dx: float) -> int:
    """Whole bins only: a last partial bin is left out."""
    return math.floor((xmax - xmin) / dx)


def in_range(index: Column, nbin: int) -> Column:
    return (index >= 0) & (index < nbin)


def hist_1d(
    df: DataFrame,
    x: str,
    values: list[str],
    xmin: float,
    xmax: float,
    dx: float,
    keys: list[str] = (),
) -> DataFrame:
    """Per bin: mean x, row count and the mean of each value. Empty bins give no row."""
    return (
        df.withColumn("bin", bin_index(F.col(x), xmin, dx))
        .filter(in_range(F.col("bin"), n_bins(xmin, xmax, dx)))
        .groupBy(*keys, "bin")
        .agg(
            F.avg(x).alias(f"{x}_mean"),
            F.count(F.lit(1)).alias("n"),
            *[F.avg(v).alias(f"{v}_mean") for v in values],
        )
    )


def pdf_1d(df: DataFrame, x: str, xmin: float, xmax: float, dx: float) -> DataFrame:
    """Normalised histogram: n / (total * dx) with the edges of each bin."""
    counts = hist_1d(df, x, [], xmin, xmax, dx)
    # One row per bin by now, so the total over all of them is small.
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    left = F.lit(float(xmin)) + F.col("bin") * F.lit(float(dx))
    return counts.select(
        "bin",
        left.alias("x_left"),
        (left + F.lit(0.5 * dx)).alias("x_mid"),
        (left + F.lit(float(dx))).alias("x_right"),
        "n",
        (F.col("n") / (total * F.lit(float(dx)))).alias("pdf"),
    )


def hist_2d(
    df: DataFrame,
    x: str,
    y: str,
    values: list[str],
    x_range: tuple[float, float, float],
    y_range: tuple[float, float, float],
    keys: list[str] = (),
    known: DataFrame | None = None,
) -> DataFrame:
    """As hist_1d on two axes (min, max, width); every bin of the grid has a row, NULL if empty.

    ``known`` holds the values of the keys, which saves looking for them in ``df``.
    """
    nx, ny = n_bins(*x_range), n_bins(*y_range)
    filled = (
        df.withColumn("ix", bin_index(F.col(x), x_range[0], x_range[2]))
        .withColumn("iy", bin_index(F.col(y), y_range[0], y_range[2]))
        .filter(in_range(F.col("ix"), nx) & in_range(F.col("iy"), ny))
        .groupBy(*keys, "ix", "iy")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(x).alias(f"{x}_mean"),
            F.avg(y).alias(f"{y}_mean"),
            *[F.avg(v).alias(f"{v}_mean") for v in values],
        )
    )
    cells = df.sparkSession.range(nx * ny).select(
        F.expr(f"cast(id div {ny} as int)").alias("ix"), F.expr(f"cast(id % {ny} as int)").alias("iy")
    )
    if keys:
        numbers = F.explode(F.sequence(F.lit(0), F.lit(nx * ny - 1)))
        cells = (
            (df.select(*keys).distinct() if known is None else known)
            .withColumn("_c", numbers)
            .select(
                *keys,
                F.expr(f"cast(_c div {ny} as int)").alias("ix"),
                F.expr(f"cast(_c % {ny} as int)").alias("iy"),
            )
        )
    return cells.join(filled, [*keys, "ix", "iy"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
