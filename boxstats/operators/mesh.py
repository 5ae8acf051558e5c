"""Cloud-in-cell assignment to a periodic mesh.

A mesh is a sparse DataFrame (ix, iy, iz, value): an absent cell holds zero.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from boxstats.box import Box
from boxstats.functions.periodic import AXES, finite

CELL = ("ix", "iy", "iz")
_CORNERS = tuple(product((0, 1), repeat=3))


def deposit(
    points: DataFrame,
    box: Box,
    nc: int,
    fields: dict[str, Column | None],
    keys: list[str] = (),
) -> DataFrame:
    """Trilinear weights of every point on the 8 cells around it.

    ``fields`` maps an output column to a per-point weight (None for 1). The eight corner
    sums are first aggregated per base cell, so a cell crowded with points collapses before
    the shuffle and only aggregated cells are fanned out to their corners.
    """
    if nc <= 0:
        raise ValueError("nc must be positive")
    t = [finite(F.col(f"x{i}"), f"x{i}") * F.lit(float(nc)) / F.lit(float(box.boxsize)) for i in AXES]
    base = [F.floor(c) for c in t]
    columns = [F.col(k) for k in keys]
    columns += [F.pmod(b, F.lit(nc)).cast("int").alias(f"c{i}") for i, b in zip(AXES, base)]
    columns += [(c - b.cast("double")).alias(f"f{i}") for i, c, b in zip(AXES, t, base)]
    columns += [(F.lit(1.0) if w is None else finite(w.cast("double"), f)).alias(f"w_{f}") for f, w in fields.items()]

    def share(corner, field):
        parts = [F.col(f"f{i}") if corner[i] else 1.0 - F.col(f"f{i}") for i in AXES]
        return parts[0] * parts[1] * parts[2] * F.col(f"w_{field}")

    per_cell = (
        points.select(*columns)
        .groupBy(*keys, "c0", "c1", "c2")
        .agg(
            *[
                F.sum(share(corner, f)).alias(f"{f}_{n}")
                for f in fields
                for n, corner in enumerate(_CORNERS)
            ]
        )
    )
    corners = F.explode(
        F.array(
            *[
                F.struct(
                    *[
                        F.pmod(F.col(f"c{i}") + corner[i], F.lit(nc)).cast("int").alias(CELL[i])
                        for i in AXES
                    ],
                    *[F.col(f"{f}_{n}").alias(f) for f in fields],
                )
                for n, corner in enumerate(_CORNERS)
            ]
        )
    )
    return (
        per_cell.select(*keys, corners.alias("m"))
        .select(*keys, "m.*")
        .groupBy(*keys, *CELL)
        .agg(*[F.sum(f).alias(f) for f in fields])
    )


def cic_density(points: DataFrame, box: Box, nc: int, keys: list[str] = (), name: str = "rho") -> DataFrame:
    return deposit(points, box, nc, {name: None}, keys)


#: The largest relative loss of mass that an assignment may have.
MASS_LOSS = 1e-5


class MassError(ArithmeticError):
    pass


def observed_density(points: DataFrame, box: Box, nc: int, name: str = "rho") -> tuple[DataFrame, Callable[[], float]]:
    """``cic_density`` whose own job counts the points and adds up the mesh, and a check to call after it: it
    returns the relative loss of mass, or raises where that passes MASS_LOSS."""
    given, found = Observation(), Observation()
    points = points.observe(given, F.count(F.lit(1)).alias("n"))
    mesh = cic_density(points, box, nc, name=name).observe(found, F.sum(name).alias("mass"))

    def check() -> float:
        n, mass = given.get["n"], found.get["mass"] or 0.0
        loss = abs(mass - n) / n if n else 0.0
        if not loss < MASS_LOSS:
            raise MassError(f"{n} points gave a mesh of mass {mass}")
        return loss

    return mesh, check


def full_grid(mesh: DataFrame, nc: int, fields: list[str], keys: list[str] = ()) -> DataFrame:
    """Give every cell a row; absent cells become 0."""
    cells = F.sequence(F.lit(0), F.lit(nc - 1))
    spark = mesh.sparkSession
    if keys:
        planes = mesh.select(*keys).distinct().withColumn("ix", F.explode(cells))
    else:
        planes = spark.range(nc).select(F.col("id").cast("int").alias("ix"))
    grid = planes.withColumn("iy", F.explode(cells)).withColumn("iz", F.explode(cells))
    joined = grid.join(mesh, [*keys, *CELL], "left")
    return joined.select(*keys, *CELL, *[F.coalesce(f, F.lit(0.0)).alias(f) for f in fields])


def density_contrast(mesh: DataFrame, nc: int, n_total: int, name: str = "rho", keys: list[str] = ()) -> DataFrame:
    """delta = rho * nc^3 / N - 1 on all cells."""
    if n_total <= 0:
        raise ValueError("the catalogue is empty")
    scale = float(nc) ** 3 / n_total
    full = full_grid(mesh, nc, [name], keys)
    return full.select(*keys, *CELL, (F.col(name) * F.lit(scale) - 1.0).alias("delta"))


def cic_momentum(points: DataFrame, box: Box, nc: int, n_total: int) -> DataFrame:
    """CIC of 0.01 * v2 in units of the mean density, minus one on every cell."""
    mesh = deposit(points, box, nc, {"p": F.col("v2")})
    full = full_grid(mesh, nc, ["p"])
    scale = float(nc) ** 3 / n_total
    return full.select(*CELL, (F.lit(0.01) * F.col("p") * F.lit(scale) - 1.0).alias("momentum"))
