"""The whole analyses: read a catalogue, compute, return or write the result."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxstats.box import Box
from boxstats.operators import charfn, fof, nearest, pairs, smoothing, spectra
from boxstats.operators.transforms import subsample, subsample_fraction
from boxstats.sources.catalog import (
    Catalog,
    read_catalog,
    smoothed_as_velocity,
    write_catalog,
    write_table,
)
from boxstats.sources.hdf5 import write_arrays, write_particles
from boxstats.sources.randoms import n_randoms, randoms
from boxstats.storage import materialize

log = logging.getLogger("boxstats")


def _load(spark: SparkSession, source: Catalog | str, **reading) -> Catalog:
    return source if isinstance(source, Catalog) else read_catalog(spark, source, **reading)


def _count(df: DataFrame) -> int:
    n = df.count()
    if n == 0:
        raise ValueError("the catalogue is empty")
    return n


def random_velocities(data: DataFrame, box: Box, n: int, seed: int = 0) -> DataFrame:
    """``n`` uniform points, each with the velocity of the nearest particle."""
    return materialize(nearest.nearest_velocity(data, randoms(data.sparkSession, n, box, seed), box))


def group_velocity(
    spark: SparkSession, source, out: str | None = None, linking_length: float = 0.2, fmt: str = "hdf5",
    halos: str | None = None, **reading,
) -> Catalog:
    """Friends-of-friends groups; every particle gets the mean velocity of its group.

    ``halos`` names an HDF5 file for the groups themselves: centres, velocities and sizes.
    """
    catalog = _load(spark, source, **reading)
    link = fof.linking_length(catalog.box, _count(catalog.df), linking_length)
    groups = materialize(fof.fof_groups(catalog.df, catalog.box, link))
    result = Catalog(fof.group_velocity(catalog.df, groups), catalog.box)
    if out:
        write_catalog(result, out, fmt)
    if halos:
        write_particles(fof.fof_halos(catalog.df, groups, catalog.box), halos, vars(catalog.box))
    return result


def smoothed_velocity(
    spark: SparkSession, source, out: str | None = None, r_smooth: float = 2.0, fmt: str = "hdf5", **reading
) -> Catalog:
    """Every particle gets the mean velocity within ``r_smooth``."""
    catalog = _load(spark, source, **reading)
    _count(catalog.df)
    smoothed = smoothing.smooth_velocity(catalog.df, catalog.box, r_smooth)
    result = Catalog(smoothed_as_velocity(smoothed), catalog.box, {"r_smooth": r_smooth})
    if out:
        write_catalog(result, out, fmt)
    return result


def matter_power(
    spark: SparkSession, source, nc: int = 128, redshift_space: bool = False, dk: float = 0.01,
    kmax: float = 0.0, out: str | None = None, **reading,
) -> DataFrame:
    catalog = _load(spark, source, **reading)
    table = spectra.power_matter(catalog.df, catalog.box, nc, dk, kmax, redshift_space, n_total=_count(catalog.df))
    if out:
        write_table(table, out, ["bin"])
    return table


def decomposed_power(
    spark: SparkSession,
    source,
    nc: int = 128,
    lambdas: list[float] = (1.0,),
    dk: float = 0.01,
    kmax: float = 0.0,
    shot_noise: float = 10.0,
    subtract_dd_shotnoise: bool = True,
    two_d: bool = False,
    sample: float | None = None,
    seed: int = 0,
    out: str | None = None,
    write_random: str | None = None,
    **reading,
) -> DataFrame:
    """P_DD, P_DU, P_UU for every distortion strength, as multipoles.

    ``two_d`` adds the table in (k, mu) from the same transform: a pair of tables, and of files
    (``out`` and ``out`` with ``-2d``).
    """
    catalog = _load(spark, source, **reading)
    data, box = catalog.df, catalog.box
    if sample is not None:
        data = materialize(subsample_fraction(data, sample, seed))
    n_data = _count(data)
    n_random = n_randoms(box, shot_noise)
    random = random_velocities(data, box, n_random, seed)
    if write_random:
        write_catalog(Catalog(random, box), write_random, "hdf5" if write_random.endswith(".h5") else "parquet")
    modes = spectra.decomposed_modes(
        data, random, box, nc, list(lambdas), subtract_shot_noise=subtract_dd_shotnoise, n_data=n_data, n_random=n_random
    )
    if two_d:
        modes = materialize(modes)
    table = materialize(spectra.multipoles_of(modes, box, nc, dk, kmax))
    if out:
        write_table(table, out, ["lam", "bin"])
        noise = {"shot_noise_data": box.volume / n_data, "shot_noise_random": box.volume / n_random}
        _write_scalars(spark, out, noise | {"n_data": n_data, "n_random": n_random, "aH": box.aH})
    if not two_d:
        return table
    grid = materialize(spectra.power_2d_of(modes, box, nc, list(lambdas), dk, kmax))
    if out:
        write_table(grid, f"{out}-2d", ["lam", "ix", "iy"])
    return table, grid


def _write_scalars(spark: SparkSession, out: str, values: dict[str, float]) -> None:
    """The numbers that go with a table, as one row beside it (``out`` with ``-parameters``)."""
    row = spark.range(1).select(*[F.lit(float(v)).alias(k) for k, v in values.items()])
    write_table(row, f"{out}-parameters", list(values)[:1])


def write_power_2d(table: DataFrame, path: str, lam: float, box: Box) -> None:
    """P(k, mu) of one strength as HDF5: k, mu, Pdd, Pdu, Puu, row by row of (k, mu) bins."""
    one = materialize(table.filter(table["lam"] == lam)).repartition(1).sortWithinPartitions("ix", "iy")
    empty = float("nan")
    columns = {"k": "k", "mu": "mu", "Pdd": "pdd", "Pdu": "pdu", "Puu": "puu"}
    one = one.fillna(empty, subset=list(columns.values()))
    last = one.agg({"ix": "max", "iy": "max"}).first()
    shape = (last["max(ix)"] + 1, last["max(iy)"] + 1)
    parameters = {"z": box.z, "omega_m": box.omega_m, "lambda": lam}
    write_arrays(one, path, parameters, {name: [(c, "<f4")] for name, c in columns.items()}, shape)


def characteristic_function(
    spark: SparkSession, source, n_random: int = 1_000_000, seed: int = 0, out: str | None = None, **reading
) -> tuple[DataFrame, DataFrame]:
    """phi(lambda) of the volume-weighted displacement, and its dispersion."""
    catalog = _load(spark, source, **reading)
    random = random_velocities(catalog.df, catalog.box, n_random, seed)
    phi = charfn.characteristic_function(random, catalog.box, n_points=n_random)
    sigma = charfn.velocity_dispersion(random, catalog.box)
    if out:
        write_table(phi, out, ["i"])
        _write_scalars(spark, out, {"aH": catalog.box.aH, "sigma2": sigma.first()["sigma2"], "n_random": n_random})
    return phi, sigma


def correlation_function_uu(
    spark: SparkSession,
    source,
    mode: str = "dduu",
    n_sample: int = 0,
    n_random: int | None = None,
    r_max: float = 200.0,
    dr: float = 1.0,
    seed: int = 0,
    out: str | None = None,
    **reading,
) -> DataFrame:
    """Pair statistics: ``dd`` of the data, ``uu`` of the randoms, or ``dduu`` of both.

    ``out`` takes the table, and beside it the counts and velocity dispersions of both sets.
    """
    if mode not in ("dd", "uu", "dduu"):
        raise ValueError(f"unknown mode {mode}")
    catalog = _load(spark, source, **reading)
    data, box = catalog.df, catalog.box
    n = _count(data)
    if 0 < n_sample < n:
        data, n = materialize(subsample(data, n_sample, seed)), n_sample
    if 2 * r_max > box.boxsize:
        log.warning("r_max is beyond half the box: the outer shells are only partly sampled")
    random = None if mode == "dd" else random_velocities(data, box, n_random or n, seed)
    if mode == "dd":
        table = pairs.xi_dd(data, box, r_max, dr)
    elif mode == "uu":
        table = pairs.pair_uu(random, box, r_max, dr)
    else:
        table = pairs.pair_dduu(data, random, box, r_max, dr)
    if out:
        table = materialize(table)
        write_table(table, out, ["ibin"])
        facts = {"n_data": n, "sigma2_data": charfn.velocity_dispersion(data, box).first()["sigma2"], "aH": box.aH}
        if random is not None:
            found = charfn.velocity_dispersion(random, box).first()
            facts |= {"n_random": found["n"], "sigma2_random": found["sigma2"]}
        _write_scalars(spark, out, facts)
    return table


def count_close_pairs(spark: SparkSession, source, r_max: float = 1.0, **reading) -> DataFrame:
    catalog = _load(spark, source, **reading)
    return pairs.count_pairs(catalog.df, catalog.box, r_max)
