"""Catalogues on disk: particles and box parameters together."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxstats.box import Box
from boxstats.functions.periodic import V, X
from boxstats.sources import binary, hdf5, text


@dataclass(frozen=True)
class Catalog:
    df: DataFrame
    box: Box
    extra: dict[str, float] = field(default_factory=dict)


_BY_SUFFIX = {".h5": "hdf5", ".b": "subsample", ".parquet": "parquet"}


def guess_format(path: str) -> str:
    for suffix, fmt in _BY_SUFFIX.items():
        if path.rstrip("/").endswith(suffix):
            return fmt
    raise ValueError(f"unknown file type {path}; name the format")


def read_catalog(
    spark: SparkSession, path: str, fmt: str | None = None, box: Box | None = None, **options
) -> Catalog:
    """Read by format, or by the suffix of ``path``.

    fmt: parquet, hdf5, subsample (.b), snapshot, fof_text, mock_text, subhalo_text,
    fof_binary. Text and group files hold no cosmology, so they need ``box``.
    """
    fmt = fmt or guess_format(path)
    if fmt == "parquet":
        row = spark.read.parquet(f"{path}/parameters").first().asDict()
        found = Box(row.pop("boxsize"), row.pop("omega_m"), row.pop("a"))
        return Catalog(spark.read.parquet(f"{path}/particles"), found, row)
    if fmt == "hdf5":
        df, parameters = hdf5.read_particles(spark, path, **options)
        parameters = dict(parameters)
        size = parameters.pop("boxsize")
        if "omega_m" in parameters and "a" in parameters:
            found = Box(size, parameters.pop("omega_m"), parameters.pop("a"))
        elif box is not None:
            found = Box(size, box.omega_m, box.a)
        else:
            raise ValueError(f"{path} holds no omega_m and a; give a box")
        return Catalog(df, found, parameters)
    if fmt == "subsample":
        return Catalog(*binary.read_subsample_binary(spark, path))
    if fmt == "snapshot":
        return Catalog(*binary.read_snapshot(spark, path, **options))
    if box is None:
        raise ValueError(f"format {fmt} needs a box")
    if fmt == "fof_binary":
        df, size = binary.read_fof_binary(spark, path, **options)
        return Catalog(df, Box(size, box.omega_m, box.a))
    readers = {
        "fof_text": text.read_fof_text,
        "mock_text": text.read_mock_text,
        "subhalo_text": text.read_subhalo_text,
    }
    if fmt not in readers:
        raise ValueError(f"unknown format {fmt}")
    return Catalog(readers[fmt](spark, path, **options), box)


def write_catalog(catalog: Catalog, path: str, fmt: str = "parquet", **options) -> None:
    """Write particles with their parameters (``extra`` holds values such as r_smooth) as parquet, hdf5 or,
    without ``extra``, subsample. ``options`` go to the writer of the format."""
    parameters = {"boxsize": catalog.box.boxsize, "omega_m": catalog.box.omega_m, "a": catalog.box.a}
    parameters |= catalog.extra
    if fmt == "hdf5":
        hdf5.write_particles(catalog.df, path, parameters, **options)
        return
    if fmt == "subsample":
        binary.write_subsample_binary(catalog.df, path, catalog.box, **options)
        return
    if fmt != "parquet":
        raise ValueError(f"cannot write format {fmt}")
    catalog.df.write.parquet(f"{path}/particles")
    columns = [F.lit(float(v)).alias(k) for k, v in parameters.items()]
    catalog.df.sparkSession.range(1).select(*columns).write.parquet(f"{path}/parameters")


def smoothed_as_velocity(df: DataFrame) -> DataFrame:
    """Put the smoothed velocity in the place of the velocity, as smoothed catalogues store it."""
    return df.select("pid", *X, *[F.col(f"vs{i}").alias(v) for i, v in enumerate(V)])


def write_table(df: DataFrame, path: str, order: list[str]) -> None:
    """Result tables (one row per bin, so small) as a single sorted text file with a header."""
    df.repartition(1).sortWithinPartitions(*order).write.option("header", True).option("sep", " ").csv(path)
