"""Whitespace-separated particle and halo text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxstats.functions.periodic import V, X
from boxstats.operators.transforms import mass_cut
from boxstats.storage import materialize


def _lines(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path).select(
        F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("t"),
        F.trim("value").alias("line"),
    )


def _token(i: int) -> Column:
    return F.get(F.col("t"), F.lit(i))


def _numbers(first: int, cast) -> list[Column]:
    return [cast(_token(first + i)).alias(name) for i, name in enumerate((*X, *V))]


def _with_pid(df: DataFrame) -> DataFrame:
    # Numbers follow the split of the files, so they are written down once, and every later scan
    # reads the same ones.
    return materialize(df.select(F.monotonically_increasing_id().alias("pid"), *df.columns))


def _lenient(c: Column) -> Column:
    return c.try_cast("double")


def read_fof_text(
    spark: SparkSession,
    path,
    log_m_min: float = 1.0,
    log_m_max: float = 20.0,
    particle_mass: float = 0.75187e10,
) -> DataFrame:
    """``nfof x y z vx vy vz`` lines in the mass range; lines that do not parse are skipped."""
    rows = _lines(spark, path).select(_token(0).try_cast("int").alias("nfof"), *_numbers(1, _lenient))
    return _with_pid(mass_cut(rows.dropna(), log_m_min, log_m_max, particle_mass))


def read_mock_text(spark: SparkSession, path) -> DataFrame:
    """``x y z vx vy vz`` lines; ``#`` starts a comment line."""
    rows = _lines(spark, path).filter(~F.col("line").startswith("#")).select(*_numbers(0, _lenient))
    return _with_pid(rows.dropna())


def read_subhalo_text(
    spark: SparkSession, path, log_m_min: float = 1.0, log_m_max: float = 20.0
) -> DataFrame:
    """``m x y z vx vy vz`` lines with the cut on m itself; a malformed line is an error."""
    rows = (
        _lines(spark, path)
        .filter(~F.col("line").startswith("#") & (F.col("line") != ""))
        .withColumn("ok", F.assert_true(F.size("t") >= 7, F.concat(F.lit("malformed line: "), F.col("line"))))
        .filter("ok is null")
        .select(_token(0).cast("double").alias("m"), *_numbers(1, lambda c: c.cast("double")))
    )
    return _with_pid(rows.filter((F.col("m") >= 10.0**log_m_min) & (F.col("m") < 10.0**log_m_max)))
