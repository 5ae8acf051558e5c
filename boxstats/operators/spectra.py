"""Power-spectrum estimators: modes, corrections and multipole averages.

The transform is dense, so every mode quantity is a column expression of the integer
frequencies on the row itself; nothing is joined to the spectrum.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxstats.box import Box
from boxstats.operators.fourier import fft_mesh
from boxstats.operators.histogram import bin_index, hist_2d, in_range, n_bins
from boxstats.operators.mesh import CELL, deposit
from boxstats.operators.transforms import redshift_space, with_lambdas

# Fixed values of the aliasing correction.
ALIAS_SHIFTS = (-2, -1, 0, 1)
ALIAS_SLOPE = -1.6
MU_WIDTH = 0.1


def frequency(i: Column, nc: int) -> Column:
    """Mesh index -> signed integer frequency."""
    return F.when(i > nc // 2, i - nc).otherwise(i)


def modes(spectrum: DataFrame, box: Box, nc: int) -> DataFrame:
    """Add n0..n2, k, mu2 and keep one of each +-k pair with 0 < k <= Nyquist.

    The Nyquist cut compares integers (4 n^2 <= nc^2), so it cannot depend on rounding.
    """
    with_n = spectrum.withColumns({f"n{i}": frequency(F.col(c), nc) for i, c in enumerate(CELL)})
    n2 = F.col("n0") * F.col("n0") + F.col("n1") * F.col("n1") + F.col("n2") * F.col("n2")
    half_space = (F.col("iz") > 0) | (F.col("n0") > 0) | ((F.col("n0") == 0) & (F.col("n1") > 0))
    kept = with_n.withColumn("nn", n2).filter(
        half_space & (F.col("iz") <= nc // 2) & (F.col("nn") > 0) & (4 * F.col("nn") <= nc * nc)
    )
    kf = 2.0 * math.pi / box.boxsize
    return kept.withColumn("k", F.lit(kf) * F.sqrt(F.col("nn").cast("double"))).withColumn(
        "mu2", (F.col("n2") * F.col("n2")).cast("double") / F.col("nn").cast("double")
    )


def shot_noise_shape(nc: int) -> Column:
    """C1 = prod_j (1 - 2/3 sin^2(pi n_j / nc))."""
    factors = []
    for i in range(3):
        s = F.sin(F.lit(math.pi) * F.col(f"n{i}") / F.lit(float(nc)))
        factors.append(1.0 - (2.0 / 3.0) * s * s)
    return factors[0] * factors[1] * factors[2]


def alias_sum(nc: int, neff: float = ALIAS_SLOPE) -> Column:
    """C2 = sum over 4^3 aliases of W^4 (k_a / k)^neff for the frequencies n0..n2.

    64 powers per mode on Arrow batches; as column expressions they outgrow compiled code.
    """

    @F.pandas_udf("double")
    def c2(n0: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
        axes = []
        for n in (n0, n1, n2):
            shifted = n.to_numpy(float)[:, None] + nc * np.array(ALIAS_SHIFTS)
            axes.append((np.sinc(shifted / nc) ** 4, shifted**2))
        k2 = sum(n.to_numpy(float) ** 2 for n in (n0, n1, n2))
        total = np.zeros(len(n0))
        for i, j, l in product(range(len(ALIAS_SHIFTS)), repeat=3):
            weight = axes[0][0][:, i] * axes[1][0][:, j] * axes[2][0][:, l]
            alias2 = axes[0][1][:, i] + axes[1][1][:, j] + axes[2][1][:, l]
            total += weight * (alias2 / k2) ** (0.5 * neff)
        return pd.Series(total)

    return c2("n0", "n1", "n2")


def with_corrections(df: DataFrame, nc: int, neff: float = ALIAS_SLOPE) -> DataFrame:
    return df.withColumn("c1", shot_noise_shape(nc)).withColumn("c2", alias_sum(nc, neff))


def subtract_fields(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Spectrum of a - b from the spectra of a and b."""
    return df.withColumns({f"{name}_{p}": F.col(f"{a}_{p}") - F.col(f"{b}_{p}") for p in ("re", "im")})


def cross_power(a: str, b: str) -> Column:
    """Re(a b*)."""
    return F.col(f"{a}_re") * F.col(f"{b}_re") + F.col(f"{a}_im") * F.col(f"{b}_im")


def multipole_weights() -> dict[int, Column]:
    """(2l + 1) P_l of mu for l = 0, 2, 4."""
    m = F.col("mu2")
    return {
        0: F.lit(1.0),
        2: 7.5 * m - 2.5,
        4: 1.125 * (35.0 * m * m - 30.0 * m + 3.0),
    }


def nyquist(box: Box, nc: int) -> float:
    return math.pi * nc / box.boxsize


def bin_multipoles(
    df: DataFrame, box: Box, nc: int, dk: float, kmax: float, columns: dict[str, tuple[str, int]], keys: list[str] = ()
) -> DataFrame:
    """Plain mean over the modes of each k bin; columns map name -> (power column, multipole)."""
    kmax = kmax or nyquist(box, nc)
    weight = multipole_weights()
    return (
        df.withColumn("bin", bin_index(F.col("k"), 0.0, dk))
        .filter(in_range(F.col("bin"), n_bins(0.0, kmax, dk)))
        .groupBy(*keys, "bin")
        .agg(
            F.avg("k").alias("k"),
            F.count(F.lit(1)).alias("n"),
            *[F.avg(F.col(p) * weight[l]).alias(name) for name, (p, l) in columns.items()],
        )
    )


def contrast_spectrum(
    points: DataFrame, box: Box, nc: int, n_total: int, name: str = "d", keys: list[str] = ()
) -> DataFrame:
    """Spectrum of the density contrast for k > 0.

    The "-1" of the contrast only touches k = 0, which no estimator reads, so the sparse
    mesh is transformed directly and never expanded to its empty cells.
    """
    if n_total <= 0:
        raise ValueError("the catalogue is empty")
    mesh = deposit(points, box, nc, {name: F.lit(float(nc) ** 3 / n_total)}, keys)
    return fft_mesh(mesh, nc, [name], keys)


def power_matter(
    points: DataFrame,
    box: Box,
    nc: int = 128,
    dk: float = 0.01,
    kmax: float = 0.0,
    redshift: bool = False,
    neff: float = ALIAS_SLOPE,
    n_total: int | None = None,
) -> DataFrame:
    """k, n, P0 (alias corrected), raw P0, P2, P4 of one catalogue. kmax = 0 means Nyquist."""
    if redshift:
        points = redshift_space(points, box)
    n_total = points.count() if n_total is None else n_total
    spectrum = with_corrections(modes(contrast_spectrum(points, box, nc, n_total), box, nc), nc, neff)
    norm = F.lit(box.volume / float(nc) ** 6)
    power = spectrum.withColumn("praw", norm * cross_power("d", "d")).withColumn("p", F.col("praw") / F.col("c2"))
    names = {"p0": ("p", 0), "p0_raw": ("praw", 0), "p2": ("p", 2), "p4": ("p", 4)}
    return bin_multipoles(power, box, nc, dk, kmax, names)


def decomposed_modes(
    data: DataFrame,
    random: DataFrame,
    box: Box,
    nc: int,
    lambdas: list[float],
    subtract_shot_noise: bool = True,
    neff: float = ALIAS_SLOPE,
    n_data: int | None = None,
    n_random: int | None = None,
) -> DataFrame:
    """Per mode and distortion strength: pdd, pdu, puu of data d and velocity-tracing randoms.

    Both catalogues and all strengths share one mesh aggregation and one transform.
    """
    n_data = data.count() if n_data is None else n_data
    n_random = random.count() if n_random is None else n_random
    if n_data <= 0 or n_random <= 0:
        raise ValueError("the catalogue is empty")
    cells = float(nc) ** 3

    def side(points, wd, wu):
        return points.select("x0", "x1", "x2", "v2", F.lit(wd).alias("_wd"), F.lit(wu).alias("_wu"))

    both = side(data, cells / n_data, 0.0).unionByName(side(random, 0.0, cells / n_random))
    shifted = redshift_space(with_lambdas(both, lambdas), box, F.col("lam"))
    mesh = deposit(shifted, box, nc, {"s": F.col("_wd"), "u": F.col("_wu")}, ["lam"])
    spectrum = with_corrections(modes(fft_mesh(mesh, nc, ["s", "u"], ["lam"]), box, nc), nc, neff)
    spectrum = subtract_fields(spectrum, "s", "u", "d")

    norm = F.lit(box.volume / cells**2)
    noise_u = F.lit(box.volume / n_random) * F.col("c1")
    noise_d = F.lit(box.volume / n_data if subtract_shot_noise else 0.0) * F.col("c1")
    return spectrum.withColumns(
        {
            "pdd": (norm * cross_power("d", "d") - noise_d - noise_u) / F.col("c2"),
            "pdu": (norm * cross_power("d", "u") + noise_u) / F.col("c2"),
            "puu": (norm * cross_power("u", "u") - noise_u) / F.col("c2"),
        }
    )


def power_decomposed(
    data: DataFrame,
    random: DataFrame,
    box: Box,
    nc: int = 128,
    lambdas: list[float] = (1.0,),
    dk: float = 0.01,
    kmax: float = 0.0,
    **options,
) -> DataFrame:
    """lam, k, n and the monopole, quadrupole and hexadecapole of DD, DU and UU."""
    return multipoles_of(decomposed_modes(data, random, box, nc, list(lambdas), **options), box, nc, dk, kmax)


def multipoles_of(power: DataFrame, box: Box, nc: int, dk: float = 0.01, kmax: float = 0.0) -> DataFrame:
    """The table of ``power_decomposed`` from the modes of ``decomposed_modes``."""
    names = {f"p{l}_{c}": (f"p{c}", l) for l in (0, 2, 4) for c in ("dd", "du", "uu")}
    return bin_multipoles(power, box, nc, dk, kmax, names, ["lam"])


def power_2d(
    data: DataFrame,
    random: DataFrame,
    box: Box,
    nc: int = 128,
    lambdas: list[float] = (1.0,),
    dk: float = 0.01,
    kmax: float = 0.0,
    include_mu1: bool = False,
    **options,
) -> DataFrame:
    """P(k, mu) of DD, DU and UU; every bin has a row, NULL where no mode falls.

    mu = 1 lies beyond the last bin and is left out unless ``include_mu1``.
    """
    power = decomposed_modes(data, random, box, nc, list(lambdas), **options)
    return power_2d_of(power, box, nc, list(lambdas), dk, kmax, include_mu1)


def power_2d_of(
    power: DataFrame, box: Box, nc: int, lambdas: list[float], dk: float = 0.01, kmax: float = 0.0, include_mu1: bool = False
) -> DataFrame:
    """The table of ``power_2d`` from the modes of ``decomposed_modes``."""
    mu = F.col("n2").cast("double") / F.sqrt(F.col("nn").cast("double"))
    power = power.withColumn("mu", mu)
    if include_mu1:
        power = power.withColumn("mu_bin", F.least(F.col("mu"), F.lit(1.0 - 0.5 * MU_WIDTH)))
    kmax = kmax or nyquist(box, nc)
    y = "mu_bin" if include_mu1 else "mu"
    table = hist_2d(
        power, "k", y, ["mu", "pdd", "pdu", "puu"] if include_mu1 else ["pdd", "pdu", "puu"],
        (0.0, kmax, dk), (0.0, 1.0, MU_WIDTH), ["lam"],
        power.sparkSession.createDataFrame([(float(x),) for x in lambdas], "lam double"),
    )
    return table.select(
        "lam", "ix", "iy", "n",
        F.col("k_mean").alias("k"), F.col("mu_mean").alias("mu"),
        F.col("pdd_mean").alias("pdd"), F.col("pdu_mean").alias("pdu"), F.col("puu_mean").alias("puu"),
    )
