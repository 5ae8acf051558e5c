"""Registered queries over the test tables and the equal SQL for each of them.

Sums of transcendental terms are rounded on both sides; everything else is exact. Rounding
is to the nearest, with the tie moved off the exact half, where a last bit would decide.
"""

from __future__ import annotations

import importlib
import os
import sys
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import boxstats as bs  # noqa: E402
from boxstats.operators import charfn, mesh, spectra, transforms  # noqa: E402
from boxstats.sources import binary, fixtures  # noqa: E402
from boxstats.sources.fixtures import BOX  # noqa: E402
from boxstats.storage import materialize, scratch_dir  # noqa: E402

NC = 16
# aH is 100 here, so these strengths shift by whole 1/128ths and keep the meshes exact.
EXACT_LAMBDAS = [0.0, 0.78125, 1.5625]
LAMBDAS = [0.0, 1.0]
DK = 0.03
R_MAX, DR = 20.0, 1.0
R_COUNT = 12.0
R_CLUMP = 1 / 128
R_SMOOTH = 8.0
FOF_B = 0.2
LOG_M = (11.5, 12.25)
PARTICLE_MASS = 0.75187e10
NFOF_MIN = 300
SAMPLE, SEED = 0.3, 11
K_NEAREST = 3
_VALUES = ["x0", "x1", "x2", "v0", "v1", "v2"]


def _particles(spark, sf):
    return fixtures.particles(spark, sf)


TIE = 0.4999


def _round(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    unit = F.lit(10.0**digits)
    return df.withColumns({c: F.floor(F.col(c) * unit + F.lit(TIE)).cast("double") / unit for c in columns})


def _lambda_points(spark, sf, lambdas):
    points = transforms.with_lambdas(_particles(spark, sf), lambdas)
    return bs.redshift_space(points, BOX, F.col("lam"))


def rsd_shift(spark, sf):
    return _lambda_points(spark, sf, EXACT_LAMBDAS).select("lam", "pid", "x0", "x1", "x2")


def wrap_positions(spark, sf):
    return bs.wrap_positions(_lambda_points(spark, sf, EXACT_LAMBDAS), BOX).select("lam", "pid", "x0", "x1", "x2")


def velocity_units(spark, sf):
    return bs.velocity_to_kms(_particles(spark, sf), 0.25).select("pid", "v0", "v1", "v2")


def physical_positions(spark, sf):
    return transforms.to_physical(_particles(spark, sf), 0.5).select("pid", "x0", "x1", "x2")


def displacement(spark, sf):
    return bs.displacement(_particles(spark, sf), BOX).select("pid", "u")


def cic_density(spark, sf):
    return bs.cic_density(_particles(spark, sf), BOX, NC)


def cic_density_rsd(spark, sf):
    return bs.cic_density(_lambda_points(spark, sf, EXACT_LAMBDAS), BOX, NC, ["lam"])


def density_contrast(spark, sf):
    points = _particles(spark, sf)
    return bs.density_contrast(bs.cic_density(points, BOX, NC), NC, points.count())


def cic_momentum(spark, sf):
    points = _particles(spark, sf)
    return bs.cic_momentum(points, BOX, NC, points.count())


def mass_cut(spark, sf):
    return bs.mass_cut(fixtures.halos(spark, sf), *LOG_M, PARTICLE_MASS)


def subsample_exact(spark, sf):
    return transforms.subsample_fraction(_particles(spark, sf), SAMPLE, SEED)


def bbox(spark, sf):
    return bs.bounding_box(_particles(spark, sf))


def hist_1d(spark, sf):
    return _round(bs.hist_1d(_particles(spark, sf), "x0", ["v2"], 0.0, 256.0, 10.0), "v2_mean")


def pdf_1d(spark, sf):
    return _round(bs.pdf_1d(_particles(spark, sf), "v2", -1000.0, 1001.0, 100.0), "pdf", digits=9)


def hist_2d(spark, sf):
    df = bs.hist_2d(_particles(spark, sf), "x0", "x1", ["v2"], (0.0, 256.0, 6.0), (0.0, 256.0, 6.0))
    return _round(df, "x0_mean", "x1_mean", "v2_mean")


def velocity_dispersion(spark, sf):
    return _round(bs.velocity_dispersion(_particles(spark, sf), BOX), "sigma2")


def char_function(spark, sf):
    return _round(bs.characteristic_function(_particles(spark, sf), BOX), "phi")


def _randoms(spark, sf) -> DataFrame:
    return materialize(bs.nearest_velocity(_particles(spark, sf), fixtures.random_points(spark, sf), BOX))


def nearest_velocity(spark, sf):
    return bs.nearest_velocity(_particles(spark, sf), fixtures.random_points(spark, sf), BOX)


def char_function_randoms(spark, sf):
    return _round(bs.characteristic_function(_randoms(spark, sf), BOX), "phi")


def knn(spark, sf):
    return bs.knn(fixtures.random_points(spark, sf), _particles(spark, sf), BOX, K_NEAREST).select(
        "qid", "rank", "pid", "d2"
    )


def pair_count_auto(spark, sf):
    return bs.count_pairs(_particles(spark, sf), BOX, R_COUNT).select(F.col("n_pairs").cast("long"))


def xi_dd(spark, sf):
    return _round(bs.xi_dd(_particles(spark, sf), BOX, R_MAX, DR), "xi0", "xi2", "dd_mean")


def pair_uu(spark, sf):
    found = bs.pair_uu(_randoms(spark, sf), BOX, R_MAX, DR)
    return _round(found.withColumn("n", F.col("n").cast("long")), "uu0", "uu2")


DDUU = ("xi0", "ww0", "ww2", "uu0", "uu2", "uu4", "ddww0", "ddww2", "ddww4", "dduu0", "dduu2", "du1", "du3")


def pair_dduu(spark, sf):
    return _round(bs.pair_dduu(_particles(spark, sf), _randoms(spark, sf), BOX, R_MAX, DR), *DDUU)


def xi_monopole(spark, sf):
    df = bs.xi_monopole(_particles(spark, sf), BOX, R_MAX, DR)
    return _round(df.withColumn("n", F.col("n").cast("long")), "xi0", "uu0", "ww0")


def _squeezed(spark, sf) -> DataFrame:
    """Half of the particles within 1/32 of one place, far below the finest cell."""
    x = [F.when(F.col("pid") % 2 == 0, F.lit(100.0) + F.col(f"x{i}") / 8192).otherwise(F.col(f"x{i}")).alias(f"x{i}") for i in range(3)]
    return _particles(spark, sf).select("pid", *x, "v2")


def xi_monopole_clump(spark, sf):
    df = bs.xi_monopole(_squeezed(spark, sf), BOX, R_MAX, DR)
    return _round(df.withColumn("n", F.col("n").cast("long")), "xi0", "uu0", "ww0")


COPIED = ("p2", "uu0", "uu2", "uu4", "ww0", "ww2", "ww4", "u1", "u3")


def pair_moments_copies(spark, sf):
    """A third of the particles share 8 places, so the odd moments pair copies in the order of pid."""
    x = [F.when(F.col("pid") % 3 == 0, F.floor(F.col(f"x{i}") / 128) * 16.0).otherwise(F.col(f"x{i}")).alias(f"x{i}") for i in range(3)]
    points = _particles(spark, sf).select("pid", *x, "v2")
    df = bs.pair_bins(points, None, BOX, R_MAX, DR)
    return _round(df.withColumn("n", F.col("n").cast("long")), *COPIED, digits=3)


def smooth_velocity(spark, sf):
    df = bs.smooth_velocity(_particles(spark, sf), BOX, R_SMOOTH)
    return _round(df, "vs0", "vs1", "vs2")


def dft_mesh(spark, sf):
    points = _particles(spark, sf)
    return _round(bs.fft_mesh(bs.cic_density(points, BOX, NC), NC, ["rho"]), "rho_re", "rho_im")


def dft_mesh_lines(spark, sf):
    """The transform of a mesh whose planes are too large for a task: lines of all three axes."""
    mesh = bs.cic_density(_particles(spark, sf), BOX, NC)
    return _round(bs.fft_mesh(mesh, NC, ["rho"], plane_cells=NC * NC - 1), "rho_re", "rho_im")


def mode_table(spark, sf):
    points = _particles(spark, sf)
    spectrum = spectra.contrast_spectrum(points, BOX, NC, points.count())
    table = spectra.with_corrections(bs.modes(spectrum, BOX, NC), NC)
    table = table.withColumn("power", spectra.cross_power("d", "d"))
    return _round(table.select("ix", "iy", "iz", "k", "mu2", "c1", "c2", "power"), "k", "mu2", "c1", "c2", "power")


MATTER = ("k", "p0", "p0_raw", "p2", "p4")


def power_matter(spark, sf):
    return _round(bs.power_matter(_particles(spark, sf), BOX, NC, DK), *MATTER)


def power_matter_rsd(spark, sf):
    return _round(bs.power_matter(_particles(spark, sf), BOX, NC, DK, redshift=True), *MATTER)


DECOMPOSED = ("k", *[f"p{l}_{c}" for l in (0, 2, 4) for c in ("dd", "du", "uu")])


def _decomposed(spark, sf, lambdas, **options):
    df = bs.power_decomposed(_particles(spark, sf), _randoms(spark, sf), BOX, NC, lambdas, DK, **options)
    return _round(df, *DECOMPOSED)


def power_decomposed(spark, sf):
    return _decomposed(spark, sf, [1.0])


def power_decomposed_lambda(spark, sf):
    return _decomposed(spark, sf, LAMBDAS)


def power_decomposed_raw_noise(spark, sf):
    return _decomposed(spark, sf, [1.0], subtract_shot_noise=False)


def power_2d(spark, sf):
    df = bs.power_2d(_particles(spark, sf), _randoms(spark, sf), BOX, NC, LAMBDAS, DK)
    return _round(df, "k", "mu", "pdd", "pdu", "puu")


def _groups(spark, sf) -> DataFrame:
    points = _particles(spark, sf)
    return bs.fof_groups(points, BOX, bs.linking_length(BOX, points.count(), FOF_B))


def fof_groups(spark, sf):
    return _groups(spark, sf)


def fof_halos(spark, sf):
    df = bs.fof_halos(_particles(spark, sf), materialize(_groups(spark, sf)), BOX)
    return _round(df, "x0", "x1", "x2", "v0", "v1", "v2")


def group_velocity(spark, sf):
    df = bs.group_velocity(_particles(spark, sf), materialize(_groups(spark, sf)))
    return _round(df, "v0", "v1", "v2")


def pair_count_clump(spark, sf):
    return bs.count_pairs(_squeezed(spark, sf).drop("v2"), BOX, R_CLUMP).select(F.col("n_pairs").cast("long"))


# --- Files: written, read back, and compared with the rows they were made of -----------------


def _file(spark, suffix: str) -> str:
    return f"{scratch_dir(spark)}/file-{uuid.uuid4().hex}{suffix}"


def _round_trip(spark, sf, suffix: str, fmt: str) -> DataFrame:
    path = _file(spark, suffix)
    bs.write_catalog(bs.Catalog(_particles(spark, sf), BOX), path, fmt)
    return bs.read_catalog(spark, path).df.select(*_VALUES)


def file_hdf5(spark, sf):
    return _round_trip(spark, sf, ".h5", "hdf5")


def file_parquet(spark, sf):
    return _round_trip(spark, sf, ".parquet", "parquet")


def file_snapshot(spark, sf):
    path = _file(spark, "")
    binary.write_snapshot(_particles(spark, sf), path, BOX, PARTICLE_MASS)
    return bs.read_catalog(spark, path, "snapshot", columns=("id", "m")).df.select("id", "m", *_VALUES)


def file_hdf5_parts(spark, sf):
    """Numbered files below a URI; the scan reads the two columns asked for and the rows of a range of pid."""
    path = _file(spark, ".h5")
    points = _particles(spark, sf)
    bs.write_catalog(bs.Catalog(points.repartitionByRange(3, "pid").sortWithinPartitions("pid"), BOX), path, "hdf5", rows_per_file=1 + points.count() // 4)
    found = bs.read_catalog(spark, path, columns=("x0", "x1", "x2")).df
    return found.filter("pid >= 100 AND pid < 700").select("x0", "x1", "x2")


def file_snapshot_types(spark, sf):
    """Five particle types in four files, with masses by header and by particle, and gas records."""
    path = _file(spark, "")
    points = _particles(spark, sf).selectExpr("*", "int(pid % 5) AS ptype", "pid % 7 + 1.0D AS m", "pid % 64 / 4.0D AS u", "pid % 32 / 8.0D AS rho")
    binary.write_snapshot(points, path, BOX, {1: PARTICLE_MASS, 3: 4.0}, rows_per_file=1 + points.count() // 4)
    columns = ("ptype", "id", "m", "u", "rho")
    return bs.read_catalog(spark, path, "snapshot", ptypes=(0, 1, 2, 3, 4), columns=columns).df.select(*columns, *_VALUES)


def file_subsample(spark, sf):
    return _round_trip(spark, sf, ".b", "subsample")


def file_fof_binary(spark, sf):
    path = _file(spark, "")
    binary.write_fof_binary(fixtures.halos(spark, sf), path, BOX, FOF_B, 1000)
    return bs.read_catalog(spark, path, "fof_binary", BOX, nfof_min=NFOF_MIN).df.select("nfof", *_VALUES)


def _text(spark, df: DataFrame, columns: list[str]) -> str:
    path = _file(spark, "")
    df.select(F.concat_ws(" ", *columns)).write.text(path)
    return path


def file_mock_text(spark, sf):
    path = _text(spark, _particles(spark, sf), _VALUES)
    return bs.read_catalog(spark, path, "mock_text", BOX).df.select(*_VALUES)


def file_fof_text(spark, sf):
    path = _text(spark, fixtures.halos(spark, sf), ["nfof", *_VALUES])
    return bs.read_catalog(spark, path, "fof_text", BOX).df.select("nfof", *_VALUES)


def file_subhalo_text(spark, sf):
    path = _text(spark, fixtures.halos(spark, sf).withColumn("m", F.col("nfof") * 1000.0), ["m", *_VALUES])
    return bs.read_catalog(spark, path, "subhalo_text", BOX).df.select("m", *_VALUES)


def entry(spark: SparkSession) -> DataFrame:
    """Decomposed power spectrum (DD, DU, UU multipoles) at two distortion strengths."""
    return power_decomposed_lambda(spark, "/root/testdata/sf0.001")


_QUERIES = (
    rsd_shift, wrap_positions, velocity_units, physical_positions, displacement, cic_density, cic_density_rsd,
    density_contrast, cic_momentum, mass_cut, subsample_exact, bbox, hist_1d, pdf_1d, hist_2d,
    velocity_dispersion, char_function, char_function_randoms, nearest_velocity, knn,
    pair_count_auto, xi_dd, xi_monopole, xi_monopole_clump, pair_uu, pair_dduu, pair_moments_copies, smooth_velocity, dft_mesh, dft_mesh_lines, mode_table,
    power_matter, power_matter_rsd, power_decomposed, power_decomposed_lambda,
    power_decomposed_raw_noise, power_2d, fof_groups, fof_halos, group_velocity, pair_count_clump,
    file_hdf5, file_hdf5_parts, file_parquet, file_snapshot, file_snapshot_types, file_subsample, file_fof_binary, file_mock_text, file_fof_text, file_subhalo_text,
)


def _optional(name: str):
    """The module, or None where its package has been taken out."""
    try:
        return importlib.import_module(name)
    except ModuleNotFoundError as error:
        if error.name in ("corpus_pipeline", "boxstats.llm", "boxstats.llm.queries"):
            return None
        raise


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {q.__name__: q for q in _QUERIES}
    if llm := _optional("boxstats.llm.queries"):
        found |= llm.queries()
    if pipeline := _optional("corpus_pipeline"):
        found["pipeline"] = pipeline.run
    return found


# --- SQL ----------------------------------------------------------------------------------


def _lattice_sql(a: str, b: str, m: tuple[int, int, int]) -> str:
    a, b = f"({a} % 4096)", f"({b} % 4096)"
    return f"(({a} * {a} * {m[0]} + {a} * {m[1]} + {b} * {m[2]}) % 4096)::DOUBLE / 16.0::DOUBLE"


def _table_sql(table: str, a: str, b: str, extra: str = "") -> str:
    x = ", ".join(f"{_lattice_sql(a, b, fixtures.POSITION[i])} AS x{i}" for i in range(3))
    v = ", ".join(
        f"(({a} * {m[0]} + {b} * {m[1]}) % 2001 - 1000)::DOUBLE AS v{i}" for i, m in enumerate(fixtures.VELOCITY)
    )
    return f"SELECT {a} AS pid, {extra} {x}, {v} FROM {table}"


_P = f"p AS ({_table_sql('events', 'event_id', 'user_id')})"
_HALOS = _table_sql("orders", "o_orderkey", "o_custkey", "(1 + o_custkey % 500)::INTEGER AS nfof,")
_RP = "rp AS (SELECT c_custkey AS pid, " + ", ".join(
    f"{_lattice_sql('c_custkey', '7', fixtures.POSITION[i])} + 1.0::DOUBLE / 32.0::DOUBLE AS x{i}" for i in range(3)
) + " FROM customer)"


def _near2(a: str, b: str) -> str:
    d = [f"least(abs({a}.x{i} - {b}.x{i}), 256 - abs({a}.x{i} - {b}.x{i}))" for i in range(3)]
    return "(" + " + ".join(f"{x} * {x}" for x in d) + ")"


def _r(expr: str, name: str, digits: int = 6) -> str:
    return f"floor(({expr}) * 1e{digits}::DOUBLE + {TIE}::DOUBLE) / 1e{digits}::DOUBLE AS {name}"


# Random points with the velocity of the nearest particle, ties to the smaller pid.
_R = f"""{_P}, {_RP},
rd AS (SELECT rp.pid AS q, p.pid, {_near2('rp', 'p')} AS d2 FROM rp, p),
rm AS (SELECT q, min(d2) AS d2 FROM rd GROUP BY q),
rn AS (SELECT rd.q, min(rd.pid) AS pid FROM rd JOIN rm USING (q, d2) GROUP BY rd.q),
r AS (SELECT rp.pid, rp.x0, rp.x1, rp.x2, p.v0, p.v1, p.v2
      FROM rp JOIN rn ON rn.q = rp.pid JOIN p ON p.pid = rn.pid)"""

_WRAP = "CASE WHEN {0} < 0 THEN {0} + 256 * ceil(-{0} / 256) WHEN {0} >= 256 THEN {0} - 256 * floor({0} / 256) ELSE {0} END"


def _values(lambdas) -> str:
    return "l AS (SELECT * FROM (VALUES " + ", ".join(f"({v}::DOUBLE)" for v in lambdas) + ") t(lam))"


def _shifted(source: str, lambdas) -> str:
    return f"SELECT lam, pid, x0, x1, x2 + lam * v2 / 100.0::DOUBLE AS x2, v2 FROM {source}, l"


def _mesh_sql(source: str, weight: str = "1.0::DOUBLE", keys: str = "") -> str:
    """Sparse cloud-in-cell mesh of a relation with x0..x2 (SELECT text)."""
    cells = f"SELECT {keys} {weight} AS w, " + ", ".join(
        f"floor(x{i} / 16)::BIGINT AS i{i}, x{i} / 16 - floor(x{i} / 16) AS f{i}" for i in range(3)
    )
    share = " * ".join(f"(CASE WHEN c{i} = 1 THEN f{i} ELSE 1 - f{i} END)" for i in range(3))
    index = ", ".join(f"(((i{i} + c{i}) % 16 + 16) % 16)::INTEGER AS {n}" for i, n in enumerate(("ix", "iy", "iz")))
    corners = "(VALUES (0), (1)) a(c0), (VALUES (0), (1)) b(c1), (VALUES (0), (1)) c(c2)"
    group = "ALL"
    return (
        f"SELECT {keys} ix, iy, iz, sum(m) AS rho FROM (SELECT {keys} {index}, {share} * w AS m "
        f"FROM ({cells} FROM {source}) s, {corners}) t GROUP BY {group}"
    )


_GRID = "grid AS (SELECT a.i::INTEGER AS ix, b.i::INTEGER AS iy, c.i::INTEGER AS iz FROM range(16) a(i), range(16) b(i), range(16) c(i))"


def _dft_sql(source: str, prefix: str, keys: str = "") -> str:
    """Three separable passes over a mesh relation (keys, ix, iy, iz, rho): CTE <prefix>."""

    def angle(k: str, i: str) -> str:
        return f"2 * pi() * (({k} * {i}) % 16) / 16"

    def step(name, src, old, new, limit):
        a = angle("kk.k", old)
        others = ", ".join(c for c in ("ix", "iy", "iz") if c != old)
        order = {"ix": f"kk.k::INTEGER AS ix, {others}", "iy": f"{others}, kk.k::INTEGER AS iy", "iz": f"{others}, kk.k::INTEGER AS iz"}[new]
        return (
            f"{name} AS (SELECT {keys} {order}, sum(re * cos({a}) + im * sin({a})) AS re, "
            f"sum(im * cos({a}) - re * sin({a})) AS im FROM {src}, range({limit}) kk(k) GROUP BY ALL)"
        )

    start = f"{prefix}0 AS (SELECT {keys} ix, iy, iz, rho AS re, 0.0::DOUBLE AS im FROM {source})"
    return ", ".join(
        [
            start,
            step(f"{prefix}1", f"{prefix}0", "iz", "iz", 9),
            step(f"{prefix}2", f"{prefix}1", "iy", "iy", 16),
            step(prefix, f"{prefix}2", "ix", "ix", 16),
        ]
    )


# Modes of the half space up to the Nyquist frequency, with both corrections.
_MODES = """
mode0 AS (SELECT ix, iy, iz, CASE WHEN ix > 8 THEN ix - 16 ELSE ix END AS n0,
          CASE WHEN iy > 8 THEN iy - 16 ELSE iy END AS n1, iz AS n2 FROM grid WHERE iz <= 8),
mode1 AS (SELECT *, n0 * n0 + n1 * n1 + n2 * n2 AS nn FROM mode0
          WHERE iz > 0 OR n0 > 0 OR (n0 = 0 AND n1 > 0)),
alias AS (SELECT * FROM (VALUES (-2), (-1), (0), (1)) a(a0), (VALUES (-2), (-1), (0), (1)) b(a1),
          (VALUES (-2), (-1), (0), (1)) c(a2)),
term AS (SELECT ix, iy, iz, nn, n0 + 16 * a0 AS q0, n1 + 16 * a1 AS q1, n2 + 16 * a2 AS q2
         FROM mode1, alias WHERE nn > 0 AND 4 * nn <= 256),
corr AS (SELECT ix, iy, iz, sum(
    power((CASE WHEN q0 = 0 THEN 1.0::DOUBLE ELSE sin(pi() * q0 / 16) / (pi() * q0 / 16) END) *
          (CASE WHEN q1 = 0 THEN 1.0::DOUBLE ELSE sin(pi() * q1 / 16) / (pi() * q1 / 16) END) *
          (CASE WHEN q2 = 0 THEN 1.0::DOUBLE ELSE sin(pi() * q2 / 16) / (pi() * q2 / 16) END), 4) *
    power((q0 * q0 + q1 * q1 + q2 * q2)::DOUBLE / nn, -0.8)) AS c2 FROM term GROUP BY ALL),
mode AS (SELECT m.*, 2 * pi() / 256 * sqrt(nn::DOUBLE) AS k, (n2 * n2)::DOUBLE / nn::DOUBLE AS mu2, c2,
    (1 - 2.0::DOUBLE / 3 * power(sin(pi() * n0 / 16), 2)) * (1 - 2.0::DOUBLE / 3 * power(sin(pi() * n1 / 16), 2)) *
    (1 - 2.0::DOUBLE / 3 * power(sin(pi() * n2 / 16), 2)) AS c1
    FROM mode1 m JOIN corr USING (ix, iy, iz))"""

_W2, _W4 = "(7.5 * mu2 - 2.5)", "(1.125 * (35 * mu2 * mu2 - 30 * mu2 + 3))"
_NBIN = "floor(pi() * 16 / 256 / 0.03::DOUBLE)"


def _matter_sql(lam: float) -> str:
    return f"""WITH {_P}, {_values([lam])}, s AS ({_shifted('p', [lam])}), {_GRID},
m AS ({_mesh_sql('s')}), {_dft_sql('m', 'f')}, {_MODES},
q AS (SELECT floor(k / 0.03::DOUBLE)::INTEGER AS bin, k, mu2, c2,
      (re * re + im * im) * power(4096.0::DOUBLE / (SELECT count(*) FROM p), 2) AS praw
      FROM f JOIN mode USING (ix, iy, iz))
SELECT bin, {_r('avg(k)', 'k')}, count(*) AS n, {_r('avg(praw / c2)', 'p0')}, {_r('avg(praw)', 'p0_raw')},
{_r(f'avg(praw / c2 * {_W2})', 'p2')}, {_r(f'avg(praw / c2 * {_W4})', 'p4')}
FROM q WHERE bin < {_NBIN} GROUP BY bin"""


def _decomposed_modes_sql(lambdas, subtract: bool = True) -> str:
    noise = "1" if subtract else "0"
    return f"""WITH {_R}, {_values(lambdas)}, sp AS ({_shifted('p', lambdas)}), sr AS ({_shifted('r', lambdas)}), {_GRID},
np AS (SELECT count(*)::DOUBLE AS n FROM p), nr AS (SELECT count(*)::DOUBLE AS n FROM r),
mp AS ({_mesh_sql('sp', keys='lam,')}), mr AS ({_mesh_sql('sr', keys='lam,')}),
{_dft_sql('mp', 'fp', 'lam,')}, {_dft_sql('mr', 'fr', 'lam,')}, {_MODES},
a AS (SELECT fp.lam, mode.*, fp.re * 4096 / np.n - fr.re * 4096 / nr.n AS dre, fp.im * 4096 / np.n - fr.im * 4096 / nr.n AS dim,
      fr.re * 4096 / nr.n AS ure, fr.im * 4096 / nr.n AS uim,
      c1 * 16777216.0::DOUBLE / np.n * {noise} AS sd, c1 * 16777216.0::DOUBLE / nr.n AS su
      FROM fp JOIN fr USING (lam, ix, iy, iz) JOIN mode USING (ix, iy, iz), np, nr),
q AS (SELECT lam, k, mu2, n2, nn, floor(k / 0.03::DOUBLE)::INTEGER AS bin,
      (dre * dre + dim * dim - sd - su) / c2 AS dd, (dre * ure + dim * uim + su) / c2 AS du,
      (ure * ure + uim * uim - su) / c2 AS uu FROM a)"""


def _decomposed_sql(lambdas, subtract: bool = True) -> str:
    columns = ", ".join(
        _r(f"avg({c}{w})", f"p{l}_{c}")
        for l, w in ((0, ""), (2, f" * {_W2}"), (4, f" * {_W4}"))
        for c in ("dd", "du", "uu")
    )
    return f"""{_decomposed_modes_sql(lambdas, subtract)}
SELECT lam, bin, {_r('avg(k)', 'k')}, count(*) AS n, {columns} FROM q WHERE bin < {_NBIN} GROUP BY lam, bin"""


def _power_2d_sql() -> str:
    return f"""{_decomposed_modes_sql(LAMBDAS)},
b AS (SELECT *, floor((n2::DOUBLE / sqrt(nn::DOUBLE)) / 0.1::DOUBLE)::INTEGER AS iy, n2::DOUBLE / sqrt(nn::DOUBLE) AS mu FROM q),
g AS (SELECT lam, bin AS ix, iy, count(*) AS n, {_r('avg(k)', 'k')}, {_r('avg(mu)', 'mu')}, {_r('avg(dd)', 'pdd')},
      {_r('avg(du)', 'pdu')}, {_r('avg(uu)', 'puu')} FROM b GROUP BY ALL),
bins AS (SELECT lam, a.i::INTEGER AS ix, b.i::INTEGER AS iy FROM l, range({int(0.19634954084936207 / DK)}) a(i), range(10) b(i))
SELECT lam, ix, iy, coalesce(n, 0)::BIGINT AS n, k, mu, pdd, pdu, puu FROM bins LEFT JOIN g USING (lam, ix, iy)"""


_SHELLS = f"""shell AS (SELECT i::INTEGER AS ibin, (i + 0.5::DOUBLE) AS r_mid,
    4 * pi() / 3 * (power(i + 1.0::DOUBLE, 3) - power(i::DOUBLE, 3)) / 16777216.0::DOUBLE AS fraction FROM range({int(R_MAX)}) t(i))"""


def _signed(a: str, b: str, i: int) -> str:
    d = f"({a}.x{i} - {b}.x{i})"
    return f"(CASE WHEN {d} > 128 THEN {d} - 256 WHEN {d} < -128 THEN {d} + 256 ELSE {d} END)"


def _pairs_sql(name: str, a: str, b: str, auto: bool) -> str:
    """Per shell sums over pairs of relations with pid, x0..x2, u: CTE <name>."""
    # Odd moments of an auto pair take x from the particle with the smaller pid.
    order = "WHERE a.pid < b.pid" if auto else ""
    return f"""{name}0 AS (SELECT a.u AS ux, b.u AS uy, {_near2('a', 'b')} AS s2, {_signed('a', 'b', 2)} AS rz FROM {a} a, {b} b {order}),
{name}1 AS (SELECT ux, uy, sqrt(s2) AS s, rz / sqrt(s2) AS nu FROM {name}0 WHERE s2 > 0 AND s2 < {R_MAX * R_MAX}),
{name}2 AS (SELECT floor(s / {DR})::INTEGER AS ibin, ux * uy AS uu, (ux - uy) * (ux - uy) AS ww, uy, nu,
    1.5 * nu * nu - 0.5 AS p2, 0.5 * (5 * nu * nu - 3) * nu AS p3, 0.125 * (35 * nu * nu * nu * nu - 30 * nu * nu + 3) AS p4 FROM {name}1),
{name} AS (SELECT ibin, count(*) AS n, sum(p2) AS p2, sum(uu) AS uu0, sum(uu * p2) AS uu2, sum(uu * p4) AS uu4, sum(ww) AS ww0,
    sum(ww * p2) AS ww2, sum(ww * p4) AS ww4, sum(uy * nu) AS u1, sum(uy * p3) AS u3 FROM {name}2 GROUP BY ibin)"""


def _moving(name: str, source: str) -> str:
    return f"{name} AS (SELECT pid, x0, x1, x2, v2 / 100.0::DOUBLE AS u FROM {source})"


_SQUEEZED = "sq AS (SELECT pid, " + ", ".join(f"CASE WHEN pid % 2 = 0 THEN 100 + x{i} / 8192 ELSE x{i} END AS x{i}" for i in range(3)) + ", v2 FROM p)"
_COPIES = "cp AS (SELECT pid, " + ", ".join(f"CASE WHEN pid % 3 = 0 THEN floor(x{i} / 128) * 16 ELSE x{i} END AS x{i}" for i in range(3)) + ", v2 FROM p)"


def _monopole_sql(source: str, *extra: str) -> str:
    mean = "(0.5 * c.n * (c.n - 1) * fraction)"
    return f"""WITH {", ".join([_P, *extra])}, {_moving('ud', source)}, {_pairs_sql('dd', 'ud', 'ud', True)}, {_SHELLS}, c AS (SELECT count(*)::DOUBLE AS n FROM p)
SELECT ibin, r_mid, coalesce(dd.n, 0)::BIGINT AS n, {_r(f'coalesce(dd.n, 0) / {mean} - 1', 'xi0')}, {_r('coalesce(uu0 / dd.n, 0)', 'uu0')},
{_r('coalesce(ww0 / dd.n, 0)', 'ww0')} FROM shell LEFT JOIN dd USING (ibin), c"""


def _dduu_sql() -> str:
    def mean(kind, moment):
        n = {"dd": "0.5 * nd.n * (nd.n - 1)", "dr": "nd.n * nr.n", "rr": "0.5 * nr.n * (nr.n - 1)"}[kind]
        return f"(coalesce({kind}.{moment}, 0) / ({n} * fraction))"

    def per_pair(moment, factor):
        return f"coalesce({factor} * rr.{moment} / rr.n, 0)"

    def excess(moment, factor):
        return f"{factor} * ({mean('dd', moment)} - 2 * {mean('dr', moment)} + {mean('rr', moment)})"

    def odd(moment, factor):
        return f"{factor} * ({mean('dr', moment)} - {mean('rr', moment)})"

    columns = {
        "xi0": f"{mean('dd', 'n')} - 1",
        "ww0": per_pair("ww0", 1), "ww2": per_pair("ww2", 5),
        "uu0": per_pair("uu0", 1), "uu2": per_pair("uu2", 5), "uu4": per_pair("uu4", 9),
        "ddww0": excess("ww0", 1), "ddww2": excess("ww2", 5), "ddww4": excess("ww4", 9),
        "dduu0": excess("uu0", 1), "dduu2": excess("uu2", 5),
        "du1": odd("u1", 3), "du3": odd("u3", 7),
    }
    return f"""WITH {_R}, {_moving('ud', 'p')}, {_moving('ur', 'r')}, {_pairs_sql('dd', 'ud', 'ud', True)},
{_pairs_sql('dr', 'ud', 'ur', False)}, {_pairs_sql('rr', 'ur', 'ur', True)}, {_SHELLS},
nd AS (SELECT count(*)::DOUBLE AS n FROM p), nr AS (SELECT count(*)::DOUBLE AS n FROM r)
SELECT ibin, r_mid, {', '.join(_r(e, c) for c, e in columns.items())}
FROM shell LEFT JOIN dd USING (ibin) LEFT JOIN dr USING (ibin) LEFT JOIN rr USING (ibin), nd, nr"""


_LINK = f"{FOF_B} * 256.0::DOUBLE / power((SELECT count(*) FROM p)::DOUBLE, 1.0::DOUBLE / 3)"

# Links between distinct particles, and their components by the smallest pid.
_FOF = f"""WITH RECURSIVE {_P}, lk AS (SELECT {_LINK} AS b),
e AS (SELECT a.pid AS s, b.pid AS t FROM p a, p b, lk WHERE a.pid <> b.pid AND {_near2('a', 'b')} < lk.b * lk.b),
w(pid, root) AS (SELECT pid, pid FROM p UNION SELECT e.t, w.root FROM w JOIN e ON e.s = w.pid AND w.root < e.t),
g AS (SELECT pid, min(root) AS gid FROM w GROUP BY pid)"""


def _sample_sql() -> str:
    p = transforms.SAMPLE_MODULUS

    def fifth(h):
        return f"((((({h} * {h}) % {p}) * (({h} * {h}) % {p})) % {p}) * {h}) % {p}"

    return f"""WITH {_P}, h0 AS (SELECT *, (pid % {p} + {SEED}) % {p} AS h FROM p),
h1 AS (SELECT * REPLACE ({fifth('h')} AS h) FROM h0), h2 AS (SELECT * REPLACE ((h * {transforms.SAMPLE_MULTIPLIER} + {SEED}) % {p} AS h) FROM h1),
h3 AS (SELECT * REPLACE ({fifth('h')} AS h) FROM h2),
o AS (SELECT *, row_number() OVER (ORDER BY h, pid) AS o FROM h3)
SELECT pid, x0, x1, x2, v0, v1, v2 FROM o WHERE o <= floor({SAMPLE}::DOUBLE * (SELECT count(*) FROM p))"""


def oracle_sql() -> dict[str, str]:
    found = _engine_sql()
    if llm := _optional("boxstats.llm.queries"):
        found |= llm.oracle_sql()
    if (pipeline := _optional("corpus_pipeline")) and pipeline.ORACLE_SQL:
        found["pipeline"] = pipeline.ORACLE_SQL
    return found


def _engine_sql() -> dict[str, str]:
    exact = f"WITH {_P}, {_values(EXACT_LAMBDAS)}, s AS ({_shifted('p', EXACT_LAMBDAS)})"
    nn = f"WITH {_P}, {_RP}"
    phi = "SELECT i::INTEGER AS i, 10.0::DOUBLE * i / 1000.0::DOUBLE AS lam, {0} FROM {1}, range(1001) t(i) GROUP BY i".format(
        _r("avg(cos(10.0::DOUBLE * i / 1000.0::DOUBLE * (v2 / 100.0::DOUBLE)))", "phi"), "{0}"
    )
    auto = f"{_moving('ud', 'p')}, {_pairs_sql('dd', 'ud', 'ud', True)}, {_SHELLS}"
    return {
        "rsd_shift": f"{exact} SELECT lam, pid, x0, x1, x2 FROM s",
        "wrap_positions": f"{exact} SELECT lam, pid, x0, x1, {_WRAP.format('x2')} AS x2 FROM s",
        "velocity_units": f"WITH {_P} SELECT pid, v0 * 0.5::DOUBLE AS v0, v1 * 0.5::DOUBLE AS v1, v2 * 0.5::DOUBLE AS v2 FROM p",
        "physical_positions": f"WITH {_P} SELECT pid, x0 * 0.5::DOUBLE AS x0, x1 * 0.5::DOUBLE AS x1, x2 * 0.5::DOUBLE AS x2 FROM p",
        "displacement": f"WITH {_P} SELECT pid, v2 / 100.0::DOUBLE AS u FROM p",
        "cic_density": f"WITH {_P} {_mesh_sql('p')}",
        "cic_density_rsd": f"{exact} {_mesh_sql('s', keys='lam,')}",
        "density_contrast": f"""WITH {_P}, {_GRID}, m AS ({_mesh_sql('p')}) SELECT ix, iy, iz,
            coalesce(rho, 0) * (4096.0::DOUBLE / (SELECT count(*) FROM p)) - 1 AS delta FROM grid LEFT JOIN m USING (ix, iy, iz)""",
        "cic_momentum": f"""WITH {_P}, {_GRID}, m AS ({_mesh_sql('p', 'v2')}) SELECT ix, iy, iz,
            0.01::DOUBLE * coalesce(rho, 0) * (4096.0::DOUBLE / (SELECT count(*) FROM p)) - 1 AS momentum
            FROM grid LEFT JOIN m USING (ix, iy, iz)""",
        "mass_cut": f"""SELECT * FROM ({_HALOS}) h WHERE nfof * {PARTICLE_MASS!r}::DOUBLE >= power(10.0::DOUBLE, {LOG_M[0]})
            AND nfof * {PARTICLE_MASS!r}::DOUBLE < power(10.0::DOUBLE, {LOG_M[1]})""",
        "subsample_exact": _sample_sql(),
        "bbox": f"WITH {_P} SELECT " + ", ".join(f"min(x{i}) AS lo{i}, max(x{i}) AS hi{i}" for i in range(3)) + " FROM p",
        "hist_1d": f"""WITH {_P} SELECT floor(x0 / 10)::INTEGER AS bin, avg(x0) AS x0_mean, count(*) AS n, {_r('avg(v2)', 'v2_mean')}
            FROM p WHERE floor(x0 / 10) < 25 GROUP BY bin""",
        "pdf_1d": f"""WITH {_P}, c AS (SELECT floor((v2 + 1000) / 100)::INTEGER AS bin, count(*) AS n FROM p
            WHERE floor((v2 + 1000) / 100) < 20 GROUP BY bin)
            SELECT bin, -1000 + bin * 100.0::DOUBLE AS x_left, -1000 + bin * 100.0::DOUBLE + 50 AS x_mid,
            -1000 + bin * 100.0::DOUBLE + 100 AS x_right, n, {_r('n / (sum(n) OVER () * 100.0::DOUBLE)', 'pdf', 9)} FROM c""",
        "hist_2d": f"""WITH {_P}, b AS (SELECT a.i::INTEGER AS ix, b.i::INTEGER AS iy FROM range(42) a(i), range(42) b(i)),
            f AS (SELECT floor(x0 / 6)::INTEGER AS ix, floor(x1 / 6)::INTEGER AS iy, count(*) AS n, {_r('avg(x0)', 'x0_mean')},
            {_r('avg(x1)', 'x1_mean')}, {_r('avg(v2)', 'v2_mean')} FROM p GROUP BY ALL)
            SELECT ix, iy, coalesce(n, 0)::BIGINT AS n, x0_mean, x1_mean, v2_mean FROM b LEFT JOIN f USING (ix, iy)""",
        "velocity_dispersion": f"WITH {_P} SELECT {_r('avg((v2 / 100.0::DOUBLE) * (v2 / 100.0::DOUBLE))', 'sigma2')}, count(*) AS n FROM p",
        "char_function": f"WITH {_P} {phi.format('p')}",
        "char_function_randoms": f"WITH {_R} {phi.format('r')}",
        "nearest_velocity": f"WITH {_R} SELECT pid, x0, x1, x2, v0, v1, v2 FROM r",
        "knn": f"""{nn}, d AS (SELECT rp.pid AS qid, p.pid, {_near2('rp', 'p')} AS d2 FROM rp, p),
            k AS (SELECT qid, pid, d2, row_number() OVER (PARTITION BY qid ORDER BY d2, pid)::INTEGER AS rank FROM d)
            SELECT qid, rank, pid, d2 FROM k WHERE rank <= {K_NEAREST}""",
        "pair_count_auto": f"""WITH {_P} SELECT count(*) AS n_pairs FROM p a, p b
            WHERE a.pid < b.pid AND {_near2('a', 'b')} < {R_COUNT * R_COUNT}""",
        "pair_count_clump": f"""WITH {_P}, c AS (SELECT pid, {', '.join(f"CASE WHEN pid % 2 = 0 THEN 100.0::DOUBLE + x{i} / 8192 ELSE x{i} END AS x{i}" for i in range(3))} FROM p)
            SELECT count(*) AS n_pairs FROM c a, c b WHERE a.pid < b.pid AND {_near2('a', 'b')} < {R_CLUMP * R_CLUMP!r}::DOUBLE""",
        **{name: f"WITH {_P} SELECT {', '.join(_VALUES)} FROM p" for name in ("file_hdf5", "file_parquet", "file_mock_text", "file_subsample")},
        "file_snapshot": f"WITH {_P} SELECT pid AS id, {PARTICLE_MASS!r}::DOUBLE AS m, {', '.join(_VALUES)} FROM p",
        "file_hdf5_parts": f"WITH {_P} SELECT x0, x1, x2 FROM p WHERE pid >= 100 AND pid < 700",
        "file_snapshot_types": f"""WITH {_P} SELECT (pid % 5)::INTEGER AS ptype, pid AS id, CASE pid % 5 WHEN 1 THEN {PARTICLE_MASS!r}::DOUBLE WHEN 3 THEN 4.0::DOUBLE
            ELSE pid % 7 + 1.0::DOUBLE END AS m, CASE WHEN pid % 5 = 0 THEN pid % 64 / 4.0::DOUBLE END AS u,
            CASE WHEN pid % 5 = 0 THEN pid % 32 / 8.0::DOUBLE END AS rho, {', '.join(_VALUES)} FROM p""",
        "file_fof_binary": f"SELECT nfof, {', '.join(_VALUES)} FROM ({_HALOS}) h WHERE nfof >= {NFOF_MIN}",
        "file_fof_text": f"SELECT nfof, {', '.join(_VALUES)} FROM ({_HALOS}) h",
        "file_subhalo_text": f"SELECT nfof * 1000.0::DOUBLE AS m, {', '.join(_VALUES)} FROM ({_HALOS}) h",
        "xi_monopole": _monopole_sql("p"),
        "xi_monopole_clump": _monopole_sql("sq", _SQUEEZED),
        "pair_moments_copies": f"""WITH {_P}, {_COPIES}, {_moving('ud', 'cp')}, {_pairs_sql('dd', 'ud', 'ud', True)}
            SELECT ibin, n, {', '.join(_r(c, c, 3) for c in COPIED)} FROM dd""",
        "xi_dd": f"""WITH {_P}, {auto}, c AS (SELECT count(*)::DOUBLE AS n FROM p)
            SELECT ibin, r_mid, {_r('coalesce(dd.n, 0) / (0.5 * c.n * (c.n - 1) * fraction) - 1', 'xi0')},
            {_r('5 * coalesce(p2, 0) / (0.5 * c.n * (c.n - 1) * fraction)', 'xi2')}, 0.0::DOUBLE AS xi4,
            {_r('0.5 * c.n * (c.n - 1) * fraction', 'dd_mean')} FROM shell LEFT JOIN dd USING (ibin), c""",
        "pair_uu": f"""WITH {_R}, {_moving('ud', 'r')}, {_pairs_sql('dd', 'ud', 'ud', True)}, {_SHELLS}
            SELECT ibin, r_mid, {_r('coalesce(uu0 / n, 0)', 'uu0')}, {_r('coalesce(5 * uu2 / n, 0)', 'uu2')}, coalesce(n, 0)::BIGINT AS n
            FROM shell LEFT JOIN dd USING (ibin)""",
        "pair_dduu": _dduu_sql(),
        "smooth_velocity": f"""WITH {_P}, s AS (SELECT a.pid, avg(b.v0) AS s0, avg(b.v1) AS s1, avg(b.v2) AS s2, count(*) AS n_near
            FROM p a, p b WHERE {_near2('a', 'b')} <= {R_SMOOTH * R_SMOOTH} GROUP BY a.pid)
            SELECT pid, x0, x1, x2, {_r('s0', 'vs0')}, {_r('s1', 'vs1')}, {_r('s2', 'vs2')}, n_near FROM p JOIN s USING (pid)""",
        **{name: f"""WITH {_P}, m AS ({_mesh_sql('p')}), {_dft_sql('m', 'f')}
            SELECT ix, iy, iz, {_r('re', 'rho_re')}, {_r('im', 'rho_im')} FROM f""" for name in ("dft_mesh", "dft_mesh_lines")},
        "mode_table": f"""WITH {_P}, {_GRID}, m AS ({_mesh_sql('p')}), {_dft_sql('m', 'f')}, {_MODES}
            SELECT ix, iy, iz, {_r('k', 'k')}, {_r('mu2', 'mu2')}, {_r('c1', 'c1')}, {_r('c2', 'c2')},
            {_r('(re * re + im * im) * power(4096.0::DOUBLE / (SELECT count(*) FROM p), 2)', 'power')}
            FROM f JOIN mode USING (ix, iy, iz)""",
        "power_matter": _matter_sql(0.0),
        "power_matter_rsd": _matter_sql(1.0),
        "power_decomposed": _decomposed_sql([1.0]),
        "power_decomposed_lambda": _decomposed_sql(LAMBDAS),
        "power_decomposed_raw_noise": _decomposed_sql([1.0], subtract=False),
        "power_2d": _power_2d_sql(),
        "fof_groups": f"{_FOF} SELECT pid, gid FROM g",
        "fof_halos": f"""{_FOF}, m AS (SELECT g.gid, p.*, q.x0 AS a0, q.x1 AS a1, q.x2 AS a2 FROM g JOIN p USING (pid) JOIN p q ON q.pid = g.gid),
            c AS (SELECT gid, count(*) AS nfof, {', '.join(f"min(a{i}) + avg({_signed('m', 'q', i).replace(f'q.x{i}', f'm.a{i}')}) AS x{i}, avg(v{i}) AS v{i}" for i in range(3))}
            FROM m GROUP BY gid)
            SELECT gid, nfof, {', '.join(_r(_WRAP.format(f'x{i}'), f'x{i}') for i in range(3))},
            {', '.join(_r(f'v{i}', f'v{i}') for i in range(3))} FROM c""",
        "group_velocity": f"""{_FOF}, c AS (SELECT gid, avg(v0) AS v0, avg(v1) AS v1, avg(v2) AS v2 FROM g JOIN p USING (pid) GROUP BY gid)
            SELECT p.pid, gid, x0, x1, x2, {', '.join(_r(f'c.v{i}', f'v{i}') for i in range(3))}
            FROM g JOIN p USING (pid) JOIN c USING (gid)""",
    }
