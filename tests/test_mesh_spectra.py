import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import boxstats as bs
from boxstats.operators import spectra
from boxstats.operators.mesh import deposit
from boxstats.operators.transforms import with_lambdas


def dense(df, nc, column):
    out = np.zeros((nc, nc, nc))
    for r in df.collect():
        out[r["ix"], r["iy"], r["iz"]] = r[column]
    return out


def test_cic_closed_forms(points, box):
    at_node = dense(bs.cic_density(points([[16, 32, 48]]), box, 16), 16, "rho")
    assert at_node[1, 2, 3] == 1 and at_node.sum() == 1
    centre = dense(bs.cic_density(points([[248, 8, 8]]), box, 16), 16, "rho")
    assert centre[15, 0, 0] == centre[0, 1, 1] == 0.125 and centre.sum() == 1
    far = bs.redshift_space(points([[8, 8, 8]], [[0, 0, -60000]]), box)
    assert dense(bs.cic_density(far, box, 16), 16, "rho").sum() == 1


def test_mass_is_conserved(cloud, cloud_df, box):
    total = bs.cic_density(cloud_df, box, 7).agg(F.sum("rho")).first()[0]
    assert total == pytest.approx(cloud.n, rel=1e-12)
    contrast = bs.density_contrast(bs.cic_density(cloud_df, box, 8), 8, cloud.n)
    assert contrast.count() == 512
    assert contrast.agg(F.sum("delta")).first()[0] == pytest.approx(0, abs=1e-9)


@pytest.mark.parametrize("nc,line,plane", [(8, 64, 1), (7, 14, 10000), (16, 1 << 16, 1 << 20)])
def test_transform_equals_numpy(cloud_df, box, nc, line, plane):
    mesh = deposit(cloud_df, box, nc, {"a": None, "b": F.col("v0")})
    got = bs.fft_mesh(mesh, nc, ["a", "b"], line_cells=line, plane_cells=plane).toPandas()
    assert len(got) == nc * nc * (nc // 2 + 1)
    for f in ("a", "b"):
        want = np.fft.rfftn(dense(mesh, nc, f))[got.ix, got.iy, got.iz]
        np.testing.assert_allclose(got[f"{f}_re"] + 1j * got[f"{f}_im"], want, atol=1e-7)


def test_transform_of_keyed_meshes(cloud_df, box):
    points = bs.redshift_space(with_lambdas(cloud_df, [0.0, 2.0]), box, F.col("lam"))
    mesh = bs.cic_density(points, box, 8, ["lam"])
    got = bs.fft_mesh(mesh, 8, ["rho"], ["lam"]).toPandas()
    for lam, part in got.groupby("lam"):
        want = np.fft.rfftn(dense(mesh.filter(F.col("lam") == lam), 8, "rho"))[part.ix, part.iy, part.iz]
        np.testing.assert_allclose(part.rho_re + 1j * part.rho_im, want, atol=1e-9)


def test_sparse_mesh_still_gives_a_dense_spectrum(points, box):
    got = bs.fft_mesh(bs.cic_density(points([[0, 0, 0]]), box, 8), 8, ["rho"]).toPandas()
    assert len(got) == 8 * 8 * 5
    np.testing.assert_allclose(got.rho_re, 1.0)


def brute_modes(nc):
    rows = []
    for ix in range(nc):
        kx = ix if ix <= nc // 2 else ix - nc
        for iy in range(nc):
            ky = iy if iy <= nc // 2 else iy - nc
            for iz in range(nc // 2 + 1):
                if iz == 0 and not (kx > 0 or (kx == 0 and ky > 0)):
                    continue
                n2 = kx**2 + ky**2 + iz**2
                if 4 * n2 <= nc**2:
                    rows.append((ix, iy, iz, kx, ky, iz))
    return np.array(rows)


@pytest.mark.parametrize("nc", [6, 7])
def test_matter_power_against_direct_sums(cloud, cloud_df, box, nc):
    dk = 0.021
    got = bs.power_matter(cloud_df, box, nc, dk).toPandas().sort_values("bin")
    rho = dense(bs.cic_density(cloud_df, box, nc), nc, "rho") * nc**3 / cloud.n - 1
    spectrum = np.fft.fftn(rho)
    m = brute_modes(nc)
    n = m[:, 3:].astype(float)
    kf = 2 * math.pi / box.boxsize
    k = kf * np.sqrt((n**2).sum(1))
    mu2 = n[:, 2] ** 2 / (n**2).sum(1)
    c2 = np.zeros(len(m))
    for a in np.ndindex(4, 4, 4):
        q = n + nc * (np.array(a) - 2)
        c2 += np.prod(np.sinc(q / nc), axis=1) ** 4 * ((q**2).sum(1) / (n**2).sum(1)) ** -0.8
    raw = np.abs(spectrum[m[:, 0], m[:, 1], m[:, 2]]) ** 2 * box.volume / nc**6
    which = np.floor(k / dk).astype(int)
    keep = which < int(math.pi * nc / box.boxsize / dk)
    frame = pd.DataFrame({"bin": which, "k": k, "p0": raw / c2, "p0_raw": raw,
                          "p2": raw / c2 * (7.5 * mu2 - 2.5),
                          "p4": raw / c2 * 1.125 * (35 * mu2**2 - 30 * mu2 + 3)})[keep]
    want = frame.groupby("bin").mean()
    assert (got.n.to_numpy() == frame.groupby("bin").size().to_numpy()).all()
    for c in ("k", "p0", "p0_raw", "p2", "p4"):
        np.testing.assert_allclose(got[c], want[c], rtol=1e-8, err_msg=c)


def test_components_add_up_to_the_total(cloud_df, spark, box):
    """P_DD + 2 P_DU + P_UU is the power of the data, up to the shot noise of the data."""
    random = bs.nearest_velocity(cloud_df, bs.randoms(spark, 200, box, 3), box)
    n = cloud_df.count()
    modes = spectra.decomposed_modes(cloud_df, random, box, 8, [1.0])
    total = modes.withColumn("sum", F.col("pdd") + 2 * F.col("pdu") + F.col("puu"))
    whole = spectra.with_corrections(
        bs.modes(spectra.contrast_spectrum(bs.redshift_space(cloud_df, box), box, 8, n), box, 8), 8
    ).withColumn("p", (F.lit(box.volume / 8.0**6) * spectra.cross_power("d", "d") - F.lit(box.volume / n) * F.col("c1")) / F.col("c2"))
    both = total.join(whole.select("ix", "iy", "iz", "p"), ["ix", "iy", "iz"]).toPandas()
    np.testing.assert_allclose(both["sum"], both["p"], rtol=1e-7, atol=1e-5)


def test_mu_one_bin(cloud_df, spark, box):
    random = bs.nearest_velocity(cloud_df, bs.randoms(spark, 50, box, 3), box).cache()
    out = bs.power_2d(cloud_df, random, box, 8, [1.0], 0.02)
    whole = bs.power_2d(cloud_df, random, box, 8, [1.0], 0.02, include_mu1=True)
    total = lambda df: df.agg(F.sum("n")).first()[0]
    n_modes = bs.power_decomposed(cloud_df, random, box, 8, [1.0], 0.02).agg(F.sum("n")).first()[0]
    assert total(whole) == n_modes > total(out)
    assert out.count() == whole.count() == 40


def test_plane_wave(spark, box):
    x = np.linspace(0, 256, 8, endpoint=False)
    cells = [(i, j, k, 1 + math.cos(2 * math.pi * 2 * i / 8)) for i in range(8) for j in range(8) for k in range(8)]
    mesh = spark.createDataFrame(cells, "ix int, iy int, iz int, rho double")
    got = bs.fft_mesh(mesh, 8, ["rho"]).filter("abs(rho_re) > 1e-6").select("ix", "iy", "iz", "rho_re").collect()
    assert sorted((r.ix, r.iy, r.iz) for r in got) == [(0, 0, 0), (2, 0, 0), (6, 0, 0)]
    assert x.size == 8


def test_characteristic_function(cloud, cloud_df, box):
    got = bs.characteristic_function(cloud_df, box, steps=20).toPandas().sort_values("i")
    u = cloud.v[:, 2] / box.aH
    np.testing.assert_allclose(got.phi, [np.cos(l * u).mean() for l in got.lam], atol=1e-12)
    assert got.phi.iloc[0] == 1.0 and got.lam.iloc[-1] == 10.0


def test_histogram_drops_the_partial_bin(spark):
    df = spark.createDataFrame([(0.5, 1.0), (9.5, 3.0), (10.2, 7.0), (-0.1, 1.0)], "x double, y double")
    got = bs.hist_1d(df, "x", ["y"], 0.0, 10.5, 1.0).toPandas().sort_values("bin")
    assert list(got.bin) == [0, 9] and list(got.y_mean) == [1.0, 3.0]
    grid = bs.hist_2d(df, "x", "y", [], (0.0, 10.0, 5.0), (0.0, 4.0, 2.0))
    assert grid.count() == 4 and grid.filter("n = 0 and x_mean is null").count() == 2


def test_subsample_is_exact_and_repeatable(spark):
    df = spark.range(5000).withColumnRenamed("id", "pid")
    a = {r.pid for r in bs.subsample(df, 1234, 5).collect()}
    b = {r.pid for r in bs.subsample(df.repartition(3), 1234, 5).collect()}
    c = {r.pid for r in bs.subsample(df, 1234, 6).collect()}
    assert len(a) == 1234 and a == b and a != c
    assert bs.subsample(df, 9000).count() == 5000 and bs.subsample(df, 0).count() == 0


def test_mass_is_observed_by_the_job_that_makes_the_mesh(spark, cloud_df, box, monkeypatch):
    from boxstats.operators import mesh

    status = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("mass", "mesh")
    df, check = mesh.observed_density(cloud_df, box, 8)
    rows = df.collect()
    jobs = len(status.getJobIdsForGroup("mass"))
    assert check() < 1e-12 and abs(sum(r.rho for r in rows) - 600) < 1e-9
    assert len(status.getJobIdsForGroup("mass")) == jobs
    spark.sparkContext.setJobGroup("other", "others")
    original = mesh.cic_density
    monkeypatch.setattr(mesh, "cic_density", lambda *a, **k: original(*a, **k).filter("ix > 0"))
    df, check = mesh.observed_density(cloud_df, box, 8)
    df.collect()
    with pytest.raises(mesh.MassError):
        check()
