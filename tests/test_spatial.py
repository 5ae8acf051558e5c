"""Spatial joins against brute force, with copies, a dense clump and small leaf caps."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import boxstats as bs
from boxstats.operators.pairs import pair_bins
from boxstats.operators.tree import cell_pairs, build_tree, distinct_positions


@pytest.mark.parametrize("radius,cap", [(3.0, 32), (100.0, 32)])
def test_pair_count(cloud, cloud_df, box, radius, cap):
    got = int(bs.count_pairs(cloud_df, box, radius, cap).first()[0])
    upper = np.triu_indices(cloud.n, 1)
    assert got == (cloud.d2()[upper] < radius**2).sum()


def test_pair_bins_with_moments(cloud, cloud_df, box):
    got = pair_bins(cloud_df, None, box, 60.0, 1.0, cap=32).toPandas().set_index("ibin").astype(float)
    first = {}
    for i, p in enumerate(map(tuple, cloud.x)):
        first.setdefault(p, i)
    order = np.array([first[tuple(p)] for p in cloud.x])
    i, j = np.where(order[:, None] < order[None, :])
    s2 = cloud.d2()[i, j]
    keep = (s2 > 0) & (s2 < 3600)
    i, j, s = i[keep], j[keep], np.sqrt(s2[keep])
    rz = cloud.x[i, 2] - cloud.x[j, 2]
    rz = np.where(rz > 128, rz - 256, np.where(rz < -128, rz + 256, rz))
    nu = rz / s
    u = cloud.v[:, 2] / box.aH
    p2, p3 = 1.5 * nu**2 - 0.5, 0.5 * (5 * nu**2 - 3) * nu
    p4 = 0.125 * (35 * nu**4 - 30 * nu**2 + 3)
    w2 = (u[i] - u[j]) ** 2
    want = {
        "n": np.ones_like(s), "p2": p2, "uu0": u[i] * u[j], "uu2": u[i] * u[j] * p2, "uu4": u[i] * u[j] * p4,
        "ww0": w2, "ww2": w2 * p2, "ww4": w2 * p4, "u1": u[j] * nu, "u3": u[j] * p3,
    }
    for name, term in want.items():
        sums = np.bincount(s.astype(int), term, minlength=60)
        shells = got.index.to_numpy()
        np.testing.assert_allclose(got[name], sums[shells], rtol=1e-9, atol=1e-6, err_msg=name)
        assert np.allclose(np.delete(sums, shells), 0)


@pytest.mark.parametrize("radius", [20.0])
def test_smoothing(cloud, cloud_df, box, radius):
    got = bs.smooth_velocity(cloud_df, box, radius, cap=32).toPandas().sort_values("pid")
    near = cloud.d2() <= radius**2
    want = (near @ cloud.v) / near.sum(1)[:, None]
    assert (got.n_near.to_numpy() == near.sum(1)).all()
    np.testing.assert_allclose(got[["vs0", "vs1", "vs2"]], want, rtol=1e-12)


@pytest.mark.parametrize("k", [1, 3])
def test_nearest(spark, cloud, cloud_df, box, k, monkeypatch):
    from boxstats.operators import nearest

    # Force both routes: the direct cells and, next to the clump, the descent.
    monkeypatch.setattr(nearest, "MAX_TESTS", 60)
    from conftest import Cloud

    other = Cloud(150, seed=5)
    other.x[:60] = (cloud.x[cloud.n // 3] + np.arange(180).reshape(60, 3) / 90.0) % 256
    other.x[60:80] = other.x[0]
    got = bs.knn(other.frame(spark), cloud_df, box, k).toPandas().sort_values(["qid", "rank"])
    want = [sorted(zip(row, range(cloud.n)))[:k] for row in other.d2(cloud.x)]
    pairs = list(zip(got.d2, got.pid))
    assert len(got) == k * other.n
    for q, row in enumerate(want):
        for rank, (d2, pid) in enumerate(row):
            assert pairs[q * k + rank][1] == pid
            assert pairs[q * k + rank][0] == pytest.approx(d2, rel=1e-12)


@pytest.mark.parametrize("link", [1.5])
def test_groups(cloud, cloud_df, box, link):
    got = bs.fof_groups(cloud_df, box, link, cap=32).toPandas().sort_values("pid")
    linked = cloud.d2() < link**2
    label = np.arange(cloud.n)
    while True:
        new = np.array([label[row].min() for row in linked])
        if (new == label).all():
            break
        label = new
    assert (got.gid.to_numpy() == label).all()


def test_groups_link_strictly_and_across_the_edge(points, box):
    df = points([[1, 5, 5], [3, 5, 5], [255.5, 5, 5], [4.5, 5, 5]])
    labels = lambda link: [r["gid"] for r in bs.fof_groups(df, box, link).orderBy("pid").collect()]
    assert labels(1.5) == [0, 1, 2, 3]
    assert labels(2.0) == [0, 1, 0, 1]
    assert labels(2.001) == [0, 0, 0, 0]


def test_halos_and_group_velocity(cloud, cloud_df, box):
    groups = bs.fof_groups(cloud_df, box, 12.0).cache()
    halos = bs.fof_halos(cloud_df, groups, box).toPandas()
    assert halos.nfof.sum() == cloud.n
    np.testing.assert_allclose((halos.nfof * halos.v1).sum(), cloud.v[:, 1].sum(), atol=1e-6)
    assert ((halos.x0 >= 0) & (halos.x0 < 256)).all()
    moved = bs.group_velocity(cloud_df, groups).toPandas().sort_values("pid")
    want = moved.gid.map(halos.set_index("gid").v2)
    np.testing.assert_allclose(moved.v2, want, rtol=1e-12)


def test_halo_centre_straddles_the_edge(points, box):
    df = points([[255, 1, 1], [1, 1, 1]])
    row = bs.fof_halos(df, bs.fof_groups(df, box, 3.0), box).first()
    assert (row.nfof, row.x0, row.x1) == (2, 0.0, 1.0)


def test_coincident_points(points, box):
    df = points([[5, 5, 5], [5, 5, 5], [6, 5, 5]])
    assert bs.count_pairs(df, box, 0.5).first()[0] == 1
    assert bs.count_pairs(df, box, 1.0).first()[0] == 1
    assert bs.count_pairs(df, box, 1.5).first()[0] == 3
    assert bs.xi_dd(df, box, 4.0, 1.0).filter("xi0 > -1").count() == 1


def test_single_point_and_errors(points, box):
    one = points([[5, 5, 5]], [[1, 2, 3]])
    assert bs.count_pairs(one, box, 1.0).first()[0] == 0
    assert bs.smooth_velocity(one, box, 1.0).first()["vs2"] == 3.0
    assert bs.fof_groups(one, box, 1.0).first()["gid"] == 0
    assert bs.nearest_velocity(one, points([[200, 5, 5]]), box).first()["v1"] == 2.0
    empty = one.filter("pid < 0")
    with pytest.raises(ValueError):
        bs.power_matter(empty, box, 4)
    with pytest.raises(ValueError):
        bs.knn(one, empty, box)
    with pytest.raises(ValueError):
        bs.smooth_velocity(one, box, 0.0)


def test_no_leaf_is_larger_than_the_cap(cloud_df, box):
    pos = distinct_positions(cloud_df, box)
    tree = build_tree(pos, box, 4, 16)
    assert tree.points.groupBy("cid").count().agg({"count": "max"}).first()[0] <= 16
    assert tree.cells.filter("leaf").agg({"n": "sum"}).first()[0] == pos.rows
    pairs = cell_pairs(tree, tree, 4.0, strict=True, half=True).open
    assert pairs.filter("not a.leaf or not b.leaf").count() == 0
    assert pairs.count() == pairs.select("a.cid", "b.cid").distinct().count()


@pytest.fixture(scope="module")
def clump(spark):
    """4,000 points within 1e-4 of the box, and a few far away."""
    rng = np.random.default_rng(9)
    x = np.concatenate([100 + rng.random((4000, 3)) * 0.0256, rng.random((50, 3)) * 256])
    frame = pd.DataFrame({"pid": np.arange(len(x))} | {f"x{i}": x[:, i] for i in range(3)} | {f"v{i}": rng.integers(-9, 9, len(x)).astype(float) for i in range(3)})
    return frame, spark.createDataFrame(frame).repartition(4).cache()


def test_leaves_of_a_clump_stay_below_the_cap(clump, box):
    from boxstats.operators.tree import build_tree, distinct_positions

    frame, df = clump
    tree = build_tree(distinct_positions(df, box), box, 4, 16)
    held = tree.points.groupBy("cid").count()
    assert held.agg({"count": "max"}).first()[0] <= 16 and tree.points.count() == len(frame)
    tree = build_tree(distinct_positions(df, box), box, 4, 64)
    assert tree.points.groupBy("cid").count().agg({"count": "max"}).first()[0] <= 64
    assert tree.cells.filter("leaf").agg({"n": "sum"}).first()[0] == len(frame)
    top = tree.ancestors().filter("lvl = 0").join(tree.cells.select("cid", "n"), "cid")
    assert top.agg({"n": "sum"}).first()[0] == len(frame)


def test_operators_on_a_clump(clump, box, monkeypatch):
    from boxstats.operators import tree

    frame, df = clump
    # Small keys, so that leaf pairs are spread over several of them.
    monkeypatch.setattr(tree, "KEY_TESTS", 2000)
    x = frame[["x0", "x1", "x2"]].to_numpy()
    d = np.abs(x[:, None] - x[None])
    d = np.minimum(d, 256 - d)
    d2 = (d * d).sum(-1)
    radius = 0.01
    upper = np.triu(d2 < radius * radius, 1).sum()
    assert int(bs.count_pairs(df, box, radius, 64).first()[0]) == int(upper)
    near = d2 <= radius * radius
    got = bs.smooth_velocity(df, box, radius, 64).toPandas().sort_values("pid")
    assert (got.n_near.to_numpy() == near.sum(1)).all()
    assert np.allclose(got.vs2, near @ frame.v2.to_numpy() / near.sum(1))
    link = 0.002
    groups = bs.fof_groups(df, box, link).toPandas().sort_values("pid").gid.to_numpy()
    label = np.arange(len(x))
    linked = d2 < link * link
    while True:
        new = np.array([label[row].min() for row in linked])
        if (new == label).all():
            break
        label = new
    assert (groups == label).all()
    asked = df.filter("pid % 40 = 0")
    found = bs.knn(asked, df, box, 2).toPandas()
    for r in found.itertuples():
        order = np.lexsort((np.arange(len(x)), d2[r.qid]))
        assert order[r.rank - 1] == r.pid


@pytest.mark.parametrize("bad", [None, float("nan"), float("inf")])
@pytest.mark.parametrize("column", ["x1", "v2"])
def test_values_that_are_no_numbers_are_refused(spark, box, column, bad):
    rows = [(i, 1.0 * i, 2.0, 3.0, 1.0, 1.0, 1.0) for i in range(5)]
    df = spark.createDataFrame(rows, "pid long, x0 double, x1 double, x2 double, v0 double, v1 double, v2 double")
    value = F.lit(bad).cast("double")
    df = df.withColumn(column, F.when(F.col("pid") == 3, value).otherwise(F.col(column)))
    with pytest.raises(ValueError, match="1 rows"):
        bs.smooth_velocity(df, box, 2.0)
    with pytest.raises(ValueError, match="1 rows"):
        bs.pair_uu(df, box, 5.0).count()
    if column == "v2":
        for broken in (bs.velocity_dispersion(df, box), bs.characteristic_function(df, box, steps=3), bs.cic_momentum(df, box, 4, 5)):
            with pytest.raises(Exception, match="NULL, NaN or infinite"):
                broken.collect()
    else:
        for run in (lambda: bs.count_pairs(df, box, 1.0), lambda: bs.fof_groups(df, box, 1.0), lambda: bs.knn(df, df, box)):
            with pytest.raises(ValueError, match="1 rows"):
                run()
        with pytest.raises(Exception, match="NULL, NaN or infinite"):
            bs.cic_density(df, box, 4).collect()


def test_pair_counts_stay_exact(spark, box):
    rows = spark.range(1).selectExpr("0L AS pid", "1D AS x0", "1D AS x1", "1D AS x2", "150000002L AS w")
    from boxstats.operators import pairs
    from boxstats.operators.tree import Positions

    def weighted(*_):
        return Positions(rows, 1, 150000002)

    original = pairs.distinct_positions
    try:
        pairs.distinct_positions = weighted
        assert pairs.count_pairs(None, box, 1.0).first()[0] == 11250000225000001
    finally:
        pairs.distinct_positions = original
    two = spark.createDataFrame([(5 * 10**18,), (5 * 10**18,)], "n long")
    assert two.agg(pairs._whole_sum("n")).first()[0] == 10**19


def test_rounds_leave_one_table(spark):
    import glob

    from boxstats.operators.components import connected_components
    from boxstats.storage import scratch_dir

    folder = scratch_dir(spark).removeprefix("file://")
    before = set(glob.glob(f"{folder}/boxstats-*"))
    chain = spark.range(300).selectExpr("id AS src", "id + 1 AS dst")
    found = connected_components(chain)
    assert found.select("comp").distinct().count() == 1 and found.count() == 301
    assert len(set(glob.glob(f"{folder}/boxstats-*")) - before) == 1


def test_components_leave_few_edges_to_the_rounds(spark, monkeypatch):
    from boxstats.operators import components

    rng = np.random.default_rng(5)
    order = rng.permutation(5000)
    # A path through 5,000 nodes in any order, a path apart from it, and a star.
    path = [(int(a), int(b), i) for i, (a, b) in enumerate(zip(order, order[1:]))]
    apart = [(i, i + 1, i) for i in range(6000, 6400)]
    star = [(7000 + i, 7999, 3) for i in range(500)]
    sizes = []
    original = components._digest

    def watched(edges):
        digest = original(edges)
        sizes.append(digest[0])
        return digest

    monkeypatch.setattr(components, "_digest", watched)
    df = spark.createDataFrame(path + apart + star + path[:50], "src long, dst long, near long")
    got = {r.id: r.comp for r in components.connected_components(df).collect()}
    want = {i: 0 for i in range(5000)} | {i: 6000 for i in range(6000, 6401)} | {i: 7000 for i in [*range(7000, 7500), 7999]}
    assert got == want
    assert max(sizes) <= 4 * spark.sparkContext.defaultParallelism
    unsorted = {r.id: r.comp for r in components.connected_components(df.drop("near")).collect()}
    assert unsorted == want
