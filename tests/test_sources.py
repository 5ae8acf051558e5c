import json
import struct

import numpy as np
import pytest

import boxstats as bs
from boxstats.plans import programs
from boxstats.sources import binary, hdf5, text
from boxstats.sources.catalog import Catalog, guess_format


def test_fof_text(spark, tmp_path):
    path = tmp_path / "halos.txt"
    path.write_text("# nfof x y z\n10 1 2 3 4 5 6\n 20\t1.5 2 3 4 5 6 extra\nbroken line\n5 1 2 3\n100 9 9 9 0 0 0\n")
    got = text.read_fof_text(spark, str(path), 1.0, 12.0, 1e10).orderBy("nfof").collect()
    assert [(r.nfof, r.x0, r.v2) for r in got] == [(10, 1.0, 6.0), (20, 1.5, 6.0)]
    assert len({r.pid for r in got}) == 2


def test_mock_and_subhalo_text(spark, tmp_path):
    mock = tmp_path / "mock.txt"
    mock.write_text("# x y z vx vy vz\n1 2 3 4 5 6\n7 8 9 1 1 1\n")
    assert text.read_mock_text(spark, str(mock)).count() == 2
    sub = tmp_path / "sub.txt"
    sub.write_text("# m x y z vx vy vz\n1e12 2 3 4 5 6 7\n1e15 2 3 4 5 6 7\n")
    assert [r.m for r in text.read_subhalo_text(spark, str(sub), 11, 13).collect()] == [1e12]
    sub.write_text("1e12 2 3 4\n")
    with pytest.raises(Exception):
        text.read_subhalo_text(spark, str(sub)).collect()


def particles(n, seed=0):
    rng = np.random.default_rng(seed)
    return rng.uniform(0, 100, (n, 3)).astype("<f4"), rng.normal(0, 300, (n, 3)).astype("<f4")


def test_subsample_binary(spark, tmp_path):
    x, v = particles(50)
    path = tmp_path / "sub.b"
    head = struct.pack("<6fi", 100, 0, 0.3, 0, 0.5, 0, 50)
    path.write_bytes(head + np.hstack([x, v]).tobytes() + struct.pack("<i", 50))
    catalog = bs.read_catalog(spark, str(path))
    got = catalog.df.orderBy("pid").toPandas()
    assert catalog.box.boxsize == 100 and catalog.box.a == 0.5
    np.testing.assert_array_equal(got[["x0", "x1", "x2"]], x.astype(float))
    np.testing.assert_array_equal(got[["v0", "v1", "v2"]], v.astype(float))
    path.write_bytes(head + np.hstack([x, v]).tobytes() + struct.pack("<i", 49))
    with pytest.raises(binary.FormatError):
        bs.read_catalog(spark, str(path))


def test_fof_binary(spark, tmp_path):
    x, v = particles(20)
    record = np.dtype([("nfof", "<i4"), ("x", "<f4", 3), ("v", "<f4", 3)])
    rows = np.zeros(20, record)
    rows["nfof"], rows["x"], rows["v"] = np.arange(20), x, v
    path = tmp_path / "groups.bin"
    path.write_bytes(struct.pack("<iffi", 604, 0.2, 100, 20) + rows.tobytes() + struct.pack("<i", 20))
    df, size = binary.read_fof_binary(spark, str(path), nfof_min=5)
    assert size == 100 and df.count() == 15
    assert df.filter("nfof = 7").first()["x1"] == float(x[7, 1])


def snapshot_bytes(counts, masses, n_files=1, total=None, time=0.25):
    header = binary.SnapshotHeader(tuple(counts), tuple(masses), time, 3.0, 0, n_files, 100.0, 0.3, 0.7, 0.7,
                                   tuple(total or counts))
    n = sum(counts)
    x, v = particles(n, seed=n)
    x[0] = [-1, 100, 50]

    def record(data):
        mark = struct.pack("<i", len(data))
        return mark + data + mark

    out = record(binary.pack_header(header)) + record(x.tobytes()) + record(v.tobytes())
    out += record(np.arange(n, dtype="<u4").tobytes())
    own = sum(c for c, m in zip(counts, masses) if m == 0)
    if own:
        out += record(np.arange(own, dtype="<f4").tobytes())
    if counts[0]:
        out += record(np.full(counts[0], 5, "<f4").tobytes()) + record(np.full(counts[0], 6, "<f4").tobytes())
    return out, x, v


def test_snapshot_types_columns_and_units(spark, tmp_path):
    data, x, v = snapshot_bytes([4, 30, 0, 0, 3, 0], [0, 2.5, 0, 0, 0, 0])
    path = tmp_path / "snap"
    path.write_bytes(data)
    df, box = binary.read_snapshot(spark, str(path), columns=("id", "m"), rows_per_task=7)
    got = df.orderBy("pid").toPandas()
    assert len(got) == 30 and box.a == 0.25
    np.testing.assert_allclose(got[["v0", "v1", "v2"]], v[4:34] * 0.5, rtol=1e-6)
    assert list(got.id) == list(range(4, 34)) and set(got.m) == {2.5}
    all_types, _ = binary.read_snapshot(spark, str(path), (0, 1, 4), ("ptype", "m", "u", "rho", "hsml"))
    rows = all_types.orderBy("pid").toPandas()
    assert list(rows.ptype) == [0] * 4 + [1] * 30 + [4] * 3
    assert list(rows.m[34:]) == [4.0, 5.0, 6.0]
    assert set(rows.u[:4]) == {5.0} and rows.u[4:].isna().all() and rows.hsml.isna().all()
    assert (rows.x0[0], rows.x1[0], rows.x2[0]) == (99.0, 0.0, 50.0)


def test_snapshot_in_parts(spark, tmp_path):
    for i, n in enumerate((10, 5)):
        data, _, _ = snapshot_bytes([0, n, 0, 0, 0, 0], [0, 1, 0, 0, 0, 0], 2, [0, 15, 0, 0, 0, 0])
        (tmp_path / f"snap.{i}").write_bytes(data)
    df, _ = binary.read_snapshot(spark, str(tmp_path / "snap"))
    assert df.count() == 15 and df.select("pid").distinct().count() == 15
    (tmp_path / "broken").write_bytes(b"\x10\0\0\0" + bytes(300))
    with pytest.raises(binary.FormatError):
        binary.read_snapshot(spark, str(tmp_path / "broken"))


def test_snapshot_round_trip(spark, cloud_df, box, tmp_path):
    path = str(tmp_path / "out")
    assert binary.write_snapshot(cloud_df, path, bs.Box(256.0, 0.3, 0.25), mass=2.0) == cloud_df.count()
    df, found = binary.read_snapshot(spark, path, columns=("id", "m"))
    assert found.boxsize == 256 and found.a == 0.25
    back = df.select("id", "x0", "v2").join(cloud_df.selectExpr("pid as id", "x0 as y0", "v2 as w2"), "id")
    assert back.count() == cloud_df.count() and back.filter("x0 != y0 or abs(v2 - w2) > 1e-3").count() == 0


def test_hdf5_round_trip(spark, cloud_df, box, tmp_path):
    path = str(tmp_path / "particles.h5")
    bs.write_catalog(Catalog(cloud_df.repartition(4), box, {"r_smooth": 2.0}), path, "hdf5")
    back = bs.read_catalog(spark, path, rows_per_task=100)
    assert back.box == box and back.extra == {"r_smooth": 2.0}
    assert back.df.select("x0", "x1", "x2", "v0", "v1", "v2").exceptAll(cloud_df.drop("pid")).count() == 0
    assert back.df.count() == cloud_df.count()
    with open(path, "rb") as file:
        found = hdf5.list_datasets(file)
    assert set(found) == {"/x", "/v", "/parameters/boxsize", "/parameters/omega_m", "/parameters/a", "/parameters/r_smooth"}
    assert found["/x"].shape == (600, 3) and found["/x"].fmt == "<f4"


def test_parquet_round_trip_and_dispatch(spark, cloud_df, box, tmp_path):
    path = str(tmp_path / "c.parquet")
    bs.write_catalog(Catalog(cloud_df, box), path)
    back = bs.read_catalog(spark, path)
    assert back.box == box and back.df.count() == cloud_df.count()
    assert guess_format("a.h5") == "hdf5" and guess_format("a.b") == "subsample"
    with pytest.raises(ValueError):
        bs.read_catalog(spark, "what.xyz")
    with pytest.raises(ValueError):
        bs.read_catalog(spark, "what.txt", "fof_text")


def test_randoms_are_a_function_of_id_and_seed(spark, box):
    a = bs.randoms(spark, 1000, box, 1).toPandas()
    b = bs.randoms(spark, 1000, box, 1).repartition(3).toPandas().sort_values("pid")
    assert (a.x0.to_numpy() == b.x0.to_numpy()).all()
    assert a.x0.between(0, 256, inclusive="left").all()
    assert abs(a[["x0", "x1", "x2"]].corr().to_numpy()[np.triu_indices(3, 1)]).max() < 0.1
    assert (bs.randoms(spark, 10, box, 2).toPandas().x0 != a.x0[:10]).all()


def test_programs(spark, cloud_df, box, tmp_path):
    catalog = Catalog(cloud_df, box)
    grouped = programs.group_velocity(spark, catalog, str(tmp_path / "groups.h5"))
    assert bs.read_catalog(spark, str(tmp_path / "groups.h5")).df.count() == grouped.df.count() == 600
    programs.smoothed_velocity(spark, catalog, str(tmp_path / "smooth.parquet"), 8.0, "parquet")
    assert bs.read_catalog(spark, str(tmp_path / "smooth.parquet")).extra == {"r_smooth": 8.0}
    assert programs.matter_power(spark, catalog, 8, dk=0.03, out=str(tmp_path / "matter")).count() > 0
    poles, table = programs.decomposed_power(
        spark, catalog, 8, [0.0, 1.0], 0.02, shot_noise=box.volume / 100, two_d=True, sample=0.5,
        write_random=str(tmp_path / "random.h5"), out=str(tmp_path / "power"),
    )
    assert table.count() == 2 * 4 * 10
    alone = programs.decomposed_power(spark, catalog, 8, [0.0, 1.0], 0.02, shot_noise=box.volume / 100, sample=0.5)
    assert poles.orderBy("lam", "bin").toPandas().round(6).equals(alone.orderBy("lam", "bin").toPandas().round(6))
    read = spark.read.option("header", True).option("sep", " ").option("inferSchema", True)
    assert read.csv(str(tmp_path / "power")).count() == poles.count()
    assert read.csv(str(tmp_path / "power-2d")).count() == table.count()
    facts = read.csv(str(tmp_path / "power-parameters")).first()
    assert facts["n_data"] == 300 and facts["n_random"] == 100 and facts["shot_noise_random"] == box.volume / 100
    assert bs.read_catalog(spark, str(tmp_path / "random.h5")).df.count() == 100
    programs.write_power_2d(table, str(tmp_path / "p2d.h5"), 1.0, box)
    with open(tmp_path / "p2d.h5", "rb") as file:
        found = hdf5.list_datasets(file)
    assert found["/Pdu"].shape == (4, 10) and "/parameters/lambda" in found
    phi, sigma = programs.characteristic_function(spark, catalog, 100, out=str(tmp_path / "phi"))
    assert phi.count() == 1001 and sigma.first()["n"] == 100
    assert read.csv(str(tmp_path / "phi")).count() == 1001
    assert abs(read.csv(str(tmp_path / "phi-parameters")).first()["sigma2"] - sigma.first()["sigma2"]) < 1e-9
    for mode in ("dd", "uu", "dduu"):
        out = str(tmp_path / mode)
        assert programs.correlation_function_uu(spark, catalog, mode, 300, r_max=10.0, out=out).count() == 10
        assert read.csv(out).count() == 10
        facts = read.csv(f"{out}-parameters").first()
        assert facts["n_data"] == 300 and (mode == "dd" or facts["n_random"] == 300)
    programs.group_velocity(spark, catalog, halos=str(tmp_path / "halos.h5"))
    halos, _ = hdf5.read_particles(spark, str(tmp_path / "halos.h5"))
    assert halos.count() == fof_count(spark, cloud_df, box)
    assert programs.count_close_pairs(spark, catalog).first()[0] > 0


def fof_count(spark, points, box):
    from boxstats.operators import fof

    return fof.fof_groups(points, box, fof.linking_length(box, points.count())).select("gid").distinct().count()


def test_row_numbers_outlive_a_change_of_parallelism(spark, cloud_df, box, tmp_path):
    cloud_df.selectExpr("concat_ws(' ', x0, x1, x2, v0, v1, v2)").repartition(5).write.text(str(tmp_path / "mock"))
    cloud_df.repartition(6).write.parquet(str(tmp_path / "table"))
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    mock = text.read_mock_text(spark, str(tmp_path / "mock"))
    first = {(r.pid, r.x0, r.v2) for r in mock.collect()}
    from boxstats.sources.parts import numbered

    table = numbered(spark.read.parquet(str(tmp_path / "table")))
    numbers = {(r.pid, r._number) for r in table.df.collect()}
    assert {n for _, n in numbers} == set(range(600))
    try:
        spark.conf.set(name, "2k")
        assert {(r.pid, r.x0, r.v2) for r in mock.collect()} == first
        assert {(r.pid, r._number) for r in table.df.collect()} == numbers
        assert hdf5.write_particles(spark.read.parquet(str(tmp_path / "table")), str(tmp_path / "split.h5"), {"boxsize": 256.0}) == 600
    finally:
        spark.conf.set(name, before)
    back, _ = hdf5.read_particles(spark, str(tmp_path / "split.h5"))
    assert back.drop("pid").exceptAll(cloud_df.drop("pid")).count() == 0


def test_physical_positions_scale_the_box(spark, cloud_df, tmp_path):
    half = bs.Box(256.0, 0.3, 0.5)
    binary.write_snapshot(cloud_df, str(tmp_path / "snap"), half, 1.0)
    df, found = binary.read_snapshot(spark, str(tmp_path / "snap"), physical_positions=True)
    assert found.boxsize == 128.0 and df.filter("x0 >= 128").count() == 0


def test_scalars():
    assert bs.Box.at_redshift(100.0, 0.3, 1.0).a == 0.5 and bs.Box(100.0, 0.3, 0.5).z == 1.0
    assert bs.parse_lambdas("0,0.5, 1") == [0.0, 0.5, 1.0]
    with pytest.raises(ValueError):
        bs.parse_lambdas(" , ")


def test_physical_coordinates(spark):
    from boxstats.operators.transforms import to_physical

    df = spark.createDataFrame([(1, 2.0, 4.0, 6.0)], "pid long, x0 double, x1 double, x2 double")
    assert to_physical(df, 0.5).first()[1:] == (1.0, 2.0, 3.0)


def test_snapshot_in_numbered_files(spark, cloud_df, box, tmp_path):
    path = str(tmp_path / "snap")
    assert binary.write_snapshot(cloud_df.repartition(7), path, box, 1.0, rows_per_file=250) == 600
    assert sorted(p.name for p in tmp_path.iterdir()) == ["snap.0", "snap.1", "snap.2"]
    df, found = binary.read_snapshot(spark, path, columns=("id",))
    assert found.boxsize == 256.0
    back = df.selectExpr("id AS pid", "x0", "x1", "x2", "v0", "v1", "v2")
    want = cloud_df.select("pid", "x0", "x1", "x2", "v0", "v1", "v2")
    assert back.count() == 600 and back.exceptAll(want).count() == 0


def test_five_types_with_gas_in_parts(spark, cloud_df, box, tmp_path):
    path = f"file://{tmp_path}/snap"
    typed = cloud_df.selectExpr("*", "cast(pid % 5 AS int) AS ptype", "double(pid % 7 + 1) AS m", "pid / 4 AS u", "pid / 8 AS rho", "pid / 16 AS hsml")
    assert binary.write_snapshot(typed, path, box, {1: 2.0, 3: 4.0}, rows_per_file=130) == 600
    assert len(list(tmp_path.iterdir())) == 5
    df, found = binary.read_snapshot(spark, path, (0, 1, 2, 3, 4), ("ptype", "id", "m", "u", "rho", "hsml"))
    assert found == box
    got = {r.id: (r.ptype, r.m, r.u, r.rho, r.hsml, r.x0, r.v2) for r in df.collect()}
    for r in typed.collect():
        gas = (r.u, r.rho, r.hsml) if r.ptype == 0 else (None,) * 3
        assert got[r.pid] == (r.ptype, {1: 2.0, 3: 4.0}.get(r.ptype, r.m), *gas, r.x0, r.v2)
    with pytest.raises(ValueError):
        binary.write_snapshot(typed.drop("m"), f"{tmp_path}/other", box, {1: 2.0})
    with pytest.raises(FileExistsError):
        binary.write_snapshot(typed, path, box)


def test_groups_and_subsamples_round_trip(spark, cloud_df, box, tmp_path):
    groups = cloud_df.selectExpr("*", "int(pid % 100) AS nfof")
    binary.write_fof_binary(groups, f"{tmp_path}/groups", box, rows_per_file=170)
    df, size = binary.read_fof_binary(spark, f"{tmp_path}/groups", 60)
    back = ["nfof", "x0", "x1", "x2", "v0", "v1", "v2"]
    want = groups.filter("nfof >= 60").select(*back)
    assert size == 256.0 and df.count() == want.count() and df.select(*back).exceptAll(want).count() == 0
    bs.write_catalog(Catalog(cloud_df, box), f"{tmp_path}/sub.b", "subsample", rows_per_file=400)
    assert {p.name for p in tmp_path.iterdir() if p.name.endswith(".b")} == {"sub.0.b", "sub.1.b"}
    again = bs.read_catalog(spark, f"{tmp_path}/sub.b")
    assert again.df.drop("pid").exceptAll(cloud_df.select(*back[1:])).count() == 0 and again.df.count() == 600


def test_a_failed_task_leaves_nothing(spark, cloud_df, box, tmp_path):
    from boxstats.sources.parts import numbered, part_files, write_parts

    def encode(part):
        if part.num_rows < 100:
            raise RuntimeError("no last part")
        return [b"x"]

    with pytest.raises(Exception, match="no last part"):
        write_parts(numbered(cloud_df), f"file://{tmp_path}/out", encode, 130)
    assert list(tmp_path.iterdir()) == []
    assert write_parts(numbered(cloud_df), f"file://{tmp_path}/out", lambda part: [b"%d" % part.num_rows], 130) == 5
    assert [(tmp_path / f"out.{k}").read_text() for k in range(5)] == ["130"] * 4 + ["80"]
    assert len(list(tmp_path.iterdir())) == len(part_files(f"{tmp_path}/out")) == 5


def test_filters_reach_the_scan(spark, cloud_df, box, tmp_path, monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan
    from pyspark.sql.types import StructType

    from boxstats.sources import segments

    halos = cloud_df.selectExpr("*", "int(pid) AS nfof").coalesce(1).sortWithinPartitions("pid")
    path = f"{tmp_path}/halos.h5"
    hdf5.write_particles(halos, path, {"boxsize": 256.0})
    read = []

    class Counted:
        def __init__(self, file):
            self.file = file

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def seek(self, at):
            self.file.seek(at)

        def read(self, n):
            read.append(n)
            return self.file.read(n)

    opened = segments.open_file
    monkeypatch.setattr(segments, "open_file", lambda path: Counted(opened(path)))
    with opened(path) as file:
        found = hdf5.list_datasets(file)
    blocks = [segments.Block(found["/x"].offset, [(c, "<f4") for c in ("x0", "x1", "x2")]), segments.Block(found["/nfof"].offset, [("nfof", "<u4")])]
    options = {"segments": json.dumps([segments.Segment(path, 600, 600 * t - 600, blocks, {"ptype": float(t)}, {}).dump() for t in (1, 2)]), "rowsPerTask": "50"}
    schema = StructType.fromDDL("pid bigint, ptype int, nfof int, x0 double, x1 double, x2 double")

    def scan(*filters):
        reader = segments.SegmentReader(schema, options)
        assert list(reader.pushFilters(list(filters))) == []
        read.clear()
        rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.column(0).to_pylist()]
        return rows, sum(read)

    everything, most = scan()
    assert everything == list(range(1200)) and most == 1200 * 16
    assert scan(EqualTo(("ptype",), 2)) == (list(range(600, 1200)), 600 * 16)
    assert scan(GreaterThanOrEqual(("pid",), 90), LessThan(("pid",), 130)) == (list(range(90, 130)), 40 * 16)
    assert scan(In(("pid",), (5, 7)))[0] == [5, 7]
    # nfof alone is read where nothing is left.
    rows, size = scan(GreaterThanOrEqual(("nfof",), 580), EqualTo(("ptype",), 1))
    assert rows == list(range(580, 600)) and size == 600 * 4 + 20 * 12
    df, _ = hdf5.read_particles(spark, path, columns=("nfof", "x0"))
    assert df.columns == ["pid", "x0", "nfof"] and df.filter("nfof >= 580 AND pid < 590").count() == 10
    plan = df.filter("nfof >= 580")._jdf.queryExecution().executedPlan().toString()
    # The scan has taken the comparison; Spark keeps what the scan leaves to it.
    assert "580" not in plan and "isnotnull(nfof" in plan


def test_small_files_share_tasks(spark, tmp_path, box, monkeypatch):
    df = spark.range(3000).selectExpr("id AS pid", "1 AS nfof", *[f"id % 256 / 1.0D AS {c}{i}" for c in "xv" for i in range(3)])
    path = str(tmp_path / "groups")
    seen = []
    original = binary.write_parts

    def watched(table, *rest):
        files = original(table, *rest)
        seen.append(files)
        return files

    monkeypatch.setattr(binary, "write_parts", watched)
    binary.write_fof_binary(df, path, box, 0.2, 10)
    assert seen == [300]
    back, _ = binary.read_fof_binary(spark, path)
    assert back.rdd.getNumPartitions() <= 2 and back.count() == 3000
    assert back.agg({"x0": "sum"}).first()[0] == sum(i % 256 for i in range(3000))
    with pytest.raises(FileExistsError):
        binary.write_fof_binary(df, path, box, 0.2, 10)


def test_parts_are_written_from_runs_of_rows(spark, tmp_path):
    from boxstats.sources.parts import Layout, numbered, packed, write_parts

    def encode(rows):
        if rows.num_rows > 100:
            raise RuntimeError("too many rows at once")
        odd = rows.filter([i % 2 == 1 for i in rows.column("id").to_pylist()])
        return [rows.num_rows], [(0, packed(rows, [("id", "<i8")])), (2, packed(odd, [("id", "<i4")]))]

    layout = Layout(encode, lambda counts: [b"%3d" % counts[0], 0, b"|", 1, b"||", 2, b"."])
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "100")
        assert write_parts(numbered(spark.range(0, 1750, 1, 3)), str(tmp_path / "out"), layout, 600) == 3
    finally:
        spark.conf.set(name, before)
    for k in range(3):
        ids = np.arange(600 * k, min(600 * k + 600, 1750))
        want = b"%3d" % len(ids) + ids.astype("<i8").tobytes() + b"|||" + ids[1::2].astype("<i4").tobytes() + b"."
        assert (tmp_path / f"out.{k}").read_bytes() == want
