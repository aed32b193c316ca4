from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointlake.functions.vec import axis_rotation, eigenvalues, eigenvector
from pointlake.operators import clean, dataset, normals, poses, ranking, raster, scoring, spatial
from pointlake.params import Box, Hand
from pointlake.sources import io


def cloud(spark, xyz, cloud_id=1):
    rows = [(cloud_id, i, float(x), float(y), float(z)) for i, (x, y, z) in enumerate(xyz)]
    return spark.createDataFrame(rows, "cloud_id long, point_id long, x double, y double, z double")


def test_remove_nans(spark):
    df = cloud(spark, [(0, 0, 0), (float("nan"), 0, 0), (float("inf"), 1, 1)])
    assert clean.remove_nans(df).count() == 1


def test_workspace_is_strict(spark):
    df = cloud(spark, [(0, 0, 0), (1, 0, 0)])
    assert clean.filter_workspace(df, Box(-1, 1, -1, 1, -1, 1)).count() == 1


def test_radius_join_equals_brute_force(spark):
    xyz = np.random.default_rng(0).uniform(-1, 1, (150, 3))
    right = cloud(spark, xyz)
    left = right.select("cloud_id", F.col("point_id").alias("sample_id"), *[F.col(c).alias(f"s{c}") for c in "xyz"])
    got = {(r[0], r[1]) for r in spatial.radius_join(left, right, 0.4).select("sample_id", "point_id").collect()}
    d = np.linalg.norm(xyz[:, None] - xyz[None], axis=2)
    assert got == set(zip(*np.nonzero(d <= 0.4), strict=True))


def test_knn_join_reaches_far_points(spark):
    xyz = [(0, 0, 0), (0.1, 0, 0), (50, 0, 0), (51, 0, 0)]
    right = cloud(spark, xyz)
    left = right.where("point_id = 0").select("cloud_id", F.col("point_id").alias("sample_id"), *[F.col(c).alias(f"s{c}") for c in "xyz"])
    rows = spatial.knn_join(left, right, 3, 0.2).orderBy("rank").select("point_id").collect()
    assert [r[0] for r in rows] == [0, 1, 2]


def test_voxels_stand_on_their_grid(spark):
    df = cloud(spark, np.random.default_rng(1).uniform(0, 1, (300, 3)).tolist())
    once = clean.voxelize(df, 0.25, normals=False)
    assert once.count() == len({tuple(r) for r in once.select("x", "y", "z").collect()}) <= 64
    assert once.agg(F.sum("n_points")).first()[0] == 300


def test_eigenvectors_match_numpy(spark):
    rng = np.random.default_rng(2)
    mats = [a @ a.T for a in rng.normal(size=(50, 3, 3))]
    rows = [tuple(float(m[i][j]) for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))) for m in mats]
    names = ["xx", "xy", "xz", "yy", "yz", "zz"]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, " + ", ".join(f"{n} double" for n in names))
    most, least = eigenvalues(names)
    out = df.withColumns({"hi": most, "lo": least}).withColumns({"v": eigenvector(names, F.col("lo")), "w": eigenvector(names, F.col("hi"))}).orderBy("id").collect()
    for m, r in zip(mats, out, strict=True):
        values, axes = np.linalg.eigh(m)
        assert r.lo == pytest.approx(values[0], abs=1e-8) and r.hi == pytest.approx(values[2])
        assert abs(np.dot(r.v, axes[:, 0])) == pytest.approx(1, abs=1e-6) and abs(np.dot(r.w, axes[:, 2])) == pytest.approx(1, abs=1e-6)


def test_normals_of_a_plane(spark):
    df = cloud(spark, [(x / 10, y / 10, 0) for x in range(6) for y in range(6)]).withColumn("cams", F.array(F.lit(0)))
    views = spark.createDataFrame([(1, 0, 0.0, 0.0, 5.0)], "cloud_id long, cam_id int, vx double, vy double, vz double")
    out = normals.estimate_normals(df, views, 0.25).collect()
    assert all(r.nz == pytest.approx(1) for r in out)


def test_plane_is_found_and_removed(spark):
    flat = [(x / 10, y / 10, 0.0) for x in range(8) for y in range(8)]
    df = cloud(spark, flat + [(0.1 * i, 0.2, 1.0 + i) for i in range(5)])
    planes = normals.fit_plane(df, 0.01, 20)
    assert normals.remove_plane(df, planes, 0.01).count() == 5


def box(spark):
    """A box of 40 x 40 x 80 with normals on its lateral faces."""
    pts = [(x, y, z, 0.0, math.copysign(1.0, y), 0.0) for x in range(-20, 21, 5) for y in (-20, 20) for z in range(-40, 41, 5)]
    rows = [(1, i, *map(float, p)) for i, p in enumerate(pts)]
    return spark.createDataFrame(rows, "cloud_id long, point_id long, x double, y double, z double, nx double, ny double, nz double")


def test_box_is_grasped_fully(spark):
    from pointlake.plans.pipelines import generate_candidates

    hand = Hand(finger=10, outer=120, depth=60, height=20, bite=10)
    samples = spark.createDataFrame([(1, 1, 20.0, 0.0, 0.0)], "cloud_id long, sample_id long, sx double, sy double, sz double")
    eye = samples.select("cloud_id", "sample_id", F.lit(0).alias("orient"), *[F.lit(float(v)).alias(c) for c, v in zip(poses.R, (-1, 0, 0, 0, -1, 0, 0, 0, 1), strict=True)])
    row = generate_candidates(samples, eye, box(spark), hand, 11, None, 20.0, 6, 3.0).first()
    assert row.width == 40 and row.label == 2 and row.placement == 5


def test_middle_of_feasible_hands(spark):
    df = spark.createDataFrame([(1, [False, True, True, True]), (2, [False] * 4), (3, [True, False, False, True])], "id int, hands array<boolean>")
    assert [r.placement for r in poses.choose_middle(df).orderBy("id").collect()] == [2, -1, 0]


def test_rotation_about_axis():
    assert np.allclose(np.array(axis_rotation(2, math.pi / 2)).reshape(3, 3) @ [1, 0, 0], [0, 1, 0])


def test_draws_do_not_depend_on_partitions(spark):
    df = cloud(spark, np.random.default_rng(5).uniform(0, 1, (50, 3)).tolist())
    one, other = (sorted(r.point_id for r in dataset.subsample_uniform(x, 7).collect()) for x in (df.repartition(1), df.repartition(9)))
    assert one == other and len(one) == 7


def test_resampling_stops_when_every_view_has_enough(spark):
    views = spark.createDataFrame([(0,), (1,)], "view_id int")
    seen = []

    def draw(v, k):
        seen.append(v.count())
        return v.select("view_id", F.when((F.col("view_id") == 0) | F.lit(k > 0), 1).otherwise(0).alias("label"))

    out = dataset.resample_until(draw, views, 1, 5)
    assert seen == [2, 1] and out.count() == 3


def test_convolution():
    rng = np.random.default_rng(4)
    x, w, bias = rng.normal(size=(2, 3, 7, 6)), rng.normal(size=(4, 3, 3, 2)), rng.normal(size=4)
    want = np.zeros((2, 4, 5, 5))
    for n, k, i, j in np.ndindex(want.shape):
        want[n, k, i, j] = (x[n, :, i : i + 3, j : j + 2] * w[k]).sum() + bias[k]
    assert np.allclose(scoring.convolve(x, w, bias), want)


def test_packed_image_fills_gaps(spark):
    rows = [(1, 1, 0, c, r, k, v) for c, r, k, v in ((0, 0, 0, 7), (1, 2, 1, 9), (0, 2, 2, 5))]
    pixels = spark.createDataFrame(rows, "cloud_id int, sample_id int, orient int, channel int, row int, col int, value short")
    want = np.zeros((3, 3, 2), int)
    want[0, 0, 0], want[2, 1, 1], want[2, 2, 0] = 7, 9, 5
    assert raster.pack(pixels, 3, 2).first()["image"] == want.ravel().tolist()


def _image_twin(points: list[dict], size: int, channels: int) -> np.ndarray:
    """The packed image of one pose, cell by cell."""
    views = [("u0", "u1", "u2")] + ([("u2", "u1", "u0"), ("u2", "u0", "u1")] if channels > 3 else [])
    out = np.zeros((size, size, channels), int)
    for k, (w0, w1, w2) in enumerate(views):
        inside: dict[tuple, list] = {}
        for p in sorted(points, key=lambda p: p["point_id"]):
            inside.setdefault((size - 1 - min(int(p[w0] * size), size - 1), min(int(p[w1] * size), size - 1)), []).append(p)
        means = {at: np.cumsum([p[w2] for p in ps])[-1] / len(ps) for at, ps in inside.items()}
        blends = {}
        for at, ps in inside.items():
            v = np.zeros(3)
            for p in ps:
                n, long = np.abs([p["nf"], p["nl"], p["nv"]]), np.sqrt((v * v).sum())
                v = n if long == 0 else v + (n - v) / long
            blends[at] = v
        depth, shadow = ({at: np.array([f(m)]) for at, m in means.items()} for f in (lambda m: 1 - m, lambda m: max(means.values()) - m))
        groups = {1: [depth], 3: [blends], 12: [blends, depth], 15: [blends, depth, shadow]}[channels]
        first = k * channels // len(views)
        for group in groups:
            width = len(next(iter(group.values())))
            wide = np.zeros((size, size, width))
            for i, j in np.ndindex(size, size):
                near = [group[a, b] for a in (i - 1, i, i + 1) for b in (j - 1, j, j + 1) if (a, b) in group]
                wide[i, j] = np.max(near, axis=0) if near else 0
            lo, hi = wide.min(), wide.max()
            out[:, :, first : first + width] = np.rint(255 * (wide - lo) / (hi - lo)) if hi > lo else 0
            first += width
    return out


@pytest.mark.parametrize(("size", "channels"), [(60, 15), (7, 12), (5, 3), (4, 1)])
def test_packed_images_equal_a_loop_over_cells(spark, size, channels):
    rng = np.random.default_rng(size)
    rows = []
    for pose in range(3):
        for k in range((1, 40, 700)[pose]):  # one point, a few, a full image
            u, n = rng.random(3), rng.normal(size=3)
            rows.append((1, pose, 0, k, *map(float, u), *map(float, n / np.linalg.norm(n))))
    names = ["cloud_id", "sample_id", "orient", "point_id", "u0", "u1", "u2", "nf", "nl", "nv"]
    points = spark.createDataFrame(rows, names).repartition(3)
    got = {r["sample_id"]: r["image"] for r in raster.packed_images(points, size, channels).collect()}
    assert set(got) == {0, 1, 2}
    for pose, image in got.items():
        want = _image_twin([dict(zip(names, r, strict=True)) for r in rows if r[1] == pose], size, channels)
        if channels == 1:  # means are made in part, in any order
            assert np.abs(np.array(image) - want.ravel()).max() <= 1
        else:
            assert image == want.ravel().tolist()
    assert raster.packed_images(points.where("false"), size, channels).count() == 0
    images = raster.packed_images(points, size, channels)
    again = raster.pack(raster.unpack(images, size, channels), size, channels)
    assert {r["sample_id"]: r["image"] for r in again.collect()} == got


def test_normals_join_the_cloud_they_belong_to(spark, tmp_path):
    head = "VERSION .7\nFIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nCOUNT 1 1 1\nWIDTH 2\nHEIGHT 1\nPOINTS 2\nDATA ascii\n"
    for name, z in (("a", 1), ("b", 2)):
        (tmp_path / f"{name}_gt.pcd").write_text(head + f"0 0 {z}\n1 0 {z}\n")
        (tmp_path / f"{name}_gt_normals.csv").write_text(f"0,0,{z}\n0,{z},0\n")
    manifest = spark.createDataFrame([(str(tmp_path / f"{n}_gt.pcd"), str(tmp_path / f"{n}_gt_normals.csv")) for n in "ab"], "cloud string, normals string")
    normals_ = io.read_normals_csv(spark, str(tmp_path / "*_normals.csv"), manifest)
    got = clean.attach_normals(io.ingest_pcd(spark, str(tmp_path / "*.pcd")), normals_).orderBy("z", "x")
    assert [(r.z, r.ny, r.nz) for r in got.collect()] == [(1, 0, 1), (1, 1, 0), (2, 0, 2), (2, 2, 0)]


def test_refined_normals_settle(spark):
    df = cloud(spark, [(i, j, 0) for i in range(4) for j in range(4)]).withColumns({"nx": F.when(F.col("point_id") == 5, 0.6).otherwise(0.0), "ny": F.lit(0.0), "nz": F.when(F.col("point_id") == 5, 0.8).otherwise(1.0)})
    one, three = (normals.refine_normals(df, 5, 1.5, n).agg(F.max(F.abs("nx"))).first()[0] for n in (1, 3))
    assert 0 < three < one < 0.6


def test_frame_plans_stay_small(spark):
    df = cloud(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0)]).withColumns({"nx": F.lit(0.6), "ny": F.lit(0.0), "nz": F.lit(0.8)})
    samples = df.select("cloud_id", F.col("point_id").alias("sample_id"), *[F.col(c).alias(f"s{c}") for c in "xyz"])
    plan = normals.local_frames(samples, df, 2.0)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 50_000


def test_matrices_descriptors_and_clouds_round_trip(spark, tmp_path):
    m = spark.createDataFrame([("a", [float(i) for i in range(16)])], "object string, m array<double>")
    m.write.parquet(str(tmp_path / "m"))
    assert io.read_matrices(spark, str(tmp_path / "m")).first()["m"][5] == 5
    cands = spark.createDataFrame([(1, 2, 3, [0.0] * 16, 0.5)], "cloud_id int, sample_id int, orient int, m array<double>, width double")
    images = spark.createDataFrame([(1, 2, 3, [1, 2])], "cloud_id int, sample_id int, orient int, image array<short>")
    io.write_descriptors(cands, images, str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d")).first()["image"] == [1, 2]
    points = cloud(spark, [(1, 2, 3)]).withColumns({"object": F.lit("o"), "camera": F.lit(4)})
    assert io.write_clouds(points, str(tmp_path / "c"), "a") and not io.write_clouds(points, str(tmp_path / "c"), "a")
    assert io.read_store(spark, str(tmp_path / "c")).where("object = 'o' and camera = 4").count() == 1


def test_dedupe_keeps_the_better_pose(spark):
    rows = [(1, 1, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 5.0), (1, 2, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 9.0)]
    df = spark.createDataFrame(rows, "cloud_id int, cand_id int, px double, py double, pz double, ax double, ay double, az double, score double")
    assert [r.cand_id for r in ranking.dedupe_candidates(df).collect()] == [2]


def test_files_of_clouds(spark, tmp_path):
    head = "VERSION .7\nFIELDS x y z rgb\nSIZE 4 4 4 4\nTYPE F F F I\nCOUNT 1 1 1 1\nWIDTH 2\nHEIGHT 1\nPOINTS 2\nDATA "
    (tmp_path / "a.pcd").write_text(head + "ascii\n1 2 3 0\n4 5 6 0\n")
    raw = np.array([(1, 2, 3, 0), (4, 5, 6, 0)], [("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("c", "<i4")])
    (tmp_path / "b.pcd").write_bytes((head + "binary\n").encode() + raw.tobytes())
    (tmp_path / "c.pcd").write_text("no cloud")
    got = io.ingest_pcd(spark, str(tmp_path / "*.pcd"))
    assert got.count() == 4 and {tuple(r) for r in got.select("x", "y", "z").collect()} == {(1, 2, 3), (4, 5, 6)}
    (tmp_path / "d.ply").write_text("ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nproperty float y\nproperty float z\nend_header\n7 8 9\n")
    assert tuple(io.ingest_ply(spark, str(tmp_path / "*.ply")).select("x", "y", "z").first()) == (7, 8, 9)


def test_round_trips_of_sinks(spark, tmp_path):
    df = box(spark)
    io.write_normals_csv(df, str(tmp_path / "n"))
    back = io.read_normals_csv(spark, str(tmp_path / "n"))
    assert back.count() == df.count() and {r[0] for r in back.select("cloud_id").distinct().collect()} == {r[0] for r in df.select("cloud_id").distinct().collect()}
    inst = spark.createDataFrame([("a", [1, 2], "train"), ("b", [3, 4], "test")], "id string, image array<int>, split string")
    for batch in ("1", "2", "2"):
        io.write_instances(inst, str(tmp_path / "i"), batch)
    assert io.read_store(spark, str(tmp_path / "i")).where("split = 'test'").count() == 2
