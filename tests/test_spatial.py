"""Joins in space against brute force: far from the origin, in dense cells, with repeats; clusters against a walk; rounds."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointlake.operators import normals, ranking, spatial


def cloud(spark, xyz, cloud_id=1):
    return spark.createDataFrame([(cloud_id, i, *map(float, p)) for i, p in enumerate(xyz)], "cloud_id long, point_id long, x double, y double, z double")


def as_samples(points):
    return points.select("cloud_id", F.col("point_id").alias("sample_id"), *[F.col(c).alias(f"s{c}") for c in "xyz"])


@pytest.mark.parametrize("offset", [0.0, 5e5, 5e6])
def test_normals_far_from_the_origin(spark, offset):
    xyz = [(offset + 0.01 * i, offset + 0.01 * j, offset + 0.002 * i) for i in range(15) for j in range(15)]
    points = cloud(spark, xyz).withColumn("cams", F.array(F.lit(0)))
    view = spark.createDataFrame([(1, 0, offset, offset, offset + 5.0)], "cloud_id long, cam_id int, vx double, vy double, vz double")
    got = np.array([(r.nx, r.ny, r.nz) for r in normals.estimate_normals(points, view, 0.025).collect()])
    assert len(got) == 225 and np.abs(got - np.array([-0.2, 0, 1]) / np.hypot(0.2, 1)).max() < 1e-6
    axes = normals.principal_axes(points, ("cloud_id",)).first()
    assert abs(abs(np.dot(axes.axis_min, [-0.2, 0, 1])) / np.hypot(0.2, 1) - 1) < 1e-6


@pytest.mark.parametrize("dense", [None, 10])
def test_joins_of_dense_cells_equal_brute_force(spark, dense):
    rng = np.random.default_rng(0)
    xyz = rng.uniform(-1, 1, (300, 3)) + 1e4
    xyz[:100] = (xyz[:100] - 1e4) * 0.02 + 1e4
    xyz[100:105] = xyz[0]
    points, d = cloud(spark, xyz), np.linalg.norm(xyz[:, None] - xyz[None], axis=2)
    pairs = spatial.neighbour_pairs(points, 0.4, dense=dense)
    got = [(min(r.a_id, r.b_id), max(r.a_id, r.b_id)) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i, j in zip(*np.nonzero(d <= 0.4), strict=True) if i < j}
    joined = [(r.sample_id, r.point_id) for r in spatial.radius_join(as_samples(points), points, 0.4, dense=dense).collect()]
    assert len(joined) == len(set(joined)) and set(joined) == set(zip(*np.nonzero(d <= 0.4), strict=True))


def test_points_in_one_dense_cell_are_spread(spark):
    """A third of a cloud in one cell: no part of it has more than twice its share of rows."""
    rng = np.random.default_rng(1)
    xyz = np.r_[rng.uniform(0, 0.1, (2000, 3)), rng.uniform(0, 10, (4000, 3))]
    points = cloud(spark, xyz).withColumn("cell_", spatial.packed_cell([F.floor(c) for c in ("x", "y", "z")]))
    _, own, on = spatial._dealt(points, points, "cloud_id", 100, "point_id")
    assert "part_" in on and own.groupBy(*on).count().agg(F.max("count")).first()[0] < 200


def test_moments_count_each_neighbour_once(spark):
    xyz = np.random.default_rng(2).uniform(0, 1, (120, 3))
    points = cloud(spark, xyz)
    near = np.linalg.norm(xyz[:, None] - xyz[None], axis=2) <= 0.3
    for r in normals.neighbour_moments(points, 0.3).collect():
        gap = (xyz - xyz[r.point_id])[near[r.point_id]]
        assert r.n == len(gap) and np.allclose([r.sx, r.sxx, r.syz], [gap[:, 0].sum(), (gap[:, 0] ** 2).sum(), (gap[:, 1] * gap[:, 2]).sum()])


def clustered(rng, n, far):
    """A dense knot, a sheet, a few places far away, and points in one place."""
    parts = [rng.normal(size=(n, 3)) * 0.001, np.c_[rng.uniform(-1, 1, (n, 2)), np.zeros(n)], rng.normal(size=(5, 3)) * far, np.tile([0.5, 0.5, 0.5], (6, 1))]
    return np.concatenate(parts)


@pytest.mark.parametrize("k", [1, 4, 50])
def test_nearest_rows_equal_brute_force_with_far_outliers(spark, k, monkeypatch):
    monkeypatch.setattr(spatial, "_LEAF_ROWS", 4)
    rng = np.random.default_rng(k)
    clouds = {1: clustered(rng, 100, 1e4), 2: rng.uniform(0, 1, (30, 3)), 3: np.zeros((1, 3))}
    points = None
    for c, xyz in clouds.items():
        points = cloud(spark, xyz, c) if points is None else points.unionByName(cloud(spark, xyz, c))
    got = {}
    for r in spatial.nearest_rows(as_samples(points), points, k).collect():
        got.setdefault((r.cloud_id, r.sample_id), []).append((r.d2, r.point_id, r.rank))
    for c, xyz in clouds.items():
        d2 = ((xyz[:, None] - xyz[None]) ** 2).sum(axis=2)
        for i in range(len(xyz)):
            want = sorted((d2[i, j], j) for j in range(len(xyz)))[:k]
            mine = sorted(got[c, i], key=lambda x: x[2])
            assert [x[2] for x in mine] == list(range(1, len(want) + 1)) and np.allclose([x[0] for x in mine], [x[0] for x in want])
            assert {x[1] for x in mine} <= {j for j in range(len(xyz)) if d2[i, j] <= want[-1][0] * (1 + 1e-9)}


def test_no_join_is_on_the_cloud_alone(spark):
    points = cloud(spark, np.random.default_rng(0).uniform(0, 1, (50, 3)))
    centres = points.select("cloud_id", F.col("point_id").alias("centre_id"), *[F.col(c).alias(f"c{c}") for c in "xyz"])
    cands = points.select("cloud_id", F.col("point_id").alias("cand_id"), *[F.col(c).alias(f"p{c}") for c in "xyz"], *[F.col(c).alias(f"a{c}") for c in "xyz"], F.lit(1).alias("score"))
    knn = spatial.knn_join(as_samples(points), points, 3, 0.001)
    for frame in (spatial.nearest_centre(points, centres), ranking.dedupe_candidates(cands), knn):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        joins = [line for line in plan.split("\n") if "Join Inner" in line]
        short = [j for j in joins if not any(c in j for c in ("cell_", "i_#", "sample_id"))]
        assert len(short) <= 1, short  # the first level's, which has eight cells a cloud at most


def hands(spark, seed, n=120):
    rng = np.random.default_rng(seed)
    axis = rng.normal(size=(n, 3)) * 0.2 + [0, 0, 1]
    axis /= np.linalg.norm(axis, axis=1)[:, None]
    place, score = rng.uniform(0, 0.12, (n, 3)), rng.integers(0, 15, n).astype(float)
    rows = [(1, i, *map(float, place[i]), *map(float, axis[i]), float(score[i])) for i in range(n)]
    frame = spark.createDataFrame(rows, "cloud_id int, cand_id int, px double, py double, pz double, cx double, cy double, cz double, score double")
    return frame, place, axis, score


def test_exclusive_clusters_equal_a_walk(spark):
    frame, place, axis, score = hands(spark, 3)
    gap = place[None] - place[:, None]
    along = np.einsum("ijk,ik->ij", gap, axis)
    off = np.sqrt(np.maximum(0, (gap**2).sum(axis=2) - along**2))
    near = (np.abs(axis @ axis.T) > np.cos(np.radians(20))) & (np.linalg.norm(gap, axis=2) <= 0.05) & (off <= 0.02)
    np.fill_diagonal(near, False)
    used, want = np.zeros(len(score), bool), {}
    for i in sorted(range(len(score)), key=lambda i: (-score[i], i)):
        own = np.flatnonzero(near[i] & ~used)
        used[own] = True
        if len(own) >= 2:
            want[i] = (len(own), score[own].mean() - 2.576 * score[own].std() / np.sqrt(len(own)))
    got = {r.cand_id: (r.support, r.score) for r in ranking.cluster_exclusive(frame, 2, angle=20.0, dist=0.05, lateral=0.02).collect()}
    assert len(want) > 5 and got.keys() == want.keys()
    assert all(got[i][0] == want[i][0] and got[i][1] == pytest.approx(want[i][1]) for i in want)


def test_rounds_never_share_a_place(spark):
    """Sample ids beyond a million, two rounds: every (sample, orientation) is one place."""
    from pointlake.operators.poses import R
    from pointlake.params import Box, Hand
    from pointlake.plans.pipelines import detect_iterative

    side = range(-20, 21, 5)
    rows = [(1, i, float(x), float(y), float(z), 0.0, float(np.sign(y)), 0.0) for i, (x, y, z) in enumerate((x, y, z) for x in side for y in (-20, 20) for z in side)]
    points = spark.createDataFrame(rows, "cloud_id long, point_id long, x double, y double, z double, nx double, ny double, nz double")
    first = spark.createDataFrame([(1, 1_000_000 + k, 20.0, 0.0, 5.0 * k) for k in range(3)], "cloud_id long, sample_id long, sx double, sy double, sz double")
    turned = lambda s: s.select("cloud_id", "sample_id", F.lit(0).alias("orient"), *[F.lit(float(v)).alias(c) for c, v in zip(R, (-1, 0, 0, 0, -1, 0, 0, 0, 1), strict=True)])
    hand, box = Hand(finger=10, outer=120, depth=60, height=20, bite=10), Box(*[-200, 200] * 3)
    found = detect_iterative(points, first, turned, hand, 2, 6, 3.0, box, (1, 100), placements=11, friction=20.0, viable=6, near=3.0)
    rows = found.select("sample_id", "orient", "round", "px", "py", "pz").collect()
    assert {r.round for r in rows} == {0, 1, 2} and len({(r.sample_id, r.orient) for r in rows}) == len(rows)
