"""Clouds met whole against brute force and against joins on cells: repeats, empty coordinates, far outliers, mixed sizes."""

from __future__ import annotations

import math
import random
import re

import pytest

from pointlake.operators import normals, spatial, whole

POINTS = "cloud_id long, point_id long, x double, y double, z double"


def scattered(spark, clouds=4, n=40, seed=5):
    """Clouds of a few and of many points, one far off, with one outlier each and two points in one place."""
    rng, rows = random.Random(seed), []
    for c in range(clouds):
        off = 5e6 if c == 1 else 0.0
        at = [[off + rng.random() for _ in range(3)] for _ in range(1 if c == 3 else n)]
        at += [[off + 400.0, off, off], at[0]] if c != 3 else []
        rows += [(c, i, *p) for i, p in enumerate(at)]
    return spark.createDataFrame(rows, POINTS)


def as_samples(df):
    return df.selectExpr("cloud_id", "point_id as sample_id", "x as sx", "y as sy", "z as sz")


def exchanges(df) -> int:
    return len(re.findall(r"\bExchange\b", df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]))


@pytest.mark.parametrize("most", [30, whole.MOST])
def test_nearest_equal_brute_force(spark, most):
    points = scattered(spark)
    rows = points.collect()
    want = {}
    for a in rows:
        near = sorted((math.dist(a[2:], b[2:]) ** 2, b.point_id) for b in rows if b.cloud_id == a.cloud_id)[:4]
        want |= {(a.cloud_id, a.point_id, k): i for k, (_, i) in enumerate(near, 1)}
    got = spatial.knn_join(as_samples(points), points, 4, 0.2, most=most).collect()
    assert {(r.cloud_id, r.sample_id, r["rank"]): r.point_id for r in got} == want and len(got) == len(want)


def test_whole_clouds_cost_one_exchange(spark):
    """neighbours of small clouds were found by copies of all rows to cells, which filled the disk."""
    points = scattered(spark).selectExpr("*", "1.0D as nx", "0.0D as ny", "0.0D as nz")
    for df in (spatial.knn_join(as_samples(points), points, 4, 0.2), normals.refine_normals(points, 4, 0.2), normals.refine_normals(points, 4, 0.2, 3)):
        assert exchanges(df) == 1 and "Generate" not in df._jdf.queryExecution().executedPlan().toString()


def test_smoothing_is_the_same_by_cells(spark):
    rng = random.Random(2)
    rows = [(*r, *(None if r.point_id == 7 else rng.gauss(0, 1) for _ in range(3))) for r in scattered(spark).collect()]
    points = spark.createDataFrame(rows, POINTS + ", nx double, ny double, nz double")
    told = lambda most: {(r.cloud_id, r.point_id): r[2:] for r in normals.refine_normals(points, 4, 0.2, 3, most=most).collect()}
    one, other = told(whole.MOST), told(30)
    assert len(one) == points.count() and one.keys() == other.keys()
    assert all(a == b or a == pytest.approx(b, abs=1e-9) for k in one for a, b in zip(one[k], other[k], strict=True))


def test_outliers_are_the_same_by_cells(spark):
    """F2"""
    points = scattered(spark)
    told = lambda most: sorted((r.cloud_id, r.point_id) for r in spatial.remove_statistical_outliers(points, 3, 1.0, 0.2, most=most).collect())
    kept = told(whole.MOST)
    assert kept == told(30)
    assert not {(0, 40), (1, 40), (2, 40)} & set(kept) and (3, 0) in kept


def test_places_that_are_not_numbers_are_near_nothing(spark):
    rows = [(1, 1, 0.0, 0.0, 0.0), (1, 2, 0.1, 0.0, 0.0), (1, 3, None, 0.0, 0.0), (1, 4, float("nan"), 0.0, 0.0), (1, 5, float("inf"), 0.0, 0.0), (None, 6, 0.0, 0.0, 0.0)]
    points = spark.createDataFrame(rows, POINTS)
    got = spatial.knn_join(as_samples(points), points, 3, 0.2).collect()
    assert sorted((r.sample_id, r.point_id) for r in got) == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_moments_are_the_same_by_cells(spark):
    """Small clouds in one exchange."""
    points = spark.createDataFrame([r for r in scattered(spark).collect()] + [(0, 3, 0.5, 0.5, 0.5), (2, 90, None, 0.0, 0.0)], POINTS)
    for of, keys in ((normals.neighbour_moments, 5), (normals.place_moments, 2)):
        told = lambda most: sorted((tuple(r) for r in of(points, 0.4, most=most).collect()), key=lambda r: (r[:2], str(r)))  # noqa: E731, B023
        one = told(whole.MOST)
        assert exchanges(of(points, 0.4)) == 1
        other = told(30)
        assert len(one) == len(other) and len(one[0]) == len(other[0])
        assert all(a == b or a == pytest.approx(b, rel=1e-6, abs=1e-6) for x, y in zip(one, other, strict=True) for a, b in zip(x[keys:], y[keys:], strict=True))


def test_draws_are_the_same_by_a_sort(spark):
    """draws numbered all points by a sort of all clouds."""
    from pointlake.operators import dataset

    points = scattered(spark)
    told = lambda most: sorted(map(tuple, dataset.subsample_indices(points, 5, 42, "point_id", most=most).collect()))
    assert told(whole.MOST) == told(30) and len(told(whole.MOST)) == 20
    assert exchanges(dataset.subsample_indices(points, 5, 42, "point_id")) == 1


def test_normals_are_the_same_by_cells(spark):
    """Axes were found row by row in expressions; repeats of an id and points alone have none or one."""
    points = scattered(spark).selectExpr("*", "array(0) as cams")
    seen = spark.createDataFrame([(c, 0, 0.5, 0.5, 9.0) for c in range(4)], "cloud_id long, cam_id int, vx double, vy double, vz double")
    told = lambda most: {(r.cloud_id, r.point_id): r for r in normals.estimate_normals(points, seen, 0.4, with_gap=True, most=most).collect()}
    one, other = told(whole.MOST), told(30)
    assert one.keys() == other.keys() and one[3, 0].nx is None
    for k, r in one.items():
        assert (r.nx is None) == (other[k].nx is None)
        if r.nx is not None and r.gap > 0.01:
            assert (r.nx, r.ny, r.nz) == pytest.approx((other[k].nx, other[k].ny, other[k].nz), abs=1e-5)
