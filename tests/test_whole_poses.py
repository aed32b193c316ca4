"""Poses and images of clouds met whole against the same by cells and windows."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from pointlake.operators import poses, raster
from pointlake.params import Hand, Image

HAND = Hand(0.1, 1.2, 0.6, 0.4, 0.1)
SIDE = Image(0.6, 1.0, 0.4, 8)


def scene(spark):
    """A thin box in two clouds, with normals (some null), a repeated id, and turned poses at some of its points."""
    rng, points, samples, grid = random.Random(4), [], [], []
    for c in (1, 2):
        for i in range(60 if c == 1 else 25):
            side = rng.choice((-1, 1))
            n = (0.0, float(side), 0.0) if i % 9 else (None, None, None)
            points.append((c, i if i != 7 else 6, rng.uniform(-0.3, 0.3), side * 0.2 + rng.uniform(-0.01, 0.01), rng.uniform(-0.4, 0.4), *n))
        for i in range(0, 12, 3):
            samples.append((c, i, *points[-1 - i][2:5]))
            for k, angle in enumerate((0.0, math.pi, 0.3)):
                a, b = math.cos(angle), math.sin(angle)
                grid.append((c, i, k, a, -b, 0.0, b, a, 0.0, 0.0, 0.0, 1.0))
    one = spark.createDataFrame(points, "cloud_id long, point_id long, x double, y double, z double, nx double, ny double, nz double")
    two = spark.createDataFrame(samples, "cloud_id long, sample_id long, sx double, sy double, sz double")
    return one, two, spark.createDataFrame(grid, "cloud_id long, sample_id long, orient int, " + ", ".join(f"{r} double" for r in poses.R))


def rows(df):
    names = sorted(df.columns)
    return sorted(tuple(round(r[n], 9) if isinstance(r[n], float) else r[n] for n in names) for r in df.collect())


def test_poses_are_the_same_by_cells(spark):
    """Windows over every pose's points moved each point once for each pose."""
    points, samples, grid = scene(spark)
    told = lambda most: poses.candidate_poses(samples, grid, points, HAND, 6, 0.1, 20.0, 2, 0.05, most=most)
    one, mixed = told(10_000), told(60)
    assert "Window" not in one._jdf.queryExecution().executedPlan().toString()
    assert {r.label for r in one.collect()} >= {2} and one.count() >= 6
    assert rows(one) == rows(mixed)
    fit = lambda most: poses.feasible_poses(samples, grid, points, HAND, 6, most=most)
    assert rows(fit(10_000)) == rows(fit(60)) and fit(10_000).count() >= one.count()
    placed = one.localCheckpoint()
    again = lambda most: poses.reevaluate(placed.drop("label"), points.where("point_id % 5 > 0"), HAND, 20.0, 2, 0.05, most=most)
    assert rows(again(10_000)) == rows(again(45)) and again(10_000).count() == placed.count()


@pytest.mark.parametrize("channels", [1, 15])
def test_images_are_the_same_by_cells(spark, channels):
    """images came from joins of every pose's points and from arrays in expressions."""
    points, samples, grid = scene(spark)
    cands = grid.join(samples, ["cloud_id", "sample_id"]).withColumns({"bottom": F.lit(-0.3), "centre": F.lit(0.02)}).localCheckpoint()
    told = lambda most, pixels=False: raster.pose_images(cands, points, SIDE, channels, HAND, pixels=pixels, most=most)
    one = told(10_000)
    assert one._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert rows(one) == rows(told(60)) and one.count() == cands.count()
    assert rows(told(10_000, True)) == rows(raster.unpack(one, SIDE.size, channels))
