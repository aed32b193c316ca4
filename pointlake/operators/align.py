"""Alignment of scans by keyed 4 x 4 matrices (``m``: 16 numbers, row-major)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vec import inverse_rigid, mul4


def pose_transform(poses: DataFrame, calibration: DataFrame) -> DataFrame:
    """object, camera, angle, m: table from reference camera, times the inverse of camera from reference camera."""
    left = poses.select("object", "angle", *[F.col("m")[i].alias(f"a{i}") for i in range(16)])
    right = calibration.select("object", "camera", *[F.col("m")[i].alias(f"b{i}") for i in range(16)])
    product = mul4([F.col(f"a{i}") for i in range(16)], inverse_rigid([F.col(f"b{i}") for i in range(16)]))
    return left.join(right, "object").select("object", "camera", "angle", F.array(*product).alias("m"))


def apply_transform(points: DataFrame, transforms: DataFrame, keys=("object", "camera", "angle")) -> DataFrame:
    """Every point of a scan moved by the scan's transform."""
    met = points.join(transforms, list(keys))
    moved = {c: F.col("m")[4 * i] * F.col("x") + F.col("m")[4 * i + 1] * F.col("y") + F.col("m")[4 * i + 2] * F.col("z") + F.col("m")[4 * i + 3] for i, c in enumerate("xyz")}
    return met.withColumns(moved).drop("m")


def merge_views(points: DataFrame, transforms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all transformed scans as one table with ``cams``, viewpoints): a camera stands where its transform moves the origin to."""
    merged = apply_transform(points, transforms).withColumn("cams", F.array("camera"))
    views = transforms.select("object", "angle", F.col("camera").alias("cam_id"), *[F.col("m")[4 * i + 3].alias(f"v{c}") for i, c in enumerate("xyz")])
    return merged, views
