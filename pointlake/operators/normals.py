"""Grouped principal axes, normals, local frames and planes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vec import bind, cross, dot, eigen
from .dataset import numbered_within
from .spatial import both_ways, cut_lineage, knn_join, neighbour_pairs, radius_join
from .whole import MOST, moments_whole, parted, place_moments_whole, refine_whole

PAIRS = ("xx", "xy", "xz", "yy", "yz", "zz")


def moments(neigh: DataFrame, keys, xyz=("x", "y", "z"), about=None) -> DataFrame:
    """Count, sums and sums of products of the coordinates of every group, less the row's ``about`` if it is given."""
    x = {n: F.col(c) - F.col(o) if o else F.col(c) for n, c, o in zip("xyz", xyz, about or (None,) * 3, strict=True)}
    return neigh.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(x[c]).alias(f"s{c}") for c in "xyz"], *[F.sum(x[p[0]] * x[p[1]]).alias(f"s{p}") for p in PAIRS])


def covariance(m: DataFrame) -> DataFrame:
    """cxx .. czz from moments, as doubles. Exact only as far as the products are: take moments about a place near the points."""
    n = F.col("n").cast("double")
    return m.withColumns({f"c{p}": F.col(f"s{p}") / n - (F.col(f"s{p[0]}") / n) * (F.col(f"s{p[1]}") / n) for p in PAIRS})


def axes_of(m: DataFrame, ends=("max", "min")) -> DataFrame:
    """Moments with covariance, greatest and least eigenvalue and their unit axes; null where undefined."""
    return covariance(m).withColumn("e_", eigen([f"c{p}" for p in PAIRS], ends)).select("*", "e_.*").drop("e_")


def principal_axes(neigh: DataFrame, keys, xyz=("x", "y", "z"), about=None) -> DataFrame:
    """Greatest and least eigenvalue of every group's covariance and their unit axes; null where undefined.

    Sums are taken about ``about`` (columns that are the same for all rows of a group), or else about the group's own lower
    corner, so that large coordinates don't cancel.
    """
    if about is None:
        about = ("low_x_", "low_y_", "low_z_")
        low = neigh.groupBy(*keys).agg(*[F.min(c).alias(o) for c, o in zip(xyz, about, strict=True)])
        neigh = neigh.join(low, list(keys))
    return axes_of(moments(neigh, keys, xyz, about))


def neighbour_moments(points: DataFrame, r: float, most: int = MOST) -> DataFrame:
    """``points`` with the moments of each one's neighbours within ``r`` about itself: n (itself included) and the sums.

    A point alone has n = 1 and sums of 0. Rows that repeat an id share their neighbours. Clouds of at most ``most`` points are met whole, in
    one exchange; in others each pair is found once by cells and counts both ways.
    """
    (small,), large = parted("cloud_id", most, points)
    found = moments_whole(small, r)
    return found if large is None else found.unionByName(_moments_by_cells(large[0], r))


def _moments_by_cells(points: DataFrame, r: float) -> DataFrame:
    near = both_ways(neighbour_pairs(points, r)).withColumnRenamed("own_id", "point_id")
    around = moments(near, ("cloud_id", "point_id"), about=("ox", "oy", "oz"))
    sums = [f"s{c}" for c in "xyz"] + [f"s{p}" for p in PAIRS]
    met = points.join(around, ["cloud_id", "point_id"], "left")
    return met.withColumns({"n": F.coalesce("n", F.lit(0)) + 1} | {c: F.coalesce(c, F.lit(0)) for c in sums})


def place_moments(points: DataFrame, r: float, most: int = MOST) -> DataFrame:
    """cloud_id, point_id, n and the sums of the coordinates of each point's neighbours within ``r`` and its own."""
    placed = points.select("cloud_id", "point_id", "x", "y", "z").where("x is not null and y is not null and z is not null")
    (small,), large = parted("cloud_id", most, placed)
    found = place_moments_whole(small, r)
    if large is None:
        return found
    near = both_ways(neighbour_pairs(large[0], r)).select("cloud_id", F.col("own_id").alias("point_id"), "x", "y", "z")
    return found.unionByName(moments(near.unionByName(large[0]), ("cloud_id", "point_id")))


def estimate_normals(points: DataFrame, viewpoints: DataFrame, r: float, with_gap: bool = False, most: int = MOST) -> DataFrame:
    """Normal of the plane through the neighbours of each point, pointed at the viewpoint of its first camera.

    Moments are taken about the point itself, so that places far from the origin lose nothing. Fewer than three neighbours give null.
    viewpoints: cloud_id, cam_id, vx, vy, vz. ``with_gap`` adds ``gap``: the middle eigenvalue less the least one, as a share of
    their sum; where it is near 0 the normal is arbitrary.
    """
    keep = [c for c in points.columns if c not in ("nx", "ny", "nz")]
    (small,), large = parted("cloud_id", most, points.select(*keep))
    least = F.when(F.col("a0").isNotNull(), F.array("a0", "a1", "a2"))
    axes = moments_whole(small, r, axes=True).select(*keep, "n", "trace", "l_max", "l_min", least.alias("axis_min"))
    if large is not None:
        far = axes_of(_moments_by_cells(large[0], r), ("min",)).withColumn("trace", F.col("cxx") + F.col("cyy") + F.col("czz"))
        axes = axes.unionByName(far.select(*keep, "n", "trace", "l_max", "l_min", "axis_min"))
    gap = ((F.col("trace") - F.col("l_max") - 2 * F.col("l_min")) / F.col("trace")).alias("gap")
    axes = axes.select(*keep, F.array_min("cams").alias("cam_id"), F.when(F.col("n") >= 3, F.col("axis_min")).alias("axis_min"), *([gap] if with_gap else []))
    seen = axes.join(viewpoints, ["cloud_id", "cam_id"], "left")
    away = dot([F.col("axis_min")[i] for i in range(3)], [F.col(c) - F.col(f"v{c}") for c in "xyz"]) > 0
    sign = F.when(away, -1).otherwise(1)
    normal = [(F.col("axis_min")[i] * sign).alias(f"n{c}") for i, c in enumerate("xyz")]
    return seen.select(*keep, *normal, *(["gap"] if with_gap else []))


def refine_normals(points: DataFrame, k: int, r: float, passes: int = 1, most: int = MOST) -> DataFrame:
    """cloud_id, point_id, nx, ny, nz after ``passes`` of smoothing: the mean normal of the k nearest points (itself
    included), of unit length; null where the normals cancel out. Clouds of at most ``most`` points are smoothed whole, in one exchange for all
    passes; in others neighbours are found once and each pass is cut."""
    (small,), large = parted("cloud_id", most, points)
    found = refine_whole(small, k, r, passes)
    return found if large is None else found.unionByName(_refine_by_joins(large[0], k, r, passes))


def _refine_by_joins(points: DataFrame, k: int, r: float, passes: int) -> DataFrame:
    left = points.select("cloud_id", F.col("point_id").alias("sample_id"), *[F.col(c).alias(f"s{c}") for c in "xyz"])
    near = knn_join(left, points.select("cloud_id", "point_id", "x", "y", "z"), k, r, most=0).select("cloud_id", "sample_id", "point_id")
    if passes > 1:
        near = cut_lineage(near)
    now = points.select("cloud_id", "point_id", "nx", "ny", "nz")
    for step in range(passes):
        mean = near.join(now, ["cloud_id", "point_id"]).groupBy("cloud_id", F.col("sample_id").alias("point_id")).agg(*[F.avg(c).alias(c) for c in ("nx", "ny", "nz")])
        size = F.sqrt(dot(("nx", "ny", "nz"), ("nx", "ny", "nz")))
        now = mean.withColumn("size_", size).select("cloud_id", "point_id", *[F.when(F.col("size_") > 0, F.col(c) / F.col("size_")).alias(c) for c in ("nx", "ny", "nz")])
        if step + 1 < passes:
            now = cut_lineage(now)
    return now


def frame_sums(samples: DataFrame, points: DataFrame, r: float) -> DataFrame:
    """Per sample the sums of normals and of their products over the points within ``r``; none without neighbours."""
    near = radius_join(samples, points, r)
    return near.groupBy("cloud_id", "sample_id").agg(F.count("*").alias("n"), *[F.sum(f"n{c}").alias(f"t{c}") for c in "xyz"], *[F.sum(F.col(f"n{p[0]}") * F.col(f"n{p[1]}")).alias(f"m{p}") for p in PAIRS])


def _frame(e: Column) -> Column:
    """From both axes of the scatter: curvature axis c, normal n and binormal b as one struct; null where an axis is."""
    a, n = ([e[axis][i] for i in range(3)] for axis in ("axis_min", "axis_max"))
    up = lambda v: F.when(F.greatest(*[F.struct(F.abs(x).alias("size"), F.lit(-i).alias("at"), x.alias("v")) for i, x in enumerate(v)])["v"] < 0, -1).otherwise(1)
    t = ("tx", "ty", "tz")
    side = dot(n, t)
    flip_n = F.when(F.abs(side) <= 1e-6 * F.sqrt(dot(t, t)), up(n)).when(side < 0, -1).otherwise(1)
    turned = F.struct(*[(v * up(a)).alias(f"c{i}") for i, v in enumerate(a)], *[(v * flip_n).alias(f"n{i}") for i, v in enumerate(n)])

    def with_side(f: Column) -> Column:
        c, m = ([f[f"{v}{i}"] for i in range(3)] for v in "cn")
        return F.struct(*[x.alias(f"{v}{i}") for v, xs in (("n", m), ("b", cross(c, m)), ("c", c)) for i, x in enumerate(xs)])

    trace = F.col("mxx") + F.col("myy") + F.col("mzz")
    gap = F.least(2 * e["l_max"] + e["l_min"] - trace, trace - e["l_max"] - 2 * e["l_min"]) / trace
    return F.when(e["axis_min"].isNotNull() & e["axis_max"].isNotNull(), F.struct(bind(turned, with_side).alias("f"), gap.alias("gap")))


def local_frames(samples: DataFrame, points: DataFrame, r: float, with_gap: bool = False) -> DataFrame:
    """cloud_id, sample_id, n0..n2 (normal), b0..b2 (binormal), c0..c2 (curvature axis).

    The curvature axis is that of the least eigenvalue of the normals' scatter, its largest component positive; the
    normal that of the greatest, turned to the side of the summed normals, or where they cancel, its largest component
    positive; the binormal is their cross product. ``with_gap`` adds ``gap``: the smaller distance of the middle eigenvalue
    from the others, as a share of their sum; where it is near 0 the axes are arbitrary.
    """
    s = frame_sums(samples, points, r).select("cloud_id", "sample_id", bind(eigen([f"m{p}" for p in PAIRS]), _frame).alias("f_"))
    return s.where("f_ is not null").select("cloud_id", "sample_id", "f_.f.*", *(["f_.gap"] if with_gap else []))


def plane_inliers(points: DataFrame, planes: DataFrame, dist: float) -> DataFrame:
    """Points with ``inlier``: within ``dist`` of their cloud's plane a x + b y + c z + d = 0 (unit normal)."""
    met = points.join(planes.select("cloud_id", *[F.col(c).alias(f"p{c}") for c in "abcd"]), "cloud_id", "left")
    away = F.abs(dot(("pa", "pb", "pc"), ("x", "y", "z")) + F.col("pd"))
    return met.withColumn("inlier", F.coalesce(away <= dist, F.lit(False))).drop("pa", "pb", "pc", "pd")


def fit_plane(points: DataFrame, dist: float, iterations: int = 50, seed: int = 42) -> DataFrame:
    """cloud_id, a, b, c, d of the dominant plane: the best of planes through three drawn points, refitted to its inliers.

    A try draws three of a cloud's points by a hash of seed, try and cloud; one that draws a point twice, or three in a line,
    gives no plane. All tries of a cloud are counted in one pass over its points, and the refit is taken about
    a point of the plane, so that large coordinates don't cancel. Points are numbered by one sort of all clouds.
    """
    numbered = numbered_within(points.select("cloud_id", "point_id", "x", "y", "z"), "cloud_id", "point_id").drop("point_id")
    sizes = points.groupBy("cloud_id").agg(F.count("*").alias("m"))
    draws = sizes.select("cloud_id", "m", F.explode(F.sequence(F.lit(1), F.lit(iterations))).alias("try")).select("*", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("k"))
    draws = draws.select("cloud_id", "try", "k", F.pmod(F.xxhash64(F.lit(seed), "try", "k", "cloud_id"), F.col("m")).alias("at"))
    three = draws.join(numbered, ["cloud_id", "at"]).groupBy("cloud_id", "try").agg(*[F.max(F.when(F.col("k") == k, F.col(c).cast("double"))).alias(f"{c}{k}") for k in (1, 2, 3) for c in "xyz"])
    normal = cross(*[[F.col(f"{c}{k}") - F.col(f"{c}1") for c in "xyz"] for k in (2, 3)])
    planes = three.withColumns({f"n{i}": v for i, v in enumerate(normal)}).withColumn("len", F.sqrt(dot(("n0", "n1", "n2"), ("n0", "n1", "n2")))).where("len > 0")
    planes = planes.select("cloud_id", "try", *[(F.col(f"n{i}") / F.col("len")).alias(c) for i, c in enumerate("abc")], "x1", "y1", "z1").withColumn("d", -dot(("a", "b", "c"), ("x1", "y1", "z1")))
    tried = planes.groupBy("cloud_id").agg(F.array_sort(F.collect_list(F.struct("try", "a", "b", "c", "d"))).alias("planes"))  # at most ``iterations``

    def near(i: int) -> Column:
        p = F.get("planes", F.lit(i))
        return F.sum((F.abs(dot((p["a"], p["b"], p["c"]), ("x", "y", "z")) + p["d"]) <= dist).cast("long")).alias(f"n{i}")

    count = points.join(tried, "cloud_id").groupBy("cloud_id").agg(F.first("planes").alias("planes"), *[near(i) for i in range(iterations)])
    every = F.array(*[F.struct(F.coalesce(f"n{i}", F.lit(-1)).alias("n"), F.get("planes", F.lit(i)).alias("p")) for i in range(iterations)])
    best = cut_lineage(count.select("cloud_id", F.array_max(every).alias("m")).select("cloud_id", "m.p.a", "m.p.b", "m.p.c", "m.p.d").where("a is not null"))  # one row per cloud
    foot = best.select("cloud_id", *[(-F.col("d") * F.col(v)).alias(f"o{c}") for v, c in zip("abc", "xyz", strict=True)])
    on = plane_inliers(points, best, dist).where("inlier").join(foot, "cloud_id").select("cloud_id", "ox", "oy", "oz", *[(F.col(c) - F.col(f"o{c}")).alias(c) for c in "xyz"])
    axes = axes_of(moments(on, ("cloud_id", "ox", "oy", "oz")))
    n = F.col("n").cast("double")
    fit = axes.select("cloud_id", *[F.col("axis_min")[i].alias(c) for i, c in enumerate("abc")], *[(F.col(f"s{c}") / n + F.col(f"o{c}")).alias(f"g{c}") for c in "xyz"]).where("a is not null")
    return cut_lineage(fit.select("cloud_id", "a", "b", "c", (-dot(("a", "b", "c"), ("gx", "gy", "gz"))).alias("d")))


def remove_plane(points: DataFrame, planes: DataFrame, dist: float) -> DataFrame:
    """The points off the plane; all points of a cloud in which nothing else is left."""
    marked = plane_inliers(points, planes, dist)
    flat = marked.groupBy("cloud_id").agg(F.min("inlier").alias("all_in"))
    return marked.join(flat, "cloud_id").where("not inlier or all_in").drop("inlier", "all_in")


def sample_above_plane(points: DataFrame, dist: float, iterations: int = 50, seed: int = 42) -> DataFrame:
    """Sample ids (cloud_id, point_id): the points off the dominant plane, or all if there are none."""
    return remove_plane(points, fit_plane(points, dist, iterations, seed), dist).select("cloud_id", "point_id")
