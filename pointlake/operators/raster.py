"""Multi-channel images of pose neighbourhoods in long form, and occluded space."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import Hand, Image
from . import poses
from .whole import MOST, parted
from .whole_poses import images_whole

KEY = ("cloud_id", "sample_id", "orient")


def unit_image_points(neigh: DataFrame, image: Image) -> DataFrame:
    """Points strictly inside the image volume, scaled to u0, u1, u2 in 0 .. 1; rows have fwd, lat, ver, bottom, centre."""
    f, side, v = F.col("fwd") - F.col("bottom"), F.col("lat") - F.col("centre"), F.col("ver")
    kept = neigh.where((f > 0) & (f < image.depth) & (F.abs(side) < image.width / 2) & (F.abs(v) < image.height))
    return kept.withColumns({"u0": f / image.depth, "u1": (side + image.width / 2) / image.width, "u2": (v + image.height) / (2 * image.height)})


def cell_index(u: Column, size: int) -> Column:
    return F.least(F.floor(u * size), F.lit(size - 1)).cast("int")


def project3(points: DataFrame) -> DataFrame:
    """Three rows for each point: ``view`` 0 .. 2 with w0, w1, w2 as (x, y, z), (z, y, x) and (z, x, y)."""
    u = [F.col(f"u{i}") for i in range(3)]
    views = [F.struct(F.lit(k).alias("view"), *[u[j].alias(f"w{i}") for i, j in enumerate(p)]) for k, p in enumerate(((0, 1, 2), (2, 1, 0), (2, 0, 1)))]
    return points.withColumn("p_", F.explode(F.array(*views))).select("*", "p_.*").drop("p_")


def cells(points: DataFrame, size: int, u=("u0", "u1", "u2")) -> DataFrame:
    """Image row and column (row 0 on top) and the depth of each point."""
    return points.withColumns({"row": F.lit(size - 1) - cell_index(F.col(u[0]), size), "col": cell_index(F.col(u[1]), size), "deep": F.col(u[2])})


def binary_image(celled: DataFrame, keys=KEY) -> DataFrame:
    """Occupied cells as 255."""
    return celled.select(*keys, "row", "col").distinct().withColumn("value", F.lit(255.0))


def depth_image(celled: DataFrame, keys=KEY) -> DataFrame:
    """1 - mean depth of each occupied cell."""
    return celled.groupBy(*keys, "row", "col").agg((1 - F.avg("deep")).alias("value"))


def shadow_image(celled: DataFrame, keys=KEY) -> DataFrame:
    """The image's greatest mean depth less the cell's."""
    mean = celled.groupBy(*keys, "row", "col").agg(F.avg("deep").alias("m"))
    return mean.withColumn("value", F.max("m").over(Window.partitionBy(*keys)) - F.col("m")).drop("m")


def normals_image(celled: DataFrame, keys=KEY) -> DataFrame:
    """The running blend of absolute normals in the order of point ids: channels 0 .. 2 of every occupied cell."""
    rows = F.array_sort(F.collect_list(F.struct("point_id", *[F.abs(F.col(c).cast("double")).alias(c) for c in _FIELDS["normals"]])))
    out = celled.groupBy(*keys, "row", "col").agg(rows.alias("p")).withColumn("v", _blend_of(F.col("p")))
    return out.select(*keys, "row", "col", F.posexplode(F.array(*[F.col("v")[c] for c in _FIELDS["normals"]])).alias("part", "value"))


def dilate3(pixels: DataFrame, size: int, keys=KEY) -> DataFrame:
    """3 x 3 maximum; what lies outside the image doesn't count."""
    steps = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    out = pixels.withColumn("o_", F.explode(F.array(*steps))).withColumns({"row": F.col("row") + F.col("o_.i"), "col": F.col("col") + F.col("o_.j")})
    return out.where(F.col("row").between(0, size - 1) & F.col("col").between(0, size - 1)).groupBy(*keys, "row", "col").agg(F.max("value").alias("value"))


def minmax_u8(pixels: DataFrame, size: int, channels: int = 1, keys=KEY) -> DataFrame:
    """Values scaled to 0 .. 255 by the image's least and greatest; cells without a row are 0 and count; constant gives 0."""
    over = Window.partitionBy(*keys)
    missing = F.count("*").over(over) < size * size * channels
    lo = F.when(missing, F.least(F.min("value").over(over), F.lit(0.0))).otherwise(F.min("value").over(over))
    hi = F.when(missing, F.greatest(F.max("value").over(over), F.lit(0.0))).otherwise(F.max("value").over(over))
    out = pixels.withColumns({"lo_": lo, "hi_": hi})
    return out.withColumn("value", F.when(F.col("hi_") > F.col("lo_"), F.rint(255 * (F.col("value") - F.col("lo_")) / (F.col("hi_") - F.col("lo_")))).otherwise(0).cast("short")).drop("lo_", "hi_")


# channels: whether there are three views of the volume, and the images of each view in the order of their channels
STRATEGIES: dict[int, tuple[bool, tuple[str, ...]]] = {
    1: (False, ("depth",)),
    3: (False, ("normals",)),
    12: (True, ("normals", "depth")),
    15: (True, ("normals", "depth", "shadow")),
}
_FIELDS = {"normals": ("nf", "nl", "nv"), "depth": ("depth",), "shadow": ("shadow",)}


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _blend_of(rows: Column) -> Column:
    """The running blend of sorted (point_id, nf, nl, nv): nf, nl, nv."""
    start = F.struct(*[F.lit(0.0).alias(c) for c in _FIELDS["normals"]])

    def blend(v: Column, p: Column) -> Column:
        size = F.sqrt(v["nf"] * v["nf"] + v["nl"] * v["nl"] + v["nv"] * v["nv"])
        return F.struct(*[F.when(size == 0, p[c]).otherwise(v[c] + (p[c] - v[c]) / size).alias(c) for c in _FIELDS["normals"]])

    return F.aggregate(rows, start, blend)


def _dense(held: Column, size: int, fields: tuple[str, ...]) -> Column:
    """All cells of an image in order, from the sorted array of those that are occupied; nulls stand for the others."""
    none = F.struct(*[F.lit(None).cast("double").alias(c) for c in fields])
    values = lambda p: F.struct(*[p[c].alias(c) for c in fields])
    ends = F.concat(F.array(F.lit(-1)), held["cell"])
    runs = F.zip_with(held, ends, lambda p, before: F.when(p.isNotNull(), F.concat(F.array_repeat(none, p["cell"] - before - 1), F.array(values(p)))))
    last = F.lit(size * size - 1) - F.element_at(held["cell"], -1)
    return F.concat(F.flatten(F.filter(runs, lambda r: r.isNotNull())), F.array_repeat(none, last))


def _dilated(image: Column, size: int, fields: tuple[str, ...]) -> Column:
    """3 x 3 maxima of each field as one pass along the rows and one along the columns."""
    most = lambda *cells: F.struct(*[F.greatest(*[c[f] for c in cells]).alias(f) for f in fields])

    def along_row(a: Column) -> Column:
        return F.transform(a, lambda x, i: most(F.when(i % size > 0, F.get(a, i - 1)), x, F.when(i % size < size - 1, F.get(a, i + 1))))

    def along_column(a: Column) -> Column:
        return F.transform(a, lambda x, i: most(F.get(a, i - size), x, F.get(a, i + size)))

    return _with(image, lambda a: _with(along_row(a), along_column))


def _scaled(image: Column, kinds: tuple[str, ...]) -> Column:
    """The channels of each cell as 0 .. 255 by the least and greatest value of its kind of image; empty cells are 0 and count."""
    groups = [_FIELDS[k] for k in kinds]
    filled = F.transform(image, lambda x: F.struct(*[F.coalesce(x[c], F.lit(0.0)).alias(c) for g in groups for c in g]))

    def bounds(a: Column) -> Column:
        ends = []
        for k, group in enumerate(groups):
            for name, over, of in ((f"lo{k}", F.least, F.array_min), (f"hi{k}", F.greatest, F.array_max)):
                found = [of(a[c]) for c in group]
                ends.append((over(*found) if len(found) > 1 else found[0]).alias(name))
        return F.struct(*ends)

    def channel(x: Column, e: Column, c: str, k: int) -> Column:
        lo, hi = e[f"lo{k}"], e[f"hi{k}"]
        return F.when(hi > lo, F.rint(255 * (x[c] - lo) / (hi - lo))).otherwise(0).cast("short")

    def cells_of(a: Column, e: Column) -> Column:
        return F.transform(a, lambda x: F.array(*[channel(x, e, c, k) for k, g in enumerate(groups) for c in g]))

    return _with(filled, lambda a: _with(bounds(a), lambda e: cells_of(a, e)))


def packed_images(unit_points: DataFrame, size: int, channels: int, keys=KEY) -> DataFrame:
    """``image``: rows x columns x channels of each pose as one array of shorts, by the strategy of the number of channels.

    The points of a pose meet once, in one exchange on ``keys``: views, cells, images and their scaling are all made there. Only where
    means of depth are all that is asked for do cells form before that, as such means are made in part where the points are.
    A pose without points has no row. Values of points of one cell with the same ``point_id`` blend in the order of their normals.
    """
    keys = list(keys)
    three, kinds = STRATEGIES[channels]
    blended = "normals" in kinds
    wanted = [*keys, "u0", "u1", "u2", *(["point_id", *_FIELDS["normals"]] if blended else [])]
    points = unit_points.select(*wanted)
    if blended:
        points = points.repartition(*keys)
    celled = cells(project3(points), size, ("w0", "w1", "w2")) if three else cells(points.withColumn("view", F.lit(0)), size)
    celled = celled.withColumn("cell", F.col("row") * size + F.col("col"))
    if blended:
        row = F.struct("point_id", *[F.abs(F.col(c).cast("double")).alias(c) for c in _FIELDS["normals"]], "deep")
        occupied = celled.groupBy(*keys, "view", "cell").agg(F.array_sort(F.collect_list(row)).alias("rows"))
        total = F.aggregate(F.col("rows")["deep"], F.lit(0.0), lambda t, x: t + x)  # in one order, so that no partitioning changes a byte
        occupied = occupied.select(*keys, "view", "cell", (total / F.size("rows")).alias("mean"), _blend_of(F.col("rows")).alias("n"))
    else:
        occupied = celled.groupBy(*keys, "view", "cell").agg(F.avg("deep").alias("mean"))
    held = occupied.groupBy(*keys, "view").agg(F.array_sort(F.collect_list(F.struct("cell", "mean", *(["n"] if blended else [])))).alias("held"))

    fields = tuple(c for k in kinds for c in _FIELDS[k])
    of = {"depth": lambda p, far: 1 - p["mean"], "shadow": lambda p, far: far - p["mean"]} | {c: lambda p, far, c=c: p["n"][c] for c in _FIELDS["normals"]}

    def valued(a: Column) -> Column:
        named = lambda far: F.transform(a, lambda p: F.struct(p["cell"].alias("cell"), *[of[c](p, far).alias(c) for c in fields]))
        return _with(F.array_max(a["mean"]), named)

    one = _with(F.col("held"), lambda a: _with(valued(a), lambda v: _scaled(_dilated(_dense(v, size, fields), size, fields), kinds)))
    images = held.select(*keys, "view", one.alias("cells"))
    if not three:
        return images.select(*keys, F.flatten("cells").alias("image"))
    views = images.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("view", "cells")))["cells"].alias("v"))  # every point is in all views
    joined = _with(F.col("v"), lambda v: F.transform(v[0], lambda first, i: F.concat(first, F.get(v[1], i), F.get(v[2], i))))
    return views.select(*keys, F.flatten(joined).alias("image"))


def pose_images(cands: DataFrame, points: DataFrame, image: Image, channels: int, hand: Hand, keys=KEY, pixels: bool = False, most: int = MOST) -> DataFrame:
    """``image`` of each pose as ``packed_images`` gives it, or with ``pixels`` what ``unpack`` gives of it.

    cands: keys, sx..sz, r00..r22, bottom, centre. Clouds of at most ``most`` points and poses are met whole, in one exchange, and images are made where
    they meet; others by cells.
    """
    keys, (three, kinds) = list(keys), STRATEGIES[channels]
    (small, solid), large = parted("cloud_id", most, cands.select(*keys, "sx", "sy", "sz", *poses.R, "bottom", "centre"), points)
    out = images_whole(small, solid, image, three, kinds, hand, keys, pixels)
    if large is None:
        return out
    at = large[0].select("cloud_id", "sample_id", "sx", "sy", "sz").distinct()
    packed = packed_images(unit_image_points(poses.neighbourhoods(at, large[0], large[1], hand, keys), image), image.size, channels, keys)
    return out.unionByName(unpack(packed, image.size, channels, keys) if pixels else packed)


def unpack(images: DataFrame, size: int, channels: int, keys=KEY) -> DataFrame:
    """Pixels (keys, channel, row, col, value) of packed images that aren't 0."""
    at = F.col("at")
    pixels = images.select(*keys, F.posexplode("image").alias("at", "value")).where("value <> 0")
    place = (at / channels).cast("int")
    return pixels.select(*keys, (at % channels).alias("channel"), (place / size).cast("int").alias("row"), (place % size).alias("col"), "value")


def describe(unit_points: DataFrame, size: int, channels: int, keys=KEY) -> DataFrame:
    """Pixels (keys, channel, row, col, value) that aren't 0, by the strategy of the number of channels."""
    return unpack(packed_images(unit_points, size, channels, keys), size, channels, keys)


def pack(pixels: DataFrame, size: int, channels: int, keys=KEY) -> DataFrame:
    """``image``: all pixels of a pose as one array of rows x columns x channels.

    The pixels that aren't 0 are sorted by place and the gaps between them filled, so that a pose costs one pass.
    """
    at = ((F.col("row") * size + F.col("col")) * channels + F.col("channel")).cast("int")
    zero = F.lit(0).cast("short")
    held = pixels.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), F.col("value").cast("short").alias("value")))).alias("p"))
    ends = F.concat(F.array(F.lit(-1)), F.col("p")["at"])
    runs = F.zip_with("p", ends, lambda p, before: F.when(p.isNotNull(), F.concat(F.array_repeat(zero, p["at"] - before - 1), F.array(p["value"]))))
    last = F.lit(size * size * channels - 1) - F.element_at(F.col("p")["at"], -1)
    dense = F.concat(F.flatten(F.filter(runs, lambda r: r.isNotNull())), F.array_repeat(zero, last))
    return held.select(*keys, dense.alias("image"))


def shadow_voxels(neigh: DataFrame, viewpoints: DataFrame, length: float, cell: float, keys=("cloud_id", "sample_id"), draws: int | None = None) -> DataFrame:
    """Distinct voxels behind the points of each neighbourhood, for each camera that sees one of them.

    From every point, ``draws`` places at (k + 0.5) / draws of ``length`` go on along the ray from the camera to the centroid.
    """
    n = draws or max(1, int(length / cell))
    keys = list(keys)
    middle = neigh.groupBy(*keys).agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])
    seen = neigh.select(*keys, F.explode("cams").alias("cam_id")).distinct().join(viewpoints, ["cloud_id", "cam_id"]).join(middle, keys)
    ray = [F.col(f"m{c}") - F.col(f"v{c}") for c in "xyz"]
    size = F.sqrt(ray[0] * ray[0] + ray[1] * ray[1] + ray[2] * ray[2])
    seen = seen.select(*keys, "cam_id", *[(r / size).alias(f"d{c}") for c, r in zip("xyz", ray, strict=True)])
    cast = neigh.select(*keys, "x", "y", "z").join(seen, keys).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    far = (F.col("k") + 0.5) / n * length
    return cast.select(*keys, "cam_id", *[((F.col(c) + far * F.col(f"d{c}")) / cell).cast("long").alias(f"i{c}") for c in "xyz"]).distinct()


def shadow_intersection(voxels: DataFrame, keys=("cloud_id", "sample_id")) -> DataFrame:
    """Voxels that lie in the shadow for every camera of their neighbourhood."""
    keys = list(keys)
    cams = voxels.groupBy(*keys).agg(F.countDistinct("cam_id").alias("n_cams"))
    return voxels.groupBy(*keys, "ix", "iy", "iz").agg(F.countDistinct("cam_id").alias("n")).join(cams, keys).where("n = n_cams").drop("n", "n_cams")


def voxels_to_points(voxels: DataFrame, cell: float, jitter: float = 0.3, seed: int = 1) -> DataFrame:
    """Voxels as points; one seeded Gaussian value of jitter x cell is added to all three coordinates."""
    unit = lambda s: (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(s), *voxels.columns)), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
    noise = F.sqrt(-2 * F.ln(unit(f"{seed}a"))) * F.cos(6.283185307179586 * unit(f"{seed}b")) * (jitter * cell)
    return voxels.withColumn("g_", noise).withColumns({c: F.col(f"i{c}") * cell + F.col("g_") for c in "xyz"}).drop("g_")
