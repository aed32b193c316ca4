"""Spatial joins by grid cells: radius, nearest neighbours, nearest centres, outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vec import dot
from ..scratch import shared_dir
from .whole import MOST, knn_whole, outliers_whole, parted


def cut_lineage(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that driver and executors share."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


_BITS = 21
_CELL, _PART = "cell_", "part_"


def packed_cell(cell) -> Column:
    """Three cell numbers as one long, each modulo 2**21: what lies so many cells apart is told from neighbours by its distance."""
    x, y, z = (c.cast("long").bitwiseAND(F.lit((1 << _BITS) - 1)) for c in cell)
    return F.shiftleft(x, 2 * _BITS).bitwiseOR(F.shiftleft(y, _BITS)).bitwiseOR(z)


def _side(r: float) -> float:
    """Cells a little wider than ``r``, so that rounding of far coordinates can't put two neighbours two cells apart."""
    return r * (1 + 1e-6)


def _cell_of(xyz, r: float) -> list[Column]:
    return [F.floor(F.col(c) / _side(r)) for c in xyz]


def _around(rows: DataFrame, xyz, r: float, half: bool = False) -> DataFrame:
    """``rows``, once for each cell of side ``r`` that a ball of radius ``r`` about the point meets, with that cell.

    With ``half`` only the point's own cell and those after it in the order of their offsets, which are ``ahead_``.
    """
    side, own, inner = _side(r), ("n0_", "n1_", "n2_"), ("h0_", "h1_", "h2_")
    rows = rows.withColumns(dict(zip(own, _cell_of(xyz, r), strict=True)))
    rows = rows.withColumns({h: F.col(c) - F.col(n) * side for h, n, c in zip(inner, own, xyz, strict=True)})
    steps, found = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)], []
    for step in steps[13:] if half else steps:
        short = [F.col(h) if s < 0 else side - F.col(h) for h, s in zip(inner, step, strict=True) if s]
        away = sum((x * x for x in short[1:]), short[0] * short[0]) if short else F.lit(0)
        cell = F.struct(packed_cell([F.col(n) + s for n, s in zip(own, step, strict=True)]).alias("cell"), F.lit(any(step)).alias("ahead"))
        found.append(F.when(away <= r * r * (1 + 1e-5), cell))  # rounding may not lose a cell
    met = rows.withColumn("at_", F.explode(F.array(*found))).where("at_ is not null")
    return met.withColumns({_CELL: F.col("at_.cell"), "ahead_": F.col("at_.ahead")}).drop("at_", *own, *inner)


def _dealt(near: DataFrame, own: DataFrame, key: str, dense: int | None, by: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with the columns to meet on. Cells of over ``dense`` rows are divided by a hash of ``by``; near rows visit all parts."""
    on = [key, _CELL]
    if dense is None:
        return near, own, on
    full = own.groupBy(*on).agg(F.count("*").alias("n_")).where(F.col("n_") > dense).select(*on, F.ceil(F.col("n_") / dense).cast("int").alias("n_"))
    full = cut_lineage(full)  # at most one row for ``dense`` points
    if full.isEmpty():
        return near, own, on
    one = F.coalesce("n_", F.lit(1))
    own = own.join(full, on, "left").withColumn(_PART, F.pmod(F.xxhash64(by), one).cast("int")).drop("n_")
    near = near.join(full, on, "left").withColumn(_PART, F.explode(F.sequence(F.lit(0), one - 1))).drop("n_")
    return near, own, [*on, _PART]


def radius_join(left: DataFrame, right: DataFrame, r: float, key: str = "cloud_id", lxyz=("sx", "sy", "sz"), rxyz=("x", "y", "z"), dense: int | None = None, by: str = "point_id") -> DataFrame:
    """All pairs of one cloud within distance ``r`` (closed), with the squared distance ``d2``.

    The left side, which should be the smaller one, is copied to the cells of side ``r`` that its ball meets (27 at most);
    both sides meet on (cloud, cell), so that one dense cloud spreads over many tasks. With ``dense``, right cells of
    more rows are divided by a hash of ``by``; that counts the right side first. Column names but the key must differ.
    """
    near = _around(left, lxyz, r).drop("ahead_")
    near, own, on = _dealt(near, right.withColumn(_CELL, packed_cell(_cell_of(rxyz, r))), key, dense, by)
    gap = [F.col(b) - F.col(a) for a, b in zip(lxyz, rxyz, strict=True)]
    return near.join(own, on).withColumn("d2", dot(gap, gap)).where(F.col("d2") <= r * r).drop(_CELL, _PART)


def neighbour_pairs(points: DataFrame, r: float, key: str = "cloud_id", id_col: str = "point_id", xyz=("x", "y", "z"), dense: int | None = 20_000) -> DataFrame:
    """Every two points of a cloud within ``r``, once: key, a_id, ax, ay, az, b_id, bx, by, bz, d2.

    A point is copied to its own cell and the half of the cells around it that comes after; in its own cell, each two points meet
    in the order of id and place. Cells of over ``dense`` points are divided (see ``radius_join``). Points that repeat
    an id are points of their own, unless they are in one place.
    """
    side = lambda p: points.select(key, F.col(id_col).alias(f"{p}_id"), *[F.col(c).alias(f"{p}{n}") for n, c in zip("xyz", xyz, strict=True)])
    a, b = ("ax", "ay", "az"), ("bx", "by", "bz")
    near, own, on = _dealt(_around(side("a"), a, r, half=True), side("b").withColumn(_CELL, packed_cell(_cell_of(b, r))), key, dense, "b_id")
    gap = [F.col(n) - F.col(m) for m, n in zip(a, b, strict=True)]
    first = (F.col("a_id") < F.col("b_id")) | ((F.col("a_id") == F.col("b_id")) & (F.struct(*a) < F.struct(*b)))
    met = near.join(own, on).withColumn("d2", dot(gap, gap)).where((F.col("d2") <= r * r) & (F.col("ahead_") | first))
    return met.select(key, "a_id", *a, "b_id", *b, "d2")


def both_ways(pairs: DataFrame, key: str = "cloud_id") -> DataFrame:
    """Each pair as two rows: key, own_id, ox, oy, oz, other_id, x, y, z, d2."""
    names = ("own_id", "ox", "oy", "oz", "other_id", "x", "y", "z")
    a, b = ("a_id", "ax", "ay", "az"), ("b_id", "bx", "by", "bz")
    rows = F.array(*[F.struct(*[F.col(c).alias(n) for n, c in zip(names, order, strict=True)]) for order in ((*a, *b), (*b, *a))])
    return pairs.select(key, "d2", F.explode(rows).alias("p_")).select(key, "p_.*", "d2")


_DEEPEST, _LEAF_ROWS = 20, 64
_BOX = [f"{end}_{c}" for end in ("lo", "hi") for c in "xyz"]


def _shifted(cell: tuple[str, ...], by: int) -> list[Column]:
    return [F.shiftright(c, by).alias(c) for c in cell]


def nearest_rows(left: DataFrame, right: DataFrame, k: int, key: str = "cloud_id", id_col: str = "sample_id", right_id: str = "point_id", lxyz=("sx", "sy", "sz"), rxyz=("x", "y", "z")) -> DataFrame:
    """The k nearest right rows of every left row by descent through cells that are halved from level to level.

    A cloud's box is the one cell of the first level. On each level every left row keeps the cells that may hold one of its k nearest:
    those not farther than the distance within which other cells hold k rows for sure. Cells have the boxes and numbers of their rows, so that empty
    space and outliers cost nothing. Rows meet only in the last cells, which hold few rows, unless many lie in one place.
    All joins are on (cloud, cell). Returns key, id_col, the right columns, d2 and rank; ties go to the smaller id.
    """
    cell = ("i_", "j_", "k_")
    box = right.groupBy(key).agg(*[F.min(c).cast("double").alias(f"low{i}_") for i, c in enumerate(rxyz)], *[F.max(c).cast("double").alias(f"top{i}_") for i, c in enumerate(rxyz)], F.count("*").alias("n_"))
    wide = F.greatest(*[F.col(f"top{i}_") - F.col(f"low{i}_") for i in range(3)])
    box = cut_lineage(box.select(key, "n_", *[f"low{i}_" for i in range(3)], F.when(wide > 0, wide).otherwise(1.0).alias("wide_")))
    most = box.agg(F.max("n_")).first()[0] or 0
    place = [F.least(F.floor((F.col(c) - F.col(f"low{i}_")) / F.col("wide_") * float(1 << _DEEPEST)), F.lit((1 << _DEEPEST) - 1)).cast("int").alias(n) for i, (n, c) in enumerate(zip(cell, rxyz, strict=True))]
    rows = cut_lineage(right.join(box, key).select(*right.columns, *place))
    depth = 1
    while 8**depth * _LEAF_ROWS < 8 * most and depth < _DEEPEST:
        depth += 1
    ends = [f(F.col(c).cast("double")).alias(f"{n}_{x}") for n, f in (("lo", F.min), ("hi", F.max)) for x, c in zip("xyz", rxyz, strict=True)]
    while True:  # deeper while a cell is overfull, as dense parts of a cloud are
        at = [F.shiftright(c, _DEEPEST - depth).alias(c) for c in cell]
        leaves = cut_lineage(rows.groupBy(key, *at).agg(F.count("*").alias("m_"), *ends))
        if depth >= _DEEPEST - 1 or (leaves.agg(F.max("m_")).first()[0] or 0) <= 4 * _LEAF_ROWS:
            break
        depth += 2
    levels = [leaves]
    for _ in range(depth - 1):
        up = [F.sum("m_").alias("m_")] + [(F.min if b.startswith("lo") else F.max)(b).alias(b) for b in _BOX]
        levels.append(cut_lineage(levels[-1].groupBy(key, *_shifted(cell, 1)).agg(*up)))
    asked = left.select(key, id_col, *lxyz).distinct()
    own = Window.partitionBy(key, id_col, *lxyz)
    near = far = F.lit(0.0)  # squared distances to a cell's rows, at least and at most
    for n, c in zip(lxyz, "xyz", strict=True):
        short = F.greatest(F.lit(0.0), F.col(f"lo_{c}") - F.col(n), F.col(n) - F.col(f"hi_{c}"))
        long = F.greatest(F.abs(F.col(n) - F.col(f"lo_{c}")), F.abs(F.col(n) - F.col(f"hi_{c}")))
        near, far = near + short * short, far + long * long
    parents = [f"p{c}" for c in cell]
    front = asked.select("*", *[F.lit(0).alias(p) for p in parents])  # a cloud is one cell on the first level
    for level, cells in enumerate(reversed(levels), 1):
        met = front.join(cells.select("*", *[F.shiftright(c, 1).alias(p) for c, p in zip(cell, parents, strict=True)]), [key, *parents])
        told = met.select(key, id_col, *lxyz, *cell, "m_", near.alias("near_"), far.alias("far_"))
        sure = told.withColumn("sum_", F.sum("m_").over(own.orderBy("far_", *cell)))
        held = sure.withColumn("bound_", F.min(F.when(F.col("sum_") >= k, F.col("far_"))).over(own))
        kept = held.where(F.col("bound_").isNull() | (F.col("near_") <= F.col("bound_") * (1 + 1e-9)))
        front = kept.select(key, id_col, *lxyz, *[F.col(c).alias(p if level < depth else c) for c, p in zip(cell, parents, strict=True)])
        if level % 3 == 2:
            front = cut_lineage(front)
    leaf = rows.select(*right.columns, *[F.shiftright(c, _DEEPEST - depth).alias(c) for c in cell])
    gap = [F.col(b) - F.col(a) for a, b in zip(lxyz, rxyz, strict=True)]
    order = Window.partitionBy(key, id_col).orderBy("d2", right_id)
    ranked = front.join(leaf, [key, *cell]).withColumn("d2", dot(gap, gap)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(key, id_col, *[c for c in right.columns if c != key], "d2", "rank")


def knn_join(left: DataFrame, right: DataFrame, k: int, r: float, key: str = "cloud_id", id_col: str = "sample_id", right_id: str = "point_id", lxyz=("sx", "sy", "sz"), rxyz=("x", "y", "z"), rounds: int = 2, most: int = MOST) -> DataFrame:
    """The k nearest right rows of every left row with ``rank``, ties to the smaller id; fewer if the cloud has fewer.

    Clouds of at most ``most`` rows are met whole, in one exchange (``knn_whole``). In others ``rounds`` radius joins, the radius doubled each time,
    serve the rows that have k neighbours so near; the rest descend through cells (``nearest_rows``), so that no round meets a whole cloud.
    (key, id_col) tells left rows apart.
    """
    (left, right), large = parted(key, most, left, right)
    found = knn_whole(left, right, k, r, key, id_col, right_id, lxyz, rxyz)
    return found if large is None else found.unionByName(_knn_by_cells(*large, k, r, key, id_col, right_id, lxyz, rxyz, rounds))


def _knn_by_cells(left: DataFrame, right: DataFrame, k: int, r: float, key: str, id_col: str, right_id: str, lxyz, rxyz, rounds: int) -> DataFrame:
    todo, found, order = left, None, Window.partitionBy(key, id_col).orderBy("d2", right_id)
    for step in range(rounds):
        met = radius_join(todo, right, r * 2**step, key, lxyz, rxyz)
        ranked = cut_lineage(met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        full = ranked.where(F.col("rank") == k).select(key, id_col)
        part = ranked.join(full, [key, id_col], "left_semi")
        found = part if found is None else found.unionByName(part)
        todo = cut_lineage(todo.join(full, [key, id_col], "left_anti"))
        if todo.isEmpty():
            return found
    rest = nearest_rows(todo, right, k, key, id_col, right_id, lxyz, rxyz)
    rest = todo.join(rest, [key, id_col])
    return rest if found is None else found.unionByName(rest.select(*found.columns))


def nearest_centre(x: DataFrame, centres: DataFrame, key: str = "cloud_id", id_col: str = "point_id", most: int = MOST) -> DataFrame:
    """For each row of ``x`` the id of the nearest centre (centre_id, cx, cy, cz) of its cloud, ties to the smaller id."""
    names = (1, key, id_col, "centre_id", ("x", "y", "z"), ("cx", "cy", "cz"))
    (x, centres), large = parted(key, most, x.select(key, id_col, "x", "y", "z"), centres.select(key, "centre_id", "cx", "cy", "cz"))
    found = knn_whole(x, centres, 1, 0, *names[1:]).select(key, id_col, "centre_id", "d2")
    return found if large is None else found.unionByName(nearest_rows(*large, *names).select(key, id_col, "centre_id", "d2"))


def remove_statistical_outliers(points: DataFrame, k: int, mult: float, r: float, most: int = MOST) -> DataFrame:
    """Drop points whose mean distance to k neighbours is over the cloud's mean by more than ``mult`` deviations."""
    (small,), large = parted("cloud_id", most, points)
    mean = outliers_whole(small, k, r)
    if large is not None:
        mean = mean.unionByName(_mean_distances(large[0], k, r))
    mean = cut_lineage(mean)  # read for the clouds' statistics and for each point
    stats = mean.groupBy("cloud_id").agg(F.avg("mean_d").alias("mu"), F.stddev_samp("mean_d").alias("sigma"))
    far = mean.join(stats, "cloud_id").where(F.col("mean_d") > F.col("mu") + mult * F.col("sigma")).select("cloud_id", "point_id")
    return points.join(far, ["cloud_id", "point_id"], "left_anti")


def _mean_distances(points: DataFrame, k: int, r: float) -> DataFrame:
    left = points.select("cloud_id", F.col("point_id").alias("sample_id"), *[F.col(c).alias(f"s{c}") for c in "xyz"])
    near = _knn_by_cells(left, points.select("cloud_id", "point_id", "x", "y", "z"), k + 1, r, "cloud_id", "sample_id", "point_id", ("sx", "sy", "sz"), ("x", "y", "z"), 2)
    return near.where("point_id <> sample_id").groupBy("cloud_id", F.col("sample_id").alias("point_id")).agg(F.avg(F.sqrt("d2")).alias("mean_d"))


def neighbourhood_stats(neigh: DataFrame, keys=("cloud_id", "sample_id"), cameras=(0, 1)) -> DataFrame:
    """Centroid and the number of neighbours that each camera sees."""
    seen = [F.sum(F.array_contains("cams", c).cast("long")).alias(f"seen_{c}") for c in cameras]
    return neigh.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{c}") for c in "xyz"], *seen)
