"""Clouds that fit a task, met whole: one exchange by cloud, and neighbours are found in arrays within the task.

A cloud of at most ``MOST`` rows costs one exchange of its rows and no copies. Larger ones go through joins on cells (``spatial``,
``poses``), where a cloud spreads over tasks. Rows arrive sorted by cloud and are taken some whole clouds at a time, so
that a task holds a few clouds, not its partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, LongType

from ..scratch import shared_dir

MOST = 50_000
_ROWS, _PAIRS = 50_000, 1_500_000


def oversized(key: str, most: int, *sides: DataFrame) -> DataFrame | None:
    """The keys of over ``most`` rows of all sides together; None if there are none."""
    rows = sides[0].select(key)
    for side in sides[1:]:
        rows = rows.unionByName(side.select(key))
    counts = rows.groupBy(key).agg(F.count("*").alias("n_"))
    if (counts.agg(F.max("n_")).first()[0] or 0) <= most:
        return None
    shared_dir(rows.sparkSession)
    return counts.where(F.col("n_") > most).select(key).checkpoint()


def parted(key: str, most: int, *sides: DataFrame) -> tuple[list[DataFrame], list[DataFrame] | None]:
    """The sides' rows of keys that fit a task, and those of the others, if there are any."""
    full = oversized(key, most, *sides)
    if full is None:
        return list(sides), None
    return [s.join(full, key, "left_anti") for s in sides], [s.join(full, key, "left_semi") for s in sides]


def whole(df: DataFrame, *columns: str) -> bool:
    """Whether all these columns hold whole numbers."""
    return all(isinstance(df.schema[c].dataType, IntegralType) for c in columns)


def _numbered(rows: DataFrame, *columns: str) -> DataFrame:
    """These columns as longs if they are whole, or else as doubles."""
    return rows.withColumns({c: F.col(c).cast("long" if isinstance(rows.schema[c].dataType, IntegralType) else "double") for c in columns})


def _starts(values: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Where runs of equal values begin."""
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    n = len(values)
    if n == 0:
        return np.zeros(0, np.int64)
    a, b = values.slice(1), values.slice(0, n - 1)
    same = pc.fill_null(pc.equal(a, b), False)
    same = pc.or_(same, pc.and_(pc.is_null(a), pc.is_null(b)))
    return np.concatenate([[0], 1 + np.flatnonzero(~same.to_numpy(zero_copy_only=False))]).astype(np.int64)


def by_cloud(rows: DataFrame, key: str, schema: str, body: Callable[[pa.Table, np.ndarray], Iterator[pa.Table]]) -> DataFrame:
    """``body(table, number of each row's cloud)`` of whole clouds, some at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            starts = _starts(table.column(key))
            code = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
            for out in body(table, code):
                yield from out.to_batches()

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= _ROWS:
                table = pa.Table.from_batches(held)
                last = int(_starts(table.column(key))[-1])
                if last:
                    yield from done(table.slice(0, last).combine_chunks())
                    held = table.slice(last).combine_chunks().to_batches()
        if held:
            yield from done(pa.Table.from_batches(held).combine_chunks())

    # by a hash of the key: an exchange by the key itself is left out above joins by it, whose partitions may then be read otherwise
    return rows.repartition(F.xxhash64(key)).sortWithinPartitions(key).mapInArrow(run, schema)


def numbers(table: pa.Table, *names: str) -> np.ndarray:
    """Columns as one array of rows: whole numbers if all are, without nulls, or else doubles, NaN for null."""
    columns = [table.column(n) for n in names]
    if all(pa.types.is_integer(c.type) and c.null_count == 0 for c in columns):
        return np.array([c.to_numpy() for c in columns], np.int64).T.reshape(-1, len(names))
    return np.array([c.cast(pa.float64()).to_numpy() for c in columns], np.float64).T.reshape(-1, len(names))


def near_pairs(code: np.ndarray, at: np.ndarray, own: np.ndarray, place: np.ndarray, r: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All (i, j, d2) of left rows (cloud ``code``, place ``at``) and right rows (``own``, ``place``) of one cloud within ``r``, i ascending.

    Right rows are sorted by cell of side ``r``; each left row meets the rows of the 27 cells around it. All pairs of a left row come
    in one part; parts hold about ``_PAIRS`` candidates. Places that aren't finite are near nothing.
    """
    left, right = np.flatnonzero(np.isfinite(at).all(1)), np.flatnonzero(np.isfinite(place).all(1))
    if not len(left) or not len(right):
        return
    low, side = np.minimum(at[left].min(0), place[right].min(0)), r * (1 + 1e-6)
    bits = (62 - int(max(code.max(), own.max())).bit_length()) // 3
    mask = (1 << bits) - 1
    cell = lambda p: np.clip(np.floor((p - low) / side), 0, float(1 << 60)).astype(np.int64) + 1
    # cell numbers are kept modulo 2**bits: what lies so far apart is told from neighbours by its distance
    pack = lambda c, x, y, z: (((c << bits | x & mask) << bits | y & mask) << bits) | z & mask
    n = cell(place[right])
    keys = pack(own[right], *n.T)
    order = np.argsort(keys, kind="stable")
    keys, right = keys[order], right[order]
    there = place[right]
    m, c = cell(at[left]), code[left]
    narrow = max(m[:, 2].max(), n[:, 2].max()) + 1 < mask  # runs of three cells don't wrap
    around = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
    ends = [(dx, dy, -1, 1) for dx, dy in around] if narrow else [(dx, dy, dz, dz) for dx, dy in around for dz in (-1, 0, 1)]
    # left rows of one cell meet the same rows
    cells, which = np.unique(pack(c, *m.T), return_inverse=True)
    first = np.zeros(len(cells), np.int64)
    first[which] = np.arange(len(which))
    c, m = c[first], m[first]
    lo = np.array([np.searchsorted(keys, pack(c, m[:, 0] + dx, m[:, 1] + dy, m[:, 2] + a), "left") for dx, dy, a, _ in ends]).T
    hi = np.array([np.searchsorted(keys, pack(c, m[:, 0] + dx, m[:, 1] + dy, m[:, 2] + b), "right") for dx, dy, _, b in ends]).T
    count = hi - lo
    total = np.cumsum(count.sum(1)[which])
    begin = 0
    while begin < len(left):
        past = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, past + _PAIRS, "right")))
        rows = which[begin:end]
        some, base = count[rows].ravel(), lo[rows].ravel()
        j = np.arange(some.sum()) + np.repeat(base - np.cumsum(some) + some, some)
        i = np.repeat(np.arange(begin, end), count[rows].sum(1))
        gap = there[j] - at[left[i]]
        d2 = np.einsum("ij,ij->i", gap, gap)
        near = np.flatnonzero(d2 <= r * r)
        yield left[i[near]], right[j[near]], d2[near]
        begin = end


def _spacing(own: np.ndarray, place: np.ndarray) -> float:
    """About how far the rows of a cloud lie apart (rows sorted by cloud); a first radius, which decides nothing but time."""
    begins = np.concatenate([[0], 1 + np.flatnonzero(own[1:] != own[:-1])])
    wide = (np.maximum.reduceat(place, begins) - np.minimum.reduceat(place, begins)).max(1).astype(float)
    wide /= np.cbrt(np.diff(np.append(begins, len(own))))
    return float(np.median(wide[wide > 0])) if (wide > 0).any() else 1.0


def nearest(code: np.ndarray, at: np.ndarray, group: np.ndarray, own: np.ndarray, place: np.ndarray, ids: np.ndarray, k: int, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, d2, rank) of the k nearest right rows of every ``group`` of left rows, ties to the smaller of ``ids``, sorted by group and rank.

    Radii grow until k rows, or all rows of the cloud, lie within: a row costs what is around it.
    """
    finite = np.isfinite(place).all(1)
    sizes = np.bincount(own[finite], minlength=int(max(code.max(initial=0), own.max(initial=0))) + 1)
    todo = np.flatnonzero(np.isfinite(at).all(1))
    if r <= 0 and finite.any():
        r = _spacing(own[finite], place[finite])
    parts = []
    while len(todo):
        met = [(todo[i], j, d2) for i, j, d2 in near_pairs(code[todo], at[todo], own, place, r)]
        open_ = np.zeros(group.max() + 1, np.int64)
        np.add.at(open_, group[todo], sizes[code[todo]])  # as many pairs as there can be
        wanted = np.minimum(open_, k)
        if met:
            i, j, d2 = (np.concatenate(x) for x in zip(*met, strict=True))
            g = group[i]
            found = np.bincount(g, minlength=len(wanted))
            kept = np.flatnonzero((found >= wanted)[g])
            i, j, d2, g = i[kept], j[kept], d2[kept], g[kept]
            order = np.lexsort((ids[j], d2, g))
            g = g[order]
            begins = np.concatenate([[0], 1 + np.flatnonzero(g[1:] != g[:-1])]) if len(g) else np.zeros(0, np.int64)
            rank = np.arange(len(g)) - np.repeat(begins, np.diff(np.append(begins, len(g))))
            best = rank < k
            parts.append((i[order][best], j[order][best], d2[order][best], rank[best] + 1))
        else:
            found = np.zeros_like(wanted)
        todo = todo[(found < wanted)[group[todo]]]
        r *= 1.5
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    i, j, d2, rank = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((rank, group[i]))
    return i[order], j[order], d2[order], rank[order]


def id_groups(code: np.ndarray, ids: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group of each row by cloud and id, groups by cloud then by order of id; the first row of each group; order of each row's id)."""
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    if pa.types.is_integer(ids.type) and ids.null_count == 0:
        order = ids.to_numpy().astype(np.int64)
    else:
        order = pc.rank(ids, "ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
    by = np.lexsort((order, code))
    new = np.concatenate([[True], (code[by][1:] != code[by][:-1]) | (order[by][1:] != order[by][:-1])]) if len(by) else np.zeros(0, bool)
    group = np.empty(len(by), np.int64)
    group[by] = np.cumsum(new) - 1
    return group, by[new], order


def drawn_whole(ids: DataFrame, n: int, seed: int, key: str, id_col: str) -> DataFrame:
    """n draws with replacement of the rows of each key that fits a task, by their place in the order of ids: key, draw, the other columns."""
    names = [key, *[c for c in ids.columns if c != key]]
    types = {f.name: f.dataType.simpleString() for f in ids.schema}
    draws = np.arange(1, n + 1, dtype=np.int64)

    def body(table: pa.Table, code: np.ndarray) -> Iterator[pa.Table]:
        _, _, order = id_groups(code, table.column(id_col))
        by = np.lexsort((order, code))
        size = np.bincount(code)
        begins = np.cumsum(size) - size
        rows = by[(begins[:, None] + (draws[None, :] * 2654435761 + seed) % size[:, None]).ravel()]
        yield table.select(names).take(rows).add_column(1, "draw", pa.array(np.tile(draws, len(size)).astype(np.int32)))

    return by_cloud(ids.where(F.col(key).isNotNull()), key, ", ".join(["`" + key + "` " + types[key], "draw int", *[f"`{c}` {types[c]}" for c in names[1:]]]), body)


def knn_whole(left: DataFrame, right: DataFrame, k: int, r: float, key: str, id_col: str, right_id: str, lxyz, rxyz) -> DataFrame:
    """The k nearest right rows of every left row of clouds that fit a task: left columns, right columns, d2, rank."""
    left, right = _numbered(left, *lxyz), _numbered(right, *rxyz)
    kind = "long" if whole(left, *lxyz) and whole(right, *rxyz) else "double"
    mine, theirs = left.columns, [c for c in right.columns if c != key]
    tag = {c: f"r_{n}" for n, c in enumerate(theirs)}  # both sides may have columns of one name
    rows = left.withColumn("left_", F.lit(True)).unionByName(right.withColumnsRenamed(tag).withColumn("left_", F.lit(False)), allowMissingColumns=True).where(F.col(key).isNotNull())
    types = {f.name: f.dataType.simpleString() for f in left.schema} | {tag[f.name]: f.dataType.simpleString() for f in right.schema if f.name != key}
    schema = ", ".join(f"`{n}` {t}" for n, t in types.items()) + f", d2 {kind}, rank int"

    def body(table: pa.Table, code: np.ndarray) -> Iterator[pa.Table]:
        side = table.column("left_").to_numpy()
        a, b = np.flatnonzero(side), np.flatnonzero(~side)
        if not len(a) or not len(b):
            return
        one, two = table.select(mine).take(a), table.select(list(tag.values())).take(b)
        group, _, _ = id_groups(code[a], one.column(id_col))
        _, _, order = id_groups(code[b], two.column(tag[right_id]))
        i, j, d2, rank = nearest(code[a], numbers(one, *lxyz), group, code[b], numbers(two, *[tag[c] for c in rxyz]), order, k, r)
        both = [*one.take(i).columns, *two.take(j).columns, pa.array(d2.astype(np.int64 if kind == "long" else np.float64)), pa.array(rank.astype(np.int32))]
        yield pa.Table.from_arrays(both, names=[*mine, *tag.values(), "d2", "rank"])

    out = by_cloud(rows, key, schema, body)
    back = {v: c for c, v in tag.items()}
    return out.withColumnsRenamed(back) if not set(theirs) & set(mine) else out.select(*[F.col(c).alias(back.get(c, c)) for c in out.columns])


def outliers_whole(points: DataFrame, k: int, r: float) -> DataFrame:
    """cloud_id, point_id and mean_d, the mean distance to the k nearest other points, of clouds that fit a task."""
    rows = _numbered(points.select("cloud_id", "point_id", "x", "y", "z").where("cloud_id is not null"), "x", "y", "z")
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}

    def body(table: pa.Table, code: np.ndarray) -> Iterator[pa.Table]:
        group, first, order = id_groups(code, table.column("point_id"))
        xyz = numbers(table, "x", "y", "z")
        i, j, d2, _ = nearest(code, xyz, group, code, xyz, order, k + 1, r)
        other = group[i] != group[j]
        g, far = group[i[other]], np.sqrt(d2[other])
        n = np.bincount(g, minlength=len(first))
        mean = np.bincount(g, far, len(first)) / np.maximum(n, 1)
        told = np.flatnonzero(n)
        yield table.select(["cloud_id", "point_id"]).take(first[told]).append_column("mean_d", pa.array(mean[told]))

    return by_cloud(rows, "cloud_id", f"cloud_id {kind['cloud_id']}, point_id {kind['point_id']}, mean_d double", body)


def refine_whole(points: DataFrame, k: int, r: float, passes: int) -> DataFrame:
    """cloud_id, point_id, nx, ny, nz after all passes of smoothing, of clouds that fit a task."""
    rows = points.select("cloud_id", "point_id", "x", "y", "z", *[F.col(c).cast("double").alias(c) for c in ("nx", "ny", "nz")]).where("cloud_id is not null")
    rows = _numbered(rows, "x", "y", "z")
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}

    def body(table: pa.Table, code: np.ndarray) -> Iterator[pa.Table]:
        group, first, order = id_groups(code, table.column("point_id"))
        xyz = numbers(table, "x", "y", "z")
        i, j, _, _ = nearest(code, xyz, group, code, xyz, order, k, r)
        g = group[i]
        normal = numbers(table, "nx", "ny", "nz")  # of rows; after a pass, of groups
        told = np.array([pc.is_valid(table.column(c)).to_numpy() for c in ("nx", "ny", "nz")]).T
        for step in range(passes):
            of = j if step == 0 else group[j]
            n = np.array([np.bincount(g, told[of, c], len(first)) for c in range(3)]).T
            total = np.array([np.bincount(g, np.where(told[of, c], normal[of, c], 0.0), len(first)) for c in range(3)]).T
            with np.errstate(all="ignore"):
                mean = total / n
                size = np.sqrt(mean[:, 0] * mean[:, 0] + mean[:, 1] * mean[:, 1] + mean[:, 2] * mean[:, 2])
                normal = mean / size[:, None]
            some = (n > 0).all(1) & ((size > 0) | np.isnan(size))
            told = np.repeat(some[:, None], 3, 1)
        known = np.unique(g)
        out = table.select(["cloud_id", "point_id"]).take(first[known])
        for c, name in enumerate(("nx", "ny", "nz")):
            out = out.append_column(name, pa.array(normal[known, c], mask=~told[known, c]))
        yield out

    return by_cloud(rows, "cloud_id", f"cloud_id {kind['cloud_id']}, point_id {kind['point_id']}, nx double, ny double, nz double", body)


_PRODUCTS = ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))
SUMS = [f"s{c}" for c in "xyz"] + [f"s{'xyz'[a]}{'xyz'[b]}" for a, b in _PRODUCTS]


def _group_moments(table: pa.Table, code: np.ndarray, r: float, about: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group of each row, its first row, number of neighbours and sums of each group); with ``about`` sums are about the point itself."""
    group, first, _ = id_groups(code, table.column("point_id"))
    xyz = numbers(table, "x", "y", "z")
    if xyz.dtype == np.int64 and len(xyz):
        reach = (min(float(np.ceil(r)), 4e18) if about else float(max(np.abs(xyz.max(initial=0)), np.abs(xyz.min(initial=0)))))
        if reach * reach * len(xyz) > 9e18:
            xyz = xyz.astype(np.float64)
    n, sums = np.zeros(len(first), np.int64), np.zeros((len(first), 9), xyz.dtype)
    for i, j, d2 in near_pairs(code, xyz, code, xyz, r):
        other = np.flatnonzero((i != j) & ((d2 > 0) | (group[i] != group[j])))
        i, j = i[other], j[other]
        if not len(i):
            continue
        begins = np.concatenate([[0], 1 + np.flatnonzero(i[1:] != i[:-1])])
        p = xyz[j] - xyz[i] if about else xyz[j]
        own = group[i[begins]]
        np.add.at(n, own, np.diff(np.append(begins, len(i))))
        x = [np.ascontiguousarray(p[:, c]) for c in range(3)]
        for at, values in enumerate([*x, *(x[a] * x[b] for a, b in _PRODUCTS)]):
            np.add.at(sums[:, at], own, np.add.reduceat(values, begins))
    return group, first, n, sums


def _least_axes(n: np.ndarray, sums: np.ndarray) -> dict[str, np.ndarray]:
    """trace, l_max, l_min and the unit axis of l_min from moments, as ``covariance`` and ``vec.eigen`` have them; NaN where undefined."""
    m, s = n.astype(np.float64), sums.astype(np.float64)
    with np.errstate(all="ignore"):
        xx, xy, xz, yy, yz, zz = (s[:, 3 + k] / m - (s[:, a] / m) * (s[:, b] / m) for k, (a, b) in enumerate(_PRODUCTS))
        q = (xx + yy + zz) / 3
        off = (xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q)
        p = np.sqrt((off + 2 * (xy * xy + xz * xz + yz * yz)) / 6)
        a, b, c, d, e, f = (xx - q) / p, (yy - q) / p, (zz - q) / p, xy / p, xz / p, yz / p
        det = a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)
        phi = np.where(p > 1e-12 * np.abs(q) + 1e-300, np.arccos(np.clip(det / 2, -1.0, 1.0)) / 3, np.nan)
        most, least = q + 2 * p * np.cos(phi), q + 2 * p * np.cos(phi + 2 * np.pi / 3)
        rows = [np.array([xx - least, xy, xz]), np.array([xy, yy - least, yz]), np.array([xz, yz, zz - least])]
        best = None
        for i, j in ((0, 1), (0, 2), (1, 2)):
            u, v = rows[i], rows[j]
            x = np.array([u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]])
            x = np.concatenate([[x[0] * x[0] + x[1] * x[1] + x[2] * x[2]], x])
            if best is None:
                best = x
                continue
            more, same = x[0] > best[0], x[0] == best[0]  # of equal length the greater in the order of its components
            for k in (1, 2, 3):
                more, same = more | (same & (x[k] > best[k])), same & (x[k] == best[k])
            best = np.where(more, x, best)
        axis = np.where(best[0] > 0, best[1:] / np.sqrt(best[0]), np.nan)
    return {"trace": xx + yy + zz, "l_max": most, "l_min": least} | {f"a{k}": axis[k] for k in range(3)}


AXES = ("trace", "l_max", "l_min", "a0", "a1", "a2")


def moments_whole(points: DataFrame, r: float, axes: bool = False) -> DataFrame:
    """``points`` with n (itself included) and the sums about itself of each one's neighbours, of clouds that fit a task.

    With ``axes``, n, trace, l_max, l_min and the axis of l_min (a0, a1, a2) instead of the sums, null where undefined.
    """
    rows = _numbered(points, "x", "y", "z")
    kind = "long" if whole(rows, "x", "y", "z") else "double"
    names = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", n long, " + ", ".join([f"{s} double" for s in AXES] if axes else [f"{s} {kind}" for s in SUMS])

    def body(table: pa.Table, code: np.ndarray) -> Iterator[pa.Table]:
        group, _, n, sums = _group_moments(table, code, r, True)
        if axes:
            told = [pa.array(v[group], from_pandas=True) for v in _least_axes(n + 1, sums).values()]
            yield pa.Table.from_arrays([*table.columns, pa.array(n[group] + 1), *told], names=[*names, "n", *AXES])
            return
        sums = sums.astype(np.int64 if kind == "long" else np.float64)
        yield pa.Table.from_arrays([*table.columns, pa.array(n[group] + 1), *(pa.array(np.ascontiguousarray(sums[group, c])) for c in range(9))], names=[*names, "n", *SUMS])

    out = by_cloud(rows, "cloud_id", schema, body)
    return out.select(*[F.col(c).cast(points.schema[c].dataType).alias(c) if c in "xyz" and not isinstance(points.schema[c].dataType, LongType) else F.col(c) for c in out.columns])


def place_moments_whole(points: DataFrame, r: float) -> DataFrame:
    """cloud_id, point_id, n and the sums of the coordinates of each point's neighbours and its own, of clouds that fit a task."""
    rows = _numbered(points.select("cloud_id", "point_id", "x", "y", "z"), "x", "y", "z")
    kind = "long" if whole(rows, "x", "y", "z") else "double"
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def body(table: pa.Table, code: np.ndarray) -> Iterator[pa.Table]:
        group, first, n, sums = _group_moments(table, code, r, False)
        xyz = numbers(table, "x", "y", "z").astype(sums.dtype)
        np.add.at(n, group, 1)
        for at, values in enumerate([*xyz.T, *(xyz[:, a] * xyz[:, b] for a, b in _PRODUCTS)]):
            np.add.at(sums[:, at], group, values)
        sums = sums.astype(np.int64 if kind == "long" else np.float64)
        ids = table.select(["cloud_id", "point_id"]).take(first)
        yield pa.Table.from_arrays([*ids.columns, pa.array(n), *(pa.array(np.ascontiguousarray(sums[:, c])) for c in range(9))], names=["cloud_id", "point_id", "n", *SUMS])

    return by_cloud(rows, "cloud_id", f"cloud_id {types['cloud_id']}, point_id {types['point_id']}, n long, " + ", ".join(f"{s} {kind}" for s in SUMS), body)
