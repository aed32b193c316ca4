"""Poses and images of clouds that fit a task: points and poses of a cloud meet in one exchange, and each pose is tested in arrays there.

The conditions are those of ``poses`` and ``raster``, which serve larger clouds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import Hand, Image
from .whole import by_cloud, id_groups, near_pairs, numbers

R = [f"r{i}{j}" for i in range(3) for j in range(3)]
AT = ["sx", "sy", "sz"]
_CELLS = 1_500_000


class Near:
    """The points around some poses, poses ascending: pose (number of its row), point (number of its row), fwd, lat, ver."""

    def __init__(self, pose: np.ndarray, point: np.ndarray, fwd: np.ndarray, lat: np.ndarray, ver: np.ndarray):
        self.row, self.p = np.unique(pose, return_inverse=True)  # poses that have points, and the place among them for each point
        self.point, self.fwd, self.lat, self.ver = point, fwd, lat, ver

    def any(self, mask: np.ndarray) -> np.ndarray:
        return np.bincount(self.p[mask], minlength=len(self.row)) > 0

    def least(self, values: np.ndarray, mask: np.ndarray | None = None, most: bool = False) -> np.ndarray:
        """The least value of each pose, or the greatest; infinite where there is none."""
        out = np.full(len(self.row), -np.inf if most else np.inf)
        p, v = (self.p, values) if mask is None else (self.p[mask], values[mask])
        if len(p):
            begins = np.concatenate([[0], 1 + np.flatnonzero(p[1:] != p[:-1])])
            out[p[begins]] = (np.maximum if most else np.minimum).reduceat(v, begins)
        return out

    def kept(self, mask: np.ndarray) -> Near:
        """Only these points, and the poses that have some of them."""
        return Near(self.row[self.p[mask]], self.point[mask], self.fwd[mask], self.lat[mask], self.ver[mask])


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[:, 0] * b[:, 0] + a[:, 1] * b[:, 1] + a[:, 2] * b[:, 2]


class Met:
    """Poses and points of some clouds."""

    def __init__(self, table: pa.Table, code: np.ndarray):
        side = table.column("pose_").to_numpy()
        a, b = np.flatnonzero(side), np.flatnonzero(~side)
        self.poses, self.points = table.take(a), table.take(b)
        self.code, self.own = code[a], code[b]
        self.at, self.turn, self.place = numbers(self.poses, *AT), numbers(self.poses, *R), numbers(self.points, "x", "y", "z")
        self.normal = numbers(self.points, "nx", "ny", "nz") if "nx" in table.column_names else None

    def column(self, j: int) -> np.ndarray:
        return self.turn[:, j::3]

    def near(self, reach: float, height: float) -> Iterator[Near]:
        """The neighbourhoods of all poses, whole poses at a time."""
        if not len(self.code) or not len(self.own):
            return
        for i, j, _ in near_pairs(self.code, self.at, self.own, self.place, reach):
            gap = self.place[j] - self.at[i]
            ver = _dot(self.column(2)[i], gap)
            kept = np.flatnonzero((ver > -height) & (ver < height))
            if len(kept):
                i, j, gap = i[kept], j[kept], gap[kept]
                yield Near(i, j, _dot(self.column(0)[i], gap), _dot(self.column(1)[i], gap), ver[kept])

    def turned_normal(self, near: Near, axis: int) -> np.ndarray:
        return _dot(self.column(axis)[near.row[near.p]], self.normal[near.point]).astype(np.float64)


def _together(poses: DataFrame, points: DataFrame) -> DataFrame:
    """Poses and points as one table; ``pose_`` tells them apart."""
    points = points.where(F.col("cloud_id").isNotNull()).select("cloud_id", *[c for c in ("point_id", "x", "y", "z", "nx", "ny", "nz") if c in points.columns])
    points = points.withColumnsRenamed({"point_id": "point_id_"})  # poses may have one
    return poses.withColumn("pose_", F.lit(True)).unionByName(points.withColumn("pose_", F.lit(False)), allowMissingColumns=True)


def _run(poses: DataFrame, points: DataFrame, added: str, body: Callable[[Met], Iterator[tuple[np.ndarray, dict[str, pa.Array]]]], columns: list[str] | None = None) -> DataFrame:
    """``poses``, or the asked columns of them, with what ``body`` adds: rows of poses and a column for each name."""
    columns = columns or poses.columns
    schema = ", ".join(f"`{c}` {poses.schema[c].dataType.simpleString()}" for c in columns) + ", " + added

    def run(table: pa.Table, code: np.ndarray) -> Iterator[pa.Table]:
        met = Met(table, code)
        if not len(met.code):
            return
        named = met.poses.select(columns)
        for rows, found in body(met):
            yield pa.Table.from_arrays([*named.take(rows).columns, *found.values()], names=[*columns, *found])

    return by_cloud(_together(poses, points), "cloud_id", schema, run)


def _placed(near: Near, hand: Hand, n: int) -> np.ndarray:
    """The middle one of the placements where both fingers fit, or -1, of each pose."""
    inside = np.flatnonzero(near.fwd < hand.bite)
    p, lat = near.p[inside], near.lat[inside]
    ok = (np.bincount(p, minlength=len(near.row)) > 0) & ~near.any((near.fwd < hand.bite) & (near.fwd < hand.bite - hand.depth))
    free = np.array([ok & (np.bincount(p[(lat > s) & (lat < s + hand.finger)], minlength=len(near.row)) == 0) for s in hand.slots(n)]).T
    hands = free[:, :n] & free[:, n:]
    m = hands.sum(1)
    chosen = hands & (np.cumsum(hands, 1) == np.maximum(1, (m + 1) // 2)[:, None])
    return np.where(m > 0, chosen.argmax(1), -1)


def _stop(near: Near, left: np.ndarray, right: np.ndarray, hand: Hand, step: float) -> np.ndarray:
    """The first step of the bite, from 1, that meets something, or the number of steps and 1."""
    lat = near.lat
    finger = ((lat > left[near.p]) & (lat < left[near.p] + hand.finger)) | ((lat > right[near.p]) & (lat < right[near.p] + hand.finger))
    first, blocked = near.least(near.fwd), near.least(near.fwd, finger)
    most = round((hand.depth - hand.bite) / step)
    stop = np.full(len(near.row), most + 1)
    for k in range(most, 0, -1):
        bite = hand.bite + k * step
        ok = (first < bite) & ~((blocked < bite) | (first < min(bite, bite - hand.depth)))
        stop = np.where(ok, stop, k)
    return stop


def _labels(near: Near, nl: np.ndarray, friction: float, viable: int, at_edge: float) -> tuple[np.ndarray, np.ndarray]:
    """(lateral extent, label 0 none, 1 half, 2 full) of each pose with these points between its fingers."""
    cone = math.cos(math.radians(friction))
    l0, l1 = near.least(near.lat), near.least(near.lat, most=True)
    on = [(-nl > cone) & (near.lat < l0[near.p] + at_edge), (nl > cone) & (near.lat > l1[near.p] - at_edge)]
    some = [near.any(o) for o in on]
    box = np.ones(len(near.p), bool)
    for v in (near.fwd, near.ver):
        lows, tops = ([near.least(v, o, most) for o in on] for most in (False, True))
        box &= (v >= np.maximum(*lows)[near.p]) & (v <= np.minimum(*tops)[near.p])
    counts = [np.bincount(near.p[o & box], minlength=len(near.row)) for o in on]
    full = some[0] & some[1] & (counts[0] >= viable) & (counts[1] >= viable)
    return l1 - l0, np.where(full, 2, np.where(some[0] | some[1], 1, 0))


def _between(near: Near, left, right, top, bottom, hand: Hand) -> np.ndarray:
    p = near.p
    return (near.fwd > bottom[p]) & (near.fwd < top[p]) & (near.lat > left[p] + hand.finger) & (near.lat < right[p])


def fitted_whole(poses: DataFrame, points: DataFrame, hand: Hand, n: int) -> DataFrame:
    """``poses`` where both fingers fit, with ``placement``."""

    def body(met: Met):
        for near in met.near(hand.reach(), hand.height):
            at = _placed(near, hand, n)
            fit = np.flatnonzero(at >= 0)
            yield near.row[fit], {"placement": pa.array(at[fit].astype(np.int32))}

    return _run(poses, points, "placement int", body)


def tested_whole(poses: DataFrame, points: DataFrame, hand: Hand, n: int, step: float | None, friction: float, viable: int, at_edge: float) -> DataFrame:
    """``poses`` that fit and have points between their fingers, with placement, stop (of the bite), n_closing, width, label."""
    slots = np.array(hand.slots(n), float)

    def body(met: Met):
        for near in met.near(hand.reach(), hand.height):
            at = _placed(near, hand, n)
            held = np.zeros(len(met.code), np.int64)
            held[near.row] = at
            near = near.kept((at >= 0)[near.p])
            at = held[near.row]
            left, right = slots[at], slots[at + n]
            stop = _stop(near, left, right, hand, step) if step else np.ones(len(near.row), np.int64)
            top = hand.bite + (stop - 1) * (step or 0)
            told = np.array([at, stop]).T
            of = np.zeros((len(met.code), 2), np.int64)
            of[near.row] = told
            near = near.kept(_between(near, left, right, top, top - hand.depth, hand))
            if not len(near.row):
                continue
            width, label = _labels(near, met.turned_normal(near, 1), friction, viable, at_edge)
            n_closing = np.bincount(near.p, minlength=len(near.row))
            yield near.row, {
                "placement": pa.array(of[near.row, 0].astype(np.int32)), "stop": pa.array(of[near.row, 1].astype(np.int32)),
                "n_closing": pa.array(n_closing.astype(np.int64)), "width": pa.array(width.astype(np.float64)), "label": pa.array(label.astype(np.int32)),
            }

    return _run(poses, points, "placement int, stop int, n_closing long, width double, label int", body)


def reevaluated_whole(poses: DataFrame, mesh: DataFrame, hand: Hand, friction: float, viable: int, at_edge: float, keys: list[str]) -> DataFrame:
    """The keys of all ``poses`` with their label against ``mesh``; rows have slot_l, slot_r, top, bottom."""

    def body(met: Met):
        label = np.zeros(len(met.code), np.int64)
        left, right, top, bottom = (numbers(met.poses, c)[:, 0].astype(np.float64) for c in ("slot_l", "slot_r", "top", "bottom"))
        for near in met.near(hand.reach(), hand.height):
            own = near.row[near.p]
            inside = near.fwd < top[own]
            finger = [(near.lat > s[own]) & (near.lat < s[own] + hand.finger) for s in (left, right)]
            fits = near.any(inside) & ~near.any(inside & ((near.fwd < bottom[own]) | finger[0] | finger[1]))
            rows = near.row
            closing = near.kept(fits[near.p] & _between(near, left[rows], right[rows], top[rows], bottom[rows], hand))
            if len(closing.row):
                label[closing.row] = _labels(closing, met.turned_normal(closing, 1), friction, viable, at_edge)[1]
        yield np.arange(len(met.code)), {"label": pa.array(label.astype(np.int32))}

    return _run(poses, mesh, "label int", body, keys)


_VIEWS = ((0, 1, 2), (2, 1, 0), (2, 0, 1))


def _view(p: np.ndarray, poses: int, u: list[np.ndarray], size: int, kinds: tuple[str, ...], normal: np.ndarray | None) -> np.ndarray:
    """The images of one view, poses x cells x fields, as 0 .. 255; points of a pose come in the order in which they blend."""
    cut = lambda w: np.minimum(np.floor(w * size), size - 1).astype(np.int64)
    key = (p * size + (size - 1 - cut(u[0]))) * size + cut(u[1])
    order = np.argsort(key, kind="stable") if normal is not None else np.lexsort((u[2], key))
    k = key[order]
    begins = np.concatenate([[0], 1 + np.flatnonzero(k[1:] != k[:-1])])
    cells, count = k[begins], np.diff(np.append(begins, len(k)))
    mean = np.bincount(np.repeat(np.arange(len(cells)), count), u[2][order], len(cells)) / count
    fields, groups = [], []
    for kind in kinds:
        if kind == "normals":
            v = normal[order[begins]].copy()
            t, left = 1, np.flatnonzero(count > 1)
            while len(left):
                now, new = v[left], normal[order[begins[left] + t]]
                size_ = np.sqrt(now[:, 0] * now[:, 0] + now[:, 1] * now[:, 1] + now[:, 2] * now[:, 2])[:, None]
                with np.errstate(all="ignore"):
                    v[left] = np.where(size_ == 0, new, now + (new - now) / size_)
                t += 1
                left = left[count[left] > t]
            fields += list(v.T)
            groups.append(slice(len(fields) - 3, len(fields)))
            continue
        if kind == "depth":
            fields.append(1 - mean)
        else:
            far = np.full(poses, -np.inf)
            np.maximum.at(far, cells // (size * size), mean)
            fields.append(far[cells // (size * size)] - mean)
        groups.append(slice(len(fields) - 1, len(fields)))
    a = np.full((poses * size * size, len(fields)), np.nan)
    a[cells] = np.array(fields).T
    a = a.reshape(poses, size, size, len(fields))
    for axis in (2, 1):  # 3 x 3 maxima as one pass along the rows and one along the columns
        b = a.copy()
        ahead, behind = [slice(None)] * 4, [slice(None)] * 4
        ahead[axis], behind[axis] = slice(1, None), slice(None, -1)
        ahead, behind = tuple(ahead), tuple(behind)
        b[behind] = np.fmax(b[behind], a[ahead])
        b[ahead] = np.fmax(b[ahead], a[behind])
        a = b
    a = np.where(np.isnan(a), 0.0, a).reshape(poses, size * size, len(fields))
    out = np.zeros(a.shape, np.int16)
    for g in groups:
        lo, hi = a[:, :, g].min((1, 2))[:, None, None], a[:, :, g].max((1, 2))[:, None, None]
        with np.errstate(all="ignore"):
            out[:, :, g] = np.where(hi > lo, np.rint(255 * (a[:, :, g] - lo) / (hi - lo)), 0)
    return out


def images_whole(poses: DataFrame, points: DataFrame, image: Image, three: bool, kinds: tuple[str, ...], hand: Hand, keys: list[str], pixels: bool = False) -> DataFrame:
    """``image`` of each pose (rows have bottom and centre) with points in the volume, or with ``pixels`` channel, row, col and value where it isn't 0."""
    blended, size = "normals" in kinds, image.size
    fields = sum(3 if k == "normals" else 1 for k in kinds)
    channels = fields * (3 if three else 1)

    def of(met: Met, near: Near, bottom: np.ndarray, centre: np.ndarray, ids: np.ndarray | None):
        own = near.row[near.p]
        f, side, v = near.fwd - bottom[own], near.lat - centre[own], near.ver
        near = near.kept((f > 0) & (f < image.depth) & (np.abs(side) < image.width / 2) & (np.abs(v) < image.height))
        if not len(near.row):
            return
        normal = None
        if blended:
            normal = np.abs(np.array([met.turned_normal(near, axis) for axis in range(3)]).T)
            tie = ids[near.point]
            order = np.lexsort((normal[:, 2], normal[:, 1], normal[:, 0], tie, near.p)) if len(np.unique(ids)) < len(ids) else np.lexsort((tie, near.p))
            near = Near(near.row[near.p[order]], near.point[order], near.fwd[order], near.lat[order], near.ver[order])
            normal = normal[order]
        own = near.row[near.p]
        u = [(near.fwd - bottom[own]) / image.depth, (near.lat - centre[own] + image.width / 2) / image.width, (near.ver + image.height) / (2 * image.height)]
        some = max(1, _CELLS // (size * size * channels))
        for a in range(0, len(near.row), some):
            b = min(len(near.row), a + some)
            i, j = np.searchsorted(near.p, [a, b])
            views = [_view(near.p[i:j] - a, b - a, [u[c][i:j] for c in order], size, kinds, normal[i:j] if blended else None) for order in (_VIEWS if three else _VIEWS[:1])]
            made, rows = np.concatenate(views, axis=2).reshape(b - a, -1), near.row[a:b]
            if pixels:
                pose, at = np.nonzero(made)
                cell, place = at // channels, at % channels
                told = {"channel": place, "row": cell // size, "col": cell % size}
                yield rows[pose], {n: pa.array(x.astype(np.int32)) for n, x in told.items()} | {"value": pa.array(made[pose, at])}
            else:
                ends = pa.array(np.arange(b - a + 1, dtype=np.int32) * made.shape[1])
                yield rows, {"image": pa.ListArray.from_arrays(ends, pa.array(made.ravel()))}

    def body(met: Met):
        bottom, centre = (numbers(met.poses, c)[:, 0].astype(np.float64) for c in ("bottom", "centre"))
        ids = id_groups(met.own, met.points.column("point_id_"))[2] if blended and len(met.own) else None
        for near in met.near(hand.reach(), hand.height):
            yield from of(met, near, bottom, centre, ids)

    return _run(poses, points, "channel int, row int, col int, value short" if pixels else "image array<short>", body, keys)
