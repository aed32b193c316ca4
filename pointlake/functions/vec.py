"""3-vectors, 3x3 and 4x4 matrices as flat lists of columns, in built-in expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def cols(names) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def dot(a, b) -> Column:
    a, b = cols(a), cols(b)
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a, b) -> list[Column]:
    a, b = cols(a), cols(b)
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def scale(a, k) -> list[Column]:
    return [x * k for x in cols(a)]


def mul3(a, b) -> list[Column]:
    """Product of two row-major 3x3 matrices."""
    return [sum((a[3 * i + k] * b[3 * k + j] for k in range(1, 3)), a[3 * i] * b[j]) for i in range(3) for j in range(3)]


def transpose3(a) -> list[Column]:
    return [a[3 * j + i] for i in range(3) for j in range(3)]


def axis_rotation(axis: int, angle: float) -> list[float]:
    """Rotation about unit axis x, y or z, row-major."""
    c, s = math.cos(angle), math.sin(angle)
    u, v = (axis + 1) % 3, (axis + 2) % 3
    out = [0.0] * 9
    out[4 * axis] = 1.0
    out[3 * u + u], out[3 * u + v], out[3 * v + u], out[3 * v + v] = c, -s, s, c
    return out


def mul4(a, b) -> list[Column]:
    """Product of two row-major 4x4 matrices."""
    return [a[4 * i] * b[j] + a[4 * i + 1] * b[4 + j] + a[4 * i + 2] * b[8 + j] + a[4 * i + 3] * b[12 + j] for i in range(4) for j in range(4)]


def inverse_rigid(a) -> list[Column]:
    """Inverse of a rotation with translation."""
    r = [a[0], a[4], a[8], a[1], a[5], a[9], a[2], a[6], a[10]]
    t = [-(r[3 * i] * a[3] + r[3 * i + 1] * a[7] + r[3 * i + 2] * a[11]) for i in range(3)]
    zero, one = F.lit(0), F.lit(1)
    return [r[0], r[1], r[2], t[0], r[3], r[4], r[5], t[1], r[6], r[7], r[8], t[2], zero, zero, zero, one]


def eigenvalues(m) -> list[Column]:
    """Greatest and least eigenvalue of a symmetric matrix given as xx, xy, xz, yy, yz, zz, in closed form."""
    xx, xy, xz, yy, yz, zz = [c.cast("double") for c in cols(m)]

    def spread(q: Column) -> Column:
        off = (xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q)
        return F.struct(q.alias("q"), F.sqrt((off + 2 * (xy * xy + xz * xz + yz * yz)) / 6).alias("p"))

    def turn(s: Column) -> Column:
        q, p = s["q"], s["p"]
        a, b, c = (xx - q) / p, (yy - q) / p, (zz - q) / p
        d, e, f = xy / p, xz / p, yz / p
        det = a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)
        known = p > 1e-12 * F.abs(q) + 1e-300
        return F.when(known, F.struct(q.alias("q"), p.alias("p"), (F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / 2))) / 3).alias("phi")))

    def ends(t: Column) -> Column:
        return F.struct((t["q"] + 2 * t["p"] * F.cos(t["phi"])).alias("most"), (t["q"] + 2 * t["p"] * F.cos(t["phi"] + 2 * math.pi / 3)).alias("least"))

    found = bind((xx + yy + zz) / 3, lambda q: bind(spread(q), lambda s: bind(turn(s), ends)))
    return [found["most"], found["least"]]


def eigenvector(m, value: Column) -> Column:
    """The unit eigenvector to ``value`` as an array: the longest cross product of two rows of the shifted matrix; null if none."""
    xx, xy, xz, yy, yz, zz = [c.cast("double") for c in cols(m)]
    rows = [[xx - value, xy, xz], [xy, yy - value, yz], [xz, yz, zz - value]]
    found = [cross(rows[i], rows[j]) for i, j in ((0, 1), (0, 2), (1, 2))]
    longest = F.greatest(*[F.struct(dot(v, v).alias("n"), *[x.alias(f"v{i}") for i, x in enumerate(v)]) for v in found])
    return F.transform(F.array(longest), lambda s: F.when(s["n"] > 0, F.array(*[s[f"v{i}"] / F.sqrt(s["n"]) for i in range(3)])))[0]


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it; plans don't expand it either."""
    return F.transform(F.array(value), f)[0]


def eigen(m, ends=("max", "min")) -> Column:
    """Of a symmetric matrix given as xx, xy, xz, yy, yz, zz: a struct of l_max, l_min and the axes axis_max and axis_min, or those asked for."""
    names = ("xx", "xy", "xz", "yy", "yz", "zz")
    whole = F.struct(*[c.cast("double").alias(n) for n, c in zip(names, cols(m), strict=True)])

    def axes(s: Column) -> Column:
        own = [s[n] for n in names]
        most, least = eigenvalues(own)

        def both(v: Column) -> Column:
            return F.struct(v["l_max"].alias("l_max"), v["l_min"].alias("l_min"), *[eigenvector(own, v[f"l_{e}"]).alias(f"axis_{e}") for e in ends])

        return bind(F.struct(most.alias("l_max"), least.alias("l_min")), both)

    return bind(whole, axes)
