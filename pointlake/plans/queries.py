"""The registered queries on the reference operators, each with the same question in SQL where SQL can ask it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from ..operators import align, clean, dataset, normals, poses, ranking, raster, scoring, spatial
from ..params import Box
from ..sources import io
from . import pipelines
from .fixtures import BOX, HAND, IMAGE, PLACEMENTS, VIEWS, fixture, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
P = PLACEMENTS
SIZE = IMAGE.size
R_FRAME, R_NORMAL, K = 10_000, 15_000, 5


def _slot_sql() -> list[str]:
    return [str(int(s)) for s in HAND.slots(P)]


def _pick(column: str) -> str:
    return "CASE placement " + " ".join(f"WHEN {i} THEN {_slot_sql()[i + (P if column == 'r' else 0)]}" for i in range(P)) + " END"


def _deep_sql() -> str:
    steps = range(round((HAND.depth - HAND.bite) / 5000) + 1)
    blocked = "(lat > slot_l AND lat < slot_l + 10000) OR (lat > slot_r AND lat < slot_r + 10000)"
    ok = ", ".join(f"bool_or(fwd < {10000 + 5000 * k}) AND NOT bool_or(fwd < {10000 + 5000 * k} AND (fwd < {5000 * k - 50000} OR {blocked})) AS ok{k}" for k in steps)
    first = " ".join(f"WHEN NOT ok{k} THEN {k}" for k in steps if k)
    return f"SELECT cloud_id, sample_id, orient, 10000 + (CASE {first} ELSE {len(steps)} END - 1) * 5000 AS top FROM (SELECT cloud_id, sample_id, orient, {ok} FROM s_held GROUP BY ALL) q"


_KEYS = "cloud_id, sample_id, orient"
_RUN = ", ".join(f"CASE WHEN h{i} THEN 1 ELSE 0 END AS g{i}" for i in range(P))
STEPS = VIEWS | {
    "s_neigh": """SELECT * FROM (SELECT p.cloud_id, p.sample_id, p.orient, q.point_id, r00 * (x - sx) + r10 * (y - sy) + r20 * (z - sz) AS fwd, r01 * (x - sx) + r11 * (y - sy) + r21 * (z - sz) AS lat,
        r02 * (x - sx) + r12 * (y - sy) + r22 * (z - sz) AS ver, r00 * nx + r10 * ny + r20 * nz AS nf, r01 * nx + r11 * ny + r21 * nz AS nl, r02 * nx + r12 * ny + r22 * nz AS nv
        FROM fx_poses p JOIN fx_obj q ON p.cloud_id = q.cloud_id WHERE (x - sx) * (x - sx) + (y - sy) * (y - sy) + (z - sz) * (z - sz) <= 12100000000) n WHERE ver > -20000 AND ver < 20000""",
    "s_fingers": f"SELECT {_KEYS}, " + ", ".join(f"(bool_or(fwd < 10000) AND NOT bool_or(fwd < -50000)) AND NOT bool_or(fwd < 10000 AND lat > {s} AND lat < {s} + 10000) AS f{i}" for i, s in enumerate(_slot_sql())) + " FROM s_neigh GROUP BY ALL",
    "s_hands": f"SELECT {_KEYS}, " + ", ".join(f"f{i} AND f{i + P} AS h{i}" for i in range(P)) + " FROM s_fingers",
    "s_middle": f"SELECT {_KEYS}, CASE WHEN {' + '.join(f'g{i}' for i in range(P))} = 0 THEN -1 "
    + " ".join(f"WHEN g{i} = 1 AND {' + '.join(f'g{j}' for j in range(i + 1))} = ({' + '.join(f'g{j}' for j in range(P))} + 1) // 2 THEN {i}" for i in range(P))
    + f" END AS placement FROM (SELECT {_KEYS}, {_RUN} FROM s_hands) h",
    "s_fit": f"SELECT {_KEYS}, placement, {_pick('l')} AS slot_l, {_pick('r')} AS slot_r FROM s_middle WHERE placement >= 0",
    "s_held": f"SELECT n.*, placement, slot_l, slot_r FROM s_neigh n JOIN s_fit USING ({_KEYS})",
    "s_deep": _deep_sql(),
    "s_closing": f"SELECT h.*, top, top - 60000 AS bottom, (slot_l + 10000 + slot_r) / 2 AS centre FROM s_held h JOIN s_deep USING ({_KEYS}) WHERE fwd < top AND fwd > top - 60000 AND lat > slot_l + 10000 AND lat < slot_r",
    "s_width": f"SELECT {_KEYS}, count(*) AS n_closing, max(lat) - min(lat) AS width FROM s_closing GROUP BY ALL",
    "s_viable": f"""SELECT c.*, -nl > cos(radians(20)) * 1000 AND lat < l0 + 3000 AS on_l, nl > cos(radians(20)) * 1000 AND lat > l1 - 3000 AS on_r
        FROM s_closing c JOIN (SELECT {_KEYS}, min(lat) AS l0, max(lat) AS l1 FROM s_closing GROUP BY ALL) e USING ({_KEYS})""",
    "s_spans": f"SELECT {_KEYS}, " + ", ".join(f"{m}({c}) FILTER (on_{s}) AS {m}_{c}_{s}" for s in "lr" for c in ("fwd", "ver") for m in ("min", "max")) + " FROM s_viable GROUP BY ALL",
    "s_label": f"""SELECT {_KEYS}, CASE WHEN count(*) FILTER (on_l AND inbox) >= 6 AND count(*) FILTER (on_r AND inbox) >= 6 THEN 2 WHEN bool_or(on_l OR on_r) THEN 1 ELSE 0 END AS label FROM (
        SELECT v.*, coalesce(fwd >= greatest(min_fwd_l, min_fwd_r) AND fwd <= least(max_fwd_l, max_fwd_r) AND ver >= greatest(min_ver_l, min_ver_r) AND ver <= least(max_ver_l, max_ver_r)
        AND min_fwd_l IS NOT NULL AND min_fwd_r IS NOT NULL, false) AS inbox FROM s_viable v JOIN s_spans USING ({_KEYS})) q GROUP BY ALL""",
    "s_unit": f"""SELECT *, (fwd - bottom) / 60000.0 AS u0, (lat - centre + 50000) / 100000.0 AS u1, (ver + 20000) / 40000.0 AS u2 FROM (
        SELECT n.*, -50000 AS bottom, (slot_l + 10000 + slot_r) / 2 AS centre FROM s_held n) q WHERE fwd - bottom > 0 AND fwd - bottom < 60000 AND abs(lat - centre) < 50000 AND abs(ver) < 20000""",
    "s_cells": f"SELECT *, {SIZE - 1} - least(CAST(floor(u0 * {SIZE}) AS INT), {SIZE - 1}) AS row, least(CAST(floor(u1 * {SIZE}) AS INT), {SIZE - 1}) AS col, u2 AS deep FROM s_unit",
    "s_depth": f"SELECT {_KEYS}, row, col, 1 - avg(deep) AS value FROM s_cells GROUP BY ALL",
    "s_shadow": f"SELECT {_KEYS}, row, col, max(m) OVER (PARTITION BY {_KEYS}) - m AS value FROM (SELECT {_KEYS}, row, col, avg(deep) AS m FROM s_cells GROUP BY ALL) q",
    "s_wide": f"""SELECT {_KEYS}, row + i AS row, col + j AS col, max(value) AS value FROM s_depth, (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j)
        WHERE row + i BETWEEN 0 AND {SIZE - 1} AND col + j BETWEEN 0 AND {SIZE - 1} GROUP BY ALL""",
    "s_radius": f"SELECT s.cloud_id, s.sample_id, p.*, (x - sx) * (x - sx) + (y - sy) * (y - sy) + (z - sz) * (z - sz) AS d2 FROM fx_samples s JOIN (SELECT cloud_id AS c, * EXCLUDE (cloud_id) FROM fx_normals) p ON s.cloud_id = p.c WHERE (x - sx) * (x - sx) + (y - sy) * (y - sy) + (z - sz) * (z - sz) <= {R_FRAME * R_FRAME}",
    "s_knn": "SELECT * FROM (SELECT s.cloud_id, s.sample_id, p.point_id, nx, ny, nz, (x - sx) * (x - sx) + (y - sy) * (y - sy) + (z - sz) * (z - sz) AS d2, row_number() OVER (PARTITION BY s.cloud_id, s.sample_id ORDER BY (x - sx) * (x - sx) + (y - sy) * (y - sy) + (z - sz) * (z - sz), p.point_id) AS rank FROM fx_samples s JOIN fx_normals p ON s.cloud_id = p.cloud_id) q WHERE rank <= 5",
    "s_pairs": """SELECT i.cloud_id, i.cand_id, j.cand_id AS other_id, j.px, j.py, j.pz, j.score FROM fx_cands i JOIN fx_cands j ON i.cloud_id = j.cloud_id AND i.cand_id <> j.cand_id
        WHERE abs(i.ax * j.ax + i.ay * j.ay + i.az * j.az) > cos(radians(30)) AND (j.px - i.px) * (j.px - i.px) + (j.py - i.py) * (j.py - i.py) + (j.pz - i.pz) * (j.pz - i.pz) <= 2500000000
        AND sqrt(greatest(0, (j.px - i.px) * (j.px - i.px) + (j.py - i.py) * (j.py - i.py) + (j.pz - i.pz) * (j.pz - i.pz) - power(i.ax * (j.px - i.px) + i.ay * (j.py - i.py) + i.az * (j.pz - i.pz), 2))) <= 30000""",
}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` may use the views and steps by name."""

    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = with_views(sql, STEPS)
        return f

    return keep


def cams(df: DataFrame) -> DataFrame:
    """The camera flags as an array."""
    return df.withColumn("cams", F.filter(F.array(F.when(F.col("cam0") == 1, 0), F.when(F.col("cam1") == 1, 1)), lambda c: c.isNotNull()))


def r4(*names):
    return [F.round(F.col(n), 4).alias(n) for n in names]


def _sides(x: str, y: str, z: str, strict: bool = True) -> str:
    lt, gt = ("<", ">") if strict else ("<=", ">=")
    return " AND ".join(f"{c} {gt} {int(a)} AND {c} {lt} {int(b)}" for c, (a, b) in zip((x, y, z), BOX.sides(), strict=True))


def neigh(spark, d):
    return poses.neighbourhoods(fixture(spark, d, "fx_samples"), fixture(spark, d, "fx_poses"), fixture(spark, d, "fx_obj"), HAND)


def fit(spark, d):
    fingers = poses.finger_placements(neigh(spark, d), HAND, P)
    return poses.slot_columns(poses.choose_middle(poses.hand_feasible(fingers, P)).where("placement >= 0").select(*poses.POSE, "placement"), HAND, P)


def held(spark, d):
    return neigh(spark, d).join(fit(spark, d), list(poses.POSE))


def closing(spark, d):
    h = held(spark, d)
    return poses.closing_region(h.join(poses.deepen(h, HAND, 5000), list(poses.POSE)), HAND)


def unit(spark, d):
    h = held(spark, d).withColumns({"bottom": F.lit(-50_000), "centre": (F.col("slot_l") + 10_000 + F.col("slot_r")) / 2})
    return raster.unit_image_points(h, IMAGE)


def described(spark, d, channels: int):
    """Pixels of the images of all poses that fit, at their initial bite."""
    points = fixture(spark, d, "fx_obj")
    fits = poses.feasible_poses(fixture(spark, d, "fx_samples"), fixture(spark, d, "fx_poses"), points, HAND, P)
    fits = fits.withColumns({"bottom": F.lit(-50_000), "centre": (F.col("slot_l") + 10_000 + F.col("slot_r")) / 2})
    return raster.pose_images(spatial.cut_lineage(fits), points, IMAGE, channels, HAND, pixels=True).withColumn("value", F.col("value").cast("int"))


def celled(spark, d):
    return raster.cells(unit(spark, d), SIZE)


@query("c0_flagship", f"SELECT * FROM (SELECT cloud_id, sample_id, n, row_number() OVER (PARTITION BY cloud_id ORDER BY n DESC, sample_id) AS rank FROM (SELECT n.cloud_id, n.sample_id, count(*) AS n FROM s_neigh n WHERE orient = 0 AND fwd > -50000 AND fwd < 10000 AND lat > -50000 AND lat < 50000 GROUP BY ALL) q) r WHERE rank <= 5")
def c0_flagship(spark, d):
    """Which five sample points of each scan have the most material in the closing box of an unturned hand?"""
    near = neigh(spark, d).where("orient = 0").withColumns({"bottom": F.lit(-50_000), "top": F.lit(10_000), "slot_l": F.lit(-60_000), "slot_r": F.lit(50_000)})
    n = poses.closing_region(near, HAND).groupBy("cloud_id", "sample_id").agg(F.count("*").alias("n"))
    top = ranking.select_top(n.withColumns({"score": F.col("n"), "cand_id": F.col("sample_id")}), 5)
    return top.select("cloud_id", "sample_id", "n", "rank")


# cleaning
query("p1_remove_nans", "SELECT * FROM fx_points_dirty WHERE x IS NOT NULL")(lambda s, d: clean.remove_nans(fixture(s, d, "fx_points_dirty")))
query("p2_filter_workspace", f"SELECT * FROM fx_points WHERE {_sides('x', 'y', 'z')}")(lambda s, d: clean.filter_workspace(fixture(s, d, "fx_points"), BOX))
query("p3_filter_samples", f"SELECT * FROM fx_samples WHERE {_sides('sx', 'sy', 'sz')}")(lambda s, d: clean.filter_samples(fixture(s, d, "fx_samples"), BOX))
query("p4_filter_sample_indices", f"SELECT cloud_id, sample_id AS point_id FROM fx_samples s WHERE EXISTS (SELECT 1 FROM fx_points p WHERE p.cloud_id = s.cloud_id AND p.point_id = s.sample_id AND {_sides('x', 'y', 'z')})")(
    lambda s, d: clean.filter_sample_indices(fixture(s, d, "fx_samples").select("cloud_id", F.col("sample_id").alias("point_id")), fixture(s, d, "fx_points"), BOX))
query("p5_assign_primary_camera", "SELECT cloud_id, point_id, CASE WHEN cam0 = 1 THEN 0 WHEN cam1 = 1 THEN 1 END AS camera FROM fx_normals")(lambda s, d: clean.assign_primary_camera(cams(fixture(s, d, "fx_normals"))).select("cloud_id", "point_id", "camera"))
query("p6_tag_cameras", "SELECT cloud_id, point_id, CASE WHEN row_number() OVER (PARTITION BY cloud_id ORDER BY point_id) <= 100 THEN 0 ELSE 1 END AS camera FROM fx_points")(
    lambda s, d: clean.tag_cameras(fixture(s, d, "fx_points"), 100).select("cloud_id", "point_id", F.col("cams")[0].alias("camera")))
query("p7_negate_normals", "SELECT cloud_id, point_id, -nx AS nx, -ny AS ny, -nz AS nz FROM fx_normals")(lambda s, d: clean.negate_normals(fixture(s, d, "fx_normals")).select("cloud_id", "point_id", "nx", "ny", "nz"))
_FACES = "coalesce((cam0 = 1 AND nx * (x - 0) + ny * (y - 0) + nz * (z - 200000) < 0) OR (cam1 = 1 AND nx * (x - 200000) + ny * y + nz * z < 0), false)"
query("p8_orient_normals", f"SELECT cloud_id, point_id, CASE WHEN {_FACES} THEN nx ELSE -nx END AS nx, CASE WHEN {_FACES} THEN ny ELSE -ny END AS ny, CASE WHEN {_FACES} THEN nz ELSE -nz END AS nz FROM fx_normals")(
    lambda s, d: clean.orient_normals(cams(fixture(s, d, "fx_normals")), fixture(s, d, "fx_viewpoints")).select("cloud_id", "point_id", "nx", "ny", "nz"))
query("p9_to_frame", f"SELECT {_KEYS}, point_id, fwd, lat, ver, nl FROM s_neigh")(lambda s, d: neigh(s, d).select(*poses.POSE, "point_id", "fwd", "lat", "ver", "nl"))
_TURN = "JOIN (SELECT sample_id, cloud_id AS c, r00, r01, r02, r10, r11, r12, r20, r21, r22 FROM fx_poses WHERE orient = 1) r ON p.cloud_id = r.c AND p.point_id = r.sample_id"
query("p10_rotate", f"SELECT cloud_id, point_id, r00 * x + r01 * y + r02 * z AS x, r10 * x + r11 * y + r12 * z AS y, r20 * x + r21 * y + r22 * z AS z FROM fx_points p {_TURN}")(
    lambda s, d: poses.rotate(fixture(s, d, "fx_points").join(fixture(s, d, "fx_poses").where("orient = 1").select("cloud_id", F.col("sample_id").alias("point_id"), *poses.R), ["cloud_id", "point_id"])).select("cloud_id", "point_id", "x", "y", "z"))
query("p11_crop_height", f"SELECT {_KEYS}, count(*) AS n FROM s_neigh WHERE ver > -5000 AND ver < 5000 GROUP BY ALL")(lambda s, d: poses.crop_height(neigh(s, d), 5000).groupBy(*poses.POSE).agg(F.count("*").alias("n")))
query("p12_slice_points", "SELECT p.* FROM fx_points p JOIN fx_samples s ON p.cloud_id = s.cloud_id AND p.point_id = s.sample_id")(
    lambda s, d: clean.slice_points(fixture(s, d, "fx_points"), fixture(s, d, "fx_samples").select("cloud_id", F.col("sample_id").alias("point_id"))))
query("j8_attach_normals", "SELECT p.*, n.nx FROM fx_points p LEFT JOIN (SELECT * FROM fx_normals WHERE cam0 = 1) n ON p.cloud_id = n.cloud_id AND p.point_id = n.point_id")(
    lambda s, d: clean.attach_normals(fixture(s, d, "fx_points"), fixture(s, d, "fx_normals").where("cam0 = 1").select("cloud_id", "point_id", "nx")))
query("a1_cloud_bounds", "SELECT cloud_id, min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z FROM fx_points GROUP BY ALL")(lambda s, d: clean.cloud_bounds(fixture(s, d, "fx_points")))
query("a2_voxelize", """SELECT cloud_id, lx + ix * 3000 AS x, ly + iy * 3000 AS y, lz + iz * 3000 AS z, count(*) AS n_points, round(avg(nx), 4) AS nx, round(avg(ny), 4) AS ny, round(avg(nz), 4) AS nz, arg_min(CASE WHEN cam0 = 1 THEN 0 ELSE 1 END, point_id) AS camera
    FROM (SELECT n.*, lx, ly, lz, (x - lx) // 3000 AS ix, (y - ly) // 3000 AS iy, (z - lz) // 3000 AS iz FROM fx_normals n JOIN (SELECT cloud_id, min(x) AS lx, min(y) AS ly, min(z) AS lz FROM fx_normals GROUP BY ALL) b USING (cloud_id)) q GROUP BY cloud_id, lx, ly, lz, ix, iy, iz""")(
    lambda s, d: clean.voxelize(cams(fixture(s, d, "fx_normals")), 3000).select("cloud_id", "x", "y", "z", "n_points", *r4("nx", "ny", "nz"), F.col("cams")[0].alias("camera")))
query("u1_concat_clouds", "SELECT cloud_id, point_id, x, 0 AS camera FROM fx_points UNION ALL SELECT o.cloud_id, point_id + last + 1, x, 1 FROM fx_obj o JOIN (SELECT cloud_id, max(point_id) AS last FROM fx_points GROUP BY ALL) l ON o.cloud_id = l.cloud_id")(
    lambda s, d: clean.concat_clouds(fixture(s, d, "fx_points"), fixture(s, d, "fx_obj").select("cloud_id", "point_id", "x", "y", "z")).select("cloud_id", "point_id", "x", F.col("cams")[0].alias("camera")))
query("a5_normal_diff_stats", "SELECT cloud_id, round(avg(c), 4) AS mean, round(max(c), 4) AS greatest, round(sum(c), 2) AS total FROM (SELECT a.cloud_id, sqrt((a.nx - b.nx) * (a.nx - b.nx) + (a.ny - b.ny) * (a.ny - b.ny) + (a.nz - b.nz) * (a.nz - b.nz)) AS c FROM fx_normals a JOIN fx_obj b ON a.cloud_id = b.cloud_id AND a.point_id = b.point_id) q GROUP BY ALL")(
    lambda s, d: clean.normal_diff_stats(fixture(s, d, "fx_normals"), fixture(s, d, "fx_obj")).select("cloud_id", *r4("mean", "greatest"), F.round("total", 2).alias("total")))

# spatial joins
near_samples = lambda s, d: spatial.radius_join(fixture(s, d, "fx_samples"), cams(fixture(s, d, "fx_normals")), R_FRAME)
query("j1_radius_join", "SELECT cloud_id, sample_id, point_id, d2 FROM s_radius")(lambda s, d: near_samples(s, d).select("cloud_id", "sample_id", "point_id", "d2"))
knn = lambda s, d: spatial.knn_join(fixture(s, d, "fx_samples"), fixture(s, d, "fx_normals"), K, 12_000)
query("j2_knn_join", "SELECT cloud_id, sample_id, point_id, d2, rank FROM s_knn")(lambda s, d: knn(s, d).select("cloud_id", "sample_id", "point_id", "d2", "rank"))
query("j9_nearest_centre", "SELECT cloud_id, point_id, arg_min(sample_id, (d2, sample_id)) AS centre_id, min(d2) AS d2 FROM (SELECT p.cloud_id, p.point_id, s.sample_id, (x - sx) * (x - sx) + (y - sy) * (y - sy) + (z - sz) * (z - sz) AS d2 FROM fx_obj p JOIN fx_samples s ON p.cloud_id = s.cloud_id) q GROUP BY ALL")(
    lambda s, d: spatial.nearest_centre(fixture(s, d, "fx_obj"), fixture(s, d, "fx_samples").select("cloud_id", F.col("sample_id").alias("centre_id"), *[F.col(f"s{c}").alias(f"c{c}") for c in "xyz"])))
STEPS["s_all"] = "SELECT cloud_id, point_id AS sample_id, x AS sx, y AS sy, z AS sz FROM fx_points"
query("a8_remove_statistical_outliers", """SELECT m.cloud_id, m.point_id FROM (SELECT cloud_id, a AS point_id, avg(sqrt(d2)) AS v FROM (SELECT p.cloud_id, p.sample_id AS a, q.sample_id AS b, (p.sx - q.sx) * (p.sx - q.sx) + (p.sy - q.sy) * (p.sy - q.sy) + (p.sz - q.sz) * (p.sz - q.sz) AS d2,
    row_number() OVER (PARTITION BY p.cloud_id, p.sample_id ORDER BY (p.sx - q.sx) * (p.sx - q.sx) + (p.sy - q.sy) * (p.sy - q.sy) + (p.sz - q.sz) * (p.sz - q.sz), q.sample_id) AS k FROM s_all p JOIN s_all q ON p.cloud_id = q.cloud_id) n WHERE k <= 4 AND a <> b GROUP BY ALL) m
    JOIN (SELECT cloud_id, avg(v) AS mu, stddev_samp(v) AS sigma FROM (SELECT cloud_id, a, avg(sqrt(d2)) AS v FROM (SELECT p.cloud_id, p.sample_id AS a, q.sample_id AS b, (p.sx - q.sx) * (p.sx - q.sx) + (p.sy - q.sy) * (p.sy - q.sy) + (p.sz - q.sz) * (p.sz - q.sz) AS d2,
    row_number() OVER (PARTITION BY p.cloud_id, p.sample_id ORDER BY (p.sx - q.sx) * (p.sx - q.sx) + (p.sy - q.sy) * (p.sy - q.sy) + (p.sz - q.sz) * (p.sz - q.sz), q.sample_id) AS k FROM s_all p JOIN s_all q ON p.cloud_id = q.cloud_id) n WHERE k <= 4 AND a <> b GROUP BY ALL) w GROUP BY ALL) t ON m.cloud_id = t.cloud_id WHERE v <= mu + sigma OR sigma IS NULL
    UNION ALL SELECT cloud_id, min(sample_id) FROM s_all GROUP BY cloud_id HAVING count(*) = 1""")(
    lambda s, d: spatial.remove_statistical_outliers(fixture(s, d, "fx_points"), 3, 1.0, 12_000).select("cloud_id", "point_id"))
query("a16_neighbourhood_stats", "SELECT cloud_id, sample_id, count(*) AS n, round(avg(x), 4) AS mx, round(avg(y), 4) AS my, round(avg(z), 4) AS mz, CAST(sum(cam0) AS BIGINT) AS seen_0, CAST(sum(cam1) AS BIGINT) AS seen_1 FROM s_radius GROUP BY ALL")(
    lambda s, d: spatial.neighbourhood_stats(near_samples(s, d)).select("cloud_id", "sample_id", "n", *r4("mx", "my", "mz"), "seen_0", "seen_1"))

# normals, frames, planes
_SUMS = "count(*) AS n, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS s{c}" for c in "xyz") + ", " + ", ".join(f"CAST(sum({p[0]} * {p[1]}) AS BIGINT) AS s{p}" for p in normals.PAIRS)
query("a3_normal_moments", f"SELECT a.cloud_id, a.point_id, {_SUMS.replace('(x', '(b.x').replace('(y', '(b.y').replace('(z', '(b.z').replace('* x', '* b.x').replace('* y', '* b.y').replace('* z', '* b.z')} FROM fx_points a JOIN fx_points b ON a.cloud_id = b.cloud_id WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= {R_NORMAL**2} GROUP BY ALL")(
    lambda s, d: normals.place_moments(fixture(s, d, "fx_points"), R_NORMAL))
_GAPS = {p: f"(b.{p[0]} - a.{p[0]}) * (b.{p[1]} - a.{p[1]})" for p in normals.PAIRS}
STEPS["n_moments"] = f"""SELECT a.cloud_id, a.point_id, a.x, a.y, a.z, a.cam0, count(*) AS n, {", ".join(f"sum(b.{c} - a.{c}) AS s{c}" for c in "xyz")}, {", ".join(f"sum({g}) AS s{p}" for p, g in _GAPS.items())}
    FROM fx_normals a JOIN fx_points b ON a.cloud_id = b.cloud_id WHERE {_GAPS["xx"]} + {_GAPS["yy"]} + {_GAPS["zz"]} <= {R_NORMAL**2} GROUP BY ALL HAVING count(*) >= 3"""
STEPS["n_cov"] = f"""SELECT *, (cxx + cyy + czz) / 3 AS q FROM (SELECT cloud_id, point_id, x, y, z, cam0,
    {", ".join(f"CAST(s{p} AS DOUBLE) / n - (CAST(s{p[0]} AS DOUBLE) / n) * (CAST(s{p[1]} AS DOUBLE) / n) AS c{p}" for p in normals.PAIRS)} FROM n_moments) m"""
STEPS["n_turn"] = """SELECT *, acos(greatest(-1.0, least(1.0, (dx * (dy * dz - fy * fy) - fx * (fx * dz - fy * fz) + fz * (fx * fy - dy * fz)) / 2))) / 3 AS phi FROM (
    SELECT *, (cxx - q) / p AS dx, (cyy - q) / p AS dy, (czz - q) / p AS dz, cxy / p AS fx, cyz / p AS fy, cxz / p AS fz FROM (
    SELECT *, sqrt(((cxx - q) * (cxx - q) + (cyy - q) * (cyy - q) + (czz - q) * (czz - q) + 2 * (cxy * cxy + cxz * cxz + cyz * cyz)) / 6) AS p FROM n_cov) a WHERE p > 0) b"""
STEPS["n_rows"] = """SELECT *, (3 * q - l1 - 2 * l0) / (3 * q) AS gap, cxy * cyz - cxz * (cyy - l0) AS a0, cxz * cxy - (cxx - l0) * cyz AS a1, (cxx - l0) * (cyy - l0) - cxy * cxy AS a2,
    cxy * (czz - l0) - cxz * cyz AS b0, cxz * cxz - (cxx - l0) * (czz - l0) AS b1, (cxx - l0) * cyz - cxy * cxz AS b2,
    (cyy - l0) * (czz - l0) - cyz * cyz AS e0, cyz * cxz - cxy * (czz - l0) AS e1, cxy * cyz - (cyy - l0) * cxz AS e2
    FROM (SELECT *, q + 2 * p * cos(phi) AS l1, q + 2 * p * cos(phi + 2 * pi() / 3) AS l0 FROM n_turn) t"""
STEPS["n_axis"] = """SELECT cloud_id, point_id, gap, x - CASE WHEN cam0 = 1 THEN 0 ELSE 200000 END AS wx, y AS wy, z - CASE WHEN cam0 = 1 THEN 200000 ELSE 0 END AS wz, v[2] / sqrt(v[1]) AS ux, v[3] / sqrt(v[1]) AS uy, v[4] / sqrt(v[1]) AS uz
    FROM (SELECT *, list_max([[a0 * a0 + a1 * a1 + a2 * a2, a0, a1, a2], [b0 * b0 + b1 * b1 + b2 * b2, b0, b1, b2], [e0 * e0 + e1 * e1 + e2 * e2, e0, e1, e2]]) AS v FROM n_rows) r WHERE v[1] > 0"""
# a normal is told where the plane is clear and the viewpoint is off it
STEPS["n_told"] = """SELECT cloud_id, point_id, CASE WHEN seen < 0 THEN ux ELSE -ux END AS nx, CASE WHEN seen < 0 THEN uy ELSE -uy END AS ny, CASE WHEN seen < 0 THEN uz ELSE -uz END AS nz
    FROM (SELECT *, ux * wx + uy * wy + uz * wz AS seen FROM n_axis WHERE gap > 0.01) a WHERE abs(seen) > 1"""


def clear_normals(s, d):
    views = cams(fixture(s, d, "fx_normals")).withColumn("left_", F.col("cam0") == 1).drop("cam0", "cam1")
    out = normals.estimate_normals(views, fixture(s, d, "fx_viewpoints"), R_NORMAL, with_gap=True)
    view = (F.when(F.col("left_"), 0).otherwise(200_000), F.lit(0), F.when(F.col("left_"), 200_000).otherwise(0))
    seen = sum((F.col(f"n{c}") * (F.col(c) - v) for c, v in zip("xyz", view, strict=True)), F.lit(0.0))
    return out.where((F.col("gap") > 0.01) & (F.abs(seen) > 1)).select("cloud_id", "point_id", *[(F.round(c, 4) + 0.0).alias(c) for c in ("nx", "ny", "nz")])


query("a3_estimate_normals", "SELECT cloud_id, point_id, round(nx, 4) + 0.0 AS nx, round(ny, 4) + 0.0 AS ny, round(nz, 4) + 0.0 AS nz FROM n_told")(clear_normals)
STEPS["s_knn_all"] = STEPS["s_knn"].replace("fx_samples", "s_all")
query("a4_refine_normals", "SELECT cloud_id, sample_id AS point_id, round(sx / n, 4) AS nx, round(sy / n, 4) AS ny, round(sz / n, 4) AS nz FROM (SELECT cloud_id, sample_id, avg(nx) AS sx, avg(ny) AS sy, avg(nz) AS sz, nullif(sqrt(avg(nx) * avg(nx) + avg(ny) * avg(ny) + avg(nz) * avg(nz)), 0) AS n FROM s_knn_all GROUP BY ALL) q")(
    lambda s, d: normals.refine_normals(fixture(s, d, "fx_normals"), K, 12_000).select("cloud_id", "point_id", *r4("nx", "ny", "nz")))
query("a4_refine_normals_3_passes")(lambda s, d: normals.refine_normals(fixture(s, d, "fx_normals"), K, 12_000, 3).select("cloud_id", "point_id", *r4("nx", "ny", "nz")))
query("a6_frame_sums", "SELECT cloud_id, sample_id, count(*) AS n, CAST(sum(nx) AS BIGINT) AS tx, CAST(sum(ny) AS BIGINT) AS ty, CAST(sum(nz) AS BIGINT) AS tz, " + ", ".join(f"CAST(sum(n{p[0]} * n{p[1]}) AS BIGINT) AS m{p}" for p in normals.PAIRS) + " FROM s_radius GROUP BY ALL")(
    lambda s, d: normals.frame_sums(fixture(s, d, "fx_samples"), fixture(s, d, "fx_normals"), R_FRAME))
# the fixture's normals lie along the axes, so that their scatter is diagonal
STEPS["f_sums"] = f"""SELECT s.cloud_id, s.sample_id, CAST(sum(nx) AS BIGINT) AS tx, CAST(sum(ny) AS BIGINT) AS ty, CAST(sum(nz) AS BIGINT) AS tz, sum(nx * nx) AS mx, sum(ny * ny) AS my, sum(nz * nz) AS mz
    FROM fx_samples s JOIN fx_normals p ON s.cloud_id = p.cloud_id WHERE (x - sx) * (x - sx) + (y - sy) * (y - sy) + (z - sz) * (z - sz) <= {9 * R_FRAME**2} GROUP BY ALL"""
_UNIT = {"x": "[1, 0, 0]", "y": "[0, 1, 0]", "z": "[0, 0, 1]"}
_most = lambda f: "CASE " + " ".join(f"WHEN m{c} = {f}(mx, my, mz) THEN {u}" for c, u in _UNIT.items()) + " END"
STEPS["f_axes"] = f"""SELECT cloud_id, sample_id, c, CASE WHEN n[1] * tx + n[2] * ty + n[3] * tz < 0 THEN -1 ELSE 1 END AS turn, n FROM (
    SELECT *, {_most('least')} AS c, {_most('greatest')} AS n FROM f_sums WHERE mx <> my AND my <> mz AND mx <> mz) q"""
query("a6_local_frames", """SELECT cloud_id, sample_id, CAST(c[1] AS DOUBLE) AS c0, CAST(c[2] AS DOUBLE) AS c1, CAST(c[3] AS DOUBLE) AS c2, CAST(turn * n[1] AS DOUBLE) AS n0, CAST(turn * n[2] AS DOUBLE) AS n1, CAST(turn * n[3] AS DOUBLE) AS n2,
    CAST(turn * (c[2] * n[3] - c[3] * n[2]) AS DOUBLE) AS b0, CAST(turn * (c[3] * n[1] - c[1] * n[3]) AS DOUBLE) AS b1, CAST(turn * (c[1] * n[2] - c[2] * n[1]) AS DOUBLE) AS b2 FROM f_axes""")(
    lambda s, d: normals.local_frames(fixture(s, d, "fx_samples"), fixture(s, d, "fx_normals"), 3 * R_FRAME, with_gap=True).where("gap > 1e-5").select("cloud_id", "sample_id", *[(F.round(f"{v}{i}", 4) + 0.0).alias(f"{v}{i}") for v in "cnb" for i in range(3)]))
_COV = ", ".join(f"avg({p[0]} * {p[1]}) - avg({p[0]}) * avg({p[1]}) AS c{p}" for p in normals.PAIRS)
query("e1_principal_axes", f"""SELECT cloud_id, n, round((q + 2 * p * cos(phi)) / q, 4) AS l_max, round((q + 2 * p * cos(phi + 2 * pi() / 3)) / q, 4) AS l_min FROM (SELECT *, acos(greatest(-1.0, least(1.0, ((cxx - q) / p * ((cyy - q) / p * (czz - q) / p - cyz / p * cyz / p) - cxy / p * (cxy / p * (czz - q) / p - cyz / p * cxz / p) + cxz / p * (cxy / p * cyz / p - (cyy - q) / p * cxz / p)) / 2))) / 3 AS phi FROM (
    SELECT *, (cxx + cyy + czz) / 3 AS q, sqrt((power(cxx - (cxx + cyy + czz) / 3, 2) + power(cyy - (cxx + cyy + czz) / 3, 2) + power(czz - (cxx + cyy + czz) / 3, 2) + 2 * (cxy * cxy + cxz * cxz + cyz * cyz)) / 6) AS p FROM (SELECT cloud_id, count(*) AS n, {_COV} FROM fx_points GROUP BY ALL) a) b) c""")(
    lambda s, d: normals.principal_axes(fixture(s, d, "fx_points"), ("cloud_id",)).withColumn("q", (F.col("cxx") + F.col("cyy") + F.col("czz")) / 3).select("cloud_id", "n", F.round(F.col("l_max") / F.col("q"), 4).alias("l_max"), F.round(F.col("l_min") / F.col("q"), 4).alias("l_min")))
flat = lambda s, d: fixture(s, d, "fx_points").select("cloud_id").distinct().select("cloud_id", F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(1.0).alias("c"), F.lit(-10000.0).alias("d"))
query("a7_plane_inliers", "SELECT cloud_id, CAST(sum(CASE WHEN abs(z - 10000) <= 5000 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM fx_points GROUP BY ALL")(lambda s, d: normals.plane_inliers(fixture(s, d, "fx_points"), flat(s, d), 5000).groupBy("cloud_id").agg(F.sum(F.col("inlier").cast("long")).alias("n")))
query("a7_fit_plane")(lambda s, d: normals.fit_plane(fixture(s, d, "fx_points"), 10_000))
query("u3_remove_plane", "SELECT * FROM fx_points WHERE abs(z - 10000) > 5000")(lambda s, d: normals.remove_plane(fixture(s, d, "fx_points"), flat(s, d), 5000))
query("t7_sample_above_plane")(lambda s, d: normals.sample_above_plane(fixture(s, d, "fx_points"), 10_000))

# poses
_GRID = " UNION ALL ".join(f"SELECT {a}, {k}, " + ", ".join(str(round(sum(t[3 * i + m] * r[3 * m + j] for m in range(3)))) for i in range(3) for j in range(3)) for a in range(3) for k in range(2) for t in [[-1, 0, 0, 0, 1, 0, 0, 0, -1]] for r in [poses.axis_rotation(a, -1.5707963267948966 + 1.5707963267948966 * k)])
_FIRST = ", ".join(f"r{i}{j}" for i in range(3) for j in range(3))
query("j6_pose_grid", f"SELECT cloud_id, sample_id, axis, orient, {_FIRST} FROM fx_samples CROSS JOIN ({_GRID}) g(axis, orient, {_FIRST})")(
    lambda s, d: poses.pose_grid(fixture(s, d, "fx_samples").select("cloud_id", "sample_id", *[F.lit(1 if v == i else 0).alias(f"{n}{i}") for v, n in enumerate("nbc") for i in range(3)]), (0, 1, 2), 2).select("cloud_id", "sample_id", "axis", "orient", *[F.round(c).cast("int").alias(c) for c in poses.R]))
bits = lambda c: F.array_join(F.transform(c, lambda b: b.cast("int").cast("string")), "")
query("a9_finger_placements", f"SELECT {_KEYS}, " + " || ".join(f"CASE WHEN f{i} THEN '1' ELSE '0' END" for i in range(2 * P)) + " AS fingers FROM s_fingers")(lambda s, d: poses.finger_placements(neigh(s, d), HAND, P).withColumn("fingers", bits("fingers")))
query("a10_hand_feasible", f"SELECT {_KEYS}, " + " || ".join(f"CASE WHEN h{i} THEN '1' ELSE '0' END" for i in range(P)) + " AS hands FROM s_hands")(lambda s, d: poses.hand_feasible(poses.finger_placements(neigh(s, d), HAND, P), P).select(*poses.POSE, bits("hands").alias("hands")))
query("a11_choose_middle", f"SELECT {_KEYS}, placement FROM s_middle")(lambda s, d: poses.choose_middle(poses.hand_feasible(poses.finger_placements(neigh(s, d), HAND, P), P)).select(*poses.POSE, "placement"))
query("a12_deepen", f"SELECT {_KEYS}, top, top - 60000 AS bottom FROM s_deep")(lambda s, d: poses.deepen(held(s, d), HAND, 5000).select(*poses.POSE, "top", "bottom"))
query("a13_closing_region", f"SELECT {_KEYS}, n_closing, width FROM s_width")(lambda s, d: poses.closing_width(closing(s, d)))


def unit_normals(df):
    return df.withColumn("nl", F.col("nl") / 1000)


query("a14_antipodal_label", f"SELECT {_KEYS}, label FROM s_label")(lambda s, d: poses.antipodal_label(unit_normals(closing(s, d)), 20.0, 6, 3000))
query("a15_antipodal_from_normals", f"SELECT {_KEYS}, CASE WHEN count(*) FILTER (-nl > 950) > 6 AND count(*) FILTER (nl > 950) > 6 THEN 2 WHEN count(*) FILTER (-nl > 950) > 6 OR count(*) FILTER (nl > 950) > 6 THEN 1 ELSE 0 END AS label FROM s_closing GROUP BY ALL")(lambda s, d: poses.antipodal_from_normals(unit_normals(closing(s, d)), 20.0, 10.0))


def placed(s, d):
    """Feasible poses of the fixture at their initial bite."""
    f = fit(s, d).withColumns({"top": F.lit(10_000), "bottom": F.lit(-50_000), "centre": ((F.col("slot_l") + 10_000 + F.col("slot_r")) / 2).cast("long")})
    return f.join(fixture(s, d, "fx_poses"), list(poses.POSE))


_FULL = f"""(SELECT v.*, min_fwd_l, max_fwd_l, min_fwd_r, max_fwd_r, min_ver_l, max_ver_l, min_ver_r, max_ver_r FROM v JOIN (SELECT {_KEYS}, """ + ", ".join(f"{m}({c}) FILTER (on_{s}) AS {m}_{c}_{s}" for s in "lr" for c in ("fwd", "ver") for m in ("min", "max")) + f" FROM v GROUP BY ALL) sp USING ({_KEYS})) w"
STEPS["m_neigh"] = STEPS["s_neigh"].replace("fx_obj q", "(SELECT * FROM fx_obj WHERE point_id % 2 = 0) q")
STEPS["m_held"] = f"SELECT n.*, placement, slot_l, slot_r FROM m_neigh n JOIN s_fit USING ({_KEYS})"
STEPS["m_fits"] = f"SELECT {_KEYS} FROM m_held GROUP BY ALL HAVING bool_or(fwd < 10000) AND NOT bool_or(fwd < 10000 AND (fwd < -50000 OR (lat > slot_l AND lat < slot_l + 10000) OR (lat > slot_r AND lat < slot_r + 10000)))"
STEPS["m_closing"] = "SELECT * FROM m_held WHERE fwd < 10000 AND fwd > -50000 AND lat > slot_l + 10000 AND lat < slot_r"
for _new, _old in (("m_viable", "s_viable"), ("m_spans", "s_spans"), ("m_label", "s_label")):
    STEPS[_new] = STEPS[_old].replace("s_closing", "m_closing").replace("s_viable", "m_viable").replace("s_spans", "m_spans")
mesh = lambda s, d: fixture(s, d, "fx_obj").where("point_id % 2 = 0").withColumns({c: F.col(c) / 1000 for c in ("nx", "ny", "nz")})
_LABELS = f"SELECT f.cloud_id, f.sample_id, f.orient, CASE WHEN m.cloud_id IS NULL THEN 0 ELSE coalesce(l.label, 0) END AS label FROM s_fit f LEFT JOIN m_fits m ON f.cloud_id = m.cloud_id AND f.sample_id = m.sample_id AND f.orient = m.orient LEFT JOIN m_label l ON f.cloud_id = l.cloud_id AND f.sample_id = l.sample_id AND f.orient = l.orient"
query("j7_reevaluate", _LABELS)(lambda s, d: poses.reevaluate(placed(s, d), mesh(s, d), HAND, 20.0, 6, 3000))
query("c6_label_against_mesh", f"SELECT {_KEYS}, CASE WHEN label = 2 THEN 1 ELSE 0 END AS label FROM ({_LABELS}) q")(lambda s, d: pipelines.label_against_mesh(placed(s, d), mesh(s, d), HAND, 20.0, 6, 3000))
_AXES = ", ".join(f"r{i}{j} AS {v}{i}" for j, v in enumerate("abc") for i in range(3))
query("p18_pose_axes", f"SELECT {_KEYS}, {_AXES} FROM fx_poses")(lambda s, d: poses.pose_axes(fixture(s, d, "fx_poses")).select(*poses.POSE, *[f"{v}{i}" for v in "abc" for i in range(3)]))
STEPS["s_placed"] = f"SELECT p.*, slot_l, slot_r, -50000 AS bottom, (slot_l + 10000 + slot_r) // 2 AS centre, r00 * -50000 + r01 * ((slot_l + 10000 + slot_r) // 2) + sx AS px, r10 * -50000 + r11 * ((slot_l + 10000 + slot_r) // 2) + sy AS py, r20 * -50000 + r21 * ((slot_l + 10000 + slot_r) // 2) + sz AS pz FROM fx_poses p JOIN s_fit USING ({_KEYS})"
at = lambda s, d: poses.grasp_position(placed(s, d))
query("p19_grasp_position", f"SELECT {_KEYS}, px, py, pz FROM s_placed")(lambda s, d: at(s, d).select(*poses.POSE, *[F.col(c).cast("long").alias(c) for c in ("px", "py", "pz")]))
query("p20_pose_to_matrix", f"SELECT {_KEYS}, " + ", ".join(f"CAST({c} AS BIGINT) AS m{k}" for k, c in enumerate([x for i, v in enumerate("xyz") for x in (f"r{i}0", f"r{i}1", f"r{i}2", f"p{v}")])) + " FROM s_placed")(
    lambda s, d: poses.pose_to_matrix(at(s, d)).select(*poses.POSE, *[F.col("m")[k].cast("long").alias(f"m{k}") for k in range(12)]))
query("p21_pose_to_quaternion", f"SELECT {_KEYS}, 0.0 AS qx, 0.0 AS qy, CASE orient WHEN 0 THEN 0.0 WHEN 1 THEN 0.7071 WHEN 2 THEN 1.0 ELSE -0.7071 END AS qz, CASE orient WHEN 0 THEN 1.0 WHEN 2 THEN 0.0 ELSE 0.7071 END AS qw FROM fx_poses".replace(" 0.0 ", " CAST(0 AS DOUBLE) ").replace("END AS q", "END::DOUBLE AS q"))(
    lambda s, d: poses.pose_to_quaternion(fixture(s, d, "fx_poses")).select(*poses.POSE, *[(F.round(c, 4) + 0.0).alias(c) for c in ("qx", "qy", "qz", "qw")]))
query("s5_candidate_rows", "SELECT px, py, pz, r02 AS c0, r12 AS c1, r22 AS c2, r00 AS a0, r10 AS a1, r20 AS a2, r01 AS b0, r11 AS b1, r21 AS b2, slot_r - slot_l - 10000 AS width FROM s_placed")(
    lambda s, d: io.candidate_rows(poses.pose_axes(at(s, d)).withColumn("width", F.col("slot_r") - F.col("slot_l") - 10_000)).select(*[F.col(c).cast("long").alias(c) for c in io.CANDIDATE_COLUMNS]))
STEPS["s_c2"] = f"SELECT {_KEYS}, placement, top, n_closing, width, label FROM s_fit JOIN s_deep USING ({_KEYS}) JOIN s_width USING ({_KEYS}) JOIN s_label USING ({_KEYS})"


def candidates(s, d):
    obj = fixture(s, d, "fx_obj").withColumns({c: F.col(c) / 1000 for c in ("nx", "ny", "nz")})
    return pipelines.generate_candidates(fixture(s, d, "fx_samples"), fixture(s, d, "fx_poses"), obj, HAND, P, 5000, 20.0, 6, 3000)


query("c2_generate_candidates", "SELECT * FROM s_c2")(lambda s, d: candidates(s, d).select(*poses.POSE, "placement", F.col("top").cast("long").alias("top"), "n_closing", "width", "label"))
query("p22_antipodal_only", f"SELECT {_KEYS} FROM s_label WHERE label = 2")(lambda s, d: ranking.antipodal_only(candidates(s, d)).select(*poses.POSE))
flagged = lambda s, d: poses.choose_middle(poses.hand_feasible(poses.finger_placements(neigh(s, d), HAND, P), P)).withColumn("is_valid", F.col("placement") >= 0)
query("p15_drop_empty_sets", f"SELECT {_KEYS}, placement FROM s_middle m WHERE EXISTS (SELECT 1 FROM s_fit f WHERE f.cloud_id = m.cloud_id AND f.sample_id = m.sample_id)")(lambda s, d: ranking.drop_empty_sets(flagged(s, d)).select(*poses.POSE, "placement"))
query("p17_valid_candidates", f"SELECT {_KEYS}, placement FROM s_fit")(lambda s, d: ranking.valid_candidates(flagged(s, d)).select(*poses.POSE, "placement"))

# ranking and clusters
scored = lambda s, d: fixture(s, d, "fx_cands")
def _corner(p: str) -> str:
    """All four corners of the hand between the sides of the box, along one axis."""
    a, b = f"a{p[1]}", f'"b{p[1]}"'
    at = f"{p} + 60000 * {b}, {p} - 60000 * {b}, {p} + 60000 * {a} + 60000 * {b}, {p} - 60000 * {a}"
    return f"least({at}) >= -75000 AND greatest({at}) <= 75000"


query("p13_filter_candidates_workspace", f'SELECT cloud_id, cand_id FROM (SELECT *, -ay AS bx, ax AS "by", 0.0 AS bz, abs(score) AS width FROM fx_cands) q WHERE width >= 10000 AND width <= 200000 AND {_corner("px")} AND {_corner("py")} AND {_corner("pz")}')(
    lambda s, d: ranking.filter_candidates_workspace(scored(s, d).withColumns({"bx": -F.col("ay"), "by": F.col("ax"), "bz": F.lit(0.0), "width": F.abs("score")}), Box(*[-75_000, 75_000] * 3), HAND, 10_000, 200_000).select("cloud_id", "cand_id"))
query("p14_filter_candidates_direction", "SELECT cloud_id, cand_id FROM fx_cands WHERE acos(greatest(-1.0, least(1.0, az))) <= 1.2")(lambda s, d: ranking.filter_candidates_direction(scored(s, d), (0, 0, 1), 1.2).select("cloud_id", "cand_id"))
query("p16_prune_by_score", "SELECT cloud_id, cand_id, score FROM fx_cands WHERE score > 100000")(lambda s, d: ranking.prune_by_score(scored(s, d), 100_000).select("cloud_id", "cand_id", "score"))
_RANK = "SELECT cloud_id, cand_id, score, row_number() OVER (PARTITION BY cloud_id ORDER BY score DESC, cand_id) AS rank FROM fx_cands"
query("t1_select_top", f"SELECT * FROM ({_RANK}) q WHERE rank <= 5")(lambda s, d: ranking.select_top(scored(s, d), 5).select("cloud_id", "cand_id", "score", "rank"))
query("t2_rank_candidates", _RANK)(lambda s, d: ranking.rank_candidates(scored(s, d)).select("cloud_id", "cand_id", "score", "rank"))
WIDE = {"angle": 30.0, "dist": 50_000, "lateral": 30_000}
LIMITS = WIDE | {"axis": ("ax", "ay", "az")}  # the fixture has one direction
query("j5_pair_inliers", "SELECT cloud_id, cand_id, other_id FROM s_pairs")(lambda s, d: ranking.pair_inliers(scored(s, d), **LIMITS).select("cloud_id", F.col("i_cand_id").alias("cand_id"), F.col("j_cand_id").alias("other_id")))
_CLUSTER = "SELECT cloud_id, cand_id, count(*) AS support, round(avg(px), 4) AS px, round(avg(score) - 2.576 * stddev_pop(score) / sqrt(count(*)), 3) AS score FROM s_pairs GROUP BY ALL HAVING count(*) >= 3"
clusters = lambda s, d: ranking.cluster_candidates(scored(s, d), 3, **LIMITS).select("cloud_id", "cand_id", "support", *r4("px"), F.round("score", 3).alias("score"))
query("a17_cluster_candidates", _CLUSTER)(clusters)
_OWNED = """SELECT cloud_id, owner AS cand_id, count(*) AS support, round(avg(px), 4) AS px, round(avg(score) - 2.576 * stddev_pop(score) / sqrt(count(*)), 3) AS score FROM (
    SELECT p.cloud_id, p.other_id, p.px, p.score, arg_min(p.cand_id, (-i.score, p.cand_id)) AS owner FROM s_pairs p JOIN fx_cands i ON p.cloud_id = i.cloud_id AND p.cand_id = i.cand_id GROUP BY ALL) q
    GROUP BY ALL HAVING count(*) >= 2"""
query("a17_cluster_exclusive", _OWNED)(
    lambda s, d: ranking.cluster_exclusive(scored(s, d), 2, **LIMITS).select("cloud_id", "cand_id", "support", *r4("px"), F.round("score", 3).alias("score")))
query("u5_clusters_or_all", f"WITH k AS ({_CLUSTER.replace('>= 3', '>= 12')}) SELECT cloud_id, cand_id FROM k UNION ALL SELECT cloud_id, cand_id FROM fx_cands c WHERE (SELECT count(*) FROM k WHERE k.cloud_id = c.cloud_id) <= 3".replace("WITH k AS", "SELECT * FROM (WITH k AS", 1) + ") q")(
    lambda s, d: ranking.clusters_or_all(ranking.cluster_candidates(scored(s, d), 12, **LIMITS).select("cloud_id", "cand_id"), scored(s, d)))
query("j10_dedupe_candidates", """SELECT cloud_id, cand_id FROM fx_cands i WHERE NOT EXISTS (SELECT 1 FROM fx_cands j WHERE j.cloud_id = i.cloud_id AND (j.score > i.score OR j.score = i.score AND j.cand_id < i.cand_id)
    AND (i.ax * j.ax + i.ay * j.ay + i.az * j.az >= 0.97 OR (i.px - j.px) * (i.px - j.px) + (i.py - j.py) * (i.py - j.py) + (i.pz - j.pz) * (i.pz - j.pz) <= 4000000))""")(lambda s, d: ranking.dedupe_candidates(scored(s, d), 2000, 0.97).select("cloud_id", "cand_id"))

# images
query("i1_unit_image_points", f"SELECT {_KEYS}, point_id, CAST(round(u0 * 60000) AS BIGINT) AS u0, CAST(round(u1 * 100000) AS BIGINT) AS u1, CAST(round(u2 * 40000) AS BIGINT) AS u2 FROM s_unit")(lambda s, d: unit(s, d).select(*poses.POSE, "point_id", *[F.round(F.col(f"u{i}") * k).cast("long").alias(f"u{i}") for i, k in enumerate((60_000, 100_000, 40_000))]))
query("i2_cell_index", f"SELECT {_KEYS}, point_id, row, col FROM s_cells")(lambda s, d: celled(s, d).select(*poses.POSE, "point_id", "row", "col"))
query("i3_binary_image", f"SELECT DISTINCT {_KEYS}, row, col, 255 AS value FROM s_cells")(lambda s, d: raster.binary_image(celled(s, d)).withColumn("value", F.col("value").cast("int")))
query("i4_depth_image", f"SELECT {_KEYS}, row, col, round(value, 4) AS value FROM s_depth")(lambda s, d: raster.depth_image(celled(s, d)).withColumn("value", F.round("value", 4)))
query("i6_shadow_image", f"SELECT {_KEYS}, row, col, round(value, 4) AS value FROM s_shadow")(lambda s, d: raster.shadow_image(celled(s, d)).withColumn("value", F.round("value", 4)))
query("i7_dilate3", f"SELECT {_KEYS}, row, col, round(value, 4) AS value FROM s_wide")(lambda s, d: raster.dilate3(raster.depth_image(celled(s, d)), SIZE).withColumn("value", F.round("value", 4)))
_U8 = f"""SELECT {_KEYS}, row, col, CAST(CASE WHEN hi > lo THEN round_even(255 * (value - lo) / (hi - lo), 0) ELSE 0 END AS INT) AS value FROM (SELECT *,
    CASE WHEN count(*) OVER w < {SIZE * SIZE} THEN least(min(value) OVER w, 0) ELSE min(value) OVER w END AS lo, CASE WHEN count(*) OVER w < {SIZE * SIZE} THEN greatest(max(value) OVER w, 0) ELSE max(value) OVER w END AS hi FROM s_wide WINDOW w AS (PARTITION BY {_KEYS})) q"""
query("i8_minmax_u8", _U8)(lambda s, d: raster.minmax_u8(raster.dilate3(raster.depth_image(celled(s, d)), SIZE), SIZE).withColumn("value", F.col("value").cast("int")))
query("i9_project3", f"SELECT {_KEYS}, view, count(*) AS n, CAST(round(600000 * sum(CASE view WHEN 0 THEN u0 ELSE u2 END)) AS BIGINT) AS w0, CAST(round(600000 * sum(CASE view WHEN 2 THEN u0 ELSE u1 END)) AS BIGINT) AS w1, CAST(round(600000 * sum(CASE view WHEN 0 THEN u2 WHEN 1 THEN u0 ELSE u1 END)) AS BIGINT) AS w2 FROM s_unit, (VALUES (0), (1), (2)) v(view) GROUP BY ALL")(
    lambda s, d: raster.project3(unit(s, d)).groupBy(*poses.POSE, "view").agg(F.count("*").alias("n"), *[F.round(600_000 * F.sum(f"w{i}")).cast("long").alias(f"w{i}") for i in range(3)]))
query("i10_describe_1", f"SELECT {_KEYS}, 0 AS channel, row, col, value FROM ({_U8}) q WHERE value <> 0")(lambda s, d: described(s, d, 1))
_CELL = "least(CAST(floor({} * %d) AS INT), %d)" % (SIZE, SIZE - 1)
STEPS["s_views"] = f"""SELECT {_KEYS}, point_id, view, nf, nl, nv, {SIZE - 1} - {_CELL.format("CASE view WHEN 0 THEN u0 ELSE u2 END")} AS row, {_CELL.format("CASE view WHEN 2 THEN u0 ELSE u1 END")} AS col,
    CASE view WHEN 0 THEN u2 WHEN 1 THEN u0 ELSE u1 END AS deep FROM s_unit, (VALUES (0), (1), (2)) v(view)"""
STEPS["s_lists"] = f"""SELECT {_KEYS}, view, row, col, list({{'a': CAST(abs(nf) AS DOUBLE), 'b': CAST(abs(nl) AS DOUBLE), 'c': CAST(abs(nv) AS DOUBLE), 's': deep}} ORDER BY point_id) AS p
    FROM s_views GROUP BY {_KEYS}, view, row, col"""
_STEP = ", ".join(f"'{c}': CASE WHEN n = 0 THEN p[i + 1].{c} ELSE v.{c} + (p[i + 1].{c} - v.{c}) / n END" for c in "abc") + ", 's': v.s + p[i + 1].s"
STEPS["s_fold"] = f"""SELECT {_KEYS}, view, row, col, p, 1 AS i, p[1] AS v FROM s_lists UNION ALL SELECT {_KEYS}, view, row, col, p, i + 1 AS i, {{{_STEP}}} AS v
    FROM (SELECT *, sqrt(v.a * v.a + v.b * v.b + v.c * v.c) AS n FROM s_fold WHERE i < len(p)) f"""
STEPS["s_kinds"] = f"""SELECT {_KEYS}, view, row, col, part, CASE part WHEN 0 THEN v.a WHEN 1 THEN v.b WHEN 2 THEN v.c WHEN 3 THEN 1 - m ELSE max(m) OVER (PARTITION BY {_KEYS}, view) - m END AS value
    FROM (SELECT *, v.s / len(p) AS m FROM s_fold WHERE i = len(p)) f, (VALUES (0), (1), (2), (3), (4)) k(part)"""
STEPS["s_broad"] = f"""SELECT {_KEYS}, view, part, greatest(part, 2) AS kind, row + i AS row, col + j AS col, max(value) AS value FROM s_kinds, (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j)
    WHERE row + i BETWEEN 0 AND {SIZE - 1} AND col + j BETWEEN 0 AND {SIZE - 1} GROUP BY ALL"""
STEPS["s_bytes"] = f"""SELECT {_KEYS}, view, part, row, col, CAST(CASE WHEN hi > lo THEN round_even(255 * (value - lo) / (hi - lo), 0) ELSE 0 END AS INT) AS value FROM (
    SELECT *, CASE WHEN missing THEN least(lo0, 0) ELSE lo0 END AS lo, CASE WHEN missing THEN greatest(hi0, 0) ELSE hi0 END AS hi FROM (
    SELECT *, min(value) OVER w AS lo0, max(value) OVER w AS hi0, count(*) OVER w < CASE WHEN kind = 2 THEN 3 ELSE 1 END * {SIZE * SIZE} AS missing FROM s_broad WINDOW w AS (PARTITION BY {_KEYS}, view, kind)) q) r"""
for _n, _of in ((3, "view = 0 AND part < 3"), (12, "part < 4"), (15, "part < 5")):
    query(f"i10_describe_{_n}", f"SELECT {_KEYS}, view * {_n // 3} + part AS channel, row, col, value FROM s_bytes WHERE value <> 0 AND {_of}")(
        lambda s, d, n=_n: described(s, d, n))
query("i5_normals_image", f"SELECT {_KEYS}, row, col, part, CASE part WHEN 0 THEN v.a WHEN 1 THEN v.b ELSE v.c END AS value FROM s_fold, (VALUES (0), (1), (2)) k(part) WHERE i = len(p) AND view = 0")(
    lambda s, d: raster.normals_image(celled(s, d)))
shadow = lambda s, d: raster.shadow_voxels(near_samples(s, d), fixture(s, d, "fx_viewpoints"), 60_000, 3000)
STEPS["s_voxels"] = """SELECT DISTINCT cloud_id, sample_id, cam_id, CAST(trunc((x + far * dx) / 3000) AS BIGINT) AS ix, CAST(trunc((y + far * dy) / 3000) AS BIGINT) AS iy, CAST(trunc((z + far * dz) / 3000) AS BIGINT) AS iz FROM (
    SELECT r.cloud_id, r.sample_id, c.cam_id, x, y, z, (k + 0.5::DOUBLE) / 20 * 60000 AS far, (mx - vx) / len AS dx, (my - vy) / len AS dy, (mz - vz) / len AS dz FROM s_radius r JOIN (
    SELECT m.*, v.*  EXCLUDE (cloud_id), sqrt((mx - vx) * (mx - vx) + (my - vy) * (my - vy) + (mz - vz) * (mz - vz)) AS len FROM (SELECT cloud_id, sample_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, max(cam0) AS c0, max(cam1) AS c1 FROM s_radius GROUP BY ALL) m
    JOIN fx_viewpoints v ON v.cloud_id = m.cloud_id AND (v.cam_id = 0 AND c0 = 1 OR v.cam_id = 1 AND c1 = 1)) c ON r.cloud_id = c.cloud_id AND r.sample_id = c.sample_id, (SELECT unnest(generate_series(0, 19)) AS k) g) q"""
query("i11_shadow_voxels", "SELECT cloud_id, sample_id, cam_id, count(*) AS n, CAST(sum(ix) AS BIGINT) AS ix, CAST(sum(iy) AS BIGINT) AS iy, CAST(sum(iz) AS BIGINT) AS iz FROM s_voxels GROUP BY ALL")(
    lambda s, d: shadow(s, d).groupBy("cloud_id", "sample_id", "cam_id").agg(F.count("*").alias("n"), *[F.sum(f"i{c}").alias(f"i{c}") for c in "xyz"]))
query("i12_shadow_intersection", "SELECT v.cloud_id, v.sample_id, ix, iy, iz FROM s_voxels v JOIN (SELECT cloud_id, sample_id, count(DISTINCT cam_id) AS m FROM s_voxels GROUP BY ALL) c ON v.cloud_id = c.cloud_id AND v.sample_id = c.sample_id GROUP BY v.cloud_id, v.sample_id, ix, iy, iz, m HAVING count(*) = m")(lambda s, d: raster.shadow_intersection(shadow(s, d)))
query("i13_voxels_to_points", "SELECT DISTINCT cloud_id, sample_id, ix * 3000 AS x, iy * 3000 AS y, iz * 3000 AS z FROM s_voxels")(
    lambda s, d: raster.voxels_to_points(shadow(s, d).select("cloud_id", "sample_id", "ix", "iy", "iz").distinct(), 3000, 0.0).select("cloud_id", "sample_id", *[F.col(c).cast("long").alias(c) for c in "xyz"]))

# data sets
_MD5 = "md5(concat('42:', CAST({} AS VARCHAR)))"
query("t3_subsample_uniform", f"SELECT cloud_id, point_id FROM (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY {_MD5.format('point_id')}, point_id) AS k FROM fx_points) q WHERE k <= 50")(lambda s, d: dataset.subsample_uniform(fixture(s, d, "fx_points"), 50).select("cloud_id", "point_id"))
query("t4_subsample_samples", f"SELECT cloud_id, sample_id FROM (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY {_MD5.format('sample_id')}, sample_id) AS k FROM fx_samples) q WHERE k <= 3")(lambda s, d: dataset.subsample_samples(fixture(s, d, "fx_samples"), 3).select("cloud_id", "sample_id"))
STEPS["s_draws"] = "SELECT c.cloud_id, draw, n.sample_id FROM (SELECT cloud_id, m, draw, (draw * 2654435761 + 42) % m AS at FROM (SELECT cloud_id, count(*) AS m FROM fx_samples GROUP BY ALL) a, (SELECT unnest(generate_series(1, 8)) AS draw) g) c JOIN (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY sample_id) - 1 AS at FROM fx_samples) n ON c.cloud_id = n.cloud_id AND c.at = n.at"
query("t5_subsample_indices", "SELECT cloud_id, CAST(draw AS INT) AS draw, sample_id FROM s_draws")(lambda s, d: dataset.subsample_indices(fixture(s, d, "fx_samples"), 8).select("cloud_id", "draw", "sample_id"))


def t6_subsample(s, d):
    """Samples of even clouds, points of clouds without; ids are given for clouds with samples only, as the SQL knows no draws of ids."""
    points, samples = fixture(s, d, "fx_points"), fixture(s, d, "fx_samples").where("cloud_id % 2 = 0")
    return dataset.subsample(points, samples, points.select("cloud_id", "point_id").join(samples.select("cloud_id"), "cloud_id", "left_semi"), 4)


query("t6_subsample", f"SELECT cloud_id, 'sample' AS kind, sample_id AS id FROM (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY {_MD5.format('sample_id')}, sample_id) AS k FROM fx_samples WHERE cloud_id % 2 = 0) q WHERE k <= 4 UNION ALL SELECT cloud_id, 'point', point_id FROM (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY {_MD5.format('point_id')}, point_id) AS k FROM fx_points WHERE cloud_id NOT IN (SELECT cloud_id FROM fx_samples WHERE cloud_id % 2 = 0)) p WHERE k <= 4")(
    t6_subsample)
STEPS["s_box"] = f"SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY point_id) - 1 AS at FROM fx_points WHERE {_sides('x', 'y', 'z', False)}"
query("t8_draw_uniform", "SELECT c.cloud_id, CAST(draw AS INT) AS draw, point_id FROM (SELECT cloud_id, m, draw, (draw * 2654435761 + 42) % m AS at FROM (SELECT cloud_id, count(*) AS m FROM s_box GROUP BY ALL) a, (SELECT unnest(generate_series(1, 8)) AS draw) g) c JOIN s_box n ON c.cloud_id = n.cloud_id AND c.at = n.at")(lambda s, d: dataset.draw_uniform(fixture(s, d, "fx_points"), BOX, 8).select("cloud_id", "draw", "point_id"))
centres = lambda s, d: fixture(s, d, "fx_samples").select("cloud_id", F.col("sample_id").alias("centre_id"), *[F.col(f"s{c}").alias(f"c{c}") for c in "xyz"])
_U = lambda seed: f"((('0x' || substr(md5(concat_ws(':', '{seed}', cloud_id, draw)), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"
query("t9_draw_sum_of_gaussians", "SELECT d.cloud_id, CAST(draw AS INT) AS draw, d.sample_id AS centre_id, " + ", ".join(f"round(s{c} + sqrt(-2 * ln({_U(f'42{c}u')})) * cos(6.283185307179586::DOUBLE * {_U(f'42{c}v')}) * 20000, 2) AS {c}" for c in "xyz") + " FROM (SELECT d.*, sx, sy, sz FROM s_draws d JOIN fx_samples s ON d.cloud_id = s.cloud_id AND d.sample_id = s.sample_id) d")(
    lambda s, d: dataset.draw_sum_of_gaussians(centres(s, d), 20_000, 8).select("cloud_id", "draw", "centre_id", *[F.round(c, 2).alias(c) for c in "xyz"]))
query("t10_draw_max_of_gaussians")(lambda s, d: dataset.draw_max_of_gaussians(centres(s, d), 20_000, 8))
inst = lambda s, d: fixture(s, d, "fx_instances")
query("a18_label_counts", "SELECT CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS positives, CAST(sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS BIGINT) AS negatives FROM fx_instances")(lambda s, d: dataset.label_counts(inst(s, d)))
query("a19_accuracy", "SELECT round(avg(CASE WHEN pred = label THEN 100.0::DOUBLE ELSE 0 END), 4) AS accuracy FROM fx_preds")(lambda s, d: dataset.accuracy(fixture(s, d, "fx_preds")).select(*r4("accuracy")))
query("a20_block_loss", "SELECT CAST(floor(batch / 100.0) AS BIGINT) AS block, round(avg(loss), 4) AS loss FROM fx_losses GROUP BY 1")(lambda s, d: dataset.block_loss(fixture(s, d, "fx_losses"), 100).select("block", *r4("loss")))
query("t11_shuffle_dataset", f"SELECT id, view_id, label, {_MD5.format('id')} AS shuffle_key FROM fx_instances")(lambda s, d: dataset.shuffle_dataset(inst(s, d)))
offset = lambda s, d: fixture(s, d, "fx_losses").withColumnRenamed("batch", "offset")
query("t12_truncate_dataset", "SELECT batch AS offset, loss FROM fx_losses WHERE batch < 5000")(lambda s, d: dataset.truncate_dataset(offset(s, d), 5000))
query("t13_block_ids", "SELECT batch AS offset, loss, batch // 800 AS block FROM fx_losses")(lambda s, d: dataset.block_ids(offset(s, d), 800))
_BALANCED = "SELECT id, view_id, label FROM (SELECT i.*, row_number() OVER (PARTITION BY view_id, label ORDER BY id) AS k, least((SELECT count(*) FROM fx_instances p WHERE p.view_id = i.view_id AND label = 1), (SELECT count(*) FROM fx_instances p WHERE p.view_id = i.view_id AND label <> 1), 10) AS m FROM fx_instances i) q WHERE k <= m"
query("t14_balance", _BALANCED)(lambda s, d: dataset.balance(inst(s, d), 20))
_SPLIT = "CASE WHEN view_id IN (0, 5, 10, 15) THEN 'test' ELSE 'train' END AS split"
query("t15_split_by_view", f"SELECT id, view_id, label, {_SPLIT} FROM fx_instances")(lambda s, d: dataset.split_by_view(inst(s, d), (0, 5, 10, 15)))
query("c7_build_training_set", f"SELECT id, view_id, label, {_SPLIT}, {_MD5.format('id')} AS shuffle_key FROM ({_BALANCED}) b")(lambda s, d: pipelines.build_training_set(inst(s, d), 20, (0, 5, 10, 15)))
query("t16_resample_until")(lambda s, d: dataset.resample_until(lambda views, k: dataset.subsample_uniform(inst(s, d).join(views, "view_id").withColumn("cloud_id", F.col("view_id")), 20, 42 + k, "id").drop("cloud_id"), inst(s, d).select("view_id").distinct(), 12, 4))
query("p23_normalise_pixels", "SELECT vec_id, " + ", ".join(f"CAST(round(CAST(embedding[{a}] AS DOUBLE) / 256 * 1000000) AS BIGINT) AS i{b}" for a, b in ((1, 0), (5, 1), (2, 16), (64, 63))) + " FROM embeddings")(
    lambda s, d: dataset.normalise_pixels(s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("image")), 4, 4).select("vec_id", *[F.round(F.col("image")[i] * 1_000_000).cast("long").alias(f"i{i}") for i in (0, 1, 16, 63)]))
query("s6_build_manifest", "SELECT DISTINCT source AS name, CAST(view AS INT) AS view, 'scans/' || source || '_' || view || '.pcd' AS cloud, 'scans/' || source || '_gt.pcd' AS mesh, 'scans/' || source || '_gt_normals.csv' AS normals FROM documents, (SELECT unnest(generate_series(1, 20)) AS view) v")(
    lambda s, d: io.build_manifest(s.read.parquet(f"{d}/documents.parquet").select(F.col("source").alias("name")).distinct(), 20, "scans/"))

# alignment
_M = "array(c, -s, 0, tx, s, c, 0, ty, 0, 0, 1, tz, 0, 0, 0, 1)"
scan_poses = lambda s, d: fixture(s, d, "fx_scan_poses").select(F.col("object_id").alias("object"), "angle", F.expr(_M).alias("m"))
calibration = lambda s, d: fixture(s, d, "fx_calibration").select(F.col("object_id").alias("object"), "camera", F.expr(_M).alias("m"))
transforms = lambda s, d: align.pose_transform(scan_poses(s, d), calibration(s, d))
STEPS["s_moves"] = """SELECT p.object_id, k.camera, p.angle, p.c * k.c + p.s * k.s AS m0, p.c * k.s - p.s * k.c AS m1, p.c * -(k.c * k.tx + k.s * k.ty) - p.s * -(-k.s * k.tx + k.c * k.ty) + p.tx AS m3,
    p.s * k.c - p.c * k.s AS m4, p.s * k.s + p.c * k.c AS m5, p.s * -(k.c * k.tx + k.s * k.ty) + p.c * -(-k.s * k.tx + k.c * k.ty) + p.ty AS m7, p.tz - k.tz AS m11 FROM fx_scan_poses p JOIN fx_calibration k ON p.object_id = k.object_id"""
query("j3_pose_transform", "SELECT * FROM s_moves")(lambda s, d: transforms(s, d).select(F.col("object").alias("object_id"), "camera", "angle", *[F.col("m")[i].cast("long").alias(f"m{i}") for i in (0, 1, 3, 4, 5, 7, 11)]))
scans = lambda s, d: fixture(s, d, "fx_points").select((F.col("cloud_id") % 5).alias("object"), (F.col("point_id") % 5).alias("camera"), "point_id", "x", "y", "z")
STEPS["s_moved"] = "SELECT q.object_id, q.camera, angle, point_id, m0 * x + m1 * y + m3 AS x, m4 * x + m5 * y + m7 AS y, z + m11 AS z FROM (SELECT cloud_id % 5 AS object_id, point_id % 5 AS camera, point_id, x, y, z FROM fx_points) q JOIN s_moves m ON q.object_id = m.object_id AND q.camera = m.camera"
whole = lambda df: df.select(F.col("object").alias("object_id"), "camera", "angle", "point_id", *[F.col(c).cast("long").alias(c) for c in "xyz"])
query("j4_apply_transform", "SELECT * FROM s_moved")(lambda s, d: whole(align.apply_transform(scans(s, d).join(transforms(s, d).select("object", "camera", "angle"), ["object", "camera"]), transforms(s, d))))
query("u2_merge_views", "SELECT object_id, angle, camera AS cam_id, m3 AS vx, m7 AS vy, m11 AS vz FROM s_moves")(lambda s, d: align.merge_views(scans(s, d).withColumn("angle", F.lit(0)), transforms(s, d))[1].select(F.col("object").alias("object_id"), "angle", "cam_id", *[F.col(f"v{c}").cast("long").alias(f"v{c}") for c in "xyz"]))
query("c8_align_scans", "SELECT object_id, angle, count(*) AS n, CAST(sum(x) AS BIGINT) AS x, CAST(sum(y) AS BIGINT) AS y, CAST(sum(z) AS BIGINT) AS z FROM s_moved GROUP BY ALL")(
    lambda s, d: pipelines.align_scans(scans(s, d).join(fixture(s, d, "fx_scan_poses").select(F.col("object_id").alias("object"), "angle"), "object"), scan_poses(s, d), calibration(s, d))[0].groupBy(F.col("object").alias("object_id"), "angle").agg(F.count("*").alias("n"), *[F.sum(c).cast("long").alias(c) for c in "xyz"]))

# scoring
images = lambda s, d: s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("image"))
query("m1_linear_score", "SELECT vec_id, round(" + " + ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) * {i % 7 - 3}" for i in range(64)) + ", 5) AS score FROM embeddings")(lambda s, d: scoring.linear_score(images(s, d), [i % 7 - 3 for i in range(64)]).select("vec_id", F.round("score", 5).alias("score")))


def net(size: int = 16, channels: int = 1) -> scoring.Scorer:
    """A small network of the usual shape with seeded weights."""
    import numpy as np

    rng = np.random.default_rng(3)
    flat_size = 8 * (((size - 4) // 2 - 4) // 2) ** 2
    shapes = {"w1": (4, channels, 5, 5), "b1": 4, "w2": (8, 4, 5, 5), "b2": 8, "w3": (flat_size, 20), "b3": 20, "w4": (20, 2), "b4": 2}
    return scoring.lenet({k: rng.normal(0, 0.2, v) for k, v in shapes.items()}, size, channels, relu_conv=True)


query("m2_lenet_score")(lambda s, d: scoring.score(images(s, d).select("vec_id", F.concat(*["image"] * 4).alias("image")), net()).select("vec_id", "score"))
features = lambda s, d: images(s, d).join(s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", (F.col("label") % 2).cast("double").alias("label")), "vec_id").select("vec_id", "label", *[F.col("image")[i].alias(f"f{i}") for i in range(16)])


def m4_evaluate(s, d):
    """Train on four fifths of the vectors, test on the rest."""
    rows = features(s, d).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(5)))
    model = scoring.train_scorer(rows.where("part > 0"), [f"f{i}" for i in range(16)], maxIter=20)
    return scoring.evaluate_scorer(model, rows.where("part = 0"))


query("m4_evaluate_scorer")(m4_evaluate)
query("m5_select_best", "SELECT arg_max(model_id, (accuracy, -model_id)) AS model_id, max(accuracy) AS accuracy FROM (SELECT label AS model_id, round(avg(CASE WHEN embedding[1] > 0 THEN 100.0::DOUBLE ELSE 0 END), 4) AS accuracy FROM embeddings GROUP BY label) q")(
    lambda s, d: scoring.select_best(s.read.parquet(f"{d}/embeddings.parquet").groupBy(F.col("label").alias("model_id")).agg(F.round(F.avg(F.when(F.col("embedding")[0] > 0, 100.0).otherwise(0.0)), 4).alias("accuracy"))))
query("c1_preprocess", f"SELECT cloud_id, x, y, z, n_points FROM (SELECT cloud_id, lx + (x - lx) // 3000 * 3000 AS x, ly + (y - ly) // 3000 * 3000 AS y, lz + (z - lz) // 3000 * 3000 AS z, count(*) AS n_points FROM (SELECT * FROM fx_points_dirty WHERE x IS NOT NULL AND {_sides('x', 'y', 'z')}) n JOIN (SELECT cloud_id, min(x) AS lx, min(y) AS ly, min(z) AS lz FROM fx_points_dirty WHERE x IS NOT NULL AND {_sides('x', 'y', 'z')} GROUP BY ALL) b USING (cloud_id) GROUP BY ALL) q")(
    lambda s, d: pipelines.preprocess(fixture(s, d, "fx_points_dirty"), fixture(s, d, "fx_viewpoints"), BOX, 3000).select("cloud_id", "x", "y", "z", "n_points"))
query("c1_preprocess_full")(lambda s, d: pipelines.preprocess(cams(fixture(s, d, "fx_normals")).drop("cam0", "cam1"), fixture(s, d, "fx_viewpoints"), BOX, 3000, R_NORMAL, (K, 12_000, 2), 10_000, 30).select("cloud_id", "point_id", *r4("nx", "ny", "nz"), "sample"))

# detection: the linear scorer's scores are whole numbers, so that SQL can rank as Spark does
REACH = Box(-120_000, 120_000, -120_000, 120_000, -120_000, 120_000)
WIDTHS = (5_000, 100_000)
SCORER = [i % 7 - 3 for i in range(SIZE * SIZE)]
TURNS = ((1, 0, 0, 0, 1, 0, 0, 0, 1), (0, -1, 0, 1, 0, 0, 0, 0, 1), (-1, 0, 0, 0, -1, 0, 0, 0, 1), (0, 1, 0, -1, 0, 0, 0, 0, 1))


def turned(samples):
    """The four quarter turns about z at every sample, as the fixture has them."""
    every = F.array(*[F.struct(F.lit(k).alias("orient"), *[F.lit(x).alias(c) for c, x in zip(poses.R, r, strict=True)]) for k, r in enumerate(TURNS)])
    return samples.withColumn("t_", F.explode(every)).select(*samples.columns, "t_.*")


def obj(s, d):
    return fixture(s, d, "fx_obj").withColumns({c: F.col(c) / 1000 for c in ("nx", "ny", "nz")})


def by_weights(images):
    return scoring.linear_score(images, SCORER)


def _hand_in(c: str) -> str:
    i = "xyz".index(c)
    at = f"p{c} + 60000 * r{i}1, p{c} - 60000 * r{i}1, p{c} + 60000 * r{i}0 + 60000 * r{i}1, p{c} - 60000 * r{i}0"
    return f"least({at}) >= -120000 AND greatest({at}) <= 120000"


_AT = ", ".join(f"r{i}0 * (top - 60000) + r{i}1 * ((slot_l + 10000 + slot_r) / 2) + s{c} AS p{c}" for i, c in enumerate("xyz"))
STEPS["d_cands"] = f"SELECT *, top - 60000 AS bottom FROM (SELECT p.*, slot_l, slot_r, top, width, label, {_AT} FROM fx_poses p JOIN s_fit USING ({_KEYS}) JOIN s_deep USING ({_KEYS}) JOIN s_width USING ({_KEYS}) JOIN s_label USING ({_KEYS})) q WHERE width >= 5000 AND width <= 100000 AND {' AND '.join(map(_hand_in, 'xyz'))}"
STEPS["d_unit"] = STEPS["s_unit"].replace("SELECT n.*, -50000 AS bottom, (slot_l + 10000 + slot_r) / 2 AS centre FROM s_held n", f"SELECT n.*, c.bottom, (c.slot_l + 10000 + c.slot_r) / 2 AS centre FROM s_neigh n JOIN (SELECT {_KEYS}, bottom, slot_l, slot_r FROM d_cands) c USING ({_KEYS})")
for _new, _old in (("d_cells", "s_cells"), ("d_depth", "s_depth"), ("d_wide", "s_wide")):
    STEPS[_new] = re.sub(r"\bs_(unit|cells|depth)\b", r"d_\1", STEPS[_old])
STEPS["d_u8"] = _U8.replace("s_wide", "d_wide")
STEPS["d_told"] = f"SELECT {_KEYS}, CAST(sum(value) AS BIGINT) AS total, CAST(sum(value * ((row * {SIZE} + col) % 7 - 3)) AS BIGINT) AS score FROM d_u8 WHERE value <> 0 GROUP BY ALL"


def filtered(s, d):
    found = pipelines.generate_candidates(fixture(s, d, "fx_samples"), fixture(s, d, "fx_poses"), obj(s, d), HAND, P, 5000, 20.0, 6, 3000)
    return spatial.cut_lineage(pipelines.filtered_candidates(found, HAND, REACH, WIDTHS))


def c4_describe(s, d):
    """The images of all candidates in the workspace, told by their sum and by a weighted sum."""
    images = pipelines.describe_candidates(filtered(s, d), fixture(s, d, "fx_obj"), IMAGE, 1, HAND)
    total = F.aggregate("image", F.lit(0).cast("long"), lambda n, v: n + v)
    return by_weights(images).select(*poses.POSE, total.alias("total"), F.col("score").cast("long").alias("score"))


query("c4_describe_candidates", "SELECT * FROM d_told")(c4_describe)


def detected(s, d, **more):
    """Ranked poses of every cloud, the whole way from its samples."""
    options = {"placements": P, "step": 5000, "friction": 20.0, "viable": 6, "near": 3000}
    return pipelines.detect(obj(s, d), fixture(s, d, "fx_samples"), fixture(s, d, "fx_poses"), HAND, IMAGE, 1, by_weights, 5, REACH, WIDTHS, **options, **more)


query("c3_detect", f"SELECT * FROM (SELECT {_KEYS}, score, row_number() OVER (PARTITION BY cloud_id ORDER BY score DESC, sample_id, orient) AS rank FROM d_told) q WHERE rank <= 5")(
    lambda s, d: detected(s, d).select("cloud_id", "cand_id.sample_id", "cand_id.orient", F.col("score").cast("long").alias("score"), "rank"))
query("c3_detect_upward", f"SELECT * FROM (SELECT {_KEYS}, score, row_number() OVER (PARTITION BY cloud_id ORDER BY score DESC, sample_id, orient) AS rank FROM d_told JOIN (SELECT {_KEYS}, r00 FROM fx_poses) r USING ({_KEYS}) WHERE r00 = 1) q WHERE rank <= 5")(
    lambda s, d: detected(s, d, direction=(1, 0, 0), most_angle=0.5).select("cloud_id", "cand_id.sample_id", "cand_id.orient", F.col("score").cast("long").alias("score"), "rank"))
# the fixture's hands all have the axis z
STEPS["d_best"] = f"""SELECT * FROM (SELECT cloud_id, sample_id, orient, px, py, pz, t.score, row_number() OVER (PARTITION BY cloud_id ORDER BY t.score DESC, sample_id, orient) AS rank FROM d_cands c JOIN d_told t USING ({_KEYS})) q WHERE rank <= 5"""
STEPS["d_clusters"] = """SELECT i.cloud_id, i.sample_id, i.orient, avg(j.px) AS px, avg(j.score) - 2.576 * stddev_pop(j.score) / sqrt(count(*)) AS score
    FROM d_best i JOIN d_best j ON i.cloud_id = j.cloud_id AND (i.sample_id <> j.sample_id OR i.orient <> j.orient)
    WHERE (j.px - i.px) * (j.px - i.px) + (j.py - i.py) * (j.py - i.py) + (j.pz - i.pz) * (j.pz - i.pz) <= 2500000000
    AND (j.px - i.px) * (j.px - i.px) + (j.py - i.py) * (j.py - i.py) <= 900000000 GROUP BY ALL HAVING count(*) >= 2"""
query("c3_detect_clustered", """SELECT cloud_id, sample_id, orient, round(px, 2) AS px, round(score, 3) AS score FROM (SELECT * FROM d_clusters UNION ALL
    SELECT cloud_id, sample_id, orient, px, score FROM d_best b WHERE (SELECT count(*) FROM d_clusters c WHERE c.cloud_id = b.cloud_id) <= 3) q""")(
    lambda s, d: detected(s, d, clusters=2, limits=WIDE).select("cloud_id", "cand_id.sample_id", "cand_id.orient", F.round("px", 2).alias("px"), F.round("score", 3).alias("score")))


def rounds(s, d, nearest_only: bool):
    first = fixture(s, d, "fx_samples").select("cloud_id", "sample_id", *[F.col(f"s{c}").cast("double").alias(f"s{c}") for c in "xyz"])
    return pipelines.detect_iterative(obj(s, d), first, turned, HAND, 2 if nearest_only else 1, 6, 5_000, REACH, WIDTHS, nearest_only=nearest_only, placements=P, step=5000, friction=20.0, viable=6, near=3000)


query("u4_accumulate_rounds")(lambda s, d: rounds(s, d, True).select(*poses.POSE, "round", "label", *[F.round(c, 2).alias(c) for c in ("px", "py", "pz", "width")]))
query("c5_detect_iterative")(lambda s, d: pipelines.best_of_rounds(rounds(s, d, False), obj(s, d), HAND, IMAGE, 1, by_weights, -100_000, 5).select("cloud_id", "cand_id.sample_id", "cand_id.orient", F.round("score", 3).alias("score"), "rank"))


def c7_whole(s, d):
    """From scans to a shuffled, balanced, split training set, the images told by their sums."""
    views = cams(fixture(s, d, "fx_obj").join(fixture(s, d, "fx_normals").select("cloud_id", "point_id", "cam0", "cam1"), ["cloud_id", "point_id"])).select("cloud_id", "point_id", "x", "y", "z", "cams")
    told = pipelines.training_instances(views, mesh(s, d), fixture(s, d, "fx_viewpoints"), turned, HAND, IMAGE, 1, REACH, WIDTHS, 2000, R_NORMAL, 6, 2, 2, 20.0, 1, 20_000, placements=P, step=5000)
    total = F.aggregate("image", F.lit(0).cast("long"), lambda n, v: n + v)
    return pipelines.build_training_set(told, 20, (0, 5, 10, 15)).select("view_id", "id", "label", "split", "round", total.alias("total"))


query("c7_training_set_from_scans")(c7_whole)


def m3_train(s, d):
    """Scores of a model fitted on four fifths of the vectors, for all of them."""
    rows = features(s, d).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(5)))
    model = scoring.train_scorer(rows.where("part > 0"), [f"f{i}" for i in range(16)], maxIter=20)
    return model.transform(rows).select("vec_id", F.col("prediction").cast("int").alias("prediction"))


query("m3_train_scorer")(m3_train)
