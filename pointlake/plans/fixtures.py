"""Inputs of the registered queries, derived from the given tables by SQL that Spark and DuckDB both run.

Coordinates are whole micrometres, so that distances, floors and sums are exact in both.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..params import Box, Hand, Image

HAND = Hand(finger=10_000, outer=120_000, depth=60_000, height=20_000, bite=10_000)
IMAGE = Image(depth=60_000, width=100_000, height=20_000, size=20)
BOX = Box(-30_000, 30_000, -25_000, 25_000, -40_000, 40_000)
PLACEMENTS = 11
TABLES = ("region", "nation", "lineitem", "events", "documents", "embeddings", "labels")

_POINT = "l_orderkey * 10000000000 + l_partkey * 100000 + l_suppkey * 10 + l_linenumber"
VIEWS = {
    "fx_points": f"""SELECT l_suppkey AS cloud_id, {_POINT} AS point_id, CAST(round(l_quantity * 2000 - 51000) AS BIGINT) AS x,
        CAST(round(l_extendedprice - 52950) AS BIGINT) AS y, CAST(round(l_discount * 1000000 - 50000) AS BIGINT) AS z FROM lineitem""",
    "fx_obj": f"""SELECT cloud_id, point_id, x, y, z,
        CASE WHEN point_id % 4 = 0 THEN 0 WHEN abs(x) > abs(y) THEN CASE WHEN x > 0 THEN 1000 ELSE -1000 END ELSE 0 END AS nx,
        CASE WHEN point_id % 4 = 0 THEN 0 WHEN abs(x) > abs(y) THEN 0 ELSE CASE WHEN y > 0 THEN 1000 ELSE -1000 END END AS ny,
        CASE WHEN point_id % 4 = 0 THEN 1000 ELSE 0 END AS nz
        FROM (SELECT l_suppkey AS cloud_id, {_POINT} AS point_id, CAST(round(l_quantity * 800 - 20400) AS BIGINT) AS x,
              CAST(round((l_extendedprice - 52950) * (2 + l_suppkey % 9) / 10) AS BIGINT) AS y,
              CAST(round(l_discount * 1000000 - 50000) AS BIGINT) AS z FROM lineitem) q""",
    "fx_points_dirty": "SELECT cloud_id, point_id, CASE WHEN point_id % 97 = 0 THEN NULL ELSE x END AS x, y, z FROM fx_points",
    "fx_normals": """SELECT cloud_id, point_id, x, y, z,
        CASE point_id % 6 WHEN 0 THEN 1000 WHEN 1 THEN -1000 ELSE 0 END AS nx, CASE point_id % 6 WHEN 2 THEN 1000 WHEN 3 THEN -1000 ELSE 0 END AS ny,
        CASE point_id % 6 WHEN 4 THEN 1000 WHEN 5 THEN -1000 ELSE 0 END AS nz,
        CASE WHEN point_id % 3 <> 1 THEN 1 ELSE 0 END AS cam0, CASE WHEN point_id % 3 <> 0 THEN 1 ELSE 0 END AS cam1 FROM fx_points""",
    "fx_viewpoints": """SELECT DISTINCT cloud_id, 0 AS cam_id, 0 AS vx, 0 AS vy, 200000 AS vz FROM fx_points
        UNION ALL SELECT DISTINCT cloud_id, 1, 200000, 0, 0 FROM fx_points""",
    "fx_samples": "SELECT cloud_id, point_id AS sample_id, x AS sx, y AS sy, z AS sz FROM fx_obj WHERE point_id % 101 = 0",
    "fx_poses": """SELECT s.cloud_id, s.sample_id, s.sx, s.sy, s.sz, o.orient, o.r00, o.r01, o.r02, o.r10, o.r11, o.r12, o.r20, o.r21, o.r22
        FROM fx_samples s CROSS JOIN (SELECT 0 AS orient, 1 AS r00, 0 AS r01, 0 AS r02, 0 AS r10, 1 AS r11, 0 AS r12, 0 AS r20, 0 AS r21, 1 AS r22
        UNION ALL SELECT 1, 0, -1, 0, 1, 0, 0, 0, 0, 1 UNION ALL SELECT 2, -1, 0, 0, 0, -1, 0, 0, 0, 1 UNION ALL SELECT 3, 0, 1, 0, -1, 0, 0, 0, 0, 1) o""",
    "fx_cands": """SELECT cloud_id, cand_id, px, py, pz, ax / len AS ax, ay / len AS ay, az / len AS az, score FROM (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS len FROM (
        SELECT label AS cloud_id, vec_id AS cand_id, CAST(round(CAST(embedding[1] AS DOUBLE) * 100000) AS BIGINT) AS px,
        CAST(round(CAST(embedding[2] AS DOUBLE) * 100000) AS BIGINT) AS py, CAST(round(CAST(embedding[3] AS DOUBLE) * 100000) AS BIGINT) AS pz,
        CAST(embedding[4] AS DOUBLE) AS ax, CAST(embedding[5] AS DOUBLE) AS ay, CAST(embedding[6] AS DOUBLE) AS az,
        CAST(round(CAST(embedding[7] AS DOUBLE) * 1000000) AS BIGINT) AS score FROM embeddings) a) b""",
    "fx_instances": "SELECT d.doc_id AS id, CAST(substr(d.source, 4) AS INT) AS view_id, l.quality AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
    "fx_preds": "SELECT doc_id AS id, toxic AS pred, quality AS label FROM labels",
    "fx_losses": "SELECT event_id AS batch, CAST(round(value * 100) AS BIGINT) AS loss FROM events",
    "fx_scan_poses": """SELECT n_regionkey AS object_id, n_nationkey AS angle, CASE n_nationkey % 4 WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS c,
        CASE n_nationkey % 4 WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END AS s, n_nationkey * 1000 AS tx, n_nationkey * 500 AS ty, n_regionkey * 250 AS tz FROM nation""",
    "fx_calibration": """SELECT r.r_regionkey AS object_id, k.camera, CASE k.camera % 4 WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS c,
        CASE k.camera % 4 WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END AS s, k.camera * 300 AS tx, r.r_regionkey * 700 AS ty, 100 AS tz
        FROM region r CROSS JOIN (SELECT 0 AS camera UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) k""",
}


def needed(text: str, known: dict[str, str]) -> list[str]:
    """The views that ``text`` uses, in the order of their definition."""
    todo, found = [text], set()
    while todo:
        for name in set(re.findall(r"\w+", todo.pop())) & known.keys() - found:
            found.add(name)
            todo.append(known[name])
    return [n for n in known if n in found]


def with_views(text: str, known: dict[str, str] = VIEWS) -> str:
    """``text`` with the views that it uses in front."""
    names = needed(text, known)
    recursive = any(re.search(rf"\b{n}\b", known[n]) for n in names)
    return (("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(f"{n} AS ({known[n]})" for n in names) + " " if names else "") + text


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views as a DataFrame."""
    text = re.sub(r"embedding\[(\d)\]", lambda m: f"embedding[{int(m[1]) - 1}]", with_views(f"SELECT * FROM {name}"))
    used = [t for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", text)]
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})
