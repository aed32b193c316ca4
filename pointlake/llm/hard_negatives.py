"""Hard negatives by coordinate pruning over buckets of like length, in the manner of LEMP.

Anchors and rows are dealt into blocks that meet once each. A block's rows stand in buckets by descending length, and
each bucket holds, for each coordinate, its rows sorted by that coordinate of their unit vectors. A search for inner products of
at least ``theta`` skips buckets too short to reach it. In the others ``theta`` asks for an angle, and so for a range of
values in each of the anchor's focus coordinates, its largest ones: an anchor's unit vector q and a row's p of angle a at most have
|acos(q_f) - acos(p_f)| <= a. Rows in the ranges of all focus coordinates are verified exactly, in whole numbers.

The first search finds each anchor's nearest rows of its own label (theta: the worst of the best so far). The second finds the rows of other
labels within the window of each positive (theta: the low end of the windows, or the worst of all windows once they are full).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .exact_topk import _rows, held, whole_numbers
from .shared import cut

LENGTH_BUCKET = 512
FOCUS = 4
_SLACK = 1e-9
_EXACT = 1 << 52


class Bucket:
    """Rows of like length with sorted coordinate lists; ``x`` holds their whole numbers."""

    def __init__(self, x: np.ndarray, length: np.ndarray):
        self.x, self.longest = x, float(length[0])
        unit = x.astype(np.float64) / np.maximum(length, 1e-300)[:, None]
        self.order = np.argsort(unit, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(unit, self.order, axis=0).T)

    def candidates(self, unit: np.ndarray, length: float, theta: float) -> np.ndarray | None:
        """Places of the rows whose product with the vector may be ``theta`` or more; None stands for all."""
        reach = length * self.longest
        if theta > reach * (1 + _SLACK):
            return np.zeros(0, np.int64)
        if theta <= 0 or reach == 0:  # shorter rows of the bucket don't ask for a smaller angle then
            return None
        angle = np.arccos(min(1.0, theta / reach)) + 1e-7
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        seen, asked = np.zeros(len(self.x), np.uint8), 0
        for f in focus:
            own = np.arccos(min(1.0, max(-1.0, unit[f])))
            low, high = np.cos(min(np.pi, own + angle)) - _SLACK, np.cos(max(0.0, own - angle)) + _SLACK
            a, b = np.searchsorted(self.sorted[f], low), np.searchsorted(self.sorted[f], high, "right")
            if b - a < len(self.x):
                seen[self.order[a:b, f]] += 1
                asked += 1
        return np.flatnonzero(seen == asked) if asked else None


def buckets(x: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, Bucket]]]:
    """(length of each row, the buckets with the places of their rows), longest first."""
    length = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    order = np.argsort(-length, kind="stable")
    return length, [(at, Bucket(x[at], length[at])) for at in (order[i : i + LENGTH_BUCKET] for i in range(0, len(order), LENGTH_BUCKET))]


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


class Block:
    """The rows of a block in buckets, with products in the narrowest numbers that hold them."""

    def __init__(self, rows: pa.Table, anchors: pa.Table, scale: int):
        width = max((len(b) // 8 for t in (rows, anchors) for b in t["v"].to_pylist()), default=0)
        self.ids, self.labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
        x, self.q = (self._matrix(t["v"], width, scale) for t in (rows, anchors))
        most = int(np.abs(x).max(initial=0)) * int(np.abs(self.q).max(initial=0)) * max(1, width)
        self.kind = np.float64 if most < _EXACT else object
        x, self.q = x.astype(self.kind), self.q.astype(self.kind)
        _, self.buckets = buckets(x)
        self.q_length = np.sqrt((self.q.astype(np.float64) ** 2).sum(axis=1))

    @staticmethod
    def _matrix(column: pa.ChunkedArray, width: int, scale: int) -> np.ndarray:
        out = np.zeros((len(column), width))
        for i, b in enumerate(column.to_pylist()):
            out[i, : len(b) // 8] = np.frombuffer(b, np.float64)
        return whole_numbers(out, scale)

    def walk(self, i: int, allowed: np.ndarray):
        """Generator of (places, scores) of rows to look at for anchor ``i``; it is sent theta for the next bucket."""
        unit = self.q[i].astype(np.float64) / max(self.q_length[i], 1e-300)
        theta = yield
        for at, bucket in self.buckets:
            found = None if self.kind is object else bucket.candidates(unit, self.q_length[i], theta)
            places = np.arange(len(at)) if found is None else found
            places = places[allowed[at[places]]]
            if len(places):
                score = bucket.x[places] @ self.q[i]
                score = np.array([held(int(s)) for s in score], np.int64) if self.kind is object else score.astype(np.int64)
                theta = yield at[places], score


def _scan(block: Block, i: int, allowed: np.ndarray, theta: float, take):
    """Feed ``take(places, scores) -> theta`` until the buckets end."""
    walk = block.walk(i, allowed)
    next(walk)
    try:
        while True:
            theta = take(*walk.send(theta))
    except StopIteration:
        pass


def _own_label(k: int, scale: int):
    """For each anchor the k first rows of its own label in the block."""

    def run(_: tuple, anchors: pa.Table, rows: pa.Table) -> pa.Table:
        block, out = Block(rows, anchors, scale), []
        ids, labels = anchors["anchor_id"].to_numpy(), anchors["label"].to_numpy()
        for i in range(len(ids)):
            best = [np.zeros(0, np.int64), np.zeros(0, np.int64)]

            def take(at: np.ndarray, score: np.ndarray) -> float:
                at, score = np.r_[best[0], at], np.r_[best[1], score]
                keep = _first(score, block.ids[at], k)
                best[:] = at[keep], score[keep]
                return float(best[1][-1]) if len(keep) == k else -np.inf

            _scan(block, i, (block.labels == labels[i]) & (block.ids != ids[i]), -np.inf, take)
            out.append(pa.table({"anchor_id": np.full(len(best[0]), ids[i]), "positive_id": block.ids[best[0]], "score": best[1]}))
        return pa.concat_tables(out) if out else pa.table({n: pa.array([], pa.int64()) for n in ("anchor_id", "positive_id", "score")})

    return run


def _other_labels(k: int, scale: int, percent: int):
    """For each positive of each anchor the k first rows of other labels in its window, of the block's."""
    names = ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")

    def run(_: tuple, anchors: pa.Table, rows: pa.Table) -> pa.Table:
        block, out = Block(rows, anchors, scale), []
        ids, labels = anchors["anchor_id"].to_numpy(), anchors["label"].to_numpy()
        for i, positives in enumerate(anchors["positives"].to_pylist()):
            told = sorted({(p["score"], p["positive_id"]) for p in positives if p["score"] >= 0})  # below zero a window is empty
            windows = [(score, -(-percent * score // 100), positive) for score, positive in told]
            best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]

            def take(at: np.ndarray, score: np.ndarray) -> float:
                for j, (high, low, _) in enumerate(windows):
                    fits = (score >= low) & (score <= high)
                    if fits.any():
                        a, s = np.r_[best[j][0], at[fits]], np.r_[best[j][1], score[fits]]
                        keep = _first(s, block.ids[a], k)
                        best[j] = a[keep], s[keep]
                return float(min(s[-1] if len(s) == k else w[1] for w, (_, s) in zip(windows, best, strict=True)))

            if windows:
                _scan(block, i, block.labels != labels[i], float(min(w[1] for w in windows)), take)
            for (high, _, positive), (at, s) in zip(windows, best, strict=True):
                out.append(pa.table(dict(zip(names, (np.full(len(at), ids[i]), np.full(len(at), positive), np.full(len(at), high), block.ids[at], s), strict=True))))
        return pa.concat_tables(out) if out else pa.table({n: pa.array([], pa.int64()) for n in names})

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with id, label and a finite vector, packed."""
    for batch in batches:
        kept = next(_rows(iter([pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(1)], names=["vec_id", "v"])])))
        ids, labels = batch.column(0).take(kept.column(0)), batch.column(2).take(kept.column(0))
        known = ids.is_valid()
        yield pa.RecordBatch.from_arrays([ids.filter(known), kept.column(1).filter(known), labels.filter(known)], names=["vec_id", "v", "label"])


def hard_negatives(
    vectors: DataFrame,
    is_anchor: str,
    label_col: str = "label",
    positives: int = 5,
    negatives: int = 5,
    percent: int = 80,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    anchor_block: int = 2048,
    row_block: int = 8192,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is an SQL condition on ``vec_id``. Scores are inner products of floor(scale * component), exact. An anchor's positives
    are the first rows with its label and another id, by higher score, then smaller id. For each of them come the first rows
    of other labels whose score is at most the positive's and at least ``percent`` hundredths of it, in the same order, ranked from 1; a positive
    below zero has none. Rows without id or label, with a null vector or null or non-finite components take no part. Shorter vectors
    count as filled up with zeros. Rows that repeat an id count each as positive and negative; as anchors the one of the smallest label counts, then
    that of the smallest packed vector. Positives of one id and one score
    have one set of negatives. Scores beyond 64 bits count as the bound. Other columns are not
    read; an empty table gives an empty one.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("long").alias("label"))
    packed = rows.where("label is not null").mapInArrow(_packed, "vec_id long, v binary, label long")
    rows = cut(packed, "mining-rows")
    n, asked = rows.agg(F.count("*"), F.count(F.when(F.expr(is_anchor), 1))).first()
    blocks, strips = max(1, -(-n // row_block)), max(1, -(-asked // anchor_block))
    block = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    every = rows.select("vec_id", "v", "label", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(strips - 1))).alias("strip")).groupBy("strip", "block")
    anchors = rows.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("m"))
    anchors = anchors.select(F.col("vec_id").alias("anchor_id"), "m.label", "m.v", F.pmod(F.xxhash64("vec_id"), F.lit(strips)).cast("int").alias("strip"))

    def meet(left: DataFrame, search, schema: str) -> DataFrame:
        dealt = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return dealt.groupBy("strip", "block").cogroup(every).applyInArrow(search, schema)

    near = meet(anchors, _own_label(positives, scale), "anchor_id long, positive_id long, score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), F.asc("positive_id"))
    near = near.withColumn("at", F.row_number().over(order)).where(F.col("at") <= positives)
    told = near.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("at", "positive_id", "score"))).alias("positives"))
    anchors = cut(anchors.join(told, "anchor_id"), "positives")
    found = meet(anchors, _other_labels(negatives, scale, percent), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id", "positive_score").orderBy(F.desc("negative_score"), F.asc("negative_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
t AS (SELECT vec_id, label, d, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS w FROM e WHERE vec_id NOT IN (SELECT vec_id FROM e WHERE x IS NULL OR NOT isfinite(x))),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, CAST(sum(a.w * b.w) AS BIGINT) AS score FROM t a JOIN t b ON a.d = b.d AND a.vec_id <> b.vec_id
      WHERE a.vec_id % 100 = 0 GROUP BY ALL),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE label = own) q WHERE k <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND s.label <> s.own WHERE 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
