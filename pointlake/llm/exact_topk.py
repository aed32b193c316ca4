"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation.

Queries and candidates are dealt into blocks; every pair of a query block and a candidate block is one
group. In a group, each dimension is a term with a posting list of (candidate, weight); the weights of the
query rows that hold the term scatter the list into dense score arrays. A partition selection keeps the k
best of the block for each query, and a window over the few survivors merges the blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

QUERY_STRIP = 64
SPARSE = 0.5


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as packed doubles; those that take no part are left out."""
    for batch in batches:
        lists = batch.column(1)
        at = lists.offsets.to_numpy()
        values = lists.values.cast(pa.float64())
        x = values.fill_null(np.nan).to_numpy(zero_copy_only=False)
        bad = np.r_[0, np.cumsum(~np.isfinite(x))]
        known = lists.is_valid().to_numpy(zero_copy_only=False) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        keep = np.flatnonzero(known & (bad[at[:-1]] == bad[at[1:]]))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array([x[at[i] : at[i + 1]].tobytes() for i in keep], pa.binary())], names=["vec_id", "v"])


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): 64-bit integers where they hold all of it, Python's own beyond."""
    if np.abs(x).max(initial=0) * scale < 2.0**62:
        return np.floor(scale * x).astype(np.int64)
    return np.array([math.floor(scale * v) if abs(v) < 2.0**52 else scale * int(v) for v in x.ravel()], object).reshape(x.shape)


def _matrix(column: pa.ChunkedArray, scale: int) -> np.ndarray:
    rows = [np.frombuffer(b, np.float64) for b in column.to_pylist()]
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return whole_numbers(out, scale)


def scores_by_term(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of all rows of ``q`` with all rows of ``c``, one term after another."""
    terms = min(q.shape[1], c.shape[1])
    most = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * max(1, terms)
    kind = np.int32 if most < 2**31 else np.int64 if most < 2**63 else object
    acc = np.zeros((len(q), len(c)), kind)
    q, c = q.astype(kind), np.ascontiguousarray(c.T).astype(kind)
    part = np.empty_like(acc)
    for t in range(terms):
        ids, rows = np.flatnonzero(c[t]), np.flatnonzero(q[:, t])
        if not len(ids) or not len(rows):
            continue
        if len(ids) < SPARSE * c.shape[1] or len(rows) < SPARSE * len(q) or kind is object:
            acc[np.ix_(rows, ids)] += np.multiply.outer(q[rows, t], c[t, ids])
        else:  # nearly full: the zero weights add nothing
            acc += np.multiply.outer(q[:, t], c[t], out=part)
    return acc


def best_of_block(score: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best of each row, ties to the smaller id. ``ids`` ascend; ``own`` is each row's id."""
    n = len(ids)
    row, col = [], []
    fits = score.dtype != object and int(np.abs(score).max(initial=0)) < 2**62 // max(1, n)
    for i in range(len(score)):
        s = score[i]
        other = ids != own[i] if own[i] in ids[np.searchsorted(ids, own[i]) : np.searchsorted(ids, own[i]) + 1] else None
        if fits:
            key = s.astype(np.int64) * n + (n - 1 - np.arange(n))
            if other is not None:
                key[~other] = np.iinfo(np.int64).min
            take = np.argpartition(key, n - k)[n - k :] if n > k else np.arange(n)
        else:
            take = np.array(sorted(range(n), key=lambda j: (-held(int(s[j])), ids[j]))[: k + n - (n if other is None else int(other.sum()))], np.int64)
        if other is not None:
            take = take[other[take]]
        row.append(np.full(len(take), i))
        col.append(take)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (row, col))


def held(score: int) -> int:
    """``score`` within 64 bits."""
    return max(-(2**63), min(2**63 - 1, score))


def _search(k: int, scale: int):
    def run(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right["vec_id"].to_numpy(), kind="stable")
        q, c = _matrix(left["v"], scale), _matrix(right["v"], scale)[order]
        q_id, c_id = left["query_id"].to_numpy(), right["vec_id"].to_numpy()[order]
        out = []
        for a in range(0, len(q), QUERY_STRIP) if len(c) else ():
            score = scores_by_term(q[a : a + QUERY_STRIP], c)
            i, j = best_of_block(score, c_id, q_id[a : a + QUERY_STRIP], k)
            exact = score[i, j]
            if exact.dtype == object:
                exact = np.array([held(x) for x in exact], np.int64)
            out.append(pa.table({"query_id": q_id[a + i], "vec_id": c_id[j], "score": exact.astype(np.int64)}))
        return pa.concat_tables(out) if out else pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})

    return run


def exact_topk(vectors: DataFrame, is_query: str, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = 4096, candidate_block: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score of the k highest integer inner products for each query.

    ``is_query`` is an SQL condition on the column ``vec_id``. A component x counts as floor(scale * x) of its
    double, exactly. Candidates are all rows with another id; ties go to the smaller id; fewer than k candidates are all
    returned. Rows without id, with a null vector, or with null or non-finite components take no part. A shorter vector
    counts as filled up with zeros. Rows that repeat an id are candidates each; as queries, the one that sorts first
    counts. Scores beyond 64 bits count as the bound. Other columns are not read; an empty table gives an empty one.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = cut(rows.mapInArrow(_rows, "vec_id long, v binary"), "topk-rows")
    n, asked = rows.agg(F.count("*"), F.count(F.when(F.expr(is_query), 1))).first()
    blocks, strips = max(1, -(-n // candidate_block)), max(1, -(-asked // query_block))
    block = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    candidates = rows.select("vec_id", "v", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(strips - 1))).alias("strip"))
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    strip = F.pmod(F.xxhash64("vec_id"), F.lit(strips)).cast("int")
    queries = queries.select(F.col("vec_id").alias("query_id"), "v", strip.alias("strip"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    met = queries.groupBy("strip", "block").cogroup(candidates.groupBy("strip", "block"))
    found = met.applyInArrow(_search(k, scale), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH x AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings WHERE vec_id IS NOT NULL),
t AS (SELECT vec_id, CAST(floor(64 * x) AS BIGINT) AS w, d FROM x WHERE vec_id NOT IN (SELECT vec_id FROM x WHERE x IS NULL OR NOT isfinite(x))),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.w * c.w) AS BIGINT) AS score FROM t q JOIN t c ON q.d = c.d AND q.vec_id <> c.vec_id
      WHERE q.vec_id % 20 = 0 GROUP BY ALL),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""
