"""Nearest neighbours by cosine: inverted file with product-quantised residuals, reranking, and an exact check by bounds.

Fitted on a bounded sample: coarse centroids, one codebook per group of dimensions for the residuals, and, by the
sample's own exact neighbours, how many lists to probe and how many candidates of a query to rerank for the
wanted recall. Every different vector is indexed once, with the smallest ids of its copies: its list, its code, the
length of what the code leaves of it and the vector itself are written as a table.

A search deals lists into parts of about ``part_rows`` vectors: small lists share a part, a large one has several. Queries
are dealt into strips, and a group holds one strip and one part with a list that they need. It runs twice:

* First the rows of the probed lists are ranked by asymmetric distance tables and the ``rerank`` best are scored on the
  original vectors in double precision. The score of the k-th is a floor: the k nearest score as much at least.
* Then every list is met whose cone about its centroid reaches the floor, and of its rows all are scored whose distance
  table allows the floor once the length that their code leaves is added. No row that is left out can be among the
  k nearest, whatever the sample was like. What the sample decides is how high the floor is, and so the time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

SUBSPACES = 16
CODES = 256


@dataclass
class Model:
    """The fitted index: centroids (lists x dims), books (subspaces x codes x dims), probes, rerank."""

    centroids: np.ndarray
    books: np.ndarray
    probes: int
    rerank: int

    def lists(self, unit: np.ndarray) -> np.ndarray:
        return nearest(unit, self.centroids)

    def codes(self, unit: np.ndarray, which: np.ndarray) -> np.ndarray:
        rest = split(unit - self.centroids[which], len(self.books))
        return np.stack([nearest(r, b) for r, b in zip(rest, self.books, strict=True)], 1).astype(np.uint8)


def split(x: np.ndarray, parts: int) -> list[np.ndarray]:
    """Columns in ``parts`` groups of one width, filled up with zeros."""
    width = -(-x.shape[1] // parts)
    x = np.pad(x, ((0, 0), (0, width * parts - x.shape[1])))
    return [x[:, i * width : (i + 1) * width] for i in range(parts)]


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The number of the nearest centre of each row."""
    half = (centres**2).sum(1) / 2
    out = np.empty(len(x), np.int64)
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = (x[i : i + 4096] @ centres.T - half).argmax(1)
    return out


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        which = nearest(x, centres)
        order = np.argsort(which, kind="stable")
        first = np.searchsorted(which[order], np.arange(len(centres)))
        count = np.bincount(which, minlength=len(centres))
        full = count > 0
        centres[full] = np.add.reduceat(x[order], first[full]) / count[full, None]
    return centres


def fit(sample: np.ndarray, n: int, k: int, recall: float, most_lists: int = 4096, trial: int = 256, seed: int = 1) -> Model:
    """Fit on unit vectors ``sample``, standing for ``n`` rows.

    The lists are 4 times the root of ``n``, but 16 rows of the sample each at least. Half of what the recall allows
    to be lost is spent on lists that aren't probed, half on candidates that aren't reranked. The rank of a true
    neighbour among the candidates by its code is taken from the sample and carried over to ``n`` rows.
    """
    rng = np.random.default_rng(seed)
    lists = int(min(max(1, 4 * int(n**0.5)), most_lists, max(1, len(sample) // 16)))
    centroids = k_means(sample, lists, 8, rng)
    which = nearest(sample, centroids)
    books = np.stack([_full(k_means(r, min(CODES, len(r)), 6, rng)) for r in split(sample - centroids[which], SUBSPACES)])
    model = Model(centroids, books, lists, max(4 * k, 16))
    some = rng.permutation(len(sample))[:trial]
    k = min(k, len(sample) - 1)
    if k < 1:
        return model
    exact = sample[some] @ sample.T
    exact[np.arange(len(some)), some] = -np.inf
    best = np.argpartition(exact, -k, axis=1)[:, -k:]
    place = np.empty((len(some), lists), np.int64)
    order = np.argsort(-(sample[some] @ centroids.T), axis=1, kind="stable")
    place[np.arange(len(some))[:, None], order] = np.arange(lists)
    lost = (1 - recall) / 2
    upto = lambda ranks: int(np.sort(ranks)[min(len(ranks) - 1, int(np.ceil((1 - lost) * len(ranks))))]) + 1
    model.probes = min(lists, upto(place[np.arange(len(some))[:, None], which[best]].ravel()))
    codes = model.codes(sample, which)
    guess = np.stack([table_scores(q, centroids, books, codes, which) for q in sample[some]])
    guess[np.arange(len(some)), some] = -np.inf
    ranks = np.array([(guess[i] > guess[i, j]).sum() for i in range(len(some)) for j in best[i]])
    # in n rows, a true neighbour has n / sample times as many candidates ahead of it only if they lie as it does; the
    # neighbours are nearer too, so that the root of that ratio is on the safe side for the codes' error
    model.rerank = int(max(model.rerank, np.ceil(1.25 * upto(ranks) * max(1.0, n / len(sample)) ** 0.5)))
    return model


def _full(book: np.ndarray) -> np.ndarray:
    return np.concatenate([book, np.repeat(book[:1], CODES - len(book), 0)])


def table_scores(q: np.ndarray, centroids: np.ndarray, books: np.ndarray, codes: np.ndarray, which: np.ndarray) -> np.ndarray:
    tables = np.stack([b @ r[0] for b, r in zip(books, split(q[None], len(books)), strict=True)])
    return (centroids @ q)[which] + tables[np.arange(len(books)), codes].sum(1)


SLACK = 1e-9  # far above what rounding does to a bound


def _usable(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
    lists = batch.column(1)
    at = lists.offsets.to_numpy()
    values = lists.values.cast(pa.float64())
    x = values.fill_null(np.nan).to_numpy(zero_copy_only=False)
    bad = np.r_[0, np.cumsum(~np.isfinite(x))]
    known = (lists.is_valid().to_numpy(zero_copy_only=False) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)) & (bad[at[:-1]] == bad[at[1:]])
    rows = [i for i in np.flatnonzero(known) if x[at[i] : at[i + 1]].any()]
    return np.array(rows, np.int64), [x[at[i] : at[i + 1]] for i in rows]


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, x = _usable(batch)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array([r.tobytes() for r in x], pa.binary())], names=["vec_id", "v"])


def matrix(column, dims: int) -> np.ndarray:
    out = np.zeros((len(column), dims))
    for i, b in enumerate(column.to_pylist()):
        r = np.frombuffer(b, np.float64)
        out[i, : min(dims, len(r))] = r[:dims]
    return out


def unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True, initial=1e-300)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True)).clip(1e-300)


def _assign(model: Model):
    """Adds a vector's list, its code, the length of what the code leaves and the cosine to the list's centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions = unit(model.centroids)
        for batch in batches:
            if batch.num_rows:
                x = unit(matrix(batch.column(0), model.centroids.shape[1]))
                which = model.lists(x)
                codes = model.codes(x, which)
                coded = np.concatenate([b[codes[:, m]] for m, b in enumerate(model.books)], 1)[:, : x.shape[1]]
                left = np.sqrt(((x - model.centroids[which] - coded) ** 2).sum(1))
                more = [pa.array(which, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(left), pa.array((x * directions[which]).sum(1))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "list", "code", "left", "cosine"])

    return run


@dataclass
class Lists:
    """Of each list: its first part, its number of parts (0 if it is empty) and the least cosine of a row to its centroid."""

    first: np.ndarray
    many: np.ndarray
    cone: np.ndarray


def _met(model: Model, lists: Lists, q: np.ndarray, floor: np.ndarray | None) -> np.ndarray:
    """Which lists each query meets: the probed ones, or with floors those in whose cone a row may reach the floor."""
    if floor is None:
        order = np.argsort(-(q @ model.centroids.T), axis=1, kind="stable")[:, : model.probes]
        out = np.zeros((len(q), len(model.centroids)), bool)
        np.put_along_axis(out, order, True, axis=1)
    else:
        angle = np.arccos(np.clip(q @ unit(model.centroids).T, -1, 1)) - np.arccos(np.clip(lists.cone, -1, 1))
        # near 0 and pi, an angle is only as good as the root of its cosine's rounding
        out = (np.cos(np.maximum(angle - 1e-7, 0)) >= floor[:, None] - SLACK) | ~model.centroids.any(axis=1)
    return out & (lists.many > 0)


def _ask(model: Model, lists: Lists, complete: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                met = _met(model, lists, unit(matrix(batch.column(1), model.centroids.shape[1])), batch.column(2).to_numpy() if complete else None)
                parts = [np.unique(np.concatenate([np.zeros(0, np.int64), *[np.arange(lists.first[p], lists.first[p] + lists.many[p]) for p in np.flatnonzero(m)]])) for m in met]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.list_(pa.int32()))], names=["query_id", "q", "floor", "parts"])

    return run


def _deal(lists: Lists):
    """Adds the part of each row: the rows of a list with several parts are dealt in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, row = batch.column(batch.schema.get_field_index("list")).to_numpy(), batch.column(batch.schema.get_field_index("row")).to_numpy()
            part = lists.first[which] + row % lists.many[which]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int32())], names=[*batch.schema.names, "part"])

    return run


def _search(model: Model, lists: Lists, k: int, complete: bool):
    """One strip of queries against one part: the k nearest of each query that this part may add."""
    dims = model.centroids.shape[1]

    def run(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        out = [none]
        if left.num_rows and right.num_rows:
            right = right.combine_chunks()
            every = right["ids"].combine_chunks()
            ids, at = every.flatten().to_numpy(), every.offsets.to_numpy().astype(np.int64)
            at = at - at[0]
            which, rest = right["list"].to_numpy(), right["left"].to_numpy()
            codes = np.frombuffer(b"".join(right["code"].to_pylist()), np.uint8).reshape(-1, SUBSPACES)
            x, q = unit(matrix(right["v"], dims)), unit(matrix(left["q"], dims))
            q_id, floor = left["query_id"].to_numpy(), left["floor"].to_numpy()
            parts, coarse = split(q, SUBSPACES), q @ model.centroids.T
            met = _met(model, lists, q, floor if complete else None)
            for i in range(len(q)):
                own = np.zeros(len(which), np.int64)  # how many of a vector's ids are the query's
                np.add.at(own, np.searchsorted(at, np.flatnonzero(ids == q_id[i]), side="right") - 1, 1)
                take = np.flatnonzero(met[i][which] & (own < at[1:] - at[:-1]))
                if complete or len(take) > model.rerank:
                    mine = codes[take]
                    guess = coarse[i][which[take]]
                    for m in range(SUBSPACES):
                        guess += (model.books[m] @ parts[m][i])[mine[:, m]]
                    take = take[guess + rest[take] >= floor[i] - SLACK] if complete else take[np.argpartition(-guess, model.rerank)[: model.rerank]]
                score = (x[take] * q[i]).sum(1)
                if len(take) > k:
                    best = score >= np.partition(score, -k)[-k]
                    take, score = take[best], score[best]
                found = np.concatenate([np.zeros(0, np.int64), *[ids[at[j] : at[j + 1]] for j in take]])
                score = np.repeat(score, at[take + 1] - at[take])
                found, score = found[found != q_id[i]], score[found != q_id[i]]
                best = np.lexsort((found, -score))[:k]
                out.append((np.full(len(best), q_id[i]), found[best], score[best]))
        a, b, c = (np.concatenate(v) for v in zip(*out, strict=True))
        return pa.table({"query_id": a, "vec_id": b, "score": c})

    return run


def parts_of_lists(sizes: dict[int, int], most: int) -> dict[int, tuple[int, int]]:
    """For each list its first part and its number of parts; lists share a part while it has room."""
    out, part, room = {}, 0, most
    for number in sorted(sizes):
        n = -(-sizes[number] // most)
        if n > 1 or sizes[number] > room:
            part, room = part + 1, most
        out[number] = (part, n)
        part, room = (part + n, most) if n > 1 else (part, room - sizes[number])
    return out


def neighbours(
    vectors: DataFrame,
    is_query: str,
    k: int = 5,
    recall: float = 0.97,
    fit_rows: int = 20_000,
    part_rows: int = 4096,
    strip_rows: int = 1024,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k nearest, by cosine in double precision.

    ``is_query`` is an SQL condition on ``vec_id``. The index is fitted on at most ``fit_rows`` different vectors (those whose
    smallest ids have the smallest hashes) and holds every row; ``recall`` is what the first pass is to reach, the second
    one leaves out nothing. The lists are 4,096 at most. Ties go to the smaller id; rows with the query's own id aren't
    its candidates; fewer than k candidates are all returned. Rows without id and vectors
    that are null, zero or hold null or non-finite components take no part; a shorter vector counts as filled up with
    zeros. Rows that repeat an id are candidates each; as queries, the one that sorts first counts. Other columns aren't
    read. An empty table gives an empty table.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(_valid, "vec_id long, v binary")
    rows = cut(rows, "vectors")
    longest = rows.agg(F.max(F.length("v"))).first()[0]
    if not longest:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    # of copies, no more than the k + 1 smallest ids can be among the k nearest of a query that has one of them itself
    smallest = Window.partitionBy("v").orderBy("vec_id")
    copies = rows.groupBy("v", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n")).withColumn("place", F.row_number().over(smallest)).where(F.col("place") <= k + 1)
    each = copies.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("vec_id", "n"))).alias("c"))
    each = cut(each.select("v", F.flatten(F.transform("c", lambda c: F.array_repeat(c["vec_id"], c["n"]))).alias("ids")), "each")
    sample = each.select("v", F.col("ids")[0].alias("id")).orderBy(F.xxhash64("id"), "id", "v").limit(fit_rows).toPandas()
    model = fit(unit(matrix(pa.array(list(sample["v"]), pa.binary()), longest // 8)), each.count(), k, recall)
    index = each.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_assign(model), "v binary, ids array<long>, row long, list int, code binary, left double, cosine double")
    index = cut(index, "index")
    sizes = {r[0]: r[1:] for r in index.groupBy("list").agg(F.count("*"), F.min("cosine")).collect()}  # as many rows as there are lists
    parts = parts_of_lists({number: r[0] for number, r in sizes.items()}, max(part_rows, 8 * model.rerank))  # so that no more than an eighth of a part is reranked
    lists = Lists(*np.array([[*parts.get(i, (0, 0))] for i in range(len(model.centroids))]).T, np.array([sizes[i][1] if i in sizes else 1.0 for i in range(len(model.centroids))]))
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("q")).withColumnRenamed("vec_id", "query_id")
    strips = max(1, -(-asked.count() // strip_rows))
    right = index.select("v", "ids", "row", "list", "code", "left").mapInArrow(_deal(lists), "v binary, ids array<long>, row long, list int, code binary, left double, part int")
    right = right.drop("row").withColumn("strip", F.explode(F.sequence(F.lit(0), F.lit(strips - 1))))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))

    def nearest_of(queries: DataFrame, complete: bool) -> DataFrame:
        left = queries.mapInArrow(_ask(model, lists, complete), "query_id long, q binary, floor double, parts array<int>")
        left = left.select("query_id", "q", "floor", F.pmod(F.xxhash64("query_id"), F.lit(strips)).cast("int").alias("strip"), F.explode("parts").alias("part"))
        found = left.groupBy("part", "strip").cogroup(right.groupBy("part", "strip")).applyInArrow(_search(model, lists, k, complete), "query_id long, vec_id long, score double")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = nearest_of(asked.select("query_id", "q", F.lit(-2.0).alias("floor")), False)
    floors = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    floors = cut(asked.join(floors, "query_id", "left").select("query_id", "q", F.coalesce("floor", F.lit(-2.0)).alias("floor")), "floors")
    return nearest_of(floors, True).select("query_id", "rank", "vec_id", "score")
