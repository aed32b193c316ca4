"""MinHash near-duplicates by a chosen-path set similarity join.

Each document is its set of distinct five-word shingles. Documents with one and the same set are joined
first by a hash of the whole set, so that exact copies of any number cost one row. For the others,
``trees`` independent trees start with the document's minwise token under a hash function each. Every
document is compared with the centre of each of its nodes, the one that shares most tokens with others (a star,
linear in the node), which connects most copies. A node whose documents are then all connected is finished: no comparison in it can add anything.
In other nodes, the documents outside the largest connected part are compared with all documents of the node;
while they are more than ``node_limit``, the node branches by two further minwise tokens,
chosen by a hash of its path. Every link is confirmed on the full sets.

A pair of similarity s meets in a node with probability ``1 - (1 - s f)**trees``, where f is 1 in roots and
``1 - (1 - s f)**2`` by the f of the level below. As all levels draw from the same 64 tokens, the share of them that agree
stands for s; averaged over it, a pair of exactly 0.75 whose nodes all branch is found with 1 - 2e-6 (no branching),
1 - 2e-5 (depth 1), 1 - 6e-5 (2), 1 - 1.5e-4 (4), 1 - 2.6e-4 (7) and 1 - 3.4e-4 (12); 0.80 with 1 - 2.5e-5 at 12.
Comparisons
are skipped only where 64 byte-sized minhashes agree in fewer than ``least_agree`` places (below 0.75 by more
than 4.5 standard deviations).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tx
from .components import components
from .shared import cut, fresh

HASHES = 64
SHINGLE_WORDS = 5
THRESHOLD = 75
_rng = np.random.default_rng(7)
_FLIP = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(s: np.ndarray) -> np.ndarray:
    """The minwise values of one set under HASHES functions."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 512):
        np.minimum(least, ((s[i : i + 512, None] ^ _FLIP) * _FACTOR).min(axis=0), out=least)
    return least


def _set_key(s: np.ndarray) -> tuple[int, int]:
    a = int(tx.mix(s).sum(dtype=np.uint64)) if len(s) else 0
    b = int(tx.mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)) if len(s) else 0
    return tuple(x - (1 << 64) if x >> 63 else x for x in (a, b))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = tx.utf8(batch.column(1))
        for a, b in tx.slices(offsets):
            sets = tx.shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], SHINGLE_WORDS)
            keys = [_set_key(s) for s in sets]
            sigs = [(tx.mix(signature(s)) >> np.uint64(32)).astype("<u4") for s in sets]  # the nodes' tokens, shortened
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([k[0] for k in keys], pa.int64()),
                    pa.array([k[1] for k in keys], pa.int64()),
                    pa.array([x.tobytes() for x in sigs], pa.binary()),
                    pa.array([x.astype(np.uint8).tobytes() for x in sigs], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "key_a", "key_b", "sig", "small"],
            )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = tx.utf8(batch.column(1))
        for a, b in tx.slices(offsets):
            sets = tx.shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], SHINGLE_WORDS)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "words"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        (da, oa), (db, ob) = tx.utf8(batch.column(2)), tx.utf8(batch.column(3))
        keep = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            x, y = np.frombuffer(da[oa[i] : oa[i + 1]].tobytes(), np.uint64), np.frombuffer(db[ob[i] : ob[i + 1]].tobytes(), np.uint64)
            if len(x) > len(y):
                x, y = y, x
            if not len(x) or 100 * len(x) < THRESHOLD * len(y):
                continue
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            both = int((y[at] == x).sum())
            keep[i] = 100 * both >= THRESHOLD * (len(x) + len(y) - both)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])


def _agreement(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (tx.utf8(batch.column(i))[0].reshape(-1, HASHES) for i in (2, 3))
            keep = pa.array((x == y).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return run


def _links_in_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (grp, side, rep, label, words) sorted by grp -> links between unconnected documents of both sides.

    The sizes of all intersections of a group come from one product of 0/1 matrices over the shingles that
    stand in two or more of its documents. Of the links found, those are given that connect labels anew.
    """

    def links(side: np.ndarray, rep: np.ndarray, label: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        n = np.array([len(x) for x in sets])
        owner = np.repeat(np.arange(len(sets)), n)
        values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        often = times > 1
        place = np.cumsum(often) - 1
        keep = often[column]
        owner, column = owner[keep], place[column[keep]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        both = np.zeros((len(left), len(right)), np.float32)
        for c in range(0, int(often.sum()), 4096):
            a, b = np.searchsorted(column, (c, c + 4096))
            block = np.zeros((len(sets), 4096), np.float32)
            block[owner[a:b], column[a:b] - c] = 1
            both += block[left] @ block[right].T
        hit = (100 * both >= THRESHOLD * (n[left][:, None] + n[right][None, :] - both)) & (label[left][:, None] != label[right][None, :])
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while x in root:
                x = root[x]
            return x

        for i, j in zip(*np.nonzero(hit), strict=True):
            x, y = find(label[left[i]]), find(label[right[j]])
            if x != y:
                root[max(x, y)] = min(x, y)
                yield rep[left[i]], rep[right[j]]

    def emit(now: list) -> pa.RecordBatch:
        grp, side, rep, label, words = now
        bound = np.flatnonzero(np.r_[True, grp[1:] != grp[:-1], True])
        out = [x for a, b in zip(bound[:-1], bound[1:], strict=True) if 0 < side[a:b].sum() < b - a for x in links(side[a:b], rep[a:b], label[a:b], [np.frombuffer(w, np.uint64) for w in words[a:b]])]
        return pa.RecordBatch.from_arrays([pa.array([min(x) for x in out], pa.int64()), pa.array([max(x) for x in out], pa.int64())], names=["a", "b"])

    return _by_group(batches, emit)


def _by_group(batches: Iterator[pa.RecordBatch], emit) -> Iterator[pa.RecordBatch]:
    """``emit`` on columns of whole groups: four of numbers, one of bytes; the last group of a batch waits for the next."""
    held: list | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)] + [batch.column(4).to_pylist()]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held[:4], now[:4], strict=True)] + [held[4] + now[4]]
        whole = int(np.searchsorted(now[0], now[0][-1]))
        if whole:
            yield emit([x[:whole] for x in now])
        held = [x[whole:] for x in now]
    if held is not None:
        yield emit(held)


def _likely_in_groups(least: int):
    """Rows (grp, side, rep, label, small) sorted by grp -> those that may have a link to the other side."""

    def emit(now: list) -> pa.RecordBatch:
        grp, side, rep, label, small = now
        small = np.frombuffer(b"".join(small), np.uint8).reshape(-1, HASHES)
        keep = np.zeros(len(grp), bool)
        bound = np.flatnonzero(np.r_[True, grp[1:] != grp[:-1], True])
        for a, b in zip(bound[:-1], bound[1:], strict=True):
            left, right = np.flatnonzero(side[a:b] == 0) + a, np.flatnonzero(side[a:b] == 1) + a
            for i in left if len(right) else ():
                hit = right[((small[right] == small[i]).sum(axis=1) >= least) & (label[right] != label[i])]
                if len(hit):
                    keep[i] = keep[hit] = True
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (grp, side, rep, label)], names=["grp", "side", "rep", "label"])

    return lambda batches: _by_group(batches, emit)


def _branches(large: DataFrame, reps: DataFrame) -> DataFrame:
    """Rows (rep, node) of the next level: two further minwise tokens for each document of a node.

    A pair of 0.75 has 1.5 children expected, so that it doesn't die out from level to level.
    """
    child = [F.pmod(F.xxhash64("node", F.lit(j)), F.lit(HASHES)).cast("int") for j in range(2)]
    branch = [F.xxhash64("node", p, F.expr("sig").substr(p * 4 + 1, F.lit(4))) for p in child]
    return large.join(reps.select("rep", "sig"), "rep").select("rep", F.explode(F.array(*branch)).alias("node")).distinct()


def minhash_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    trees: int = 10,
    node_limit: int = 1024,
    most_depth: int = 12,
    least_agree: int = 31,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    component_id is the smallest id reachable by links of Jaccard similarity 0.75 or more; kept marks it. Null or
    wordless texts have an empty set and link with nothing. Rows that repeat an id count as one document that
    links by any of its texts. A row without an id is linked with nothing: component_id is null, kept true. Other
    columns are not read. An empty table gives an empty table.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sketches = cut(docs.mapInArrow(_sketches, "doc_id long, n_shingles long, key_a long, key_b long, sig binary, small binary"), "sketches")
    known = sketches.where("doc_id is not null and n_shingles > 0")
    of_set = ["key_a", "key_b", "n_shingles"]
    classes = cut(known.groupBy(of_set).agg(F.min(F.struct("doc_id", "sig", "small")).alias("m")).select(*of_set, F.col("m.doc_id").alias("rep"), "m.sig", "m.small"), "classes")
    reps = classes.select("rep", "sig", "small")

    # roots: one node for each tree and minwise token
    rows = reps.select("rep", F.explode(F.array(*[F.xxhash64(F.lit(i), F.substring("sig", 4 * i + 1, 4)) for i in range(trees)])).alias("node"))
    nodes = rows.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
    members = cut(rows.join(nodes, "node"), "roots")
    shared = members.select("rep").distinct()
    sets = cut(docs.join(shared.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi").mapInArrow(_full_sets, "id long, words binary"), "sets")

    # every document against the centre of each of its nodes, which is the member that shares most tokens
    weight = members.groupBy("rep").agg(F.sum("size").alias("weight"))
    centre = members.select("node", "rep").join(weight, "rep").groupBy("node").agg(F.max(F.struct("weight", "rep")).alias("m")).select("node", F.col("m.rep").alias("centre"))
    star = members.join(centre, "node").where("rep <> centre").select(F.least("centre", "rep").alias("a"), F.greatest("centre", "rep").alias("b")).distinct()
    of = lambda df, key, value, names: df.select(F.col(key).alias(names[0]), F.col(value).alias(names[1]))
    likely = star.join(of(reps, "rep", "small", "by"), "b").join(of(reps, "rep", "small", "ax"), "a").select("a", "b", "x", "y")
    likely = cut(likely.mapInArrow(_agreement(least_agree), "a long, b long").distinct(), "star")
    met = likely.join(of(sets, "id", "words", "by"), "b").join(of(sets, "id", "words", "ax"), "a").select("a", "b", "x", "y")
    links = cut(met.mapInArrow(_confirm, "a long, b long").distinct(), "star-links")
    label = components(links, "a", "b")
    named = reps.select("rep").distinct().join(label.withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("label", "rep").alias("label"))
    named = cut(named.join(shared, "rep", "left_semi"), "labels")

    # nodes whose documents aren't all connected; they branch while too many of them are outside the largest part
    done, rows = None, members.select("node", "rep")
    for depth in range(most_depth + 1):
        rows = rows.join(named, "rep")
        parts = rows.groupBy("node", "label").agg(F.count("*").alias("n"))
        nodes = parts.groupBy("node").agg(F.sum("n").alias("size"), F.max("n").alias("most"), F.max(F.struct("n", "label")).alias("m"))
        nodes = nodes.where("most < size").select("node", "size", (F.col("size") - F.col("most")).alias("others"), F.col("m.label").alias("major"))
        rows = cut(rows.join(nodes, "node"), f"open{depth}")
        small = rows if depth == most_depth else rows.where(F.col("others") <= node_limit)
        done = small if done is None else done.unionByName(small)
        large = rows.where(F.col("others") > node_limit).select("node", "rep")
        if depth == most_depth or large.isEmpty():
            break
        rows = _branches(large, reps)

    # within a node: blocks of what is outside the largest part, against blocks of all
    strips, chunks = (F.ceil(F.col(c) / node_limit).cast("int") for c in ("others", "size"))
    own = lambda k, of: F.pmod(F.xxhash64("rep", F.lit(k)), of).cast("int")
    upto = lambda k: F.explode(F.sequence(F.lit(0), k - 1))
    left = done.where("label <> major").select("node", "rep", "label", F.lit(0).alias("side"), own(1, strips).alias("i"), upto(chunks).alias("j"))
    right = done.select("node", "rep", "label", F.lit(1).alias("side"), own(2, chunks).alias("j"), upto(strips).alias("i"))
    dealt = left.unionByName(right).select(F.xxhash64("node", "i", "j").alias("grp"), "side", "rep", "label")
    dealt = dealt.join(reps.select("rep", "small"), "rep").select("grp", "side", "rep", "label", "small")
    dealt = dealt.repartition(n, "grp").sortWithinPartitions("grp")
    dealt = cut(dealt.mapInArrow(_likely_in_groups(least_agree), "grp long, side int, rep long, label long"), "likely")
    dealt = dealt.join(sets.withColumnRenamed("id", "rep"), "rep").select("grp", "side", "rep", "label", "words")
    dealt = dealt.repartition(n, "grp").sortWithinPartitions("grp")
    links = links.unionByName(cut(dealt.mapInArrow(_links_in_groups, "a long, b long").distinct(), "node-links"))
    if not known.groupBy("doc_id").count().where("count > 1").isEmpty():  # an id with several texts belongs to the classes of all of them
        twice = known.join(classes.select(*of_set, "rep"), of_set).where("doc_id <> rep")
        links = links.unionByName(twice.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    label = cut(components(links, "a", "b"), "components")
    of_class = classes.select(*of_set, "rep").join(label.withColumnRenamed("node", "rep"), "rep", "left").select(*of_set, F.coalesce("label", "rep").alias("root"))
    out = sketches.select("doc_id", *of_set).join(of_class, of_set, "left")
    root = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", root.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one_of_each(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs``, all columns, without near-duplicates of a document with a smaller id.

    Null, empty and wordless texts are near nothing and stay, as rows without an id do. Rows that repeat an id are
    documents of their own: those of unrelated texts all stay, and of rows with one id and one text one is left, which one
    isn't defined. Columns may have any names. An empty table gives an empty table.
    """
    named, free = docs.where("doc_id is not null"), docs.where("doc_id is null")
    key = fresh(docs, "kept")
    if named.groupBy("doc_id").count().where("count > 1").isEmpty():
        found = minhash_components(named, **parameters)
        kept = found.where("kept").select(F.col("doc_id").alias(key))
        return named.join(kept, F.col("doc_id").cast("long") == F.col(key), "left_semi").unionByName(free)
    of = F.xxhash64("doc_id", F.lit(1), "text")  # a row's own number
    rows = named.select(of.alias("doc_id"), F.col("doc_id").cast("long").alias("named"), "text")
    found = minhash_components(rows, **parameters).select("doc_id", "component_id", "n_shingles").distinct()
    found = found.join(rows.select("doc_id", "named").distinct(), "doc_id").withColumn("group", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    kept = found.groupBy("group").agg(F.min(F.struct("named", "doc_id")).alias("m")).select(F.col("m.doc_id").alias(key))
    first = named.withColumn(key, of).dropDuplicates([key])
    return first.join(kept, key, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(free)
