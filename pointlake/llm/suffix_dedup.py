"""Suffix-array dedup: find every byte covered by a string of 200 bytes that starts more than once in the corpus.

Sharding. Of the k-grams in a window of 200 bytes, the one with the smallest hash is the window's anchor; equal
windows have equal anchors at equal offsets. An anchor occurrence stands for a run of window starts, and the
bytes of all these windows are its context. Anchors that occur once in the corpus end the search for their
windows. Contexts that are equal as wholes are classes, told by 128 bits of two hashes that have nothing in common (the
anchor's, and the whole's over another table and base) and counted: all windows of a class of two or more repeat. What is left are different contexts around one anchor, as where a repeated passage begins and
ends: one context of each class goes to the task of its anchor, where a suffix array (see ``lyndon_sort``) brings
equal windows together. Around an anchor with very many classes the search goes on with longer k-grams instead, up
to k = 200, where anchors are windows and counting them decides. No group is cut short and none is unbounded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tx
from .lyndon_sort import suffix_array
from .shared import cut

WINDOW = 200
STEPS = (101, 161, 191, 200)
_PLACE = np.uint64((1 << 24) - 1)
_PIECE = 1 << 22


def anchors(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(row, first window start, last window start, anchor place, prefix sums) of every run of windows in the texts."""
    width = WINDOW - k + 1
    sums = tx.prefix(data)
    starts = np.maximum(0, np.diff(offsets) - WINDOW + 1)
    if not starts.sum():
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, sums
    grams = len(data) - k + 1
    every = tx.mix((sums[k - 1 : k - 1 + grams] - sums[:grams]) * tx.powers(len(sums))[1][:grams])  # as ``ranges`` has it
    least = (every & ~_PLACE) | np.arange(grams, dtype=np.uint64)
    span = 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[: len(least) - step], least[step:])
        span += step
    row = np.repeat(np.arange(len(starts)), starts)
    window = np.arange(len(row)) - np.repeat(np.cumsum(starts) - starts, starts) + np.repeat(offsets[:-1], starts)
    place = (least[window] & _PLACE).astype(np.int64)
    change = np.r_[True, (place[1:] != place[:-1]) | (row[1:] != row[:-1])]
    first = np.flatnonzero(change)
    last = np.r_[first[1:], len(row)] - 1
    return row[first], window[first], window[last], place[first], sums


def _pieces(offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, offsets of each begin and end) in pieces of bounded size; windows of a longer text are parted, bytes overlap."""
    for a, b in tx.slices(offsets):
        if b - a > 1 or offsets[b] - offsets[a] <= _PIECE:
            yield np.arange(a, b), offsets[a : b + 1]
        else:
            for begin in range(int(offsets[a]), int(offsets[b]), _PIECE):
                yield np.array([a]), np.array([begin, min(int(offsets[b]), begin + _PIECE + WINDOW - 1)])


def _runs(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.utf8(batch.column(2))
            base = batch.column(1).to_numpy(zero_copy_only=False)
            for rows, cuts in _pieces(offsets):
                piece = data[cuts[0] : cuts[-1]]
                row, lo, hi, place, sums = anchors(piece, cuts - cuts[0], k)
                whole = tx.ranges(tx.prefix(piece, 1), lo, hi + WINDOW, 1) ^ tx.mix((place - lo).astype(np.uint64) + np.uint64(1))
                at = base[rows[row]] + cuts[0] - offsets[rows[row]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tx.ranges(sums, place, place + k).view(np.int64)), pa.array(whole.view(np.int64)), batch.column(0).take(pa.array(rows[row])), pa.array((lo + at).astype(np.int64)), pa.array((hi - lo + 1).astype(np.int32))],
                    names=["a", "c", "doc", "lo", "n"],
                )

    return run


def repeated_windows(contexts: list[bytes]) -> list[np.ndarray]:
    """For each context, whether the 200 bytes from each of its window starts also start anywhere else in them."""
    text = b"\0".join(contexts) if all(0 not in c for c in contexts) else [x for c in contexts for x in (*(b + 1 for b in c), 0)][:-1]
    raw = b"\0".join(contexts)
    order = suffix_array(text)
    size = [len(c) for c in contexts]
    begin = np.cumsum([0] + [s + 1 for s in size])
    ok = np.zeros(len(raw) + 1, bool)
    for b, s in zip(begin[:-1], size, strict=True):
        ok[b : b + max(0, s - WINDOW + 1)] = True
    twice = np.zeros(len(raw) + 1, bool)
    previous = -1
    for i in order:
        if not ok[i]:
            continue
        if previous >= 0 and raw[previous : previous + WINDOW] == raw[i : i + WINDOW]:
            twice[previous] = twice[i] = True
        previous = i
    return [twice[b : b + max(0, s - WINDOW + 1)] for b, s in zip(begin[:-1], size, strict=True)]


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, doc, lo, single, bytes) sorted by a -> the byte ranges of repeated windows of single contexts."""

    def emit(rows: list[tuple]) -> Iterator[tuple[int, int, int]]:
        i = 0
        while i < len(rows):
            j = i
            while j < len(rows) and rows[j][0] == rows[i][0]:
                j += 1
            group = rows[i:j]
            for (_, doc, lo, single, _), hit in zip(group, repeated_windows([g[4] for g in group]), strict=True):
                if single and hit.any():
                    edge = np.flatnonzero(np.diff(np.r_[0, hit.view(np.int8), 0]))
                    yield from ((doc, lo + int(a), lo + int(b) - 1 + WINDOW) for a, b in zip(edge[::2], edge[1::2], strict=True))
            i = j

    def batch_of(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], names=["doc", "start", "end"])

    held: list[tuple] = []
    for batch in batches:
        held += zip(*[c.to_pylist() for c in batch.columns], strict=True)
        if held and held[0][0] != held[-1][0]:
            whole = next(i for i in range(len(held) - 1, -1, -1) if held[i][0] != held[-1][0]) + 1
            yield batch_of(list(emit(held[:whole])))
            held = held[whole:]
    if held:
        yield batch_of(list(emit(held)))


def repeated_ranges(texts: DataFrame, most_classes: int = 1000, step: int = 0) -> DataFrame:
    """(doc, start, end) byte ranges, maybe overlapping, of repeated windows in ``texts`` (doc, base, bytes)."""
    k = STEPS[step]
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = texts.mapInArrow(_runs(k), "a long, c long, doc long, lo long, n int").repartition(n, "a")
    # both readers of the exchange ask for all its columns, so that it is made once
    often = every.groupBy("a").agg(F.count("*").alias("times"), *[F.min(c).alias(f"any_{c}") for c in ("c", "doc", "lo", "n")])
    often = often.where("times > 1 and any_n > 0 and any_lo >= 0 and any_c is not null and any_doc is not null").select("a")
    runs = cut(every.join(often.hint("shuffle_hash"), "a"), f"runs{k}")
    classes = runs.groupBy("a", "c").agg(F.count("*").alias("times"), F.min(F.struct("doc", "lo", "n")).alias("m"))
    classes = cut(classes.select("a", "c", "times", "m.doc", "m.lo", "m.n"), f"classes{k}")
    whole = runs.join(classes.where("times > 1").select("a", "c"), ["a", "c"])
    found = whole.select("doc", F.col("lo").alias("start"), (F.col("lo") + F.col("n") + (WINDOW - 1)).alias("end"))
    if k == WINDOW:
        return found
    many = classes.groupBy("a").agg(F.count("*").alias("classes")).where("classes > 1")
    open_ = cut(classes.join(many, "a").select("a", "classes", "doc", "lo", "n", (F.col("times") == 1).alias("single")), f"open{k}")
    piece = F.expr(f"substring(bytes, cast(lo - base + 1 as int), cast(n + {WINDOW - 1} as int))")
    inside = F.expr(f"lo >= base and lo - base + n + {WINDOW - 1} <= length(bytes)")
    met = open_.join(texts, "doc").where(inside).select("a", "classes", "doc", "lo", "single", piece.alias("bytes"))
    if step:  # contexts of one document may overlap: each of them may hold the run
        met = met.dropDuplicates(["a", "doc", "lo"])
    met = cut(met, f"contexts{k}")
    small = met.where(F.col("classes") <= most_classes).select("a", "doc", "lo", "single", "bytes").repartition(n, "a").sortWithinPartitions("a")
    found = found.unionByName(small.mapInArrow(_sorted_groups, "doc long, start long, end long"))
    large = met.where(F.col("classes") > most_classes).select("doc", F.col("lo").alias("base"), "bytes")
    if not large.isEmpty():
        found = found.unionByName(repeated_ranges(large, most_classes, step + 1))
    return found


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for data, starts, ends in zip(*[batch.column(i).to_pylist() for i in (1, 2, 3)], strict=True):
            data, spans = data or b"", []
            for a, b in sorted(zip(starts or (), ends or (), strict=True)):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(b, spans[-1][1])
                else:
                    spans.append([a, b])
            edges = [0, *[x for s in spans for x in s], len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            rows.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left) for every row of ``docs``.

    Texts are UTF-8 bytes, a null text is empty, and matches never cross rows. A text of under 200 bytes loses nothing;
    of equal texts none is kept whole, as both strings repeat. Rows that repeat an id, or have none, are
    taken as texts of their own. Other columns are not read. An empty table gives an empty table.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("bytes"))
    plain = dict(docs.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint") and docs.where(F.col(id_col).isNull() | (F.col(id_col) < 0)).isEmpty() and docs.groupBy(id_col).count().where("count > 1").isEmpty()
    key = F.col("doc_id").cast("long") if plain else F.xxhash64("doc_id", "bytes")
    texts = rows.select(key.alias("doc"), F.lit(0).cast("long").alias("base"), "bytes")
    found = repeated_ranges(texts).groupBy("doc").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    met = rows.withColumn("doc", key).join(found, "doc", "left").select("doc_id", "bytes", "starts", "ends")
    return met.mapInArrow(_removed, f"doc_id {dict(docs.dtypes)[id_col]}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
