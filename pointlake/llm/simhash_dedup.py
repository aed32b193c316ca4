"""SimHash near-duplicates by covering locality-sensitive hashing.

A document's fingerprint takes, for each of 64 bits, the majority of its word shingles' hashes. Two fingerprints
link if they differ in two bits at most. To find all such pairs, every bit gets one of the seven non-zero vectors of
three bits, and table v keeps the bits whose vector has an odd product with v. Two differing bits span at most a plane,
so some v is orthogonal to both: that table keeps neither of them, and the pair falls into one bucket of it, always.

Documents of one fingerprint are joined first, so that copies of any number cost one row. A bucket with more than
``bucket_limit`` different fingerprints is covered again, by seven tables over the bits that its own table leaves out.
Of those at most 12 are left out then, so that no bucket of the second level has more than 4,096 fingerprints, whatever the data.
Within a bucket all are compared in a task, and only links that connect anew are given: fewer than it has rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tx
from .components import components
from .shared import cut

BITS, RADIUS, SHINGLE_WORDS, SEED = 64, 2, 3, 42
VECTORS = range(1, 1 << (RADIUS + 1))
_STEP = 1 << 16


def covering_masks(free: int) -> list[int]:
    """Seven masks over the set bits of ``free``; of any two of those bits, some mask keeps neither."""
    places = [i for i in range(BITS) if free >> i & 1]
    vector = {p: VECTORS[k % len(VECTORS)] for k, p in enumerate(places)}
    return [sum(1 << p for p in places if (vector[p] & v).bit_count() % 2) for v in VECTORS]


def mask_levels() -> tuple[list[int], list[int]]:
    """The masks of the first level, and for each of them the seven of the second, which keep its bits as well."""
    whole = (1 << BITS) - 1
    first = covering_masks(whole)
    return first, [m | below for m in first for below in covering_masks(whole & ~m)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes) -> int:
    """The majority bits of the XXH64 of all runs of three words; of the whole sequence if there are fewer, zero if none."""
    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII white spaces
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1].tolist()
    last = min(SHINGLE_WORDS, len(words)) - 1
    hash_of = xxhash.xxh64_intdigest
    h = np.array([hash_of(joined[a:b], SEED) for a, b in zip(starts, ends[last:].tolist(), strict=False)], "<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), _STEP):
        bits = np.unpackbits(h[at : at + _STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = tx.utf8(batch.column(1))
        found = np.fromiter((fingerprint(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "bits"])


def links_in_buckets(bucket: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of a spanning forest of the links within buckets; rows of a bucket stand side by side."""
    root, out = np.arange(len(bits)), []

    def top(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    at, gap = np.arange(len(bits) - 1), 1
    while len(at):  # every row meets the one ``gap`` places on, while that is in its bucket
        at = at[at + gap < len(bits)]
        at = at[bucket[at] == bucket[at + gap]]
        near = at[np.bitwise_count(bits[at] ^ bits[at + gap]) <= RADIUS]
        for i in near[root[near] != root[near + gap]].tolist():
            a, b = top(i), top(i + gap)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((i, i + gap))
        while (root != root[root]).any():
            root = root[root]
        gap += 1
    found = np.array(out, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, bits, rep) sorted by bucket -> links; the last bucket of a batch waits for the next one."""

    def emit(bucket: np.ndarray, bits: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
        i, j = links_in_buckets(bucket, bits.view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(rep[i]), pa.array(rep[j])], names=["a", "b"])

    held = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        if batch.num_rows:
            now = [np.concatenate([x, batch.column(k).to_numpy(zero_copy_only=False)]) for k, x in enumerate(held)]
            whole = int(np.searchsorted(now[0], now[0][-1]))
            yield emit(*[x[:whole] for x in now])
            held = [x[whole:] for x in now]
    yield emit(*held)


def covering_links(classes: DataFrame, bucket_limit: int = 2048) -> DataFrame:
    """Links (a, b) between the rows (rep, bits) of different fingerprints: their components are those of all links."""
    spark = classes.sparkSession
    first, second = mask_levels()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def dealt(rows: DataFrame, table, masks: list[int]) -> DataFrame:
        every = F.array(*[F.lit(signed(m)) for m in masks])
        out = rows.withColumn("table", F.explode(table))
        return out.withColumn("bucket", F.xxhash64("table", F.col("bits").bitwiseAND(F.get(every, F.col("table"))), F.lit(len(masks))))

    def counted(rows: DataFrame) -> DataFrame:
        return rows.join(rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "bucket")

    rows = cut(counted(dealt(classes, F.sequence(F.lit(0), F.lit(len(first) - 1)), first)), "buckets")
    below = F.sequence(F.col("table") * len(first), F.col("table") * len(first) + len(first) - 1)
    deep = counted(dealt(rows.where(F.col("size") > bucket_limit).select("rep", "bits", "table"), below, second))
    met = rows.where(F.col("size") <= bucket_limit).select("bucket", "bits", "rep").unionByName(deep.select("bucket", "bits", "rep"))
    met = met.repartition(n, "bucket").sortWithinPartitions("bucket")
    return met.mapInArrow(_links, "a long, b long").distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_limit: int = 2048) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id reachable by links of fingerprints that differ in two bits or fewer, exactly. Null,
    empty and wordless texts have the fingerprint zero, which links like any other; a text with fewer than three words
    is one shingle; texts of any length are read whole. A bit that half of the shingles set is 0. Rows that repeat an id
    count as one document that links by any of its texts. A row without an id links nothing: component_id is null. Other columns
    are not read. An empty table gives an empty table.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = cut(docs.mapInArrow(_fingerprints, "doc_id long, bits long"), "fingerprints")
    known = prints.where("doc_id is not null")
    classes = cut(known.groupBy("bits").agg(F.min("doc_id").alias("rep")), "classes")
    links = covering_links(classes, bucket_limit)
    repeated = known.groupBy("doc_id").agg(F.min("bits").alias("least"), F.max("bits").alias("most")).where("least <> most").select("doc_id")
    of_all = known.join(repeated, "doc_id").join(classes, "bits").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    label = components(links.unionByName(of_all.where("a <> b")), "a", "b")
    named = classes.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("bits", F.coalesce("label", "rep").alias("component"))
    out = prints.join(named, "bits", "left")
    hex16 = F.lower(F.lpad(F.hex("bits"), 16, "0"))
    return out.select("doc_id", hex16.alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))
