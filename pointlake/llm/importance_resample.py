"""Importance resampling towards a target distribution, drawn by a distributed quickselect.

Texts are bags of hashed words and word pairs. Counts per bucket over all documents and over all target texts give an array of
gains, and an array lookup scores each document: the floored mean gain of its features. Scores get Gumbel noise
from a hash of the id, so that the k highest are a draw without replacement. The k-th is found without a sort:
each round draws pivot keys at random, counts exactly how many keys come before and at each of them, and keeps
only the keys between the two pivots that enclose the k-th, until a pivot is the k-th itself. The winners alone are then
sorted, and numbered by the sizes of their sorted partitions.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textnum as tx
from .shared import cut, discard, fresh

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # of bytes in lower case: what isn't ASCII counts as a letter
_KEPT_WORDS = 200_000


def feature_buckets(text: bytes, buckets: int, known: dict[bytes, tuple[int, int]]) -> tuple[int, np.ndarray]:
    """(number of words, bucket of every word and every pair of neighbouring words): crc32 of the bytes, modulo ``buckets``.

    ``known`` keeps crc32 of words, and of words with a space behind, from which that of a pair goes on.
    """
    words = WORD.findall(text.lower())
    if len(known) > _KEPT_WORDS:
        known.clear()
    for w in set(words):
        if w not in known:
            c = zlib.crc32(w)
            known[w] = c, zlib.crc32(b" ", c)
    both = [known[w] for w in words]
    n = len(words)
    out = np.empty(max(0, 2 * n - 1), np.int64)
    out[:n] = [c for c, _ in both]
    out[n:] = list(map(zlib.crc32, words[1:], [c for _, c in both[:-1]]))
    return n, out % buckets


def _texts(column: pa.Array) -> Iterator[bytes]:
    data, offsets = tx.utf8(column)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield data[a:b].tobytes()


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, known = np.zeros(buckets, np.int64), {}
        for batch in batches:
            for text in _texts(batch.column(0)):
                total += np.bincount(feature_buckets(text, buckets, known)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = 10_000) -> np.ndarray:
    """How many features of all texts fall into each bucket: one row of counts a task, summed; ``buckets`` numbers come to the driver."""
    rows = texts.select(F.col(text_col).alias("text")).mapInArrow(_count(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed likelihood ratio) of each bucket."""
    b, s, t = len(source), int(source.sum()), int(target.sum())
    ratio = [float((int(y) + 1) * (s + b)) / float((int(x) + 1) * (t + b)) for x, y in zip(source, target, strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def _score(gain: np.ndarray, rest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[int, int]] = {}
        for batch in batches:
            words, features, weight = [], [], []
            for text in _texts(batch.column(rest)):
                n, found = feature_buckets(text, len(gain), known)
                words.append(n)
                features.append(len(found))
                weight.append(int(gain[found].sum()) // len(found) if len(found) else 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(rest)), *(pa.array(x, pa.int64()) for x in (words, features, weight))], names=[*batch.schema.names[:rest], "n_words", "n_features", "weight"])

    return run


def gumbel(seed: int, id_col: str) -> Column:
    """floor(1000 x a standard Gumbel number) from sha256 of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _before(score: int, key: int, at: bool = False) -> Column:
    """Whether a row comes before the key (score, key): by higher score, then smaller id; with ``at`` also at it."""
    of = F.col("key") <= key if at else F.col("key") < key
    return (F.col("score") > score) | ((F.col("score") == score) & of)


def kth_key(keys: DataFrame, k: int, pivots: int = 15, seed: int = 7, most_rounds: int = 200) -> tuple[int, int]:
    """The k-th (from 1) of the rows (score, key) in descending order of score, then ascending of key.

    A round reads what is left, draws ``pivots`` rows by a hash and counts the rows before and at each; what is left
    shrinks by about that factor and is cut. Equal keys can't be told apart and count one by one.
    """
    left, done = keys.select("score", "key"), 0
    for step in range(most_rounds):
        drawn = left.orderBy(F.xxhash64(F.lit(seed), F.lit(step), "score", "key"), "score", "key").limit(pivots).collect()
        drawn = sorted({(r.score, r.key) for r in drawn}, key=lambda p: (-p[0], p[1]))
        count = left.agg(*[F.count(F.when(_before(*p, at=bool(j)), 1)).alias(f"n{i}_{j}") for i, p in enumerate(drawn) for j in range(2)]).first()
        low, high = None, None
        for i, p in enumerate(drawn):
            if k <= done + count[f"n{i}_0"]:
                high = p
                break
            if k <= done + count[f"n{i}_1"]:
                return p
            low, passed = p, count[f"n{i}_1"]
        part = left
        if low is not None:
            part, done = part.where(~_before(*low, at=True)), done + passed
        if high is not None:
            part = part.where(_before(*high))
        part = cut(part, "between")
        if step:
            discard(left)
        left = part
    raise RuntimeError("the k-th key was not found")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = 10_000, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """``docs``, every row and column, with n_features, weight, score and rank (long) added; rank is null where undrawn.

    Of the N rows with at least ``least_words`` words, floor(percent * N / 100) are drawn: the highest scores, ties to the
    smaller id. Words are runs of letters and digits (ASCII, lower-cased) and of all characters beyond ASCII; features are words
    and pairs of neighbours. A null or wordless text has no features and the weight 0; texts of any length count
    whole. A row without an id counts in the statistics, has a null score and is never drawn or part of N. Rows that repeat an id have one
    noise; if they tie in all, which of them is drawn first isn't defined, as nothing tells them apart but other columns.
    Added columns must not be there already, in any case of letters: that is an error. Empty tables give empty tables; an empty
    target gives the gains of no target features.
    """
    added = ("n_features", "weight", "score", "rank")
    clash = {c.lower() for c in docs.columns} & set(added)
    if clash:
        raise ValueError(f"rename the columns {sorted(clash)} first")
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_col, buckets))
    spare = [fresh(docs, "key"), fresh(docs, "text")]
    rest = [f"c{i}" for i in range(len(docs.columns))]  # names of any kind pass through Arrow under plain ones
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, rest, strict=True)], F.col(id_col).cast("long").alias(spare[0]), F.col(text_col).alias(spare[1]))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields[:-1])
    scored = plain.mapInArrow(_score(gain, len(rest) + 1), f"{kinds}, n_words long, n_features long, weight long").withColumnRenamed(spare[0], "key")
    scored = cut(scored.withColumn("score", F.col("weight") + gumbel(seed, "key")), "scores")
    fit = scored.where((F.col("n_words") >= least_words) & F.col("key").isNotNull())
    k = percent * fit.count() // 100
    out = lambda df, rank: df.select(*[F.col(n).alias(c) for n, c in zip(rest, docs.columns, strict=True)], "n_features", "weight", "score", rank.cast("long").alias("rank"))
    if k <= 0:
        return out(scored, F.lit(None))
    worst = kth_key(fit, k, seed=seed)
    drawn = (F.col("n_words") >= least_words) & F.col("key").isNotNull() & _before(*worst, at=True)
    first = scored.where(drawn).orderBy(F.desc("score"), F.asc("key")).withColumn("place", F.monotonically_increasing_id())
    first = cut(first, "winners")
    part = F.shiftright("place", 33)  # the sorted partition; below, the place in it
    sizes = first.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    ahead = sizes.withColumn("ahead", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "ahead")
    ranked = first.withColumn("part", part).join(ahead, "part").withColumn("at", F.col("ahead") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    rank = F.when(F.col("at") <= k, F.col("at"))  # rows that tie with the last one in all
    return out(ranked, rank).unionByName(out(scored.where(~F.coalesce(drawn, F.lit(False))), F.lit(None)))


_CRC_TABLE = "[list_reduce([i] || range(8), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) FOR i IN range(256)]"
ORACLE = f"""
WITH d AS (SELECT doc_id, 0 AS part, text FROM documents UNION ALL SELECT NULL, 1, text FROM benchmark),
w AS (SELECT *, row_number() OVER () AS row_no, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM d),
f AS (SELECT row_no, part, unnest(words || list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS feature FROM w),
g AS (SELECT row_no, part, feature, count(*) AS n FROM f GROUP BY ALL),
crc AS (SELECT {_CRC_TABLE} AS t),
names AS (SELECT DISTINCT feature FROM g),
b AS (SELECT feature, xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(regexp_extract_all(hex(encode(feature)), '..'), lambda x: CAST(CAST('0x' || x AS INT) AS BIGINT)),
     lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) % 10000 AS bucket FROM names, crc),
c AS (SELECT bucket, coalesce(sum(n) FILTER (part = 0), 0) AS s, coalesce(sum(n) FILTER (part = 1), 0) AS t FROM g JOIN b USING (feature) GROUP BY ALL),
total AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM c),
gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (s_all + 10000) AS DOUBLE) / CAST((s + 1) * (t_all + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM c, total),
doc AS (SELECT row_no, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS gained FROM g JOIN b USING (feature) JOIN gain USING (bucket) WHERE part = 0 GROUP BY ALL),
x AS (SELECT doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, CASE WHEN n_features > 0 THEN (gained - ((gained % n_features) + n_features) % n_features) // n_features ELSE 0 END AS weight,
     CAST(CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) AS DOUBLE) AS h FROM w LEFT JOIN doc USING (row_no) WHERE part = 0),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM x),
r AS (SELECT *, n_words >= 20 AND doc_id IS NOT NULL AS fit, row_number() OVER (PARTITION BY n_words >= 20 AND doc_id IS NOT NULL ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_words >= 20 AND doc_id IS NOT NULL) OVER () AS n FROM y)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CAST(CASE WHEN fit AND place <= 25 * n // 100 THEN place END AS BIGINT) AS rank FROM r
"""
