"""SimHash, hard negatives and importance resampling against brute force, with nulls, empties, ties, repeats and hot groups."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest
import xxhash

from pointlake.llm import hard_negatives as hn
from pointlake.llm import importance_resample as ir
from pointlake.llm import simhash_dedup as sh

TEXTS = [None, "", " \t\n", "one", "One two", "ONE\ttwo", "a b c", "a b c a b c", "é ü\x1fß   x y z", "İ K A\x0bb\x0cc d", "word " * 40_000]


def plain_print(text) -> int:
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(nodes, linked) -> dict:
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("text", TEXTS[:-1])
def test_fingerprint(text):
    assert sh.fingerprint((text or "").encode()) == plain_print(text)


def test_every_pair_within_the_radius_is_covered():
    first, second = sh.mask_levels()
    for pair in itertools.combinations(range(64), 2):
        differ = (1 << pair[0]) | (1 << pair[1])
        met = [k for k, m in enumerate(first) if not m & differ]
        assert met and all(any(not second[7 * k + j] & differ for j in range(7)) for k in met)
    assert all(64 - m.bit_count() <= 28 for m in first) and all(64 - m.bit_count() <= 12 for m in second)


def test_fingerprint_as_spark_hashes(spark):
    rows = spark.createDataFrame([("a b c",), ("é ü ß",), ("x" * 100,)], "t string").selectExpr("t", "xxhash64(t) as h").collect()
    for r in rows:
        assert sh.signed(xxhash.xxh64_intdigest(r.t.encode(), 42)) == r.h


@pytest.mark.parametrize("limit", [1, 8, 2048])
def test_links_connect_what_brute_force_connects(spark, limit):
    rng = np.random.default_rng(limit)
    base = [int(x) for x in rng.integers(0, 1 << 63, 6, dtype=np.uint64)]
    prints = set(base) | {0, (1 << 64) - 1}
    for x in base:
        for _ in range(20):
            y = x
            for b in rng.integers(0, 64, rng.integers(1, 5)):
                y ^= 1 << int(b)
            prints.add(y)
    prints = sorted(prints)
    rows = spark.createDataFrame([(i, sh.signed(x)) for i, x in enumerate(prints)], "rep long, bits long")
    links = [(r.a, r.b) for r in sh.covering_links(rows, limit).collect()]
    assert all((prints[a] ^ prints[b]).bit_count() <= 2 for a, b in links)
    got = closure(range(len(prints)), lambda a, b: (a, b) in set(links) or (b, a) in set(links))
    assert got == closure(range(len(prints)), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)


def test_a_full_bucket_gives_a_forest():
    """All 4,096 values of twelve bits: connected, with no more links than rows."""
    bits = np.arange(4096, dtype=np.uint64)
    i, j = sh.links_in_buckets(np.zeros(4096, np.int64), bits)
    assert len(i) == 4095 and (np.bitwise_count(bits[i] ^ bits[j]) <= 2).all()


def test_simhash_components(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = list(TEXTS)
    for _ in range(10):
        base = list(rng.choice(vocabulary, 200))
        for _ in range(5):
            copy = list(base)
            for at in rng.integers(0, 200, rng.integers(0, 3)):
                copy[at] = "z"
            texts.append(" ".join(copy))
    rows = [(i, t, "s", 1, -1) for i, t in enumerate(texts)] + [(None, "one", "s", 1, -1), (3, texts[-1], "s", 1, -1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bits string, rep int, component_id int")
    got = sh.simhash_components(docs).collect()
    prints = [(i, plain_print(t)) for i, t, *_ in rows]
    root = closure(range(len(prints)), lambda a, b: None not in (prints[a][0], prints[b][0]) and (prints[a][0] == prints[b][0] or (prints[a][1] ^ prints[b][1]).bit_count() <= 2))
    least = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            least[root[k]] = min(least.get(root[k], i), i)
    want = [(i, f"{p:016x}", None if i is None else least[root[k]]) for k, (i, p) in enumerate(prints)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_simhash_of_an_empty_table(spark):
    assert sh.simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_negatives(rows, is_anchor, k=5, scale=256, percent=80):
    fit = [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: hn.held(sum(x * y for x, y in zip(a, b, strict=False)))
    out = []
    for i in sorted({r[0] for r in fit if is_anchor(r[0])}):
        _, q, own = min((r for r in fit if r[0] == i), key=lambda r: r[2])
        scored = sorted((-dot(q, v), j, lab) for j, v, lab in fit if j != i)
        for s, p in sorted({(-s, j) for s, j, lab in [x for x in scored if x[2] == own][:k]}):
            window = [(-n, j) for n, j, lab in scored if lab != own and percent * s <= -100 * n <= 100 * s][:k]
            out += [(i, p, rank, j, s, n) for rank, (n, j) in enumerate(window, 1)]
    return sorted(out)


def mined(spark, rows, **options):
    table = spark.createDataFrame([(i, v, lab, "x") for i, v, lab in rows], "vec_id long, embedding array<double>, label int, v string")
    return sorted(map(tuple, hn.hard_negatives(table, "vec_id % 7 = 0", **options).collect()))


def test_hard_negatives_equal_brute_force(spark):
    rng, rows = np.random.default_rng(2), []
    for i in range(150):
        v = rng.normal(size=6) * rng.choice([0.02, 1, 5])
        rows.append((i, [float(x) for x in (rng.choice([0.0, 1.0], 6) if i % 3 == 0 else v)], int(rng.integers(3))))
    rows += [(14, None, 1), (15, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (16, [math.nan] + [0.0] * 5, 0), (17, [math.inf] + [0.0] * 5, 0), (21, [1.0, 1.0], 9), (None, [1.0] * 6, 0), (35, [1.0] * 6, None)]
    rows += [(200 + i, [0.0] * 6, 0) for i in range(3)] + [(300, [0.5] * 6, 1), (300, [0.25] * 6, 1), (301, [], 1)]
    want = plain_negatives(rows, lambda i: i % 7 == 0)
    assert len(want) > 100 and mined(spark, rows) == want
    assert mined(spark, rows, anchor_block=5, row_block=16) == want


def test_hard_negatives_of_huge_numbers_and_few_rows(spark):
    rows = [(0, [1e15, 1.0], 0), (7, [2e15, 3.0], 0), (8, [1.9e15, 0.5], 1), (9, [1.0, 1.0], 1)]
    assert mined(spark, rows) == plain_negatives(rows, lambda i: i % 7 == 0)
    assert mined(spark, [(0, [1.0], 0)]) == [] and mined(spark, []) == []


def test_coordinate_ranges_lose_nothing_and_prune():
    rng = np.random.default_rng(3)
    x = np.floor(256 * (rng.normal(size=(3000, 8)) * rng.choice([0.1, 1, 2], (3000, 1))))
    length, found = hn.buckets(x)
    looked = 0
    for q in x[:40]:
        for theta in (0.3, 0.6, 0.9):
            least = theta * float(q @ q)
            hit = set(np.flatnonzero(x @ q >= least).tolist())
            seen = set()
            for at, bucket in found:
                places = bucket.candidates(q / np.linalg.norm(q), float(np.linalg.norm(q)), least)
                seen |= set(at.tolist() if places is None else at[places].tolist())
            assert hit <= seen
            looked += len(seen)
    assert looked < 0.5 * 3000 * 120


def plain_resample(rows, targets, percent=25, buckets=10_000):
    def found(t):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return len(w), [zlib.crc32(f.encode()) % buckets for f in w + [f"{a} {b}" for a, b in itertools.pairwise(w)]]

    s, t = np.zeros(buckets, int), np.zeros(buckets, int)
    for _, text in rows:
        np.add.at(s, found(text)[1], 1)
    for text in targets:
        np.add.at(t, found(text)[1], 1)
    gain = [math.floor(1000 * math.log(float((int(y) + 1) * (int(s.sum()) + buckets)) / float((int(x) + 1) * (int(t.sum()) + buckets)))) for x, y in zip(s, t, strict=True)]
    out = []
    for i, text in rows:
        n, f = found(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = None if i is None else int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(f), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in out if r[1] >= 20 and r[0] is not None), key=lambda r: (-r[4], r[0]))
    drawn = {id(r): k for k, r in enumerate(fit[: percent * len(fit) // 100], 1)}
    return [(r[0], *r[2:], drawn.get(id(r))) for r in out]


def same_rows(got, want):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    return sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_resample_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    vocabulary = ["alpha", "Beta", "gamma2", "straße", "Él", "漢字", "x", "UPPER", "don't", "a-b", "\x7f", "e f"]
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 80)))) for i in range(200)] + [(None, "alpha " * 30), (500, None), (501, ""), (502, "--- ..."), (503, "long " * 50_000), (-4, "beta " * 25)]
    targets = ["alpha beta gamma2", None, "", "straße x"]
    docs = spark.createDataFrame([(i, t, "c", 5) for i, t in rows], "doc_id long, text string, `c0` string, `a.b` int")
    out = ir.resample(docs, spark.createDataFrame([(t,) for t in targets], "text string"))
    assert out.columns == ["doc_id", "text", "c0", "a.b", "n_features", "weight", "score", "rank"]
    assert same_rows(out.select("doc_id", "n_features", "weight", "score", "rank").collect(), plain_resample(rows, targets))


def test_resample_of_repeated_rows_and_empty_tables(spark):
    text = "one two three four five " * 5
    rows = [(7, text)] * 9 + [(8, text)] * 3
    docs, none = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "text string")
    got = ir.resample(docs, none).drop("text").collect()
    assert same_rows(got, plain_resample(rows, []))
    assert ir.resample(docs.limit(0), none).count() == 0
    with pytest.raises(ValueError, match="rename"):
        ir.resample(docs.selectExpr("*", "1 as Score"), none)


@pytest.mark.parametrize("pivots", [1, 15])
def test_kth_key(spark, pivots):
    rng = np.random.default_rng(6)
    rows = [(int(s), int(k)) for s, k in zip(rng.integers(-20, 20, 300), rng.integers(0, 60, 300), strict=True)]
    order = sorted(rows, key=lambda r: (-r[0], r[1]))
    keys = spark.createDataFrame(rows, "score long, key long").repartition(3)
    for k in (1, 77, 300) if pivots > 1 else (150,):
        assert ir.kth_key(keys, k, pivots) == order[k - 1]
