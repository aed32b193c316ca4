"""Toxicity by a convolutional text classifier trained in numpy.

A word is the sum of two hashed embeddings, of the whole word and of its first letters. Filters of widths 1, 2 and 3
run over all words of the text, each is pooled by its maximum, and a linear layer gives the score. The
classifier is fitted on a bounded sample of labelled documents; a part of the sample that isn't trained on
sets the point where the score is 0.5, and a threshold for each language for those who decide by language.
Neither language nor any other column than the text enters the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tx

WORD_BITS, HEAD_BITS, HEAD_BYTES = 20, 18, 5
ROWS = (1 << WORD_BITS) + (1 << HEAD_BITS) + 1
DIMS, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
PAD = ROWS - 1
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[i for i in range(33, 127) if not chr(i).isalnum()]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(embedding rows of the words, of their heads, number of words before each text)."""
    start, end, first = tx.words(data, offsets)
    start, end = start.copy(), end.copy()
    for _ in range(2):  # up to two marks at either side
        end -= (end - start > 1) & _PUNCTUATION[data[end - 1]]
        start += (end - start > 1) & _PUNCTUATION[data[np.minimum(start, len(data) - 1)]]
    folded = tx.FOLD[data]
    word = tx.hashes(folded, start, end) & np.uint64((1 << WORD_BITS) - 1)
    head = tx.hashes(folded, start, np.minimum(end, start + HEAD_BYTES)) & np.uint64((1 << HEAD_BITS) - 1)
    return word.astype(np.int32), head.astype(np.int32) + (1 << WORD_BITS), first


@dataclass
class Network:
    """The parameters; ``shift`` is taken from the linear layer's sum."""

    table: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    shift: float
    thresholds: dict[str, float]

    def pooled(self, word: np.ndarray, head: np.ndarray, first: np.ndarray, places: bool = False):
        """The pooled filter values of each text, and with ``places`` the places of the maxima and the inputs."""
        n, gap = len(first) - 1, max(WIDTHS)
        length = np.diff(first)
        at = np.arange(len(word)) + np.repeat(np.arange(n), length) * gap
        total = len(word) + n * gap
        rows = np.full((2, total), PAD, np.int64)
        rows[0, at], rows[1, at] = word, head
        x = self.table[rows[0]].astype(np.float32) + self.table[rows[1]]
        x = np.concatenate([x, np.zeros((gap, DIMS), np.float32)])
        begin = first[:-1] + np.arange(n) * gap
        out, where = [], []
        for w, f in zip(WIDTHS, self.filters, strict=True):
            z = x[:total] @ f[0]
            for j in range(1, w):
                z += x[j : total + j] @ f[j]
            out.append(np.maximum.reduceat(z, begin, axis=0))
            if places:
                ends = np.r_[begin[1:], total]
                where.append(np.stack([a + z[a:b].argmax(0) for a, b in zip(begin, ends, strict=True)]))
        pooled = np.concatenate(out, 1) + self.bias
        return (pooled, where, rows, x) if places else pooled

    def logits(self, word: np.ndarray, head: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.maximum(self.pooled(word, head, first), 0) @ self.out - self.shift


def _start(docs: list, labels: np.ndarray, rng: np.random.Generator) -> Network:
    """Small random values; the first dimension starts as the smoothed log-odds of a row's documents."""
    seen = np.zeros((2, ROWS), np.float32)
    for (word, head), y in zip(docs, labels, strict=True):
        seen[int(y), np.unique(np.r_[word, head])] += 1
    total = np.bincount(labels.astype(int), minlength=2)
    known = np.flatnonzero(seen.any(axis=0))  # the other rows stay 0: the table is the largest thing in the driver
    no, yes = seen[:, known].astype(float)
    odds = np.log((yes + 1) / (total[1] + 2)) - np.log((no + 1) / (total[0] + 2))
    table = np.zeros((ROWS, DIMS), np.float32)
    table[known] = rng.normal(0, 0.05, (len(known), DIMS))
    table[known, 0] = odds * (no + yes) / (no + yes + 5)
    table[PAD] = 0
    filters = [rng.normal(0, 0.2, (w, DIMS, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0, :2] = 1 / len(f)
    out = rng.normal(0, 0.05, FILTERS * len(WIDTHS)).astype(np.float32)
    out[::FILTERS] = 0.5
    return Network(table, filters, np.zeros(FILTERS * len(WIDTHS), np.float32), out, 2.0, {})


def train(docs: list, labels: np.ndarray, epochs: int = 2, batch: int = 64, rate: float = 0.01, seed: int = 5) -> Network:
    """Fit by AdaGrad on the logistic loss; ``docs`` are pairs of row arrays."""
    rng = np.random.default_rng(seed)
    net = _start(docs, labels, rng)
    weights = [net.out, net.bias, *net.filters]
    memory = [np.full(w.shape, 0.1, np.float32) for w in weights]
    table_memory = np.full(ROWS, 0.1, np.float32)
    balance = len(labels) / (2 * np.maximum(1, np.bincount(labels.astype(int), minlength=2)))
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for i in range(0, len(order), batch):
            some = order[i : i + batch]
            first = np.r_[0, np.cumsum([len(docs[d][0]) for d in some])]
            word, head = (np.concatenate([docs[d][k] for d in some]) for k in (0, 1))
            pooled, where, rows, x = net.pooled(word, head, first, places=True)
            active = np.maximum(pooled, 0)
            p = 1 / (1 + np.exp(-np.clip(active @ net.out - net.shift, -30, 30)))
            g = ((p - labels[some]) * balance[labels[some].astype(int)] / len(some)).astype(np.float32)
            back = g[:, None] * net.out * (pooled > 0)
            grads = [active.T @ g, back.sum(0)]
            net_shift = -g.sum()
            touched, pulls = [], []
            for k, (w, f) in enumerate(zip(WIDTHS, net.filters, strict=True)):
                b = back[:, k * FILTERS : (k + 1) * FILTERS]
                df = np.zeros_like(f)
                for j in range(w):
                    at = np.minimum(where[k] + j, len(x) - 1)
                    df[j] = np.einsum("nf,nfd->df", b, x[at])
                    pull = b[:, :, None] * f[j].T[None]
                    inside = at < rows.shape[1]
                    for side in (0, 1):
                        touched.append(rows[side][np.minimum(at, rows.shape[1] - 1)][inside])
                        pulls.append(pull[inside])
                grads.append(df)
            net.shift -= rate * float(net_shift) * 0.5
            for value, grad, past in zip(weights, grads, memory, strict=True):
                past += grad**2
                value -= rate * grad / np.sqrt(past)
            touched, pulls = np.concatenate(touched), np.concatenate(pulls)
            unique, which = np.unique(touched, return_inverse=True)
            grad = np.zeros((len(unique), DIMS), np.float32)
            np.add.at(grad, which, pulls)
            table_memory[unique] += (grad**2).mean(1)
            net.table[unique] -= rate * grad / np.sqrt(table_memory[unique])[:, None]
            net.table[PAD] = 0
    return net


def best_threshold(logit: np.ndarray, labels: np.ndarray) -> float:
    """In the gap where F1 is highest, at 0.3 of it from below: rare toxic words leave low scores."""
    order = np.argsort(-logit, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + labels.sum())
    k = int(f1.argmax())
    low = logit[order[k + 1]] if k + 1 < len(order) else logit[order[k]] - 1
    return float(low + 0.3 * (logit[order[k]] - low))


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = tx.utf8(batch.column(0))
        for a, b in tx.slices(offsets):
            word, head, first = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            parts = lambda v: pa.array([v[x:y].tobytes() for x, y in zip(first[:-1], first[1:], strict=True)], pa.binary())  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([parts(word), parts(head), *[batch.column(i).slice(a, b - a) for i in (1, 2, 3)]], names=["word", "head", "lang", "toxic", "part"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 2500, fit_chars: int = 200_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """Fit on at most ``per_class`` toxic and twice as many other documents that aren't held out.

    Held out are the ids whose crc32 as text leaves 0 modulo 5; those that leave 1 calibrate and aren't trained on.
    Ids labelled twice count as toxic if one label says so; null labels don't count. Of rows that repeat an id, the text
    that sorts first by hash is taken. Texts of over ``fit_chars`` characters aren't fitted on, which bounds what the driver
    gathers; a null text counts as empty. None if a class is missing or the tables are empty.
    """
    part = (F.crc32(F.col("doc_id").cast("string")) % 5).cast("int")
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).withColumn("part", part).where("part <> 0")
    pick = lambda y, n: known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = pick(1, per_class).unionByName(pick(0, 2 * per_class))
    met = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).join(F.broadcast(chosen), "doc_id")
    one = met.where(F.coalesce(F.length("text"), F.lit(0)) <= fit_chars).groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "lang", "toxic", "part")).alias("m")).select("m.text", "m.lang", "m.toxic", "m.part")
    rows = one.mapInArrow(_rows_of, "word binary, head binary, lang string, toxic int, part int").collect()
    read = [(np.frombuffer(r["word"], np.int32), np.frombuffer(r["head"], np.int32)) for r in rows]
    toxic, trial = (np.array(x) for x in ([float(r["toxic"]) for r in rows], [r["part"] == 1 for r in rows]))
    said = [r["lang"] or "" for r in rows]
    del rows
    if len({*toxic}) < 2:
        return None
    if len({*toxic[~trial]}) < 2 or len({*toxic[trial]}) < 2:
        trial = np.zeros(len(read), bool)
    order = sorted(np.flatnonzero(~trial), key=lambda i: (toxic[i], read[i][0].tobytes(), read[i][1].tobytes()))
    net = train([read[i] for i in order], toxic[order])
    seen = np.flatnonzero(trial) if trial.any() else np.arange(len(read))
    logit = np.concatenate([net.logits(*_joined([read[i] for i in seen[a : a + 64]])) for a in range(0, len(seen), 64)])
    point = best_threshold(logit, toxic[seen])
    net.shift += point
    logit = logit - point
    langs = np.array([said[i] for i in seen])
    for lang in sorted({*langs}):
        own = langs == lang
        if len({*toxic[seen][own]}) == 2:
            net.thresholds[lang] = float(1 / (1 + np.exp(-best_threshold(logit[own], toxic[seen][own]))))
    net.table = net.table.astype(np.float16)
    return net


def _joined(docs: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.concatenate([d[0] for d in docs]), np.concatenate([d[1] for d in docs]), np.r_[0, np.cumsum([len(d[0]) for d in docs])]


def score_toxicity(docs: DataFrame, net: Network | None, text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """``docs`` with score (0 to 1), predicted (1 from 0.5 on) and over_threshold (by the language's threshold).

    Whole texts are scored; a null or empty text is scored as one without words. Without a network every score is 0.
    Columns of these names in the input are replaced; all others stay, whatever they hold.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)  # of a size fixed by WORD_BITS, HEAD_BITS and DIMS
    new = ("score", "predicted", "over_threshold")
    kept = [c for c in docs.columns if c not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            data, offsets = tx.utf8(batch.column(kept.index(text_col)))
            scores = [np.zeros(0)]
            for a, b in tx.slices(offsets, 1 << 19):
                part = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                scores.append(1 / (1 + np.exp(-np.clip(model.logits(*part).astype(float), -30, 30))) if model else np.zeros(b - a))
            score = np.concatenate(scores)
            lang = batch.column(kept.index(lang_col)).to_pylist() if lang_col else [None] * len(score)
            least = np.array([model.thresholds.get(str(x or ""), 0.5) if model else 0.5 for x in lang])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(score >= least, pa.bool_())], names=[*kept, *new])

    schema = docs.select(*kept).schema.add("score", "double").add("predicted", "integer").add("over_threshold", "boolean")
    return docs.select(*kept).mapInArrow(run, schema)
