"""SentencePiece-style encoding and decoding by a max-plus parallel scan.

A text is segmented into pieces of the vocabulary so that the sum of piece scores is greatest. Spaces count as
the mark U+2581 and one mark is put before the text, as in the vocabulary's own library; a character that
no piece covers becomes the pieces of its bytes. Scores are integers, so sums are exact in any order.

Except within runs of marks, pieces hold a mark only at their start. A text is therefore cut before every mark
that follows another character: at such a place the boundary has one state, a chunk's transfer matrix one
entry, and the chunks' best paths simply join. Each worker keeps the ids of every distinct chunk.

A giant document is cut anywhere instead, into chunks of a fixed number of characters that are tasks of their
own. A boundary's state is the number of characters by which the last piece reaches beyond it. Every chunk
yields the matrix of best scores from each state at its start to each state at its end. Groups of chunks combine
theirs by an associative max-plus scan, then the groups of a document theirs, which gives the best scores of all states
at every boundary. With these each chunk says which state at its start belongs to each state at its end; these maps
are followed from the end of the document, and each chunk is then backtraced by itself.

Of segmentations with one score that is given whose last piece is longest, then the one before it, and so on. Both
ways keep this rule, so it doesn't matter for the ids which of them a text takes.

The vocabulary given here was made for merges, not for scores: its files rank pieces. A piece's score is taken as
its log-probability under Zipf's law by that rank (see ``Vocabulary``), so segmentations are the most probable
ones under that law, and not those of the merge procedure. Decoding gives back the text exactly, but for marks of its own, which become spaces.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tx
from .cached_encode import ChunkEncoder
from .shared import cut, fresh

MARK = "▁"
NEVER = -(1 << 60)
TOGETHER = 256


class Vocabulary:
    """Pieces, scores and byte pieces of a vocabulary file of the sentencepiece library."""

    _read: dict[str, Vocabulary] = {}

    def __init__(self, pieces: dict[str, int], byte_ids: list[int], names: list[str]):
        self.names, self.byte_ids = names, byte_ids
        offset, scale = 10, 10_000
        self.pieces = {p: (i, -round(scale * math.log(r + offset))) for r, (p, i) in enumerate(sorted(pieces.items(), key=lambda x: x[1]))}
        self.byte_score = -round(scale * math.log(len(pieces) + offset)) - 10 * scale
        self.longest = max(map(len, pieces), default=1)
        self.table = {p[:k]: None for p in pieces for k in range(1, len(p))} | self.pieces  # None: only the beginning of a piece
        self.byte_of = {i: b for b, i in enumerate(byte_ids)}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        if path not in cls._read:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            n = model.vocab_size()
            names = [model.id_to_piece(i) for i in range(n)]
            plain = {p: i for i, p in enumerate(names) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
            byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
            cls._read[path] = cls(plain, byte_ids, names)
        return cls._read[path]

    def fallback(self, c: str) -> tuple[int, tuple[int, ...]]:
        """Score and ids of a character that is no piece."""
        raw = c.encode()
        return self.byte_score * len(raw), tuple(self.byte_ids[b] for b in raw)

    def steps(self, text: str, i: int) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """(length, score, ids) of what may start at ``i``."""
        if self.table.get(text[i]) is None:
            yield 1, *self.fallback(text[i])
        for end in range(i + 1, min(len(text), i + self.longest) + 1):
            found = self.table.get(text[i:end], 0)
            if found == 0:
                return
            if found:
                yield end - i, found[1], (found[0],)

    def encode(self, text: str) -> tuple[list[int], int]:
        """(ids, score) of the best segmentation of marked text; ties to the longer last piece."""
        n, table = len(text), self.table
        best, back, said = [NEVER] * (n + 1), [0] * (n + 1), [()] * (n + 1)
        best[0] = 0
        for i in range(n):
            base, end = best[i], i + 1
            found = table.get(text[i])
            if found is None:
                score, ids = self.fallback(text[i])
                if base + score > best[end]:
                    best[end], back[end], said[end] = base + score, i, ids
                if text[i] not in table:
                    continue
            while found != 0:
                if found:
                    score = base + found[1]
                    if score > best[end]:
                        best[end], back[end], said[end] = score, i, (found[0],)
                end += 1
                if end > n:
                    break
                found = table.get(text[i:end], 0)
        out, i = [], n
        while i:
            out.append(said[i])
            i = back[i]
        return [x for ids in reversed(out) for x in ids], best[-1]

    @cached_property
    def trie(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Steps between beginnings of pieces as sorted numbers (beginning, character), the beginning after each, and each one's id or -1 and score."""
        number = {p: i for i, p in enumerate(["", *self.table])}
        steps = np.array([number[p[:-1]] << 21 | ord(p[-1]) for p in self.table], np.int64)
        order = np.argsort(steps)
        ids = np.array([-1, *[-1 if x is None else x[0] for x in self.table.values()]], np.int32)
        scores = np.array([0, *[0 if x is None else x[1] for x in self.table.values()]], np.int64)
        return steps[order], order + 1, ids, scores

    def encode_many(self, texts: list[str], most_chars: int = 100_000) -> list[list[int]]:
        """The ids of ``encode`` for each marked text; those up to ``TOGETHER`` characters are taken together."""
        out: list[list[int]] = [[]] * len(texts)
        some, chars = [], 0
        for i, text in enumerate(texts):
            if len(text) > TOGETHER:
                out[i] = self.encode(text)[0]
                continue
            some.append(i)
            chars += len(text)
            if chars > most_chars:
                self._together(texts, some, out)
                some, chars = [], 0
        self._together(texts, some, out)
        return out

    def _together(self, texts: list[str], some: list[int], out: list[list[int]]) -> None:
        """As ``encode``: all pieces that lie at any place are found length by length, and places of one distance from their
        texts' starts settle at once, as no two of their pieces end at one place. Every text has a place more than characters."""
        code = np.frombuffer("".join(texts[i] + "\0" for i in some).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        size = np.array([len(texts[i]) for i in some], np.int64)
        if not size.sum():
            return
        first = np.cumsum(size + 1) - size - 1
        inside = np.ones(len(code), bool)
        inside[first + size] = False
        steps, then, ids, scores = self.trie
        at = np.flatnonzero(inside)
        end, node, found = at, np.zeros(len(at), np.int64), []
        while len(at):
            key = node << 21 | code[end]
            k = np.searchsorted(steps, key)
            k[k == len(steps)] = 0
            on = (steps[k] == key) & inside[end]
            if end is at or (end == at).all():  # a character that is no piece becomes those of its bytes
                single = np.where(on, ids[then[k]], -1) < 0
                unknown = at[single]
            at, end, node = at[on], end[on] + 1, then[k[on]]
            whole = ids[node] >= 0
            found.append((at[whole], end[whole], scores[node[whole]], ids[node[whole]]))
        spelled = {c: self.fallback(chr(c)) for c in np.unique(code[unknown]).tolist()}
        names = np.array([*spelled], np.int64)
        which = np.searchsorted(names, code[unknown])
        found.append((unknown, unknown + 1, np.array([x[0] for x in spelled.values()], np.int64)[which], (-2 - which).astype(np.int32)))
        begin, end, score, said = (np.concatenate(x) for x in zip(*found, strict=True))
        depth = begin - np.repeat(first, size + 1)[begin]
        order = np.argsort(depth, kind="stable")
        begin, end, score, said = begin[order], end[order], score[order], said[order]
        bounds = np.searchsorted(depth[order], np.arange(int(size.max()) + 1))
        best, back = np.full(len(code), NEVER), np.zeros(len(code), np.int64)
        best[first] = 0
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            new, to = best[begin[a:b]] + score[a:b], end[a:b]
            better = new > best[to]
            best[to[better]], back[to[better]] = new[better], a + np.flatnonzero(better)
        place, rows, path = first + size, np.flatnonzero(size), []
        while len(rows):
            step = back[place[rows]]
            path.append((rows, said[step]))
            place[rows] = begin[step]
            rows = rows[place[rows] > first[rows]]
        rows, said = (np.concatenate([x[j] for x in reversed(path)]) for j in (0, 1))
        order = np.argsort(rows, kind="stable")
        rows, said = rows[order], said[order]
        bytes_of = [x[1] for x in spelled.values()]
        count = np.ones(len(said), np.int64)
        count[said < 0] = [len(bytes_of[-2 - x]) for x in said[said < 0].tolist()]
        flat = np.repeat(said, count)
        flat[np.repeat(said < 0, count)] = [b for x in said[said < 0].tolist() for b in bytes_of[-2 - x]]
        flat, total = flat.tolist(), np.r_[0, np.cumsum(np.bincount(rows, count, len(some)).astype(np.int64))].tolist()
        for j, i in enumerate(some):
            out[i] = flat[total[j] : total[j + 1]]

    def transfer(self, text: str, size: int) -> np.ndarray:
        """Of a chunk of ``size`` characters followed by the rest of ``text``: best score from state to state."""
        states = self.longest
        best = np.full((size + states, states), NEVER, np.int64)
        best[np.arange(min(states, size + 1)), np.arange(min(states, size + 1))] = 0
        for i in range(size):
            for length, score, _ in self.steps(text, i):
                np.maximum(best[i + length], best[i] + score, out=best[i + length])
        out = best[size : size + states].T.copy()  # [state at the start, state at the end]
        out[out < NEVER // 2] = NEVER
        return out

    def paths(self, text: str, size: int, entry: np.ndarray) -> tuple[list[int], list[tuple[int, ...]]]:
        """From the scores of the states at a chunk's start: of each place (the place before it, the ids between them)."""
        best, back, said = [NEVER] * (size + self.longest), list(range(size + self.longest)), [()] * (size + self.longest)
        best[: len(entry)] = entry.tolist()
        for i in range(size):
            if best[i] > NEVER:
                for length, score, ids in self.steps(text, i):
                    # a state at the start is a piece that begins before all of this chunk's
                    if best[i] + score > best[i + length]:
                        best[i + length], back[i + length], said[i + length] = best[i] + score, i, ids
        return back, said

    def begins(self, text: str, size: int, entry: np.ndarray) -> list[int]:
        """The state at the chunk's start on the path to each state at its end that can be reached."""
        back, said = self.paths(text, size, entry)
        out = []
        for end in range(self.longest):
            i = size + end
            while said[i]:
                i = back[i]
            out.append(i)
        return out

    def between(self, text: str, size: int, end: int, entry: np.ndarray) -> list[int]:
        """The ids of the pieces that begin in a chunk, on the path to a state at its end."""
        back, said = self.paths(text, size, entry)
        out, i = [], size + end
        while said[i]:
            out.append(said[i])
            i = back[i]
        return [x for ids in reversed(out) for x in ids]

    def decode(self, ids: list[int]) -> str:
        """The text: byte pieces are joined as UTF-8, marks are spaces, the first one goes."""
        raw = b"".join(bytes((self.byte_of[i],)) if i in self.byte_of else self.names[i].encode() for i in ids)
        return raw.decode("utf-8", "replace").replace(MARK, " ")[1:]


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product of two transfer matrices."""
    return np.maximum((a[:, :, None] + b[None]).max(axis=1), NEVER)


def scan(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """All prefix products, by doubling: each round combines neighbours twice as far apart."""
    out, step = list(matrices), 1
    while step < len(out):
        out = [combine(out[i - step], m) if i >= step else m for i, m in enumerate(out)]
        step *= 2
    return out


def start_scores(states: int) -> np.ndarray:
    """Of the states before the first chunk: nothing reaches into it."""
    return np.where(np.arange(states) == 0, 0, NEVER)


def after(entry: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Scores of the states behind a stretch, from those before it and its matrix."""
    return np.maximum((entry[:, None] + matrix).max(axis=0), NEVER)


def end_states(begins: list[list[int]]) -> list[int]:
    """The state at each chunk's end, from the chunks' maps; the last one ends in state 0."""
    out, state = [], 0
    for into in reversed(begins):
        out.append(state)
        state = into[state]
    return out[::-1]


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def _cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks that begin at a space after another character: (start, end, chunks before each text)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    cuts = np.zeros(n, bool)
    cuts[1:] = (data[1:] == 32) & (data[:-1] != 32)
    # a mark of the text itself is a character of three bytes, beside which nothing is cut
    mark = np.zeros(n, bool)
    mark[2:] = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)
    cuts[1:] &= ~mark[:-1]
    cuts[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    start = np.flatnonzero(cuts)
    return start, np.r_[start[1:], n], np.searchsorted(start, offsets)


_ENCODERS: dict[str, tuple[ChunkEncoder, ChunkEncoder]] = {}


def _encoders(path: str) -> tuple[ChunkEncoder, ChunkEncoder]:
    """For chunks at the start of a text, which get a mark before them, and for the others."""
    if path not in _ENCODERS:
        v = Vocabulary.load(path)
        of = lambda before: ChunkEncoder(lambda texts: v.encode_many([before + t.decode().replace(" ", MARK) for t in texts]))
        _ENCODERS[path] = of(MARK), of("")
    return _ENCODERS[path]


def _encode_all(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_of, other_of = _encoders(path)
        for batch in batches:
            data, offsets = tx.utf8(batch.column(batch.num_columns - 1))
            for a, b in tx.slices(offsets):
                part, cuts = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                start, end, first = _cuts(part, cuts)
                lead = np.zeros(len(start), bool)
                lead[first[:-1][first[:-1] < first[1:]]] = True
                count = np.zeros(len(start), np.int64)
                count[lead], ids_lead = first_of.encode(part, start[lead], end[lead])
                count[~lead], ids_other = other_of.encode(part, start[~lead], end[~lead])
                at = np.repeat(lead, count)
                ids = np.empty(len(at), np.int32)
                ids[at], ids[~at] = ids_lead, ids_other
                total = np.r_[0, np.cumsum(count)][first]
                lists = pa.ListArray.from_arrays(pa.array(total, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in batch.columns[:-1]], lists], names=[*batch.schema.names[:-1], "token_ids"])

    return run


def _matrices(path: str, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary.load(path)
        for batch in batches:
            sizes = [min(chunk, n - i * chunk) for i, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            found = [v.transfer(t, n).tobytes() for t, n in zip(batch.column(3).to_pylist(), sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["key", "i", "matrix"])

    return run


def _square(raw: bytes) -> np.ndarray:
    x = np.frombuffer(raw, np.int64)
    return x.reshape(math.isqrt(len(x)), -1)


def _ordered(table: pa.Table, by: str) -> pa.Table:
    return table.take(pa.array(np.argsort(table[by].to_numpy())))


def _prefixes(key: tuple, table: pa.Table) -> pa.Table:
    """Of a group of neighbouring chunks: the product before each chunk (null for the first), and at the last one that of all."""
    table = _ordered(table, "i")
    products = [m.tobytes() for m in scan([_square(x) for x in table["matrix"].to_pylist()])]
    whole = [None] * (len(products) - 1) + products[-1:]
    return pa.table({"key": table["key"], "part": table["part"], "i": table["i"], "before": pa.array([None, *products[:-1]], pa.binary()), "whole": pa.array(whole, pa.binary())})


def _entries(key: tuple, table: pa.Table) -> pa.Table:
    """Of a document's groups: the scores of the states before each."""
    table = _ordered(table, "part")
    products = scan([_square(x) for x in table["whole"].to_pylist()])
    start = start_scores(len(products[0]))
    entry = [start, *[after(start, m) for m in products[:-1]]]
    return pa.table({"key": table["key"], "part": table["part"], "entry": pa.array([e.astype(np.int64).tobytes() for e in entry], pa.binary())})


def _begins(path: str, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary.load(path)
        for batch in batches:
            entries, maps = [], []
            for i, n, text, entry, before in zip(*[batch.column(j).to_pylist() for j in range(1, 6)], strict=True):
                entry = np.frombuffer(entry, np.int64)
                if before is not None:
                    entry = after(entry, _square(before))
                entries.append(entry.tobytes())
                maps.append(v.begins(text, min(chunk, n - i * chunk), entry))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(entries, pa.binary()), pa.array(maps, pa.list_(pa.int32()))], names=["key", "i", "n", "text", "entry", "begins"])

    return run


def _ends(key: tuple, table: pa.Table) -> pa.Table:
    table = _ordered(table, "i")
    return pa.table({"key": table["key"], "i": table["i"], "end": pa.array(end_states(table["begins"].to_pylist()), pa.int32())})


def _backtrace(path: str, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary.load(path)
        for batch in batches:
            rows = zip(*[batch.column(j).to_pylist() for j in range(1, 6)], strict=True)
            ids = [v.between(text, min(chunk, n - i * chunk), end, np.frombuffer(entry, np.int64)) for i, n, text, entry, end in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["key", "i", "ids"])

    return run


def encode_pieces(docs: DataFrame, path: str, giant: int = 65_536, chunk: int = 4096, group: int = 512, text_col: str = "text") -> DataFrame:
    """``docs`` with ``token_ids``: the piece ids of every whole text (an input column of that name is replaced).

    Texts of more than ``giant`` characters are encoded chunk by chunk in parallel, the chunks' matrices combined in
    groups of ``group`` and then by document, where a string's greatest length leaves 1,024 groups at most; the ids are those of the
    other way. A null or empty text has no ids. Of segmentations with one score that with the longest last pieces is
    given. Rows may repeat ids or texts or have none; all stay, with all other columns whatever their names. An empty
    table gives an empty result.
    """
    kept = [c for c in docs.columns if c != "token_ids"]
    whole, key = fresh(docs, "pl_text"), fresh(docs, "pl_key")
    docs = docs.select(*kept, F.coalesce(F.col(text_col), F.lit("")).alias(whole))
    small = docs.where(F.length(whole) <= giant)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields)
    out = small.mapInArrow(_encode_all(path), f"{types}, token_ids array<int>")
    large = docs.where(F.length(whole) > giant)
    large = large.select(*kept, F.sha2(whole, 256).alias(key), F.concat(F.lit(MARK), F.translate(whole, " ", MARK)).alias(whole))
    longest = Vocabulary.load(path).longest
    texts = large.select(F.col(key).alias("key"), F.col(whole).alias("text")).dropDuplicates(["key"]).select("key", F.length("text").alias("n"), "text")
    texts = texts.select("key", "n", "text", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / chunk).cast("int"))).alias("i"))
    chunks = texts.select("key", "i", "n", F.col("text").substr(F.col("i") * chunk + 1, F.lit(chunk + longest)).alias("text"))
    chunks = cut(chunks, "giant-chunks").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "i")
    matrices = chunks.mapInArrow(_matrices(path, chunk), "key string, i int, matrix binary").withColumn("part", F.floor(F.col("i") / group).cast("int"))
    prefixes = cut(matrices.groupBy("key", "part").applyInArrow(_prefixes, "key string, part int, i int, before binary, whole binary"), "giant-prefixes")
    entries = prefixes.where("whole is not null").select("key", "part", "whole").groupBy("key").applyInArrow(_entries, "key string, part int, entry binary")
    known = prefixes.select("key", "part", "i", "before").join(entries, ["key", "part"])
    known = chunks.join(known, ["key", "i"]).select("key", "i", "n", "text", "entry", "before")
    known = cut(known.mapInArrow(_begins(path, chunk), "key string, i int, n int, text string, entry binary, begins array<int>"), "giant-begins")
    ends = known.select("key", "i", "begins").groupBy("key").applyInArrow(_ends, "key string, i int, end int")
    traced = known.drop("begins").join(ends, ["key", "i"]).select("key", "i", "n", "text", "entry", "end").mapInArrow(_backtrace(path, chunk), "key string, i int, ids array<int>")
    joined = traced.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "ids"))).alias("all")).select(F.col("key").alias(key), F.flatten("all.ids").alias("token_ids"))
    return out.unionByName(large.join(joined, key).select(*kept, "token_ids"))


def _decoder(path: str):
    """A function from a column of id lists to texts; null stays null."""
    v = Vocabulary.load(path)
    raw = [bytes((v.byte_of[i],)) if i in v.byte_of else p.encode() for i, p in enumerate(v.names)]
    lengths = np.array([len(r) for r in raw])
    starts = np.cumsum(lengths) - lengths
    all_bytes = np.frombuffer(b"".join(raw), np.uint8)

    def decode(column: pa.Array) -> list[str | None]:
        texts = []
        for ids in column:
            if not ids.is_valid:
                texts.append(None)
                continue
            ids = ids.values.to_numpy()
            n = lengths[ids]
            ends = np.cumsum(n)
            source = np.repeat(starts[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
            texts.append(all_bytes[source].tobytes().decode("utf-8", "replace").replace(MARK, " ")[1:])
        return texts

    return decode


def decode_pieces(encoded: DataFrame, path: str, out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text that ``token_ids`` stand for in ``out_col``; null ids give null."""
    kept = [c for c in encoded.columns if c != out_col]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*kept).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _decoder(path)
        for batch in batches:
            texts = decode(batch.column(kept.index("token_ids")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*kept, out_col])

    return encoded.select(*kept).mapInArrow(run, f"{types}, `{out_col}` string")


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of little-endian 32-bit ids), decoded_md5 from doc_id and token_ids.

    Decodes as ``decode_pieces`` does, in the same pass, so that a task has one Python worker less.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _decoder(path)
        for batch in batches:
            ids = [x.values.to_numpy() for x in batch.column(1)]
            md5 = [hashlib.md5(t.encode()).hexdigest() for t in decode(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), pa.array(md5, pa.string())], names=["doc_id", "n_pieces", "ids_crc32", "decoded_md5"])

    return encoded.select("doc_id", "token_ids").mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, n_pieces long, ids_crc32 long, decoded_md5 string")
