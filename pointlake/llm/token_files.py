"""Token ids in fixed-width bit-packed files.

Texts are range-partitioned and sorted by id, encoded, and each partition writes one file:

    "PLTOK1\\0\\0" | blocks | footer | length of the footer (int64) | "PLTOK1\\0\\0"

A block holds BLOCK_IDS ids as ``width`` little-endian 64-bit words per 64 ids, ``width`` being the fewest
bits that hold every id of the vocabulary. The footer has the counts, the byte offset of every block, and
for every document its id and the number of its first token in the file, so that any token range is read
from the blocks that hold it, and unpacked with numpy. Executors write to the folder that they share with
the driver, first under a name of the task attempt; a task that runs again gives the same file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textnum as tx
from .cached_encode import ChunkEncoder
from .shared import cut, open_read, open_write, scratch

MAGIC = b"PLTOK1\0\0"
BLOCK_IDS = 64 * 1024


def bit_width(vocabulary: int) -> int:
    """The fewest bits that hold the ids 0 .. vocabulary - 1."""
    return max(1, (max(1, vocabulary) - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> np.ndarray:
    """Pack ids (a multiple of 64 of them) into little-endian 64-bit words."""
    rows = ids.astype(np.uint64).reshape(-1, 64)
    out = np.zeros((len(rows), width), np.uint64)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        out[:, word] |= rows[:, j] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= rows[:, j] >> np.uint64(64 - shift)
    return out.reshape(-1).astype("<u8")


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    """The inverse of ``pack``."""
    rows = words.reshape(-1, width).astype(np.uint64)
    out = np.empty((len(rows), 64), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        x = rows[:, word] >> np.uint64(shift)
        if shift + width > 64:
            x = x | (rows[:, word + 1] << np.uint64(64 - shift))
        out[:, j] = x & mask
    return out.reshape(-1)


class Writer:
    """Writes one file in parts; ``close`` gives the numbers of documents and of ids."""

    def __init__(self, file, width: int):
        self.file, self.width = file, width
        self.left, self.blocks, self.at = np.zeros(0, np.int64), [], len(MAGIC)
        self.doc, self.has, self.count, self.n = [], [], [], 0
        file.write(MAGIC)

    def _block(self, ids: np.ndarray) -> None:
        self.blocks.append(self.at)
        self.at += self.file.write(pack(np.pad(ids, (0, -len(ids) % 64)), self.width).tobytes())

    def add(self, doc: np.ndarray, has: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        self.doc.append(doc), self.has.append(has), self.count.append(count)
        self.n += len(ids)
        ids = np.r_[self.left, ids]
        whole = len(ids) // BLOCK_IDS * BLOCK_IDS
        for i in range(0, whole, BLOCK_IDS):
            self._block(ids[i : i + BLOCK_IDS])
        self.left = ids[whole:]

    def close(self) -> tuple[int, int]:
        if len(self.left):
            self._block(self.left)
        doc, has, count = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.doc, self.has, self.count))
        head = np.array([self.width, self.n, len(doc), len(self.blocks)], "<i8")
        footer = b"".join(x.astype("<i8").tobytes() for x in (head, np.array(self.blocks), doc, has, np.cumsum(count) - count))
        self.file.write(footer + len(footer).to_bytes(8, "little") + MAGIC)
        self.file.close()
        return len(doc), self.n


class Reader:
    """Random access to one file: ``doc``, ``has``, ``start`` of each document and ``read(a, b)``."""

    def __init__(self, file):
        self.file = file
        size = file.seek(0, 2)
        file.seek(size - 16)
        tail = file.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a token file, or cut off")
        n = int.from_bytes(tail[:8], "little")
        file.seek(size - 16 - n)
        parts = np.frombuffer(file.read(n), "<i8")
        self.width, self.n, docs, blocks = (int(x) for x in parts[:4])
        self.blocks = parts[4 : 4 + blocks]
        self.doc, self.has, self.start = parts[4 + blocks :].reshape(3, docs)

    def read(self, a: int, b: int) -> np.ndarray:
        """The ids with numbers a .. b - 1 in the file."""
        if b <= a:
            return np.zeros(0, np.uint32)
        first, last = a // BLOCK_IDS, (b - 1) // BLOCK_IDS
        out = []
        for k in range(first, last + 1):
            ids = min(BLOCK_IDS, self.n - k * BLOCK_IDS)
            self.file.seek(int(self.blocks[k]))
            words = np.frombuffer(self.file.read((ids + 63) // 64 * self.width * 8), "<u8")
            out.append(unpack(words, self.width)[:ids])
        return np.concatenate(out)[a - first * BLOCK_IDS : b - first * BLOCK_IDS]


def safe_cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of texts that a byte-level pre-tokenizer never joins: (start, end, chunks before each text).

    A chunk ends before a single space between two characters that aren't white space: a pre-token of that kind
    of tokenizer may begin with such a space but never has it inside, and no lookahead crosses it. Beside bytes
    that may belong to other Unicode white space no cut is made.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    before, before2, after = np.full(n, 32, np.uint8), np.full(n, 32, np.uint8), np.full(n, 32, np.uint8)
    before[1:], before2[2:], after[:-1] = data[:-1], data[:-2], data[1:]
    safe_before = ((before > 32) & (before < 128)) | ((before >= 128) & (before2 >= 0xC3) & (before2 <= 0xDF))
    safe_after = (after > 32) & ~np.isin(after, np.array([0xC2, 0xE1, 0xE2, 0xE3], np.uint8))
    cuts = (data == 32) & safe_before & safe_after
    begin = offsets[:-1][offsets[:-1] < offsets[1:]]
    cuts[begin] = True
    start = np.flatnonzero(cuts)
    return start, np.r_[start[1:], n], np.searchsorted(start, offsets)


_ENCODERS: dict[str, ChunkEncoder] = {}


def _encoder(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)

        def encode_new(texts: list[bytes]) -> list:
            return [x.ids for x in tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

        # four times the default: this encoder is alone in its worker, and asking the tokenizer again is what costs
        _ENCODERS[path] = ChunkEncoder(encode_new, most_kept=1_000_000, most_bytes=32 << 20)
    return _ENCODERS[path]


def _write(path: str, folder: str, width: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        task, writer, name, commit = TaskContext.get(), None, "", None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                name = f"{folder}/shard-{task.partitionId():06d}.tok"
                file, commit = open_write(name, f"attempt{task.taskAttemptId()}")
                writer, encoder = Writer(file, width), _encoder(path)
            data, offsets = tx.utf8(batch.column(1))
            has = batch.column(0).is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
            doc = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            for a, b in tx.slices(offsets):
                part, cuts = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                start, end, first = safe_cuts(part, cuts)
                count, ids = encoder.encode(part, start, end)
                total = np.r_[0, np.cumsum(count)][first]
                each = np.diff(total)
                writer.add(doc[a:b], has[a:b], each + 1, np.insert(ids, total[1:], end_id))
        if writer is not None:
            n_docs, n_ids = writer.close()
            commit()
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([name]), pa.array([n_docs], pa.int64()), pa.array([n_ids], pa.int64())], names=["shard", "path", "n_docs", "n_ids"])

    return run


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 0, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Encode every whole text and write ids in ascending id order; returns the files: shard, path, n_docs, n_ids.

    A null text counts as empty and gives ``end_id`` alone. Rows without an id come first; rows that repeat an
    id stand together, in the order of their texts. Other columns are not read. No rows give no files.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    width = bit_width(max(end_id + 1, Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True)))
    folder = folder or scratch(spark, "tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    return cut(rows.mapInArrow(_write(tokenizer_path, folder, width, end_id), "shard int, path string, n_docs long, n_ids long"), "shards")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            with open_read(name) as file:
                reader = Reader(file)
                bound = np.r_[reader.start, reader.n]
                a = 0
                while a < len(reader.doc):
                    b = max(a + 1, int(np.searchsorted(bound, bound[a] + 16 * BLOCK_IDS, "right")) - 1)
                    ids = reader.read(int(bound[a]), int(bound[b])).astype("<u4")
                    at = bound[a : b + 1] - bound[a]
                    crc = [zlib.crc32(ids[x:y].tobytes()) for x, y in zip(at[:-1], at[1:], strict=True)]
                    doc = pa.array(reader.doc[a:b], pa.int64(), mask=reader.has[a:b] == 0)
                    yield pa.RecordBatch.from_arrays([doc, pa.array(bound[a:b] + before, pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    a = b


def read_token_files(files: DataFrame) -> DataFrame:
    """Read the files back: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    placed = files.select("path", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("before"))
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(n).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
