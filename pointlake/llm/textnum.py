"""Vectorised text handling on Arrow string buffers: words, 64-bit hashes of byte ranges, shingles.

All functions take whole texts as UTF-8 bytes straight from Arrow, without making Python strings.

``hashes`` is for ranges such as words: eight bytes at a time go through a bijective scrambling that is chained, so
that ranges of up to eight bytes never share a hash and longer ones only by chance. ``prefix`` and ``ranges``
are for overlapping ranges: one prefix sum, modulo 2**64, of a random number for each pair of neighbouring bytes times
a power of a base. A plain sum over single bytes would give one and the same value to a Thue-Morse string and
its complement; with pairs, the ones that lie across the joints of such strings don't cancel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_rng = np.random.default_rng(20240229)
_PAIRS = _rng.integers(0, 1 << 63, (2, 1 << 16), dtype=np.uint64) * U64(2) + U64(1)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)
_SEED = U64(0x2545F4914F6CDD1D)
_CHAINED = 4
_POWERS: dict[int, list[np.ndarray]] = {}


def _series(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0], have = 1, 1
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * U64(pow(base, have, 1 << 64))
        have += take
    return out


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n, kept for the next call."""
    if which not in _POWERS or len(_POWERS[which][0]) < n:
        size = 1 << max(21, (n - 1).bit_length())
        _POWERS[which] = [_series(_BASES[which], size), _series(pow(_BASES[which], -1, 1 << 64), size)]
    return _POWERS[which][0][:n], _POWERS[which][1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind, width = (pa.string() if pa.types.is_string(column.type) else pa.binary()), np.int32
    else:
        kind = pa.large_string() if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else pa.large_binary()
        column, width = column.cast(kind), np.int64
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(kind) or pa.types.is_large_binary(kind) else "")
    n, buffers = len(column), column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], width)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer text makes a range of its own."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, min(end, n)
        row = min(end, n)


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end), equal for equal bytes wherever they stand."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 9,), "<u8", padded, 0, (1,))  # the eight bytes from every place on
    size = end - start
    out = mix((eight[start] & _MASKS[np.clip(size, 0, 8)]) ^ (size.astype(np.uint64) * _SEED))
    for j in range(1, _CHAINED):
        some = np.flatnonzero(size > 8 * j)
        if not len(some):
            return out
        out[some] = mix(out[some] ^ (eight[start[some] + 8 * j] & _MASKS[np.minimum(size[some] - 8 * j, 8)]))
    some = np.flatnonzero(size > 8 * _CHAINED)
    if len(some):  # what is left of long ranges: every piece scrambled with its number
        count = (size[some] + 7) // 8 - _CHAINED
        first = np.cumsum(count) - count
        number = np.arange(count.sum()) - np.repeat(first, count) + _CHAINED
        at = np.repeat(start[some], count) + 8 * number
        left = np.minimum(np.repeat(end[some], count) - at, 8)
        piece = mix((eight[at] & _MASKS[left]) ^ mix(number.astype(np.uint64) * _SEED))
        out[some] = mix(out[some] ^ np.add.reduceat(piece * _SEED, first))
    return out


def prefix(data: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix sums over the pairs of neighbouring bytes, with a leading zero; see ``ranges``."""
    n = max(0, len(data) - 1)
    up, _ = powers(n + 1, which)
    pair = data[:-1].astype(np.uint16) << np.uint16(8)
    pair |= data[1:]
    out = np.zeros(n + 1, np.uint64)
    np.cumsum(_PAIRS[which][pair] * up[:-1], out=out[1:])
    return out


def ranges(sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end) of two bytes and more; ``which`` as given to ``prefix``."""
    _, down = powers(len(sums), which)
    return mix((sums[end - 1] - sums[start]) * down[start])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first) of the words ``[^\\x20\\x09-\\x0D]+``; first[d] is the number of words before text d."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    gap = SPACE[data]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = gap[:-1]
    before[inner] = True
    after = np.empty(len(data), bool)
    after[-1] = True
    after[:-1] = gap[1:]
    after[inner - 1] = True
    start, end = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    return start, end, np.searchsorted(start, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: ``size`` lower-cased (A-Z) words each.

    A text with fewer words has its whole sequence as its one shingle; one without words has none.
    """
    start, end, first = words(data, offsets)
    h = hashes(FOLD[data], start, end)
    weight = mix(np.arange(1, size + 1, dtype=np.uint64) * U64(0xD6E8FEB86659FD93)) | U64(1)
    n = max(0, len(h) - size + 1)
    whole = np.zeros(n, np.uint64)
    for j in range(size):
        whole += h[j : j + n] * weight[j]
    whole = mix(whole)
    out = []
    for d in range(len(offsets) - 1):
        a, b = int(first[d]), int(first[d + 1])
        if b - a >= size:
            out.append(np.unique(whole[a : b - size + 1]))
        elif b > a:
            out.append(mix((h[a:b] * weight[: b - a]).sum(dtype=np.uint64, keepdims=True) + U64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
