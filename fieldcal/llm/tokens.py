"""Whole texts as flat byte arrays: tokens, their hashes and documents, without a loop over rows.

A column of an Arrow batch is one byte array with offsets. Tokens are maximal runs of one byte class inside a
document; their 64-bit hashes come from prefix sums of a polynomial over all bytes of a block, so a long text costs
the same per byte as a short one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text forms a block of its own.
BLOCK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_ODD = np.uint64(0xD6E8FEB86659FD93)

#: Words of up to so many times eight bytes are hashed together.
LANES = 8


def byte_values(seed: int, fold_case: bool) -> np.ndarray:
    """A random 64-bit value for each byte; with ``fold_case`` A-Z have the values of a-z."""
    values = mix(np.arange(1, 257, dtype=np.uint64) + np.uint64((seed * 1000003) & _MASK))
    if fold_case:
        values[65:91] = values[97:123]
    return values


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        p = np.full(n, base, np.uint64)
        p[:1] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = BLOCK_BYTES * 2
    while size < n:
        size *= 2
    return _powers(size)


def prefix_hash(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """h with h[j] - h[i] = sum of values[data[k]] * base**k over i <= k < j."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span, the same wherever it stands."""
    shifted = (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]
    return mix(shifted + (end - start).astype(np.uint64))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes; a longer document is a range of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def text_blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last document, bytes and offsets of each block of a column."""
    data, offsets = buffers(column)
    for a, b in blocks(offsets):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def runs(classes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each maximal run of one class other than 0 inside a document."""
    n = len(classes)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    change = np.ones(n, bool)
    np.not_equal(classes[1:], classes[:-1], out=change[1:])
    first = offsets[:-1]
    change[first[first < n]] = True
    start = np.flatnonzero(change)
    end = np.append(start[1:], n)
    real = classes[start] != 0
    start, end = start[real], end[real]
    return start, end, np.searchsorted(offsets, start, side="right") - 1


@lru_cache(maxsize=1)
def word_class() -> np.ndarray:
    """1 for every byte but 0x20 and 0x09-0x0D."""
    table = np.ones(256, np.uint8)
    table[[0x20, *range(0x09, 0x0E)]] = 0
    return table


@lru_cache(maxsize=1)
def fold_case() -> np.ndarray:
    """Every byte, A-Z as a-z."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def word_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each slice of ``data``, mixed after every eight bytes.

    Unlike a polynomial over the bytes it has no structure that special texts could use. Slices of more than
    ``LANES`` times eight bytes, of which a block holds few, are hashed one by one.
    """
    length = end - start
    out = mix(length.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 1) & _MASK))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from every place on
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    rest = np.flatnonzero(length <= 8 * LANES)
    for k in range(LANES):
        rest = rest[length[rest] > 8 * k]
        if not len(rest):
            break
        lane = lanes[start[rest] + 8 * k] & masks[np.minimum(length[rest] - 8 * k, 8)]
        out[rest] = mix(out[rest] * _ODD + lane)
    for i in np.flatnonzero(length > 8 * LANES).tolist():
        digest = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest()
        out[i] ^= np.uint64(int.from_bytes(digest, "little"))
    return out


def one_blank(data: np.ndarray, word: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words from ``start`` to ``end`` with one blank between two, and their places in there.

    ``word`` is 1 for bytes of words. Neighbours of one text have a blank between them, so n words of a row are one slice.
    """
    if not len(start):
        return b"", start, end
    keep = word.astype(bool)
    keep[1:] |= word[:-1].astype(bool)  # the first byte behind a word
    plain = np.where(word == 0, np.uint8(0x20), data)
    width = end - start
    wide = width + (word[np.minimum(end, len(word) - 1)] == 0)
    at = np.cumsum(wide) - wide
    return plain[keep].tobytes(), at, at + width


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers start[i], start[i] + 1, ... (length[i] of them) for all i in turn."""
    total = int(length.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    before = np.cumsum(length) - length
    return np.arange(total, dtype=np.int64) + np.repeat(start - before, length)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Lists of ``counts`` values each, taken from ``values`` in turn."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
