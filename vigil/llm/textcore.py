"""Vectorised text primitives over Arrow string buffers: word bounds, word and window hashes.

A *block* is a run of whole documents of about ``BLOCK_BYTES`` (one longer document is a block of its
own), so working memory follows the largest document, not the batch.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
U64 = np.uint64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_NONSPACE = ~_SPACE
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E6C63D0876A9A35
#: Bits of the first n bytes of a little-endian number.
_LAST = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)
_pow = np.ones(1, U64)


def powers(n: int) -> np.ndarray:
    """_BASE**i modulo 2**64 for i < n."""
    global _pow
    if len(_pow) < n:
        p = np.full(max(n, 64), _BASE, U64)
        p[0] = 1
        _pow = np.multiply.accumulate(p)
    return _pow


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def tidied(f):
    """``f`` for mapInArrow, giving back to the machine at its end what the worker, which lives on, has freed."""

    def run(batches):
        yield from f(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return run


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets (n + 1) and validity of an Arrow string or binary array; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    valid = np.ones(n, bool) if not column.null_count else column.is_valid().to_numpy(zero_copy_only=False)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), valid
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:  # a null slot may cover bytes: rebuild without them
        lens = np.where(valid, np.diff(off), 0)
        if lens.sum() != off[-1] - off[0]:
            data = np.concatenate([data[off[i] : off[i + 1]] for i in np.flatnonzero(valid)] or [np.zeros(0, np.uint8)])
            off = np.concatenate([[0], np.cumsum(lens)])
    return data, off, valid


def blocks(column: pa.Array, size: int = BLOCK_BYTES):
    """(first row, bytes, offsets from 0) of runs of whole documents."""
    data, off, _ = buffers(column)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, side="right")) - 1)
        j = min(j, n)
        yield i, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and each document's first word (n + 1)."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    solid = _NONSPACE[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[off] = True
    before = np.empty(len(buf), bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | cut[:-1]))
    after = np.empty(len(buf), bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def lanes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges as 8-byte numbers, the last one padded with zeros: values, number within the range, each range's first and count."""
    count = (ends - starts + 7) >> 3
    firsts = np.cumsum(count) - count
    number = np.arange(int(count.sum())) - np.repeat(firsts, count)
    at = np.repeat(starts, count) + 8 * number
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    values = np.ndarray((len(buf) + 1,), "<u8", padded, 0, (1,))[at]
    values &= _LAST[np.minimum(np.repeat(ends, count) - at, 8)]
    return values, number, firsts, count


def _lane_hashes(lens: np.ndarray, values: np.ndarray, number: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    mixed = mix(mix(values) + (number.astype(U64) + U64(1)) * U64(_BASE))
    return mix((np.add.reduceat(mixed, firsts) if len(firsts) < len(mixed) else mixed) + lens.astype(U64) * U64(0xD6E8FEB86659FD93))


def segment_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range that isn't empty: its 8-byte lanes, each mixed with its number, summed and mixed.

    Ranges of up to 8 bytes and equal length have equal hashes only if they are equal.
    """
    if not len(starts):
        return np.zeros(0, U64)
    values, number, firsts, _ = lanes(buf, starts, ends)
    return _lane_hashes(ends - starts, values, number, firsts)


def distinct_segments(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One range of each distinct content, and which of them each range equals; decided by the bytes, not by the hash."""
    lens = ends - starts
    values, number, firsts, count = lanes(buf, starts, ends)
    _, index, inverse = np.unique(_lane_hashes(lens, values, number, firsts), return_index=True, return_inverse=True)
    model = index[inverse]
    if (lens == lens[model]).all() and (values == values[np.repeat(firsts[model], count) + number]).all():
        return index, inverse
    raw, seen = buf.tobytes(), {}
    inverse = np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(starts.tolist(), ends.tolist())], np.int64)
    return np.unique(inverse, return_index=True)[1], inverse


def lower(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    s, e, first = words(buf, off)
    return segment_hashes(buf, s, e), first, s, e


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words over the whole array (runs across documents are the caller's to drop).

    A polynomial in the words' hashes; sums of powers of two cancel over runs of a thousand words, so long runs
    go by ``window_hashes``.
    """
    if n > 64:
        return window_hashes(h, n)
    if len(h) < n:
        return np.zeros(0, U64)
    p = powers(n)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out += h[k : len(h) - n + 1 + k] * p[k]
    return mix(out)


def window_hashes(h: np.ndarray, n: int, second: bool = False) -> np.ndarray:
    """Hash of each run of n words in time that grows with log n: a ladder of doubled runs, mixed at each step.

    ``second`` gives another hash of the same runs, so that both make 128 bits.
    """
    if len(h) < n:
        return np.zeros(0, U64)
    size = len(h) - n + 1
    part = mix(h ^ U64(0xA0761D6478BD642F)) if second else h
    odd = U64(0xE7037ED1A0B428DB if second else 0x9FB21C651E98DF25)
    out, done, width, left = None, 0, 1, n
    while left:
        if left & 1:
            piece = part[done : done + size]
            out = piece if out is None else mix(out * odd + piece)
            done += width
        left >>= 1
        if left:
            part = mix(part[: len(part) - width] * odd + part[width:])
            width *= 2
    return mix(out + U64(n))


def crc32_rule(column: str, modulo: int):
    """crc32(doc_id as text) mod ``modulo`` as a Spark column."""
    from pyspark.sql import functions as F

    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulo)


def share_limit(share: float) -> int:
    """The signed 64-bit number below which about ``share`` of all 64-bit hashes lie, for any share however small."""
    return min(int(share * 2.0**64), (1 << 64) - 1) - (1 << 63)


def hash_sample(column: str, limit):
    """Rows whose hash of a column lies under a limit of ``share_limit``: a sample that every run picks alike."""
    from pyspark.sql import functions as F

    return F.xxhash64(column) <= limit
