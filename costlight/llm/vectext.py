"""Numpy views of Arrow text: flat bytes, words, and rolling hashes.

Texts are handled as UTF-8 bytes in one flat buffer with document offsets, so that every
step is a vector operation over a bounded chunk.  A word is hashed eight bytes at a time through a
non-linear step.  Sequences of tokens are hashed by doubling: the hash of 2k tokens stirs together
those of its halves, and that of any span stirs together its first and last power of two (they
overlap), so no algebra of the tokens survives as it does with polynomials modulo 2**64.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C13
U64 = np.uint64
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (a bijection)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(32))
        x *= U64(0xD6E8FEB86659FD93)
        x ^= x >> U64(32)
        x *= U64(0xD6E8FEB86659FD93)
        x ^= x >> U64(32)
    return x


def stir(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of two 64-bit values in this order."""
    with np.errstate(over="ignore"):
        x = a * U64(BASE)
        x += b
        x ^= x >> U64(29)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(32)
        x *= U64(0x94D049BB133111EB)
    return x


#: A 64-bit value for each byte.
BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and its n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about limit bytes; a longer document stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


def release() -> None:
    """Gives memory that is free in this process back to the system, as Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def table(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


#: Bytes of words that end at white space: all but 09-0D and 20.
NOT_SPACE = table(bytes(x for x in range(256) if x != 0x20 and not 0x09 <= x <= 0x0D))
#: Bytes of words of letters and digits: 0-9, a-z and all of non-ASCII characters (after lower-casing A-Z).
ALNUM = table(bytes(x for x in range(256) if 0x30 <= x <= 0x39 or 0x61 <= x <= 0x7A or x >= 0x80))
#: Lower-cases A-Z only.
LOWER = np.array([x + 32 if 0x41 <= x <= 0x5A else x for x in range(256)], np.uint8)


def words(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the n+1 offsets of documents in words; no word crosses documents."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    is_in = inside[data]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    begins = is_in.copy()
    begins[1:] &= ~is_in[:-1] | cut[1:n]
    ends = is_in.copy()
    ends[:-1] &= ~is_in[1:] | cut[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, off)


class Rolling:
    """Hashes of spans of a sequence of 64-bit tokens."""

    def __init__(self, tokens: np.ndarray):
        self.n = len(tokens)
        self.levels = [tokens]  # hash of 2**j tokens from each place on

    def _level(self, j: int) -> np.ndarray:
        while len(self.levels) <= j:
            half, size = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(stir(half[:-size], half[size:]) if len(half) > size else np.zeros(0, U64))
        return self.levels[j]

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the tokens and length of each span [start, end); spans are not empty."""
        size = end - start
        out = np.empty(len(start), U64)
        power = np.frexp(size.astype(np.float64))[1] - 1
        for j in np.unique(power).tolist():
            at = np.flatnonzero(power == j)
            level = self._level(j)
            with np.errstate(over="ignore"):
                out[at] = mix(stir(level[start[at]], level[end[at] - (1 << j)]) + size[at].astype(U64))
        return out

    def grams(self, k: int) -> np.ndarray:
        """Hash of each k tokens in a row."""
        if self.n < k:
            return np.zeros(0, U64)
        j = k.bit_length() - 1
        level, last = self._level(j), k - (1 << j)
        h = stir(level[: self.n - k + 1], level[last : last + self.n - k + 1])
        with np.errstate(over="ignore"):
            h += U64(k)
        return mix(h)


_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
_LONG_WORD = 64


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes and length."""
    size = end - start
    h = mix(size.astype(U64) + U64(BASE))
    if not len(start):
        return h
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    live, left, own = slice(None), size, start
    for at in range(0, _LONG_WORD, 8):
        h[live] = stir(h[live], eight[own + at] & _LOW_BYTES[np.minimum(left, 8)])
        more = left > 8
        live = np.flatnonzero(more) if at == 0 else live[more]
        if not len(live):
            return mix(h)
        left, own = left[more] - 8, own[more]
    rest = [int.from_bytes(hashlib.blake2b(data[a + _LONG_WORD : b], digest_size=8).digest()) for a, b in zip(start[live].tolist(), end[live].tolist(), strict=True)]
    h[live] = stir(h[live], np.array(rest, U64))
    return mix(h)


def window_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each width values in a row, by doubling."""
    have, size = v, 1
    while 2 * size <= width:
        have = np.minimum(have[:-size], have[size:])
        size *= 2
    return have if size == width else np.minimum(have[: len(v) - width + 1], have[width - size :])
