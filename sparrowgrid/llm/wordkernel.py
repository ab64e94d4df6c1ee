"""Vectorised word scanning: whole Arrow string columns become word positions and 64-bit word hashes.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``. Texts lie end to end in one byte
buffer; a text's first and last byte bound words as white space does. The hash of a word is a chain of bijective
steps, one for each eight bytes, from a seed of its length, so that words of up to eight bytes and equal length never collide;
words of more than ``CHAINED`` bytes take XXH3. Equal words have equal hashes on every machine and in every process.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words of so many bytes are hashed by steps over arrays, longer ones one by one.
CHAINED = 32
#: Stretches of one length up to this one never share a hash.
EXACT = 8
#: Masks of a block's first bytes.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
CHUNK = 1 << 20


def _return_memory() -> None:
    """Let the C library give large blocks back when they are freed, Arrow's among them, as an executor's workers live for many tasks."""
    with contextlib.suppress(AttributeError, OSError, TypeError):
        ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD of glibc; elsewhere there is no such call
        pa.set_memory_pool(pa.system_memory_pool())


_return_memory()


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z as a-z."""
    return _LOWER[data]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def stretch_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the stretches ``data[start[k]:end[k]]``."""
    size = end - start
    out = mix(size.astype(U) * U(0x9E3779B97F4A7C15) + U(0xD6E8FEB86659FD93))
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    blocks = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    own = np.flatnonzero((size > 0) & (size <= CHAINED))
    for k in range(0, CHAINED, 8):
        own = own[size[own] > k] if k else own
        if not len(own):
            break
        out[own] = mix(out[own] ^ (blocks[start[own] + k] & _FIRST[np.minimum(size[own] - k, 8)]))
    long = np.flatnonzero(size > CHAINED)
    if len(long):
        raw = memoryview(padded)
        out[long] = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)), U, len(long))
    return out


@dataclass
class Words:
    """Words of a run of texts: ``first[k]:first[k + 1]`` are those of text ``k``; ``start`` and ``end`` are byte positions in ``data``."""

    data: np.ndarray
    offsets: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    space: np.ndarray
    lower: bool

    @functools.cached_property
    def hash(self) -> np.ndarray:
        """The hash of each word; with ``lower``, A-Z and a-z hash alike."""
        return stretch_hashes(lowered(self.data) if self.lower else self.data, self.start, self.end)

    def hash_of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hashes of any stretches of the data as it is."""
        return stretch_hashes(self.data, start, end)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most ``limit`` bytes in all, or one longer text."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high
        low = high


def scan(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> Words:
    """The words of texts ``data[offsets[k]:offsets[k + 1]]``; with ``lower``, A-Z and a-z hash alike."""
    n = len(data)
    space = _SPACE[data]
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    edge[1:n] = False
    edge[offsets] = True
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0] = after[n - 1] = True
        before[1:] = space[:-1]
        after[:-1] = space[1:]
    word = ~space
    start = np.flatnonzero(word & (before | edge[:n]))
    end = np.flatnonzero(word & (after | edge[1:])) + 1
    return Words(data, offsets, np.searchsorted(start, offsets), start, end, space, lower)


def joined(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """All words in lower case with a blank before and behind each, and the place of each one, with the end of the last."""
    begin = np.r_[0, np.cumsum(words.end - words.start + 1)] + 1
    keep = ~words.space
    behind = words.space[1:] & keep[:-1]  # of the white space behind a word the first
    keep[1:] |= behind
    flat = lowered(words.data)
    flat[words.space] = 32
    flat = flat[keep]
    # A word at its text's end has a blank only where the next text begins with one.
    last = words.end[words.first[1:][words.counts > 0] - 1]
    bare = last[last < len(words.data)]
    bare = bare[~words.space[bare]]
    if len(bare):
        flat = np.insert(flat, begin[np.searchsorted(words.end, bare) + 1] - 2 - np.arange(len(bare)), 32)
    out = np.full(int(begin[-1]), 32, np.uint8)
    # White space before the first word has no word before it and isn't kept.
    out[1 : 1 + len(flat)] = flat
    return out, begin


def scan_column(column: pa.Array, lower: bool = True) -> Iterator[tuple[int, int, Words]]:
    """(first text, end text, words) for bounded runs of a string column."""
    data, offsets = string_buffers(column)
    for low, high in runs(offsets):
        own = offsets[low : high + 1]
        yield low, high, scan(data[own[0] : own[-1]], own - own[0], lower)


_WEIGHTS = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of ``width`` consecutive values (over text borders too: mask those with :func:`inside`)."""
    n = max(0, len(hashes) - width + 1)
    out = np.zeros(n, U)
    for k in range(width):
        out += hashes[k : k + n] * _WEIGHTS[k]
    return mix(out)


def inside(first: np.ndarray, width: int) -> np.ndarray:
    """Positions of the words at which a window of ``width`` words of one text starts."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    total = int(counts.sum())
    return np.arange(total) + np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts)


def shingle_sets(words: Words, width: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its word windows; a text with fewer words is one window, one without words has none."""
    windows = window_hashes(words.hash, width)
    out = []
    for low, high in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        n = high - low
        if n >= width:
            out.append(np.unique(windows[low : high - width + 1]))
        elif n:
            out.append(mix((words.hash[low:high] * _WEIGHTS[:n]).sum(dtype=U, keepdims=True) + U(n * 0xA0761D6478BD642F % 2**64)))
        else:
            out.append(np.empty(0, U))
    return out
