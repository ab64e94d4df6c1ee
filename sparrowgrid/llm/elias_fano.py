"""Elias-Fano coding of non-decreasing integers, and token files that use it.

n values up to u take about ``n * (2 + log2(u / n))`` bits: each value's low bits are packed side by side, its high
part is coded in unary in a bit vector, where the i-th one stands at ``high(i) + i``. A table of each 256th one's
position answers ``select`` by a short scan; it holds 32-bit numbers, never one for each value.

File: the magic, the header's length (4 bytes, little-endian), a JSON header (counts; place and length of each
section), then the sections: all ids as little-endian unsigned 16-bit integers, the documents' boundaries
(Elias-Fano, one more than documents), and the documents' numbers (Elias-Fano, from their least).
"""

from __future__ import annotations

import json
import struct

import numpy as np

MAGIC = b"SGTOKEF1"
SAMPLE = 256


def encode(values: np.ndarray, universe: int) -> bytes:
    """Non-decreasing integers of 0 to ``universe``."""
    n = len(values)
    values = np.asarray(values, np.int64)
    width = max(0, int(universe // max(n, 1)).bit_length() - 1)
    high = (values >> width) + np.arange(n)
    bits = np.zeros((universe >> width) + n + 1, bool)
    bits[high] = True
    low = ((values[:, None] >> np.arange(width)) & 1).astype(bool).ravel()
    samples = high[::SAMPLE]
    if len(bits) >= 1 << 32:
        raise ValueError("a file this large needs to be split")
    return struct.pack("<QQBI", n, universe, width, len(bits)) + samples.astype("<u4").tobytes() + np.packbits(bits, bitorder="little").tobytes() + np.packbits(low, bitorder="little").tobytes()


class EliasFano:
    """Read access to what :func:`encode` made."""

    def __init__(self, raw: bytes):
        self.n, self.universe, self._width, self._n_bits = struct.unpack_from("<QQBI", raw)
        at = struct.calcsize("<QQBI")
        count = -(-self.n // SAMPLE)
        self._samples = np.frombuffer(raw, "<u4", count, at)
        at += 4 * count
        self._high = np.frombuffer(raw, np.uint8, -(-self._n_bits // 8), at)
        at += len(self._high)
        self._low = np.frombuffer(raw, np.uint8, -(-self.n * self._width // 8), at)

    def select(self, i: int) -> int:
        """The i-th value, by the samples and a scan of the bits behind one of them."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = int(self._samples[i // SAMPLE])
        left, byte = i % SAMPLE, place >> 3
        head = int(self._high[byte]) >> (place & 7) << (place & 7)
        while (ones := head.bit_count()) <= left:
            left, byte = left - ones, byte + 1
            head = int(self._high[byte])
        for _ in range(left):
            head &= head - 1
        high = 8 * byte + (head & -head).bit_length() - 1 - i
        low = 0
        for k in range(self._width):
            bit = i * self._width + k
            low |= (int(self._low[bit >> 3]) >> (bit & 7) & 1) << k
        return high << self._width | low

    def select_range(self, low: int, high: int) -> np.ndarray:
        """Values ``low`` to ``high`` (not included): one scan from the sample before the first to the one behind the last; nothing else is unpacked."""
        if not 0 <= low <= high <= self.n:
            raise IndexError((low, high))
        if low == high:
            return np.empty(0, np.int64)
        first, behind = low // SAMPLE, -(-high // SAMPLE)
        start = int(self._samples[first]) >> 3
        stop = (int(self._samples[behind]) >> 3) + 1 if behind < len(self._samples) else len(self._high)
        ones = np.flatnonzero(np.unpackbits(self._high[start:stop], bitorder="little")) + 8 * start
        ones = ones[ones >= int(self._samples[first])][low - first * SAMPLE :][: high - low]
        bit = low * self._width
        raw = self._low[bit >> 3 : -(-high * self._width // 8)]
        bits = np.unpackbits(raw, bitorder="little")[bit & 7 :][: (high - low) * self._width].reshape(high - low, self._width).astype(np.int64)
        return (ones - np.arange(low, high) << self._width) + (bits << np.arange(self._width)).sum(1)


def file_bytes(doc_ids: np.ndarray, n_null: int, parts: list[bytes]) -> bytes:
    """A token file: ``doc_ids`` ascend, ``parts`` are the ids of each document, the first ``n_null`` of which have no number."""
    bounds = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) // 2 for p in parts], out=bounds[1:])
    base = int(doc_ids[0]) if len(doc_ids) else 0
    rest = doc_ids.astype(np.int64) - base
    sections = {"ids": b"".join(parts), "bounds": encode(bounds, int(bounds[-1])), "doc_ids": encode(rest, int(rest[-1]) if len(rest) else 0)}
    at, places = 0, {}
    for k, raw in sections.items():
        places[k] = [at, len(raw)]
        at += len(raw)
    header = json.dumps({"n_docs": len(parts), "n_null": n_null, "n_ids": int(bounds[-1]), "base": base, "sections": places}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *sections.values()])


class TokenFile:
    """A token file opened for reading; ids are read by ranges."""

    def __init__(self, source):
        self._source = source
        head = source.read_at(len(MAGIC) + 4, 0)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token file")
        size = struct.unpack("<I", head[len(MAGIC) :])[0]
        self.header = json.loads(source.read_at(size, len(MAGIC) + 4))
        self._at = len(MAGIC) + 4 + size
        self.bounds = EliasFano(self._section("bounds"))
        self.n_docs = self.header["n_docs"]
        self._numbers: EliasFano | None = None

    def _section(self, name: str) -> bytes:
        place, size = self.header["sections"][name]
        return self._source.read_at(size, self._at + place)

    def doc_ids(self, low: int, high: int) -> list[int | None]:
        """The numbers of documents ``low`` to ``high`` in order; those without one come first."""
        if self._numbers is None:
            self._numbers = EliasFano(self._section("doc_ids"))
        null = self.header["n_null"]
        rest = self._numbers.select_range(max(low - null, 0), max(high - null, 0)) + self.header["base"]
        return [None] * (min(high, null) - min(low, null)) + rest.tolist()

    def ids(self, low: int, high: int) -> np.ndarray:
        """ids ``low`` to ``high`` of the file."""
        return np.frombuffer(self._source.read_at(2 * (high - low), self._at + self.header["sections"]["ids"][0] + 2 * low), "<u2")

    def document(self, k: int) -> np.ndarray:
        """The ids of the file's k-th document."""
        return self.ids(self.bounds.select(k), self.bounds.select(k + 1))
