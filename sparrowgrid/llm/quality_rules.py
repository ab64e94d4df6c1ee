"""Quality rules by compression bands.

A text is compressed with zstandard as a whole and in fixed chunks. Natural prose of a given length lies in a
band of ratios; text far above it repeats itself, text far below it is noise (encoded data, random strings).
Each band of length has its own limits, as short texts compress less. Counting rules on words and lines
(:func:`base_counts`) come first.

Everything is one pass over each text, in Arrow batches and without any exchange.

Defined results: a null text counts as empty; a text without words has zero counts and fails the base rules;
rows are never merged, so repeated rows give repeated results; an empty table gives an empty result; further
columns of the input, whatever their names, don't matter to :func:`assess` and pass through :func:`keep_good`.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import wordkernel as wk
from .common import bounded_batches, on_batches

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Band:
    """Limits of texts with at least ``least_bytes`` bytes (up to the next band's)."""

    least_bytes: int
    low: float
    high: float


#: Whole texts. Below 500 bytes frame overhead rules the ratio, so there is no lower limit. Measured: base64 and random
#: alphanumeric words reach 1.34 at 1,500 bytes and 1.39 from 8,000 on, ordinary text of sf0.1 at least 1.43, 1.69 from 1,000 bytes and 1.92 from 2,000.
BANDS = (Band(0, 0.0, 3.5), Band(500, 1.35, 4.0), Band(2_000, 1.41, 5.0), Band(10_000, 1.37, 6.5), Band(50_000, 1.41, 8.0))
CHUNK_BYTES = 4_096
#: Of each chunk (the last one ends with the text and overlaps its neighbour), and the share of chunks beyond them that a text may have.
CHUNK_LOW, CHUNK_HIGH, CHUNK_SHARE = 1.35, 6.0, 0.25
LEVEL = 3
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, whole_ratio double, chunk_outliers double, kept boolean"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated_words(words: wk.Words) -> np.ndarray:
    """Words of each text that lie in a 3-word window that the text holds twice or more."""
    at = wk.inside(words.first, 3)
    covered = np.zeros(len(words.hash) + 1, bool)
    if len(at):
        text = words.text_of()[at]
        # One sort for the run: the text number is mixed into its windows' hashes.
        own = wk.window_hashes(words.hash, 3)[at] ^ wk.mix(text.astype(np.uint64) + np.uint64(1))
        order = np.argsort(own)
        same = own[order][1:] == own[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for k in range(3):
            covered[at[twice] + k] = True
    return _sums(covered[:-1], words.first)


def _duplicate_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    raw = data.tobytes()
    out = np.zeros(len(offsets) - 1, np.int64)
    for k, (low, high) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        lines = raw[low:high].split(b"\n")
        if len(lines) > 1:
            lines = [x for x in lines if x and x.strip(b" \t\n\v\f\r")]
            out[k] = len(lines) - len(set(lines))
    return out


def base_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The counting rules' figures for a string column."""
    parts: dict[str, list[np.ndarray]] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    for _, _, w in wk.scan_column(column, lower=False):
        parts["n_words"].append(w.counts)
        parts["word_chars"].append(_sums(~w.space & ((w.data & 0xC0) != 0x80), w.offsets))
        parts["n_symbols"].append(_sums(_SYMBOL[w.data], w.offsets))
        parts["n_dup_lines"].append(_duplicate_lines(w.data, w.offsets))
        parts["n_repeat_words"].append(_repeated_words(w))
    return {k: np.concatenate(v).astype(np.int64) if v else np.empty(0, np.int64) for k, v in parts.items()}


def band_of(n_bytes: int, bands: tuple[Band, ...] = BANDS) -> Band:
    """The last band whose ``least_bytes`` the length reaches."""
    return max((b for b in bands if n_bytes >= b.least_bytes), key=lambda b: b.least_bytes)


def compression(text: memoryview | bytes, compressor: zstandard.ZstdCompressor) -> tuple[float, float]:
    """(ratio of the whole text, share of its chunks beyond the chunk limits); an empty text has ratio 0."""
    n = len(text)
    if not n:
        return 0.0, 0.0
    whole = n / len(compressor.compress(text))
    if n <= CHUNK_BYTES:
        return whole, 0.0
    starts = [*range(0, n - CHUNK_BYTES, CHUNK_BYTES), n - CHUNK_BYTES]
    beyond = 0
    for k in starts:
        ratio = CHUNK_BYTES / len(compressor.compress(text[k : k + CHUNK_BYTES]))
        beyond += not CHUNK_LOW <= ratio <= CHUNK_HIGH
    return whole, beyond / len(starts)


def metrics(column: pa.Array, bands: tuple[Band, ...] = BANDS) -> dict[str, np.ndarray]:
    """All columns of :data:`METRICS` for a string column."""
    out = base_counts(column)
    data, offsets = wk.string_buffers(column)
    view, compressor = memoryview(np.ascontiguousarray(data)), zstandard.ZstdCompressor(level=LEVEL)
    n = len(offsets) - 1
    whole, beyond, inside = np.zeros(n), np.zeros(n), np.zeros(n, bool)
    for k, (low, high) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        whole[k], beyond[k] = compression(view[low:high], compressor)
        band = band_of(high - low, bands)
        inside[k] = band.low <= whole[k] <= band.high and beyond[k] <= CHUNK_SHARE
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    out |= {"whole_ratio": whole, "chunk_outliers": beyond, "kept": ~out["base_failed"] & inside}
    return out


def _assess(batch: pa.RecordBatch, bands: tuple[Band, ...]) -> pa.RecordBatch:
    found = metrics(batch.column(1), bands)
    return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[k.split()[0]]) for k in METRICS.split(", "))], names=["id", *(k.split()[0] for k in METRICS.split(", "))])


def _good(batch: pa.RecordBatch, text: str, bands: tuple[Band, ...]) -> pa.RecordBatch:
    return batch.filter(pa.array(metrics(batch.column(batch.schema.names.index(text)), bands)["kept"]))


def assess(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bands: tuple[Band, ...] = BANDS) -> DataFrame:
    """A row of figures and verdicts for each row of ``docs``: ``doc_id`` and :data:`METRICS`."""
    two = bounded_batches(docs).select(docs[doc_id].alias("id"), docs[text].alias("text"))
    kind = two.schema["id"].dataType.simpleString()
    return two.mapInArrow(on_batches(functools.partial(_assess, bands=bands)), f"id {kind}, {METRICS}").withColumnRenamed("id", doc_id)


def keep_good(docs: DataFrame, text: str = "text", bands: tuple[Band, ...] = BANDS) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns as they are."""
    return bounded_batches(docs).mapInArrow(on_batches(functools.partial(_good, text=text, bands=bands)), docs.schema)
