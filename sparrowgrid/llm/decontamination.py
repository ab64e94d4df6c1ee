"""Benchmark decontamination by CGK embedding and bit sampling.

A benchmark item leaks into a document when a passage of it is within edit similarity ``SIMILARITY`` of the item
(1 - edit distance / length, on characters, with A-Z in lower case and white space as single blanks).

1. Windows. A window as long as an item starts at each word of a document, and at each character of a word behind its first ``LONG_WORD``.
   Its embedding restarts at each of these places too, so that one embedding of a document serves windows of all lengths: a window agrees
   with an item when the embeddings from some place of each agree in a band, and it starts as far before that place as the item does.
2. CGK: a random walk (a pseudo-random bit for each step and character decides whether it stays) embeds what follows a place so that Hamming distance
   follows edit distance: edited characters part two walks for some steps, after which they meet again.
3. Bit sampling: each of ``WALKS`` walks is sampled at places of its first steps; windows whose samples equal the item's are candidates.
   Longer items have more places, one of which is enough, so they can ask for agreement over more steps (``REACHES``).
4. Exact: the least edit distance between the item and any stretch of the window, widened by the edits that are allowed (bit-parallel, many windows at once).

The benchmark is the query set: it is read in blocks of bounded size, each of which passes over all documents once.
Documents are neither shuffled nor cut; windows are made in the task that holds the text.

Defined results: null texts and texts without words match nothing, nor do such items; rows that share an item number are separate texts of that item, of
which the best counts; repeated documents each give their rows; rows without a number are kept, as null; an empty
table on either side gives an empty result; further columns are ignored by :func:`leaks` and pass through
:func:`without_leaks`, whatever their names.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordkernel as wk
from .common import bounded_batches, in_portions, on_batches

SIMILARITY = 0.8
WALKS = 3
#: (Characters of an item at least, steps of a walk, sampled places): the first that an item is long enough for.
REACHES = ((160, 32, 16), (80, 28, 14), (24, 16, 8), (0, 8, 4))
#: Behind so many characters of a word, each one starts windows: some scripts have no blanks.
LONG_WORD = 16
#: Characters of benchmark texts in a task's closure at once.
BLOCK_CHARS = 16 << 20
#: Places that are embedded at once: larger arrays leave the processor's cache, and their memory goes back to the system each time.
PLACES = 1 << 15
#: Windows that are compared at once.
TOGETHER = 4_096
LEAKS = "doc_id long, item_id long, similarity double, start_word long, n_words long"
_SEED = 20250607
_FILTER_BITS = 20


@dataclass
class Chars:
    """A run of texts as characters: of each the low byte of its code, never 0. Words have single blanks between; ``begin`` has their places, and one more."""

    low: np.ndarray
    code: np.ndarray
    begin: np.ndarray
    first: np.ndarray

    @staticmethod
    def of(words: wk.Words) -> Chars:
        flat, begin = wk.joined(words)
        raw = flat.tobytes()
        code = np.frombuffer(raw.decode().encode("utf-32-le"), "<u4")
        if len(code) < len(raw):
            marks = np.zeros(len(flat) + 1, np.int64)
            np.cumsum((flat & 0xC0) != 0x80, out=marks[1:])
            begin = marks[begin]
        low = code.astype(np.uint8)
        low[low == 0] = 1
        return Chars(low, code, begin, words.first)

    def places(self, every: bool = False) -> np.ndarray:
        """Where windows start; ``every``: at each character."""
        if every:
            return np.arange(int(self.begin[0]), len(self.low))
        size = np.diff(self.begin) - 1
        long = np.flatnonzero(size > LONG_WORD)
        if not len(long):
            return self.begin[:-1]
        more = size[long] - LONG_WORD
        ends = np.cumsum(more)
        inner = np.arange(int(ends[-1])) + np.repeat(self.begin[long] + LONG_WORD - (ends - more), more)
        return np.sort(np.concatenate([self.begin[:-1], inner]))


def walk(low: np.ndarray, at: np.ndarray, steps: int, seed: int) -> np.ndarray:
    """CGK embeddings of what follows each place: a row for each step. Behind the end stands 0."""
    padded = np.zeros(len(low) + steps + 1, np.uint8)
    padded[: len(low)] = low
    stay = np.random.default_rng(seed).integers(0, 2, (steps, 256), dtype=np.uint8)
    at = at.astype(np.int64)
    out = np.empty((steps, len(at)), np.uint8)
    for j in range(steps):
        np.take(padded, at, out=out[j], mode="clip")
        at += np.take(stay[j], out[j])
    return out


def samples(embedded: np.ndarray, which: int, reach: int) -> np.ndarray:
    """A band's key of each embedding: its characters at the sampled steps, mixed into one number."""
    _, steps, bits = REACHES[reach]
    places = np.random.default_rng(_SEED + 100 + which).choice(steps, bits, replace=False)
    key = np.zeros(embedded.shape[1], np.uint64)
    for k in range(0, bits, 8):
        block = np.zeros((len(key), 8), np.uint8)
        for j, place in enumerate(places[k : k + 8].tolist()):
            block[:, j] = embedded[place]
        key = wk.mix(key ^ block.view("<u8")[:, 0])
    return key


def nearest(pattern: str, text: str) -> int:
    """The least edit distance between ``pattern`` and any stretch of ``text``."""
    own = {c: k + 1 for k, c in enumerate(dict.fromkeys(pattern))}
    if not own:
        return 0
    masks = row_masks([np.array([own[c] for c in pattern])], len(own) + 1)
    return int(columns(masks, np.array([[own.get(c, 0)] for c in text], np.int64).reshape(-1, 1), np.array([len(pattern)]))[0][0])


def row_masks(patterns: list[np.ndarray], kinds: int) -> np.ndarray:
    """For each 64 rows, pattern and kind of character below ``kinds``, the bits of the rows that have it."""
    out = np.zeros((-(-max(map(len, patterns)) // 64), len(patterns) * kinds), np.uint64)
    for j, p in enumerate(patterns):
        rows = np.arange(len(p))
        np.bitwise_or.at(out, (rows >> 6, j * kinds + p.astype(np.int64)), np.uint64(1) << (rows & 63).astype(np.uint64))
    return out


def columns(masks: np.ndarray, column: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of a pattern and a text the least edit distance of the pattern to a stretch of the text, and where the first such ends.

    ``column`` has a row for each place of the texts, and the masks' place of each text's character there. Bit-parallel, in words of 64 rows of all pairs at once."""
    n, words = len(size), len(masks)
    # Longer patterns come first, so that a word of rows is worked out for those that reach it alone.
    order = np.argsort(-(-(-size // 64)), kind="stable")
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    column, size = np.ascontiguousarray(column[:, order]), size[order]
    reach = [int((size > 64 * w).sum()) for w in range(words)] + [0]
    one, top, high = np.uint64(1), np.uint64(63), ((size - 1) & 63).astype(np.uint64)
    plus, minus = np.full((words, n), ~np.uint64(0)), np.zeros((words, n), np.uint64)
    score, best, where = size.copy(), size.copy(), np.zeros(n, np.int64)
    none = np.zeros(n, np.uint64)
    for c in range(len(column)):
        up = down = none
        for w in range(words):
            m, longer = reach[w], reach[w + 1]
            if not m:
                break
            up, down = up[:m], down[:m]
            eq, p, q = masks[w, column[c, :m]], plus[w, :m], minus[w, :m]
            xv = eq | q
            eq |= down
            xh = (((eq & p) + p) ^ p) | eq
            ph, mh = q | ~(xh | p), p & xh
            if longer < m:
                score[longer:m] += (ph[longer:] >> high[longer:m] & one).view(np.int64) - (mh[longer:] >> high[longer:m] & one).view(np.int64)
            ph_out, mh_out = ph >> top, mh >> top
            ph, mh = ph << one | up, mh << one | down
            plus[w, :m], minus[w, :m] = mh | ~(xv | ph), ph & xv
            up, down = ph_out, mh_out
        better = np.flatnonzero(score < best)
        if len(better):
            best[better] = score[better]
            where[better] = c + 1
    best, where = best[back], where[back]
    return best, where


@dataclass
class Item:
    """A benchmark text as the tasks need it."""

    item_id: int | None
    low: np.ndarray
    code: np.ndarray
    n_words: int
    edits: int


@dataclass
class Band:
    """The keys of a walk and a reach, sorted, with their items and places there; ``seen`` tells most other keys."""

    walk: int
    reach: int
    key: np.ndarray
    item: np.ndarray
    place: np.ndarray
    seen: np.ndarray


@dataclass
class Benchmark:
    """A block of items with their bands."""

    items: list[Item]
    bands: list[Band]

    @staticmethod
    def of(rows: list[tuple[int | None, str | None]]) -> Benchmark:
        items: list[Item] = []
        found: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for base, _, words in wk.scan_column(pa.array([t for _, t in rows], pa.string())):
            chars = Chars.of(words)
            for k, n in enumerate(words.counts.tolist()):
                if not n:
                    continue
                a, b = int(words.first[k]), int(words.first[k + 1])
                start, end = int(chars.begin[a]), int(chars.begin[b]) - 1
                own = Chars(chars.low[start:end], chars.code[start:end], np.r_[chars.begin[a:b], end + 1] - start, np.array([0, n]))
                reach = next(r for r, (least, _, _) in enumerate(REACHES) if end - start >= least)
                at = own.places(reach == len(REACHES) - 1)
                for w in range(WALKS):
                    found.setdefault((w, reach), []).append((samples(walk(own.low, at, REACHES[reach][1], _SEED + w), w, reach), np.full(len(at), len(items)), at))
                items.append(Item(rows[base + k][0], own.low.copy(), own.code.copy(), n, math.floor((1 - SIMILARITY) * (end - start) + 1e-9)))
        bands = []
        for (w, reach), parts in sorted(found.items()):
            key, item, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((place, item, key))
            seen = np.zeros(1 << _FILTER_BITS, bool)
            seen[(key >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
            bands.append(Band(w, reach, key[order], item[order], place[order], seen))
        return Benchmark(items, bands)


def candidates(chars: Chars, bench: Benchmark) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, place where the item would start) of the windows that agree with an item in a band; each once, in order."""
    places = chars.places()
    steps = max((REACHES[b.reach][1] for b in bench.bands), default=0)
    own: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(0, len(places), PLACES):
        at = places[k : k + PLACES]
        # A walk reads no more than its steps behind a place.
        begin, end = int(at[0]), int(at[-1]) + steps + 1
        embedded: dict[int, np.ndarray] = {}
        for band in bench.bands:
            if band.walk not in embedded:
                embedded = {band.walk: walk(chars.low[begin:end], at - begin, steps, _SEED + band.walk)}
            key = samples(embedded[band.walk], band.walk, band.reach)
            maybe = np.flatnonzero(band.seen[(key >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            low = np.searchsorted(band.key, key[maybe], "left")
            times = np.searchsorted(band.key, key[maybe], "right") - low
            entry = np.repeat(low - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
            where = np.repeat(at[maybe], times)
            own.append((band.item[entry] << 36 | (where - band.place[entry] + (1 << 34)), where))
    if not own:
        return (np.empty(0, np.int64),) * 3
    code, where = (np.concatenate(x) for x in zip(*own, strict=True))
    text = np.searchsorted(chars.begin[chars.first[1:]], where, "right")
    order = np.lexsort((code, text))
    text, code = text[order], code[order]
    new = np.r_[True, (code[1:] != code[:-1]) | (text[1:] != text[:-1])][: len(code)]
    return text[new], code[new] >> 36, (code[new] & ((1 << 36) - 1)) - (1 << 34)


def _string(code: np.ndarray) -> str:
    return code.astype("<u4").tobytes().decode("utf-32-le")


def _compared(low: np.ndarray, items: list[Item], item: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(windows, least distance, its end) by portions of bounded size; characters are told apart by their codes' low bytes."""
    size = np.array([len(x.low) for x in items], np.int64)
    order = np.argsort(begin - end, kind="stable")
    k = 0
    while k < len(order):
        longest = int((end - begin)[order[k]])
        some = order[k : k + max(1, min(TOGETHER, (1 << 21) // max(longest, 1)))]
        k += len(some)
        own, row = np.unique(item[some], return_inverse=True)
        # A row for each place, made one by one: arrays of places would be many times the letters.
        column = np.empty((longest, len(some)), np.int32)
        at, rest, masks = begin[some], (end - begin)[some], (row * 256).astype(np.int32)
        for c in range(longest):
            np.add(masks, np.where(c < rest, low.take(at + c, mode="clip"), np.uint8(0)), out=column[c])
        yield some, *columns(row_masks([items[j].low for j in own.tolist()], 256), column, size[item[some]])


def windows_of(chars: Chars, bench: Benchmark, edits: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, item, begin, end) of the stretches in which passages may lie."""
    text, item, start = candidates(chars, bench)
    if not len(text):
        return text, item, start, start
    # Windows of an item that start within the allowed edits of each other are one, which holds what each of them does.
    new = np.r_[True, (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > edits[item[1:]])][: len(text)]
    at = np.flatnonzero(new)
    text, item, first, last = text[at], item[at], start[at], start[np.r_[at[1:], len(new)] - 1]
    begin = np.maximum(first - edits[item], chars.begin[chars.first[text]])
    return text, item, begin, np.minimum(last + size[item] + edits[item], chars.begin[chars.first[text + 1]] - 1)


def find_leaks(column: pa.Array, bench: Benchmark) -> list[tuple[int, int, float, int]]:
    """(row, item, similarity, passage's first word) of the passages of a string column; the best one for each row and item."""
    edits, size = (np.array(x, np.int64) for x in ([x.edits for x in bench.items], [len(x.code) for x in bench.items]))
    runs: list[tuple[int, Chars]] = []
    parts: list[tuple[np.ndarray, ...]] = []
    held = 0
    for base, _, words in wk.scan_column(column):
        chars = Chars.of(words)
        text, item, begin, end = windows_of(chars, bench, edits, size)
        if len(text):
            parts.append((np.full(len(text), len(runs)), text, item, begin + held, end + held))
            runs.append((base, chars))
            held += len(chars.low)
    found: dict[tuple[int, int], tuple[float, int]] = {}
    if not runs:
        return []
    run, text, item, begin, end = (np.concatenate(x) for x in zip(*parts, strict=True))
    low, code = (np.concatenate([getattr(c, x) for _, c in runs]) for x in ("low", "code"))
    before = np.cumsum([0, *(len(c.low) for _, c in runs)])
    for some, best, where in _compared(low, bench.items, item, begin, end):
        for j in np.flatnonzero(best <= edits[item[some]]).tolist():
            k = int(some[j])
            i, least, a, b = int(item[k]), int(best[j]), int(begin[k]), int(end[k])
            if max(code[a:b].max(), bench.items[i].code.max()) > 255:  # characters with equal low bytes
                least = nearest(_string(bench.items[i].code), _string(code[a:b]))
            base, chars = runs[run[k]]
            similarity, row = 1 - least / int(size[i]), base + int(text[k])
            if least <= edits[i] and similarity > found.get((row, i), (0.0, 0))[0]:
                place = max(a + int(where[j]) - int(size[i]), a) - int(before[run[k]])
                found[row, i] = similarity, max(0, int(np.searchsorted(chars.begin, place, "right")) - 1 - int(chars.first[text[k]]))
    return [(row, item, similarity, start) for (row, item), (similarity, start) in sorted(found.items())]


def _leaks(batch: pa.RecordBatch, bench: Benchmark) -> pa.RecordBatch | None:
    rows = find_leaks(batch.column(1), bench)
    if not rows:
        return None
    where, item, similarity, start = zip(*rows, strict=True)
    kinds = [pa.int64(), pa.float64(), pa.int64(), pa.int64()]
    rest = ([bench.items[k].item_id for k in item], similarity, start, [bench.items[k].n_words for k in item])
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(where)), *(pa.array(x, t) for x, t in zip(rest, kinds, strict=True))], names=[x.split()[0] for x in LEAKS.split(", ")])


def _without(batch: pa.RecordBatch, text: int, bench: Benchmark) -> pa.RecordBatch:
    clean = np.ones(batch.num_rows, bool)
    clean[[x[0] for x in find_leaks(batch.column(text), bench)]] = False
    return batch.filter(pa.array(clean))


def blocks_of(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> Iterator[Benchmark]:
    """The items in blocks of bounded size."""
    two = benchmark.select(benchmark[item_id].cast("long").alias("item_id"), benchmark[text].alias("text")).filter(F.col("text").isNotNull())
    size = two.agg(F.sum(F.length("text"))).first()[0] or 0
    count = -(-size // block_chars)
    for k in range(count):
        own = two if count == 1 else two.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k)
        yield Benchmark.of([(r.item_id, r.text) for r in own.orderBy("item_id", "text").collect()])


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each document and item that leaked into it, with the best passage's similarity and place."""
    two = bounded_batches(docs).select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    found = [two.mapInArrow(in_portions(on_batches(functools.partial(_leaks, bench=b))), LEAKS) for b in blocks_of(benchmark, block_chars=block_chars)]
    return functools.reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], LEAKS)


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` into which no item leaked, with their columns as they are."""
    names = docs.columns
    rest = bounded_batches(docs).toDF(*[f"c{k}" for k in range(len(names))])
    for b in blocks_of(benchmark, block_chars=block_chars):
        rest = rest.mapInArrow(in_portions(on_batches(functools.partial(_without, text=names.index(text), bench=b))), rest.schema)
    return rest.toDF(*names)
