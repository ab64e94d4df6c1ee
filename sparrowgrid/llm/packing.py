"""Packing documents into sequences by column generation for the cutting-stock problem.

A document's ids fill whole sequences first; what remains of it is an item. Items fall into classes of ``grid``
tokens (rounded up), and the histogram of classes, of bounded size, reaches the driver. There a linear program
chooses between patterns (multisets of classes that fit a sequence, at the cost of one) and cutting (an item joins
a stretch that is cut where sequences are full, at the cost of its share of a sequence and a little more). It is
solved by a revised simplex method; a knapsack dynamic program over the dual prices finds the next pattern or
proves that there is none. As cutting caps the prices, only patterns that fill a sequence almost wholly pay.
Patterns are used as often as their rounded-down weights say; what the rounding leaves is packed where
that fills sequences, by arithmetic on the classes' counts, and is cut otherwise. The end of the stretch is cut into sequences whose lengths are powers
of two, which need no padding.

Ranks tie patterns to documents: an item's rank in its class decides its pattern, the pattern's instance and its
slot there, or its place in the stretch, by arithmetic. Ranks are a task's own count plus the counts of the tasks
before it, so that no class, however common, meets in one task. Ids are encoded once, and kept in a table in the
shared folder.

Defined results: a null text counts as empty and is the end id alone; repeated rows and equal numbers are
documents of their own; rows without a number are packed as well; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import bounded_batches, shared_path, staged

LENGTH, GRID = 2048, 4
#: Offsets of tasks' ranks are broadcast up to this number of rows (24 bytes each), and joined beyond.
BROADCAST_ROWS = 1_000_000
ENCODED = "doc_id long, ids binary, n long, part long, seq long, class int, rank long, full_rank long"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long"


def _encode(batches: Iterator[pa.RecordBatch], vocabulary: str, style: str, end_id: int, length: int, grid: int) -> Iterator[pa.RecordBatch]:
    encoder, end, part = tokens.encoder(vocabulary, style), np.array([end_id], "<u2").tobytes(), TaskContext.get().partitionId()
    seen, seq, full = np.zeros(length // grid + 2, np.int64).tolist(), 0, 0
    names = [x.split()[0] for x in ENCODED.split(", ")]
    for batch in batches:
        for low, high, ids, bounds in encoder.encode(batch.column(1)):
            raw, cut = ids.tobytes(), (2 * bounds).tolist()
            codes = [raw[a:b] + end for a, b in zip(cut[:-1], cut[1:], strict=True)]
            sizes = np.diff(bounds) + 1
            classes = -(-(sizes % length) // grid)
            ranks = []
            for k in classes.tolist():
                ranks.append(seen[k])
                seen[k] += 1
            fulls = np.cumsum(sizes // length) - sizes // length + full
            m = high - low
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, m), pa.array(codes, pa.binary()), pa.array(sizes), pa.array(np.full(m, part)), pa.array(np.arange(seq, seq + m)), pa.array(classes.astype(np.int32)), pa.array(ranks, pa.int64()), pa.array(fulls)], names=names)
            seq, full = seq + m, full + int((sizes // length).sum())


def knapsack(prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The dearest multiset of classes (class k is k units large and worth ``prices[k]``) within ``capacity``, as counts."""
    best = np.zeros(capacity + 1)
    take = np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        worth = prices[1 : c + 1] + best[c - 1 :: -1]
        k = int(worth.argmax())
        if worth[k] > best[c - 1] + 1e-12:
            best[c], take[c] = worth[k], k + 1
        else:
            best[c] = best[c - 1]
    counts, c = np.zeros(len(prices), np.int64), capacity
    while c > 0:
        if take[c]:
            counts[take[c]] += 1
            c -= take[c]
        else:
            c -= 1
    return float(best[capacity]), counts


def column_generation(demand: np.ndarray, capacity: int, cut_cost: float = 0.003, gap: float = 1e-4, rounds: int = 3_000) -> list[tuple[np.ndarray, float]]:
    """Patterns and weights of a least-cost plan for ``demand[k]`` items of size k; items that they don't cover are cut.

    A pattern costs 1; cutting an item of size k costs ``k / capacity * (1 + cut_cost)``. Revised simplex from the plan that cuts
    everything; it ends when nothing can improve the plan, or the plan is within ``gap`` of the bound that the prices prove.
    """
    used = np.flatnonzero(demand)
    if not len(used):
        return []
    m, cap = len(used), used / capacity * (1 + cut_cost)
    columns: list[np.ndarray | None] = [None] * m
    costs, inverse, weights = cap.copy(), np.eye(m), demand[used].astype(float)
    for _ in range(rounds):
        duals = costs @ inverse
        prices = np.full(capacity + 1, -1.0)
        prices[used] = duals
        value, pattern = knapsack(prices, capacity)
        over = duals / cap
        k = int(over.argmax())
        if max(value, over[k]) <= 1 + gap:
            break
        if over[k] > value:
            pattern, cost, entering = None, cap[k], np.eye(m)[k]
        else:
            cost, entering = 1.0, pattern[used]
        direction = inverse @ entering
        ratio = np.full(m, np.inf)
        np.divide(weights, direction, out=ratio, where=direction > 1e-9)
        leave = int(ratio.argmin())
        if not np.isfinite(ratio[leave]):
            break
        step = ratio[leave]
        weights = weights - step * direction
        weights[leave] = step
        np.maximum(weights, 0, out=weights)
        row = inverse[leave] / direction[leave]
        inverse -= np.outer(direction, row)
        inverse[leave] = row
        columns[leave], costs[leave] = pattern, cost
    return [(c, float(w)) for c, w in zip(columns, weights, strict=True) if c is not None and w > 1e-9]


@dataclass
class Plan:
    """For each class: where the ranks of a pattern begin, the pattern's first sequence, its items of the class, and their first slot.

    Ranks from ``covered[class]`` on are cut; ``stretch[class]`` is where those of a class begin in the stretch, in units of ``grid``.
    """

    covered: np.ndarray
    stretch: np.ndarray
    units: int
    sequences: int
    starts: list[np.ndarray] = field(default_factory=list)
    base: list[np.ndarray] = field(default_factory=list)
    count: list[np.ndarray] = field(default_factory=list)
    slot: list[np.ndarray] = field(default_factory=list)


def full_patterns(left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns, with their numbers, that fill sequences from the items ``left``, by arithmetic on the classes' counts.

    The largest class that is left, then the largest that fits, and so on; as often as the counts allow. A class with which no sequence
    fills is given up. Each step uses up or gives up a class, or leaves fewer of one than a pattern takes, so their number doesn't follow the items'."""
    left, out = left.copy(), []
    while (classes := np.flatnonzero(left)[::-1]).size:
        pattern, room = np.zeros(capacity + 1, np.int64), capacity
        for k in classes.tolist():
            pattern[k] = min(int(left[k]), room // k)
            room -= int(pattern[k]) * k
        if room > 1:
            left[classes[0]] = 0
            continue
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        out.append((pattern, times))
        left -= pattern * times
    return out


def solve(demand: np.ndarray, capacity: int) -> Plan:
    """Whole-number patterns for a histogram of classes."""
    left = demand.astype(np.int64).copy()
    left[0] = 0
    chosen: list[tuple[np.ndarray, int]] = []
    for pattern, weight in sorted(column_generation(left, capacity), key=lambda x: -x[1]):
        if times := int(weight + 1e-9):
            times = min(times, int((left[pattern > 0] // pattern[pattern > 0]).min()))
        if times:
            chosen.append((pattern, times))
            left -= pattern * times
    sizes = np.arange(capacity + 1)
    chosen += full_patterns(left, capacity)
    segments: list[list[tuple[int, int, int, int]]] = [[] for _ in range(capacity + 1)]
    at, sequence = np.zeros(capacity + 1, np.int64), 0
    for pattern, times in chosen:
        slot = 0
        for k in np.flatnonzero(pattern).tolist():
            segments[k].append((int(at[k]), sequence, int(pattern[k]), slot))
            at[k] += pattern[k] * times
            slot += int(pattern[k])
        sequence += times
    volume = (demand - at) * sizes
    volume[0] = 0
    plan = Plan(at, np.cumsum(volume) - volume, int(volume.sum()), sequence)
    for own in segments:
        table = np.array(own, np.int64).reshape(-1, 4)
        for place, k in ((plan.starts, 0), (plan.base, 1), (plan.count, 2), (plan.slot, 3)):
            place.append(table[:, k].copy())
    return plan


def powers_of_two(total: int) -> np.ndarray:
    """Borders of stretches of ``total`` whose lengths are powers of two, largest first."""
    points = [0]
    while total:
        step = 1 << (total.bit_length() - 1)
        points.append(points[-1] + step)
        total -= step
    return np.array(points, np.int64)


def _place(batches: Iterator[pa.RecordBatch], plan: Plan, end: dict[tuple[int, int], int], end_tokens: int, n_full: int, length: int, grid: int) -> Iterator[pa.RecordBatch]:
    capacity = length // grid
    last = plan.units - plan.units % capacity
    points = powers_of_two(end_tokens)
    names = [x.split()[0] for x in PIECES.split(", ")]
    for batch in batches:
        out: list[tuple] = []
        for doc, raw, n, part, seq, k, rank, full in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids = np.frombuffer(raw, "<u2").astype("<u4")
            whole = n // length
            pieces = [(j * length, length, full + j, 0) for j in range(whole)]
            at, rest = whole * length, n % length
            if rest and rank < plan.covered[k]:
                s = int(np.searchsorted(plan.starts[k], rank, "right")) - 1
                q, each = rank - int(plan.starts[k][s]), int(plan.count[k][s])
                pieces.append((at, rest, n_full + int(plan.base[k][s]) + q // each, int(plan.slot[k][s]) + q % each))
            elif rest:
                first = n_full + plan.sequences
                place = int(plan.stretch[k]) + (rank - int(plan.covered[k])) * k
                while rest and place < last:
                    size = min(rest, (capacity - place % capacity) * grid)
                    pieces.append((at, size, first + place // capacity, place))
                    at, rest, place = at + size, rest - size, (place // capacity + 1) * capacity
                place = end.get((part, seq), 0)
                while rest:
                    s = int(np.searchsorted(points, place, "right")) - 1
                    size = min(rest, int(points[s + 1]) - place)
                    pieces.append((at, size, first + last // capacity + s, place))
                    at, rest, place = at + size, rest - size, place + size
            out += [(doc, start, size, zlib.crc32(ids[start : start + size]), n, sequence, slot) for start, size, sequence, slot in pieces]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=names)


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", style: str = tokens.BYTE_LEVEL, end_id: int = 1, length: int = LENGTH, grid: int = GRID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece of each document: its place in the document, its sequence and its offset there."""
    spark = docs.sparkSession
    two = bounded_batches(docs).select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    path = shared_path(spark, "packing-ids")
    encoded = two.mapInArrow(functools.partial(_encode, vocabulary=vocabulary, style=style, end_id=end_id, length=length, grid=grid), ENCODED)
    encoded.write.option("compression", "zstd").parquet(path)
    encoded = spark.read.schema(encoded.schema).parquet(path)

    # Ranks: the rows of a class, and the full sequences, in the tasks before.
    counts = encoded.groupBy("part", "class").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.floor(F.col("n") / length)).alias("fulls"))
    counts = staged(counts, "packing-counts")
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per_part = counts.groupBy("part").agg(F.sum("fulls").alias("fulls"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    full_base = per_part.select("part", F.coalesce(F.sum("fulls").over(ahead), F.lit(0)).alias("full_base"))
    offsets = staged(counts.select("part", "class", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base")).join(full_base, "part"), "packing-offsets")
    demand, n_full = np.zeros(length // grid + 1, np.int64), 0
    for row in counts.groupBy("class").agg(F.sum("rows").alias("rows"), F.sum("fulls").alias("fulls")).collect():  # a row for each class
        demand[row["class"]] = row["rows"]
        n_full += row["fulls"]
    plan = solve(demand, length // grid)

    small = offsets.count() <= BROADCAST_ROWS
    ranked = encoded.join(F.broadcast(offsets) if small else offsets, ["part", "class"]).select("doc_id", "ids", "n", "part", "seq", "class", (F.col("rank") + F.col("base")).alias("rank"), (F.col("full_rank") + F.col("full_base")).alias("full"))
    # The end of the stretch: items that reach into its last sequence, so at most one for each unit of a sequence.
    last = plan.units - plan.units % (length // grid)
    sizes = np.arange(len(demand))
    ends = np.flatnonzero((sizes > 0) & (demand > plan.covered) & (plan.stretch + (demand - plan.covered) * sizes > last))
    # An Arrow table becomes rows in the driver's JVM; rows of Python objects would start further workers.
    reach = spark.createDataFrame(pa.table({"class": pa.array(ends, pa.int32()), "covered": pa.array(plan.covered[ends], pa.int64()), "stretch": pa.array(plan.stretch[ends], pa.int64())}))
    place = F.col("stretch") + (F.col("rank") - F.col("covered")) * F.col("class")
    items = ranked.select("n", "part", "seq", "class", "rank").join(F.broadcast(reach), "class").filter("rank >= covered").withColumn("place", place).filter(F.col("place") + F.col("class") > last).collect()
    end, end_tokens = {}, 0
    for row in sorted(items, key=lambda x: x.place):
        end[row.part, row.seq] = end_tokens
        end_tokens += row.n % length - max(0, last - row.place) * grid
    pieces = ranked.mapInArrow(functools.partial(_place, plan=plan, end=end, end_tokens=end_tokens, n_full=n_full, length=length, grid=grid), PIECES)
    there = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("offset", F.coalesce(F.sum("length").over(there), F.lit(0))).drop("slot")
