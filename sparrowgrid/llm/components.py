"""Connected components of edges between numbers, by contraction.

Each partition first reduces its edges to a forest. Then rounds of large-star and small-star steps (joins and
grouped minima on DataFrames, so that a node with very many edges is combined before the shuffle and its join can
be split) bring each component nearer to a star around its least node. As soon as no more than ``finish_edges``
edges are left (16 bytes each), one task finishes; a larger rest takes further rounds until it no longer changes.

Defined results: null ends and loops are ignored; repeated and reversed edges count once; no edges, no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import one_after_another, staged

FINISH_EDGES = 100_000


def least_labels(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0 to n - 1 the least node that edges (u, v) lead to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as (node, least node of its component); the least nodes themselves are left out."""
    us, vs = [], []
    for batch in batches:
        us.append(batch.column(0).to_numpy(zero_copy_only=False))
        vs.append(batch.column(1).to_numpy(zero_copy_only=False))
    if us and sum(map(len, us)):
        nodes, ends = np.unique(np.concatenate(us + vs), return_inverse=True)
        half = len(ends) // 2
        label = least_labels(ends[:half], ends[half:], len(nodes))
        other = np.flatnonzero(label != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(nodes[label[other]])], names=["u", "v"])


def _stars(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
    large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _print_of(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, finish_edges: int = FINISH_EDGES, made_by: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """(node, root) for the nodes that are not the least of their component. ``edges``: two columns of numbers, or rows of which the Arrow function
    ``made_by`` makes two columns of longs without nulls, in the worker that takes the forest."""
    if made_by:
        first = edges.mapInArrow(one_after_another(made_by, forest), "u long, v long")
    else:
        u, v = (F.col(f"`{c}`").cast("long") for c in edges.columns[:2])
        first = edges.select(u.alias("u"), v.alias("v")).filter("u <> v").mapInArrow(forest, "u long, v long")
    rest = staged(first, "components")
    mark = _print_of(rest)
    while mark[0] > finish_edges:
        new = staged(_stars(rest), "components")
        after = _print_of(new)
        if after == mark:
            return new.select(F.col("u").alias("node"), F.col("v").alias("root"))
        rest, mark = new, after
    return staged(rest.coalesce(1).mapInArrow(forest, "u long, v long"), "components").select(F.col("u").alias("node"), F.col("v").alias("root"))
