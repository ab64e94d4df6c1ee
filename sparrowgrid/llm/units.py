"""Exact comparison of the members of clusters, in units of bounded size.

A cluster is a set of nodes that no link leaves. One that fits a unit meets there as a whole. A larger one meets in
three rounds, of which the later ones see only what is not connected yet:

1. its blocks (by hash), each on its own;
2. one node for each component of each block, so that near copies of one text become one component at a node a block;
3. where several components are left, the nodes outside the largest one, in blocks, against each other and against the blocks
   of the largest. Two nodes of one component are not linked again, so no link between different components is lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .components import connected_components


def _pieces(weight: F.Column, limit: int) -> F.Column:
    return F.greatest(F.lit(1), F.ceil(weight / limit)).cast("int")


def _all_roots(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``nodes`` with the least node that edges lead to, as ``label``."""
    return nodes.join(connected_components(edges).withColumnsRenamed({"root": "label"}), "node", "left").withColumn("label", F.coalesce("label", "node"))


def linked(member: DataFrame, limit: int, compare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Edges (u, v) that join all linked nodes. ``member``: (node, root, weight), a cluster's nodes of weight ``limit`` or less in all meet at
    once. ``compare`` maps units (root, unit, node) to a forest (u, v) of each unit's links."""
    member = member.select("node", "root", "weight")
    total = member.groupBy("root").agg(F.sum("weight").alias("total"))
    blocks = total.select("root", _pieces(F.col("total"), limit).alias("blocks"))
    dealt = staged(member.join(blocks, "root").withColumn("unit", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("long")), "unit-members")
    edges = staged(compare(dealt.select("root", "unit", "node")), "unit-links")
    large = dealt.filter("blocks > 1")
    if large.isEmpty():
        return edges
    large = staged(_all_roots(edges, large), "large-clusters")
    heads = large.groupBy("root", "unit", "label").agg(F.min("node").alias("node"), F.min_by("weight", "node").alias("weight"))
    few = heads.groupBy("root").agg(_pieces(F.sum("weight"), limit).alias("pieces"))
    more = staged(compare(heads.join(few, "root").select("root", F.pmod(F.xxhash64("label"), "pieces").cast("long").alias("unit"), "node")), "unit-links")
    edges = edges.unionByName(more)

    large = staged(_all_roots(edges, large.drop("label")), "large-clusters")
    parts = large.groupBy("root", "label").agg(F.sum("weight").alias("weight"))
    first = parts.groupBy("root").agg(F.max_by("label", F.struct("weight", "label")).alias("largest"), F.sum("weight").alias("total"), F.max("weight").alias("most")).filter("total > most")
    if first.isEmpty():
        return edges
    half = max(1, limit // 2)
    split = first.select("root", "largest", _pieces(F.col("most"), half).alias("many"), _pieces(F.col("total") - F.col("most"), half).alias("rest"))
    last = large.join(split, "root").withColumn("h", F.abs(F.xxhash64(F.lit(1), "node") % (1 << 40)))
    # A unit is numbered by the rest's block, and by a block of the largest component or another of the rest.
    side = (F.col("many") + F.col("rest")).cast("long")
    inside = F.transform(F.sequence(F.lit(0), F.col("rest") - 1), lambda r: r * side + F.col("h") % F.col("many"))
    mine = F.col("h") % F.col("rest")
    outside = F.concat(F.transform(F.sequence(F.lit(0), F.col("many") - 1), lambda m: mine * side + m), F.transform(F.sequence(F.lit(0), F.col("rest") - 1), lambda r: F.least(mine, r) * side + F.col("many") + F.greatest(mine, r)))
    units = last.select("root", F.explode(F.when(F.col("label") == F.col("largest"), inside).otherwise(outside)).alias("unit"), "node")
    return edges.unionByName(staged(compare(units), "unit-links"))
