"""Keyset pages: order, cursor predicate and one row more than asked for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_ROWS = 100


def beyond(keys: Sequence[Column], after: Sequence, descending: bool) -> Column:
    """Whether a row's keys come after a cursor's (O-3, O-4); one struct comparison."""
    here, there = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]), F.struct(*[(a if isinstance(a, Column) else F.lit(a)).alias(f"k{i}") for i, a in enumerate(after)])
    return here < there if descending else here > there


def page(rows: DataFrame, keys: Sequence[Column], limit: int, after: Sequence | None = None, descending: bool = False) -> DataFrame:
    """``limit`` rows and one more in key order, which plans as a bounded top-k."""
    if after is not None:
        rows = rows.filter(beyond(keys, after, descending))
    return rows.orderBy(*[k.desc() if descending else k.asc() for k in keys]).limit(min(max(limit, 1), MOST_ROWS) + 1)


def visible(found: list, limit: int) -> tuple[list, bool]:
    """(rows to show, whether more follow) from a page's rows (O-6)."""
    limit = min(max(limit, 1), MOST_ROWS)
    return found[:limit], len(found) > limit


def ordered_distinct(rows: DataFrame, key: Sequence[str], position: str, last_value: bool = True) -> DataFrame:
    """A row for each key at its first position, with the values of its last (or first) one (O-12)."""
    rest = [c for c in rows.columns if c not in (*key, position)]
    pick = F.max_by if last_value else F.min_by
    aggregates = [F.min(position).alias(position)] + ([pick(F.struct(*rest), F.col(position)).alias("p")] if rest else [])
    return rows.groupBy(*key).agg(*aggregates).select(*key, position, *[F.col(f"p.{c}").alias(c) for c in rest])
