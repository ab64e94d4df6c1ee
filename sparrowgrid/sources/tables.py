"""Stored tables: reads by key or predicate, writes in key order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from ..schemas import TABLES


def read(spark: SparkSession, root: str, name: str, where: Column | str | None = None) -> DataFrame:
    """A table, filtered in the scan where Parquet's statistics allow (S-15)."""
    rows = spark.read.schema(TABLES[name].schema).parquet(f"{root}/{name}")
    return rows if where is None else rows.filter(where)


def write(rows: DataFrame, root: str, name: str, *order: str, mode: str = "overwrite") -> None:
    """A table's rows, sorted within files by ``order`` (or the key), so that keyset reads skip row groups."""
    own = rows.select(*TABLES[name].schema.names)
    own.sortWithinPartitions(*(order or TABLES[name].key)).write.mode(mode).parquet(f"{root}/{name}")
