"""Writes as snapshot rewrites: upserts, inserts, guarded updates, deletes, receipts.

Plain Parquet has no row updates. Each operator takes the current state and a batch and gives the new state; keys are
partitioned once, and what wins within a key is decided by aggregates (``max_by``), which combine before the shuffle,
rather than by windows, which don't.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key (O-9). ``order`` has to be total within a key, or equal rows of it be interchangeable."""
    rest = [c for c in rows.columns if c not in key]
    if not rest:
        return rows.dropDuplicates(list(key))
    picked = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("picked"))
    return picked.select(*key, *[F.col(f"picked.{c}").alias(c) for c in rest]).select(*rows.columns)


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows of ``new`` replace those of ``old``; the last of a key in ``new`` counts (W-1, W-6). ``order`` may use columns of ``new``."""
    columns = old.columns
    batch = latest(new.withColumn("_order", F.struct(*order)), key, [F.col("_order")]).select(*columns)
    both = old.select(*columns, F.lit(0).alias("_new")).unionByName(batch.withColumn("_new", F.lit(1)))
    return latest(both, key, [F.col("_new")]).select(*columns)


def merge(old: DataFrame, new: DataFrame, key: Sequence[str], keep_old: Sequence[str] = (), keep_if_null: Sequence[str] = ()) -> DataFrame:
    """Upsert by column (W-2, W-3): columns in ``keep_old`` never change, those in ``keep_if_null`` keep the old value where the new one
    is null, and others take the new value. ``new`` has a row for each key at most."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key], "full_outer")
    in_old, in_new = F.col(f"o.{key[0]}").isNotNull(), F.col(f"n.{key[0]}").isNotNull()
    out = []
    for c in old.columns:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}") if c in new.columns else F.lit(None)
        if c in key:
            out.append(F.coalesce(a, b).alias(c))
        elif c in keep_old or c not in new.columns:
            out.append(F.when(in_old, a).otherwise(b).alias(c))
        elif c in keep_if_null:
            out.append(F.coalesce(b, a).alias(c))
        else:
            out.append(F.when(in_new, b).otherwise(a).alias(c))
    return joined.select(*out)


def first_last_seen(rows: DataFrame, key: Sequence[str], order: Sequence[Column], first: Sequence[str], last: Sequence[str]) -> DataFrame:
    """For each key the values of ``first`` columns at its first row, and of ``last`` ones at its last, as ``first_*`` and ``last_*`` (W-4)."""
    at = F.struct(*order)
    found = rows.groupBy(*key).agg(F.min_by(F.struct(*first), at).alias("f"), F.max_by(F.struct(*last), at).alias("l"))
    return found.select(*key, *[F.col(f"f.{c}").alias(f"first_{c}") for c in first], *[F.col(f"l.{c}").alias(f"last_{c}") for c in last])


def insert_ignore(old: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows of ``new`` whose key ``old`` lacks; the first of a key counts (W-5)."""
    rest = [c for c in new.columns if c not in key]
    first = new.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("p")).select(*key, *[F.col(f"p.{c}").alias(c) for c in rest]) if rest else new.dropDuplicates(list(key))
    return first.select(*new.columns).join(old.select(*key), list(key), "left_anti")


def insert_where(new: DataFrame, authority: DataFrame, on: Sequence[str], exists: bool = True) -> DataFrame:
    """Rows of ``new`` with (or without) an authority (W-7)."""
    return new.join(authority.select(*on), list(on), "left_semi" if exists else "left_anti")


def guarded_update(rows: DataFrame, eligible: DataFrame, key: Sequence[str], changes: dict[str, Column]) -> DataFrame:
    """Rows with ``changes`` where their key is eligible (W-8): a single writer computes who is, once, and writes the new snapshot."""
    marked = rows.join(eligible.select(*key).distinct().withColumn("_hit", F.lit(True)), list(key), "left")
    return marked.select(*[F.when(F.col("_hit"), changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in rows.columns])


def raise_floor(old: DataFrame, new: DataFrame, key: Sequence[str], column: str) -> DataFrame:
    """``column`` of ``old`` raised to the largest new value; it never falls (W-9)."""
    top = new.groupBy(*key).agg(F.max(column).alias("_top"))
    return old.join(top, list(key), "left").withColumn(column, F.greatest(column, "_top")).select(*old.columns)


def delete_cascade(parents: DataFrame, children: dict[str, tuple[DataFrame, Sequence[str]]], gone: DataFrame, key: Sequence[str]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Parents without those in ``gone``, and children without orphans (W-11)."""
    left = {n: c.join(gone.select(*[F.col(k).alias(f) for k, f in zip(key, on, strict=True)]), list(on), "left_anti") for n, (c, on) in children.items()}
    return parents.join(gone.select(*key), list(key), "left_anti"), left


def receipts(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """Requests (lease_id, request_digest, ...) with ``verdict``: new, duplicate (of the stored digest) or conflict (W-12, T-9)."""
    known = stored.select("lease_id", F.col("request_digest").alias("_digest"))
    return requests.join(known, "lease_id", "left").withColumn("verdict", F.when(F.col("_digest").isNull(), "new").when(F.col("_digest") == F.col("request_digest"), "duplicate").otherwise("conflict")).drop("_digest")


def publish(frames: dict[str, DataFrame], path: str, batch: str) -> None:
    """Write all frames under one batch name, then a pointer to it (W-10): readers that follow the pointer see all of a batch or nothing."""
    for name, frame in frames.items():
        frame.write.mode("overwrite").parquet(f"{path}/batches/{batch}/{name}")
    spark = next(iter(frames.values())).sparkSession
    spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("overwrite").json(f"{path}/current")


def published(spark, path: str, name: str) -> DataFrame:
    """A frame of the batch that the pointer names."""
    batch = spark.read.json(f"{path}/current").first()["batch"]
    return spark.read.parquet(f"{path}/batches/{batch}/{name}")


def stager(path: str) -> Callable[[DataFrame, str], DataFrame]:
    """A function that writes a frame under ``path`` and reads it back: what several outputs need is computed once, and a lost executor loses nothing."""

    def stage(frame: DataFrame, name: str) -> DataFrame:
        place = f"{path}/{name}-{uuid.uuid4().hex}"
        frame.write.parquet(place)
        return frame.sparkSession.read.schema(frame.schema).parquet(place)

    return stage
