"""Version projection: a change-only history of what sources said."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def project_versions(observations: DataFrame) -> DataFrame:
    """Each observation's version number and event (D-1, O-8).

    ``observations``: source_key, seq (arrival order, unique within a key), digest, complete (boolean), gone (boolean: the source
    was reported gone at this point; digest is null then). A version is new when it is the key's first, its digest changed, or it
    completes an incomplete one of equal digest. Events: gone, restored (complete, after gone), changed, unchanged.

    One window order serves all of it: state before a row is what the last observation left.
    """
    w = Window.partitionBy("source_key").orderBy("seq")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    seen = F.col("digest").isNotNull()
    state = observations.withColumns({
        "_prev": F.last(F.when(seen, F.col("digest")), ignorenulls=True).over(before),
    })
    # A run of equal digests is complete from its first complete observation on.
    state = state.withColumn("_start", F.when(seen & (F.col("_prev").isNull() | (F.col("_prev") != F.col("digest"))), 1).otherwise(0))
    state = state.withColumn("_run", F.sum("_start").over(w))
    r = Window.partitionBy("source_key", "_run").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    state = state.withColumn("_was_complete", F.coalesce(F.max(F.when(seen, F.col("complete"))).over(r), F.lit(False)))
    upgrade = seen & (F.col("_start") == 0) & F.col("complete") & ~F.col("_was_complete")
    state = state.withColumn("is_new", (F.col("_start") == 1) | upgrade)
    # Gone until a complete observation comes: the last report or complete observation before decides.
    gone_mark = F.when(F.col("gone"), True).when(seen & F.col("complete"), False)
    state = state.withColumn("_was_gone", F.coalesce(F.last(gone_mark, ignorenulls=True).over(before), F.lit(False)))
    event = (
        F.when(F.col("gone"), "gone")
        .when(F.col("complete") & F.col("_was_gone"), "restored")
        .when(F.col("is_new"), "changed")
        .otherwise("unchanged")
    )
    return state.select(*observations.columns, F.sum(F.col("is_new").cast("long")).over(w).alias("version_no"), "is_new", event.alias("event"))


def latest_versions(projected: DataFrame) -> DataFrame:
    """The newest version of each key with its number: what current-state rows point to (J-9)."""
    return projected.filter("is_new").groupBy("source_key").agg(F.max("version_no").alias("latest_version_no"), F.max_by("digest", "version_no").alias("latest_digest"))


def latest_complete(projected: DataFrame) -> DataFrame:
    """The newest complete version of each key that isn't gone (J-10)."""
    gone = projected.groupBy("source_key").agg(F.max_by("gone", F.when(F.col("gone") | F.col("complete"), F.col("seq"))).alias("gone")).filter("gone")
    found = projected.filter("is_new and complete").groupBy("source_key").agg(F.max("version_no").alias("version_no"), F.max_by("digest", "version_no").alias("digest"))
    return found.join(gone, "source_key", "left_anti")
