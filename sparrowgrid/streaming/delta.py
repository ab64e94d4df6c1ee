"""Streams over the event log: change feed, idempotent submission, polling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def event_stream(spark: SparkSession, path: str, schema: StructType, files: int = 100) -> DataFrame:
    """A log folder as a stream of bounded batches (T-1)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def once_per_lease(results: DataFrame, at: str, lateness: str = "1 day") -> DataFrame:
    """Results without repeats of a lease and digest (T-9); a lease with another digest passes, for the conflict check."""
    return results.withWatermark(at, lateness).dropDuplicatesWithinWatermark(["lease_id", "request_digest"])


def run_available(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process what there is in batches, each of which ``handle`` applies under its number, and stop (T-1, W-10)."""
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def change_feed(versions: DataFrame, after: tuple | None = None) -> DataFrame:
    """Changes beyond a cursor (updated_at, canonical_id), as upserts and tombstones (T-2); a batch or a stream."""
    if after is not None:
        versions = versions.filter(F.struct(F.col("updated_at").alias("a"), F.col("canonical_id").alias("b")) > F.struct(F.lit(after[0]).alias("a"), F.lit(after[1]).alias("b")))
    return versions.withColumn("change", F.when(F.col("lifecycle") == "delisted", "tombstone").otherwise("upsert"))
