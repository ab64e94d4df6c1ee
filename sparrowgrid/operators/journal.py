"""A node's journal of runs and tasks, and what nodes contributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Task states in the order in which they may follow; the last two are final.
TASK_STATES = ("claimed", "fetching", "submitting", "completed", "failed")


def task_states(entries: DataFrame) -> DataFrame:
    """The state of each task (D-28): a final state stays, otherwise the furthest counts; entries: run_id, task_id, state, at."""
    final = F.col("state").isin("completed", "failed")
    rank = F.array_position(F.array(*map(F.lit, TASK_STATES)), F.col("state"))
    first_final = F.min_by("state", F.when(final, F.col("at")))
    found = entries.groupBy("run_id", "task_id").agg(F.coalesce(first_final, F.max_by("state", F.struct(rank, "at"))).alias("state"), F.min("at").alias("started_at"), F.max("at").alias("updated_at"))
    return found


def run_totals(tasks: DataFrame) -> DataFrame:
    """Counters of each run (A-11)."""
    return tasks.groupBy("run_id").agg(F.count(F.lit(1)).alias("tasks"), F.count_if(F.col("state") == "completed").alias("completed"), F.count_if(F.col("state") == "failed").alias("failed"))


def node_totals(events: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """A counter of each kind of evidence for each node (A-8), in one grouping."""
    return events.groupBy("node_id").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds])


def node_recent(events: DataFrame, top: int, order: list) -> DataFrame:
    """The newest ``top`` events of each node (O-9). A rank filter lets each task keep no more than ``top`` rows of a node before the shuffle."""
    return events.withColumn("rank", F.row_number().over(Window.partitionBy("node_id").orderBy(*order))).filter(F.col("rank") <= top)
