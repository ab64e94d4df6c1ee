"""Downstream applications: ownership, feedback, demand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import key_of
from .paging import page


def owned_apps(apps: DataFrame, ownership: DataFrame, users: DataFrame, user_id: str, limit: int = 50, after: tuple | None = None) -> DataFrame:
    """A user's live applications in order (J-11)."""
    live = users.filter((F.col("user_id") == user_id) & F.col("revoked_at").isNull()).select("user_id")
    mine = ownership.join(live, "user_id", "left_semi").select("app_id")
    return page(apps.filter("revoked_at is null").join(mine, "app_id", "left_semi"), [F.col("created_at"), F.col("app_id")], limit, after)


def feedback(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report rows, demand signals) of reports (D-25): demand reports are missed searches, others ask for a refresh.

    ``reports``: app_id, report_type, query, zero_hits, requested_platform, target_url, category, metadata (map), recorded_at.
    """
    own = reports.withColumn("report_id", key_of(F.col("app_id"), F.col("report_type"), F.col("query"), F.col("target_url"), F.col("recorded_at")))
    payload = F.to_json(F.struct("query", "zero_hits", "requested_platform", "target_url", "category", "metadata"), {"ignoreNullFields": "false"})
    rows = own.select("report_id", "app_id", "report_type", payload.alias("payload_json"), F.lit("pending").alias("review_status"), "recorded_at")
    kind = F.when(F.col("report_type") == "demand_signal", "search_miss").otherwise("refresh_demand")
    signals = own.filter("report_type <> 'removal'").select(F.col("report_id").alias("signal_id"), "app_id", kind.alias("signal_type"), "query", F.coalesce("zero_hits", F.lit(False)).alias("zero_hits"), "requested_platform", "target_url", "category", F.to_json("metadata").alias("metadata_json"), "recorded_at", F.lit(None).cast("timestamp").alias("resolved_at"))
    return rows, signals
