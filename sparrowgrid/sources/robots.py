"""Robots snapshots from captured hops (S-13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.policy import robots_expiry
from ..functions.urls import is_safe_redirect

MOST_HOPS, MOST_BYTES, UNUSABLE = 5, 512 * 1024, 599


def snapshots(hops: DataFrame) -> DataFrame:
    """(origin, status_code, body, fetched_at, expires_at) from hops (origin, hop, status, location, content_type, body, at).

    The last hop counts. A chain of more than five redirects, an unsafe redirect, a partial or HTML answer or one that is too
    large is unusable (599); the body of an answer other than 2xx is dropped.
    """
    unsafe = F.col("status").between(300, 399) & ~F.coalesce(is_safe_redirect(F.col("location")), F.lit(False))
    chains = hops.groupBy("origin").agg(F.max_by(F.struct("status", "content_type", "body", "at"), "hop").alias("last"), F.count_if(F.col("status").between(300, 399)).alias("redirects"), F.max(F.coalesce(unsafe, F.lit(False))).alias("unsafe"))
    status, body = F.col("last.status"), F.coalesce("last.body", F.lit(""))
    bad = F.col("unsafe") | (F.col("redirects") > MOST_HOPS) | status.between(300, 399) | (status == 206) | (status.between(200, 299) & (F.lower("last.content_type").contains("html") | (F.octet_length(body) > MOST_BYTES)))
    code = F.when(F.coalesce(bad, F.lit(False)), UNUSABLE).otherwise(status).cast("int")
    return chains.select("origin", code.alias("status_code"), F.when(code.between(200, 299), body).otherwise("").alias("body"), F.col("last.at").alias("fetched_at"), robots_expiry(code, F.col("last.at")).alias("expires_at"))
