"""Guards: ordered rejections and value bounds. Valid rows pass; the rest go to a quarantine frame with the reason."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.policy import is_reserved_v4
from ..functions.urls import is_itch_search
from ..sources.responses import gate

# Bounds of an observation's fields, as (least, most) characters or elements.
OBSERVATION_BOUNDS = {"source_item_key": (1, 200), "title": (1, 500), "author": (1, 300), "summary": (0, 1024), "outbound_links": (0, 100), "platform_tags": (0, 50)}
TAG_BOUND = (1, 100)
# Bounds of the fields of other requests, and of a seed's delay (ms).
REQUEST_BOUNDS = {
    "search": {"query": (0, 200), "category": (0, 100), "tags": (0, 20)},
    "report": {"query": (0, 200), "target_url": (0, 1000), "category": (0, 100)},
    "takedown": {"reason": (1, 1000), "target_url": (0, 1000), "contact_email": (0, 320)},
    "rule": {"path_scope": (1, 1000), "reason": (1, 300), "review_reference": (1, 300)},
    "profile": {"path_scope": (1, 1000), "reason": (1, 300), "review_reference": (1, 300), "retain_classes": (0, 4), "publish_classes": (0, 4)},
}
SEED_DELAY_MS = (0, 86_400_000)


def first_reason(checks: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first check that fails, or null; a check that is null fails."""
    out = F.lit(None).cast("string")
    for name, good in reversed(checks):
        out = F.when(~F.coalesce(good, F.lit(False)), name).otherwise(out)
    return out


def guard(rows: DataFrame, checks: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with ``reject_code``) (P-22, P-23)."""
    judged = rows.withColumn("reject_code", first_reason(checks))
    return judged.filter("reject_code is null").drop("reject_code"), judged.filter("reject_code is not null")


def bounded(column: Column, least: int, most: int, array: bool = False) -> Column:
    """Whether a text's characters or an array's elements are within bounds; a null passes where nothing is asked for."""
    size = F.size(column) if array else F.length(column)
    return F.when(column.isNull(), F.lit(least == 0)).otherwise(size.between(least, most))


def observation_checks(rows: DataFrame, bounds: Mapping[str, tuple[int, int]] = OBSERVATION_BOUNDS) -> list[tuple[str, Column]]:
    """Checks of an observation's bounds (P-24) for the columns that ``rows`` has."""
    checks = []
    for name, (least, most) in bounds.items():
        if name in rows.columns:
            array = rows.schema[name].dataType.typeName() == "array"
            checks.append((f"{name}_bounds", bounded(F.col(name), least, most, array)))
    if "platform_tags" in rows.columns:
        checks.append(("tag_bounds", F.coalesce(F.forall("platform_tags", lambda t: F.length(t).between(*TAG_BOUND)), F.lit(True))))
    return checks


def seed_checks(now: Column) -> list[tuple[str, Column]]:
    """A seed's rejections in order (P-23): over a row with platform, purpose, url, origin, min_delay_ms, the suppression and the rule it
    names (suppressed, rule_id, rule_expires_at, rule_disabled_at), and the job that has its URL (job_platform, job_purpose)."""
    c = F.col
    alive = c("rule_disabled_at").isNull() & (c("rule_expires_at") > now)
    return [
        ("not_https", c("url").rlike(r"^https://[^/:@?#]+(?::443)?(?:[/?][^#]*)?$")),
        ("not_public", ~c("url").rlike(r"^https://(?:localhost|[^/]*\.(?:local|internal))(?:[:/?]|$)") & ~(c("url").rlike(r"^https://[0-9.]+(?:[:/?]|$)") & is_reserved_v4(F.regexp_extract("url", r"^https://([0-9.]+)", 1)))),
        ("target_class", gate(c("platform"), c("purpose"), c("url"), c("origin")).isNull() & ~is_itch_search(c("url"))),
        ("delay", c("min_delay_ms").between(*SEED_DELAY_MS)),
        ("suppressed", ~F.coalesce(c("suppressed"), F.lit(False))),
        ("rule_ended", c("rule_id").isNull() | alive),
        ("contract", c("job_platform").isNull() | ((c("job_platform") == c("platform")) & (c("job_purpose") == c("purpose")))),
    ]


def submission_checks() -> list[tuple[str, Column]]:
    """A result's rejections in order (P-22): over a joined row with credential_, lease_ and profile_ columns."""
    c = F.col
    one_listing = (c("platform") == "vpm") | ~c("outcome").isin("batch", "partial_batch")
    return [
        ("unknown_node", c("credential_node_id").isNotNull() & c("credential_revoked_at").isNull()),
        ("capability", F.array_contains(c("credential_capabilities"), c("platform"))),
        ("batch_platform", one_listing),
        ("no_lease", c("lease_lease_id").eqNullSafe(c("lease_id")) & (c("lease_claimed_by") == c("node_id"))),
        ("lease_expired", c("lease_expires_at") > c("submitted_at")),
        ("no_profile", c("profile_id").isNotNull()),
        ("discovery_only", (c("job_purpose") != "discovery") | c("outcome").isin("discovery", "batch", "partial_batch", "unchanged", "gone", "temporary_failure", "rate_limited", "blocked")),
        ("retention", (c("summary_chars") == 0) | F.array_contains(c("retain_classes"), "creator_prose")),
        ("duplicate_keys", c("n_items") == c("n_item_keys")),
    ]


def duplicate_items(observations: DataFrame) -> DataFrame:
    """Leases whose observations name an item twice (A-14)."""
    return observations.groupBy("lease_id").agg(F.count(F.lit(1)).alias("n_items"), F.countDistinct("source_item_key").alias("n_item_keys")).filter("n_items <> n_item_keys")


def minimise(observations: DataFrame, retain: str = "retain_classes") -> DataFrame:
    """Summaries blanked unless the lease retains prose (S-12)."""
    return observations.withColumn("summary", F.when(F.array_contains(retain, "creator_prose"), F.col("summary")).otherwise(F.lit("")))
