"""The engine's tables: columns, keys and value domains.

A line for each table: name, key columns, then columns as ``name type``, where ``?`` marks what may be null. Types: s text,
l long, i int, d double, b boolean, t timestamp, a text array.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

from .functions.policy import PLATFORMS

_TYPES = {"s": StringType(), "l": LongType(), "i": IntegerType(), "d": DoubleType(), "b": BooleanType(), "t": TimestampType(), "a": ArrayType(StringType())}
_PROVENANCE = "contributor_node_id s? submission_lease_id s? source_profile_id s?"
_ACTION = "action_id s {0} s actor s action s reason s occurred_at t"
_TABLES = f"""
node_credentials|node_id|node_id s token_hash s capabilities a revoked_at t?
node_credential_actions|action_id|{_ACTION.format("node_id")}
node_heartbeats|node_id|node_id s last_seen_at t state s active_job_id s?
crawl_jobs|job_id|job_id s platform s url s origin s state s next_fetch_at t claimed_by s? lease_id s? lease_expires_at t? etag s? last_modified s? created_at t robots_deferred_until t? source_rule_id s? job_purpose s lease_profile_id s?
origin_leases|origin|origin s active_job_id s? lease_expires_at t? next_allowed_at t min_delay_ms l
origin_robots|origin|origin s snapshot_id s status_code i body s fetched_at t expires_at t
origin_robots_refresh_leases|origin|origin s lease_id s lease_expires_at t
suppressed_urls|url|url s reason s suppressed_at t
source_items|source_key|source_key s platform s source_url s latest_digest s latest_version_no i gone_at t?
source_versions|version_id|version_id s source_key s version_no i digest s payload_json s observed_at t complete b {_PROVENANCE}
source_events|event_id|event_id s job_id s source_key s? kind s observed_at t version_id s? {_PROVENANCE}
source_issues|issue_id|issue_id s job_id s source_item_key s version_key s? code s observed_at t {_PROVENANCE}
source_leads|lead_key|lead_key s discovered_from_url s discovered_from_job_id s discovered_from_item_key s? kind s target_url s claimed_package_id s? status s first_seen_at t last_seen_at t {_PROVENANCE}
operator_actions|action_id|{_ACTION.format("lead_key")}
job_seed_actions|action_id|action_id s job_id s actor s reason s occurred_at t
lead_autoqueue_rules|rule_id|rule_id s lead_kind s origin s path_scope s min_delay_ms l expires_at t review_reference s reason s created_at t disabled_at t?
operator_rule_actions|action_id|{_ACTION.format("rule_id")}
source_access_profiles|profile_id|profile_id s platform s origin s path_scope s query_scope s? method s purpose s min_delay_ms l expires_at t review_reference s reason s retain_classes a publish_classes a created_at t disabled_at t?
source_access_profile_actions|action_id|{_ACTION.format("profile_id")}
job_results|lease_id|lease_id s job_id s node_id s idempotency_key s request_digest s response_json s submitted_at t
canonical_packages|canonical_id|canonical_id s umbrella s category s lifecycle s display_name s vpm_id s? created_at t updated_at t published_at t? timestamp_confidence s?
coordinator_meta|key|key s value s
identity_links|link_id|link_id s source_key s canonical_id s evidence_kind s confidence d review_state s created_at t reviewed_at t?
package_fronts|front_id|front_id s canonical_id s source_key s platform s storefront_url s price d? currency s? availability s observed_at t
avatar_compatibilities|compatibility_id|compatibility_id s source_key s target_avatar_base s scope s confidence s evidence_source s created_at t
desktop_tool_evidence|canonical_id|canonical_id s tool_subtype s supported_os a particular_vrchat_target b evidence_url s publisher_claim s confidence d created_at t
registered_apps|app_id|app_id s app_name s token_hash s contact_email s? permissions a created_at t revoked_at t?
registered_users|user_id|user_id s user_name s token_hash s contact_email s? created_at t revoked_at t?
user_app_ownership|app_id|app_id s user_id s created_at t
catalog_reports|report_id|report_id s app_id s report_type s payload_json s review_status s recorded_at t
downstream_demand_signals|signal_id|signal_id s app_id s signal_type s query s? zero_hits b requested_platform s? target_url s? category s? metadata_json s? recorded_at t resolved_at t?
creator_opt_outs|takedown_id|takedown_id s target_url s? canonical_id s? requester_type s requester_id s? reason s proof_kind s? proof_value s? contact_email s? recorded_at t review_status s review_notes s?
node_metadata|key|key s value s
node_runs|run_id|run_id s started_at t finished_at t? completed l failed l
node_tasks|task_id|task_id s run_id s job_id s state s started_at t updated_at t
"""

# The domains of coded columns.
DOMAINS = {
    ("crawl_jobs", "platform"): PLATFORMS, ("crawl_jobs", "state"): ("pending", "leased", "done", "backoff", "blocked"), ("crawl_jobs", "job_purpose"): ("discovery", "metadata"),
    ("node_heartbeats", "state"): ("idle", "fetching"), ("canonical_packages", "umbrella"): ("tools", "assets", "avatars"),
    ("canonical_packages", "lifecycle"): ("active", "deprecated", "quarantined", "delisted"), ("identity_links", "review_state"): ("accepted", "provisional", "rejected"),
    ("avatar_compatibilities", "scope"): ("named_base", "universal", "uncertain"), ("avatar_compatibilities", "confidence"): ("creator_declared", "keyword_inferred", "unverified"),
    ("desktop_tool_evidence", "tool_subtype"): ("companion_client", "osc_control", "tracking_bridge", "streaming_accessibility", "utility"),
    ("source_leads", "status"): ("pending_review", "approved", "rejected"), ("canonical_packages", "timestamp_confidence"): ("confirmed", "inferred", "observed"),
    ("source_access_profiles", "method"): ("GET",), ("creator_opt_outs", "review_status"): ("pending", "verified", "rejected"),
}


@dataclass(frozen=True)
class Table:
    """A table's key and schema."""

    name: str
    key: tuple[str, ...]
    schema: StructType


def _table(line: str) -> Table:
    name, key, columns = line.split("|")
    words = columns.split()
    fields = [StructField(c, _TYPES[k[0]], k.endswith("?")) for c, k in zip(words[::2], words[1::2], strict=True)]
    return Table(name, tuple(key.split(",")), StructType(fields))


TABLES = {t.name: t for t in map(_table, _TABLES.strip().split("\n"))}


def violations(name: str, rows: DataFrame) -> DataFrame:
    """Rows that break a table's rules, with ``violation``: a null where none may be, or a value outside its domain."""
    table = TABLES[name]
    out = F.lit(None).cast("string")
    for f in table.schema.fields:
        domain = DOMAINS.get((name, f.name))
        if domain:
            out = F.when(F.col(f.name).isNotNull() & ~F.col(f.name).isin(*domain), f"{f.name}_domain").otherwise(out)
        if not f.nullable:
            out = F.when(F.col(f.name).isNull(), f"{f.name}_null").otherwise(out)
    return rows.withColumn("violation", out).filter("violation is not null")


def repeated_keys(name: str, rows: DataFrame) -> DataFrame:
    """Keys that more than one row has."""
    return rows.groupBy(*TABLES[name].key).count().filter("count > 1")
