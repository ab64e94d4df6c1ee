"""Lifecycles: gone sources, takedowns, job states, issues, reviews, disabled authorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.policy import job_state, next_fetch_at
from .upsert import guarded_update


def delist_fronts(fronts: DataFrame, gone: DataFrame) -> DataFrame:
    """Fronts of gone sources become delisted. ``gone``: source_key."""
    return guarded_update(fronts, gone, ["source_key"], {"availability": F.lit("delisted")})


def delist_packages(packages: DataFrame, fronts: DataFrame, gone: DataFrame, at: Column) -> DataFrame:
    """Packages of gone sources become delisted if they have no package name and no front is available any more (D-10).

    ``fronts``: after :func:`delist_fronts`.
    """
    touched = fronts.join(gone.select("source_key"), "source_key", "left_semi").select("canonical_id").distinct()
    available = fronts.filter("availability = 'available'").select("canonical_id")
    unnamed = packages.filter("vpm_id is null and lifecycle <> 'delisted'").select("canonical_id")
    out = touched.join(available, "canonical_id", "left_anti").join(unnamed, "canonical_id", "left_semi")
    return guarded_update(packages, out, ["canonical_id"], {"lifecycle": F.lit("delisted"), "updated_at": at})


def takedown_targets(packages: DataFrame, fronts: DataFrame, takedowns: DataFrame) -> DataFrame:
    """Packages that takedowns name by id, or by a front's URL as it was written (D-23). ``takedowns``: canonical_id, target_url."""
    by_id = takedowns.filter("canonical_id is not null").select("canonical_id")
    by_url = fronts.join(takedowns.filter("target_url is not null").select(F.col("target_url").alias("storefront_url")), "storefront_url", "left_semi").select("canonical_id")
    return packages.join(by_id.unionByName(by_url).distinct(), "canonical_id", "left_semi").select("canonical_id")


def apply_takedowns(packages: DataFrame, fronts: DataFrame, takedowns: DataFrame, at: Column) -> DataFrame:
    """Packages with takedowns delisted at once, before any review, as the source does."""
    return guarded_update(packages, takedown_targets(packages, fronts, takedowns), ["canonical_id"], {"lifecycle": F.lit("delisted"), "updated_at": at})


def reject_takedowns(packages: DataFrame, fronts: DataFrame, rejected: DataFrame, at: Column) -> DataFrame:
    """The reverse, for takedowns that a review rejects: delisted packages are active again."""
    back = takedown_targets(packages, fronts, rejected).join(packages.filter("lifecycle = 'delisted'").select("canonical_id"), "canonical_id", "left_semi")
    return guarded_update(packages, back, ["canonical_id"], {"lifecycle": F.lit("active"), "updated_at": at})


def finish_jobs(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Jobs after their results (D-12): state, next fetch, and a released lease. ``results``: job_id, outcome, submitted_at, retry_after_seconds."""
    done = jobs.join(results.select("job_id", "outcome", "submitted_at", "retry_after_seconds"), "job_id", "left")
    hit = F.col("outcome").isNotNull()
    changed = {
        "state": F.when(hit, job_state(F.col("outcome"))).otherwise(F.col("state")),
        "next_fetch_at": F.when(hit, next_fetch_at(F.col("outcome"), F.col("submitted_at"), F.col("retry_after_seconds"))).otherwise(F.col("next_fetch_at")),
        "lease_id": F.when(~hit, F.col("lease_id")),
        "lease_expires_at": F.when(~hit, F.col("lease_expires_at")),
    }
    return done.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in jobs.columns])


def issue_rows(results: DataFrame) -> DataFrame:
    """A row for each issue of partial results (D-11). ``results``: job_id, submitted_at, issues."""
    return results.filter("outcome = 'partial_batch'").select("job_id", F.col("submitted_at").alias("observed_at"), F.explode("issues").alias("i")).select("job_id", F.col("i.source_item_key").alias("source_item_key"), F.col("i.version").alias("version_key"), F.col("i.code").alias("code"), "observed_at")


def lifecycle_events(results: DataFrame) -> DataFrame:
    """Events of results that carry no observation (D-11)."""
    return results.filter("outcome not in ('changed', 'batch', 'partial_batch')").select("job_id", F.lit(None).cast("string").alias("source_key"), F.col("outcome").alias("kind"), F.col("submitted_at").alias("observed_at"))


def suppress_urls(items: DataFrame, suppressed: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(items, events): items of suppressed URLs are gone from then on, with an event each that wasn't before."""
    hit = items.join(suppressed.select(F.col("url").alias("source_url")), "source_url", "left_semi").filter("gone_at is null").select("source_key")
    return guarded_update(items, hit, ["source_key"], {"gone_at": at}), hit.select("source_key", F.lit("suppressed").alias("kind"), at.alias("observed_at"))


def review_links(links: DataFrame, fronts: DataFrame, verdicts: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(links, fronts) after reviews (link_id, verdict): a front goes when no live link of its pair remains."""
    reviewed = links.join(verdicts.select("link_id", "verdict"), "link_id", "left")
    new = reviewed.select(*[F.coalesce("verdict", "review_state").alias(c) if c == "review_state" else F.when(F.col("verdict").isNotNull(), at).otherwise(F.col(c)).alias(c) if c == "reviewed_at" else F.col(c) for c in links.columns])
    pair = ["canonical_id", "source_key"]
    dead = reviewed.filter("verdict = 'rejected'").select(*pair).distinct().join(new.filter("review_state in ('accepted', 'provisional')").select(*pair), pair, "left_anti")
    return new, fronts.join(dead, pair, "left_anti")


def release_leases(jobs: DataFrame, disabled: DataFrame, key: str) -> DataFrame:
    """Leased jobs under disabled authorities become pending (D-24). ``key``: lease_profile_id or source_rule_id."""
    hit = jobs.filter("state = 'leased'").join(disabled.select(key), key, "left_semi").select("job_id")
    empty = {c: F.lit(None).cast(jobs.schema[c].dataType) for c in ("lease_id", "lease_expires_at", "claimed_by") if c in jobs.columns}
    return guarded_update(jobs, hit, ["job_id"], {"state": F.lit("pending"), **empty})


def drop_idle_refreshes(refreshes: DataFrame, due: DataFrame) -> DataFrame:
    """Robots refresh leases of origins where something is still due."""
    return refreshes.join(due.select("origin"), "origin", "left_semi")
