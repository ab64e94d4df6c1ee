"""Scheduling as set queries: eligibility, grants, robots refreshes, rules, workforce.

A round computes all grants at once: joins find what is eligible, ranks keep one job for each origin and one for each
node. ``now`` is always an argument.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.policy import PLATFORMS, robots_allows

# The delays that an approval asks for at least, in ms.
REPOSITORY_MS, PRODUCT_MS, PUBLISHER_MS = 60_000, 1_500, 2_000


def eligible_jobs(jobs: DataFrame, origins: DataFrame, robots: DataFrame, refreshes: DataFrame, profiles: DataFrame, suppressed: DataFrame, now: Column, capabilities: Sequence[str] | None = None) -> DataFrame:
    """Due jobs that nothing forbids (D-15), each with the longest profile that covers it (O-1).

    Due: pending, or waiting or done and past their time, or under an expired lease (T-7). The origin is free and its pacing
    allows a request; its robots snapshot is live and not being refreshed; a live profile covers the URL; it isn't suppressed.
    """
    state = F.col("state")
    due = jobs.filter((F.col("next_fetch_at") <= now) & (state.isin("pending", "backoff", "done", "blocked") | ((state == "leased") & (F.col("lease_expires_at") <= now))) & (F.col("robots_deferred_until").isNull() | (F.col("robots_deferred_until") <= now)))
    if capabilities:
        due = due.filter(F.col("platform").isin(*capabilities))
    free = origins.filter((F.col("next_allowed_at") <= now) & (F.col("active_job_id").isNull() | (F.col("origin_lease_expires_at") <= now))).select("origin", "min_delay_ms")
    live = robots.filter(F.col("expires_at") > now).select("origin", "status_code", "body", F.col("expires_at").alias("robots_expires_at"))
    held = refreshes.filter(F.col("refresh_expires_at") > now).select("origin")
    open_jobs = due.join(free, "origin").join(live, "origin").join(held, "origin", "left_anti").join(suppressed.select("url"), "url", "left_anti")
    return longest_profile(open_jobs, profiles, now)


def longest_profile(jobs: DataFrame, profiles: DataFrame, now: Column) -> DataFrame:
    """Jobs with the profile of longest scope, then oldest, that covers them (O-1, P-2); jobs without one are left out.

    The join is on platform, purpose and origin; the prefix is a residual of it.
    """
    p = profiles.filter((F.col("expires_at") > now) & F.col("disabled_at").isNull()).select("platform", F.col("purpose").alias("job_purpose"), "origin", "path_scope", "profile_id", F.col("created_at").alias("profile_created_at"))
    covers = F.startswith(F.col("url"), F.concat("origin", "path_scope")) & (F.endswith("path_scope", F.lit("/")) | (F.length("url") == F.length("origin") + F.length("path_scope")))
    pairs = jobs.select("job_id", "platform", "job_purpose", "origin", "url").join(p, ["platform", "job_purpose", "origin"]).filter(covers)
    best = pairs.groupBy("job_id").agg(F.min(F.struct((-F.length("path_scope")).alias("n"), "profile_created_at", "profile_id")).alias("b")).select("job_id", F.col("b.profile_id").alias("profile_id"))
    return jobs.join(best, "job_id")


def grants(eligible: DataFrame, nodes: DataFrame, agents: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(grants, deferrals) of a round (O-2, P-16): denied jobs wait for their robots snapshot's end; of the others the first of each
    origin is offered. Nodes claim in the order of their ids, each the first offer that is left on a platform of its own.

    ``nodes``: node_id, capabilities. A node gets one job, so that no platform needs more offers than there are nodes: these, at most, are
    ranked (a limit that each task applies before anything is shuffled) and come to the driver, where the claims are made one after the other.
    """
    judged = eligible.withColumn("allowed", robots_allows(agents)(F.col("status_code"), F.col("body"), F.col("url")))
    deferrals = judged.filter("not allowed").select("job_id", F.col("robots_expires_at").alias("robots_deferred_until"))
    order = F.struct("next_fetch_at", "created_at", "job_id")
    job = ("job_id", "platform", "profile_id", "min_delay_ms")
    offers = judged.filter("allowed").groupBy("origin").agg(F.min_by(F.struct(*job), order).alias("j"), F.min(order).alias("o")).select("origin", "j.*", "o")
    waiting = sorted(nodes.select("node_id", "capabilities").collect())  # the idle nodes of a round
    first = offers.withColumn("k", F.row_number().over(Window.partitionBy("platform").orderBy("o"))).filter(F.col("k") <= len(waiting)).drop("k")
    left: dict[str, list] = {}
    for row in sorted(first.collect(), key=lambda r: r.o, reverse=True):  # a row for each node and platform, at most
        left.setdefault(row.platform, []).append(row)
    granted = []
    for node in waiting:
        heads = [left[p][-1] for p in node.capabilities or () if left.get(p)]
        if heads:
            taken = min(heads, key=lambda r: r.o)
            left[taken.platform].pop()
            granted.append((node.node_id, taken.job_id, taken.origin, taken.platform, taken.profile_id, taken.min_delay_ms))
    kinds = {f.name: f.dataType.simpleString() for f in offers.schema}
    schema = ", ".join([f"node_id {nodes.schema['node_id'].dataType.simpleString()}", *(f"{c} {kinds[c]}" for c in ("job_id", "origin", "platform", "profile_id", "min_delay_ms"))])
    return eligible.sparkSession.createDataFrame(granted, schema), deferrals


def robots_due(jobs: DataFrame, robots: DataFrame, refreshes: DataFrame, now: Column) -> DataFrame:
    """Origins with an approved due job and no live snapshot or refresh, with the longest delay of those jobs (D-16, A-6)."""
    due = jobs.filter(F.col("state").isin("pending", "backoff", "done") & (F.col("next_fetch_at") <= now))
    stale = due.join(robots.filter(F.col("expires_at") > now).select("origin"), "origin", "left_anti").join(refreshes.filter(F.col("refresh_expires_at") > now).select("origin"), "origin", "left_anti")
    return stale.groupBy("origin").agg(F.max("min_delay_ms").alias("min_delay_ms"), F.min("next_fetch_at").alias("first_due_at")).filter("min_delay_ms is not null")


def undefer(jobs: DataFrame, refreshed: DataFrame) -> DataFrame:
    """Jobs of origins with a new snapshot lose their deferral (D-17)."""
    hit = refreshed.select("origin").distinct().withColumn("_hit", F.lit(True))
    return jobs.join(hit, "origin", "left").withColumn("robots_deferred_until", F.when(F.col("_hit").isNull(), F.col("robots_deferred_until"))).select(*jobs.columns)


def probe(asked: DataFrame, robots: DataFrame, now: Column) -> DataFrame:
    """A row for each origin that is asked for, with its robots snapshot if there is one (J-17)."""
    return asked.join(robots, "origin", "left").withColumn("live", F.col("expires_at") > now)


def rule_for_leads(leads: DataFrame, rules: DataFrame, now: Column) -> DataFrame:
    """Pending listing leads with the longest, then newest, live rule that covers them (P-19, D-13)."""
    live = rules.filter((F.col("expires_at") > now) & F.col("disabled_at").isNull()).select("rule_id", F.col("lead_kind").alias("kind"), "origin", "path_scope", "min_delay_ms", F.col("created_at").alias("rule_created_at"))
    own = leads.filter("status = 'pending_review' and kind = 'vpm_listing'").withColumn("origin", F.regexp_extract("target_url", r"^https://[^/?#]+", 0))
    pairs = own.join(live, ["kind", "origin"]).filter(F.startswith(F.col("target_url"), F.concat("origin", "path_scope")))
    best = pairs.groupBy("lead_key").agg(F.max_by(F.struct("rule_id", "min_delay_ms"), F.struct(F.length("path_scope"), "rule_created_at", "rule_id")).alias("r"))
    return own.join(best, "lead_key").select("lead_key", "target_url", "r.rule_id", "r.min_delay_ms")


def route_leads(leads: DataFrame, min_delay_ms: int = 1_000) -> DataFrame:
    """The job that an approved lead becomes (D-14): platform, purpose, URL and delay; ``error`` for kinds that become none."""
    kind, url = F.col("kind"), F.col("target_url")
    host = F.lower(F.regexp_extract(url, r"^https://([^/:?#]+)", 1))
    store = F.when(host == "booth.pm", "booth").when(host == "gumroad.com", "gumroad").when(host == "jinxxy.com", "jinxxy").when(host == "sellfy.com", "sellfy").otherwise("custom_domain")
    platform = F.when(kind == "vpm_listing", "vpm").when(kind == "github_repository", "github").when(kind == "storefront_product", store).when(kind == "publisher_site", "custom_domain")
    repository = F.regexp_replace(F.regexp_extract(url, r"^https://github\.com/([^/]+/[^/]+)", 1), r"\.git$", "")
    job_url = F.when((kind == "github_repository") & (repository != ""), F.concat(F.lit("https://api.github.com/repos/"), repository)).otherwise(url)
    least = F.when(kind == "github_repository", REPOSITORY_MS).when(kind == "storefront_product", PRODUCT_MS).when(kind == "publisher_site", PUBLISHER_MS).otherwise(0)
    error = F.when(F.col("status") == "rejected", "rejected").when(platform.isNull(), "not_a_job")
    return leads.select("lead_key", "kind", platform.alias("platform"), F.when(platform.isNotNull(), F.when(kind == "vpm_listing", "discovery").otherwise("metadata")).alias("purpose"), F.when(platform.isNotNull(), job_url).alias("job_url"), F.when(platform.isNotNull(), F.greatest(F.lit(min_delay_ms), least).cast("long")).alias("delay_ms"), error.alias("error"))


def workforce(jobs: DataFrame, demand: DataFrame, heartbeats: DataFrame, credentials: DataFrame, now: Column, candidates: Sequence[str] = ()) -> DataFrame:
    """Platforms by need (D-22, A-1 to A-4): (2 jobs + 5 signals + 1) / (workers + 1), ties in platform order; three of them unless
    ``candidates`` names its own."""
    state = F.col("state")
    pending = jobs.filter(state.isin("pending", "backoff") | ((state == "done") & (F.col("next_fetch_at") <= now))).groupBy("platform").agg(F.count(F.lit(1)).alias("pending"))
    wanted = demand.filter("resolved_at is null and requested_platform is not null").groupBy(F.col("requested_platform").alias("platform")).agg(F.count(F.lit(1)).alias("demand"))
    active = heartbeats.filter(F.col("last_seen_at") >= F.timestamp_millis(F.unix_millis(now) - 15 * 60_000)).join(credentials.filter("revoked_at is null").select("node_id", "capabilities"), "node_id")
    workers = active.select(F.explode("capabilities").alias("platform")).groupBy("platform").agg(F.count(F.lit(1)).alias("workers"))
    names = list(dict.fromkeys(candidates)) or list(PLATFORMS)
    dim = jobs.sparkSession.createDataFrame(list(enumerate(names)), "ordinal int, platform string")
    scored = dim.join(pending, "platform", "left").join(wanted, "platform", "left").join(workers, "platform", "left").na.fill(0, ["pending", "demand", "workers"])
    scored = scored.withColumn("score", (2 * F.col("pending") + 5 * F.col("demand") + 1) / (F.col("workers") + 1)).orderBy(F.desc("score"), "ordinal")
    return scored if candidates else scored.limit(3)


def heartbeat_rows(beats: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """Heartbeats that may be stored (D-27): idle ones, and fetching ones whose node holds the live lease they name."""
    live = jobs.filter((F.col("state") == "leased") & (F.col("lease_expires_at") > now)).select(F.col("claimed_by").alias("node_id"), F.col("job_id").alias("active_job_id"))
    fetching = beats.filter("state = 'fetching'").join(live, ["node_id", "active_job_id"], "left_semi").select(*beats.columns)
    return beats.filter("state = 'idle'").unionByName(fetching)
