"""A batch of results applied to the catalog's state, in phases over a fixed snapshot.

Every lookup reads the state as it was before the batch, so that results are independent of how rows are dealt out; "first"
and "last" within a batch follow (submitted_at, lease_id, position). The new state is a set of frames to be published
together (:func:`~sparrowgrid.operators.upsert.publish`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import digest_of, key_of, source_key
from ..functions.policy import STOREFRONTS
from ..schemas import TABLES
from . import identity, lifecycle, upsert, versions

#: What an observation's digest covers.
FACTS = ("title", "author", "summary", "outbound_links", "platform_tags", "price", "currency", "availability", "storefront_url", "release_json")
ORDER = ("submitted_at", "lease_id", "position")


def _order() -> list[Column]:
    return [F.col(c) for c in ORDER]


def _fit(name: str, rows: DataFrame) -> DataFrame:
    """``rows`` with a table's columns; those that it lacks are null."""
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[name].schema.fields])


def observed(results: DataFrame, observations: DataFrame, jobs: DataFrame, issues: DataFrame) -> DataFrame:
    """Observations of new results with their job, key, digest and completeness: an item that an issue names is incomplete."""
    named = issues.select("lease_id", F.col("source_item_key").alias("item_key"), F.lit(True).alias("has_issue")).distinct()
    own = observations.join(results.select("lease_id", "job_id", "submitted_at"), "lease_id").join(jobs.select("job_id", "platform", "url"), "job_id").join(named, ["lease_id", "item_key"], "left")
    return own.withColumns({"source_key": source_key(F.col("platform"), F.col("url"), F.col("item_key")), "complete": F.col("has_issue").isNull(), "digest": digest_of(*FACTS), "observed_at": F.col("submitted_at")})


def project(items: DataFrame, stored: DataFrame, seen: DataFrame, gone: DataFrame) -> DataFrame:
    """Versions and events of a batch (D-1): each key's last stored version and gone mark come before its new rows."""
    at = lambda k, *cells: F.struct(F.lit(k).alias("k"), *[c.cast(t).alias(n) for n, t, c in zip(("s", "l", "p"), ("timestamp", "string", "long"), cells, strict=True)])
    none = (F.lit(None),) * 3
    keys = seen.select("source_key").unionByName(gone.select("source_key")).distinct()
    known = items.join(keys, "source_key", "left_semi")
    last = known.join(stored.select("source_key", F.col("version_no").alias("latest_version_no"), "complete"), ["source_key", "latest_version_no"], "left")
    old = last.select("source_key", at(0, *none).alias("seq"), F.col("latest_digest").alias("digest"), F.coalesce("complete", F.lit(True)).alias("complete"), F.lit(False).alias("gone"))
    left = known.filter("gone_at is not null").select("source_key", at(1, *none).alias("seq"), F.lit(None).cast("string").alias("digest"), F.lit(False).alias("complete"), F.lit(True).alias("gone"))
    new = seen.select("source_key", at(2, *_order()).alias("seq"), "digest", "complete", F.lit(False).alias("gone"))
    lost = gone.select("source_key", at(2, F.col("submitted_at"), F.col("lease_id"), F.lit(-1)).alias("seq"), F.lit(None).cast("string").alias("digest"), F.lit(False).alias("complete"), F.lit(True).alias("gone"))
    every = old.unionByName(left).unionByName(new).unionByName(lost)
    base = known.select("source_key", F.col("latest_version_no").alias("base"))
    projected = versions.project_versions(every).filter("seq.k = 2").join(base, "source_key", "left")
    return projected.withColumn("version_no", F.col("version_no") + F.coalesce(F.col("base") - 1, F.lit(0)))


def apply_batch(state: dict[str, DataFrame], results: DataFrame, observations: DataFrame, issues: DataFrame, leads: DataFrame, stage: Callable[[DataFrame, str], DataFrame] = lambda frame, name: frame) -> dict[str, DataFrame]:
    """The state after a batch (D-1 to D-12).

    ``results``: lease_id, job_id, node_id, idempotency_key, request_digest, submitted_at, outcome, retry_after_seconds.
    ``observations``: lease_id, position, item_key and FACTS. ``issues``: lease_id, source_item_key, version, code.
    ``leads``: lease_id, kind, url, claimed_package_id. Results whose lease has a receipt already are left out. ``stage`` gets the frames
    that several outputs need (see :func:`~sparrowgrid.operators.upsert.stager`).
    """
    s, out = dict(state), dict(state)
    fresh = upsert.receipts(results, s["job_results"]).filter("verdict = 'new'").drop("verdict")
    jobs = s["crawl_jobs"]
    seen = stage(observed(fresh, observations, jobs, issues), "seen")
    lost = fresh.filter("outcome = 'gone'").join(jobs.select("job_id", "platform", "url"), "job_id")
    gone = lost.join(s["source_items"].select("source_key", "platform", F.col("source_url").alias("url")), ["platform", "url"]).select("source_key", "submitted_at", "lease_id")

    # Versions, events, items.
    projected = project(s["source_items"], s["source_versions"], seen, gone)
    facts = seen.select("source_key", F.struct(F.lit(2).alias("k"), F.col("submitted_at").alias("s"), F.col("lease_id").alias("l"), F.col("position").cast("long").alias("p")).alias("seq"), "job_id", "platform", "url", F.to_json(F.struct(*FACTS), {"ignoreNullFields": "false"}).alias("payload_json"))
    rows = stage(projected.join(facts, ["source_key", "seq"], "left"), "versions")
    news = rows.filter("is_new").select(key_of(F.col("source_key"), F.col("version_no")).alias("version_id"), "source_key", "version_no", "digest", "payload_json", F.col("seq.s").alias("observed_at"), "complete", F.col("seq.l").alias("submission_lease_id"))
    out["source_versions"] = s["source_versions"].unionByName(_fit("source_versions", news))
    told = rows.filter("not gone").select(key_of(F.col("source_key"), F.col("seq.l"), F.col("seq.p")).alias("event_id"), "job_id", "source_key", F.col("event").alias("kind"), F.col("seq.s").alias("observed_at"))
    plain = lifecycle.lifecycle_events(fresh).withColumn("event_id", key_of(F.col("job_id"), F.col("kind"), F.col("observed_at")))
    out["source_events"] = s["source_events"].unionByName(_fit("source_events", told)).unionByName(_fit("source_events", plain))
    last = rows.groupBy("source_key").agg(F.max_by(F.struct("platform", F.col("url").alias("source_url")), F.when(F.col("platform").isNotNull(), F.col("seq"))).alias("w"), F.max("version_no").alias("latest_version_no"), F.max_by("digest", F.when(F.col("is_new"), F.col("seq"))).alias("latest_digest"), F.max_by("gone", F.when(F.col("gone") | F.col("complete"), F.col("seq"))).alias("is_gone"), F.max(F.when(F.col("gone"), F.col("seq.s"))).alias("gone_time"))
    before = s["source_items"].withColumnRenamed("gone_at", "old_gone").select("source_key", F.col("platform").alias("p"), F.col("source_url").alias("u"), F.col("latest_digest").alias("d"), "old_gone")
    items = last.join(before, "source_key", "left").select("source_key", F.coalesce("w.platform", "p").alias("platform"), F.coalesce("w.source_url", "u").alias("source_url"), F.coalesce("latest_digest", "d").alias("latest_digest"), "latest_version_no", F.when(F.col("is_gone").isNull(), F.col("old_gone")).when(F.col("is_gone"), F.coalesce("gone_time", "old_gone")).alias("gone_at"))
    out["source_items"] = stage(upsert.upsert(s["source_items"], _fit("source_items", items), ["source_key"], [F.col("latest_version_no")]), "items")
    found = issues.join(fresh.select("lease_id", "job_id", "submitted_at"), "lease_id").select(key_of(F.col("job_id"), F.col("source_item_key"), F.col("version"), F.col("code"), F.col("submitted_at")).alias("issue_id"), "job_id", "source_item_key", F.col("version").alias("version_key"), "code", F.col("submitted_at").alias("observed_at"))
    out["source_issues"] = s["source_issues"].unionByName(_fit("source_issues", found))

    # Packages and links. The last observation of a key in the batch speaks for it.
    current = stage(upsert.latest(seen, ["source_key"], _order()), "current")
    listed, listing_links = identity.canonical_from_listing(current)
    old_leads, old_links = s["source_leads"], s["identity_links"]
    matches = stage(identity.storefront_matches(current, s["source_items"], old_leads, old_links), "matches")
    built, built_links = identity.storefront_bootstrap(current, matches)
    packages = upsert.merge(s["canonical_packages"], _fit("canonical_packages", upsert.latest(listed, ["canonical_id"], [F.col("updated_at"), F.col("display_name")])), ["canonical_id"], keep_old=["created_at", "lifecycle"], keep_if_null=["vpm_id", "published_at", "timestamp_confidence"])
    built = upsert.latest(built, ["canonical_id"], [F.col("updated_at"), F.col("display_name")])
    packages = upsert.merge(packages, _fit("canonical_packages", built), ["canonical_id"], keep_old=["umbrella", "category", "lifecycle", "vpm_id", "created_at", "published_at", "timestamp_confidence"])
    links = identity.union([_fit("identity_links", x) for x in (listing_links, identity.repository_matches(current, old_leads, old_links), identity.storefront_links(matches, old_links), built_links)])
    out["identity_links"] = stage(old_links.unionByName(upsert.insert_ignore(old_links, links, ["link_id"], [F.col("created_at")])), "links")

    # Fronts, evidence, leads.
    store = current.filter(F.col("platform").isin(*STOREFRONTS) | F.col("price").isNotNull())
    fronts = upsert.upsert(s["package_fronts"], _fit("package_fronts", identity.fronts_of(store, out["identity_links"])), ["canonical_id", "source_key"], [F.col("observed_at")])
    compat = identity.avatar_evidence(current)
    out["avatar_compatibilities"] = upsert.upsert(s["avatar_compatibilities"], _fit("avatar_compatibilities", compat), ["compatibility_id"], [F.col("created_at"), F.col("source_key")])
    out["desktop_tool_evidence"] = upsert.upsert(s["desktop_tool_evidence"], _fit("desktop_tool_evidence", identity.desktop_evidence(current, old_links)), ["canonical_id"], [F.col("created_at"), F.col("evidence_url")])
    told_leads = leads.join(fresh.select("lease_id", "job_id", "submitted_at"), "lease_id").join(jobs.select("job_id", F.col("url").alias("job_url")), "job_id").select(key_of(F.col("job_url"), F.col("kind"), F.col("url"), F.col("claimed_package_id")).alias("lead_key"), F.col("job_url").alias("discovered_from_url"), F.col("job_id").alias("discovered_from_job_id"), "kind", F.col("url").alias("target_url"), "claimed_package_id", F.lit("pending_review").alias("status"), F.col("submitted_at").alias("observed_at"))
    outbound = identity.outbound_leads(current)
    new_leads = outbound.unionByName(told_leads, allowMissingColumns=True).withColumns({"first_seen_at": F.col("observed_at"), "last_seen_at": F.col("observed_at")})
    out["source_leads"] = upsert.merge(old_leads, _fit("source_leads", upsert.latest(new_leads, ["lead_key"], [F.col("observed_at"), F.col("discovered_from_job_id")])), ["lead_key"], keep_old=[c for c in old_leads.columns if c not in ("lead_key", "last_seen_at")])

    # Gone sources, jobs, receipts.
    dead = out["source_items"].filter("gone_at is not null").join(gone.select("source_key").distinct(), "source_key", "left_semi").select("source_key", "gone_at")
    out["package_fronts"] = stage(lifecycle.delist_fronts(fronts, dead), "fronts")
    at = dead.agg(F.max("gone_at").alias("t"))
    delisted = lifecycle.delist_packages(packages.crossJoin(F.broadcast(at)), out["package_fronts"], dead, F.coalesce("t", "updated_at"))  # one row
    out["canonical_packages"] = _fit("canonical_packages", delisted)
    out["crawl_jobs"] = lifecycle.finish_jobs(jobs, fresh)
    receipts = fresh.select("lease_id", "job_id", "node_id", "idempotency_key", "request_digest", F.to_json(F.struct("outcome")).alias("response_json"), "submitted_at")
    out["job_results"] = s["job_results"].unionByName(_fit("job_results", receipts))
    return out
