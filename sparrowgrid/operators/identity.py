"""Identity: leads, repository and storefront matches, bootstrap, fronts, evidence.

Lookups read the state before the batch, so that two observations of a batch never see each other's links. Disjunctions
of equalities are unions of equi-joins, as a join on ``OR`` plans as a nested loop.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tags as tag_functions
from ..functions.hashing import key_of, source_key
from ..functions.policy import STOREFRONTS
from ..functions.urls import github_api_url, lead_kind, normal_identity


def union(frames: list[DataFrame]) -> DataFrame:
    """All rows of frames with equal columns."""
    return reduce(DataFrame.unionByName, frames)


def or_join(left: DataFrame, right: DataFrame, pairs: list[tuple[Column, Column]], left_columns: list[str], right_columns: list[str]) -> DataFrame:
    """Distinct pairs of rows for which any of the equalities holds (J-7). ``pairs``: keys of the left and the right."""
    parts = []
    for a, b in pairs:
        x = left.select(a.alias("_k"), *left_columns).filter("_k is not null")
        y = right.select(b.alias("_k"), *right_columns).filter("_k is not null")
        parts.append(x.join(y, "_k").select(*left_columns, *right_columns))
    return union(parts).distinct()


def outbound_leads(observations: DataFrame) -> DataFrame:
    """Leads of listing observations' links, keyed by what they are and where they were found (D-3).

    ``observations``: job_id, platform, url, item_key, outbound_links, observed_at.
    """
    links = observations.filter("platform = 'vpm'").select("job_id", "url", "item_key", "observed_at", F.explode("outbound_links").alias("target_url"))
    found = links.withColumn("kind", lead_kind(F.col("target_url"))).filter("kind is not null")
    return found.select(key_of(F.lit("outbound"), F.col("url"), F.col("item_key"), F.col("kind"), F.col("target_url")).alias("lead_key"), F.col("url").alias("discovered_from_url"), F.col("job_id").alias("discovered_from_job_id"), F.col("item_key").alias("discovered_from_item_key"), "kind", "target_url", F.lit("pending_review").alias("status"), "observed_at")


def canonical_from_listing(observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(packages, links) of complete listing observations: the package is the item, its link is accepted at 1.0 (D-2)."""
    complete = observations.filter("platform = 'vpm' and complete")
    category, umbrella = tag_functions.category_from_tags(F.col("platform_tags"), F.lit("vpm_package")), tag_functions.umbrella_from_tags(F.col("platform_tags"))
    packages = complete.select(F.col("item_key").alias("canonical_id"), umbrella.alias("umbrella"), category.alias("category"), F.lit("active").alias("lifecycle"), F.col("title").alias("display_name"), F.col("item_key").alias("vpm_id"), F.col("observed_at").alias("created_at"), F.col("observed_at").alias("updated_at"), F.lit(None).cast("timestamp").alias("published_at"), F.lit(None).cast("string").alias("timestamp_confidence"))
    return packages, new_links(complete.select(source_key(F.col("platform"), F.col("url"), F.col("item_key")).alias("source_key"), F.col("item_key").alias("canonical_id"), F.lit("vpm_id").alias("evidence_kind"), F.lit(1.0).alias("confidence"), F.lit("accepted").alias("review_state"), F.col("observed_at").alias("created_at")))


def new_links(links: DataFrame) -> DataFrame:
    """Links with an identifier that follows from what they join, so that a repeated observation adds none."""
    return links.select(key_of(F.col("source_key"), F.col("canonical_id"), F.col("evidence_kind")).alias("link_id"), "*")


def repository_matches(observations: DataFrame, leads: DataFrame, links: DataFrame) -> DataFrame:
    """Provisional links at 0.7 from repositories to packages whose listings lead to them (D-4)."""
    repos = observations.filter("platform = 'github'").select(source_key(F.col("platform"), F.col("url"), F.col("item_key")).alias("source_key"), F.explode("outbound_links").alias("link"), "observed_at").withColumn("norm_url", normal_identity(F.col("link")))
    toward = leads.filter("kind = 'github_repository'").withColumn("norm_url", normal_identity(F.col("target_url"))).select("norm_url", "discovered_from_item_key", "discovered_from_url", "claimed_package_id")
    accepted = links.filter("evidence_kind = 'vpm_id' and review_state = 'accepted'").select(F.col("source_key").alias("link_source"), "canonical_id")
    item = F.col("discovered_from_item_key")
    owners = or_join(toward, accepted, [(item, F.col("canonical_id")), (item, F.col("link_source")), (source_key(F.lit("vpm"), F.col("discovered_from_url"), item), F.col("link_source")), (F.col("claimed_package_id"), F.col("canonical_id"))], ["norm_url"], ["canonical_id"])
    found = repos.join(owners, "norm_url").groupBy("source_key", "canonical_id").agg(F.min("observed_at").alias("created_at"))
    return new_links(found.select("source_key", "canonical_id", F.lit("repository").alias("evidence_kind"), F.lit(0.7).alias("confidence"), F.lit("provisional").alias("review_state"), "created_at"))


def storefront_matches(observations: DataFrame, items: DataFrame, leads: DataFrame, links: DataFrame) -> DataFrame:
    """(source_key, canonical_id, observed_at) from five kinds of evidence (D-5): existing links, outbound links to items, repositories'
    REST items, leads' targets, and the job's own URL as a lead's target. All but the first are for storefronts or priced items."""
    live = links.filter("review_state in ('accepted', 'provisional')").select(F.col("source_key").alias("link_source"), "canonical_id")
    own = observations.withColumn("source_key", source_key(F.col("platform"), F.col("url"), F.col("item_key")))
    known = own.join(live, F.col("source_key") == F.col("link_source")).select("source_key", "canonical_id", "observed_at")
    store = own.filter(F.col("platform").isin(*STOREFRONTS) | F.col("price").isNotNull())
    out = store.select("source_key", "observed_at", F.explode("outbound_links").alias("link"))
    places = items.select(F.col("source_key").alias("link_source"), normal_identity(F.col("source_url")).alias("_k")).join(live, "link_source").select("_k", "canonical_id")
    item = F.col("discovered_from_item_key")
    targets = or_join(leads.withColumn("_t", normal_identity(F.col("target_url"))), live, [(item, F.col("canonical_id")), (item, F.col("link_source")), (source_key(F.lit("vpm"), F.col("discovered_from_url"), item), F.col("link_source")), (F.col("claimed_package_id"), F.col("canonical_id"))], ["_t"], ["canonical_id"]).withColumnRenamed("_t", "_k")
    by = lambda frame, key, other: frame.withColumn("_k", key).join(other, "_k").select("source_key", "canonical_id", "observed_at")
    link = F.col("link")
    parts = [known, by(out, normal_identity(link), places), by(out.filter(F.lower(link).startswith("https://github.com/")), normal_identity(github_api_url(link)), places), by(out, normal_identity(link), targets), by(store.select("source_key", "observed_at", "url"), normal_identity(F.col("url")), targets)]
    return union(parts).groupBy("source_key", "canonical_id").agg(F.min("observed_at").alias("observed_at"))


def storefront_links(matches: DataFrame, links: DataFrame) -> DataFrame:
    """Provisional links at 0.8 for matches without a live link."""
    live = links.filter("review_state in ('accepted', 'provisional')").select("source_key", "canonical_id")
    fresh = matches.join(live, ["source_key", "canonical_id"], "left_anti")
    return new_links(fresh.select("source_key", "canonical_id", F.lit("storefront").alias("evidence_kind"), F.lit(0.8).alias("confidence"), F.lit("provisional").alias("review_state"), F.col("observed_at").alias("created_at")))


def storefront_bootstrap(observations: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(packages, links) for storefront observations that match nothing (D-6): a package of their own, classified by text or tags."""
    own = observations.filter(F.col("platform").isin(*STOREFRONTS) | F.col("price").isNotNull()).withColumn("source_key", source_key(F.col("platform"), F.col("url"), F.col("item_key")))
    alone = own.join(matches.select("source_key"), "source_key", "left_anti").withColumn("tool", tag_functions.desktop_tool(F.col("title"), F.col("summary"), F.col("outbound_links"), F.col("platform_tags")))
    sure = F.col("tool.is_tool") & (F.col("tool.confidence") >= 0.8)
    umbrella = F.when(sure, "tools").otherwise(tag_functions.umbrella_from_tags(F.col("platform_tags"), F.lit("assets")))
    category = F.when(sure, F.col("tool.subtype")).otherwise(tag_functions.category_from_tags(F.col("platform_tags"), F.lit("storefront_product")))
    packages = alone.select(F.col("item_key").alias("canonical_id"), umbrella.alias("umbrella"), category.alias("category"), F.lit("active").alias("lifecycle"), F.col("title").alias("display_name"), F.lit(None).cast("string").alias("vpm_id"), F.col("observed_at").alias("created_at"), F.col("observed_at").alias("updated_at"))
    return packages, new_links(alone.select("source_key", F.col("item_key").alias("canonical_id"), F.lit("storefront").alias("evidence_kind"), F.lit(1.0).alias("confidence"), F.lit("accepted").alias("review_state"), F.col("observed_at").alias("created_at")))


def fronts_of(observations: DataFrame, links: DataFrame) -> DataFrame:
    """A front for each package and source that live links join (D-7); a missing price stays null."""
    own = observations.withColumn("source_key", source_key(F.col("platform"), F.col("url"), F.col("item_key")))
    live = links.filter("review_state in ('accepted', 'provisional')").select("source_key", "canonical_id").distinct()
    return own.join(live, "source_key").select(key_of(F.col("canonical_id"), F.col("source_key")).alias("front_id"), "canonical_id", "source_key", "platform", F.coalesce("storefront_url", "url").alias("storefront_url"), "price", "currency", F.coalesce("availability", F.lit("available")).alias("availability"), "observed_at")


def desktop_evidence(observations: DataFrame, links: DataFrame) -> DataFrame:
    """Evidence rows for linked packages of observations that are desktop tools with confidence 0.8 or more (D-8)."""
    own = observations.withColumn("source_key", source_key(F.col("platform"), F.col("url"), F.col("item_key"))).withColumn("tool", tag_functions.desktop_tool(F.col("title"), F.col("summary"), F.col("outbound_links"), F.col("platform_tags"))).filter(F.col("tool.confidence") >= 0.8)
    live = links.filter("review_state in ('accepted', 'provisional')").select("source_key", "canonical_id").distinct()
    text = F.concat_ws(" ", "title", "summary", F.array_join("platform_tags", " "))
    return own.join(live, "source_key").select("canonical_id", F.col("tool.subtype").alias("tool_subtype"), tag_functions.supported_os(text).alias("supported_os"), F.lit(True).alias("particular_vrchat_target"), F.col("url").alias("evidence_url"), F.col("title").alias("publisher_claim"), F.col("tool.confidence").alias("confidence"), F.col("observed_at").alias("created_at"))


def avatar_evidence(observations: DataFrame) -> DataFrame:
    """Compatibility rows of observations (D-9)."""
    own = observations.withColumn("source_key", source_key(F.col("platform"), F.col("url"), F.col("item_key")))
    found = own.select("source_key", "observed_at", F.explode(tag_functions.avatar_compatibility(F.col("title"), F.col("summary"), F.col("platform_tags"), F.col("item_key"))).alias("c"))
    return found.select("c.compatibility_id", "source_key", "c.target_avatar_base", "c.scope", "c.confidence", "c.evidence_source", F.col("observed_at").alias("created_at"))
