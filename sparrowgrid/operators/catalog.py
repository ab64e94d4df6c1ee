"""Catalog reads: build, page, delta, faceted search."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .paging import beyond, page


def children(packages: DataFrame, links: DataFrame, fronts: DataFrame) -> DataFrame:
    """Packages with their accepted links and all their fronts, nested in order (D-18, J-15, O-8).

    Children are restricted to the packages given before they are grouped, so that a page's build reads a page's children.
    """
    ids = packages.select("canonical_id")
    own_links = links.filter("review_state = 'accepted'").join(ids, "canonical_id", "left_semi").groupBy("canonical_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "source_key", "evidence_kind", "confidence"))).alias("links"))
    own_fronts = fronts.join(ids, "canonical_id", "left_semi").groupBy("canonical_id").agg(F.array_sort(F.collect_list(F.struct("observed_at", "front_id", "source_key", "platform", "storefront_url", "price", "currency", "availability"))).alias("fronts"))
    out = packages.join(own_links, "canonical_id", "left").join(own_fronts, "canonical_id", "left")
    empty = lambda c: F.coalesce(c, F.array().cast(out.schema[c].dataType))
    return out.withColumns({"links": empty("links"), "fronts": empty("fronts")})


def catalog_page(packages: DataFrame, limit: int = 50, after: tuple | None = None) -> DataFrame:
    """Newest packages first (D-19): created_at, then canonical_id, descending."""
    return page(packages, [F.col("created_at"), F.col("canonical_id")], limit, after, descending=True)


def catalog_delta(packages: DataFrame, limit: int = 50, after: tuple | None = None) -> DataFrame:
    """Changes in order (D-20, T-2): a delisted package is a tombstone, others are upserts."""
    rows = page(packages, [F.col("updated_at"), F.col("canonical_id")], limit, after)
    return rows.withColumn("change", F.when(F.col("lifecycle") == "delisted", "tombstone").otherwise("upsert"))


def like(column: Column, text: str) -> Column:
    """``LIKE '%text%'`` that ignores the case of letters; ``%`` and ``_`` in the text keep their meaning."""
    return F.coalesce(column.ilike(f"%{text}%"), F.lit(False))


@dataclass
class Search:
    """A catalog search."""

    umbrella: str | None = None
    category: str | None = None
    platform: str | None = None
    query: str | None = None
    tags: Sequence[str] = field(default_factory=tuple)
    limit: int = 50
    after: tuple | None = None

    @property
    def keyword(self) -> str | None:
        return (self.query or "").strip() or None

    def keys(self) -> list[Column]:
        """With a keyword by creation, else by publication where there is one (O-5)."""
        at = F.col("created_at") if self.keyword else F.coalesce("published_at", "created_at")
        return [at, F.col("canonical_id")]


def matching(search: Search, packages: DataFrame, links: DataFrame, fronts: DataFrame, compatibilities: DataFrame) -> DataFrame:
    """Packages that a search finds, before paging (D-21)."""
    found = packages.filter("lifecycle <> 'delisted'")
    if search.umbrella:
        found = found.filter(F.col("umbrella") == search.umbrella)
    if search.category:
        found = found.filter(F.col("category") == search.category)
    if search.keyword:
        found = found.filter(like(F.col("display_name"), search.keyword) | like(F.col("category"), search.keyword) | like(F.col("vpm_id"), search.keyword))
    if search.platform:
        found = found.join(fronts.filter(F.col("platform") == search.platform).select("canonical_id"), "canonical_id", "left_semi")
    for tag in [t.strip().lower() for t in search.tags if t.strip()]:
        # A semi join of one kind of evidence would make the disjunction a nested loop: the ids that fit are marked first.
        fits = compatibilities.filter(like(F.col("target_avatar_base"), tag) | like(F.col("scope"), tag)).select("source_key")
        tagged = links.filter("review_state = 'accepted'").join(fits, "source_key", "left_semi").select("canonical_id").distinct().withColumn("_fits", F.lit(True))
        plain = like(F.col("category"), tag) | (F.col("umbrella") == tag) | like(F.col("display_name"), tag)
        found = found.join(tagged, "canonical_id", "left").filter(F.col("_fits").isNotNull() | plain).drop("_fits")
    return found


def search_page(search: Search, packages: DataFrame, links: DataFrame, fronts: DataFrame, compatibilities: DataFrame) -> DataFrame:
    """A page of what a search finds, newest first."""
    return page(matching(search, packages, links, fronts, compatibilities), search.keys(), search.limit, search.after, descending=True)


def search_total(search: Search, packages: DataFrame, links: DataFrame, fronts: DataFrame, compatibilities: DataFrame, count_scope: str = "page") -> DataFrame:
    """The number found (A-5): from the cursor on (``page``, as the source counts), or altogether (``all``)."""
    found = matching(search, packages, links, fronts, compatibilities)
    if search.after is not None and count_scope == "page":
        found = found.filter(beyond(search.keys(), search.after, descending=True))
    return found.agg(F.count(F.lit(1)).alias("total"))
