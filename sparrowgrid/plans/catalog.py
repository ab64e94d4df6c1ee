"""Catalog pages, deltas and searches."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog, upsert
from ..sources import adapters as a
from .registry import query

FRONT_KEY = ["canonical_id", "source_key"]


def _newest(rows: DataFrame, shown: DataFrame | None) -> DataFrame:
    """The newest row of each key; those of a page's packages only, whose ids (a page's number at most) are broadcast before anything is shuffled."""
    if shown is not None:
        rows = rows.join(F.broadcast(shown.select("canonical_id")), "canonical_id", "left_semi")
    return upsert.latest(rows, FRONT_KEY, [F.col("seq")]).drop("seq")


def _links(spark: SparkSession, sf_dir: str, shown: DataFrame | None = None) -> DataFrame:
    return _newest(a.link_rows(spark, sf_dir), shown)


def _fronts(spark: SparkSession, sf_dir: str, shown: DataFrame | None = None) -> DataFrame:
    return _newest(a.front_rows(spark, sf_dir), shown)


def _page(spark: SparkSession, sf_dir: str, shown: DataFrame) -> DataFrame:
    return _flat(catalog.children(shown, _links(spark, sf_dir, shown), _fronts(spark, sf_dir, shown)))


def _flat(nested: DataFrame) -> DataFrame:
    """A page's children as text, so that its rows can be compared anywhere."""
    return nested.select(
        "canonical_id", "umbrella", "lifecycle", a.iso("created_at").alias("created_at"), F.size("links").cast("long").alias("n_links"), F.size("fronts").cast("long").alias("n_fronts"),
        F.array_join(F.transform("links", lambda x: x["source_key"]), ",").alias("link_sources"), F.array_join(F.transform("fronts", lambda x: x["front_id"]), ",").alias("front_ids"),
        F.round(F.aggregate(F.transform("fronts", lambda x: x["price"]), F.lit(0.0), lambda s, p: s + p), 2).alias("price_sum"),
    )


_NESTED = f"""
SELECT p.canonical_id, p.umbrella, p.lifecycle, strftime(p.created_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS created_at, coalesce(l.n, 0) AS n_links, coalesce(f.n, 0) AS n_fronts,
       coalesce(l.s, '') AS link_sources, coalesce(f.s, '') AS front_ids, round(coalesce(f.total, 0.0), 2) AS price_sum
FROM shown p
LEFT JOIN (SELECT canonical_id, count(*) AS n, string_agg(source_key, ',' ORDER BY created_at, source_key) AS s FROM link WHERE review_state = 'accepted' GROUP BY 1) l USING (canonical_id)
LEFT JOIN (SELECT canonical_id, count(*) AS n, string_agg(front_id, ',' ORDER BY observed_at, front_id) AS s, sum(price) AS total FROM front GROUP BY 1) f USING (canonical_id)"""


def _with(*views: str) -> str:
    return "WITH " + ", ".join(views)


@query(_with(a.PACKAGES, a.FRONTS, a.LINKS, "shown AS (SELECT * FROM package ORDER BY created_at DESC, canonical_id DESC LIMIT 51)") + _NESTED)
def catalog_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest page of the catalog with its links and fronts (D-18, D-19, O-4, J-15)."""
    return _page(spark, sf_dir, catalog.catalog_page(a.packages(spark, sf_dir), 50))


@query(_with(a.PACKAGES, a.FRONTS, a.LINKS, "shown AS (SELECT * FROM package WHERE (created_at, canonical_id) < (TIMESTAMP '1998-01-01', 'pkg-5') ORDER BY created_at DESC, canonical_id DESC LIMIT 26)") + _NESTED)
def catalog_page_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page behind a cursor (D-19, O-4)."""
    return _page(spark, sf_dir, catalog.catalog_page(a.packages(spark, sf_dir), 25, (datetime(1998, 1, 1), "pkg-5")))


@query(_with(a.PACKAGES, a.FRONTS, a.LINKS, "shown AS (SELECT * FROM package)") + _NESTED)
def catalog_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole catalog (D-18)."""
    return _flat(catalog.children(a.packages(spark, sf_dir), _links(spark, sf_dir), _fronts(spark, sf_dir)))


@query(_with(a.PACKAGES) + " SELECT canonical_id, strftime(updated_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS updated_at, lifecycle, CASE WHEN lifecycle = 'delisted' THEN 'tombstone' ELSE 'upsert' END AS change FROM package WHERE (updated_at, canonical_id) > (TIMESTAMP '1995-06-01', 'pkg-10') ORDER BY package.updated_at, canonical_id LIMIT 101")
def catalog_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes after a cursor (D-20, O-3, T-2)."""
    return catalog.catalog_delta(a.packages(spark, sf_dir), 100, (datetime(1995, 6, 1), "pkg-10")).select("canonical_id", a.iso("updated_at").alias("updated_at"), "lifecycle", "change")


def _frames(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [a.packages(spark, sf_dir), _links(spark, sf_dir), _fronts(spark, sf_dir), a.compatibilities(spark, sf_dir)]


def _found(spark: SparkSession, sf_dir: str, search: catalog.Search) -> DataFrame:
    return catalog.search_page(search, *_frames(spark, sf_dir)).select("canonical_id", "umbrella", "category", "display_name", "vpm_id", a.iso("created_at").alias("created_at"))


_SHOWN = " SELECT canonical_id, umbrella, category, display_name, vpm_id, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS created_at FROM package p WHERE lifecycle <> 'delisted'"
_BY_PUBLICATION = " ORDER BY coalesce(p.published_at, p.created_at) DESC, canonical_id DESC LIMIT 51"


@query(_with(a.PACKAGES, a.FRONTS) + _SHOWN + " AND umbrella = 'tools' AND category = 'shader' AND EXISTS (SELECT 1 FROM front f WHERE f.canonical_id = p.canonical_id AND f.platform = 'vpm')" + _BY_PUBLICATION)
def search_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search by umbrella, category and platform (D-21, J-5)."""
    return _found(spark, sf_dir, catalog.Search(umbrella="tools", category="shader", platform="vpm"))


@query(_with(a.PACKAGES) + _SHOWN + " AND (display_name ILIKE '%HIGH 1%' OR category ILIKE '%HIGH 1%' OR coalesce(vpm_id, '') ILIKE '%HIGH 1%') ORDER BY p.created_at DESC, canonical_id DESC LIMIT 51")
def search_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search by keyword, whatever its case (D-21)."""
    return _found(spark, sf_dir, catalog.Search(query=" high 1 "))


_TAG = "(category ILIKE '%{0}%' OR umbrella = '{0}' OR display_name ILIKE '%{0}%' OR EXISTS (SELECT 1 FROM link l JOIN compatibility c USING (source_key) WHERE l.canonical_id = p.canonical_id AND l.review_state = 'accepted' AND (c.target_avatar_base ILIKE '%{0}%' OR c.scope ILIKE '%{0}%')))"


@query(_with(a.PACKAGES, a.LINKS, a.COMPATIBILITIES) + _SHOWN + f" AND {_TAG.format('kikyo')} AND {_TAG.format('tools')}" + _BY_PUBLICATION)
def search_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search by two tags, each of which may fit in five ways (D-21, J-13)."""
    return _found(spark, sf_dir, catalog.Search(tags=(" Kikyo", "tools", " ")))


@query(_with(a.PACKAGES, a.LINKS, a.COMPATIBILITIES) + f" SELECT count(*) AS total FROM package p WHERE lifecycle <> 'delisted' AND {_TAG.format('universal')} AND (coalesce(published_at, created_at), canonical_id) < (TIMESTAMP '1997-01-01', 'pkg-7')")
def search_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number that a search finds from its cursor on (A-5)."""
    return catalog.search_total(catalog.Search(tags=("universal",), after=(datetime(1997, 1, 1), "pkg-7")), *_frames(spark, sf_dir))


@query(_with(a.PACKAGES) + _SHOWN + " AND umbrella = 'avatars' AND (coalesce(published_at, p.created_at), canonical_id) < (TIMESTAMP '1996-03-01', 'pkg-3')" + _BY_PUBLICATION)
def search_published_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search in order of publication, behind a cursor (O-5)."""
    return _found(spark, sf_dir, catalog.Search(umbrella="avatars", after=(datetime(1996, 3, 1), "pkg-3")))
