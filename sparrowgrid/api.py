"""The engine's front: what the routes of a catalog service ask for, over stored tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.codecs import decode_cursor, encode_cursor
from .functions.policy import iso_text, utc
from .operators import catalog, downstream, scheduling
from .operators.paging import page, visible
from .sources import tables


class Catalog:
    """Reads over the tables under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self._spark, self._root = spark, root

    def table(self, name: str):
        """A table by name."""
        return tables.read(self._spark, self._root, name)

    def _nested(self, rows: list) -> list[dict]:
        ids = [r["canonical_id"] for r in rows]
        own = self.table("canonical_packages").filter(F.col("canonical_id").isin(ids))
        found = {r["canonical_id"]: r.asDict(recursive=True) for r in catalog.children(own, self.table("identity_links"), self.table("package_fronts")).collect()}
        return [found[i] for i in ids]

    def index(self, limit: int = 50, cursor: str | None = None) -> dict:
        """A page of packages, newest first; a cursor that doesn't decode is an error."""
        after = decode_cursor("catalog", cursor) if cursor else None
        if cursor and after is None:
            raise ValueError("invalid cursor")
        key = (utc(after["createdAt"]), after["canonicalId"]) if after else None
        rows, more = visible(catalog.catalog_page(self.table("canonical_packages"), limit, key).withColumn("at", iso_text(F.col("created_at"))).collect(), limit)
        return {"items": self._nested(rows), "next_cursor": encode_cursor("catalog", createdAt=rows[-1]["at"], canonicalId=rows[-1]["canonical_id"]) if more else None}

    def epoch(self) -> str:
        """The catalog's epoch; a consumer whose cursor has another one starts again."""
        row = self.table("coordinator_meta").filter("key = 'catalog_epoch'").first()
        return row["value"] if row else "0"

    def delta(self, limit: int = 50, cursor: str | None = None) -> dict:
        """Changes after a cursor. On the last page there is no cursor: a consumer keeps the one it had."""
        after, epoch = decode_cursor("delta", cursor) if cursor else None, self.epoch()
        if cursor and after is None:
            raise ValueError("invalid cursor")
        if after and after["epoch"] != epoch:
            return {"epoch": epoch, "restart": True, "changes": [], "next_cursor": None}
        key = (utc(after["updatedAt"]), after["canonicalId"]) if after else None
        rows, more = visible(catalog.catalog_delta(self.table("canonical_packages"), limit, key).withColumn("at", iso_text(F.col("updated_at"))).collect(), limit)
        bodies = {b["canonical_id"]: b for b in self._nested([r for r in rows if r["change"] == "upsert"])}
        changes = [{"change": r["change"], "canonical_id": r["canonical_id"], "package": bodies.get(r["canonical_id"])} for r in rows]
        return {"epoch": epoch, "restart": False, "changes": changes, "next_cursor": encode_cursor("delta", updatedAt=rows[-1]["at"], canonicalId=rows[-1]["canonical_id"], epoch=epoch) if more else None}

    def search(self, request: catalog.Search, cursor: str | None = None) -> dict:
        """A search's page and total; a cursor that doesn't decode is ignored."""
        after = decode_cursor("catalog", cursor) if cursor else None
        if after:
            request = replace(request, after=(utc(after["createdAt"]), after["canonicalId"]))
        frames = [self.table(n) for n in ("canonical_packages", "identity_links", "package_fronts", "avatar_compatibilities")]
        rows, more = visible(catalog.search_page(request, *frames).withColumn("at", iso_text(request.keys()[0])).collect(), request.limit)
        total = catalog.search_total(request, *frames).first()["total"]
        return {"items": self._nested(rows), "total_estimated": total, "next_cursor": encode_cursor("catalog", createdAt=rows[-1]["at"], canonicalId=rows[-1]["canonical_id"]) if more else None}

    def leads(self, limit: int = 50, cursor: str | None = None) -> list[dict]:
        """Pending leads, oldest first."""
        after = decode_cursor("leads", cursor) if cursor else None
        key = (utc(after["firstSeenAt"]), after["leadKey"]) if after else None
        return [r.asDict() for r in visible(page(self.table("source_leads").filter("status = 'pending_review'"), [F.col("first_seen_at"), F.col("lead_key")], limit, key).collect(), limit)[0]]

    def apps(self, user_id: str, limit: int = 50) -> list[dict]:
        """A user's applications."""
        rows = downstream.owned_apps(self.table("registered_apps"), self.table("user_app_ownership"), self.table("registered_users"), user_id, limit)
        return [r.asDict() for r in visible(rows.collect(), limit)[0]]

    def workforce(self, now: str, candidates: tuple[str, ...] = ()) -> list[str]:
        """Platforms by need."""
        rows = scheduling.workforce(self.table("crawl_jobs"), self.table("downstream_demand_signals"), self.table("node_heartbeats"), self.table("node_credentials"), F.lit(now).cast("timestamp"), candidates)
        return [r["platform"] for r in rows.collect()]
