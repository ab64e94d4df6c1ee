"""Batches of results applied to an empty catalog."""

from datetime import datetime, timedelta

import pytest

from sparrowgrid import schemas
from sparrowgrid.operators import submission, upsert

T = datetime(2024, 1, 1)
NAMES = ("crawl_jobs", "source_items", "source_versions", "source_events", "source_issues", "source_leads", "canonical_packages", "identity_links", "package_fronts", "avatar_compatibilities", "desktop_tool_evidence", "job_results")
RESULT = "lease_id string, job_id string, node_id string, idempotency_key string, request_digest string, submitted_at timestamp, outcome string, retry_after_seconds long"
SEEN = "lease_id string, position long, item_key string, title string, author string, summary string, outbound_links array<string>, platform_tags array<string>, price double, currency string, availability string, storefront_url string, release_json string"
JOBS = {"vpm": ("vpm", "https://l.example/index.json"), "gh": ("github", "https://api.github.com/repos/o/r"), "booth": ("booth", "https://booth.pm/ja/items/1"), "other": ("booth", "https://booth.pm/ja/items/2")}


class Catalog:
    def __init__(self, spark, tmp):
        self.spark, self.tmp, self.n = spark, tmp, 0
        self.state = {n: spark.createDataFrame([], schemas.TABLES[n].schema) for n in NAMES}
        schema = schemas.TABLES["crawl_jobs"].schema
        rows = [{"job_id": k, "platform": p, "url": u, "origin": "o", "state": "leased", "next_fetch_at": T, "created_at": T, "job_purpose": "metadata", "lease_id": "x"} for k, (p, u) in JOBS.items()]
        self.state["crawl_jobs"] = spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)

    def submit(self, *results):
        """Results: (job, outcome, observations, issues)."""
        rs, seen, issues = [], [], []
        for job, outcome, own, bad in results:
            self.n += 1
            lease = f"lease-{self.n}"
            rs.append((lease, job, "n", "k", f"d{self.n}", T + timedelta(hours=self.n), outcome, None))
            for k, o in enumerate(own):
                base = {"title": "T", "author": "A", "summary": "", "outbound_links": [], "platform_tags": []}
                seen.append((lease, k, *[(base | o).get(c.split()[0]) for c in SEEN.split(", ")[2:]]))
            issues += [(lease, i, "1.0.0", "invalid_manifest") for i in bad]
        f = self.spark.createDataFrame
        new = submission.apply_batch(self.state, f(rs, RESULT), f(seen, SEEN), f(issues, "lease_id string, source_item_key string, version string, code string"), f([], "lease_id string, kind string, url string, claimed_package_id string"), upsert.stager(f"{self.tmp}/stage"))
        for name in NAMES:  # published, so that the next batch reads files
            new[name].write.mode("overwrite").parquet(f"{self.tmp}/{self.n}/{name}")
        self.state = {n: self.spark.read.schema(new[n].schema).parquet(f"{self.tmp}/{self.n}/{n}") for n in NAMES}

    def get(self, name, *columns, order=None):
        return [tuple(r) for r in self.state[name].orderBy(*(order or columns)).select(*columns).collect()]


@pytest.fixture
def catalog(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield Catalog(spark, tmp_path)
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_listing_repository_storefront(catalog):
    listing = {"item_key": "com.a", "title": "Tool", "outbound_links": ["https://github.com/O/R.git", "https://booth.pm/ja/items/1"]}
    catalog.submit(("vpm", "batch", [listing], []), ("booth", "changed", [{"item_key": "booth.pm/ja/items/1", "title": "Hat 【桔梗】", "price": 5.0}], []))
    assert catalog.get("canonical_packages", "canonical_id", "umbrella", "category", "lifecycle", "vpm_id") == [("booth.pm/ja/items/1", "assets", "storefront_product", "active", None), ("com.a", "tools", "vpm_package", "active", "com.a")]
    assert catalog.get("identity_links", "canonical_id", "confidence", "review_state") == [("booth.pm/ja/items/1", 1.0, "accepted"), ("com.a", 1.0, "accepted")]
    assert sorted(k for k, in catalog.get("source_leads", "kind")) == ["github_repository", "storefront_product"]
    assert catalog.get("package_fronts", "canonical_id", "price", "availability") == [("booth.pm/ja/items/1", 5.0, "available")]
    assert catalog.get("avatar_compatibilities", "target_avatar_base") == [("kikyo",)]
    catalog.submit(("gh", "changed", [{"item_key": "github:1", "outbound_links": ["https://github.com/o/r"]}], []), ("booth", "changed", [{"item_key": "booth.pm/ja/items/1", "title": "Hat", "price": 6.0}], []))
    assert ("com.a", 0.7, "provisional") in catalog.get("identity_links", "canonical_id", "confidence", "review_state")
    assert ("com.a", 0.8, "provisional") in catalog.get("identity_links", "canonical_id", "confidence", "review_state")
    assert catalog.get("package_fronts", "canonical_id", "price") == [("booth.pm/ja/items/1", 6.0), ("com.a", 6.0)]
    before = len(catalog.get("identity_links", "link_id"))
    catalog.submit(("vpm", "batch", [listing], []))
    assert len(catalog.get("identity_links", "link_id")) == before
    assert catalog.get("source_versions", "version_no", order=["source_key", "version_no"]) == [(1,), (2,), (1,), (1,)]
    assert [s for s, in catalog.get("crawl_jobs", "state", order=["job_id"])] == ["done", "done", "leased", "done"]


def test_gone_and_restored(catalog):
    item = {"item_key": "booth.pm/ja/items/1", "title": "Hat"}
    catalog.submit(("booth", "changed", [item], []))
    catalog.submit(("booth", "gone", [], []))
    assert catalog.get("package_fronts", "availability") == [("delisted",)] and catalog.get("canonical_packages", "lifecycle") == [("delisted",)]
    catalog.submit(("booth", "changed", [item], []))
    assert catalog.get("source_versions", "version_no") == [(1,)] and catalog.get("source_items", "gone_at") == [(None,)]
    assert [k for k, in catalog.get("source_events", "kind", order=["observed_at"])] == ["changed", "gone", "restored"]
    assert catalog.get("package_fronts", "availability") == [("available",)] and catalog.get("canonical_packages", "lifecycle") == [("delisted",)]


def test_partial_then_complete(catalog):
    catalog.submit(("vpm", "partial_batch", [{"item_key": "com.a"}, {"item_key": "com.b"}], ["com.a"]))
    assert catalog.get("canonical_packages", "canonical_id") == [("com.b",)] and catalog.get("source_issues", "source_item_key", "code") == [("com.a", "invalid_manifest")]
    catalog.submit(("vpm", "batch", [{"item_key": "com.a"}, {"item_key": "com.b"}], []))
    assert catalog.get("canonical_packages", "canonical_id") == [("com.a",), ("com.b",)]
    assert catalog.get("source_versions", "source_key", "version_no", "complete") == [("vpm:https://l.example/index.json:com.a", 1, False), ("vpm:https://l.example/index.json:com.a", 2, True), ("vpm:https://l.example/index.json:com.b", 1, True)]
