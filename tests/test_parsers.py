"""Parsers and outcomes against inline bodies."""

import json

import pytest
from pyspark.sql import functions as F

from sparrowgrid.sources import parsers as p
from sparrowgrid.sources import responses

VPM = p.Job("vpm", "discovery", "https://l.example/index.json")


def _manifest(name="com.a.b", version="1.0.0", **more):
    return {"name": name, "version": version, **more}


def _listing(versions, name="com.a.b"):
    return json.dumps({"name": "L", "url": "https://l.example/?utm_source=x", "author": {"name": "Root"}, "packages": {name: {"versions": versions}}})


def test_listing():
    body = _listing({"1.0.0": _manifest(displayName="[FREE] Tool", url="https://d.example/a.zip", keywords=[" avatar ", "tool", "avatar", "  ", 42, "vrc", "tool"]), "1.2.3-rc.2+build.04": _manifest(version="1.2.3-rc.2+build.04", updated_at="2024-01-02", vpmDependencies={"x": ">=1"})})
    (found,), issues = p.repository(VPM, body)
    assert issues == [] and p.strict_repository(VPM, body) == [found]
    assert (found["source_item_key"], found["title"], found["author"], found["platform_tags"]) == ("com.a.b", "Tool", "Root", ["avatar", "tool", "vrc"])
    assert found["outbound_links"] == ["https://l.example", "https://d.example/a.zip"] and found["origin_updated_at"] == "2024-01-02T00:00:00.000Z"
    assert [r["version"] for r in found["releases"]] == ["1.0.0", "1.2.3-rc.2+build.04"] and found["releases"][1]["dependency_ranges"] == {"x": ">=1"}


def test_listing_issues():
    body = _listing({"1.0.0": "x", "1.0.1": {"name": 1, "version": "1.0.1"}, "1.0.2": _manifest("other", "1.0.2"), "v2.0.0": _manifest(version="v2.0.0"), "1.2": _manifest(version="1.2"), "3.0.0": _manifest(version="3.0.0", zipSHA256="zz"), "4.0.0": _manifest(version="4.0.0")})
    (found,), issues = p.repository(VPM, body)
    assert [i["code"] for i in issues] == ["invalid_manifest", "invalid_manifest", "identity_mismatch", "invalid_version", "invalid_version", "invalid_release_evidence"]
    assert len(found["releases"]) == 1 and p.strict_repository(VPM, body) is None
    for bad in ("", "[]", "{}", '{"packages":{}}', json.dumps({"packages": {str(k): {} for k in range(101)}})):
        assert p.repository(VPM, bad) is None
    assert p.repository(VPM, '{"packages":{"a":{}}}') == ([], [{"source_item_key": "a", "version": None, "code": "invalid_package"}])


def test_keywords():
    assert len(p.tags_of([str(k) for k in range(60)])) == 50
    assert p.tags_of("x") is None and p.tags_of(["x" * 101]) is None


def test_recipe():
    body = {"name": "N", "url": "https://l.example", "githubRepos": ["o/r", "o/r"], "packages": [{"id": "p", "releases": ["https://d.example/A.ZIP"]}]}
    leads = p.recipe(VPM, json.dumps(body))
    assert [(x["kind"], x["url"], x["claimed_package_id"]) for x in leads] == [("vpm_listing", "https://l.example/", None), ("github_repository", "https://github.com/o/r", None), ("release_zip", "https://d.example/A.ZIP", "p")]
    for change in ({"githubRepos": ["o"]}, {"githubRepos": ["o/.."]}, {"url": "http://x"}, {"packages": [{"releases": ["https://d/x.txt"]}]}, {"name": ""}, {"packages": 1}):
        assert p.recipe(VPM, json.dumps(body | change)) is None


def test_github():
    job = p.Job("github", "metadata", "https://api.github.com/repos/Own/Repo")
    body = {"private": False, "full_name": "own/repo", "owner": {"login": "Own"}, "name": "Repo", "id": 7, "html_url": "https://github.com/Own/Repo", "homepage": "https://h.example", "updated_at": "2024-01-01T00:00:00Z"}
    found = p.github(job, json.dumps(body))
    assert (found["source_item_key"], found["outbound_links"], found["origin_updated_at"]) == ("github:7", ["https://github.com/Own/Repo", "https://h.example"], "2024-01-01T00:00:00.000Z")
    for change in ({"private": True}, {"full_name": "x/y"}, {"id": 0}, {"id": True}, {"html_url": "https://evil.example/Own/Repo"}, {"owner": None}):
        assert p.github(job, json.dumps(body | change)) is None


def test_manifest():
    assert p.manifest(VPM, json.dumps(_manifest()))["release"]["version"] == "1.0.0"
    for bad in (_manifest(version="v1.0.0"), _manifest(name=" a"), _manifest(name="x" * 201), {"name": "a"}):
        assert p.manifest(VPM, json.dumps(bad)) is None


def test_product():
    job = p.Job("booth", "metadata", "https://booth.pm/ja/items/12")
    linked = json.dumps([{"@type": "Product", "url": "https://booth.pm/ja/items/99", "name": "Other"}, {"@type": "Product", "url": "/ja/items/12", "name": "[FREE] Hat", "brand": {"name": "Shop"}, "keywords": "a; b"}])
    found = p.product(job, f"<script type='application/ld+json'>{linked}</script><div class='item-description'>Nice <a href='https://x.example'>x</a></div><p class='tags'><a>c</a></p>")
    assert (found["source_item_key"], found["title"], found["author"], found["summary"], found["platform_tags"]) == ("booth.pm/ja/items/12", "Hat", "Shop", "Nice x", ["a", "b", "c"])
    assert found["outbound_links"] == ["https://booth.pm/ja/items/12", "https://x.example"]
    assert p.product(job, "<meta property=og:title content='T'><h1>no</h1>")["title"] == "T"
    assert p.product(job, "<p>no title</p>") is None and p.product(p.Job("booth", "metadata", "https://booth.pm/x"), "<h1>a</h1>") is None


def test_browse():
    job = p.Job("booth", "discovery", "https://booth.pm/ja/browse/x?page=1")
    body = '<a href="/ja/items/12345?x=1">a</a><a href="https://booth.pm/items/67890">b</a><a href="/ja/items/12345#t">c</a><a href="https://other.pm/items/1">d</a>'
    assert [x["url"] for x in p.browse(job, body)] == ["https://booth.pm/ja/items/12345", "https://booth.pm/ja/items/67890"]
    assert p.browse(job, "".join(f'<a href="/items/{k}">x</a>' for k in range(1, 102))) is None
    assert p.browse(p.Job("booth", "discovery", "https://booth.pm/ja/browse/x"), body) is None


def test_sitemap():
    job = p.Job("shopify", "discovery", "https://s.example/sitemap_products_1.xml", "https://s.example")
    body = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://s.example/products/a</loc></url><url><loc>https://s.example/products/a</loc></url><url><loc>https://other.example/products/b</loc></url><url><loc>https://s.example/collections/c</loc></url></urlset>'
    assert [x["url"] for x in p.sitemap(job, body)] == ["https://s.example/products/a"]
    for bad in (body[:-9], "<!DOCTYPE x>" + body, "<sitemapindex></sitemapindex>", body.replace("<url>", "<urlx>", 1)):
        assert p.sitemap(job, bad) is None


def test_curated():
    job = p.Job("curated", "discovery", "https://c.example/list.txt")
    body = "# comment\nhttps://a.example/index.json\nhttps://b.example/vpm.json\nhttp://c.example/x.json\nhttps://github.com/o/r\n"
    assert [x["kind"] for x in p.curated(job, body)] == ["vpm_listing", "vpm_listing", "github_repository"]
    assert [x["url"] for x in p.curated(job, "<html>see https://github.com/o/r/issues and https://github.com/topics/x</html>", "text/html")] == ["https://github.com/o/r"]
    assert p.curated(job, "nothing") is None


@pytest.mark.parametrize(("status", "headers", "body", "outcome"), [
    (429, {"retry-after": "42"}, "", ("rate_limited", 42)), (403, {"retry-after": "9"}, "", ("rate_limited", 9)), (200, {"cf-mitigated": "challenge"}, "", ("blocked", None)), (302, {}, "", ("blocked", None)), (403, {}, "", ("blocked", None)),
    (304, {}, "", ("unchanged", None)), (410, {}, "", ("gone", None)), (500, {}, "", ("temporary_failure", None)), (200, {}, "x" * 2_000_001, ("temporary_failure", None)), (200, {}, "<h1>Name</h1>", ("changed", None)), (200, {}, None, ("temporary_failure", None)),
])
def test_outcomes(spark, status, headers, body, outcome):
    row = ("j", "custom_domain", "metadata", "https://x.example/a", "https://x.example", status, headers, body)
    rows = spark.createDataFrame([row], "job_id string, platform string, purpose string, url string, origin string, status int, headers map<string,string>, body string")
    got = responses.outcomes(rows, F.lit("2025-01-01").cast("timestamp")).first()
    assert (got["outcome"], got["retry_after_seconds"]) == outcome


def test_gate(spark):
    rows = [("github", "metadata", "https://github.com/o/r"), ("booth", "discovery", "https://booth.pm/x"), ("booth", "metadata", "https://booth.pm/items/1"), ("sellfy", "metadata", "https://s.example/p/a"), ("custom_domain", "metadata", "https://s.example/")]
    df = spark.createDataFrame(rows, "platform string, purpose string, url string").withColumn("g", responses.gate(F.col("platform"), F.col("purpose"), F.col("url"), F.lit("")))
    assert [r["g"] for r in df.collect()] == ["not_a_repository", "not_a_browse_page", None, None, "no_path"]
