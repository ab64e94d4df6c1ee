"""Dataflow operators on small frames."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sparrowgrid import schemas
from sparrowgrid.api import Catalog
from sparrowgrid.operators import catalog, downstream, guards, identity, journal, lifecycle, paging, scheduling, upsert, versions
from sparrowgrid.sources import robots, tables
from sparrowgrid.streaming import delta, pacing

T = datetime(2024, 1, 1)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "k int, v string, w string")
    new = spark.createDataFrame([(2, "c", None, 1), (2, "d", None, 2), (3, "e", "y", 1)], "k int, v string, w string, seq int")
    assert rows(upsert.upsert(old, new, ["k"], [F.col("seq")])) == [(1, "a", None), (2, "d", None), (3, "e", "y")]
    last = upsert.latest(new, ["k"], [F.col("seq")]).drop("seq")
    assert rows(upsert.merge(old, last, ["k"], keep_if_null=["w"])) == [(1, "a", None), (2, "d", "x"), (3, "e", "y")]
    assert rows(upsert.merge(old, last, ["k"], keep_old=["v"])) == [(1, "a", None), (2, "b", None), (3, "e", "y")]
    assert rows(upsert.insert_ignore(old, new, ["k"], [F.col("seq")])) == [(3, "e", "y", 1)]
    assert rows(upsert.guarded_update(old, old.filter("k = 1"), ["k"], {"v": F.lit("z")})) == [(1, "z", None), (2, "b", "x")]
    parents, kids = upsert.delete_cascade(old, {"c": (new, ["k"])}, old.filter("k = 2"), ["k"])
    assert rows(parents) == [(1, "a", None)] and rows(kids["c"].select("k")) == [(3,)]
    empty = new.filter("false")
    assert rows(upsert.upsert(old, empty, ["k"], [F.col("seq")])) == rows(old)


def test_publish(spark, tmp_path):
    upsert.publish({"a": spark.range(3), "b": spark.range(1)}, str(tmp_path), "b1")
    assert upsert.published(spark, str(tmp_path), "a").count() == 3


@pytest.mark.parametrize(("history", "expected"), [
    ([("d1", True, False)], [(1, "changed")]),
    ([("d1", True, False), ("d1", True, False), ("d2", True, False)], [(1, "changed"), (1, "unchanged"), (2, "changed")]),
    ([("d1", False, False), ("d1", True, False), ("d1", True, False)], [(1, "changed"), (2, "changed"), (2, "unchanged")]),
    ([("d1", True, False), (None, False, True), ("d1", True, False)], [(1, "changed"), (1, "gone"), (1, "restored")]),
    ([("d1", True, False), (None, False, True), ("d2", False, False), ("d2", True, False)], [(1, "changed"), (1, "gone"), (2, "changed"), (3, "restored")]),
    ([("d1", True, False), ("d1", False, False)], [(1, "changed"), (1, "unchanged")]),
])
def test_versions(spark, history, expected):
    df = spark.createDataFrame([("s", k, *h) for k, h in enumerate(history)], "source_key string, seq int, digest string, complete boolean, gone boolean")
    got = versions.project_versions(df).orderBy("seq").select("version_no", "event").collect()
    assert [tuple(r) for r in got] == expected


def _packages(spark, *more):
    base = [("a", "tools", "x", "active", "Alpha Optimizer", "com.a", T, T, None, None), ("b", "tools", "y", "active", "Beta", None, datetime(2023, 1, 1), T, None, None), ("c", "assets", "z", "delisted", "Gamma", None, T, datetime(2024, 2, 1), None, None), *more]
    return spark.createDataFrame(base, schemas.TABLES["canonical_packages"].schema)


def test_search_order(spark):
    p = spark.createDataFrame([(k, "tools", "c", "active", k, None, created, T, published, None) for k, created, published in (("a", T, datetime(2021, 1, 1)), ("b", T, datetime(2024, 1, 1)), ("c", datetime(2023, 1, 1), None))], schemas.TABLES["canonical_packages"].schema)
    none = [spark.createDataFrame([], schemas.TABLES[n].schema) for n in ("identity_links", "package_fronts", "avatar_compatibilities")]
    first = catalog.Search(limit=2)
    got, more = paging.visible(catalog.search_page(first, p, *none).collect(), 2)
    assert [r["canonical_id"] for r in got] == ["b", "c"] and more
    rest = catalog.search_page(catalog.Search(limit=2, after=(datetime(2023, 1, 1), "c")), p, *none).collect()
    assert [r["canonical_id"] for r in rest] == ["a"]


def test_catalog(spark, tmp_path):
    root = str(tmp_path)
    links = [("l1", "s1", "a", "vpm_id", 1.0, "accepted", T, None), ("l2", "s2", "a", "repository", 0.7, "provisional", T, None)]
    fronts = [("f1", "a", "s1", "booth", "https://x", None, None, "available", T), ("f2", "a", "s2", "vpm", "https://y", 1.0, "USD", "available", datetime(2023, 1, 1))]
    compat = [("c1", "s1", "kikyo", "named_base", "creator_declared", "title", T)]
    data = {"canonical_packages": _packages(spark)} | {n: spark.createDataFrame(r, schemas.TABLES[n].schema) for n, r in (("identity_links", links), ("package_fronts", fronts), ("avatar_compatibilities", compat), ("coordinator_meta", [("catalog_epoch", "7")]))}
    for name, frame in data.items():
        tables.write(frame, root, name)
    c = Catalog(spark, root)
    first = c.index(limit=2)
    assert [i["canonical_id"] for i in first["items"]] == ["c", "a"] and first["next_cursor"]
    assert [f["front_id"] for f in first["items"][1]["fronts"]] == ["f2", "f1"] and len(first["items"][1]["links"]) == 1 and first["items"][0]["links"] == []
    assert [i["canonical_id"] for i in c.index(limit=2, cursor=first["next_cursor"])["items"]] == ["b"]
    with pytest.raises(ValueError, match="cursor"):
        c.index(cursor="x")
    changes = c.delta()
    assert [(x["change"], x["canonical_id"], x["package"] is None) for x in changes["changes"]] == [("upsert", "a", False), ("upsert", "b", False), ("tombstone", "c", True)] and changes["epoch"] == "7"
    found = c.search(catalog.Search(query="optimizer"))
    assert [i["canonical_id"] for i in found["items"]] == ["a"] and found["total_estimated"] == 1
    assert c.search(catalog.Search(umbrella="tools", limit=1))["next_cursor"]
    assert [i["canonical_id"] for i in c.search(catalog.Search(tags=("Kikyo",)))["items"]] == ["a"]
    assert [i["canonical_id"] for i in c.search(catalog.Search(platform="vpm"))["items"]] == ["a"]


OBSERVATION = "job_id string, platform string, url string, item_key string, title string, summary string, outbound_links array<string>, platform_tags array<string>, price double, currency string, availability string, storefront_url string, complete boolean, observed_at timestamp"


def _observed(spark, *rows_):
    base = {"job_id": "j", "title": "T", "summary": "", "outbound_links": [], "platform_tags": [], "price": None, "currency": None, "availability": None, "storefront_url": None, "complete": True, "observed_at": T}
    names = [x.split()[0] for x in OBSERVATION.split(", ")]
    return spark.createDataFrame([tuple((base | r)[n] for n in names) for r in rows_], OBSERVATION)


def test_identity(spark):
    listing = _observed(spark, {"platform": "vpm", "url": "https://l/i.json", "item_key": "com.a", "outbound_links": ["https://github.com/O/R.git", "https://booth.pm/items/1", "http://no"]})
    packages, links = identity.canonical_from_listing(listing)
    assert packages.first()["canonical_id"] == "com.a" and links.first()["confidence"] == 1.0
    leads = identity.outbound_leads(listing).withColumn("claimed_package_id", F.lit(None).cast("string"))
    assert rows(leads.select("kind")) == [("github_repository",), ("storefront_product",)]
    repo = _observed(spark, {"platform": "github", "url": "https://api.github.com/repos/o/r", "item_key": "github:1", "outbound_links": ["https://github.com/o/r/"]})
    assert rows(identity.repository_matches(repo, leads, links).select("canonical_id", "confidence", "review_state")) == [("com.a", 0.7, "provisional")]
    store = _observed(spark, {"platform": "booth", "url": "https://booth.pm/items/1", "item_key": "booth.pm/items/1", "price": 5.0}, {"platform": "booth", "url": "https://booth.pm/items/2", "item_key": "booth.pm/items/2", "title": "VRCX"})
    items = spark.createDataFrame([], "source_key string, source_url string")
    matches = identity.storefront_matches(store, items, leads, links)
    assert rows(matches.select("canonical_id")) == [("com.a",)]
    assert rows(identity.storefront_links(matches, links).select("confidence")) == [(0.8,)]
    own, _ = identity.storefront_bootstrap(store, matches)
    assert rows(own.select("canonical_id", "umbrella", "category")) == [("booth.pm/items/2", "tools", "companion_client")]
    fronts = identity.fronts_of(store, identity.storefront_links(matches, links))
    assert rows(fronts.select("canonical_id", "price", "availability")) == [("com.a", 5.0, "available")]
    assert identity.avatar_evidence(_observed(spark, {"platform": "booth", "url": "u", "item_key": "i", "title": "【桔梗】"})).first()["target_avatar_base"] == "kikyo"
    assert identity.desktop_evidence(store, identity.storefront_links(matches, links)).count() == 0


def test_gone(spark):
    fronts = spark.createDataFrame([("a", "s1", "available", "u1"), ("a", "s2", "available", "u2"), ("b", "s1", "available", "u3"), ("n", "s1", "available", "u4")], "canonical_id string, source_key string, availability string, storefront_url string")
    packages = spark.createDataFrame([("a", None, "active", T), ("b", None, "active", T), ("n", "com.n", "active", T)], "canonical_id string, vpm_id string, lifecycle string, updated_at timestamp")
    gone = spark.createDataFrame([("s1",)], "source_key string")
    left = lifecycle.delist_fronts(fronts, gone)
    assert rows(lifecycle.delist_packages(packages, left, gone, F.col("updated_at")).select("canonical_id", "lifecycle")) == [("a", "active"), ("b", "delisted"), ("n", "active")]
    takedowns = spark.createDataFrame([("a", None), (None, "u3")], "canonical_id string, target_url string")
    down = lifecycle.apply_takedowns(packages, fronts, takedowns, F.col("updated_at"))
    assert rows(down.select("canonical_id", "lifecycle")) == [("a", "delisted"), ("b", "delisted"), ("n", "active")]
    assert rows(lifecycle.reject_takedowns(down, fronts, takedowns, F.col("updated_at")).select("lifecycle")) == [("active",)] * 3


def test_jobs(spark):
    jobs = spark.createDataFrame([("j1", "leased", T, "l", T), ("j2", "pending", T, None, None)], "job_id string, state string, next_fetch_at timestamp, lease_id string, lease_expires_at timestamp")
    results = spark.createDataFrame([("j1", "rate_limited", T, 42)], "job_id string, outcome string, submitted_at timestamp, retry_after_seconds long")
    done = lifecycle.finish_jobs(jobs, results).orderBy("job_id").collect()
    assert (done[0]["state"], done[0]["next_fetch_at"], done[0]["lease_id"]) == ("backoff", datetime(2024, 1, 1, 0, 0, 42), None) and done[1]["state"] == "pending"
    released = lifecycle.release_leases(jobs.withColumn("lease_profile_id", F.lit("p")), spark.createDataFrame([("p",)], "lease_profile_id string"), "lease_profile_id")
    assert rows(released.select("state")) == [("pending",), ("pending",)]


def test_starvation(spark):
    """More than a hundred denied jobs don't hide an allowed one."""
    body = "User-agent: *\nDisallow: /no"
    names = "job_id string, url string, origin string, platform string, next_fetch_at timestamp, created_at timestamp, status_code int, body string, robots_expires_at timestamp, profile_id string, min_delay_ms long"
    eligible = spark.createDataFrame([(f"j{k:03d}", f"https://x/no/{k}", "https://x", "vpm", T, T, 200, body, T, "p", 1) for k in range(130)] + [("z", "https://x/yes", "https://x", "vpm", datetime(2025, 1, 1), T, 200, body, T, "p", 1)], names)
    nodes = spark.createDataFrame([("n1", ["vpm"]), ("n2", ["vpm"])], "node_id string, capabilities array<string>")
    granted, deferred = scheduling.grants(eligible, nodes, ("bot",))
    assert rows(granted.select("node_id", "job_id")) == [("n1", "z")] and deferred.count() == 130


def test_guards(spark):
    df = spark.createDataFrame([("k", "t" * 501, ""), ("", "t", ""), ("k", "t", None)], "source_item_key string, title string, summary string")
    good, bad = guards.guard(df, guards.observation_checks(df))
    assert good.count() == 1 and sorted(r["reject_code"] for r in bad.collect()) == ["source_item_key_bounds", "title_bounds"]
    obs = spark.createDataFrame([("l", "a"), ("l", "a"), ("m", "b")], "lease_id string, source_item_key string")
    assert rows(guards.duplicate_items(obs)) == [("l", 2, 1)]


def test_journal(spark):
    e = spark.createDataFrame([("r", "t1", "claimed", 1), ("r", "t1", "completed", 2), ("r", "t1", "failed", 3), ("r", "t2", "submitting", 1), ("r", "t2", "fetching", 2)], "run_id string, task_id string, state string, at int")
    assert rows(journal.task_states(e).select("task_id", "state")) == [("t1", "completed"), ("t2", "submitting")]
    assert rows(journal.run_totals(journal.task_states(e))) == [("r", 2, 1, 0)]


def test_feedback(spark):
    r = spark.createDataFrame([("a", "demand_signal", "q", True, "vpm", None, None, {"k": "v"}, T), ("a", "removal", None, None, None, "u", None, None, T), ("a", "broken_link", None, None, None, "u", None, None, T)], "app_id string, report_type string, query string, zero_hits boolean, requested_platform string, target_url string, category string, metadata map<string,string>, recorded_at timestamp")
    reports, signals = downstream.feedback(r)
    assert reports.count() == 3 and rows(signals.select("signal_type", "zero_hits")) == [("refresh_demand", False), ("search_miss", True)]


def test_robots_snapshots(spark):
    hops = spark.createDataFrame([("a", 0, 301, "https://b/robots.txt", None, None, T), ("a", 1, 200, None, "text/plain", "x", T), ("b", 0, 200, None, "text/html", "x", T), ("c", 0, 404, None, None, "y", T), ("d", 0, 301, "http://b", None, None, T), ("d", 1, 200, None, "text/plain", "x", T)], "origin string, hop int, status int, location string, content_type string, body string, at timestamp")
    assert rows(robots.snapshots(hops).select("origin", "status_code", "body")) == [("a", 200, "x"), ("b", 599, ""), ("c", 404, ""), ("d", 599, "")]


def test_schemas(spark):
    assert len(schemas.TABLES) == 35
    bad = spark.createDataFrame([("a", "weird", "x", "active", "d", None, T, T, None, None)], schemas.TABLES["canonical_packages"].schema)
    assert schemas.violations("canonical_packages", bad).first()["violation"] == "umbrella_domain"
    assert schemas.repeated_keys("canonical_packages", bad.union(bad)).count() == 1


def test_pacing():
    p = pacing.Pacing.of("booth.pm")
    assert p.delay_ms == 1850
    for k in range(3):
        p.step("booth.pm", k, "success", None)
    assert p.delay_ms == 1750
    p.step("booth.pm", 10, "limited", 999999999.0)
    assert p.backoff_until == 10 + 300_000 and p.delay_ms == 3150
    p.step("booth.pm", 20, "success", 5.0)
    assert p.limited == 1


def test_breaker():
    b = pacing.Breaker()
    for k in range(3):
        b.step("h", k, "failure", None)
    assert b.state == "OPEN" and b.open_until == 30_002
    b.step("h", 10, "failure", None)
    assert b.open_until == 30_002
    b.step("h", 30_002, "ask", None)
    assert b.state == "HALF_OPEN" and b.granted
    b.step("h", 30_003, "ask", None)
    assert not b.granted
    b.step("h", 30_004, "success", None)
    assert b.state == "CLOSED" and b.failures == 0


def test_fold_stream_equals_batch(spark, tmp_path):
    events = spark.createDataFrame([("booth.pm" if k % 3 else "itch.io", k, k * 1000, ("success", "failure", "limited")[k % 5 % 3], float(k)) for k in range(40)], "host string, seq long, at_ms long, kind string, value double")
    for k in range(2):
        events.filter(f"seq div 20 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = pacing.fold_stream(stream, pacing.Pacing).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(pacing.fold(events, pacing.Pacing))


def test_change_feed(spark):
    feed = delta.change_feed(_packages(spark), (datetime(2024, 1, 1), "a"))
    assert rows(feed.select("canonical_id", "change")) == [("b", "upsert"), ("c", "tombstone")]


def test_ordered_distinct(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")], "k string, pos int, v string")
    assert rows(paging.ordered_distinct(df, ["k"], "pos")) == [("a", 1, "z"), ("b", 2, "y")]


def test_seed_guards(spark):
    names = "url string, platform string, purpose string, origin string, min_delay_ms long, suppressed boolean, rule_id string, rule_expires_at timestamp, rule_disabled_at timestamp, job_platform string, job_purpose string"
    good = {"url": "https://a.example/x", "platform": "custom_domain", "purpose": "metadata", "origin": "https://a.example", "min_delay_ms": 1}
    cases = [({}, None), ({"url": "http://a.example/x"}, "not_https"), ({"url": "https://10.0.0.1/x"}, "not_public"), ({"url": "https://a.example/"}, "target_class"), ({"min_delay_ms": -1}, "delay"), ({"suppressed": True}, "suppressed"), ({"rule_id": "r", "rule_expires_at": T}, "rule_ended"), ({"job_platform": "booth", "job_purpose": "metadata"}, "contract")]
    rows_ = spark.createDataFrame([tuple((good | c).get(n.split()[0]) for n in names.split(", ")) for c, _ in cases], names)
    got = rows_.withColumn("r", guards.first_reason(guards.seed_checks(F.lit("2024-06-01").cast("timestamp")))).collect()
    assert [r["r"] for r in got] == [r for _, r in cases]
