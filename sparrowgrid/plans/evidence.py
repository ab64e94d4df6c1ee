"""URL shapes, formats, digests, cursors and writes over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs, hashing, policy, urls
from ..operators import downstream, lifecycle, paging, scheduling, upsert
from ..sources import adapters as a
from ..sources import seeds
from .registry import query

_NOW = f"TIMESTAMP '{a.NOW}'"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: URLs of every shape that the predicates tell apart, by part; the same expression in both dialects.
_SHAPES = (
    "concat('https://api.github.com/repos/o', k, '/r.', k)", "concat('https://api.github.com/repos/-o/r', k)", "concat('https://booth.pm/ja/browse/tools?page=', k % 1000)",
    "concat('https://booth.pm/en/browse/..?page=', k)", "concat('https://booth.pm/ja/items/', k, '/')", "concat('https://booth.pm/items/0', k)", "concat('https://shop', k, '.example.com/sitemap_products_', k, '.xml?from=', k, '&to=', k)",
    "concat('https://shop.example.com/en-us/products/hat-', k)", "concat('https://shop.example.com/collections/', k)", "concat('https://Sellfy.com/store', k, '/p/i', k, '/')", "concat('https://itch.io/search?q=', k)",
    "concat('http://localhost:8787/x/', k)", "concat('https://user@host', k, '.example.com/a#f')", "concat('https://github.com/Own', k, '/Name.git')", "concat('https://host', k, '.example.com')",
)
_CASE = "CASE k % {} {} END".format(len(_SHAPES), " ".join(f"WHEN {j} THEN {x}" for j, x in enumerate(_SHAPES)))
_SHAPED = f"shaped AS (SELECT k, {_CASE} AS url FROM (SELECT p_partkey AS k FROM part))"


def _shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).select("k", F.expr(_CASE).alias("url"))


@query(rf"""WITH {_SHAPED} SELECT k, url,
  CASE WHEN regexp_matches(url, '^https://api\.github\.com/repos/[A-Za-z0-9][A-Za-z0-9-]{{0,38}}/[A-Za-z0-9_.-]{{1,100}}$') AND NOT regexp_matches(url, '/\.\.?$') THEN substr(url, 30) END AS repository,
  regexp_matches(url, '^https://booth\.pm/(?:ja|en)/browse/[A-Za-z0-9._~%-]+\?page=[1-9][0-9]{{0,2}}$') AND NOT regexp_matches(url, '/browse/\.{{1,2}}\?') AS browse,
  nullif(regexp_extract(url, '^https://booth\.pm/(?:ja/|en/)?items/([1-9][0-9]{{0,17}})/?$', 1), '') AS item,
  regexp_matches(url, '^https://[a-z0-9.-]+/sitemap_products_[1-9][0-9]*\.xml(?:\?from=[1-9][0-9]*&to=[1-9][0-9]*)?$') AS sitemap,
  CASE WHEN regexp_matches(url, '^https://shop\.example\.com/(?:[a-z]{{2}}(?:-[a-z]{{2}})?/)?products/[a-z0-9][a-z0-9-]*$') THEN url END AS product,
  CASE WHEN regexp_matches(url, '^https://[A-Za-z0-9.-]+(?:/[A-Za-z0-9_.-]+)?/p/[A-Za-z0-9_.-]+/?$') THEN lower(split_part(url, '/', 3)) || ':' || split_part(url, '/', 4) || ':' || split_part(url, '/', 6) END AS sellfy,
  regexp_matches(url, '^https://[^/:@?#]+/[^?#]+$') AS custom, regexp_matches(url, '^https?://itch\.io/search') AS itch FROM shaped""")
def url_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a URL is by its shape (P-7, P-8, P-9, P-10, P-11, P-12)."""
    u = F.col("url")
    return _shaped(spark, sf_dir).select(
        "k", "url", urls.github_repository(u).alias("repository"), urls.is_booth_browse(u).alias("browse"), urls.booth_item(u).alias("item"), urls.is_shopify_sitemap(u).alias("sitemap"),
        urls.shopify_product(u, F.lit("https://shop.example.com")).alias("product"), urls.sellfy_product(u).alias("sellfy"), urls.is_custom_product(u).alias("custom"), urls.is_itch_search(u).alias("itch"),
    )


@query(rf"""WITH {_SHAPED} SELECT k, regexp_matches(url, '^https://[^/:@?#]+(?::443)?(?:[/?][^#]*)?$') AND NOT regexp_matches(url, '^https://localhost(?:[:/?]|$)') AS safe,
  regexp_matches(url, '^https://[^/]') OR regexp_matches(url, '^http://(?:localhost|127\.0\.0\.1|\[::1\])(?:[:/]|$)') AS endpoint,
  regexp_replace(url, '(?i)^https://github\.com/([^/]+)/([^/?#]+?)(?:\.git)?/?$', 'https://api.github.com/repos/\1/\2') AS api_url,
  regexp_extract(url, '^([^:]+://[^/?#]+)', 1) || rtrim(regexp_extract(url, '^[^:]+://[^/?#]+([^?#]*)', 1), '/') || '/v1/claims' AS joined,
  k % 700 BETWEEN 502 AND 504 OR k % 700 BETWEEN 520 AND 524 AS transient FROM shaped""")
def url_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redirect targets, endpoints and rewrites (P-20, P-21, F-20, F-37)."""
    u = F.col("url")
    return _shaped(spark, sf_dir).select("k", urls.is_safe_redirect(u).alias("safe"), policy.is_coordinator_endpoint(u).alias("endpoint"), urls.github_api_url(u).alias("api_url"), urls.join_endpoint(u, F.lit("//v1/claims")).alias("joined"), policy.is_transient_status(F.col("k") % 700).alias("transient"))


_TOKENS = "CASE k % 6 WHEN 0 THEN concat('vrcp_app_', h) WHEN 1 THEN concat('vrcp_usr_', h) WHEN 2 THEN concat('vrcp_', h, '0fA9') WHEN 3 THEN upper(h) WHEN 4 THEN concat('vrcp_app_', upper(h)) ELSE concat(k % 300, '.0.0.', k % 7, CASE WHEN k % 4 = 0 THEN ':' ELSE '' END) END"


@query(rf"""WITH made AS (SELECT k, {_TOKENS} AS token FROM (SELECT p_partkey AS k, sha256(CAST(p_partkey AS VARCHAR)) AS h FROM part))
SELECT k, CASE WHEN regexp_matches(token, '^vrcp_app_[a-f0-9]{{64}}$') THEN 'app' WHEN regexp_matches(token, '^vrcp_usr_[a-f0-9]{{64}}$') THEN 'user' WHEN regexp_matches(token, '^vrcp_[0-9a-fA-F]{{68}}$') THEN 'node' WHEN regexp_matches(token, '^[0-9a-fA-F]{{64}}$') THEN 'operator' END AS kind,
  regexp_matches(token, '^[0-9]{{1,3}}(\.[0-9]{{1,3}}){{3}}$') OR contains(token, ':') AS ip, sha256(token) AS digest, 'booth:' || token || ':' || k AS source_key FROM made""")
def token_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of credentials, addresses, digests and source keys (P-14, P-18, F-24, F-32)."""
    made = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.sha2(F.col("p_partkey").cast("string"), 256).alias("h")).select("k", F.expr(_TOKENS).alias("token"))
    token = F.col("token")
    return made.select("k", codecs.token_kind(token).alias("kind"), policy.is_ip(token).alias("ip"), hashing.sha256(token).alias("digest"), hashing.source_key(F.lit("booth"), token, F.col("k").cast("string")).alias("source_key"))


_PATHS = "CASE k % 5 WHEN 0 THEN '/a/' WHEN 1 THEN '/a/b' WHEN 2 THEN '/a/%E3' WHEN 3 THEN '/' ELSE '/a/b/' END"


@query(f"""WITH s AS (SELECT p_partkey AS k, {_PATHS.replace('k % 5', 'p_partkey % 5')} AS a, {_PATHS.replace('k % 5', '(p_partkey // 5) % 5')} AS b, CASE WHEN p_partkey % 3 = 0 THEN 'q=1' END AS q, CASE WHEN p_partkey % 7 = 0 THEN 'q=1' WHEN p_partkey % 7 = 1 THEN '' END AS r FROM part)
SELECT k, coalesce(q, '') = coalesce(r, '') AND (a = b OR (NOT contains(a, '%') AND NOT contains(b, '%') AND ((ends_with(a, '/') AND starts_with(b, a)) OR (ends_with(b, '/') AND starts_with(a, b))))) AS overlap,
  CASE WHEN k % 2 = 0 THEN NOT (k % 3 = 0 AND k % 5 = 0) ELSE k % 3 <> 0 AND k % 5 <> 0 END AS matches FROM s""")
def scopes_and_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping scopes, and evidence that fits its platform (P-3, P-5)."""
    rows = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).select("k", F.expr(_PATHS).alias("a"), F.expr(_PATHS.replace("k % 5", "(k div 5) % 5")).alias("b"), F.expr("case when k % 3 = 0 then 'q=1' end").alias("q"), F.expr("case when k % 7 = 0 then 'q=1' when k % 7 = 1 then '' end").alias("r"))
    release, releases = F.expr("case when k % 3 = 0 then 'r' end"), F.expr("case when k % 5 = 0 then 'rs' end")
    return rows.select("k", policy.scopes_overlap(F.col("a"), F.col("q"), F.col("b"), F.col("r")).alias("overlap"), policy.observation_matches(F.expr("case when k % 2 = 0 then 'vpm' else 'booth' end"), release, releases).alias("matches"))


@query("""SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%dT00:00:00.000Z') AS normal, epoch_ms(o_orderdate) + CASE WHEN o_orderkey % 600 BETWEEN 200 AND 299 OR o_orderkey % 600 IN (404, 410) THEN 86400000 ELSE 3600000 END AS expires,
  CAST(least(250 * power(2, o_orderkey % 6), 2000) AS BIGINT) AS retry_ms, CASE o_orderkey % 4 WHEN 0 THEN 'booth.pm' WHEN 1 THEN 'gumroad.com' WHEN 2 THEN 'shop' || o_orderkey || '.example.com' ELSE 'plain' END AS host FROM orders""")
def times_and_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as ISO text, expiries, waits and paced hosts (F-28, F-34, F-35, F-38, T-8)."""
    k, at = F.col("o_orderkey"), F.col("o_orderdate")
    form = F.when(k % 3 == 0, F.date_format(at, "yyyy-MM-dd")).when(k % 3 == 1, F.date_format(at, "yyyy/MM/dd")).otherwise(F.date_format(at, "MMM d, yyyy"))
    host = F.when(k % 4 == 0, " BOOTH ").when(k % 4 == 1, F.concat(F.lit("gumroad:"), k.cast("string"))).when(k % 4 == 2, F.concat(F.lit("https://Shop"), k.cast("string"), F.lit(".example.com:443/x"))).otherwise("plain")
    return _t(spark, sf_dir, "orders").select(k.alias("k"), policy.normalized_date(form).alias("normal"), F.unix_millis(policy.robots_expiry(k % 600, at.cast("timestamp"))).alias("expires"), policy.client_retry_ms(k % 6 + 1).alias("retry_ms"), policy.normal_host(host).alias("host"))


# ---- Writes


@query("""SELECT compat_id, arg_max(k, k) AS evidence, arg_max(p_type, k) AS detail FROM (SELECT p_brand || ':' || (p_size % 5) AS compat_id, p_partkey AS k, p_type FROM part) GROUP BY 1""")
def insert_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence rows inserted or replaced by their key (W-6)."""
    rows = _t(spark, sf_dir, "part").select(F.expr("concat(p_brand, ':', p_size % 5)").alias("compat_id"), F.col("p_partkey").alias("evidence"), F.col("p_type").alias("detail"))
    return upsert.upsert(rows.filter("evidence <= 50"), rows.filter("evidence > 50"), ["compat_id"], [F.col("evidence")])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def insert_with_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that an authority lets in (W-7)."""
    return upsert.insert_where(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), _t(spark, sf_dir, "customer").filter("c_acctbal > 0").withColumnRenamed("c_custkey", "o_custkey"), ["o_custkey"])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_custkey % 10 = 3 THEN 'leased' ELSE o_orderstatus END AS state FROM orders")
def guarded_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that change only where they are still eligible (W-8)."""
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("state"))
    return upsert.guarded_update(rows, rows.filter("state = 'O' and o_custkey % 10 = 3"), ["o_orderkey"], {"state": F.lit("leased")}).select("o_orderkey", "state")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def cascade_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children whose parents stay (W-11)."""
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    _, left = upsert.delete_cascade(orders, {"lines": (_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"])}, orders.filter("o_orderpriority = '1-URGENT'"), ["o_orderkey"])
    return left["lines"]


@query("""SELECT n_name AS url, n_regionkey AS k FROM nation WHERE n_name NOT IN (SELECT n_name FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT n_name FROM nation WHERE n_nationkey % 5 = 0)""")
def unknown_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds that neither a job nor a suppression knows (J-14)."""
    rows = _t(spark, sf_dir, "nation").select(F.col("n_name").alias("url"), F.col("n_regionkey").alias("k"), "n_nationkey")
    return seeds.new_seeds(rows.select("url", "k"), rows.filter("n_nationkey % 3 = 0"), rows.filter("n_nationkey % 5 = 0"))


@query("""SELECT c_custkey AS app_id FROM customer c JOIN nation n ON c_nationkey = n_nationkey WHERE c_acctbal >= 0 AND n_name = (SELECT min(n_name) FROM nation WHERE n_nationkey = 7) ORDER BY c_custkey LIMIT 51""")
def owned_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's live applications through their ownership (J-11, O-3)."""
    customers = _t(spark, sf_dir, "customer")
    apps = customers.select(F.col("c_custkey").alias("app_id"), F.col("c_custkey").alias("created_at"), F.expr("case when c_acctbal < 0 then 'gone' end").alias("revoked_at"))
    ownership = customers.select(F.col("c_custkey").alias("app_id"), F.concat(F.lit("user-"), "c_nationkey").alias("user_id"))
    users = _t(spark, sf_dir, "nation").select(F.concat(F.lit("user-"), "n_nationkey").alias("user_id"), F.lit(None).cast("string").alias("revoked_at"))
    return downstream.owned_apps(apps, ownership, users, "user-7").select("app_id")


@query(f"""WITH {a.NATIONS} SELECT w.origin, r.status_code, r.expires_at > {_NOW} AS live FROM (VALUES ('https://origin3.example.com'), ('https://nowhere.example.com')) w(origin) LEFT JOIN robot r ON r.origin = w.origin""")
def origin_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of origins that are asked for: a row for each, known or not (J-17)."""
    asked = spark.createDataFrame([("https://origin3.example.com",), ("https://nowhere.example.com",)], "origin string")
    return scheduling.probe(asked, a.robots(spark, sf_dir), F.lit(a.NOW).cast("timestamp_ntz")).select("origin", "status_code", "live")


@query("SELECT p_brand, min(p_partkey) AS place, arg_max(p_name, p_partkey) AS name FROM part GROUP BY p_brand")
def first_place_last_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys at their first place with their last value (O-12)."""
    return paging.ordered_distinct(_t(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("place"), F.col("p_name").alias("name")), ["p_brand"], "place")


@query("""SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 3 = 0 THEN CASE o_orderkey % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'blocked' ELSE 'backoff' END ELSE 'leased' END AS state,
  o_orderdate + to_seconds(CASE WHEN o_orderkey % 3 <> 0 THEN 0 ELSE CASE o_orderkey % 4 WHEN 0 THEN 86400 WHEN 1 THEN 3 * 86400 WHEN 2 THEN 42 ELSE 900 END END) AS next_fetch_at, CASE WHEN o_orderkey % 3 <> 0 THEN 'lease' END AS lease_id FROM orders""")
def job_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs after their results (D-12)."""
    orders = _t(spark, sf_dir, "orders")
    at = F.col("o_orderdate")
    jobs = orders.select(F.col("o_orderkey").alias("job_id"), F.lit("leased").alias("state"), at.cast("timestamp").alias("next_fetch_at"), F.lit("lease").alias("lease_id"), at.alias("lease_expires_at"))
    outcome = F.expr("case o_orderkey % 4 when 0 then 'changed' when 1 then 'blocked' when 2 then 'rate_limited' else 'temporary_failure' end")
    results = orders.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("job_id"), outcome.alias("outcome"), at.cast("timestamp").alias("submitted_at"), F.lit(42).cast("long").alias("retry_after_seconds"))
    return lifecycle.finish_jobs(jobs, results).select("job_id", "state", F.col("next_fetch_at").cast("timestamp_ntz").alias("next_fetch_at"), "lease_id")


@query("""SELECT o_orderkey AS job_id, 'item-' || i AS source_item_key, 'bad' AS code FROM orders, (VALUES (0), (1)) t(i) WHERE o_orderkey % 4 = 1""")
def result_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each issue of partial results (D-11)."""
    issue = lambda k: F.struct(F.lit(f"item-{k}").alias("source_item_key"), F.lit("1.0.0").alias("version"), F.lit("bad").alias("code"))
    results = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.expr("case when o_orderkey % 4 = 1 then 'partial_batch' else 'changed' end").alias("outcome"), F.col("o_orderdate").alias("submitted_at"), F.array(issue(0), issue(1)).alias("issues"))
    return lifecycle.issue_rows(results).select("job_id", "source_item_key", "code")


@query("SELECT o_orderkey AS job_id, CASE o_orderkey % 3 WHEN 0 THEN 'gone' ELSE 'unchanged' END AS kind FROM orders WHERE o_orderkey % 3 < 2")
def result_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of results without an observation (D-11)."""
    results = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.expr("case o_orderkey % 3 when 0 then 'gone' when 1 then 'unchanged' else 'batch' end").alias("outcome"), F.col("o_orderdate").alias("submitted_at"))
    return lifecycle.lifecycle_events(results).select("job_id", "kind")


@query("SELECT o_orderkey AS job_id, CASE WHEN o_custkey % 9 = 2 AND o_orderstatus = 'O' THEN 'pending' WHEN o_orderstatus = 'O' THEN 'leased' ELSE 'done' END AS state, CASE WHEN o_custkey % 9 = 2 AND o_orderstatus = 'O' THEN NULL ELSE 'lease' END AS lease_id FROM orders")
def disabled_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leased jobs under disabled profiles become pending (D-24)."""
    jobs = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.expr("case when o_orderstatus = 'O' then 'leased' else 'done' end").alias("state"), F.lit("lease").alias("lease_id"), (F.col("o_custkey") % 9).alias("lease_profile_id"))
    disabled = spark.createDataFrame([(2,)], "lease_profile_id long")
    return lifecycle.release_leases(jobs, disabled, "lease_profile_id").select("job_id", "state", "lease_id")


_KIND = "CASE event_id % 3 WHEN 0 THEN 'demand_signal' WHEN 1 THEN 'removal' ELSE 'stale' END"


@query(f"SELECT event_id % 50 AS app, CASE event_id % 3 WHEN 0 THEN 'search_miss' ELSE 'refresh_demand' END AS signal_type, event_type AS query, count(*) AS n FROM events WHERE {_KIND} <> 'removal' GROUP BY ALL")
def feedback_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demand signals that reports make (D-25)."""
    none = F.lit(None).cast("string")
    reports = _t(spark, sf_dir, "events").select(F.expr("event_id % 50").alias("app_id"), F.expr(_KIND).alias("report_type"), F.col("event_type").alias("query"), F.lit(True).alias("zero_hits"), none.alias("requested_platform"), F.col("event_id").cast("string").alias("target_url"), none.alias("category"), F.create_map(F.lit("a"), F.lit("b")).alias("metadata"), F.col("ts").cast("timestamp").alias("recorded_at"))
    _, signals = downstream.feedback(reports)
    return signals.groupBy(F.col("app_id").alias("app"), "signal_type", "query").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id AS beat, user_id AS node_id FROM events WHERE event_id % 2 = 0 OR (event_id % 40 IN (1, 3, 5, 7, 9) AND user_id % 40 = event_id % 40)")
def stored_heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heartbeats of idle nodes, and of nodes that hold the lease they name, while it lasts (D-27, T-7)."""
    beats = _t(spark, sf_dir, "events").select(F.col("event_id").alias("beat"), F.col("user_id").alias("node_id"), F.expr("case when event_id % 2 = 0 then 'idle' else 'fetching' end").alias("state"), F.expr("concat('job-', event_id % 40)").alias("active_job_id"))
    holders = _t(spark, sf_dir, "events").select("user_id").distinct()
    now = F.lit(a.NOW).cast("timestamp_ntz")
    jobs = holders.select(F.expr("concat('job-', user_id % 40)").alias("job_id"), F.lit("leased").alias("state"), F.col("user_id").alias("claimed_by"), F.when(F.col("user_id") % 40 < 10, now + F.expr("interval 1 minute")).otherwise(now).alias("lease_expires_at"))
    return scheduling.heartbeat_rows(beats, jobs, now).select("beat", "node_id")


@query("SELECT l_orderkey AS origin_key, max(l_linenumber) AS n, bool_or(l_linenumber % 2 = 0) AS kept FROM lineitem GROUP BY l_orderkey HAVING l_orderkey % 4 = 1")
def undeferred_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs whose origin has a new robots snapshot lose their deferral (D-17); by origin how many jobs there are, and whether any is deferred still."""
    jobs = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("origin"), "l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, F.lit("later")).alias("robots_deferred_until"))
    left = scheduling.undefer(jobs, jobs.filter("origin % 4 <> 1").select("origin"))
    return left.filter("origin % 4 = 1 or robots_deferred_until is not null").groupBy(F.col("origin").alias("origin_key")).agg(F.max("l_linenumber").alias("n"), F.expr("bool_or(robots_deferred_until is not null)").alias("kept"))
