"""The write path over the test tables: listings first, then repositories and storefronts that lead to them.

Jobs 0 to 23 are listings, repositories and storefronts in turn. A listing's items are the parts that fall to it; some lead to the
repository or the storefront behind their listing, and some have an issue.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import submission, upsert
from ..schemas import TABLES
from .registry import query, shared_path

_STATE = ("crawl_jobs", "source_items", "source_versions", "source_events", "source_issues", "source_leads", "canonical_packages", "identity_links", "package_fronts", "avatar_compatibilities", "desktop_tool_evidence", "job_results")
_START = datetime(2024, 1, 1)
_URL = "CASE n % 3 WHEN 0 THEN concat('https://l', n, '.example.com/index.json') WHEN 1 THEN concat('https://api.github.com/repos/o/r', n) ELSE concat('https://booth.pm/ja/items/', 1000 + n) END"
_PLATFORM = "CASE n % 3 WHEN 0 THEN 'vpm' WHEN 1 THEN 'github' ELSE 'booth' END"
_JOBS = f"job AS (SELECT n, concat('job-', n) AS job_id, {_PLATFORM} AS platform, {_URL} AS url FROM range(24) t(n))"
_ITEMS = _JOBS + ", item AS (SELECT p_partkey AS k, p_name AS title, 'com.p' || p_partkey AS item_key, j.*, 'vpm:' || j.url || ':com.p' || p_partkey AS source_key, p_partkey % 11 <> 0 AS complete FROM part JOIN job j ON j.n = p_partkey % 24 AND j.platform = 'vpm')"
#: What the second batch finds: the packages whose listing leads to a repository or a storefront.
_MATCHES = _ITEMS + """, match AS (
  SELECT 'github:' || j.url || ':r' || j.n AS source_key, i.item_key AS canonical_id, 'repository' AS evidence_kind, 0.7 AS confidence, 'provisional' AS review_state, j.n FROM job j JOIN item i ON i.n = j.n - 1 AND i.k % 5 = 0 AND i.complete WHERE j.platform = 'github'
  UNION ALL SELECT 'booth:' || j.url || ':' || substr(j.url, 9), i.item_key, 'storefront', 0.8, 'provisional', j.n FROM job j JOIN item i ON i.n = j.n - 2 AND i.k % 7 = 0 AND i.complete WHERE j.platform = 'booth'
), alone AS (SELECT 'booth:' || url || ':' || substr(url, 9) AS source_key, substr(url, 9) AS canonical_id, n FROM job WHERE platform = 'booth' AND n NOT IN (SELECT n FROM match)),
link AS (SELECT source_key, canonical_id, evidence_kind, confidence, review_state FROM match UNION ALL SELECT source_key, canonical_id, 'storefront', 1.0, 'accepted' FROM alone UNION ALL SELECT source_key, item_key, 'vpm_id', 1.0, 'accepted' FROM item WHERE complete)"""


def _results(spark: SparkSession, wanted: str) -> DataFrame:
    rows = spark.range(24).withColumnRenamed("id", "n").filter(wanted)
    at = F.lit(_START).cast("timestamp") + F.make_interval(hours=F.col("n").cast("int"))
    return rows.select(F.expr("concat('lease-', n)").alias("lease_id"), F.expr("concat('job-', n)").alias("job_id"), F.lit("node").alias("node_id"), F.expr("concat('k-', n)").alias("idempotency_key"), F.expr("concat('d-', n)").alias("request_digest"), at.alias("submitted_at"), F.when(F.col("n") % 3 == 0, "partial_batch").otherwise("changed").alias("outcome"), F.lit(None).cast("long").alias("retry_after_seconds"))


def _facts(rows: DataFrame) -> DataFrame:
    """Observations with all their columns: lease_id, position, item_key, title, outbound_links and price are the rows' own."""
    none = {c: F.lit(None).cast("string") for c in ("currency", "availability", "storefront_url", "release_json")}
    return rows.select("lease_id", "position", "item_key", "title", F.lit("author").alias("author"), F.lit("").alias("summary"), "outbound_links", F.array().cast("array<string>").alias("platform_tags"), F.col("price").cast("double").alias("price"), *[v.alias(k) for k, v in none.items()])


def _listed(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The state after the listings' batch."""
    state = {t: spark.createDataFrame([], TABLES[t].schema) for t in _STATE}
    own = spark.range(24).selectExpr("id AS n").select(F.expr("concat('job-', n)").alias("job_id"), F.expr(_PLATFORM).alias("platform"), F.expr(_URL).alias("url"), F.lit("leased").alias("state"), F.lit(_START).cast("timestamp").alias("next_fetch_at"))
    state["crawl_jobs"] = submission._fit("crawl_jobs", own)
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey AS k", "p_partkey % 24 AS n", "p_name AS title").filter("n % 3 = 0")
    links = F.filter(F.array(F.expr("CASE WHEN k % 5 = 0 THEN concat('https://github.com/O/R', n + 1, '.git') END"), F.expr("CASE WHEN k % 7 = 0 THEN concat('https://booth.pm/ja/items/', 1000 + n + 2) END")), lambda x: x.isNotNull())
    seen = _facts(parts.select(F.expr("concat('lease-', n)").alias("lease_id"), F.col("k").alias("position"), F.expr("concat('com.p', k)").alias("item_key"), "title", links.alias("outbound_links"), F.lit(None).alias("price")))
    issues = parts.filter("k % 11 = 0").select(F.expr("concat('lease-', n)").alias("lease_id"), F.expr("concat('com.p', k)").alias("source_item_key"), F.lit("1.0.0").alias("version"), F.lit("invalid_manifest").alias("code"))
    return submission.apply_batch(state, _results(spark, "n % 3 = 0"), seen, issues, _no_leads(spark), upsert.stager(shared_path(spark, "batch")))


def _no_leads(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "lease_id string, kind string, url string, claimed_package_id string")


def _matched(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The state after the repositories' and storefronts' batch."""
    stage = upsert.stager(shared_path(spark, "batch"))
    state = {t: stage(f, t) for t, f in _listed(spark, sf_dir).items()}
    jobs = spark.range(24).selectExpr("id AS n").filter("n % 3 <> 0")
    item = F.expr("CASE WHEN n % 3 = 1 THEN concat('r', n) ELSE concat('booth.pm/ja/items/', 1000 + n) END")
    links = F.filter(F.array(F.expr("CASE WHEN n % 3 = 1 THEN concat('https://github.com/o/r', n) END")), lambda x: x.isNotNull())
    seen = _facts(jobs.select(F.expr("concat('lease-', n)").alias("lease_id"), F.lit(0).cast("long").alias("position"), item.alias("item_key"), F.lit("Hat").alias("title"), links.alias("outbound_links"), F.expr("CASE WHEN n % 3 = 2 THEN n END").alias("price")))
    none = spark.createDataFrame([], "lease_id string, source_item_key string, version string, code string")
    return submission.apply_batch(state, _results(spark, "n % 3 <> 0"), seen, none, _no_leads(spark), stage)


@query(f"WITH {_MATCHES} SELECT item_key AS canonical_id, 'tools' AS umbrella, 'vpm_package' AS category, 'active' AS lifecycle, title AS display_name, item_key AS vpm_id FROM item WHERE complete UNION ALL SELECT canonical_id, 'assets', 'storefront_product', 'active', 'Hat', NULL FROM alone")
def batch_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages after both batches: of complete listings, and of storefronts that match nothing (D-2, D-6)."""
    return _matched(spark, sf_dir)["canonical_packages"].select("canonical_id", "umbrella", "category", "lifecycle", "display_name", "vpm_id")


@query(f"WITH {_MATCHES} SELECT source_key, canonical_id, evidence_kind, CAST(confidence AS DOUBLE) AS confidence, review_state FROM link")
def batch_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity links after both batches (D-2, D-4, D-5, D-6)."""
    return _matched(spark, sf_dir)["identity_links"].select("source_key", "canonical_id", "evidence_kind", "confidence", "review_state")


@query(f"WITH {_MATCHES} SELECT canonical_id, source_key, 'booth' AS platform, CAST(n AS DOUBLE) AS price, 'available' AS availability FROM (SELECT canonical_id, source_key, n FROM match WHERE evidence_kind = 'storefront' UNION ALL SELECT canonical_id, source_key, n FROM alone)")
def batch_fronts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fronts of the storefronts that links join to packages (D-7)."""
    return _matched(spark, sf_dir)["package_fronts"].select("canonical_id", "source_key", "platform", "price", "availability")


@query(f"""WITH {_ITEMS} SELECT url AS discovered_from_url, item_key, 'github_repository' AS kind, 'https://github.com/O/R' || (n + 1) || '.git' AS target_url FROM item WHERE k % 5 = 0
UNION ALL SELECT url, item_key, 'storefront_product', 'https://booth.pm/ja/items/' || (1002 + n) FROM item WHERE k % 7 = 0""")
def batch_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads of the listings' outbound links (D-3)."""
    return _listed(spark, sf_dir)["source_leads"].select("discovered_from_url", F.col("discovered_from_item_key").alias("item_key"), "kind", "target_url")


@query(f"WITH {_ITEMS} SELECT source_key, 1 AS version_no, complete, TIMESTAMP '2024-01-01' + to_hours(CAST(n AS INT)) AS observed_at FROM item")
def batch_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of the listings' items; those with an issue are incomplete (D-1)."""
    return _listed(spark, sf_dir)["source_versions"].select("source_key", F.col("version_no").cast("int").alias("version_no"), "complete", F.col("observed_at").cast("timestamp_ntz").alias("observed_at"))


@query(f"WITH {_JOBS} SELECT job_id, CASE WHEN n % 3 = 0 THEN 'done' ELSE 'leased' END AS state, TIMESTAMP '2024-01-01' + to_hours(CAST(CASE WHEN n % 3 = 0 THEN n + 24 ELSE 0 END AS INT)) AS next_fetch_at FROM job")
def batch_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs after the listings' batch (D-12, F-33)."""
    return _listed(spark, sf_dir)["crawl_jobs"].select("job_id", "state", F.col("next_fetch_at").cast("timestamp_ntz").alias("next_fetch_at"))


@query(f"WITH {_ITEMS} SELECT job_id, item_key AS source_item_key, 'invalid_manifest' AS code FROM item WHERE NOT complete")
def batch_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of the listings' batch (D-11)."""
    return _listed(spark, sf_dir)["source_issues"].select("job_id", "source_item_key", "code")
