"""Claims, robots refreshes, profiles, workforce, pacing floors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs
from ..functions.policy import PLATFORMS, profile_matches
from ..operators import scheduling, upsert
from ..sources import adapters as a
from .registry import query

_NOW = f"TIMESTAMP '{a.NOW}'"


def _now() -> F.Column:
    return F.lit(a.NOW).cast("timestamp_ntz")


_ELIGIBLE = f"""WITH {a.JOBS}, {a.NATIONS}, {a.REFRESHES}, suppressed AS (SELECT url FROM job WHERE job_id LIKE '%99'), due AS (
  SELECT j.*, r.status_code, r.denied, r.expires_at AS robots_expires_at, o.min_delay_ms AS pace FROM job j JOIN origin o USING (origin) JOIN robot r USING (origin)
  WHERE j.next_fetch_at <= {_NOW} AND (j.state IN ('pending', 'backoff', 'done', 'blocked') OR (j.state = 'leased' AND j.lease_expires_at <= {_NOW}))
    AND (j.robots_deferred_until IS NULL OR j.robots_deferred_until <= {_NOW}) AND j.platform IN ('booth', 'vpm', 'github', 'itch')
    AND o.next_allowed_at <= {_NOW} AND (o.active_job_id IS NULL OR o.origin_lease_expires_at <= {_NOW}) AND r.expires_at > {_NOW}
    AND NOT EXISTS (SELECT 1 FROM refresh f WHERE f.origin = j.origin AND f.refresh_expires_at > {_NOW}) AND NOT EXISTS (SELECT 1 FROM suppressed s WHERE s.url = j.url)
), covered AS (
  SELECT d.*, p.profile_id, row_number() OVER (PARTITION BY d.job_id ORDER BY length(p.path_scope) DESC, p.profile_id) AS k
  FROM due d JOIN profile p ON p.platform = d.platform AND p.purpose = d.job_purpose AND p.origin = d.origin AND p.expires_at > {_NOW} AND starts_with(d.url, p.origin || p.path_scope)
), eligible AS (SELECT * FROM covered WHERE k = 1)
"""


def _eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = a.jobs(spark, sf_dir).drop("min_delay_ms")
    suppressed = jobs.filter("job_id like '%99'").select("url")
    return scheduling.eligible_jobs(jobs, a.origins(spark, sf_dir), a.robots(spark, sf_dir), a.held_refreshes(spark, sf_dir), a.profiles(spark, sf_dir), suppressed, _now(), ("booth", "vpm", "github", "itch"))


@query(_ELIGIBLE + "SELECT job_id, platform, origin, profile_id FROM eligible")
def claim_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Due jobs that nothing forbids, with their profile (D-15, J-1 to J-6, O-1)."""
    return _eligible(spark, sf_dir).select("job_id", "platform", "origin", "profile_id")


_NODES = """, node AS (SELECT 'node-' || n AS node_id, CASE WHEN n % 2 = 0 THEN ['booth', 'vpm'] ELSE ['github', 'itch', 'booth'] END AS platforms, row_number() OVER (ORDER BY 'node-' || n) AS n FROM range(12) t(n)),
offer AS (SELECT *, row_number() OVER (ORDER BY next_fetch_at, created_at, job_id) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY origin ORDER BY next_fetch_at, created_at, job_id) AS o FROM eligible WHERE status_code BETWEEN 200 AND 299 AND NOT (denied IS NOT NULL AND contains(url, '.example.com' || denied))) WHERE o = 1),
claim(n, taken) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT c.n + 1, list_append(c.taken, list_min(list_filter(o.places, lambda x: NOT list_contains(c.taken, x)))) FROM claim c JOIN node d ON d.n = c.n + 1 JOIN (
    SELECT d.n, coalesce(list(f.place) FILTER (WHERE f.place IS NOT NULL), []) AS places FROM node d LEFT JOIN offer f ON list_contains(d.platforms, f.platform) GROUP BY d.n) o ON o.n = c.n + 1)
SELECT d.node_id, f.job_id, f.origin, f.platform FROM (SELECT max(n) AS n, arg_max(taken, n) AS taken FROM claim) c JOIN node d ON true JOIN offer f ON f.place = c.taken[d.n]"""


@query(_ELIGIBLE.rstrip().replace("WITH", "WITH RECURSIVE", 1) + _NODES)
def claim_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A round's grants (O-2, P-16): one job for each origin, one for each node."""
    nodes = spark.range(12).selectExpr("concat('node-', id) as node_id", "case when id % 2 = 0 then array('booth', 'vpm') else array('github', 'itch', 'booth') end as capabilities")
    granted, _ = scheduling.grants(_eligible(spark, sf_dir), nodes, ("SparrowgridBot", "SparrowgridCatalog"))
    return granted.select("node_id", "job_id", "origin", "platform")


@query(f"""WITH {a.JOBS}, {a.NATIONS}, {a.REFRESHES} SELECT origin, max(min_delay_ms) AS min_delay_ms, strftime(min(next_fetch_at), '%Y-%m-%dT%H:%M:%S.%gZ') AS first_due_at FROM job j
WHERE state IN ('pending', 'backoff', 'done') AND next_fetch_at <= {_NOW} AND NOT EXISTS (SELECT 1 FROM robot r WHERE r.origin = j.origin AND r.expires_at > {_NOW}) AND NOT EXISTS (SELECT 1 FROM refresh f WHERE f.origin = j.origin AND f.refresh_expires_at > {_NOW}) GROUP BY origin""")
def robots_refresh_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Origins whose robots file has to be fetched (D-16, A-6)."""
    due = scheduling.robots_due(a.jobs(spark, sf_dir), a.robots(spark, sf_dir), a.held_refreshes(spark, sf_dir), _now())
    return due.select("origin", "min_delay_ms", a.iso("first_due_at").alias("first_due_at"))


@query(f"""WITH {a.JOBS}, {a.NATIONS} SELECT job_id, profile_id FROM (SELECT j.job_id, p.profile_id, row_number() OVER (PARTITION BY j.job_id ORDER BY length(p.path_scope) DESC, p.profile_id) AS k
FROM job j JOIN profile p ON p.platform = j.platform AND p.purpose = j.job_purpose AND p.origin = j.origin AND p.expires_at > {_NOW} AND starts_with(j.url, p.origin || p.path_scope)) WHERE k = 1""")
def profile_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each job's profile of longest scope (O-1, P-2)."""
    return scheduling.longest_profile(a.jobs(spark, sf_dir), a.profiles(spark, sf_dir), _now()).select("job_id", "profile_id")


@query(f"""WITH {a.JOBS}, {a.NATIONS} SELECT job_id, count(*) AS n_profiles FROM job j JOIN profile p ON p.platform = j.platform AND p.purpose = j.job_purpose AND p.origin = j.origin AND p.expires_at > {_NOW}
  AND starts_with(substr(j.url, length(j.origin) + 1), p.path_scope) GROUP BY 1""")
def profile_matches_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many profiles cover each job by the strict rule (P-1, P-4)."""
    jobs = a.jobs(spark, sf_dir).select("job_id", "platform", F.col("job_purpose").alias("purpose"), "origin", F.expr("substr(url, length(origin) + 1)").alias("path")).alias("j")
    rules = a.profiles(spark, sf_dir).withColumns({"method": F.lit("GET"), "query_scope": F.lit(None).cast("string")}).alias("p")
    names = ("platform", "purpose", "origin", "path")
    covers = profile_matches({**{n: F.col(f"j.{n}") for n in names}, "query": F.lit(None).cast("string")}, {n: F.col(f"p.{n}") for n in ("platform", "purpose", "origin", "path_scope", "query_scope", "method", "disabled_at", "expires_at")}, _now())
    return jobs.join(rules, covers).groupBy("job_id").agg(F.count(F.lit(1)).alias("n_profiles"))


_NAMES = ", ".join(f"'{p}'" for p in PLATFORMS)


@query(f"""WITH {a.JOBS}, plat AS (SELECT unnest([{_NAMES}]) AS platform, unnest(range({len(PLATFORMS)})) AS ordinal),
pending AS (SELECT platform, count(*) AS n FROM job WHERE state IN ('pending', 'backoff') OR (state = 'done' AND next_fetch_at <= {_NOW}) GROUP BY 1),
demand AS (SELECT [{_NAMES}][CAST(c_custkey % 10 AS INT) + 1] AS platform, count(*) AS n FROM customer WHERE c_custkey % 7 <> 0 AND c_acctbal > 0 GROUP BY 1),
worker AS (SELECT platform, count(*) AS n FROM (SELECT unnest(CASE WHEN c_custkey % 3 = 0 THEN ['booth', 'vpm'] WHEN c_custkey % 3 = 1 THEN ['github'] ELSE ['itch', 'gumroad', 'vpm'] END) AS platform FROM customer WHERE c_custkey % 5 = 0 AND c_mktsegment <> 'BUILDING') GROUP BY 1)
SELECT platform, coalesce(p.n, 0) AS pending, coalesce(d.n, 0) AS demand, coalesce(w.n, 0) AS workers, (2 * coalesce(p.n, 0) + 5 * coalesce(d.n, 0) + 1) / (coalesce(w.n, 0) + 1) AS score
FROM plat LEFT JOIN pending p USING (platform) LEFT JOIN demand d USING (platform) LEFT JOIN worker w USING (platform) ORDER BY score DESC, ordinal LIMIT 3""")
def workforce_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three platforms most in need of workers (D-22, A-1 to A-4)."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    demand = customers.select(F.expr(f"element_at(array({_NAMES}), cast(c_custkey % 10 as int) + 1)").alias("requested_platform"), F.expr("case when c_custkey % 7 = 0 or not (c_acctbal > 0) then 1 end").alias("resolved_at"))
    nodes = customers.filter("c_custkey % 5 = 0")
    beats = nodes.select(F.expr("concat('node-', c_custkey)").alias("node_id"), _now().cast("timestamp").alias("last_seen_at"))
    held = nodes.select(F.expr("concat('node-', c_custkey)").alias("node_id"), F.expr("case when c_custkey % 3 = 0 then array('booth', 'vpm') when c_custkey % 3 = 1 then array('github') else array('itch', 'gumroad', 'vpm') end").alias("capabilities"), F.expr("case when c_mktsegment = 'BUILDING' then 1 end").alias("revoked_at"))
    jobs = a.jobs(spark, sf_dir).withColumn("next_fetch_at", F.col("next_fetch_at").cast("timestamp"))
    return scheduling.workforce(jobs, demand, beats, held, _now().cast("timestamp")).select("platform", "pending", "demand", "workers", "score")


@query(f"""WITH {a.JOBS}, {a.NATIONS} SELECT o.origin, greatest(o.min_delay_ms, coalesce(j.top, 0)) AS min_delay_ms FROM origin o LEFT JOIN (SELECT origin, max(min_delay_ms) AS top FROM job WHERE state = 'pending' GROUP BY 1) j USING (origin)""")
def origin_pacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pacing floors, which only rise (A-6, W-9)."""
    pending = a.jobs(spark, sf_dir).filter("state = 'pending'").select("origin", "min_delay_ms")
    return upsert.raise_floor(a.origins(spark, sf_dir), pending, ["origin"], "min_delay_ms").select("origin", "min_delay_ms")


@query(f"""WITH {a.EVENTS}, held AS (SELECT node_id, [{_NAMES}][item % 10 + 1] AS platform FROM event WHERE item < 90), mask AS (SELECT node_id, bit_or(1 << (list_position([{_NAMES}], platform) - 1)) AS m FROM held GROUP BY 1)
SELECT node_id, CAST(m AS INT) AS mask, lpad(lower(to_hex(m)), 4, '0') AS code FROM mask""")
def capability_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node's platforms as a mask and a code (F-30, A-15)."""
    held = a.events(spark, sf_dir).filter("item < 90").select("node_id", F.array(F.expr(f"element_at(array({_NAMES}), item % 10 + 1)")).alias("p"))
    masks = held.groupBy("node_id").agg(F.bit_or(codecs.capability_mask(F.col("p"))).alias("mask"))
    return masks.select("node_id", F.col("mask").cast("int").alias("mask"), codecs.capability_code(F.col("mask")).alias("code"))
