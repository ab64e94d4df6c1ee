"""Domain views of the test tables: fixed renamings and expressions, without any randomness. Each has the same text in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.policy import PLATFORMS

_NAMES = ", ".join(f"'{p}'" for p in PLATFORMS)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def iso(column: str) -> F.Column:
    """A time without zone as ISO text."""
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages from orders."""
    return _read(spark, sf_dir, "orders").select(
        F.expr("concat('pkg-', o_orderkey)").alias("canonical_id"),
        F.expr("case when substr(o_orderpriority, 1, 1) in ('1', '2') then 'tools' when substr(o_orderpriority, 1, 1) = '3' then 'assets' else 'avatars' end").alias("umbrella"),
        F.expr("element_at(array('vpm_package', 'shader', 'avatar_tool', 'world_tool', 'animation_tool'), cast(o_custkey % 5 as int) + 1)").alias("category"),
        F.expr("case o_orderstatus when 'F' then 'delisted' when 'O' then 'active' else 'deprecated' end").alias("lifecycle"),
        F.expr("concat(o_orderpriority, ' ', o_custkey)").alias("display_name"),
        F.expr("case when o_custkey % 2 = 1 then concat('com.pkg.', o_orderkey) end").alias("vpm_id"),
        F.col("o_orderdate").alias("created_at"),
        F.expr("o_orderdate + make_dt_interval(cast(o_custkey % 30 as int))").alias("updated_at"),
        F.expr("case when o_orderkey % 3 <> 0 then o_orderdate - make_dt_interval(cast(o_custkey % 100 as int)) end").alias("published_at"),
    )


PACKAGES = """package AS (
  SELECT 'pkg-' || o_orderkey AS canonical_id,
         CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'tools' WHEN substr(o_orderpriority, 1, 1) = '3' THEN 'assets' ELSE 'avatars' END AS umbrella,
         ['vpm_package', 'shader', 'avatar_tool', 'world_tool', 'animation_tool'][CAST(o_custkey % 5 AS INT) + 1] AS category,
         CASE o_orderstatus WHEN 'F' THEN 'delisted' WHEN 'O' THEN 'active' ELSE 'deprecated' END AS lifecycle,
         o_orderpriority || ' ' || o_custkey AS display_name,
         CASE WHEN o_custkey % 2 = 1 THEN 'com.pkg.' || o_orderkey END AS vpm_id,
         o_orderdate AS created_at, o_orderdate + to_days(CAST(o_custkey % 30 AS INT)) AS updated_at,
         CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate - to_days(CAST(o_custkey % 100 AS INT)) END AS published_at
  FROM orders)"""

#: A total order of line items: "latest" has to be decided by every column.
LINE_ORDER = ("l_shipdate", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def front_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Front observations from line items, in arrival order ``seq``."""
    return _read(spark, sf_dir, "lineitem").select(
        F.expr("concat('pkg-', l_orderkey)").alias("canonical_id"),
        F.expr("concat('src:', l_suppkey)").alias("source_key"),
        F.expr(f"element_at(array({_NAMES}), cast(l_suppkey % 10 as int) + 1)").alias("platform"),
        F.expr("concat('https://shop', l_suppkey, '.example.com/p/', l_orderkey)").alias("storefront_url"),
        F.col("l_extendedprice").alias("price"),
        F.expr("case l_linestatus when 'O' then 'JPY' else 'USD' end").alias("currency"),
        F.expr("case l_linestatus when 'O' then 'available' else 'delisted' end").alias("availability"),
        F.col("l_shipdate").alias("observed_at"),
        F.expr("concat('front-', l_orderkey, '-', l_suppkey)").alias("front_id"),
        F.struct(*LINE_ORDER).alias("seq"),
    )


FRONT_ROWS = f"""front_row AS (
  SELECT 'pkg-' || l_orderkey AS canonical_id, 'src:' || l_suppkey AS source_key, [{_NAMES}][CAST(l_suppkey % 10 AS INT) + 1] AS platform,
         'https://shop' || l_suppkey || '.example.com/p/' || l_orderkey AS storefront_url, l_extendedprice AS price,
         CASE l_linestatus WHEN 'O' THEN 'JPY' ELSE 'USD' END AS currency, CASE l_linestatus WHEN 'O' THEN 'available' ELSE 'delisted' END AS availability,
         l_shipdate AS observed_at, 'front-' || l_orderkey || '-' || l_suppkey AS front_id, {", ".join(LINE_ORDER)},
         row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY {", ".join(c + " DESC" for c in LINE_ORDER)}) AS newest
  FROM lineitem)"""
FRONTS = FRONT_ROWS + ", front AS (SELECT * FROM front_row WHERE newest = 1)"


def link_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity links from line items, in arrival order ``seq``."""
    return _read(spark, sf_dir, "lineitem").select(
        F.expr("concat('pkg-', l_orderkey)").alias("canonical_id"), F.expr("concat('src:', l_suppkey)").alias("source_key"),
        F.lit("vpm_id").alias("evidence_kind"), F.expr("round(1 - l_discount, 2)").alias("confidence"),
        F.expr("case l_returnflag when 'A' then 'accepted' when 'N' then 'provisional' else 'rejected' end").alias("review_state"),
        F.col("l_shipdate").alias("created_at"), F.struct(*LINE_ORDER).alias("seq"),
    )


LINKS = f"""link AS (
  SELECT canonical_id, source_key, evidence_kind, confidence, review_state, created_at FROM (
    SELECT 'pkg-' || l_orderkey AS canonical_id, 'src:' || l_suppkey AS source_key, 'vpm_id' AS evidence_kind, round(1 - l_discount, 2) AS confidence,
           CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'N' THEN 'provisional' ELSE 'rejected' END AS review_state, l_shipdate AS created_at,
           row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY {", ".join(c + " DESC" for c in LINE_ORDER)}) AS newest FROM lineitem) WHERE newest = 1)"""


def compatibilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Avatar compatibilities from suppliers."""
    return _read(spark, sf_dir, "supplier").select(
        F.expr("concat('src:', s_suppkey)").alias("source_key"),
        F.expr("element_at(array('kikyo', 'manuka', 'shinano', 'generic'), cast(s_suppkey % 4 as int) + 1)").alias("target_avatar_base"),
        F.expr("case when s_suppkey % 4 = 3 then 'universal' else 'named_base' end").alias("scope"),
    )


COMPATIBILITIES = """compatibility AS (
  SELECT 'src:' || s_suppkey AS source_key, ['kikyo', 'manuka', 'shinano', 'generic'][CAST(s_suppkey % 4 AS INT) + 1] AS target_avatar_base,
         CASE WHEN s_suppkey % 4 = 3 THEN 'universal' ELSE 'named_base' END AS scope FROM supplier)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the item of their properties."""
    item = F.get_json_object("props", "$.k").cast("int")
    return _read(spark, sf_dir, "events").select("event_id", F.col("ts").alias("at"), F.expr("concat('node-', user_id % 50)").alias("node_id"), F.col("user_id"), F.col("event_type").alias("kind"), F.col("value"), item.alias("item"))


EVENTS = """event AS (
  SELECT event_id, ts AS seen_at, 'node-' || (user_id % 50) AS node_id, user_id, event_type AS kind, value, CAST(json_extract_string(props, '$.k') AS INT) AS item FROM events)"""

#: The instant of the scheduling queries.
NOW = "2024-06-01 00:00:00"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl jobs from events: origins from users, platforms and purposes from items."""
    return events(spark, sf_dir).select(
        F.expr("concat('job-', event_id)").alias("job_id"),
        F.expr(f"element_at(array({_NAMES}), item % 10 + 1)").alias("platform"),
        F.expr("concat('https://origin', user_id % 25, '.example.com')").alias("origin"),
        F.expr("concat('https://origin', user_id % 25, '.example.com/', case when item % 3 = 0 then 'a/' when item % 3 = 1 then 'a/b/' else 'c/' end, event_id)").alias("url"),
        F.expr("case kind when 'signup' then 'pending' when 'error' then 'backoff' when 'purchase' then 'leased' else 'done' end").alias("state"),
        F.expr("case when item % 2 = 0 then 'discovery' else 'metadata' end").alias("job_purpose"),
        F.col("at").alias("next_fetch_at"), F.expr("at - make_dt_interval(cast(item as int))").alias("created_at"),
        F.expr("case when kind = 'purchase' then at + make_dt_interval(0, 0, 5) end").alias("lease_expires_at"),
        F.expr("case when item % 17 = 0 then at + make_dt_interval(400) end").alias("robots_deferred_until"),
        F.expr("cast(500 + 100 * item as bigint)").alias("min_delay_ms"),
    )


JOBS = EVENTS + f""", job AS (
  SELECT 'job-' || event_id AS job_id, [{_NAMES}][item % 10 + 1] AS platform, 'https://origin' || (user_id % 25) || '.example.com' AS origin,
         'https://origin' || (user_id % 25) || '.example.com/' || CASE WHEN item % 3 = 0 THEN 'a/' WHEN item % 3 = 1 THEN 'a/b/' ELSE 'c/' END || event_id AS url,
         CASE kind WHEN 'signup' THEN 'pending' WHEN 'error' THEN 'backoff' WHEN 'purchase' THEN 'leased' ELSE 'done' END AS state,
         CASE WHEN item % 2 = 0 THEN 'discovery' ELSE 'metadata' END AS job_purpose, seen_at AS next_fetch_at, seen_at - to_days(item) AS created_at,
         CASE WHEN kind = 'purchase' THEN seen_at + to_minutes(5) END AS lease_expires_at, CASE WHEN item % 17 = 0 THEN seen_at + to_days(400) END AS robots_deferred_until,
         CAST(500 + 100 * item AS BIGINT) AS min_delay_ms FROM event)"""


def origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Origin pacing from nations."""
    return _read(spark, sf_dir, "nation").select(F.expr("concat('https://origin', n_nationkey, '.example.com')").alias("origin"), F.expr("cast(1000 + 100 * n_nationkey as bigint)").alias("min_delay_ms"), F.expr(f"timestamp_ntz '{NOW}' + make_dt_interval(case when n_nationkey % 6 = 5 then 1 else -1 end)").alias("next_allowed_at"), F.expr("case when n_nationkey % 7 = 3 then 'job-x' end").alias("active_job_id"), F.expr(f"timestamp_ntz '{NOW}' + make_dt_interval(case when n_nationkey % 2 = 1 then 1 else -1 end)").alias("origin_lease_expires_at"))


def robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robots snapshots from nations: some expired, some failing."""
    return _read(spark, sf_dir, "nation").select(F.expr("concat('https://origin', n_nationkey, '.example.com')").alias("origin"), F.expr("cast(case when n_nationkey % 5 = 4 then 503 else 200 end as int)").alias("status_code"), F.expr("case when n_nationkey % 3 = 0 then 'User-agent: *\\nDisallow: /c/' else '' end").alias("body"), F.expr(f"timestamp_ntz '{NOW}' + make_dt_interval(case when n_nationkey % 4 = 1 then -1 else 1 end)").alias("expires_at"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source profiles from nations: a folder, a folder in it, and one that ended."""
    scope = F.explode(F.array(*[F.struct(F.lit(p).alias("path_scope"), F.lit(d).alias("days")) for p, d in (("/a/", 10), ("/a/b/", 10), ("/c/", -1))]))
    base = _read(spark, sf_dir, "nation").select("n_nationkey", scope.alias("s")).crossJoin(F.broadcast(spark.createDataFrame([(k, p, q) for k, p in enumerate(PLATFORMS) for q in ("discovery", "metadata")], "pk int, platform string, purpose string")))
    return base.filter("(n_nationkey + pk) % 3 <> 0").select(F.expr("concat('profile-', n_nationkey, '-', platform, '-', purpose, s.path_scope)").alias("profile_id"), "platform", "purpose", F.expr("concat('https://origin', n_nationkey, '.example.com')").alias("origin"), "s.path_scope", F.expr(f"timestamp_ntz '{NOW}' + make_dt_interval(s.days)").alias("expires_at"), F.expr("cast(null as timestamp_ntz)").alias("disabled_at"), F.expr(f"timestamp_ntz '{NOW}'").alias("created_at"))


NATIONS = f"""origin AS (
  SELECT 'https://origin' || n_nationkey || '.example.com' AS origin, CAST(1000 + 100 * n_nationkey AS BIGINT) AS min_delay_ms,
         TIMESTAMP '{NOW}' + to_days(CASE WHEN n_nationkey % 6 = 5 THEN 1 ELSE -1 END) AS next_allowed_at, CASE WHEN n_nationkey % 7 = 3 THEN 'job-x' END AS active_job_id,
         TIMESTAMP '{NOW}' + to_days(CASE WHEN n_nationkey % 2 = 1 THEN 1 ELSE -1 END) AS origin_lease_expires_at FROM nation
), robot AS (
  SELECT 'https://origin' || n_nationkey || '.example.com' AS origin, CASE WHEN n_nationkey % 5 = 4 THEN 503 ELSE 200 END AS status_code,
         CASE WHEN n_nationkey % 3 = 0 THEN '/c/' END AS denied, TIMESTAMP '{NOW}' + to_days(CASE WHEN n_nationkey % 4 = 1 THEN -1 ELSE 1 END) AS expires_at FROM nation
), profile AS (
  SELECT 'profile-' || n_nationkey || '-' || platform || '-' || purpose || path_scope AS profile_id, platform, purpose, 'https://origin' || n_nationkey || '.example.com' AS origin, path_scope,
         TIMESTAMP '{NOW}' + to_days(days) AS expires_at
  FROM nation, (SELECT unnest([{_NAMES}]) AS platform, unnest(range({len(PLATFORMS)})) AS pk), (SELECT unnest(['discovery', 'metadata']) AS purpose), (VALUES ('/a/', 10), ('/a/b/', 10), ('/c/', -1)) AS s(path_scope, days)
  WHERE (n_nationkey + pk) % 3 <> 0)"""


def held_refreshes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robots refreshes under way, from nations."""
    return _read(spark, sf_dir, "nation").filter("n_nationkey % 11 = 2").select(F.expr("concat('https://origin', n_nationkey, '.example.com')").alias("origin"), F.expr(f"timestamp_ntz '{NOW}' + make_dt_interval(0, 0, 1)").alias("refresh_expires_at"))


REFRESHES = f"""refresh AS (SELECT 'https://origin' || n_nationkey || '.example.com' AS origin, TIMESTAMP '{NOW}' + to_minutes(1) AS refresh_expires_at FROM nation WHERE n_nationkey % 11 = 2)"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations from conversations: a text's length class is its digest, so that digests repeat; some are incomplete or report gone."""
    rows = _read(spark, sf_dir, "conversations")
    return rows.select(F.expr("concat('conv-', conv_id)").alias("source_key"), F.col("turn").alias("seq"), F.expr("case when turn % 5 <> 3 then concat('d', length(text) % 2) end").alias("digest"), F.expr("turn % 5 <> 3 and length(text) % 3 <> 0").alias("complete"), F.expr("turn % 5 = 3").alias("gone"))


HISTORY = """history AS (
  SELECT 'conv-' || conv_id AS source_key, turn AS seq, CASE WHEN turn % 5 <> 3 THEN 'd' || (length(text) % 2) END AS digest,
         turn % 5 <> 3 AND length(text) % 3 <> 0 AS complete, turn % 5 = 3 AS gone FROM conversations)"""
