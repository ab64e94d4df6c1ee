"""Identity joins, leads, gone sources, takedowns, near duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, urls
from ..operators import identity, lifecycle, neardup, scheduling, upsert
from ..sources import adapters as a
from .registry import query

_LEADS = """lead AS (SELECT 'lead-' || event_id AS lead_key, CASE WHEN item % 4 = 0 THEN 'pkg-' || user_id WHEN item % 4 = 1 THEN 'src:' || (user_id % 40) END AS item_key, CASE WHEN item % 4 = 2 THEN 'pkg-' || item END AS claimed FROM event WHERE kind = 'signup')"""


def _or_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.events(spark, sf_dir).filter("kind = 'signup'").select(F.expr("concat('lead-', event_id)").alias("lead_key"), F.expr("case when item % 4 = 0 then concat('pkg-', user_id) when item % 4 = 1 then concat('src:', user_id % 40) end").alias("item_key"), F.expr("case when item % 4 = 2 then concat('pkg-', item) end").alias("claimed"))


@query(f"WITH {a.EVENTS}, {_LEADS}, {a.LINKS} SELECT DISTINCT lead_key, canonical_id FROM lead l JOIN link k ON l.item_key = k.canonical_id OR l.item_key = k.source_key OR l.claimed = k.canonical_id WHERE k.review_state = 'accepted'")
def identity_or_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads to packages by any of three keys, as a union of equi-joins (J-7)."""
    links = upsert.latest(a.link_rows(spark, sf_dir), ["canonical_id", "source_key"], [F.col("seq")]).filter("review_state = 'accepted'")
    return identity.or_join(_or_leads(spark, sf_dir), links, [(F.col("item_key"), F.col("canonical_id")), (F.col("item_key"), F.col("source_key")), (F.col("claimed"), F.col("canonical_id"))], ["lead_key"], ["canonical_id"])


@query("""WITH side AS (SELECT page_id, regexp_replace(regexp_replace(lower(split_part(split_part(url, '#', 1), '?', 1)), '/+$', ''), '\\.git$', '') AS k FROM pages)
SELECT a.page_id AS a, b.page_id AS b FROM side a JOIN side b ON a.k = b.k AND a.page_id < b.page_id""")
def identity_normalized_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of equal normal URL (J-8, F-19)."""
    side = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", urls.normal_identity(F.substring_index(F.substring_index("url", "#", 1), "?", 1)).alias("k"))
    return side.alias("x").join(side.alias("y"), (F.col("x.k") == F.col("y.k")) & (F.col("x.page_id") < F.col("y.page_id"))).select(F.col("x.page_id").alias("a"), F.col("y.page_id").alias("b"))


def _kind_sql(url: str) -> str:
    host, path = f"lower(regexp_extract({url}, '^https://([^/:?#@]+)(?::443)?(?:[/?#]|$)', 1))", f"regexp_extract({url}, '^https://[^/?#]+([^?#]*)', 1)"
    return f"CASE WHEN {host} = '' OR regexp_matches({path}, '(?i)\\.(?:zip|unitypackage|tar\\.gz)$') THEN NULL WHEN {host} = 'github.com' AND regexp_matches({path}, '^/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+(?:/.*)?$') THEN 'github_repository' WHEN {host} IN ('booth.pm', 'gumroad.com', 'jinxxy.com', 'sellfy.com', 'payhip.com') OR ends_with({host}, '.itch.io') THEN 'storefront_product' WHEN contains({host}, '.') AND NOT contains({host}, 'localhost') AND NOT ends_with({host}, '.internal') AND NOT ends_with({host}, '.local') THEN 'publisher_site' END"


_VARIANTS = ("url", "replace(url, '.example.', '.itch.io.example.')", "'https://github.com/' || page_id || '/repo.git'", "'https://booth.pm/items/' || page_id", "'https://x' || page_id || '.itch.io/a.zip'", "'https://store' || page_id || '.itch.io/a'")


@query("SELECT page_id, k, target_url, " + _kind_sql("target_url") + " AS kind FROM (SELECT page_id, unnest(range(6)) AS k, unnest([" + ", ".join(_VARIANTS) + "]) AS target_url FROM pages)")
def lead_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What links may lead to (P-6)."""
    variants = [F.expr(v.replace("||", "||")) for v in _VARIANTS]
    links = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.posexplode(F.array(*variants)).alias("k", "target_url"))
    return links.select("page_id", F.col("k").cast("long").alias("k"), "target_url", urls.lead_kind(F.col("target_url")).alias("kind"))


@query("""SELECT page_id, sha256('["outbound","' || url || '",' || CASE WHEN page_id % 3 = 0 THEN 'null' ELSE '"item-' || page_id || '"' END || ']') AS lead_key FROM pages""")
def lead_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lead keys, in which a missing part stays null (F-25)."""
    item = F.expr("case when page_id % 3 <> 0 then concat('item-', page_id) end")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", hashing.key_of(F.lit("outbound"), F.col("url"), item).alias("lead_key"))


_ROUTES = """lead AS (SELECT 'lead-' || page_id AS lead_key, ['vpm_listing', 'github_repository', 'storefront_product', 'publisher_site', 'release_zip'][CAST(page_id % 5 AS INT) + 1] AS kind, CASE WHEN page_id % 11 = 0 THEN 'rejected' ELSE 'pending_review' END AS status,
  CASE page_id % 5 WHEN 1 THEN 'https://github.com/o' || page_id || '/r.git' WHEN 2 THEN 'https://' || ['booth.pm', 'gumroad.com', 'jinxxy.com', 'sellfy.com', 'x.itch.io'][CAST(page_id % 7 AS INT) % 5 + 1] || '/p/' || page_id ELSE url END AS target_url FROM pages)"""


@query(f"""WITH {_ROUTES}, h AS (SELECT *, lower(regexp_extract(target_url, '^https://([^/:?#]+)', 1)) AS host FROM lead)
SELECT lead_key, kind, CASE kind WHEN 'vpm_listing' THEN 'vpm' WHEN 'github_repository' THEN 'github' WHEN 'storefront_product' THEN CASE host WHEN 'booth.pm' THEN 'booth' WHEN 'gumroad.com' THEN 'gumroad' WHEN 'jinxxy.com' THEN 'jinxxy' WHEN 'sellfy.com' THEN 'sellfy' ELSE 'custom_domain' END WHEN 'publisher_site' THEN 'custom_domain' END AS platform,
  CASE kind WHEN 'release_zip' THEN NULL WHEN 'vpm_listing' THEN 'discovery' ELSE 'metadata' END AS purpose,
  CASE WHEN kind = 'release_zip' THEN NULL WHEN kind = 'github_repository' THEN 'https://api.github.com/repos/' || regexp_replace(regexp_extract(target_url, '^https://github\\.com/([^/]+/[^/]+)', 1), '\\.git$', '') ELSE target_url END AS job_url,
  CAST(CASE kind WHEN 'vpm_listing' THEN 1000 WHEN 'github_repository' THEN 60000 WHEN 'storefront_product' THEN 1500 WHEN 'publisher_site' THEN 2000 END AS BIGINT) AS delay_ms,
  CASE WHEN status = 'rejected' THEN 'rejected' WHEN kind = 'release_zip' THEN 'not_a_job' END AS error FROM h""")
def lead_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jobs that approved leads become (D-14)."""
    target = F.expr("case page_id % 5 when 1 then concat('https://github.com/o', page_id, '/r.git') when 2 then concat('https://', element_at(array('booth.pm', 'gumroad.com', 'jinxxy.com', 'sellfy.com', 'x.itch.io'), cast(page_id % 7 as int) % 5 + 1), '/p/', page_id) else url end")
    leads = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.expr("concat('lead-', page_id)").alias("lead_key"), F.expr("element_at(array('vpm_listing', 'github_repository', 'storefront_product', 'publisher_site', 'release_zip'), cast(page_id % 5 as int) + 1)").alias("kind"), F.expr("case when page_id % 11 = 0 then 'rejected' else 'pending_review' end").alias("status"), target.alias("target_url"))
    return scheduling.route_leads(leads)


@query(f"""WITH rule AS (SELECT 'rule-' || i AS rule_id, 'https://' || regexp_extract(u, '^https://([^/?#]+)', 1) AS origin, s AS path_scope, TIMESTAMP '2024-01-01' + to_days(i) AS created_at
  FROM (SELECT min(page_id) AS i, u FROM (SELECT page_id, regexp_extract(url, '^https://[^/?#]+') AS u FROM pages) WHERE u <> '' GROUP BY u), (VALUES ('/'), ('/en/'), ('/fr/')) t(s)),
lead AS (SELECT 'lead-' || page_id AS lead_key, url AS target_url, regexp_extract(url, '^https://[^/?#]+') AS origin FROM pages WHERE url LIKE 'https://%')
SELECT lead_key, target_url, rule_id, min_delay_ms FROM (SELECT lead_key, target_url, rule_id || path_scope AS rule_id, CAST(1000 + length(path_scope) AS BIGINT) AS min_delay_ms, row_number() OVER (PARTITION BY lead_key ORDER BY length(path_scope) DESC, created_at DESC, rule_id DESC) AS k FROM lead JOIN rule USING (origin) WHERE starts_with(target_url, origin || path_scope)) WHERE k = 1""")
def autoqueue_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending leads with the longest rule that covers them (P-19, D-13)."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    places = pages.withColumn("origin", F.regexp_extract("url", r"^https://[^/?#]+", 0)).filter("origin <> ''").groupBy("origin").agg(F.min("page_id").alias("i"))
    rules = places.select("origin", "i", F.explode(F.array(F.lit("/"), F.lit("/en/"), F.lit("/fr/"))).alias("path_scope")).select(F.expr("concat('rule-', i, path_scope)").alias("rule_id"), F.lit("vpm_listing").alias("lead_kind"), "origin", "path_scope", F.expr("cast(1000 + length(path_scope) as bigint)").alias("min_delay_ms"), F.expr("timestamp_ntz '2024-01-01' + make_dt_interval(cast(i as int))").alias("created_at"), F.expr("timestamp_ntz '2025-01-01'").alias("expires_at"), F.lit(None).cast("timestamp_ntz").alias("disabled_at"))
    leads = pages.filter("url like 'https://%'").select(F.expr("concat('lead-', page_id)").alias("lead_key"), F.lit("vpm_listing").alias("kind"), F.lit("pending_review").alias("status"), F.col("url").alias("target_url"))
    return scheduling.rule_for_leads(leads, rules, F.expr("timestamp_ntz '2024-06-01'"))


_GONE = "gone AS (SELECT 'src:' || s_suppkey AS source_key FROM supplier WHERE s_suppkey % 2 = 0)"
_DELISTED = f"""WITH {a.PACKAGES}, {a.FRONTS}, {_GONE}, now_front AS (SELECT f.canonical_id, f.source_key, CASE WHEN g.source_key IS NOT NULL THEN 'delisted' ELSE f.availability END AS availability FROM front f LEFT JOIN gone g USING (source_key))"""


@query(_DELISTED + """ SELECT p.canonical_id, CASE WHEN p.vpm_id IS NULL AND p.lifecycle <> 'delisted' AND EXISTS (SELECT 1 FROM now_front f JOIN gone USING (source_key) WHERE f.canonical_id = p.canonical_id)
  AND NOT EXISTS (SELECT 1 FROM now_front f WHERE f.canonical_id = p.canonical_id AND f.availability = 'available') THEN 'delisted' ELSE p.lifecycle END AS lifecycle FROM package p""")
def gone_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages after half of the sources are gone (D-10, J-4, J-5)."""
    fronts = upsert.latest(a.front_rows(spark, sf_dir), ["canonical_id", "source_key"], [F.col("seq")]).drop("seq")
    gone = a.compatibilities(spark, sf_dir).filter("cast(substr(source_key, 5) as int) % 2 = 0").select("source_key")
    return lifecycle.delist_packages(a.packages(spark, sf_dir), lifecycle.delist_fronts(fronts, gone), gone, F.col("updated_at")).select("canonical_id", "lifecycle")


_TAKEDOWNS = "takedown AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'pkg-' || c_custkey END AS canonical_id, CASE WHEN c_custkey % 2 = 1 THEN 'https://shop' || (c_custkey % 50) || '.example.com/p/' || c_custkey END AS target_url FROM customer WHERE c_custkey % 3 = 0)"


@query(f"""WITH {a.PACKAGES}, {a.FRONTS}, {_TAKEDOWNS}, hit AS (SELECT canonical_id FROM takedown WHERE canonical_id IS NOT NULL UNION SELECT f.canonical_id FROM front f JOIN takedown t ON f.storefront_url = t.target_url)
SELECT canonical_id, CASE WHEN canonical_id IN (SELECT canonical_id FROM hit) THEN 'delisted' ELSE lifecycle END AS lifecycle FROM package""")
def takedown_delist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages after takedowns by id and by URL (D-23)."""
    takedowns = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_custkey % 3 = 0").select(F.expr("case when c_custkey % 2 = 0 then concat('pkg-', c_custkey) end").alias("canonical_id"), F.expr("case when c_custkey % 2 = 1 then concat('https://shop', c_custkey % 50, '.example.com/p/', c_custkey) end").alias("target_url"))
    fronts = upsert.latest(a.front_rows(spark, sf_dir), ["canonical_id", "source_key"], [F.col("seq")])
    return lifecycle.apply_takedowns(a.packages(spark, sf_dir), fronts, takedowns, F.col("updated_at")).select("canonical_id", "lifecycle")


@query(f"""WITH {a.LINKS}, verdict AS (SELECT canonical_id, source_key, 'rejected' AS v FROM link WHERE source_key LIKE '%7'), {a.FRONTS}
SELECT f.canonical_id, f.source_key FROM front f WHERE NOT EXISTS (SELECT 1 FROM verdict v WHERE v.canonical_id = f.canonical_id AND v.source_key = f.source_key)""")
def link_review_fronts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fronts that remain after links are rejected (§2.13 reviews)."""
    key = ["canonical_id", "source_key"]
    links = upsert.latest(a.link_rows(spark, sf_dir), key, [F.col("seq")]).select(hashing.key_of(*map(F.col, key)).alias("link_id"), *key, "review_state", "created_at", F.lit(None).cast("timestamp_ntz").alias("reviewed_at"))
    fronts = upsert.latest(a.front_rows(spark, sf_dir), key, [F.col("seq")]).select(*key)
    verdicts = links.filter("source_key like '%7'").select("link_id", F.lit("rejected").alias("verdict"))
    return lifecycle.review_links(links, fronts, verdicts, F.expr("timestamp_ntz '2024-06-01'"))[1]


#: Item hashes with up to three flipped bits; all pairs are compared, without blocks.
_NEAR = f"""WITH {a.EVENTS}, hashed AS (SELECT event_id, CAST(('0x' || substr(sha256(CAST(item AS VARCHAR)), 1, 15)) AS BIGINT) AS h0, event_id % 4 AS flip FROM event),
fixed AS (SELECT event_id, xor(h0, CASE flip WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 65537 ELSE 4294967555 END) AS h FROM hashed),
class AS (SELECT h, min(event_id) AS representative, count(*) AS n FROM fixed WHERE h IS NOT NULL GROUP BY h),
near AS (SELECT q.event_id, c.representative, c.n - CASE WHEN q.h = c.h THEN 1 ELSE 0 END AS members, CAST(bit_count(xor(q.h, c.h)) AS INT) AS distance
  FROM fixed q, class c WHERE q.event_id % 20 = 0 AND bit_count(xor(q.h, c.h)) <= 3)
"""


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    flip = F.expr("case event_id % 4 when 0 then 0L when 1 then 1L when 2 then 65537L else 4294967555L end")
    rows = a.events(spark, sf_dir).select("event_id", F.conv(F.substring(F.sha2(F.col("item").cast("string"), 256), 1, 15), 16, 10).cast("long").bitwiseXOR(flip).alias("hash"))
    return neardup.search(rows.filter("event_id % 20 = 0"), rows, "event_id")


@query(_NEAR + "SELECT event_id, representative, members, distance FROM near WHERE members > 0")
def lsh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes of equal hashes near to each query row, among all events, by blocks (J-16, F-22, F-23)."""
    return _near(spark, sf_dir)


@query(_NEAR + "SELECT event_id, representative, distance, row_number() OVER (PARTITION BY event_id ORDER BY distance, representative) AS place FROM near WHERE members > 0")
def candidates_by_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in order of distance (O-10)."""
    return neardup.by_distance(_near(spark, sf_dir).select("event_id", "representative", "distance"), "event_id", "representative")


@query()
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents near to benchmark items by SimHash, three bits apart at most (D-26); Unicode normalisation has no SQL form here."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", hashing.simhash(F.col("text")).alias("hash"))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", hashing.simhash(F.col("text")).alias("hash"))
    return neardup.near_pairs(docs, items, "doc_id", "item_id")


@query()
def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHashes of part names (F-9, A-10)."""
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", hashing.unsigned_text(hashing.simhash(F.col("p_name"))).alias("simhash"))
