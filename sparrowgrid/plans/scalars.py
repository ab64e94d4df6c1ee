"""Scalar functions over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, policy, tags, text, urls, versions
from ..operators import guards
from ..sources import adapters as a
from .registry import query


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _chain(column: str) -> str:
    for entity, character in text.ENTITIES:
        column = f"replace({column}, '{entity}', '{character.replace(chr(39), chr(39) * 2)}')"
    return column


@query(f"SELECT page_id, sha256({_chain('html')}) AS unescaped FROM pages")
def html_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with entities replaced (F-1)."""
    return _t(spark, sf_dir, "pages").select("page_id", F.sha2(text.unescape_html(F.col("html")), 256).alias("unescaped"))


_WS = "\\t\\n\\x0b\\f\\r \\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}"
_ACROSS = _WS.replace("\\n", "").replace("\\r", "", 1)


@query(f"""WITH d AS (SELECT doc_id, {_chain("'![x](y) see https://discord.gg/abc ' || text")} AS t FROM documents), e AS (SELECT doc_id, regexp_replace(regexp_replace(t, '!\\[[^\\n\\r]*?\\]\\([^\\n\\r]*?\\)', '', 'g'), '(?i)https?://(?:discord\\.gg|discord(?:app)?\\.com/invite)/[^{_WS}]+', '', 'g') AS t FROM d),
f AS (SELECT doc_id, regexp_replace(replace(regexp_replace(regexp_replace(t, '^[{_WS}]+|[{_WS}]+$', '', 'g'), '[{_ACROSS}]+', ' ', 'g'), chr(13) || chr(10), chr(10)), '\\n[{_WS}]*\\n[{_WS}]*\\n+', chr(10) || chr(10), 'g') AS t FROM e)
SELECT doc_id, sha256(regexp_replace(t, '^[{_WS}]+|[{_WS}]+$', '', 'g')) AS cleaned FROM f""")
def description_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cleaned as descriptions (F-5)."""
    raw = F.concat(F.lit("![x](y) see https://discord.gg/abc "), "text")
    return _t(spark, sf_dir, "documents").select("doc_id", F.sha2(text.clean_description(raw), 256).alias("cleaned"))


@query("""WITH q AS (SELECT page_id, url, regexp_extract(url, '^([^?#]*)', 1) AS head, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS q, regexp_extract(url, '(#.*)$', 1) AS frag FROM pages),
p AS (SELECT page_id, head, frag, array_to_string(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(lower(split_part(x, '=', 1)), '^(utm|aff|ref)_') AND lower(split_part(x, '=', 1)) NOT IN (""" + ", ".join(f"'{x}'" for x in sorted(urls.TRACKING)) + """)), '&') AS kept FROM q)
SELECT page_id, head || CASE WHEN kept = '' THEN '' ELSE '?' || kept END || frag AS clean FROM p""")
def tracking_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page URLs without tracking parameters (F-17)."""
    return _t(spark, sf_dir, "pages").select("page_id", urls.clean_query(F.col("url")).alias("clean"))


@query()
def tracking_params_href(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with URLs re-serialised as browsers do (F-17, F-18)."""
    return _t(spark, sf_dir, "pages").select("page_id", urls.clean_tracking(F.col("url")).alias("clean"), F.size(urls.https_links(F.array("url", F.concat("url", F.lit("&ref=1")), "url"))).cast("long").alias("n_links"))


_TAGS = "string_split(lower(p_type || ' ' || CASE p_size % 7 WHEN 0 THEN 'Avatar Tool' WHEN 1 THEN 'hair texture' WHEN 2 THEN 'World' WHEN 3 THEN 'physbone prop' WHEN 4 THEN 'OSC outfit' WHEN 5 THEN 'none shader' ELSE 'misc' END), ' ')"


def _tags() -> F.Column:
    return F.expr("split(concat(p_type, ' ', case p_size % 7 when 0 then 'Avatar Tool' when 1 then 'hair texture' when 2 then 'World' when 3 then 'physbone prop' when 4 then 'OSC outfit' when 5 then 'none shader' else 'misc' end), ' ')")


@query(f"""WITH t AS (SELECT p_partkey, {_TAGS} AS tags FROM part) SELECT p_partkey, coalesce(list_filter(list_transform(tags, lambda t: CASE WHEN contains(t, 'avatar') THEN 'avatar_tool' WHEN contains(t, 'shader') THEN 'shader' WHEN contains(t, 'world') THEN 'world_tool' WHEN contains(t, 'animation') THEN 'animation_tool' WHEN contains(t, 'physics') OR contains(t, 'physbone') THEN 'physics_tool' WHEN contains(t, 'clothing') OR contains(t, 'outfit') OR contains(t, 'cosmetic') THEN 'vpm_package' END), lambda x: x IS NOT NULL)[1], 'vpm_package') AS category FROM t""")
def category_from_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories by tags (F-10)."""
    return _t(spark, sf_dir, "part").select("p_partkey", tags.category_from_tags(_tags(), F.lit("vpm_package")).alias("category"))


@query(f"""WITH t AS (SELECT p_partkey, {_TAGS} AS tags FROM part) SELECT p_partkey, coalesce(list_filter(list_transform(tags, lambda t: CASE WHEN regexp_matches(t, 'tool|script|system|gimmick|osc|tracking') THEN 'tools' WHEN regexp_matches(t, 'shader|texture|material|prop|asset') THEN 'assets' WHEN regexp_matches(t, 'avatar|clothing|hair|outfit|cosmetic') THEN 'avatars' END), lambda x: x IS NOT NULL)[1], 'tools') AS umbrella FROM t""")
def umbrella_from_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Umbrellas by tags (F-11)."""
    return _t(spark, sf_dir, "part").select("p_partkey", tags.umbrella_from_tags(_tags()).alias("umbrella"))


_OS_TEXT = "p_name || CASE p_size % 6 WHEN 0 THEN ' for Windows and Linux' WHEN 1 THEN ' setup.exe' WHEN 2 THEN ' Mac OS build' WHEN 3 THEN ' archlinux ubuntu' WHEN 4 THEN ' .exe' ELSE '' END"


@query(f"""WITH t AS (SELECT p_partkey, lower({_OS_TEXT}) AS s FROM part), o AS (SELECT p_partkey, concat_ws(',', CASE WHEN regexp_matches(s, '(^|[^a-z0-9_])(windows|win10|win11|win7|win8)([^a-z0-9_]|$)') OR regexp_matches(s, '[a-z0-9_]\\.exe([^a-z0-9_]|$)') THEN 'windows' END, CASE WHEN regexp_matches(s, '(^|[^a-z0-9_])(linux|ubuntu|debian|arch|appimage|flatpak)([^a-z0-9_]|$)') THEN 'linux' END, CASE WHEN regexp_matches(s, '(^|[^a-z0-9_])(macos|mac\\s*os|osx|darwin)([^a-z0-9_]|$)') THEN 'macos' END) AS n FROM t)
SELECT p_partkey, CASE WHEN n = '' THEN 'windows' ELSE n END AS supported_os FROM o""")
def os_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Systems that names mention (F-12)."""
    return _t(spark, sf_dir, "part").select("p_partkey", F.array_join(tags.supported_os(F.expr(_OS_TEXT)), ",").alias("supported_os"))


_TITLES = ("VRCX companion", "VRChat OSC router app", "SteamVR base station mount", "Unity Editor extension", "Kikyo dress costume", "VRChat cache cleaner", "plain tool", "VRC Face Tracking")


@query()
def desktop_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Desktop-tool verdicts on parts with made-up titles (F-13)."""
    title = F.concat(F.element_at(F.array(*map(F.lit, _TITLES)), (F.col("p_partkey") % len(_TITLES) + 1).cast("int")), F.lit(" "), "p_name")
    verdict = tags.desktop_tool(title, F.col("p_type"), F.array(F.col("p_brand")), F.array("p_type"))
    return _t(spark, sf_dir, "part").select("p_partkey", verdict.alias("v")).select("p_partkey", "v.is_tool", "v.subtype", "v.confidence", "v.rule")


@query()
def avatar_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Avatar bases in part names and made-up descriptions (F-14)."""
    about = F.element_at(F.array(*map(F.lit, ("【桔梗対応】", "for Manuka", "全アバター", "lime and mint", "サングラス", "nothing"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    found = tags.avatar_compatibility(F.col("p_name"), about, F.array("p_brand"), F.col("p_partkey").cast("string"))
    return _t(spark, sf_dir, "part").select("p_partkey", F.explode(found).alias("c")).select("p_partkey", "c.target_avatar_base", "c.scope", "c.confidence", "c.evidence_source")


@query("""WITH RECURSIVE s AS (SELECT p_partkey, p_brand AS t FROM part), f(p_partkey, t, i, h) AS (SELECT p_partkey, t, 0, CAST(14695981039346656037 AS UHUGEINT) FROM s UNION ALL SELECT p_partkey, t, i + 1, (xor(h, CAST(ascii(substr(t, i + 1, 1)) AS UHUGEINT)) * CAST(1099511628211 AS UHUGEINT)) % CAST(18446744073709551616 AS UHUGEINT) FROM f WHERE i < length(t))
SELECT p_partkey, CAST(h AS VARCHAR) AS hash FROM f WHERE i = length(t)""")
def fnv1a64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FNV-1a of brands, natively (F-21)."""
    return _t(spark, sf_dir, "part").select("p_partkey", hashing.unsigned_text(hashing.fnv1a64_native(F.col("p_brand"))).alias("hash"))


_OUTCOME = "CASE kind WHEN 'signup' THEN 'changed' WHEN 'error' THEN 'temporary_failure' WHEN 'click' THEN 'rate_limited' WHEN 'view' THEN 'blocked' ELSE 'gone' END"


@query(f"""WITH {a.EVENTS}, o AS (SELECT event_id, seen_at, item, {_OUTCOME} AS outcome FROM event) SELECT event_id, strftime(seen_at + to_seconds(CASE outcome WHEN 'rate_limited' THEN item + 1 WHEN 'temporary_failure' THEN 900 WHEN 'blocked' THEN 259200 ELSE 86400 END), '%Y-%m-%dT%H:%M:%S.%gZ') AS next_fetch_at, CASE outcome WHEN 'blocked' THEN 'blocked' WHEN 'rate_limited' THEN 'backoff' WHEN 'temporary_failure' THEN 'backoff' ELSE 'done' END AS state FROM o""")
def next_fetch_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When jobs are due again (F-33, D-12)."""
    e = a.events(spark, sf_dir).withColumn("outcome", F.expr(_OUTCOME))
    return e.select("event_id", policy.iso_text(policy.next_fetch_at(F.col("outcome"), F.col("at").cast("timestamp"), F.col("item") + 1)).alias("next_fetch_at"), policy.job_state(F.col("outcome")).alias("state"))


def _headers() -> F.Column:
    pairs = [("cf-mitigated", "item % 13 = 0", "'challenge'"), ("retry-after", "item % 3 = 0", "cast(item * 1000 as string)"), ("x-ratelimit-remaining", "item % 4 = 1", "'0'"), ("x-ratelimit-reset", "item % 4 = 1", f"cast(unix_timestamp(cast(timestamp_ntz '{a.NOW}' as timestamp)) + item * 7 as string)")]
    return F.map_from_entries(F.array_compact(F.array(*[F.expr(f"case when {c} then struct('{k}' as key, {v} as value) end") for k, c, v in pairs])))


_STATUS = "CASE kind WHEN 'signup' THEN 429 WHEN 'error' THEN 403 WHEN 'click' THEN 200 ELSE 503 END"


@query(f"WITH {a.EVENTS} SELECT event_id, CASE WHEN item % 13 = 0 THEN 'challenge' WHEN {_STATUS} = 429 THEN 'rate_limited' WHEN {_STATUS} = 403 AND (item % 3 = 0 OR item % 4 = 1) THEN 'rate_limited' WHEN {_STATUS} = 403 THEN 'forbidden' END AS failure FROM event")
def access_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access failures by status and headers (P-15)."""
    return a.events(spark, sf_dir).select("event_id", policy.access_failure(F.expr(_STATUS), _headers()).alias("failure"))


@query(f"WITH {a.EVENTS} SELECT event_id, CAST(CASE WHEN item % 3 = 0 AND item > 0 THEN least(86400, item * 1000) WHEN item % 4 = 1 AND item > 0 THEN least(86400, item * 7) ELSE 300 END AS BIGINT) AS seconds FROM event")
def retry_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds to wait by headers (F-29)."""
    now = F.expr(f"cast(timestamp_ntz '{a.NOW}' as timestamp)")
    return a.events(spark, sf_dir).select("event_id", policy.retry_after_seconds(_headers(), now).alias("seconds"))


_VERSION = "(item % 5) || '.' || (user_id % 12) || '.' || (event_id % 7) || CASE item % 4 WHEN 0 THEN '-beta.' || (event_id % 11) WHEN 1 THEN '-rc' ELSE '' END"


@query(f"""WITH {a.EVENTS}, v AS (SELECT node_id, {_VERSION} AS version, item % 5 AS x, user_id % 12 AS y, event_id % 7 AS z, item % 4 AS k, event_id % 11 AS b FROM event)
SELECT node_id, arg_max(version, (x, y, z, CASE k WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END, CASE WHEN k = 0 THEN b ELSE 0 END)) AS newest FROM v GROUP BY 1""")
def newest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest semantic version of each node (F-27)."""
    rows = a.events(spark, sf_dir).select("node_id", F.expr(_VERSION.replace("||", "||")).alias("version"))
    return rows.groupBy("node_id").agg(F.max_by("version", versions.sort_key(F.col("version"))).alias("newest"))


@query(f"""WITH {a.EVENTS}, v AS (SELECT event_id, CASE item % 6 WHEN 0 THEN 'v1.0.0' WHEN 1 THEN '1.0' WHEN 2 THEN '01.0.0' WHEN 3 THEN {_VERSION} WHEN 4 THEN '1.2.3+b.' || event_id ELSE ' 1.0.0' END AS version FROM event)
SELECT event_id, regexp_matches(version, '^(0|[1-9][0-9]*)\\.(0|[1-9][0-9]*)\\.(0|[1-9][0-9]*)(-(0|[1-9][0-9]*|[0-9]*[A-Za-z-][0-9A-Za-z-]*)(\\.(0|[1-9][0-9]*|[0-9]*[A-Za-z-][0-9A-Za-z-]*))*)?(\\+[0-9A-Za-z-]+(\\.[0-9A-Za-z-]+)*)?$') AS valid FROM v""")
def version_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict versions (P-17)."""
    v = F.expr(f"case item % 6 when 0 then 'v1.0.0' when 1 then '1.0' when 2 then '01.0.0' when 3 then {_VERSION} when 4 then '1.2.3+b.' || event_id else ' 1.0.0' end")
    return a.events(spark, sf_dir).select("event_id", versions.is_version(v).alias("valid"))


_ADDRESS = "(item * 3 % 256) || '.' || (user_id % 256) || '.' || (event_id % 256) || '.' || item"


@query(f"""WITH {a.EVENTS}, p AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN '300.1.1.1' ELSE {_ADDRESS} END AS address, item * 3 % 256 AS x, user_id % 256 AS y, event_id % 256 AS z FROM event)
SELECT event_id, event_id % 50 = 0 OR x IN (0, 10, 127) OR x >= 224 OR (x = 169 AND y = 254) OR (x = 172 AND y BETWEEN 16 AND 31) OR (x = 192 AND y = 168) OR (x = 100 AND y BETWEEN 64 AND 127) OR (x = 192 AND y = 0 AND z IN (0, 2)) OR (x = 198 AND y IN (18, 19)) OR (x = 198 AND y = 51 AND z = 100) OR (x = 203 AND y = 0 AND z = 113) AS reserved FROM p""")
def reserved_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Private and reserved IPv4 addresses (P-13)."""
    address = F.expr(f"case when event_id % 50 = 0 then '300.1.1.1' else {_ADDRESS} end")
    return a.events(spark, sf_dir).select("event_id", policy.is_reserved_v4(address).alias("reserved"))


@query("""SELECT doc_id, CASE WHEN length(split_part(text, chr(10), 1)) NOT BETWEEN 1 AND 500 THEN 'title_bounds' WHEN length(text) > 1024 THEN 'summary_bounds' END AS reject_code FROM documents""")
def observation_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first bound that a document breaks as an observation (P-22, P-24)."""
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("summary"))
    return rows.select("doc_id", guards.first_reason(guards.observation_checks(rows)).alias("reject_code"))


@query()
def titles_and_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as titles and authors with advertising and handles around them (F-2 to F-4, F-7)."""
    name = F.col("p_name")
    authors = text.resolve_authors(F.concat(name, F.lit(", @x & Co")), F.concat(F.lit("com."), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit(".tool")), F.lit(None).cast("string"), F.array("p_brand"))
    return _t(spark, sf_dir, "part").select("p_partkey", text.clean_title(F.concat(F.lit("[FREE] 【VRChat】 "), name, F.lit(" v1.2.0 beta"))).alias("title"), text.normalize_listing_title(F.concat(F.lit("（汎用）"), name)).alias("plain"), text.clean_author_name(F.concat(name, F.lit(" (x) @handle"))).alias("author"), authors["primary_author"].alias("primary_author"))


@query()
def readme_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as READMEs (F-6)."""
    readme = F.concat(F.lit("# Title\n\n![b](c)\n\n"), F.replace("text", F.lit("\n"), F.lit("\n\n")), F.lit("\n## License\nx"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.sha2(text.readme_description(readme, F.lit("A synopsis.")), 256).alias("description"))
