"""Upserts, versions, evidence totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import journal, upsert, versions
from ..sources import adapters as a
from .registry import query

_KEY = ["canonical_id", "source_key"]
_SPLIT = "1996-01-01"


@query(f"WITH {a.FRONTS} SELECT canonical_id, source_key, platform, price, availability, strftime(observed_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS observed_at FROM front")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fronts of older line items, overwritten by those of newer ones (W-1)."""
    rows = a.front_rows(spark, sf_dir)
    old = upsert.latest(rows.filter(F.col("observed_at") < F.lit(_SPLIT).cast("timestamp_ntz")), _KEY, [F.col("seq")])
    new = rows.filter(F.col("observed_at") >= F.lit(_SPLIT).cast("timestamp_ntz"))
    return upsert.upsert(old, new, _KEY, [F.col("seq")]).select("canonical_id", "source_key", "platform", "price", "availability", a.iso("observed_at").alias("observed_at"))


@query(f"""WITH {a.PACKAGES}, old AS (SELECT * FROM package WHERE canonical_id NOT LIKE '%7'), new AS (
  SELECT canonical_id, 'tools' AS umbrella, 'new' AS category, display_name || '!' AS display_name, CASE WHEN umbrella = 'assets' THEN 'vpm.' || canonical_id END AS vpm_id, updated_at AS created_at FROM package WHERE canonical_id NOT LIKE '%3')
SELECT coalesce(o.canonical_id, n.canonical_id) AS canonical_id, CASE WHEN n.canonical_id IS NOT NULL THEN n.umbrella ELSE o.umbrella END AS umbrella, CASE WHEN n.canonical_id IS NOT NULL THEN n.category ELSE o.category END AS category,
       CASE WHEN n.canonical_id IS NOT NULL THEN n.display_name ELSE o.display_name END AS display_name, coalesce(n.vpm_id, o.vpm_id) AS vpm_id,
       strftime(CASE WHEN o.canonical_id IS NOT NULL THEN o.created_at ELSE n.created_at END, '%Y-%m-%dT%H:%M:%S.%gZ') AS created_at
FROM old o FULL JOIN new n ON o.canonical_id = n.canonical_id""")
def upsert_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages merged by column: creation stays, a missing package name keeps the old one (W-2, W-3)."""
    p = a.packages(spark, sf_dir).select("canonical_id", "umbrella", "category", "display_name", "vpm_id", "created_at", "updated_at")
    old = p.filter("canonical_id not like '%7'").drop("updated_at")
    new = p.filter("canonical_id not like '%3'").select("canonical_id", F.lit("tools").alias("umbrella"), F.lit("new").alias("category"), F.concat("display_name", F.lit("!")).alias("display_name"), F.expr("case when umbrella = 'assets' then concat('vpm.', canonical_id) end").alias("vpm_id"), F.col("updated_at").alias("created_at"))
    return upsert.merge(old, new, ["canonical_id"], keep_old=["created_at"], keep_if_null=["vpm_id"]).withColumn("created_at", a.iso("created_at"))


@query(f"""WITH {a.EVENTS} SELECT node_id, item, strftime(min(seen_at), '%Y-%m-%dT%H:%M:%S.%gZ') AS first_at, strftime(max(seen_at), '%Y-%m-%dT%H:%M:%S.%gZ') AS last_at, arg_min(kind, (seen_at, event_id)) AS first_kind, arg_max(kind, (seen_at, event_id)) AS last_kind FROM event GROUP BY ALL""")
def first_last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each node saw each item first and last (W-4)."""
    seen = upsert.first_last_seen(a.events(spark, sf_dir), ["node_id", "item"], [F.col("at"), F.col("event_id")], ["at", "kind"], ["at", "kind"])
    return seen.select("node_id", "item", a.iso("first_at").alias("first_at"), a.iso("last_at").alias("last_at"), "first_kind", "last_kind")


@query(f"""WITH {a.LINKS}, known AS (SELECT DISTINCT 'src:' || s_suppkey AS source_key FROM supplier WHERE s_suppkey % 3 = 0), fresh AS (
  SELECT source_key, canonical_id, review_state, row_number() OVER (PARTITION BY source_key ORDER BY created_at, canonical_id) AS k FROM link)
SELECT source_key, canonical_id, review_state FROM fresh WHERE k = 1 AND source_key NOT IN (SELECT source_key FROM known)""")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first link of each source that isn't known yet (W-5)."""
    new = upsert.latest(a.link_rows(spark, sf_dir), _KEY, [F.col("seq")]).select("source_key", "canonical_id", "review_state", "created_at")
    known = a.compatibilities(spark, sf_dir).filter("cast(substr(source_key, 5) as int) % 3 = 0")
    return upsert.insert_ignore(known, new, ["source_key"], [F.col("created_at"), F.col("canonical_id")]).select("source_key", "canonical_id", "review_state")


_PROJECTED = f"""WITH {a.HISTORY}, marked AS (
  SELECT *, last_value(digest IGNORE NULLS) OVER (PARTITION BY source_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
         last_value(CASE WHEN gone THEN TRUE WHEN complete THEN FALSE END IGNORE NULLS) OVER (PARTITION BY source_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was_gone FROM history
), runs AS (
  SELECT *, digest IS NOT NULL AND (prev IS NULL OR prev <> digest) AS starts, sum(CASE WHEN digest IS NOT NULL AND (prev IS NULL OR prev <> digest) THEN 1 ELSE 0 END) OVER (PARTITION BY source_key ORDER BY seq) AS run FROM marked
), news AS (
  SELECT *, starts OR (digest IS NOT NULL AND complete AND NOT coalesce(bool_or(digest IS NOT NULL AND complete) OVER (PARTITION BY source_key, run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE)) AS is_new FROM runs
), projected AS (
  SELECT source_key, seq, digest, complete, gone, is_new, CAST(sum(CASE WHEN is_new THEN 1 ELSE 0 END) OVER (PARTITION BY source_key ORDER BY seq) AS BIGINT) AS version_no,
         CASE WHEN gone THEN 'gone' WHEN complete AND coalesce(was_gone, FALSE) THEN 'restored' WHEN is_new THEN 'changed' ELSE 'unchanged' END AS event FROM news)
"""


@query(_PROJECTED + "SELECT source_key, seq, version_no, is_new, event FROM projected")
def version_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version numbers and events of a history (D-1, O-8)."""
    return versions.project_versions(a.history(spark, sf_dir)).select("source_key", "seq", "version_no", "is_new", "event")


@query(_PROJECTED + """SELECT source_key, max(version_no) AS version_no, arg_max(digest, version_no) AS digest FROM projected
WHERE is_new AND complete AND source_key NOT IN (SELECT source_key FROM projected WHERE gone OR complete GROUP BY 1 HAVING arg_max(gone, seq)) GROUP BY source_key""")
def version_latest_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest complete version of each source that isn't gone (J-10)."""
    return versions.latest_complete(versions.project_versions(a.history(spark, sf_dir)))


@query(_PROJECTED + "SELECT source_key, max(version_no) AS latest_version_no, arg_max(digest, version_no) AS latest_digest FROM projected WHERE is_new GROUP BY 1")
def version_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What current-state rows point to (J-9)."""
    return versions.latest_versions(versions.project_versions(a.history(spark, sf_dir)))


_KINDS = ("signup", "error", "click", "view", "purchase")


@query(f"WITH {a.EVENTS} SELECT node_id, {', '.join(f'count(*) FILTER (WHERE kind = {k!r}) AS n_{k}' for k in _KINDS)} FROM event GROUP BY 1")
def node_evidence_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of each kind for each node (A-8)."""
    return journal.node_totals(a.events(spark, sf_dir), _KINDS)


@query(f"WITH {a.EVENTS} SELECT node_id, rank, event_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY seen_at DESC, event_id DESC) AS rank FROM event) WHERE rank <= 5")
def node_recent_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest five events of each node (O-9)."""
    return journal.node_recent(a.events(spark, sf_dir), 5, [F.desc("at"), F.desc("event_id")]).select("node_id", F.col("rank").cast("long").alias("rank"), "event_id", "kind")


@query(f"""WITH {a.EVENTS}, entry AS (SELECT node_id AS run_id, user_id AS task_id, CASE kind WHEN 'signup' THEN 'claimed' WHEN 'click' THEN 'fetching' WHEN 'view' THEN 'submitting' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS state, seen_at, event_id FROM event),
task AS (SELECT run_id, task_id, coalesce(arg_min(state, seen_at) FILTER (WHERE state IN ('completed', 'failed')), arg_max(state, (list_position(['claimed', 'fetching', 'submitting', 'completed', 'failed'], state), seen_at))) AS state FROM entry GROUP BY ALL)
SELECT run_id, count(*) AS tasks, count(*) FILTER (WHERE state = 'completed') AS completed, count(*) FILTER (WHERE state = 'failed') AS failed FROM task GROUP BY 1""")
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of runs whose tasks keep their first final state (D-28, A-11)."""
    state = F.expr("case kind when 'signup' then 'claimed' when 'click' then 'fetching' when 'view' then 'submitting' when 'purchase' then 'completed' else 'failed' end")
    entries = a.events(spark, sf_dir).select(F.col("node_id").alias("run_id"), F.col("user_id").alias("task_id"), state.alias("state"), "at")
    return journal.run_totals(journal.task_states(entries))


@query(f"""WITH {a.EVENTS}, request AS (SELECT 'lease-' || (event_id % 1000) AS lease_id, event_id, sha256(kind) AS digest FROM event), stored AS (SELECT lease_id, digest FROM request WHERE event_id < 500)
SELECT r.event_id, CASE WHEN s.digest IS NULL THEN 'new' WHEN s.digest = r.digest THEN 'duplicate' ELSE 'conflict' END AS verdict FROM request r LEFT JOIN stored s USING (lease_id) WHERE r.event_id >= 500""")
def receipt_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests against stored receipts (W-12, T-9)."""
    rows = a.events(spark, sf_dir).select(F.expr("concat('lease-', event_id % 1000)").alias("lease_id"), "event_id", F.sha2("kind", 256).alias("request_digest"))
    return upsert.receipts(rows.filter("event_id >= 500"), rows.filter("event_id < 500")).select("event_id", "verdict")
