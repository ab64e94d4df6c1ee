"""Captured responses to outcomes (S-1, S-2): target gates, access failures, then the platform's parser."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrow_function, policy, urls
from . import parsers
from .parsers import Job

MOST_BYTES, MOST_OUTCOME = 2_000_000, 240_000
RELEASE = "struct<version:string,dependency_ranges:map<string,string>,download_url:string,zip_sha256:string>"
OBSERVATION = f"struct<source_item_key:string,title:string,author:string,summary:string,outbound_links:array<string>,origin_updated_at:string,release:{RELEASE},releases:array<{RELEASE}>,platform_tags:array<string>>"
LEAD = "struct<kind:string,url:string,claimed_package_id:string>"
ISSUE = "struct<source_item_key:string,version:string,code:string>"
PARSED = f"struct<kind:string,reason:string,observations:array<{OBSERVATION}>,leads:array<{LEAD}>,issues:array<{ISSUE}>>"


def gate(platform: Column, purpose: Column, url: Column, origin: Column) -> Column:
    """Why a job's URL is not of its platform's class, or null."""
    discovery, metadata = purpose == "discovery", purpose == "metadata"
    return (
        F.when(((platform == "github") | F.startswith(url, F.lit("https://api.github.com/"))) & ((platform != "github") | urls.github_repository(url).isNull()), "not_a_repository")
        .when((platform == "booth") & discovery & ~urls.is_booth_browse(url), "not_a_browse_page")
        .when((platform == "booth") & metadata & urls.booth_item(url).isNull(), "not_an_item")
        .when((platform == "shopify") & discovery & ~urls.is_shopify_sitemap(url), "not_a_sitemap")
        .when((platform == "shopify") & metadata & urls.shopify_product(url, origin).isNull(), "not_a_product")
        .when((platform == "sellfy") & metadata & urls.sellfy_product(url).isNull(), "not_a_product")
        .when((platform == "custom_domain") & metadata & ~urls.is_custom_product(url), "no_path")
    )


def parse_body(job: Job, body: str, content_type: str) -> dict:
    """What a good response's body says: an outcome of one kind."""
    out = {"kind": "temporary_failure", "reason": None, "observations": None, "leads": None, "issues": None}
    kind = content_type.lower()
    if job.platform in ("booth", "shopify", "curated") and job.purpose == "discovery":
        right = {"booth": "text/html" in kind, "shopify": bool(re.match(r"(?:application|text)/xml\b", kind)), "curated": True}[job.platform]
        if not right:
            return out | {"reason": "wrong_type"}
        leads = {"booth": parsers.browse, "shopify": parsers.sitemap}.get(job.platform, lambda j, b: parsers.curated(j, b, content_type))(job, body)
        return out | ({"reason": "no_bounded_leads"} if leads is None else {"kind": "discovery", "leads": leads})
    if job.platform == "vpm":
        found, leads = parsers.repository(job, body), None
        if found:
            out |= {"kind": "partial_batch" if found[1] else "batch", "observations": found[0], "issues": found[1] or None}
        elif (leads := parsers.recipe(job, body)) is not None:
            out |= {"kind": "discovery", "leads": leads}
        if found or leads is not None:
            return out if len(json.dumps(out, ensure_ascii=False)) <= MOST_OUTCOME else {**dict.fromkeys(out), "kind": "temporary_failure", "reason": "too_large"}
    one = parsers.github(job, body) if job.platform == "github" else parsers.manifest(job, body) if job.platform == "vpm" else None if "json" in kind else parsers.product(job, body)
    return out | ({"kind": "changed", "observations": [one]} if one else {"reason": "no_observation"})


@arrow_function(PARSED)
def parsed(platform: pd.Series, purpose: pd.Series, url: pd.Series, origin: pd.Series, body: pd.Series, content_type: pd.Series) -> pd.DataFrame:
    """:func:`parse_body` in Arrow batches; null where there is no body to parse."""
    rows = [parse_body(Job(p, q, u, o or ""), b, c or "") if b is not None else dict.fromkeys(("kind", "reason", "observations", "leads", "issues")) for p, q, u, o, b, c in zip(platform, purpose, url, origin, body, content_type, strict=True)]
    return pd.DataFrame(rows, columns=["kind", "reason", "observations", "leads", "issues"])


def outcomes(responses: DataFrame, now: Column) -> DataFrame:
    """(job_id, outcome, reason, retry_after_seconds, observations, leads, issues) of captured responses.

    ``responses``: job_id, platform, purpose, url, origin, status, headers (map with lower-case keys), body. Bodies that a gate,
    the status or the size rules out are not parsed.
    """
    c = F.col
    header = lambda name: F.try_element_at("headers", F.lit(name))
    failure = policy.access_failure(c("status"), c("headers"), F.substring(c("body"), 1, 5000))
    secondary = (c("platform") == "github") & (c("status") == 403) & c("body").rlike("(?i)secondary rate limit|abuse detection")
    large = (F.octet_length("body") > MOST_BYTES) | (header("content-length").try_cast("long") > MOST_BYTES)
    status = c("status")
    verdict = (
        F.when(gate(c("platform"), c("purpose"), c("url"), c("origin")).isNotNull(), "blocked:gate")
        .when(failure == "challenge", "blocked:challenge")
        .when(failure == "rate_limited", "rate_limited:")
        .when(secondary, "rate_limited:secondary")
        .when((failure == "forbidden") | (status == 401), F.concat(F.lit("blocked:http_"), status.cast("string")))
        .when(status == 304, "unchanged:")
        .when(status.between(300, 399), "blocked:redirect")
        .when(status.isin(404, 410), "gone:")
        .when(~status.between(200, 299), F.concat(F.lit("temporary_failure:http_"), status.cast("string")))
        .when(F.coalesce(large, F.lit(False)), "temporary_failure:too_large")
    )
    judged = responses.withColumn("verdict", verdict)
    body = F.when(c("verdict").isNull(), F.coalesce(c("body"), F.lit("")))
    read = judged.withColumn("p", parsed(c("platform"), c("purpose"), c("url"), c("origin"), body, header("content-type")))
    kind, reason = F.substring_index("verdict", ":", 1), F.nullif(F.substring_index("verdict", ":", -1), F.lit(""))
    wait = policy.retry_after_seconds(c("headers"), now)
    seconds = F.when(c("verdict") == "rate_limited:", wait).when(c("verdict") == "rate_limited:secondary", F.greatest(F.lit(60), policy.retry_after_seconds(c("headers"), now, 60)))
    return read.select("job_id", F.coalesce(kind, "p.kind").alias("outcome"), F.coalesce(reason, "p.reason").alias("reason"), seconds.alias("retry_after_seconds"), "p.observations", "p.leads", "p.issues")
