r"""URL rules with redirect equivalence.

A rule is a host and a path prefix with a verdict; it fits its host and all subdomains where the URL's path starts
with its path, and the longest that fits decides. URLs that no rule fits follow their aliases: URLs tied by
redirects (``http-equiv=refresh``) and canonical links (``rel=canonical``) form components, found by distributed
contraction. An alias of a blocked URL is blocked, unless its component also has an explicitly allowed one; without
either, it is allowed. A URL's own rule always comes first.

Rules are matched in a map literal when there are at most ``LITERAL_RULES`` of them, else by a join on host suffixes.

Aliases are resolved as a browser does: entities of the attribute, the page's ``<base>``, relative references, dot segments; scheme and host in
lower case, without the scheme's own port and without a fragment. Targets of other schemes (``mailto:``, ``javascript:``) tie nothing.

Defined results: a null URL, or one without ``://``, has empty host and path, no rule and no alias; equal URLs share
their aliases, and repeated rows give repeated results; null pages have no links; an empty table gives an empty
result; further columns are ignored. URLs are told apart by 64 bits of their SHA-256.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .components import connected_components

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
LITERAL_RULES = 2_000
CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
BASE = r"""(?is)<base\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\burl\s*=\s*["']?([^"'\s>;]+)"""


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """Up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    host = F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def _suffixes(host: Column) -> Column:
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def with_rule(urls: DataFrame, rules: tuple[tuple[str, str], ...] | DataFrame, host: str = "host", path: str = "path") -> DataFrame:
    """``urls`` with ``rule`` and ``rule_verdict``: the longest rule that fits, or null. Of equal rules, allow wins."""
    if not isinstance(rules, DataFrame):
        rules = urls.sparkSession.createDataFrame(list(rules), "verdict string, rule string")
    split = rules.select("verdict", "rule", F.substring_index("rule", "/", 1).alias("rule_host"), F.expr("substr(rule, instr(rule, '/'))").alias("rule_path")).filter("instr(rule, '/') > 0")
    few = split.limit(LITERAL_RULES + 1).collect()
    best = lambda found: F.array_max(F.transform(found, lambda r: F.struct(F.length(r["rule"]).alias("n"), (r["verdict"] == "allow").alias("allow"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    if len(few) <= LITERAL_RULES:
        by_host: dict[str, list] = {}
        for r in few:
            by_host.setdefault(r.rule_host, []).append(F.struct(F.lit(r.rule).alias("rule"), F.lit(r.rule_path).alias("path"), F.lit(r.verdict).alias("verdict")))
        if not by_host:
            return urls.withColumns({"rule": F.lit(None).cast("string"), "rule_verdict": F.lit(None).cast("string")})
        table = F.create_map(*[x for h, own in by_host.items() for x in (F.lit(h), F.array(*own))])
        fitting = F.filter(F.flatten(F.transform(_suffixes(F.col(host)), lambda s: F.coalesce(F.try_element_at(table, s), F.array().cast("array<struct<rule:string,path:string,verdict:string>>")))), lambda r: F.startswith(F.col(path), r["path"]))
        return urls.withColumn("best_rule", best(fitting)).withColumns({"rule": F.col("best_rule.rule"), "rule_verdict": F.col("best_rule.verdict")}).drop("best_rule")
    places = urls.select(host, path).distinct()
    fits = places.withColumn("suffix", F.explode(_suffixes(F.col(host)))).join(split, F.col("suffix") == F.col("rule_host")).filter(F.startswith(F.col(path), F.col("rule_path")))
    chosen = fits.groupBy(host, path).agg(F.max(F.struct(F.length("rule").alias("n"), (F.col("verdict") == "allow").alias("allow"), "rule", "verdict")).alias("best_rule"))
    return urls.join(chosen, [host, path], "left").withColumns({"rule": F.col("best_rule.rule"), "rule_verdict": F.col("best_rule.verdict")}).drop("best_rule")


def normal(url: Column) -> Column:
    """An absolute URL as it is fetched: scheme and host in lower case, no own port, no dot segments, no fragment; a missing path is ``/``."""
    fetched = F.substring_index(url, "#", 1)
    root = F.lower(F.regexp_extract(fetched, r"^[^:/?]+://[^/?]*", 0))
    root = F.regexp_replace(F.regexp_replace(root, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
    path, query = F.regexp_extract(fetched, r"(?s)^[^:/?]+://[^/?]*([^?]*)", 1), F.regexp_extract(fetched, r"(?s)^[^?]*(\?.*)$", 1)
    parts = F.split(path, "/", -1)
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.concat(acc, F.array(x))))
    whole = F.array_join(F.concat(kept, F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))), "/")
    return F.when(url.contains("://"), F.concat(root, F.when(whole == "", "/").otherwise(whole), query))


def resolved(base: Column, target: Column) -> Column:
    """A reference from ``base`` as an absolute URL; null if it leads nowhere that is fetched."""
    to = F.trim(F.replace(F.replace(F.replace(target, F.lit("&#38;"), F.lit("&")), F.lit("&#x26;"), F.lit("&")), F.lit("&amp;"), F.lit("&")))
    scheme, root = F.substring_index(base, "://", 1), F.regexp_extract(base, r"^[^:/?#]+://[^/?#]*", 0)
    path = F.regexp_extract(base, r"(?s)^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)
    absolute = (
        F.when((to == "") | F.startswith(to, F.lit("#")), F.lit(None).cast("string"))
        .when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(F.startswith(to, F.lit("//")), F.concat(scheme, F.lit(":"), to))
        .when(F.startswith(to, F.lit("/")), F.concat(root, to))
        .when(F.startswith(to, F.lit("?")), F.concat(root, path, to))
        .otherwise(F.concat(root, folder, F.lit("/"), to))
    )
    return normal(absolute)


def _node(url: Column) -> Column:
    """The number of a URL in its normal form."""
    return F.conv(F.substring(F.sha2(url, 256), 1, 15), 16, 10).cast("long")


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(from_url, to_url) of the redirects and canonical links of pages, in normal form."""
    u, h = F.col(f"`{url}`"), F.col(f"`{html}`")
    some = pages.filter(h.rlike("(?i)canonical|http-equiv") & u.contains("://"))
    target = F.explode(F.array(F.regexp_extract(h, CANONICAL, 1), F.regexp_extract(h, REFRESH, 1)))
    found = some.select(u.alias("own"), F.regexp_extract(h, BASE, 1).alias("base"), target.alias("to")).filter("to <> ''")
    base = F.coalesce(resolved(F.col("own"), F.col("base")), F.col("own"))
    return found.select(normal(F.col("own")).alias("from_url"), resolved(base, F.col("to")).alias("to_url"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] | DataFrame = RULES, page_id: str = "page_id", url: str = "url", html: str = "html", edges: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of ``pages``. ``edges``: further (from_url, to_url), of recorded redirects."""
    links = link_edges(pages, url, html)
    if edges is not None:
        links = links.unionByName(edges.select(normal(F.col("from_url")).alias("from_url"), normal(F.col("to_url")).alias("to_url")))
    links = staged(links.filter("from_url is not null and to_url is not null"), "url-links")
    roots = connected_components(links.select(_node(F.col("from_url")), _node(F.col("to_url"))))
    own = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"))
    placed = lambda df: with_rule(df.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}), rules)
    # The decisions of a component: of every URL that an edge names, whether a page has it or not.
    ends = placed(links.select(F.explode(F.array("from_url", "to_url")).alias("url")).distinct()).filter("rule_verdict is not null").select(_node(F.col("url")).alias("node"), "rule_verdict")
    decided = ends.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("rule_verdict").alias("alias_verdict"))
    member = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    spread = member.join(decided, "root").select("node", "alias_verdict")
    out = placed(own).withColumn("node", _node(normal(F.col("url")))).join(spread, "node", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "alias_verdict", F.lit("allow")).alias("verdict"))


JUDGE_SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), links AS (
  SELECT DISTINCT split_part(url, '#', 1) AS a, split_part(CASE WHEN contains(t, '://') THEN t WHEN starts_with(t, '//') THEN split_part(url, '://', 1) || ':' || t
           WHEN starts_with(t, '/') THEN regexp_extract(url, '^[^:]*://[^/?#]*') || t
           ELSE regexp_extract(url, '^[^:]*://[^/?#]*') || coalesce(nullif(regexp_extract(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '^(.*/)?'), ''), '/') || t END, '#', 1) AS b
  FROM (SELECT url, rest, unnest([regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
                            regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), '(?is)\burl\s*=\s*["'']?([^"''\s>;]+)', 1)]) AS t
        FROM p WHERE rest IS NOT NULL) WHERE t <> ''
), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
urls AS (SELECT DISTINCT url FROM p WHERE url IS NOT NULL UNION SELECT a FROM both_ways),
parsed AS (
  SELECT url, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1), '') AS path
  FROM (SELECT url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM urls)
), rules(verdict, rule, h, q) AS (
  VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'), ('block', 'example.org/en/1', 'example.org', '/en/1'),
         ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')
), judged AS (
  SELECT url, host, path, arg_max(rule, length(rule)) AS rule, arg_max(r.verdict, length(rule)) AS own
  FROM parsed LEFT JOIN rules r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY ALL
), spread AS (
  SELECT r.a AS url, min(j.own) AS alias FROM reach r JOIN judged j ON j.url = r.b WHERE j.own IS NOT NULL GROUP BY ALL
)
SELECT p.page_id, coalesce(j.host, '') AS host, coalesce(j.path, '') AS path, j.rule, coalesce(j.own, s.alias, 'allow') AS verdict
FROM p LEFT JOIN judged j ON j.url = p.url LEFT JOIN spread s ON s.url = split_part(p.url, '#', 1)
"""
