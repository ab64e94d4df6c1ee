"""Parsers of captured bodies: listings, recipes, repositories, manifests, product pages, browse pages, sitemaps, feeds.

JSON decides by the types of its values, and HTML needs a tree, so parsers are plain functions over one body, applied in
Arrow batches. Each gives None for what it doesn't accept as a whole.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from typing import Any
from urllib.parse import urljoin
from xml.etree import ElementTree

from ..functions import text as t
from ..functions.urls import Url, https_links_of

# Bounds of what one response may bring.
MOST, MOST_ID, MOST_VERSION, MOST_TAGS, MOST_TAG = 100, 200, 100, 50, 100
TITLE, AUTHOR, SUMMARY = 500, 300, 1024
_SEMVER = re.compile(r"(?:0|[1-9]\d*)\.(?:0|[1-9]\d*)\.(?:0|[1-9]\d*)(?:-(?:0|[1-9]\d*|\d*[A-Za-z-][0-9A-Za-z-]*)(?:\.(?:0|[1-9]\d*|\d*[A-Za-z-][0-9A-Za-z-]*))*)?(?:\+[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*)?", re.A)


@dataclass
class Job:
    """What was fetched, and why."""

    platform: str
    purpose: str
    url: str
    origin: str = ""


def units(text: str, most: int) -> str:
    """The first ``most`` UTF-16 units of a text."""
    return text.encode("utf-16-le", "surrogatepass")[: 2 * most].decode("utf-16-le", "ignore")


def size(text: str) -> int:
    """UTF-16 units."""
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


def _json(body: str) -> Any:
    try:
        return json.loads(body)
    except (ValueError, RecursionError):
        return None


def _text(value: Any) -> str | None:
    return (t._strip(value) or None) if isinstance(value, str) else None


def _object(value: Any) -> dict | None:
    return value if isinstance(value, dict) else None


def _name(value: Any) -> str | None:
    return _text(value) or _text((_object(value) or {}).get("name"))


def _https(value: Any) -> str | None:
    url = Url.parse(value) if isinstance(value, str) else None
    return value if url and url.scheme == "https" else None


def title_of(raw: str) -> str:
    """``clean_title`` for one string."""
    title = unicodedata.normalize("NFKC", t._entities(raw or ""))
    for _ in range(3):
        for labels in (t.PLATFORM_LABELS, t.OFFER_LABELS):
            title = re.sub(rf"^[【\[(]?(?:{labels})[】\])]{t._W}*", " ", title, flags=re.I)
            title = re.sub(rf"[【\[(]?(?:{labels})[】\])]$", " ", title, flags=re.I)
        title = re.sub(rf"{t._W}*[【\[(](?:{t.INNER_LABELS})[】\])]", " ", title, flags=re.I)
    for pattern in t.BRACKETED:
        title = re.sub(pattern, " ", title)
    title = re.sub(rf"{t._W}+v?[0-9]+\.[0-9]+(?:\.[0-9]+)?(?:{t._W}*beta|{t._W}*alpha)?$", "", title, flags=re.I)
    return t._strip(t._JS.sub(" ", title)) or t._strip(t._entities(raw or ""))


def tags_of(value: Any) -> list[str] | None:
    """Trimmed, bounded, distinct tags of a keyword list, or None."""
    if not isinstance(value, list):
        return None
    kept = [x for x in (t._strip(v) for v in value if isinstance(v, str)) if 0 < size(x) <= MOST_TAG]
    return list(dict.fromkeys(kept))[:MOST_TAGS] or None


def iso_date(value: Any) -> str | None:
    """A date text as ISO with milliseconds in UTC, or None."""
    from datetime import UTC, datetime
    from email.utils import parsedate_to_datetime

    if not _text(value):
        return None
    raw = _text(value)
    for read in (lambda x: datetime.fromisoformat(x.replace("Z", "+00:00")), parsedate_to_datetime):
        try:
            at = read(raw)
        except (TypeError, ValueError):
            continue
        at = at.replace(tzinfo=UTC) if at.tzinfo is None else at.astimezone(UTC)
        return at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z"
    return None


def _observation(key: str, title: str, author: str, summary: str, links: list, updated: str | None, **more: Any) -> dict:
    return {"source_item_key": key, "title": units(title_of(title), TITLE), "author": units(t.author_of(author), AUTHOR), "summary": units(t._described(summary), SUMMARY), "outbound_links": https_links_of(links), "origin_updated_at": updated, "release": None, "releases": None, "platform_tags": None} | more


def release_of(version: str, manifest: dict) -> dict | None:
    """A version's evidence: dependency ranges, download and hash."""
    if not _SEMVER.fullmatch(version) or len(version) > 256:
        return None
    depends = _object(manifest["vpmDependencies"]) if "vpmDependencies" in manifest else {}
    if depends is None or len(depends) > MOST:
        return None
    ranges = {k: _text(v) for k, v in depends.items()}
    if any(not k or size(k) > MOST_ID or not v or size(v) > MOST_ID for k, v in ranges.items()):
        return None
    digest = _text(manifest.get("zipSHA256"))
    if digest and not re.fullmatch("[a-fA-F0-9]{64}", digest):
        return None
    return {"version": version, "dependency_ranges": ranges, "download_url": _https(manifest.get("url")), "zip_sha256": digest.lower() if digest else None}


def _links_of(manifest: dict) -> Iterator[Any]:
    for key in ("url", "repo"):
        yield manifest.get(key)
    repository = manifest.get("repository")
    yield repository if isinstance(repository, str) else (_object(repository) or {}).get("url")
    for key in ("homepage", "documentation", "documentationLink"):
        yield manifest.get(key)
    yield (_object(manifest.get("author")) or {}).get("url")


def repository(job: Job, body: str) -> tuple[list[dict], list[dict]] | None:
    """(observations, issues) of a package listing (S-3): valid entries stand, malformed ones become issues."""
    whole = _object(_json(body)) if job.platform == "vpm" else None
    packages = _object((whole or {}).get("packages"))
    if not packages or len(packages) > MOST:
        return None
    found, issues = [], []

    def issue(key: str, code: str, version: str | None = None) -> None:
        issues.append({"source_item_key": key, "version": version, "code": code})

    for key, value in packages.items():
        if not key or size(key) > MOST_ID:
            return None
        versions = _object((_object(value) or {}).get("versions"))
        if not versions or len(versions) > MOST:
            issue(key, "invalid_package")
            continue
        good = []
        for version, manifest in versions.items():
            named = version if version and size(version) <= MOST_VERSION else None
            m = _object(manifest)
            if named is None or m is None or not all(isinstance(m.get(k), str) and m[k] for k in ("name", "version")):
                issue(key, "invalid_manifest", named)
            elif (m["name"], m["version"]) != (key, version):
                issue(key, "identity_mismatch", version)
            elif not _SEMVER.fullmatch(version):
                issue(key, "invalid_version", version)
            elif (release := release_of(version, m)) is None:
                issue(key, "invalid_release_evidence", version)
            else:
                good.append((m, release))
        if len(issues) > MOST:
            return None
        if good:
            first = lambda get: next((x for x in (get(m) for m, _ in good) if x), None)  # noqa: B023, E731
            dates = sorted(filter(None, (iso_date(m.get("updated_at")) for m, _ in good)))
            links = [whole.get("url"), (_object(whole.get("infoLink")) or {}).get("url"), *(x for m, _ in good for x in _links_of(m))]
            words = next((m["keywords"] for m, _ in good if isinstance(m.get("keywords"), list)), None)
            found.append(_observation(key, first(lambda m: _text(m.get("displayName"))) or key, first(lambda m: _name(m.get("author"))) or _name(whole.get("author")) or t.UNKNOWN, first(lambda m: _text(m.get("description"))) or "", links, dates[-1] if dates else None, releases=[r for _, r in good], platform_tags=tags_of(words)))
    return found, issues


def strict_repository(job: Job, body: str) -> list[dict] | None:
    """A listing's observations if it has no issue (S-4)."""
    found = repository(job, body)
    return found[0] if found and not found[1] else None


_PART = r"[A-Za-z0-9_.-]+"


def recipe(job: Job, body: str) -> list[dict] | None:
    """Leads of a listing's build recipe (S-5): all entries, or None if any is malformed."""
    whole = _object(_json(body)) if job.platform in ("vpm", "curated") else None
    if whole is None or not _text(whole.get("name")) or not _https(whole.get("url")):
        return None
    packages, repos = whole.get("packages"), whole.get("githubRepos")
    if any(k in whole and not isinstance(whole[k], list) for k in ("packages", "githubRepos")) or (packages is None and repos is None):
        return None
    packages, repos = packages or [], repos or []
    if max(len(packages), len(repos)) > MOST:
        return None
    leads = [("vpm_listing", Url.parse(whole["url"]).href, None)]
    for repo in repos:
        if not isinstance(repo, str) or not re.fullmatch(f"{_PART}/{_PART}", repo) or any(p in (".", "..") for p in repo.split("/")):
            return None
        leads.append(("github_repository", f"https://github.com/{repo}", None))
    for entry in packages:
        releases = (_object(entry) or {}).get("releases")
        if not isinstance(releases, list) or len(releases) > MOST:
            return None
        claimed = _text(entry.get("id")) or _text(entry.get("name"))
        if claimed and size(claimed) > MOST_ID:
            return None
        for release in releases:
            url = Url.parse(release) if _https(release) else None
            if url is None or not url.path.lower().endswith(".zip"):
                return None
            leads.append(("release_zip", url.href, claimed))
    if len(leads) > MOST:
        return None
    return [{"kind": k, "url": u, "claimed_package_id": c} for k, u, c in dict.fromkeys(leads)]


def github(job: Job, body: str) -> dict | None:
    """A public repository whose answer is the one asked for (S-6)."""
    match = re.fullmatch(r"https://api\.github\.com/repos/([A-Za-z0-9][A-Za-z0-9-]{0,38}/[A-Za-z0-9_.-]{1,100})", job.url)
    repo = _object(_json(body))
    if job.platform != "github" or not match or repo is None or repo.get("private") is not False:
        return None
    wanted, owner, name, number = match[1].lower(), _text((_object(repo.get("owner")) or {}).get("login")), _text(repo.get("name")), repo.get("id")
    page = _https(repo.get("html_url"))
    same = owner and name and page and {(_text(repo.get("full_name")) or "").lower(), f"{owner}/{name}".lower()} == {wanted} and page.lower() == f"https://github.com/{wanted}"
    if not same or isinstance(number, bool) or not isinstance(number, int) or not 0 < number < 1 << 53:
        return None
    return _observation(f"github:{number}", name, owner, _text(repo.get("description")) or "", [page, repo.get("homepage")], iso_date(repo.get("updated_at")))


def manifest(job: Job, body: str) -> dict | None:
    """A single package manifest (S-7); its identity is never cut."""
    item = _object(_json(body)) if job.platform == "vpm" else None
    if item is None:
        return None
    name, version = item.get("name"), item.get("version")
    if not all(isinstance(x, str) and x and x == t._strip(x) for x in (name, version)) or size(name) > MOST_ID or size(version) > MOST_VERSION:
        return None
    release = release_of(version, item)
    if release is None:
        return None
    return _observation(name, str(item.get("displayName") or name), _name(item.get("author")) or t.UNKNOWN, str(item.get("description") or ""), list(_links_of(item)), iso_date(item.get("updated_at")), release=release, platform_tags=tags_of(item.get("keywords")))


# ---- HTML

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Node:
    """An element: tag, attributes, children (nodes and strings)."""

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None = None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    @property
    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text for c in self.children)

    def has(self, name: str) -> bool:
        return name in self.attrs.get("class", "").split()

    def within(self, *names: str) -> bool:
        node = self.parent
        while node is not None and not any(map(node.has, names)):
            node = node.parent
        return node is not None


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("", {})

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {}, self.here)
        for k, v in attrs:
            node.attrs.setdefault(k, v or "")
        self.here.children.append(node)
        if tag not in _VOID:
            self.here = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.here = self.here.parent

    def handle_endtag(self, tag):
        node = self.here
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.here = node.parent

    def handle_data(self, data):
        self.here.children.append(data)


def tree(body: str) -> Node:
    """A page's tree, read as far as it goes."""
    parser = _Tree()
    parser.feed(body)
    parser.close()
    return parser.root


_PRODUCTS = {
    "booth": r"https?://[^/]+/(?:[a-z]{2}/)?items/\d+/?(?:[?#].*)?", "gumroad": r"https?://[^/]+/l/[^/?#]+/?(?:[?#].*)?", "jinxxy": r"https?://[^/]+/[^/?#]+/[^/?#]+/?(?:[?#].*)?", "itch": r"https?://[^/?#]+\.itch\.io(?:[:/?#].*)?",
    "shopify": r"(?i:https?://[^/]+/(?:[a-z]{2}(?:-[a-z]{2})?/)?products/[a-z0-9][a-z0-9-]*/?(?:[?#].*)?)", "sellfy": r"https://[^/:@?#]+(?:/[A-Za-z0-9_.-]+)?/p/[A-Za-z0-9_.-]+/?", "custom_domain": r"https://[^/:@?#]+/[^?#]+",
}


def _linked(root: Node, url: Url, base: str) -> dict:
    """The page's first product or application in linked data that is about this URL, or nothing."""
    for node in root.walk():
        if node.tag == "script" and node.attrs.get("type") == "application/ld+json":
            value = _json(node.text)
            for item in value if isinstance(value, list) else [value]:
                if isinstance(item, dict) and re.search("Product|SoftwareApplication", str(item.get("@type") or ""), re.I):
                    claimed = Url.parse(urljoin(base, str(item["url"]))) if item.get("url") else url
                    if claimed and (claimed.origin, claimed.path) == (url.origin, url.path):
                        return item
    return {}


def product(job: Job, body: str) -> dict | None:
    """A product page (S-8): linked data, then meta properties, then known classes."""
    url = Url.parse(job.url)
    if url is None or not re.fullmatch(_PRODUCTS.get(job.platform, "(?!)"), job.url, re.S):
        return None
    root = tree(body)
    nodes = list(root.walk())
    data = _linked(root, url, job.url)

    def meta(key: str) -> str:
        node = next((n for n in nodes if n.tag == "meta" and key in (n.attrs.get("property"), n.attrs.get("name"))), None)
        return t._strip(node.attrs.get("content", "")) if node else ""

    def shown(*names: str, tag: str | None = None) -> str:
        node = next((n for n in nodes if (n.tag == tag if tag else any(map(n.has, names)))), None)
        return node.text if node else ""

    told = lambda value: str(value) if value else ""
    raw = t._strip(told(data.get("name")) or meta("og:title") or shown("item-name") or shown(tag="h1"))
    key = f"{url.host}{':' + url.port if url.port else ''}{url.path}"
    if not raw or not title_of(raw) or size(key) > MOST_ID:
        return None
    inner = lambda k: told((_object(data.get(k)) or {}).get("name"))
    author = t._strip(inner("brand") or inner("author") or shown("shop-name") or shown("user-name") or meta("author") or t.UNKNOWN)
    about = ("item-description", "js-item-description", "description-text")
    summary = t._strip(told(data.get("description")) or meta("og:description") or shown(*about) or meta("description"))
    words = data.get("keywords") or meta("keywords")
    tags = [t._strip(w) for w in (words if isinstance(words, list) else re.split("[,;]+", words)) if isinstance(w, str)]
    tags += [t._strip(n.text) for n in nodes if n.tag == "a" and n.within("item-tags", "tag-list", "tags", "tag")]
    links = [n.attrs["href"] for n in nodes if n.tag == "a" and "href" in n.attrs and n.within(*about)]
    updated = iso_date(told(data.get("dateModified")) or meta("article:modified_time") or shown("item-created-date"))
    return _observation(key, raw, author, summary, [data.get("url"), job.url, *links], updated, platform_tags=list(dict.fromkeys(filter(None, tags)))[:MOST_TAGS] or None)


def browse(job: Job, body: str) -> list[dict] | None:
    """Item links of a market's browse page (S-9)."""
    if job.platform != "booth" or job.purpose != "discovery" or not re.fullmatch(r"https://booth\.pm/(?:ja|en)/browse/[A-Za-z0-9._~%-]+\?page=[1-9]\d{0,2}", job.url, re.A):
        return None
    items: dict[str, None] = {}
    for node in tree(body).walk():
        if node.tag == "a" and node.attrs.get("href"):
            url = Url.parse(urljoin(job.url, node.attrs["href"]))
            match = re.fullmatch(r"/(?:ja/|en/)?items/([1-9]\d{0,17})/?", url.path, re.A) if url and url.origin == "https://booth.pm" and not url.user else None
            if match:
                items[match[1]] = None
    return None if len(items) > MOST else [{"kind": "storefront_product", "url": f"https://booth.pm/ja/items/{i}", "claimed_package_id": None} for i in items]


def sitemap(job: Job, body: str) -> list[dict] | None:
    """Product links of a shop's sitemap (S-10); nothing with declarations, an index, or a missing end."""
    if job.platform != "shopify" or job.purpose != "discovery" or not re.fullmatch(r"https://[a-z0-9.-]+/sitemap_products_[1-9]\d*\.xml(?:\?from=[1-9]\d*&to=[1-9]\d*)?", job.url, re.A):
        return None
    if re.search("<!DOCTYPE|<!ENTITY", body, re.I) or not re.search(r"</urlset>\s*$", body):
        return None
    try:
        root = ElementTree.fromstring(body.strip().encode())
    except ElementTree.ParseError:
        return None
    local = lambda e: e.tag.rpartition("}")[2]
    if local(root) != "urlset" or any(local(e) in ("urlset", "sitemapindex") for e in list(root.iter())[1:]):
        return None
    places: dict[str, None] = {}
    for entry in root:
        loc = next((e for e in entry if local(e) == "loc"), None) if local(entry) == "url" else None
        place = t._strip(loc.text or "") if loc is not None else ""
        url = Url.parse(place)
        if url and url.href == place and url.origin == job.origin and len(place) <= 1000 and not (url.user or url.query or url.fragment) and re.fullmatch(r"/(?:[a-z]{2}(?:-[a-z]{2})?/)?products/[a-z0-9][a-z0-9-]*", url.path):
            places[place] = None
    return None if len(places) > MOST else [{"kind": "storefront_product", "url": u, "claimed_package_id": None} for u in places]


def curated(job: Job, body: str, content_type: str = "") -> list[dict] | None:
    """Leads of a community list (S-11): a recipe, else a line for each URL, else the URLs in a page."""
    if job.platform != "curated" or job.purpose != "discovery":
        return None
    if leads := recipe(job, body):
        return leads
    found: list[tuple[str, str]] = []
    for line in re.split(r"[\r\n]+", body):
        line = t._strip(line)
        url = Url.parse(line) if line and not line.startswith("#") else None
        if url and url.scheme == "https":
            if url.host == "github.com" and re.fullmatch(f"/{_PART}/{_PART}", url.path):
                found.append(("github_repository", url.href))
            elif url.path.endswith(".json"):
                found.append(("vpm_listing", url.href))
    if not found and ("html" in content_type or "http" in body):
        for match in re.findall(r"https://[A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.~!$&'()*+,;=:@%-]+)+", body):
            url = Url.parse(match)
            repo = re.match(f"/({_PART})/({_PART})", url.path) if url and url.host == "github.com" else None
            if repo and repo[1] not in ("topics", "search"):
                found.append(("github_repository", f"https://github.com/{repo[1]}/{repo[2]}"))
            elif url and url.host != "github.com" and url.path.endswith(("/index.json", "/vpm.json", "/packages.json")):
                found.append(("vpm_listing", url.href))
    return [{"kind": k, "url": u, "claimed_package_id": None} for k, u in dict.fromkeys(found[:MOST])] or None
