r"""URLs: parts, identities, tracking parameters, target classes.

The source parses URLs as browsers do. Where an href is the result, an Arrow function re-serialises it; where only a
predicate is asked for, one anchored pattern over the string decides, and Catalyst sees a Column expression.
"""

from __future__ import annotations

import re
from urllib.parse import quote, quote_plus, unquote_plus

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import arrow_function

# Query parameters that track, and prefixes of such.
TRACKING = frozenset("utm_source utm_medium utm_campaign utm_term utm_content ref aff affiliate fbclid gclid token source msclkid twclid igshid mc_eid _ga _gl spm si session_id feature".split())
TRACKING_PREFIXES = ("utm_", "aff_", "ref_")
# Default ports and the characters that stay as they are in each part.
PORTS = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443"}
PATH_SAFE, QUERY_SAFE, FRAGMENT_SAFE = "/%:@!$&'()*+,;=-._~[]|^\\", "/%:@!$&()*+,;=-._~?[]|^\\`{}", "/%:@!$&'()*+,;=-._~?[]|^\\{}#"
LINKS = 100

_SPECIAL = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):[/\\]{2,}([^/\\?#]*)([^?#]*)(\?[^#]*)?(#.*)?", re.S)
_OTHER = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):([^?#]*)(\?[^#]*)?(#.*)?", re.S)
_HOST = re.compile(r"[^\x00-\x20#%/:<>?@\[\\\]^|]+|\[[0-9A-Fa-f:.]+\]")


class Url:
    """A URL as browsers read it; :meth:`parse` gives None for what they reject."""

    def __init__(self, scheme: str, user: str, host: str, port: str, path: str, query: str, fragment: str):
        self.scheme, self.user, self.host, self.port, self.path, self.query, self.fragment = scheme, user, host, port, path, query, fragment

    @staticmethod
    def parse(text: str | None) -> Url | None:
        text = re.sub(r"[\t\n\r]", "", (text or "").strip("".join(map(chr, range(33)))))
        match = _SPECIAL.fullmatch(text)
        if not match or match[1].lower() not in PORTS:
            other = _OTHER.fullmatch(text)
            if not other or other[1].lower() in PORTS:
                return None
            return Url(other[1].lower(), "", "", "", other[2], other[3] or "", other[4] or "")
        scheme, authority, path, query, fragment = match[1].lower(), match[2], match[3] or "", match[4] or "", match[5] or ""
        user, _, place = authority.rpartition("@")
        host, port = (place, "") if place.endswith("]") or ":" not in place else place.rsplit(":", 1)
        host = host.lower()
        if not host.isascii():
            try:
                host = host.encode("idna").decode()
            except UnicodeError:
                return None
        if not _HOST.fullmatch(host) or (port and not (port.isdigit() and int(port) < 65536)):
            return None
        port = "" if not port or PORTS[scheme] == str(int(port)) else str(int(port))
        parts: list[str] = []
        raw = path.replace("\\", "/").split("/")[1:] or [""]
        for k, part in enumerate(raw):
            dots = part.lower().replace("%2e", ".")
            if dots == ".." and parts:
                parts.pop()
            if dots in (".", ".."):
                if k == len(raw) - 1:
                    parts.append("")
            else:
                parts.append(quote(part, safe=PATH_SAFE))
        return Url(scheme, user, host, port, "/" + "/".join(parts), quote(query, safe=QUERY_SAFE) if len(query) > 1 else "", quote(fragment, safe=FRAGMENT_SAFE) if len(fragment) > 1 else "")

    @property
    def origin(self) -> str:
        return f"{self.scheme}://{self.host}{':' + self.port if self.port else ''}"

    @property
    def href(self) -> str:
        if self.scheme not in PORTS:
            return f"{self.scheme}:{self.path}{self.query}{self.fragment}"
        user = f"{self.user}@" if self.user else ""
        return f"{self.scheme}://{user}{self.host}{':' + self.port if self.port else ''}{self.path}{self.query}{self.fragment}"


def _tracks(key: str) -> bool:
    low = key.lower()
    return low in TRACKING or low.startswith(TRACKING_PREFIXES)


def without_tracking(text: str | None) -> str:
    """A URL without tracking parameters; what isn't a URL comes back as it was (F-17)."""
    url = Url.parse(text)
    if not text or url is None:
        return text or ""
    pairs = [tuple(map(unquote_plus, p.partition("=")[::2])) for p in url.query[1:].split("&") if p]
    if any(_tracks(k) for k, _ in pairs):
        kept = "&".join(f"{quote_plus(k, safe='*-._')}={quote_plus(v, safe='*-._')}" for k, v in pairs if not _tracks(k)).replace("~", "%7E")
        url.query = f"?{kept}" if kept else ""
    href = url.href
    return href[:-1] if href.endswith("/") and url.path == "/" and not text.endswith("/") else href


@arrow_function("string")
def clean_tracking(url: pd.Series) -> pd.Series:
    """:func:`without_tracking` in Arrow batches."""
    return url.map(without_tracking)


def https_links_of(values: list[str | None] | None) -> list[str]:
    """Clean https links, each once in order, 100 at most (F-18)."""
    clean = [without_tracking(v) for v in values or [] if isinstance(v, str)]
    return list(dict.fromkeys(v for v in clean if (u := Url.parse(v)) and u.scheme == "https"))[:LINKS]


@arrow_function("array<string>")
def https_links(values: pd.Series) -> pd.Series:
    """:func:`https_links_of` in Arrow batches."""
    return values.map(lambda v: https_links_of(None if v is None else list(v)))


def clean_query(url: Column) -> Column:
    """Tracking parameters dropped by splitting the query, for URLs that are serialised already: the native form of F-17."""
    head, query, fragment = F.regexp_extract(url, r"^([^?#]*)", 1), F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), F.regexp_extract(url, r"(#.*)$", 1)
    key = lambda p: F.lower(F.substring_index(p, "=", 1))
    kept = F.array_join(F.filter(F.split(query, "&", -1), lambda p: (p != "") & ~key(p).isin(*sorted(TRACKING)) & ~key(p).rlike("^(utm|aff|ref)_")), "&")
    return F.concat(head, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)), fragment)


def normal_identity(url: Column) -> Column:
    """Lower case, without slashes at the end and ``.git``: how identities are matched (F-19)."""
    return F.regexp_replace(F.regexp_replace(F.lower(url), "/+$", ""), r"\.git$", "")


def github_api_url(url: Column) -> Column:
    """github.com/owner/name as the REST URL of the repository; other URLs as they are (F-20)."""
    return F.regexp_replace(url, r"(?i)^https://github\.com/([^/]+)/([^/?#]+?)(?:\.git)?/?$", "https://api.github.com/repos/$1/$2")


def github_repository(url: Column) -> Column:
    """owner/name of a REST repository URL, or null (P-7)."""
    found = F.regexp_extract(url, r"^https://api\.github\.com/repos/([A-Za-z0-9][A-Za-z0-9-]{0,38}/[A-Za-z0-9_.-]{1,100})$", 1)
    return F.when((found != "") & ~found.rlike(r"/\.\.?$"), found)


def is_booth_browse(url: Column) -> Column:
    """A category page of the market (P-8)."""
    return url.rlike(r"^https://booth\.pm/(?:ja|en)/browse/[A-Za-z0-9._~%-]+\?page=[1-9][0-9]{0,2}$") & ~url.rlike(r"/browse/\.{1,2}\?")


def booth_item(url: Column) -> Column:
    """The item number of an item URL, or null (P-8)."""
    return F.nullif(F.regexp_extract(url, r"^https://booth\.pm/(?:ja/|en/)?items/([1-9][0-9]{0,17})/?$", 1), F.lit(""))


def is_shopify_sitemap(url: Column) -> Column:
    """A product sitemap of a shop (P-9)."""
    return url.rlike(r"^https://[a-z0-9.-]+/sitemap_products_[1-9][0-9]*\.xml(?:\?from=[1-9][0-9]*&to=[1-9][0-9]*)?$")


def shopify_product(url: Column, origin: Column) -> Column:
    """A product URL on the reviewed origin, or null (P-9)."""
    path = F.substr(url, F.length(origin) + 1, F.length(url))
    return F.when((F.length(url) <= 1000) & F.startswith(url, origin) & path.rlike(r"^/(?:[a-z]{2}(?:-[a-z]{2})?/)?products/[a-z0-9][a-z0-9-]*$"), url)


_SELLFY = r"^https://([A-Za-z0-9.-]+)(?:/([A-Za-z0-9_.-]+))?/p/([A-Za-z0-9_.-]+)/?$"


def sellfy_product(url: Column) -> Column:
    """host[:shop]:product of a product URL, or null (P-10)."""
    part = lambda k: F.nullif(F.regexp_extract(url, _SELLFY, k), F.lit(""))
    return F.when(url.rlike(_SELLFY), F.concat_ws(":", F.lower(part(1)), part(2), part(3)))


def is_custom_product(url: Column) -> Column:
    """An https URL with a path and nothing else (P-11)."""
    return url.rlike(r"^https://[^/:@?#]+/[^?#]+$")


def is_itch_search(url: Column) -> Column:
    """The market's search (P-12)."""
    return url.rlike(r"^https?://itch\.io/search")


def is_safe_redirect(url: Column) -> Column:
    """https at its own port, without credentials and fragment, not the local host (P-21)."""
    return url.rlike(r"^https://[^/:@?#]+(?::443)?(?:[/?][^#]*)?$") & ~url.rlike(r"^https://localhost(?:[:/?]|$)")


# Hosts of storefronts, a host whose subdomains are storefronts, and suffixes of archives.
STOREFRONTS = ("booth.pm", "gumroad.com", "jinxxy.com", "sellfy.com", "payhip.com")
STOREFRONT_PARENT = "itch.io"
ARCHIVES = r"(?i)\.(?:zip|unitypackage|tar\.gz)$"


def lead_kind(url: Column) -> Column:
    """What an outbound link may lead to: a repository, a storefront, a publisher's site, or nothing (P-6)."""
    host = F.lower(F.regexp_extract(url, r"^https://([^/:?#@]+)(?::443)?(?:[/?#]|$)", 1))
    path = F.regexp_extract(url, r"^https://[^/?#]+([^?#]*)", 1)
    repository = path.rlike(r"^/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+(?:/.*)?$") & ~path.rlike(r"^/\./|^/[^/]+/\.(?:/|$)")
    private = host.contains("localhost") | F.endswith(host, F.lit(".internal")) | F.endswith(host, F.lit(".local"))
    return (
        F.when((host == "") | path.rlike(ARCHIVES), F.lit(None).cast("string"))
        .when((host == "github.com") & repository, "github_repository")
        .when(host.isin(*STOREFRONTS) | F.endswith(host, F.lit("." + STOREFRONT_PARENT)), "storefront_product")
        .when(host.contains(".") & ~private, "publisher_site")
    )


def join_endpoint(base: Column, path: Column) -> Column:
    """A path below a base URL, whose own path stays (F-37)."""
    root, own = F.regexp_extract(base, r"^([^:]+://[^/?#]+)", 1), F.regexp_replace(F.regexp_extract(base, r"^[^:]+://[^/?#]+([^?#]*)", 1), "/+$", "")
    return F.concat(root, own, F.lit("/"), F.regexp_replace(path, "^/+", ""))
