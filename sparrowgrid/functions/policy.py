r"""Policy predicates: addresses, access failures, robots rules, profiles, tokens, schedules."""

from __future__ import annotations

import re
from datetime import datetime
from functools import lru_cache
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import arrow_function

# Platforms in their order, storefronts among them, and the crawler's tokens.
PLATFORMS = ("booth", "github", "vpm", "gumroad", "jinxxy", "itch", "curated", "shopify", "sellfy", "custom_domain")
STOREFRONTS = tuple(p for p in PLATFORMS if p not in ("github", "vpm", "curated"))
# IPv4 ranges that are private or reserved, as first and last address.
RESERVED_V4 = ("0.0.0.0-0.255.255.255", "10.0.0.0-10.255.255.255", "100.64.0.0-100.127.255.255", "127.0.0.0-127.255.255.255", "169.254.0.0-169.254.255.255", "172.16.0.0-172.31.255.255", "192.0.0.0-192.0.0.255", "192.0.2.0-192.0.2.255", "192.168.0.0-192.168.255.255", "198.18.0.0-198.19.255.255", "198.51.100.0-198.51.100.255", "203.0.113.0-203.0.113.255", "224.0.0.0-255.255.255.255")


def _number(address: str) -> int:
    a, b, c, d = map(int, address.split("."))
    return a << 24 | b << 16 | c << 8 | d


_RANGES = tuple(tuple(map(_number, r.split("-"))) for r in RESERVED_V4)


def is_reserved_v4(address: Column) -> Column:
    """Private, reserved or malformed IPv4 (P-13, native)."""
    part = F.split(address, r"\.", -1)
    good = (F.size(part) == 4) & F.forall(part, lambda p: p.rlike("^[0-9]{1,3}$") & (F.try_to_number(p, F.lit("999")) <= 255))
    value = F.aggregate(part, F.lit(0).cast("long"), lambda s, p: s * 256 + F.coalesce(F.expr("cast(null as bigint)"), p.try_cast("long"), F.lit(0)))
    inside = F.lit(False)
    for low, high in _RANGES:
        inside = inside | value.between(low, high)
    return F.coalesce(~good | inside, F.lit(True))


def reserved_address(text: str | None) -> bool:
    """Private, reserved or malformed address, IPv4 or IPv6; embedded IPv4 addresses are judged as such (P-13)."""
    clean = re.sub(r"^\[|\]$", "", (text or "").strip())
    if clean in ("", "localhost"):
        return True
    if ":" not in clean:
        return "." not in clean or _reserved_quad(clean)
    clean = clean.lower()
    head, _, tail = clean.rpartition(":")
    if "." in tail:
        if _reserved_quad(tail):
            return True
        n = _number(tail)
        clean = f"{head}:{n >> 16:x}:{n & 0xFFFF:x}"
    sides = clean.split("::")
    if len(sides) > 2:
        return True
    try:
        groups = [[int(g or "0", 16) for g in s.split(":")] if s or len(sides) == 1 else [] for s in sides]
    except ValueError:
        return True
    whole = groups[0] if len(sides) == 1 else groups[0] + [0] * max(0, 8 - len(groups[0]) - len(groups[1])) + groups[1]
    if len(whole) != 8 or any(not 0 <= g <= 0xFFFF for g in whole):
        return True
    value = int.from_bytes(b"".join(g.to_bytes(2, "big") for g in whole), "big")
    if value < 2 or value >> 32 in (0, 0xFFFF):
        return value < 2 or any(low <= value & 0xFFFFFFFF <= high for low, high in _RANGES)
    top = whole[0]
    return top >> 9 == 0x7E or top >> 6 in (0x3FA, 0x3FB) or top >> 8 == 0xFF or whole[:2] == [0x2001, 0x0DB8] or (top == 0x0100 and whole[1] >> 8 == 0)


def _reserved_quad(text: str) -> bool:
    parts = text.split(".")
    if len(parts) != 4 or not all(p.isdigit() and int(p) < 256 for p in parts):
        return True
    return any(low <= _number(text) <= high for low, high in _RANGES)


@arrow_function("boolean")
def is_reserved_address(address: pd.Series) -> pd.Series:
    """:func:`reserved_address` in Arrow batches."""
    return address.map(reserved_address)


def is_ip(text: Column) -> Column:
    """Four numbers, or anything with a colon (P-14)."""
    return text.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$") | text.contains(":")


CHALLENGE = r"(?i)challenges\.cloudflare\.com/turnstile|cf-mitigated:\s*challenge|/cdn-cgi/challenge-platform/"


def access_failure(status: Column, headers: Column, body: Column | None = None) -> Column:
    """challenge, rate_limited, forbidden or null, in that order of precedence (P-15). ``headers``: map with lower-case keys."""
    header = lambda name: F.try_element_at(headers, F.lit(name))
    challenge = F.coalesce(F.lower(F.trim(header("cf-mitigated"))) == "challenge", F.lit(False))
    if body is not None:
        challenge = challenge | F.coalesce(body.rlike(CHALLENGE), F.lit(False))
    spent = header("retry-after").isNotNull() | F.coalesce(header("x-ratelimit-remaining") == "0", F.lit(False))
    return F.when(challenge, "challenge").when(status == 429, "rate_limited").when((status == 403) & spent, "rate_limited").when(status == 403, "forbidden")


def retry_after_seconds(headers: Column, now: Column, fallback: int = 300) -> Column:
    """Seconds to wait: Retry-After as a number or date, or the limit's reset, a day at most (F-29)."""
    header = lambda name: F.try_element_at(headers, F.lit(name))
    raw = header("retry-after")
    epoch = F.unix_millis(now) / 1000
    date = F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(raw, r"^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss")))
    first = F.coalesce(raw.try_cast("double"), date - epoch)
    reset = F.when(header("x-ratelimit-remaining") == "0", header("x-ratelimit-reset").try_cast("double") - epoch)
    capped = lambda s: F.when(s > 0, F.least(F.lit(86_400), F.ceil(s)))
    return F.coalesce(capped(first), capped(reset), F.lit(fallback)).cast("long")


def is_transient_status(status: Column) -> Column:
    """Edge failures worth a retry (P-20)."""
    return status.between(502, 504) | status.between(520, 524)


def is_coordinator_endpoint(url: Column) -> Column:
    """https, or http on the loopback (P-20)."""
    return url.rlike(r"^https://[^/]") | url.rlike(r"^http://(?:localhost|127\.0\.0\.1|\[::1\])(?:[:/]|$)")


# ---- Robots (RFC 9309)


@lru_cache(maxsize=4096)
def robots_groups(body: str) -> dict[str, tuple[tuple[bool, str], ...]]:
    """Rules (allow, pattern) by lower-case agent; groups of one agent are merged."""
    groups: dict[str, list[tuple[bool, str]]] = {}
    agents: list[str] = []
    in_rules = False
    for line in body.replace("\r", "\n").split("\n"):
        name, colon, value = line.split("#", 1)[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            continue
        if name == "user-agent":
            agents = [value.lower()] if in_rules else [*agents, value.lower()]
            in_rules = False
            groups.setdefault(value.lower(), [])
        elif name in ("allow", "disallow"):
            in_rules = True
            if value:
                for a in agents:
                    groups[a].append((name == "allow", value))
    return {k: tuple(v) for k, v in groups.items()}


@lru_cache(maxsize=65_536)
def _matcher(pattern: str) -> re.Pattern:
    end = pattern.endswith("$")
    encoded = quote(pattern[:-1] if end else pattern, safe="%/:?#[]@!$&'()*+,;=-._~")
    return re.compile(".*".join(map(re.escape, encoded.split("*"))) + ("$" if end else ""), re.S)


def robots_allow(body: str, agent: str, path: str) -> bool:
    """Whether an agent may fetch a path: the longest rule of its group wins, and allow wins ties."""
    groups = robots_groups(body)
    rules = groups.get(agent.lower(), groups.get("*", ()))
    target = quote(path or "/", safe="%/:?#[]@!$&'()*+,;=-._~")
    if target == "/robots.txt":
        return True
    best = max(((len(p), allow) for allow, p in rules if _matcher(p).match(target)), default=(0, True))
    return best[1]


def robots_verdict(status: int | None, body: str | None, url: str, agents: tuple[str, ...]) -> bool:
    """No file allows; a failing one denies; else every agent has to be allowed (P-16)."""
    if status in (404, 410):
        return True
    if status is None or not 200 <= status < 300:
        return False
    path = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "", url).split("#")[0]
    path = path if path.startswith("/") else "/" + path
    return all(robots_allow(body or "", a, path) for a in agents)


def robots_allows(agents: tuple[str, ...]):
    """An Arrow function (status, body, url) -> boolean; parsed files are kept by each worker."""

    @arrow_function("boolean")
    def allows(status: pd.Series, body: pd.Series, url: pd.Series) -> pd.Series:
        return pd.Series([robots_verdict(None if pd.isna(s) else int(s), b, u, agents) for s, b, u in zip(status, body, url, strict=True)])

    return allows


# ---- Profiles and rules


def profile_matches(job: dict[str, Column], profile: dict[str, Column], now: Column) -> Column:
    """Whether a reviewed source profile covers a job (P-1). ``job``: platform, purpose, origin, path, query; ``profile``: its columns."""
    exact = profile["path_scope"] == job["path"]
    inside = F.endswith(profile["path_scope"], F.lit("/")) & F.startswith(job["path"], profile["path_scope"]) & ~job["path"].contains("%")
    return (
        (profile["platform"] == job["platform"]) & (profile["purpose"] == job["purpose"]) & (profile["method"] == "GET")
        & profile["disabled_at"].isNull() & (profile["expires_at"] > now) & (profile["origin"] == job["origin"]) & F.startswith(job["origin"], F.lit("https://"))
        & is_canonical_path(job["path"]) & (F.coalesce(profile["query_scope"], F.lit("")) == F.coalesce(job["query"], F.lit(""))) & (exact | inside)
    )


def is_canonical_path(path: Column) -> Column:
    """A path that serialises to itself: known characters, no empty or dot segments, escapes of non-ASCII bytes only (P-4)."""
    return path.rlike(r"^/(?:[A-Za-z0-9._~!$&'()*+,;=:@/-]|%[89A-F][0-9A-F])*$") & ~path.contains("//") & ~path.rlike(r"/\.{1,2}(?:/|$)")


def scopes_overlap(path_a: Column, query_a: Column, path_b: Column, query_b: Column) -> Column:
    """Equal queries, and equal paths or one a folder of the other (P-3)."""
    folder = lambda a, b: F.endswith(a, F.lit("/")) & F.startswith(b, a) & ~b.contains("%") & ~a.contains("%")
    return (F.coalesce(query_a, F.lit("")) == F.coalesce(query_b, F.lit(""))) & ((path_a == path_b) | folder(path_a, path_b) | folder(path_b, path_a))


def observation_matches(platform: Column, release: Column, releases: Column) -> Column:
    """Package listings have one form of release evidence at most, other platforms have none (P-5)."""
    return F.when(platform == "vpm", ~(release.isNotNull() & releases.isNotNull())).otherwise(release.isNull() & releases.isNull())


# ---- Times


def next_fetch_at(outcome: Column, at: Column, retry_seconds: Column) -> Column:
    """When a job is due again after an outcome (F-33)."""
    seconds = F.when(outcome == "rate_limited", retry_seconds).when(outcome == "temporary_failure", 900).when(outcome == "blocked", 3 * 86_400).otherwise(86_400)
    return F.timestamp_millis(F.unix_millis(at) + seconds.cast("long") * 1000)


def job_state(outcome: Column) -> Column:
    """A job's state after an outcome (D-12)."""
    return F.when(outcome == "blocked", "blocked").when(outcome.isin("rate_limited", "temporary_failure"), "backoff").otherwise("done")


def robots_expiry(status: Column, at: Column) -> Column:
    """A day for usable answers, an hour for failing ones (F-34)."""
    usable = status.between(200, 299) | status.isin(404, 410)
    return F.timestamp_millis(F.unix_millis(at) + F.when(usable, 86_400_000).otherwise(3_600_000).cast("long"))


def client_retry_ms(attempt: Column, base_ms: int = 250, most_ms: int = 2_000) -> Column:
    """The wait before a client's next attempt (F-38)."""
    return F.least(F.lit(base_ms) * F.pow(F.lit(2), attempt - 1), F.lit(most_ms)).cast("long")


# Hosts and aliases whose pacing is configured under one name.
HOST_ALIASES = (("booth", "booth.pm"), ("gumroad", "gumroad.com"), ("github", "api.github.com"), ("jinxxy", "jinxxy.com"), ("itch", "itch.io"))


def normal_host(name: Column) -> Column:
    """The name under which a host or alias is paced (F-35)."""
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    out = F.when(low.rlike("^https?://"), F.coalesce(F.nullif(F.regexp_extract(low, r"^https?://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")), low))
    for alias, target in HOST_ALIASES:
        out = out.when((low == alias) | (F.startswith(low, F.lit("gumroad:")) if alias == "gumroad" else F.lit(False)), target)
    return out.otherwise(low)


def iso_text(at: Column) -> Column:
    """A time as ISO text with milliseconds, whose order is the times' order."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def normalized_date(text: Column) -> Column:
    """A date in one of the usual forms as ISO text, or null (F-28)."""
    forms = ("yyyy-MM-dd'T'HH:mm:ss[.SSS][XXX]", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "EEE, dd MMM yyyy HH:mm:ss z", "dd MMM yyyy HH:mm:ss", "MMM d, yyyy", "yyyy/MM/dd")
    clean = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3}, | GMT$", "")
    return iso_text(F.coalesce(*[F.try_to_timestamp(clean, F.lit(f)) for f in forms if "EEE" not in f]))


def utc(text: str) -> datetime:
    """An ISO text as a time without zone."""
    return datetime.fromisoformat(text.replace("Z", "+00:00")).replace(tzinfo=None)
