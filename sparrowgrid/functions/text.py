r"""Text hygiene: entities, titles, authors, descriptions, READMEs.

White space is the wide class of the source's regular expressions, which the JVM's ``\s`` is not; word borders are ASCII.
Everything but Unicode normalisation (which Spark lacks) and paragraph assembly is a Column expression.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import arrow_function

# The white space of the source's regular expressions.
SPACE = "\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
# Entities, in the order in which they are replaced.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&#x2F;", "/"), ("&nbsp;", " "))
# What a listing's brackets advertise.
PLATFORM_LABELS = "VRC(?:hat)?|Unity|3Dモデル|3D衣装|VRC想定|3Dシステム|3Dアバター|VRC向け"
OFFER_LABELS = "無料|FREE|Free|Sale|セール|VerUP|早急用|簡単導入|全アバター対応|汎用|MA対応|Modular Avatar対応|VRCFury対応|非公式"
INNER_LABELS = "VRC(?:hat)?|Unity|3Dモデル|3D衣装|無料|FREE|Free|Sale|セール|VerUP|早急用"
BRACKETED = (r"【[^】]*】", r"\[[^\]]*\]", r"[（(][^）)]*[）)]")

_W = f"[{SPACE}]"


@arrow_function("string")
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode NFKC, in Arrow batches; ASCII passes as it is."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def trim(text: Column) -> Column:
    """Without wide white space at either end."""
    return F.regexp_replace(text, f"^{_W}+|{_W}+$", "")


def blank_to_null(text: Column) -> Column:
    """The trimmed text, or null if nothing is left (F-16)."""
    return F.nullif(trim(text), F.lit(""))


def squeeze(text: Column) -> Column:
    """Runs of white space as single blanks, trimmed."""
    return trim(F.regexp_replace(text, f"{_W}+", " "))


def unescape_html(text: Column) -> Column:
    """Eight entities in a fixed order; the ampersand comes first, so doubly escaped text is unescaped twice. Null is empty (F-1)."""
    out = F.coalesce(text, F.lit(""))
    for entity, character in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(character))
    return out


def _without_brackets(text: Column) -> Column:
    for pattern in BRACKETED:
        text = F.regexp_replace(text, pattern, " ")
    return text


def clean_title(raw: Column) -> Column:
    """A listing's title without advertising brackets, other brackets and a version at its end (F-2)."""
    title = nfkc(unescape_html(raw))
    both = ((r"^[【\[(]?", PLATFORM_LABELS), (r"^[【\[(]?", OFFER_LABELS))
    for _ in range(3):
        for opening, labels in both:
            title = F.regexp_replace(title, f"(?i){opening}(?:{labels})[】\\])]{_W}*", " ")
            title = F.regexp_replace(title, f"(?i)[【\\[(]?(?:{labels})[】\\])]$", " ")
        title = F.regexp_replace(title, f"(?i){_W}*[【\\[(](?:{INNER_LABELS})[】\\])]", " ")
    title = F.regexp_replace(_without_brackets(title), f"(?i){_W}+v?[0-9]+\\.[0-9]+(?:\\.[0-9]+)?(?:{_W}*beta|{_W}*alpha)?$", "")
    return F.coalesce(F.nullif(squeeze(title), F.lit("")), trim(unescape_html(raw)))


def normalize_listing_title(title: Column) -> Column:
    """NFKC, without bracketed parts, white space squeezed (F-3)."""
    return squeeze(_without_brackets(nfkc(F.coalesce(title, F.lit("")))))


def clean_author_name(raw: Column) -> Column:
    """A name without tags, parentheses and handles; ``Unknown`` if nothing is left (F-4)."""
    name = F.regexp_replace(F.regexp_replace(nfkc(unescape_html(raw)), "<[^>]+>", ""), r"\([^)]+\)", "")
    handle = name.rlike(f"^{_W}*[@#]")
    name = F.when(handle, F.regexp_replace(name, f"^{_W}*[@#]+", "")).otherwise(F.regexp_replace(name, f"{_W}+[@#][^\\n\\r\\u2028\\u2029]*$", ""))
    return F.coalesce(F.nullif(squeeze(name), F.lit("")), F.lit("Unknown"))


def clean_description(raw: Column) -> Column:
    """A description without image embeds and chat invitations; lines keep, blank ones collapse (F-5)."""
    text = F.regexp_replace(unescape_html(raw), "!\\[[^\\n\\r\u2028\u2029]*?\\]\\([^\\n\\r\u2028\u2029]*?\\)", "")
    text = trim(F.regexp_replace(text, rf"(?i)https?://(?:discord\.gg|discord(?:app)?\.com/invite)/[^{SPACE}]+", ""))
    across = SPACE.replace("\n", "").replace("\r", "")
    text = F.replace(F.regexp_replace(text, f"[{across}]+", " "), F.lit("\r\n"), F.lit("\n"))
    return trim(F.regexp_replace(text, f"\n{_W}*\n{_W}*\n+", "\n\n"))


# ---- README assembly: paragraphs depend on those before them, so it runs in an Arrow UDF.

_JS = re.compile(_W + "+")
_CUTS = tuple(re.compile(p, f) for p, f in (
    (r"<!--.*?-->", re.S), (r"```.*?```", re.S), (r"\[!\[.*?\]\(.*?\)\](?:\(.*?\))?", 0), (r"!\[.*?\]\(.*?\)", 0), (r"<img[^>]*>", re.I),
))
_SECTIONS = re.compile(rf"\n#{{1,3}}{_W}+(?:license|contributing|changelog|release notes|sponsors|donations|acknowledgements|credits)(?![A-Za-z0-9_]).*", re.I | re.S)
_CONTENTS = re.compile(rf"[-*+]{_W}*\[.*?\]\(#.*?\)")
_ORNAMENT = re.compile(r"https?://(?:img\.shields\.io|badge|github\.com/[^/]+/[^/]+/actions)|-{3,}|\*{3,}|_{3,}")
README_TARGET, README_SHORT, README_SENTENCE, README_TITLE, README_TOTAL = 2000, 600, 50, 50, 2500


def _strip(text: str) -> str:
    return re.sub(f"^{_W}+|{_W}+$", "", text)


def _described(text: str) -> str:
    text = re.sub(r"!\[.*?\]\(.*?\)", "", _entities(text))
    text = _strip(re.sub(rf"https?://(?:discord\.gg|discord(?:app)?\.com/invite)/[^{SPACE}]+", "", text, flags=re.I))
    across = SPACE.replace("\n", "").replace("\r", "")
    text = re.sub(f"[{across}]+", " ", text).replace("\r\n", "\n")
    return _strip(re.sub(f"\n{_W}*\n{_W}*\n+", "\n\n", text))


def _entities(text: str) -> str:
    for entity, character in ENTITIES:
        text = text.replace(entity, character)
    return text


def _paragraphs(text: str) -> list[str]:
    found = []
    for block in re.split(f"\n{_W}*\n", text):
        lines = [x for x in map(_strip, block.split("\n")) if x]
        if not lines or all(_CONTENTS.fullmatch(x) for x in lines) or all(_ORNAMENT.match(x) for x in lines):
            continue
        shown = (re.sub(f"^#{{1,6}}{_W}+", "", x) for x in lines)
        joined = _strip("\n".join(re.sub(f"^[-*+]{_W}+", "- ", x) for x in shown))
        if joined:
            found.append(joined)
    if len(found) > 1 and "\n" not in found[0] and len(found[0]) < README_TITLE and not found[0].endswith("."):
        del found[0]
    return found


def readme_text(readme: str | None, synopsis: str | None) -> str:
    """The overview of a README, with a synopsis before it unless it repeats it."""
    lead = _described(synopsis) if synopsis else ""
    if not readme:
        return lead
    text = readme.replace("\r\n", "\n")
    for cut in _CUTS:
        text = cut.sub("", text)
    text = _entities(re.sub(r"<[^>]+>", " ", text))
    text = re.sub(r"`([^`]+)`", r"\1", re.sub(r"\[([^\]]+)\]\([^)]+\)", r"\1", text))
    out = ""
    for p in _paragraphs(_SECTIONS.sub("", text)):
        if out and len(out) + len(p) + 2 > README_TARGET:
            stop = p[: README_TARGET - len(out) - 2].rfind(".")
            if len(out) < README_SHORT and stop > README_SENTENCE:
                out += "\n\n" + p[: stop + 1]
            break
        out = f"{out}\n\n{p}" if out else p
    out = _described(out)
    if not lead or not out:
        return out or lead
    return out if lead.lower() in out.lower() else f"{lead}\n\n{out}"[:README_TOTAL]


@arrow_function("string")
def readme_description(readme: pd.Series, synopsis: pd.Series) -> pd.Series:
    """:func:`readme_text` in Arrow batches (F-6)."""
    return pd.Series([readme_text(r, s) for r, s in zip(readme, synopsis, strict=True)])


# ---- Authors

# Top-level domains that count as such, and name-space prefixes.
TLDS = frozenset("com net org edu gov mil int arpa io dev app me tech xyz art club space online site jp at de uk fr ru cn ca au eu us ch nl se no fi es it kr tw hk sg in br nz pl".split())
NAMESPACES = frozenset("users github gitlab codeberg".split())
OFFICIAL, COMMUNITY, UNKNOWN = "VRChat", "community", "Unknown"


def is_tld(segment: str) -> bool:
    """Whether a segment is a known top-level domain (F-8)."""
    return _strip(segment).lower() in TLDS


def reverse_dns_segments(name: str) -> list[str]:
    """A reverse-DNS name's segments from the first that is neither a top-level domain nor a name space (F-8)."""
    parts = [p for p in map(_strip, _strip(re.sub("^vpm:", "", name, flags=re.I)).split(".")) if p]
    start = next((k for k, p in enumerate(parts) if p.lower() not in TLDS | NAMESPACES), None)
    return parts if start is None else parts[start:]


def author_of(raw: str) -> str:
    """:func:`clean_author_name` for one string."""
    name = re.sub(r"\([^)]+\)", "", re.sub("<[^>]+>", "", unicodedata.normalize("NFKC", _entities(raw or ""))))
    name = re.sub(f"^{_W}*[@#]+", "", name) if re.match(f"{_W}*[@#]", name) else re.sub(f"{_W}+[@#].*$", "", name)
    return _strip(_JS.sub(" ", name)) or UNKNOWN


def authors_of(raw: str | None, package: str | None, repository: str | None, listed: list[str] | None) -> tuple[str, list[str]]:
    """(primary author, all authors) from the names given, the repository's owner and the package's name."""
    usable = lambda a: a and not is_tld(a) and a.lower() != UNKNOWN.lower()
    generic = lambda a: a.lower() in (OFFICIAL.lower(), COMMUNITY)
    named = dict.fromkeys(a for a in map(author_of, [x for x in listed or [] if x]) if usable(a))
    named |= dict.fromkeys(a for a in map(author_of, re.split(r"[,;/&]+", raw)) if usable(a)) if raw else {}
    match = re.search(r"github\.com/([a-zA-Z0-9_-]+)/", repository or "", re.I)
    owner = match[1] if match else None
    if owner and owner.lower() == OFFICIAL.lower():
        owner = OFFICIAL
    elif owner and (len(owner) < 2 or is_tld(owner)):
        owner = None
    name = re.sub("^vpm:", "", package or "", flags=re.I)
    official = name.startswith(("com.vrchat.", "vrchat."))
    primary = ""
    if official:
        primary = OFFICIAL
        named.setdefault(OFFICIAL)
    elif owner:
        primary = next((a for a in named if not generic(a)), owner)
        if all(map(generic, named)):
            named.setdefault(owner)
    if package and (not primary or generic(primary) or is_tld(primary)) and (segments := reverse_dns_segments(name)):
        first = segments[0]
        if first.lower() == OFFICIAL.lower():
            primary = OFFICIAL
        elif len(first) >= 2 and not is_tld(first):
            primary = first
    primary = primary or next(iter(named), author_of(raw or ""))
    if primary != UNKNOWN:
        named.setdefault(primary)
    shown = [a for a in named if a.lower() != COMMUNITY and (a.lower() != OFFICIAL.lower() or official or owner == OFFICIAL)]
    return primary, shown or [primary]


@arrow_function("struct<primary_author:string,all_authors:array<string>>")
def resolve_authors(raw: pd.Series, package: pd.Series, repository: pd.Series, listed: pd.Series) -> pd.DataFrame:
    """:func:`authors_of` in Arrow batches (F-7)."""
    rows = [authors_of(r, p, u, None if x is None else list(x)) for r, p, u, x in zip(raw, package, repository, listed, strict=True)]
    return pd.DataFrame(rows, columns=["primary_author", "all_authors"])
