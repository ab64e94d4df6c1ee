r"""Categories, umbrellas, systems, desktop tools and avatar bases from titles, descriptions and tags.

Ladders of rules become ``when`` chains over one lower-case text, so that Catalyst sees them whole. JavaScript's word
border is ASCII; the JVM's is not, so borders are written out as look-arounds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, nfkc, trim

_W = f"[{SPACE}]*"
_B, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def words(*choices: str) -> str:
    """A pattern for any of the choices between ASCII word borders; ``~`` in a choice is optional white space."""
    return f"{_B}(?:{'|'.join(c.replace('~', _W) for c in choices)}){_E}"


def normal_tags(tags: Column) -> Column:
    """Tags in NFKC and lower case, trimmed; null tags are empty."""
    joined = nfkc(F.array_join(F.transform(tags, lambda t: F.replace(F.coalesce(t, F.lit("")), F.lit("\x1f"), F.lit(" "))), "\x1f"))
    return F.when(F.size(tags) > 0, F.transform(F.split(F.lower(joined), "\x1f", -1), trim)).otherwise(F.array().cast("array<string>"))


def _first(tags: Column, rule, default: Column) -> Column:
    """The first tag's outcome that a ladder decides."""
    return F.coalesce(F.get(F.filter(F.transform(tags, rule), lambda x: x.isNotNull()), 0), default)


def _has(tag: Column, *parts: str) -> Column:
    out = tag.contains(parts[0])
    for p in parts[1:]:
        out = out | tag.contains(p)
    return out


def category_from_tags(tags: Column, default: Column) -> Column:
    """The category of the first tag that a rule knows; clothing keeps the default (F-10)."""
    rule = lambda t: (F.when(_has(t, "avatar"), "avatar_tool").when(_has(t, "shader"), "shader").when(_has(t, "world"), "world_tool").when(_has(t, "animation"), "animation_tool").when(_has(t, "physics", "physbone"), "physics_tool").when(_has(t, "clothing", "outfit", "cosmetic"), default))
    return _first(normal_tags(tags), rule, default)


def umbrella_from_tags(tags: Column, default: Column | None = None) -> Column:
    """tools, assets or avatars by the first tag that a rule knows (F-11)."""
    rule = lambda t: F.when(_has(t, "tool", "script", "system", "gimmick", "osc", "tracking"), "tools").when(_has(t, "shader", "texture", "material", "prop", "asset"), "assets").when(_has(t, "avatar", "clothing", "hair", "outfit", "cosmetic"), "avatars")
    return _first(normal_tags(tags), rule, F.lit("tools") if default is None else default)


def keywords(tags: Column) -> Column:
    """Trimmed tags of 1 to 100 characters, each once in order, 50 at most; null if none is left (F-15)."""
    kept = F.slice(F.array_distinct(F.filter(F.transform(F.filter(tags, lambda t: t.isNotNull()), trim), lambda t: F.length(t).between(1, 100))), 1, 50)
    return F.when(F.size(kept) > 0, kept)


def supported_os(text: Column) -> Column:
    """Systems that a text names; windows if it names none (F-12)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    # A border before ".exe" asks for a word character there.
    windows = low.rlike(words("windows", "win10", "win11", "win7", "win8")) | low.rlike(rf"(?<=[A-Za-z0-9_])\.exe{_E}")
    named = F.array_compact(F.array(F.when(windows, "windows"), F.when(low.rlike(words("linux", "ubuntu", "debian", "arch", "appimage", "flatpak")), "linux"), F.when(low.rlike(words("macos", "mac~os", "osx", "darwin")), "macos")))
    return F.when(F.size(named) > 0, named).otherwise(F.array(F.lit("windows")))


# The phrases of the desktop-tool rules.
SOFTWARE = ("executable", "desktop~app", "software", "application")
HARDWARE = ("base~station~mount", "wall~mount", "3d~print(?:able)?", "mount", "stand", "holder", "strap", "sensor~mount")
COSMETIC = ("avatar~clothing", "3d~model", "costume", "dress", "outfit", "texture~pack", "hair~mesh", "avatar~prefab")
RUNNING = ("executable", "desktop~app", "companion", "utility", "tracking")
EDITOR = ("unity~editor(?:~extension|~tool|~window|~script)?", "unitypackage", "ndmf~plugin", "modular~avatar~(?:module|setup)", "editor~hierarchy")
STANDALONE = ("standalone", "desktop~app", "executable", "electron", "wpf", "winforms", "tauri")
DESKTOP = ("desktop", "standalone", "companion", "executable", "app", "application", "client", "gui", "window", "overlay", "soundboard", "daemon", "tray", "bridge", "router")
SUBTYPES = (
    ("tracking_bridge", ("tracking~bridge", "face~tracking", "eye~tracking", "facetracking", "mocap~(?:bridge|osc)", "kinect", "body~tracking~bridge", "tracker~bridge")),
    ("companion_client", ("companion~(?:client|app|application)?", "friend~(?:manager|log)", "session~(?:logger|history)", "vrc~client", "account~manager")),
    ("streaming_accessibility", ("speech~to~text", "stt", "text~to~speech", "tts", "translation", "stream~overlay", "subtitles", "captions", "twitch~chat")),
    ("osc_control", ("osc~(?:tool|control|controller|router|dashboard|soundboard|app|application)", "chatbox~(?:osc|tool|app)", "avatar~parameters?~(?:osc|control)", "osc")),
    ("utility", ("cache~cleaner", "log~(?:watcher|parser|viewer)", "screenshot~(?:manager|organizer)", "desktop~utility", "vrc(?:hat)?~utility")),
)
KNOWN_TOOLS = (("vrcx", "vrcx", "companion_client", 0.98), ("vrcfacetracking", "vrcfacetracking|vrc~face~tracking", "tracking_bridge", 0.98), ("vrcosc", "vrcosc", "osc_control", 0.98), ("advosc", "advosc", "osc_control", 0.95))


def desktop_tool(title: Column, description: Column, links: Column, tags: Column) -> Column:
    """struct(is_tool, subtype, confidence, rule): the first rule that decides (F-13)."""
    low = lambda c: trim(F.lower(nfkc(F.coalesce(c, F.lit("")))))
    name, tag = low(title), normal_tags(tags)
    text = F.concat_ws(" ", name, low(description), F.array_join(tag, " "))
    exe = text.rlike(rf"(?<=[A-Za-z0-9_])\.exe{_E}")
    has = lambda choices: text.rlike(words(*choices))

    def verdict(tool: bool, subtype: str | Column | None, confidence: float, rule: str) -> Column:
        return F.struct(F.lit(tool).alias("is_tool"), (subtype if isinstance(subtype, Column) else F.lit(subtype).cast("string")).alias("subtype"), F.lit(confidence).alias("confidence"), F.lit(rule).alias("rule"))

    subtype = F.lit(None).cast("string")
    for kind, choices in reversed(SUBTYPES):
        subtype = F.when(has(choices), kind).otherwise(subtype)
    targeted = has(("vrchat", "vrc", "vrc-osc")) | F.exists(links, lambda u: F.lower(u).contains("vrchat"))
    steps = [(name.rlike(words(*pattern.split("|"))) | F.array_contains(tag, F.lit(key)), verdict(True, kind, sure, "known")) for key, pattern, kind, sure in KNOWN_TOOLS]
    steps += [
        (has(HARDWARE) & ~has(SOFTWARE) & ~exe, verdict(False, None, 0.05, "hardware")),
        (has(COSMETIC) & ~has(RUNNING) & ~exe, verdict(False, None, 0.02, "cosmetic")),
        (has(EDITOR) & ~has(STANDALONE) & ~exe, verdict(False, None, 0.15, "editor")),
        (~targeted & (has(("steamvr", "openvr", "valve~index", "vive")) | has(("osc", "open~sound~control"))), verdict(False, None, 0.15, "generic")),
        (~targeted, verdict(False, None, 0.05, "untargeted")),
        (subtype.isNotNull() & (has(DESKTOP) | exe), verdict(True, subtype, 0.88, "desktop")),
        (subtype.isNotNull(), verdict(False, subtype, 0.65, "unconfirmed")),
    ]
    out = verdict(False, None, 0.3, "mention")
    for condition, value in reversed(steps):
        out = F.when(F.coalesce(condition, F.lit(False)), value).otherwise(out)
    return out


# Avatar bases, each with its native spelling (a pattern) and its Latin one.
BASES = (
    ("kikyo", "桔梗", "kikyo|kikyou"), ("manuka", "マヌカ", "manuka"), ("shinano", "縹乃|しなの", "shinano"), ("selestia", "セレスティア", "selestia|celestia"),
    ("rindo", "竜胆", "rindo|rindou"), ("karin", "カリン", "karin"), ("grus", "(?<!サン)グラス", "grus"), ("maya", "舞夜", "maya"), ("moe", "(?<![a-zA-Z])萌(?!え)", "moe"),
    ("lime", "ライム", "lime"), ("mint", "ミント", "mint"), ("milk", "ミルク", "milk"), ("komano", "狛乃", "komano"), ("minase", "水瀬", "minase"), ("sio", "汐", "sio"),
    ("uzuki", "卯月", "uzuki"), ("chiffon", "シフォン", "chiffon"), ("cheryl", "シェリル", "cheryl"), ("lunalitt", "ルナリット", "lunalitt"), ("rushan", "ルーシャン", "rushan"),
    ("anri", "アンリ", "anri"), ("misaki", "みさき", "misaki"), ("vroid", None, "v-?roid"),
)
# What says that an item fits every avatar, and what says that a description declares a fit.
UNIVERSAL = rf"全アバター|全対応|汎用|アバター問わず|【対応】|(?i:{_B}universal(?:[{SPACE}]+fit|[{SPACE}]+avatar)?{_E}|{_B}all[{SPACE}]+avatars?{_W}(?:compatible|supported)?{_E}|{_B}any[{SPACE}]+avatar{_E})"
DECLARED = rf"(?i)対応|supported|compatible|for[{SPACE}]+|designed[{SPACE}]+for|動作確認"
SPAN = r"[【\[(（][^】\])）]+[】\])）]"


def avatar_compatibility(title: Column, description: Column, tags: Column, item_key: Column) -> Column:
    """array of struct(compatibility_id, item_key, target_avatar_base, scope, confidence, evidence_source) (F-14).

    A universal claim counts from the title, tags, then description; a base from brackets, tags, title, then description.
    """
    wide = lambda c: nfkc(F.coalesce(c, F.lit("")))
    name, about = wide(title), wide(description)
    tag = F.when(F.size(tags) > 0, F.split(nfkc(F.array_join(F.transform(tags, lambda t: F.coalesce(t, F.lit(""))), "\x1f")), "\x1f", -1)).otherwise(F.array().cast("array<string>"))
    inner = F.array_join(F.regexp_extract_all(name, F.lit(SPAN), F.lit(0)), " ")

    def record(base: str, scope: str, sure: Column, source: Column) -> Column:
        return F.struct(F.concat_ws(":", item_key, F.lit(base), F.lit(scope)).alias("compatibility_id"), item_key.alias("item_key"), F.lit(base).alias("target_avatar_base"), F.lit(scope).alias("scope"), sure.alias("confidence"), source.alias("evidence_source"))

    in_tags = lambda p: F.exists(tag, lambda t: t.rlike(p))
    source = F.when(name.rlike(UNIVERSAL), "title").when(in_tags(UNIVERSAL), "tags").when(about.rlike(UNIVERSAL), "description")
    found = [F.when(source.isNotNull(), record("generic", "universal", F.when(source == "description", "keyword_inferred").otherwise("creator_declared"), source))]
    for base, native, latin in BASES:
        pattern = "|".join(filter(None, (native, f"(?i:{_B}(?:{latin}){_E})")))
        source = F.when(inner.rlike(pattern), "title").when(in_tags(pattern), "tags").when(name.rlike(pattern), "title").when(about.rlike(pattern), "description")
        sure = F.when((source != "description") | about.rlike(DECLARED), "creator_declared").otherwise("keyword_inferred")
        found.append(F.when(source.isNotNull(), record(base, "named_base", sure, source)))
    return F.array_compact(F.array(*found))
