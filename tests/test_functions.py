"""URLs, hashes, versions, policies, tags and codecs against literal cases."""

import pytest
from pyspark.sql import functions as F

from sparrowgrid.functions import codecs, hashing, policy, tags, urls, versions


@pytest.mark.parametrize(("raw", "clean"), [
    ("https://example.com/items/12345?utm_source=twitter&utm_medium=social&aff=xyz&ref=affiliate&fbclid=abc&session_id=s123&keep=true", "https://example.com/items/12345?keep=true"),
    ("https://example.com?utm_source=twitter", "https://example.com"), ("not-a-url", "not-a-url"), (None, ""), ("HTTPS://Example.COM:443/a/../b", "https://example.com/b"), ("https://e.com/?a=1&b=2", "https://e.com/?a=1&b=2"),
])
def test_tracking(raw, clean):
    assert urls.without_tracking(raw) == clean


def test_links():
    assert urls.https_links_of(["https://a.b/?ref=1", "http://a.b/", None, "https://a.b/", "x"]) == ["https://a.b", "https://a.b/"]


@pytest.mark.parametrize(("url", "kind"), [
    ("https://github.com/o/r", "github_repository"), ("https://github.com/o", "publisher_site"), ("https://booth.pm/items/1", "storefront_product"), ("https://x.itch.io/g", "storefront_product"), ("https://itch.io/g", "publisher_site"),
    ("https://a.b/c.zip", None), ("http://a.b/", None), ("https://u:p@a.b/", None), ("https://a.b:8443/", None), ("https://localhost/x", None), ("https://x.local/", None), ("https://me.example/", "publisher_site"),
])
def test_lead_kind(one, url, kind):
    assert one(urls.lead_kind, url) == kind


def test_identities(one):
    assert one(urls.normal_identity, "https://GitHub.com/O/R.git/") == "https://github.com/o/r"
    assert one(urls.github_api_url, "https://github.com/o/r.git") == "https://api.github.com/repos/o/r"
    assert one(urls.github_repository, "https://api.github.com/repos/o/r") == "o/r"
    assert one(urls.github_repository, "https://api.github.com/repos/o/..") is None
    assert one(urls.booth_item, "https://booth.pm/ja/items/12") == "12"
    assert one(urls.sellfy_product, "https://Shop.sellfy.com/store/p/abc/") == "shop.sellfy.com:store:abc"


def test_fnv(one, spark):
    for word in ("", "a", "foobar", "Brand#11"):
        assert int(one(lambda c: hashing.unsigned_text(hashing.fnv1a64_native(c)), word)) == hashing.fnv1a64(word)
    assert hashing.fnv1a64("a") == 0xAF63DC4C8601EC8C


@pytest.mark.parametrize(("a", "b"), [("【VRChat想定】Modular Avatar対応 ツール", "Modular Avatar Tool"), ("【簡単導入】VRCFury対応 シェーダーシステム", "VRCFury Shader System")])
def test_simhash_near(a, b):
    assert (hashing.simhash64(a) ^ hashing.simhash64(b)).bit_count() <= 3


def test_simhash_empty():
    assert hashing.simhash64("") == hashing.simhash64(None) == 0


@pytest.mark.parametrize(("text", "good"), [("1.0.0", True), ("2.1.3-beta.1", True), ("v1.0.0", False), (" 1.0.0 ", False), ("1.0", False), ("01.0.0", False), ("latest", False), ("1.2.3-rc.2+build.04", True), (None, False)])
def test_version(one, text, good):
    assert one(versions.is_version, text) is good


@pytest.mark.parametrize(("a", "b", "sign"), [("1.0.0", "1.0.1", -1), ("2.0.0", "1.9.9", 1), ("1.0.0", "1.0.0", 0), ("1.0.0-beta.1", "1.0.0", -1), ("1.0.0-2", "1.0.0-10", -1), ("1.0.0-a", "1.0.0-1", 1), ("1.0.0-a.1", "1.0.0-a", 1)])
def test_compare(one, a, b, sign):
    assert versions.compare(a, b) == sign
    key_a, key_b = one(versions.sort_key, a), one(versions.sort_key, b)
    assert (key_a > key_b) - (key_a < key_b) == sign


def test_clean_version():
    assert versions.clean(" =v1.2.3+x ") == "1.2.3"
    assert versions.clean("1.2") is None


@pytest.mark.parametrize(("address", "reserved"), [("8.8.8.8", False), ("10.1.1.1", True), ("172.32.0.1", False), ("256.1.1.1", True), ("::1", True), ("2001:4860:4860::8888", False), ("::ffff:10.0.0.1", True), ("fe80::1", True), ("2001:db8::1", True), ("[fc00::1]", True), ("", True), ("x", True), ("::ffff:8.8.8.8", False)])
def test_addresses(one, address, reserved):
    assert policy.reserved_address(address) is reserved
    if ":" not in address:
        assert one(policy.is_reserved_v4, address) is reserved


def _headers(**pairs):
    return F.create_map(*[F.lit(x) for k, v in pairs.items() for x in (k.replace("_", "-"), v)]) if pairs else F.create_map().cast("map<string,string>")


@pytest.mark.parametrize(("status", "headers", "failure"), [(429, {}, "rate_limited"), (403, {}, "forbidden"), (403, {"retry_after": "9"}, "rate_limited"), (403, {"x_ratelimit_remaining": "0"}, "rate_limited"), (200, {"cf_mitigated": "challenge"}, "challenge"), (302, {}, None)])
def test_access(one, status, headers, failure):
    assert one(lambda s: policy.access_failure(s, _headers(**headers)), status, types=["int"]) == failure


@pytest.mark.parametrize(("headers", "seconds"), [({"retry_after": "42"}, 42), ({"retry_after": "999999"}, 86400), ({}, 300), ({"retry_after": "Wed, 01 Jan 2025 00:01:00 GMT"}, 60), ({"x_ratelimit_remaining": "0", "x_ratelimit_reset": "1735689630"}, 30), ({"retry_after": "-1"}, 300)])
def test_retry_after(one, headers, seconds):
    assert one(lambda n: policy.retry_after_seconds(_headers(**headers), n.cast("timestamp")), "2025-01-01 00:00:00") == seconds


ROBOTS = "User-agent: GoodBot\nDisallow: /private\nAllow: /private/ok\n\nUser-agent: *\nDisallow: /*.pdf$\n\nUser-agent: goodbot\nDisallow: /b\n"


@pytest.mark.parametrize(("agent", "path", "allowed"), [("GoodBot", "/private/x", False), ("goodbot", "/private/ok/x", True), ("GoodBot", "/b", False), ("GoodBot", "/x.pdf", True), ("Other", "/x.pdf", False), ("Other", "/x.pdfs", True), ("Other", "/private", True)])
def test_robots(agent, path, allowed):
    assert policy.robots_allow(ROBOTS, agent, path) is allowed


@pytest.mark.parametrize(("status", "allowed"), [(404, True), (410, True), (503, False), (None, False), (200, False)])
def test_robots_verdict(status, allowed):
    assert policy.robots_verdict(status, ROBOTS, "https://x/private/a", ("GoodBot", "Other")) is allowed


def test_hosts(one):
    for raw, host in (("BOOTH", "booth.pm"), ("https://Api.GitHub.com/x", "api.github.com"), ("gumroad:x", "gumroad.com"), ("itch", "itch.io"), ("z.example", "z.example")):
        assert one(policy.normal_host, raw) == host


def test_tags(one):
    call = lambda f, *t: one(lambda c: f(F.split(c, ","), *t), "misc,Avatar Shader,world")
    assert call(tags.category_from_tags, F.lit("x")) == "avatar_tool"
    assert call(tags.umbrella_from_tags) == "assets"
    assert one(lambda c: tags.category_from_tags(F.split(c, ","), F.lit("x")), "outfit,shader") == "x"
    assert one(lambda c: tags.keywords(F.split(c, ",")), " avatar ,tool,avatar,  ,vrc,tool") == ["avatar", "tool", "vrc"]


@pytest.mark.parametrize(("text", "systems"), [("for Linux and Mac OS", ["linux", "macos"]), ("setup.exe", ["windows"]), ("nothing", ["windows"]), (" .exe", ["windows"]), ("darwinism", ["windows"])])
def test_os(one, text, systems):
    assert one(tags.supported_os, text) == systems


@pytest.mark.parametrize(("title", "about", "verdict"), [
    ("VRCX", "", (True, "companion_client", 0.98)), ("VRChat Cache Cleaner & Screenshot Organizer", "desktop app", (True, "utility", 0.88)), ("Generic SteamVR Base Station Mount", "", (False, None, 0.05)),
    ("OpenVR helper", "", (False, None, 0.15)), ("Word processor", "", (False, None, 0.05)), ("VRChat osc", "", (False, "osc_control", 0.65)), ("VRChat thing", "", (False, None, 0.3)), ("Kikyo costume", "", (False, None, 0.02)), ("Unity Editor extension for VRChat", "", (False, None, 0.15)),
])
def test_desktop_tool(one, title, about, verdict):
    empty = F.array().cast("array<string>")
    got = one(lambda a, b: tags.desktop_tool(a, b, empty, empty), title, about)
    assert (got["is_tool"], got["subtype"], got["confidence"]) == verdict


@pytest.mark.parametrize(("title", "about", "bases"), [
    ("【桔梗・マヌカ・セレスティア対応】Cute Gothic Dress", "", {("kikyo", "creator_declared"), ("manuka", "creator_declared"), ("selestia", "creator_declared")}),
    ("【全アバター対応】スマートメガネ", "", {("generic", "creator_declared")}), ("Generic Party Prop", "Rindo wears it", {("rindo", "keyword_inferred")}), ("サングラス", "", set()), ("x", "made for Lime", {("lime", "creator_declared")}), ("manuka対応", "", {("manuka", "creator_declared")}),
])
def test_avatars(one, title, about, bases):
    got = one(lambda a, b: tags.avatar_compatibility(a, b, F.array().cast("array<string>"), F.lit("i")), title, about)
    assert {(g["target_avatar_base"], g["confidence"]) for g in got} == bases


@pytest.mark.parametrize(("platforms", "code"), [("booth", "0001"), ("github", "0002"), ("vpm", "0004"), ("gumroad", "0008"), ("shopify", "0080"), ("vpm,github", "0006"), ("booth,shopify", "0081"), (",".join(policy.PLATFORMS), "03ff")])
def test_capabilities(one, platforms, code):
    assert one(lambda c: codecs.capability_code(codecs.capability_mask(F.split(c, ","))), platforms) == code
    assert set(one(codecs.capabilities_of, code)) == set(platforms.split(","))


def test_cursors():
    text = codecs.encode_cursor("catalog", createdAt="2024-01-01T00:00:00.000Z", canonicalId="a")
    assert codecs.decode_cursor("catalog", text) == {"createdAt": "2024-01-01T00:00:00.000Z", "canonicalId": "a"}
    for bad in ("", "x", text + "=", text[:-1], "e30", None, codecs.encode_cursor("leads", firstSeenAt="a", leadKey="b")):
        assert codecs.decode_cursor("catalog", bad) is None


def test_endpoint(one):
    assert one(urls.join_endpoint, "https://e.example/base/", "/v1/x") == "https://e.example/base/v1/x"
    assert one(urls.join_endpoint, "https://e.example", "v1") == "https://e.example/v1"
