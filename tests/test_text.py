"""Text functions against literal cases."""

import pytest

from sparrowgrid.functions import text


@pytest.mark.parametrize(("raw", "clean"), [("&amp; &lt; &gt; &quot; &#39; &#x2F;", "& < > \" ' /"), ("&amp;lt;", "<"), (None, ""), ("a&nbsp;b", "a b")])
def test_entities(one, raw, clean):
    assert one(text.unescape_html, raw) == clean


@pytest.mark.parametrize(("raw", "clean"), [("[FREE] [VRChat] Advanced Locomotion System v2.1.0 beta", "Advanced Locomotion System"), ("", ""), ("[FREE]", "[FREE]"), ("Tool　1.2", "Tool")])
def test_title(one, raw, clean):
    assert one(text.clean_title, raw) == clean


def test_listing_title(one):
    assert one(text.normalize_listing_title, "【VRChat想定】［無料］Modular Avatar対応 ツール（汎用）") == "Modular Avatar対応 ツール"


@pytest.mark.parametrize(("raw", "clean"), [("<b>CreatorName</b> (@TwitterHandle)", "CreatorName"), ("Author &amp; Co.", "Author & Co."), ("@SoloDev", "SoloDev"), ("Creator @handle", "Creator"), ("", "Unknown"), (None, "Unknown")])
def test_author(one, raw, clean):
    assert one(text.clean_author_name, raw) == clean
    assert text.author_of(raw or "") == clean


def test_description(one):
    raw = "A ![x](y) b\t c https://discord.gg/abc\r\n\n\n\n d "
    assert one(text.clean_description, raw) == "A b c \n\n d"
    assert text._described(raw) == "A b c \n\n d"


def test_readme():
    readme = "# Tool\n\n[![b](x)](y) Overview of it. `code` [link](u)\n\n- [Overview](#overview)\n\n```\nrun\n```\n* one\n* two\n\n## License\nMIT"
    assert text.readme_text(readme, "A synopsis.") == "A synopsis.\n\nOverview of it. code link\n\n- Overview\n\n- one\n- two"
    assert text.readme_text(None, "S") == "S"
    assert text.readme_text("Long enough first paragraph that ends here.\n\n" + "x" * 3000, None).startswith("Long enough")


@pytest.mark.parametrize(("args", "primary", "all_authors"), [
    (("Ann, Bob", "com.ann.tool", None, None), "ann", ["Ann", "Bob", "ann"]),
    (("Ann, Bob", "", "https://github.com/eve/tool", None), "Ann", ["Ann", "Bob"]),
    (("", "com.vrchat.base", None, None), "VRChat", ["VRChat"]),
    (("community", "jp.lilx.tool", "https://github.com/lilx/tool", None), "lilx", ["lilx"]),
    (("com", "", None, ["io", "Eve"]), "Eve", ["Eve"]),
])
def test_authors(args, primary, all_authors):
    assert text.authors_of(*args) == (primary, all_authors)


def test_segments():
    assert text.reverse_dns_segments("vpm:jp.lilxyzw.basispatcher") == ["lilxyzw", "basispatcher"]
    assert text.reverse_dns_segments("com.net") == ["com", "net"]
