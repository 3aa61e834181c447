"""URL rules on strings and the same rules as Columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from papyrine.functions import url_rules, urls
from papyrine.functions.hosts import host_of

KEY = "00ff" * 16
SAFE_LINKS = ["http://m.test", "https://m.test/?q", "HtTpS://m.test", "mailto:desk@m.test", "tel:112", "/up", "?page=2", "#top", "map.gif", "../a:b", "/go?to=ftp://m.test", "\n/up"]
UNSAFE_LINKS = [
    "", "//m.test", "/\\m.test", "\\/m.test", "\\\\m.test", "\\m", "javascript:0", "DATA:,x", "file:/etc", "vbscript:0", ":x", "two words:x", "9p:x", "a:b:c", "ja\nva\tscript:0", "\x02\\m.test", "\x1f", "&#x6a;avascript&colon;0",
]


def signed(url: str, key: str) -> str:
    """The proxied URL, made apart from the functions under test."""
    import base64
    import hashlib
    import hmac

    path = "/proxy/" + base64.urlsafe_b64encode(url.encode()).decode().rstrip("=")
    return f"{path}?sig={hmac.new(bytes.fromhex(key), path.encode(), hashlib.sha256).hexdigest()}"


def test_links_and_images():
    assert [u for u in SAFE_LINKS if not url_rules.is_safe_link(u)] == []
    assert [u for u in UNSAFE_LINKS if url_rules.is_safe_link(u)] == []
    assert url_rules.is_safe_image("http://m.test:81/a.gif") and url_rules.is_safe_image("a.gif")
    assert not any(map(url_rules.is_safe_image, ["mailto:desk@m.test", "tel:2", "data:image/gif,x", "sftp://m.test", "7z://m.test"]))


def test_dangerous_scheme_and_references():
    assert all(map(url_rules.has_dangerous_scheme, ["d\ra\rta:,x", "VB\nScript:0", "&#106avascript&#x3Ax", "JAVASCRIPT:0"]))
    assert not any(map(url_rules.has_dangerous_scheme, ["javascripts:0", "x-data:0", "/javascript:0"]))
    decoded = {"m&amp;n": "m&n", "m&#n": "m&#n", "&#106avascript&#x3Ax": "javascript:x", "&#xDFFF;&#4294967296;": "&#xDFFF;&#4294967296;", "&amp;#x41": "A"}
    assert {k: url_rules.decode_references(k) for k in decoded} == decoded


def test_proxy():
    url = "https://m.test/rain.gif"
    assert url_rules.to_proxy(url, "/proxy/", (KEY,)) == url_rules.to_proxy(f" {url}\n", "/proxy/", ("xyz", KEY, "11")) == signed(url, KEY)
    assert url_rules.to_proxy(url, "/proxy/", ("xyz",)) == signed(url, KEY).split("?")[0] and url_rules.to_proxy(url, "/proxy/", ("",)) == signed(url, "")
    assert url_rules.to_proxy(" \t", "/proxy/", (KEY,)) == " \t" and url_rules.to_proxy(url, "", (KEY,)) == url


def test_columns_agree_with_strings(spark):
    values = [*SAFE_LINKS, *UNSAFE_LINKS, "https://example.com/photo.jpg", "  HTTP://x ", "/proxy/x", " https://x　", "a:b", "../r.jpg", "https://例え.jp/" + "長" * 200]
    rows = (
        spark.createDataFrame([(v,) for v in [*values, None]], "u string")
        .select(
            "u",
            urls.is_safe_link(F.col("u")).alias("link"),
            urls.is_safe_image(F.col("u")).alias("image"),
            urls.has_dangerous_scheme(F.col("u")).alias("danger"),
            urls.is_external_http(F.col("u")).alias("external"),
            urls.is_relative(F.col("u")).alias("relative"),
            urls.should_proxy(F.col("u")).alias("proxy"),
            urls.to_proxy(F.col("u"), keys=(KEY,)).alias("signed"),
        )
        .collect()
    )
    for r in rows:
        if r.u is None:
            assert r.link is None and r.signed is None
            continue
        assert r.link == url_rules.is_safe_link(r.u), r.u
        assert r.image == url_rules.is_safe_image(r.u), r.u
        assert r.danger == url_rules.has_dangerous_scheme(r.u), r.u
        assert r.external == url_rules.is_external_http(r.u), r.u
        assert r.relative == url_rules.is_relative(r.u), r.u
        assert r.proxy == url_rules.should_proxy(r.u, "/proxy/"), r.u
        assert r.signed == url_rules.to_proxy(r.u, "/proxy/", (KEY,)), r.u


@pytest.mark.parametrize(
    ("url", "host"),
    [("HTTPS://WWW.A.test:443/x", "a.test"), ("//b.test/y?z", "b.test"), ("/rel", ""), ("http://u:p@c.test#f", "c.test"), ("", ""), (None, None), ("mailto:a@b.c", "")],
)
def test_hosts(spark, url, host):
    assert spark.createDataFrame([(url,)], "u string").select(host_of(F.col("u"))).head()[0] == host
