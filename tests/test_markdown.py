"""Markdown rendering, URL extraction, chunking."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from papyrine.operators import chunking, md_urls, render
from papyrine.operators.chunking import ChunkOptions, chunk

PLAIN = render.RenderOptions(proxy_images=False)
ADMIN = render.RenderOptions(allow_html=True, nofollow_links=False, proxy_images=False)


@pytest.mark.parametrize(
    ("md", "html"),
    [
        ("Rain today", "<p>Rain today</p>"),
        ("<u>wet</u>", "<p>&lt;u&gt;wet&lt;/u&gt;</p>"),
        ("[map](https://m.test 'Big')", '<p><a href="https://m.test" title="Big" rel="nofollow ugc noopener" target="_blank">map</a></p>'),
        ("[up](../a) [odd](x:y) [bad](vbscript:y)", '<p><a href="../a">up</a> <a>odd</a> <a>bad</a></p>'),
        ("![far](//m.test/x.gif)", '<p><img alt="far" /></p>'),
        ("wet\ncold", "<p>wet<br />\ncold</p>"),
        ("(https://m.test/a)", '<p>(<a href="https://m.test/a" rel="nofollow ugc noopener" target="_blank">https://m.test/a</a>)</p>'),
        ("_wet **cold** dry_ ~~hot~~ `x*y`", "<p><em>wet <strong>cold</strong> dry</em> <del>hot</del> <code>x*y</code></p>"),
        ("***wet*** **dry*", "<p><em><strong>wet</strong></em> *<em>dry</em></p>"),
        ("### Day ###\n\n* sun\n* rain\n  * hail", "<h3>Day</h3>\n<ul>\n<li>sun</li>\n<li>rain\n<ul>\n<li>hail</li>\n</ul>\n</li>\n</ul>"),
        ("3. sun\n\n   noon\n4. rain", '<ol start="3">\n<li>\n<p>sun</p>\n<p>noon</p>\n</li>\n<li>\n<p>rain</p>\n</li>\n</ol>'),
        ("> sun\nrain\n\n~~~c\na&b\n~~~", '<blockquote>\n<p>sun<br />\nrain</p>\n</blockquote>\n<pre><code class="language-c">a&amp;b\n</code></pre>'),
        ("|day|mm|\n|-|-:|\n|mon|4|", '<table>\n<thead>\n<tr>\n<th>day</th>\n<th align="right">mm</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td>mon</td>\n<td align="right">4</td>\n</tr>\n</tbody>\n</table>'),
        ("[rain]\n\n[rain]: /r 'Wet'", '<p><a href="/r" title="Wet">rain</a></p>'),
        ("Rain\n===\n\n- - -", "<h1>Rain</h1>\n<hr />"),
        ("\\_x\\_ &sect; w@m.test", '<p>_x_ § <a href="mailto:w@m.test">w@m.test</a></p>'),
        ("[sun [rain](r) hail](s)", '<p>[sun <a href="r">rain</a> hail](s)</p>'),
        ("", ""),
    ],
)
def test_render(md, html):
    assert render.render(md, PLAIN) == html


def test_admin():
    assert render.render("<i>wet</i> [map](https://m.test) <style>x</style>", ADMIN) == '<p><i>wet</i> <a href="https://m.test" rel="noopener" target="_blank">map</a> </p>'
    exact = [
        ('<style>x</style><img alt="map" src="data:x"><a href="vbscript:x">up</a><hr><li>sun</li><!-- rain -->', '<img alt="map"><a>up</a><hr><li>sun</li>'),
        ("<weather>sun</weather>", "sun"),
        ("a<br/>b", "a<br>b"),
        ('<a title="far" target="t">up</a>', '<a title="far">up</a>'),
        ('<dd id="d" class="k l" lang="nl" style="x" onfocus="y()">sun</dd>', '<dd id="d" class="k l">sun</dd>'),
    ]
    assert [(a, render.sanitize_admin(a)) for a, _ in exact] == exact


@pytest.mark.parametrize(
    ("md", "links"),
    [
        ("Maps at https://maps.com/a, also <http://maps.org>", ["https://maps.com/a", "http://maps.org"]),
        ("rain on weather.org today", ["weather.org"]),
        ("(see maps.nl/north?x=1!)", ["maps.nl/north?x=1!)"]),
        ("north: maps.nl/north.", ["maps.nl/north"]),
        ("[maps.nl](maps.nl) and maps.nl, MAPS.nl", ["maps.nl", "MAPS.nl"]),
        ("main.cpp and v2.10 of e.g. rain.wet", []),
        ("`maps.nl`\n\n    maps.org\n\n~~~\nmaps.com\n~~~", []),
        ("org.uk alone is a suffix", []),
        ("[a](vbscript:x) [b](?to=https://m.test) [c](#x:y) [d](//m.test)", ["?to=https://m.test", "#x:y"]),
    ],
)
def test_urls(md, links):
    assert md_urls.extract(md)[0] == links


def test_mail_is_no_domain():
    assert "weather.org" not in md_urls.extract("write to desk@weather.org about it")[0]
    assert md_urls.extract("![a](https://m.com/a.gif)![b](https://m.com/a.gif)![c](mailto:x)")[1] == ["https://m.com/a.gif"] * 2
    known = md_urls.suffixes()
    assert md_urls.registrable("a.b.co.uk", known) and not md_urls.registrable("co.uk", known) and not md_urls.registrable("a." * 130 + "uk", known)
    with pytest.raises(FileNotFoundError):
        md_urls.extract_markdown_urls(F.lit("x"), "/missing/list")


DAYS = "# Week\n\nSeven days\n\n## Monday\n\nSun\n\n## Tuesday\n\nRain\n"


def test_chunk_pins():
    crumbs = lambda md, *options: [(c.breadcrumb, c.level, c.text) for c in chunk(md, ChunkOptions(*options))]
    assert chunk("") == chunk(" \n\t\n ") == []
    plain = chunk("Only words, no heading at all.")
    assert [(c.level, c.header, c.headers, c.breadcrumb, c.text) for c in plain] == [(0, None, [], "", "Only words, no heading at all.")]
    assert crumbs(DAYS) == [("Week", 1, "Seven days\n\n## Monday\n\nSun\n\n## Tuesday\n\nRain")]
    assert crumbs(DAYS, None, None, 1) == [("Week", 1, "Seven days"), ("Week > Monday", 2, "Sun"), ("Week > Tuesday", 2, "Rain")]
    named = chunk("sun\n\nrain", ChunkOptions(title="Weather"))
    assert [(c.breadcrumb, c.header, c.headers) for c in named] == [("Weather", "Weather", ["Weather"])]
    twice = "# Sun\n\nhot\n\n# Sun\n\nwarm"
    assert len(crumbs(twice, None, None, 1)) == 2 and crumbs(twice, 100, 900, 2) == [("Sun", 1, "hot\n\nwarm")]
    assert crumbs("# Sky\n\nblue\n\n##### Cloud\n\nwhite", 900, 9000) == [("Sky", 1, "blue\n\n##### Cloud\n\nwhite")]
    assert crumbs("Before all.\n\n# Sky\n\nblue")[0] == ("", 0, "Before all.")
    assert crumbs("# Sky\n\n## Cloud\n\n#### Rain\n\n## Sun\n\nAt last.")[-1][2].endswith("At last.")
    assert chunk("## Sky\n\n#### Rain\n\nwet", ChunkOptions(phase=1))[-1].headers == [None, "Sky", None, "Rain"]
    code = chunk("# Sky\n\nblue\n\n~~~\n## no heading\n\nstill code\n~~~\n\nwhite", ChunkOptions(20, 400))
    assert all("no heading" not in c.breadcrumb for c in code) and any("## no heading\n\nstill code" in c.text for c in code)
    assert all(c.length <= 120 for c in chunk("# Sky\n\n" + "\n\n".join(["Blue all day. " * 7] * 4), ChunkOptions(max_length=120)))
    assert len(chunk("# Sky\n\n" + "blue " * 600, ChunkOptions(max_length=50))) == 1
    assert chunk("# Sky\n\nblue", ChunkOptions(800, 80)) and crumbs("#hash ####### seven")[0][1] == 0
    assert chunk("___CODE_BLOCK_7___ as text")[0].text == "___CODE_BLOCK_7___ as text"
    assert [chunking.count_length(x) for x in ("sun", "sun \n\t rain", "", " \u2003 ", "é", " \x1f ")] == [3, 8, 0, 0, 1, 1]
    assert [(c.text, c.length) for c in chunk("# Sky")] == [("", 3)]


def test_hostile():
    began = time.time()
    for x in ("`" * 9_999, "_b " * 5_000, "![" * 5_000, "> " * 5_000, "+ " * 2_000 + "y", "*b**c" * 3_000, "<b " * 5_000, "[b" * 5_000, "\\\\" * 2_500, "b.c" * 5_000, "## " * 5_000, "[b]: c\n" * 2_000, "|b" * 5_000):
        render.render(x)
        md_urls.extract(x)
        chunk(x)
    assert time.time() - began < 90


def test_columns(spark):
    df = spark.createDataFrame([(1, DAYS), (2, None), (3, "")], "id int, md string")
    rows = chunking.chunks_of(df, "id", "md", ChunkOptions(phase=1)).orderBy("id", "seq").collect()
    assert [(r.id, r.seq, r.breadcrumb) for r in rows] == [(1, 0, "Week"), (1, 1, "Week > Monday"), (1, 2, "Week > Tuesday")]
    assert df.select(render.render_markdown_to_html(F.col("md"))).collect()[1][0] is None
    one = df.repartition(1).select("id", md_urls.extract_markdown_urls(F.col("md")).alias("u"), chunking.length_of(F.col("md")).alias("n")).orderBy("id").collect()
    many = df.repartition(8).select("id", md_urls.extract_markdown_urls(F.col("md")).alias("u"), chunking.length_of(F.col("md")).alias("n")).orderBy("id").collect()
    assert one == many and one[0].n == chunking.count_length(DAYS)
