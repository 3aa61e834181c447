"""HTML tree, feed sanitiser, extraction, removals, boilerplate learning."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from papyrine.operators import boilerplate, dom, extract, rss


def clean(h: str, **options) -> str:
    return rss.sanitize(h, rss.RssOptions(**options))[0]


@pytest.mark.parametrize(
    ("html", "has", "lacks"),
    [
        ("<h3>Rain</h3><style>h3 { top: 0 }</style>tomorrow<script>let rain = 1</script>", ["<h3>Rain</h3>tomorrow"], ["top", "let"]),
        ('<ul><li>Tea<input name=q><select><option>Milk</select></ul><textarea>rum</textarea><object data="o"><b>cup</b></object><math><mi>z</mi></math>', ["<ul><li>Tea</li></ul>"], ["input", "Milk", "rum", "cup", "<mi>"]),
        ('<figure lang=en onclick=go() style="top:0" data-k=v aria-label=x>Map</figure>', ["<figure>Map</figure>"], ["lang", "onclick", "style", "data-k", "aria"]),
        ('<img alt="A map" src="map.png" srcset="map2.png 2x" sizes=9 height=4 onload=go()>', ['alt="A map"', 'src="map.png"', 'loading="lazy"', 'fetchpriority="low"', 'decoding="async"'], ["srcset", "sizes", "height", "onload"]),
        ('Tea<svg><text>leaf</text></svg><base href="//b.test"><meta charset=x><embed src=e>', ["Tea"], ["leaf", "base", "meta", "embed"]),
        ("<section><header> </header><summary>\n</summary></section><p>Tea</p><main><iframe src=i></iframe></main>", ["<p>Tea</p>"], ["section", "header", "summary", "main"]),
        ('<a href="VBScript&#x3a;go">Cup</a><a href=" java\nscript:go()">Pot</a><img src="data&colon;text/plain,x">', [">Cup</a>", ">Pot</a>", 'rel="nofollow noopener"', 'target="_blank"', "<img"], ["href", "script:", "src"]),
        ('<a href="mailto:tea@b.test">Write</a><a target=top rel=author href="../cup?a=b#c">Up</a>', ['href="mailto:tea@b.test"', 'href="../cup?a=b#c"'], ["author", '"top"']),
        ("<blockquote>Rain<table><tr><th>Day<td>Wet</table></blockquote><sup>2</sup>", ["<blockquote>Rain<table>", "<th>Day</th><td>Wet</td>", "</blockquote>", "<sup>2</sup>"], []),
        ("<tea-cup size=2><em>Full</em></tea-cup><!-- note -->", ["<em>Full</em>"], ["tea-cup", "size", "note"]),
        ("Sun<hr>Rain<br>Snow", ["Sun<hr>Rain<br>Snow"], []),
    ],
)
def test_sanitize(html, has, lacks):
    out = clean(html)
    assert all(x in out for x in has), out
    assert not any(x in out for x in lacks), out


def test_first_image_and_proxy():
    html = '<img src="here.gif"><object><img src="https://gone.test/a.gif"></object><img src="\thttps://one.test/a.gif "><img src="http://two.test/b.gif">'
    out, first = rss.sanitize(html, rss.RssOptions(True))
    assert first == "\thttps://one.test/a.gif " and out.count('src="/proxy/') == 2 and 'src="here.gif"' in out
    assert rss.sanitize(html)[1] == first and "proxy" not in rss.sanitize(html)[0]
    assert rss.sanitize("") == ("", None) and rss.sanitize("no image") == ("no image", None)


@pytest.mark.parametrize("html", ["<nav></nav>", "<FOOTER>\t</FOOTER>", "<aside>&#8195;</aside>", "<span>&nbsp; </span>", "<b>x</b><details title='a>b'>\n</details>"])
def test_empty_containers(html):
    assert rss.has_empty_container(html)


@pytest.mark.parametrize("html", ["<b></b>", "<navy></navy>", "<nav", "<nav>&#x;</nav>", "<td></td>", "<nav>.</nav>"])
def test_not_empty_containers(html):
    assert not rss.has_empty_container(html)


def test_tree():
    assert dom.serialize(dom.parse("<p>a<p>b<ul><li>c<li>d</ul>")) == "<p>a</p><p>b</p><ul><li>c</li><li>d</li></ul>"
    assert dom.serialize(dom.parse("<b><i>x</b>y</i>")) == "<b><i>x</i></b><i>y</i>"
    assert dom.serialize(dom.parse("<script>a<b && '</p>'</script>x")) == "<script>a<b && '</p>'</script>x"
    page = dom.parse('<html lang="en"><head><title>T</title></head><body><p>x</body></html>', fragment=False)
    assert dom.serialize(page) == '<html lang="en"><head><title>T</title></head><body><p>x</p></body></html>'
    assert [n.attrs["id"] for n in dom.select(dom.parse('<div class="a b" id="1"><p id="2"><i id="3" x="yz">q</i></p></div>'), ["div.a > p", "[x^=y]", "#1", "p b", "!!"])] == ["1", "2", "3"]


def test_hostile():
    began = time.time()
    for h in ("<" * 50_000, "<a " * 20_000, "<div>" * 20_000, '<a href="' * 20_000, "<!--" * 20_000, "<b>" * 5_000 + "</p>" * 1_000, "&amp;" * 50_000, "<p>" * 20_000, "x" * 1_000_000):
        rss.sanitize(h)
    assert time.time() - began < 60


def test_content():
    html = (
        '<!doctype html><html lang="nl"><head><meta property="OG:Title" content="Other"><title>\n Tea\t of Rain </title><meta name="Author" content="A. Cup"><meta name="author" content="late"><link rel="canonical next" href=" https://tea.test/rain ">'
        '<link rel="icon" href="/i.png"></head><body><header><a href="/menu">Menu</a></header><section id="text"><h4>Pots</h4><p>Boil <a href="https://kettle.test">the kettle</a>, buy <a rel="Sponsored" href="/shop">ours</a>.</p>'
        "<ol><li>Warm<ul><li>the pot</li></ul></li><li>Pour</li></ol><blockquote>Wait</blockquote><pre>t = 4\n  m</pre><table><tr><th>Leaf<th>Min<tr><td>Green<td>3</table></section></body></html>"
    )
    got = extract.content_of(html, extract.ConvertOptions(content_selectors=("#text",), link_rel_tokens_to_remove=("SPONSORED",)))
    assert (got["title"], got["canonical_url"], got["lang"], got["meta"]["author"]) == ("Tea of Rain", "https://tea.test/rain", "nl", "A. Cup")
    assert got["links"] == {"canonical": " https://tea.test/rain ", "next": " https://tea.test/rain ", "icon": "/i.png"}
    body = ["#### Pots", "Boil [the kettle](https://kettle.test), buy .", "1. Warm\n   - the pot\n2. Pour", "> Wait", "```\nt = 4\n  m\n```", "| Leaf | Min |\n| --- | --- |\n| Green | 3 |"]
    assert got["content"] == "\n\n".join(body)
    some = extract.content_of(html, extract.ConvertOptions(("header", "!!"), (), ("ours",), ("https://kettle.test",)))["content"]
    assert "Menu" not in some and "kettle" not in some and "ours" not in some and "Boil" in some
    dense = "<ul><li><a href=1>First other story</a><li><a href=2>Second other story</a></ul><p>A line of text that stays.</p>"
    assert extract.content_of(dense, extract.ConvertOptions(use_text_density_filter=True))["content"] == "A line of text that stays."
    assert extract.content_of("<meta property='og:title' content='Only this'><p>x")["title"] == "Only this"


@pytest.mark.parametrize("part", ["<div>x", "<li>x", "<ol><li>x", "<b>x", "<table><tr><td>x", "<a href=u>x", "<p>x</p>", "<blockquote>x", "<!-- ", "<script ", '<a "'])
def test_content_is_linear(part):
    took = []
    for size in (100_000, 400_000):
        began = time.time()
        root = dom.parse(part * (size // len(part)), fragment=False)
        parsed = time.time()
        extract._prepare(root, extract.ConvertOptions(("aside",), (), ("y",), (), (), True))
        if part.count("<") == 1 and "blockquote" not in part and part != "<li>x":
            extract.markdown_of(root)
        took.append(time.time() - parsed + 0 * began)
    assert took[1] < 8 * took[0] + 1, took


def test_embedding(spark):
    cases = {
        "<td>see <a href='/r'>the rain</a> <img src='r.gif' alt='wet street'></td>": "see the rain wet street",
        "<h5>Rain</h5>today": "##### Rain\n\ntoday",
        "  \n ": "",
        "<section><ul></ul></section>": "",
        "<li>never <i>closed": "- never *closed*",
        "<section>" * 120 + "far down" + "</section>" * 120: "far down",
        None: None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "h string").select("h", extract.html_to_embedding_text(F.col("h")).alias("t")).collect()
    assert {r.h: r.t for r in rows} == cases


def test_removals(spark):
    assert extract.apply_removals("<article><h2>Rain</h2><footer>Imprint</footer></article>", ["article > footer"], []) == "<article><h2>Rain</h2></article>"
    assert extract.apply_removals('Rain<ul id="m"> <li>Menu\n</li> </ul>', [], ['<ul id="m"><li>Menu</li></ul>', "plain", ""]) == "Rain"
    pages = spark.createDataFrame([(1, 1, "<p>a</p><nav>n</nav>"), (2, 2, "<p>b</p>"), (3, 1, None)], "page_id int, site_id int, html string")
    removals = spark.createDataFrame([(1, ["nav"], None)], "site_id int, css_selectors_to_remove array<string>, html_to_remove array<string>")
    got = {r.page_id: r.cleaned_html for r in extract.with_removals(pages, removals).collect()}
    assert got == {1: "<p>a</p>", 2: "<p>b</p>", 3: None}


def test_learn(spark):
    bar = '<div class="bar top">Weather desk, open all day for letters and calls</div>'
    page = "<html><body>{}<main><h1>Day {}</h1><p>Rain of day {}</p></main><dialog id='d'>{}</dialog></body></html>"
    rows = [(i, 1, page.format(bar, i, i, "Join" if i < 2 else f"No {i}")) for i in range(4)] + [(0, 1, page.format(bar, 0, 0, "Join")), (9, 2, "<ul>one page</ul>"), (10, 3, None)]
    df = spark.createDataFrame(rows, "page_id int, site_id int, html string")
    got = {r.site_id: r for r in boilerplate.extract_dom_removals(df).collect()}
    assert set(got) == {1, 2} and got[1].css_selectors_to_remove == ["div.bar.top"] and got[2].css_selectors_to_remove == got[2].html_to_remove == []
    assert got[1].html_to_remove == ['<dialog id="d">Join</dialog>']
    named = boilerplate.extract_dom_removals(df.filter("page_id < 2"), patterns=("weather desk",), ratio=2.0).filter("site_id = 1").head()
    assert named.css_selectors_to_remove == ["div.bar.top"]
    assert boilerplate.extract_dom_removals(df.limit(0)).count() == 0


def test_learn_paragraphs_of_varying_blocks(spark):
    page = "<div>{}<p>Contact: Douren 43</p></div><ul>{}<li class='x'>Our newsletter</li></ul><main><p>Same in all</p><p class='y'>{}</p><div><p>Text {}</p></div></main><p class='y'>End</p>"
    rows = [(i, 1, page.format(f"<p>Note {i}</p>", f"<li>Item {i}</li>" if i < 2 else f"<li class='x'>Other {i}</li>", i, i)) for i in range(4)]
    df = spark.createDataFrame(rows, "page_id int, site_id int, html string")
    got = boilerplate.extract_dom_removals(df).head()
    assert got.css_selectors_to_remove == [] and got.html_to_remove == ['<li class="x">Our newsletter</li>', '<p class="y">End</p>', "<p>Contact: Douren 43</p>"]
    few = df.withColumn("html", F.when(F.col("page_id") < 2, F.col("html")).otherwise("<p>Else</p>")).unionByName(spark.range(10, 20).selectExpr("int(id) page_id", "1 site_id", "concat('<p>', id, '</p>') html"))
    assert boilerplate.extract_dom_removals(few, patterns=("newsletter",)).head().css_selectors_to_remove == ["li.x"]
    foot = [(i, 1, "<footer><p>All rights</p></footer>" if i < 2 else f"<div><p>All rights</p><p>{i}</p></div>") for i in range(4)]
    got = boilerplate.extract_dom_removals(spark.createDataFrame(foot, "page_id int, site_id int, html string")).head()
    assert got.html_to_remove == ["<footer><p>All rights</p></footer>", "<p>All rights</p>"]
