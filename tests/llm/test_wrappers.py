"""Simple tree matching and the slots of a host's pages."""

from __future__ import annotations

import itertools
import random

from papyrine.llm import wrappers
from papyrine.llm.wrappers import Tree, page_slots, tree_match


def score(a: Tree, b: Tree, xs: list[int], ys: list[int]) -> float:
    """The best order-keeping match of two lists of children, by trying all of them."""
    best = 0.0
    for k in range(min(len(xs), len(ys)) + 1):
        for p in itertools.combinations(xs, k):
            for q in itertools.combinations(ys, k):
                if all(a.tags[x] == b.tags[y] for x, y in zip(p, q)):
                    best = max(best, sum(1 + (0.5 if a.keys[x] and a.keys[x] == b.keys[y] else 0) + score(a, b, a.children[x], b.children[y]) for x, y in zip(p, q)))
    return best


def test_matching_is_best():
    r = random.Random(1)
    make = lambda d: "".join(f"<{t}>{r.choice('ab')}{make(d - 1) if d else ''}</{t}>" for t in r.choices(["div", "span", "b"], k=r.randint(0, 3)))
    for _ in range(25):
        a, b = Tree(make(2)), Tree(make(2))
        got = tree_match(a, b)
        value = sum(1 + (0.5 if a.keys[x] and a.keys[x] == b.keys[y] else 0) for x, y in got.items())
        assert value == score(a, b, a.roots, b.roots)
        assert all(a.tags[x] == b.tags[y] for x, y in got.items()) and len(set(got.values())) == len(got)


def test_slots(spark):
    page = "<html><body><nav><a>Home</a><a>News</a></nav><main><h1>Title {0}</h1><p>Text {0} of its own</p>{1}</main><footer>All rights reserved</footer></body></html>"
    rows = [(i, f"http://www.a.test/{i}", page.format(i, "<p>more</p>" if i == 2 else ""), 7) for i in range(6)]
    rows += [rows[0], (20, "https://b.test/x", "<p>alone</p>", 7), (21, None, "<p>no host</p>", 7), (22, "https://a.test/y", None, 7), (23, "https://a.test/z", "", 7)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, host int")
    got = {r.page_id: r.slots for r in page_slots(df).collect()}
    assert set(got) == {*range(6), 20, 21, 23}
    assert got[2] == ["Title 2", "Text 2 of its own", "more"] and got[4] == ["Title 4", "Text 4 of its own"]
    assert got[20] == ["alone"] and got[21] == ["no host"] and got[23] == []
    assert page_slots(df.limit(0)).count() == 0


def test_wide_and_deep():
    assert len(tree_match(Tree("<div>" * 300), Tree("<div>" * 300))) == 300
    assert wrappers.WIDEST > 0 and len(tree_match(Tree("<p>x</p>" * 900), Tree("<p>x</p>" * 900))) == 900


def test_optional_furniture_and_layouts(spark):
    """No page holds all the furniture of the host, whichever page is looked at first."""
    notes = ["We store small files", "Mail every Friday", "Share this story", "Written by the desk"]
    rows = []
    for i in range(40):
        own = "".join(f"<div><p>{n}</p></div>" for k, n in enumerate(notes) if i % 4 == k)
        body = f"<div><p>Text {i} here</p></div>" * (i % 3) + own + f"<div><p>End {i}</p></div>"
        rows.append((i, "http://a.test/", f"<ul><a>Home</a></ul>{body}" if i % 2 else f"<table><tr><td>Other layout</td></tr></table><main>{body}</main>"))
    got = {r.page_id: r.slots for r in page_slots(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for i in range(40):
        assert got[i] == [f"Text {i} here"] * (i % 3) + [f"End {i}"]


def test_wide_lists_are_exact(monkeypatch):
    make = lambda n: Tree("<div>Top</div>" + "".join(f"<p>{i} of {n}</p>" for i in range(n)) + "<p>Foot</p><p>Last {0}</p>".format(n))
    a, b = make(600), make(601)
    foot = tree_match(a, b)
    assert foot[601] == 602 and foot[0] == 0 and len(foot) == 603
    r = random.Random(2)
    page = lambda: Tree("".join(f"<{t}><b>{r.randint(0, 9)}</b></{t}>" for t in r.choices(["div", "p", "ul"], k=90)))
    for _ in range(3):
        a, b = page(), page()
        monkeypatch.setattr(wrappers, "WIDEST", 10**9)
        kept = tree_match(a, b)
        monkeypatch.setattr(wrappers, "WIDEST", 1)
        assert tree_match(a, b) == kept
    a, b = Tree("<div>" * 3000 + "x"), Tree("<div>" * 3000 + "y")
    assert len(tree_match(a, b)) == 3000
